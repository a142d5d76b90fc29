"""Toxicity: logistic regression on hashed words with a counterfactual penalty.

Labelled texts are scored together with a copy in which identity terms are
swapped; the loss adds the squared change of the score, so that neutral
mentions of a group do not raise it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from galvanite.llm.shared import lean, small_batches, staged

# Identity terms; each is swapped for the next of its line.
IDENTITY = [
    "women men", "woman man", "girls boys", "girl boy", "gay straight lesbian bisexual", "muslim christian jewish hindu buddhist atheist",
    "muslims christians jews hindus buddhists atheists", "black white asian latino", "immigrant citizen refugee", "immigrants citizens refugees",
    "trans cis", "deaf blind disabled", "old young", "mujeres hombres", "frauen männer", "femmes hommes",
]
SWAP = {a: b for line in IDENTITY for a, b in zip(line.split(), line.split()[1:] + line.split()[:1])}
WORD = re.compile(r"[^\W_]+")
BITS = 20


MASK = (1 << BITS) - 1
STEMS = (4, 5, 6, 7)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@lru_cache(maxsize=30_000)
def word_slots(word: str) -> tuple[int, ...]:
    """Feature numbers of a word and of its stems (first letters), which catch inflected forms."""
    return tuple(zlib.crc32(x.encode()) & MASK for x in (word, *(f"{word[:k]}^" for k in STEMS if len(word) >= k)))


def mark(f, k: int):
    """Feature number of mark `k` of feature `f`."""
    return (f * 31 + k + 1) * 2654435761 >> 3 & MASK


def slots(words: list[str]) -> np.ndarray:
    """Sorted feature numbers of a text: its words and stems, and marks of those that come often or make up much of it."""
    counts: Counter[int] = Counter()
    for word, n in Counter(words).items():
        for f in word_slots(word):
            counts[f] += n
    f = np.fromiter(counts.keys(), dtype=np.int64, count=len(counts))
    n = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    size = max(len(words), 1)
    often = [n >= 2, n >= 4, (n >= 2) & (n * 100 >= size), (n >= 2) & (n * 30 >= size)]
    return np.unique(np.concatenate([f, *(mark(f[x], k) for k, x in enumerate(often))]))


def features_column(text: Column) -> Column:
    """Struct of two feature lists: the text, and its copy with swapped identity terms (null for a text without any)."""

    @pandas_udf("own array<int>, other array<int>")
    @lean
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            for at in range(0, len(texts), 128):  # feature lists are long: they leave in small parts
                sets = [words_of(t) for t in texts.iloc[at:at + 128]]
                yield pd.DataFrame({"own": [slots(s).astype(np.int32) for s in sets], "other": [None if SWAP.keys().isdisjoint(s) else slots([SWAP.get(w, w) for w in s]).astype(np.int32) for s in sets]})
        word_slots.cache_clear()

    return make(F.coalesce(text, F.lit("")))


def only_column(features: Column, kept: np.ndarray) -> Column:
    """Feature lists without the features that are not kept."""
    wanted = np.zeros(1 << BITS, dtype=bool)
    wanted[kept] = True
    packed = np.packbits(wanted)

    @pandas_udf("array<int>")
    @lean
    def only(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = np.unpackbits(packed).astype(bool)
        for lists in batches:
            for at in range(0, len(lists), 128):
                yield lists.iloc[at:at + 128].map(lambda f: f[bits[f]])

    return only(features)


def is_held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, rounds: int = 200, swap_weight: float = 1.0, l2: float = 1e-3) -> np.ndarray:
    """Weights, the last one for the constant, from at most `max_rows` labelled rows.

    The rows are the first ones by a hash of the id, the same on every run; of
    repeated ids the least text counts. Features are counted and chosen in
    Spark; only the chosen ones come to the driver, as one Arrow table. Rows
    without id, held-out rows and null labels are left out; without any row
    the weights give a score of one half everywhere below the threshold.
    """
    small_batches(docs.sparkSession)
    use = labels.where(~is_held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    use = use.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(use), "doc_id")  # at most max_rows lines of two numbers
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = staged(rows.select("doc_id", "toxic", features_column(F.col("text")).alias("f")).select("doc_id", "toxic", "f.*"), "labelled")
    n1, n0 = rows.agg(F.sum((F.col("toxic") > 0).cast("long")), F.sum((F.col("toxic") <= 0).cast("long"))).first()
    width = 1 << BITS
    weights = np.zeros(width + 1)
    if not (n1 or n0):
        weights[-1] = -2.0
        return weights
    n1, n0 = max(n1, 1), max(n0, 1)
    # Words of few texts carry noise only, and those alike in both kinds say nothing: they get no weight.
    # Log-odds of a word in toxic texts scale its feature, so that few rounds suffice.
    seen = rows.select(F.explode("own").alias("f"), "toxic").groupBy("f").agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("long")).alias("pos"))
    scale = F.log((F.col("pos") + 0.5) / n1) - F.log((F.col("n") - F.col("pos") + 0.5) / n0)
    found = seen.where(F.col("n") >= 5).select("f", scale.alias("scale")).where(F.abs("scale") >= 2.0).toArrow().sort_by("f")  # fewer than 2^BITS lines of two numbers
    kept, scale = found["f"].to_numpy(), found["scale"].to_numpy()
    table = rows.orderBy("doc_id").select("toxic", only_column(F.col("own"), kept).alias("own"), only_column(F.coalesce("other", "own"), kept).alias("other")).toArrow()
    y = (table["toxic"].to_numpy() > 0).astype(float)
    k = len(kept)
    full, weights = weights, np.zeros(k + 1)

    def matrix(name: str):
        column = table[name].combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        return np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(kept, column.flatten().to_numpy())

    own, other = matrix("own"), matrix("other")
    case = np.where(y > 0, n0 / n1, 1.0) / (2 * n0)
    n, at, m1, m2 = len(y), 0, np.zeros(k + 1), np.zeros(k + 1)

    def margin(part):
        return np.bincount(part[0], weights=weights[part[1]] * scale[part[1]], minlength=n) + weights[-1]

    def back(part, g):
        out = np.zeros(k + 1)
        out[:-1] = np.bincount(part[1], weights=g[part[0]], minlength=k) * scale
        out[-1] = g.sum()
        return out

    for at in range(1, rounds + 1):
        z, swapped = margin(own), margin(other)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        d = 2 * swap_weight * (z - swapped) / n  # changes count in log-odds, where a sure score still moves
        g = back(own, case * (p - y) + d) + back(other, -d) + l2 * weights / n
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        weights = weights - 0.1 * (m1 / (1 - 0.9**at)) / (np.sqrt(m2 / (1 - 0.99**at)) + 1e-9)
    full[kept], full[-1] = weights[:-1] * scale, weights[-1]
    return full


def score_column(text: Column, weights: np.ndarray) -> Column:
    """Score from 0 to 1; a null text counts as empty."""
    per, bias = weights[:-1], float(weights[-1])
    every = np.arange(1 << BITS)
    useful = (per != 0) | np.any([per[mark(every, k)] != 0 for k in range(4)], axis=0)
    numbers = np.flatnonzero(useful)
    table = {f: tuple(w) for f, *w in zip(numbers.tolist(), *(x.tolist() for x in (per[numbers], *(per[mark(numbers, k)] for k in range(4)))))}

    @pandas_udf("double")
    @lean
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            out = []
            for t in texts:
                words = words_of(t)
                size, counts, z = max(len(words), 1), Counter(), bias
                for word, n in Counter(words).items():
                    if (own := known.get(word)) is None:
                        if len(known) > 50_000:
                            known.clear()
                        own = known[word] = tuple(f for f in word_slots(word) if f in table)
                    for f in own:
                        counts[f] += n
                for f, n in counts.items():
                    one, two, four, some, much = table[f]
                    z += one + (n >= 2 and two + (n >= 4) * four + (n * 100 >= size) * some + (n * 30 >= size) * much)
                out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
            yield pd.Series(out, dtype=float)
        word_slots.cache_clear()

    return score(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted per row of `docs`; null ids are not held out, repeated rows score alike."""
    weights = train(docs, labels, max_rows)
    df = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), weights).alias("score"))
    return df.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
