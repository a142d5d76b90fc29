"""Quality by repetition: suffix array over the words of a text.

Neighbours in the suffix array share a prefix of lcp words; the intervals of
equal lcp are the maximal repeats. Their spans are united; the covered
fraction and the longest repeat decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long"


def neighbour_lcp(ids: np.ndarray) -> np.ndarray:
    """For each position the longest prefix, in words, that its suffix shares with another one."""
    n = len(ids)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while width < n and ranks[-1].max() < n - 1:
        tail = np.zeros(n, dtype=np.int64)
        tail[:-width] = ranks[-1][width:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 1) + tail, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    shared = np.zeros(n - 1, dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step, rank = 1 << level, ranks[level]
        while True:  # a level can fit more than once only at the top
            i, j = a + shared, b + shared
            ok = (i < n) & (j < n)
            ok[ok] = rank[i[ok]] == rank[j[ok]]
            shared[ok] += step
            if level < len(ranks) - 1 or not ok.any():
                break
    out = np.zeros(n, dtype=np.int64)
    out[a] = shared
    np.maximum.at(out, b, shared)
    return out


def covered(lcp: np.ndarray, least: int) -> int:
    """Words inside the union of the repeats of at least `least` words."""
    n = len(lcp)
    at = np.flatnonzero(lcp >= least)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + lcp[at], n), -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: str, least: int) -> tuple[int, ...]:
    words = WORD.findall(text)
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    lcp = neighbour_lcp(ids)
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        covered(lcp, 8), covered(lcp, least), int(lcp.max(initial=0)))


def measure_column(text: Column, least: int = 5) -> Column:
    @pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        for texts in batches:
            yield pd.DataFrame([measure(t, least) for t in texts], columns=names)

    return run(F.coalesce(text, F.lit("")))


def judge_repetition(docs: DataFrame, least: int = 5, max_covered: float = 0.4, long_words: int = 100, max_long: float = 0.25) -> DataFrame:
    """Base counts and the verdict per row of `docs` (doc_id, text).

    A text is kept unless it fails the base rule, repeats of `least` words
    cover more than `max_covered` of it, or one repeat has over `long_words`
    words and over `max_long` of the text. Null texts have no words and fail;
    null ids stay; repeated rows are judged one by one.
    """
    m = docs.select("doc_id", measure_column(F.col("text"), least).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    bad = (F.col("n_covered") > max_covered * F.col("n_words")) | (
        (F.col("longest_repeat") > long_words) & (F.col("longest_repeat") > max_long * F.col("n_words")))
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & ~bad)
