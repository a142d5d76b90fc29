"""Best-fit packing of tokenized documents into sequences of fixed capacity.

The plan needs only the histogram of piece lengths, which has at most
`capacity` lines however large the corpus is. Pieces above one third of the
capacity fit at most twice into a bin: they are matched greedily, the longest
with the longest partner that fits. Shorter lengths then go, longest first,
into the smallest gap that takes them. Every step treats all bins of one
content as one group, so the plan stays bounded too (each length splits at
most two groups). Rows find their place by their rank within their length.
"""

from __future__ import annotations

import bisect
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galvanite.llm.shared import lean, staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SEGMENTS = "seg_length long, rank_from long, rank_to long, bin_from long, per_bin long, at long"


class PieceMemo:
    """Ids of whole texts by a memo of their pre-tokens, as little-endian bytes.

    A byte-level BPE without normalizer never merges across its pre-tokens, so
    the ids of a text are those of its pre-tokens in a row. Texts with added
    tokens or with characters that the pattern here may class otherwise, and
    tokenizers of another kind, go through the library as a whole. Words that
    are new go through it too, all of a batch at once.
    """

    # Fixed value: the splitting pattern of byte-level pre-tokenizers.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, room: int = 500_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.able = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") \
            and not spec["model"].get("dropout")
        self.pattern, self.room, self.longest = regex.compile(self.PATTERN), room, longest
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.usual = set(map(chr, range(128)))
        self.ids: dict[str, bytes] = {}

    def ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, text: str) -> bool:
        if not self.able or any(t in text for t in self.added):
            return False
        if not text.isascii() and (fresh := set(text) - self.usual):
            self.usual |= {c for c in fresh if unicodedata.category(c) != "Cn"}
            return not fresh - self.usual
        return True

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [self.pattern.findall(t) if self.plain(t) else None for t in texts]
        new = set().union(*filter(None, words)).difference(self.ids)
        if len(self.ids) + len(new) > self.room:
            new |= set().union(*filter(None, words))
            self.ids.clear()
        asked = list(new)
        self.ids.update(zip(asked, self.ask(asked)))
        rest = iter(self.ask([t for t, w in zip(texts, words) if w is None]))
        out = [next(rest) if w is None else b"".join(map(self.ids.__getitem__, w)) for w in words]
        for w in new:
            if len(w) > self.longest:
                del self.ids[w]
        return out


def token_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, batch_chars: int = 1 << 19, memo_words: int = 500_000) -> DataFrame:
    """Token ids of each text plus `end_id`, cut into pieces of `capacity`; the first piece takes the rest.

    Null texts count as empty (one piece with `end_id` alone), null ids stay
    null, repeated rows give repeated pieces. `tokenizer` is a file path that
    every worker can read; unset, the installed byte_bpe_50k.json.
    """

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        memo, end = PieceMemo(str(path), memo_words), end_id.to_bytes(4, "little")

        def rows(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            of, piece, start, length, crc = [], [], [], [], []
            for i, raw in enumerate(memo.encode(texts)):
                tokens = np.frombuffer(raw + end, dtype="<u4")
                a, n = 0, len(tokens)
                b = n % capacity or min(capacity, n)
                k = 0
                while a < n:
                    of.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(tokens[a:b].tobytes()))
                    a, b, k = b, b + capacity, k + 1
            return pa.record_batch([
                ids.take(pa.array(of, pa.int64())).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        for batch in batches:
            texts, first, size = batch.column(1), 0, 0
            part: list[str] = []
            for i in range(batch.num_rows):
                part.append(texts[i].as_py() or "")
                size += len(part[-1])
                if size >= batch_chars or i + 1 == batch.num_rows:
                    yield rows(batch.column(0).slice(first, len(part)), part)
                    first, size, part = i + 1, 0, []

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, PIECES)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, rank_from, rank_to, bin_from, per_bin, offset) that place every rank of every length."""
    left = {n: c for n, c in histogram.items() if c > 0}
    bins: list[list] = [[] for _ in range(capacity + 1)]  # gap -> groups [number of bins, [(length, per bin), ...]]
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        i = bisect.bisect_right(large, capacity - a) - 1
        b = large[i] if i >= 0 else None
        if b == a and left[a] < 2:
            b = large[i - 1] if i else None
        if b is None:
            n, content, gap = left[a], [(a, 1)], capacity - a
            left[a] = 0
        elif b == a:
            n, content, gap = left[a] // 2, [(a, 2)], capacity - 2 * a
            left[a] %= 2
        else:
            n, content, gap = min(left[a], left[b]), [(a, 1), (b, 1)], capacity - a - b
            left[a] -= n
            left[b] -= n
        bins[gap].append([n, content])
        large = [x for x in large if left[x]]
    for size in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[size]
        for gap in range(size, capacity):
            fit, keep = gap // size, []
            for group in bins[gap]:
                full = min(group[0], count // fit)
                if full:
                    bins[gap - fit * size].append([full, [*group[1], (size, fit)]])
                    count -= full * fit
                    group[0] -= full
                if 0 < count < fit and group[0]:
                    bins[gap - count * size].append([1, [*group[1], (size, count)]])
                    group[0] -= 1
                    count = 0
                if group[0]:
                    keep.append(group)
            bins[gap] = keep
            if not count:
                break
        fit = capacity // size
        if count // fit:
            bins[capacity - fit * size].append([count // fit, [(size, fit)]])
        if count % fit:
            bins[capacity - count % fit * size].append([1, [(size, count % fit)]])
    out, used, first = [], dict.fromkeys(histogram, 0), 0
    for groups in bins:
        for n, content in groups:
            at = 0
            for size, per in content:
                out.append((size, used[size], used[size] + n * per, first, per, at))
                used[size] += n * per
                at += size * per
            first += n
    return out


def pack(pieces: DataFrame, capacity: int = 2048, rows_per_rank: int = 1_000_000, least_ranks: int = 64) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...).

    Ranks within a length are counted in hashed parts, so that a length that
    a third of all pieces share spreads over tasks. Repeated rows take places
    of their own. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    parts = max(least_ranks, -(-total // rows_per_rank))
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    counts = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` lines
    segments = spark.createDataFrame(plan_bins(histogram, capacity), SEGMENTS)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    ranked = salted.withColumn("r", F.row_number().over(within)).join(base, ["length", "part"]).withColumn("r", F.col("r") + F.col("base") - 1)
    s = F.broadcast(segments)  # bounded by the capacity, not by the corpus
    hit = ranked.join(s, (F.col("length") == F.col("seg_length")) & (F.col("r") >= F.col("rank_from")) & (F.col("r") < F.col("rank_to")))
    nth = F.col("r") - F.col("rank_from")
    return hit.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin_from") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("per_bin") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, memo_words: int = 500_000) -> DataFrame:
    """Tokenize once into a written table of numbers, then pack; a worker remembers the ids of at most `memo_words` words."""
    return pack(staged(token_pieces(docs, capacity, tokenizer, memo_words=memo_words), "pieces"), capacity)
