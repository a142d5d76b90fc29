"""Near duplicates by bottom-k sketches of one hash function.

Texts with equal shingle sets form one node. A node keeps its k smallest
shingle hashes; inverted lists of these values give candidate pairs, the
sketch of the union estimates their similarity, and the full sets confirm it.

Two sets with a Jaccard similarity of at least t share at least `least` sketch
values (exactly so for small sets; else with a failure rate below 1e-8 at the
limit itself). Hence one shared value lies among the `size - least + 1` rarest
values of each node, and only those are listed: values of passages that many
documents share drop out, as their nodes have rarer ones.

In a list every member is first compared with the head of the list, its most
typical member; members that end in one component need no further comparison.
Such turns, with other heads, go on while they lessen the pairs across components of a list; the
pairs that are left are then all compared, each at most once, but for those of
long lists whose own shingles (full sets, counted exactly) rule the link out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galvanite.llm.decontam import NO_ID
from galvanite.llm.shared import LOWER, UPPER, lean, staged

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans(UPPER, LOWER)
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle."""
    words = WORD.findall((text or "").translate(_LOW))
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(" ".join(words))], dtype=np.uint64)
    one: dict[str, int] = {}
    for w in words:
        if w not in one:
            one[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(one.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - width + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        total = mixed(total + h[i:i + n] * _MULT[i % 5] + np.uint64(i + 1))
    return np.unique(total)


SKETCH = "doc_id long, id0 long, h long, node binary, n_shingles long, sketch array<long>"


def sketches(docs: DataFrame, k: int, width: int) -> DataFrame:
    """Per row: node (digest of the shingle set, null if empty), set size, k smallest hashes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, kept = [], [], []
            for t in batch.column(3):
                s = shingle_hashes(t.as_py(), width)
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sizes.append(len(s))
                kept.append(s[:k].view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
            flat = np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)
            yield pa.record_batch([
                batch.column(0), batch.column(1), batch.column(2), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int64()))], names=["doc_id", "id0", "h", "node", "n_shingles", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id0"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, SKETCH)


def inverted_lists(nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """v, node, n, typical: the rarest sketch values of each node that another node has too.

    `typical` sums the frequencies of the sketch values: within a group of
    copies it is greatest where edits are fewest.
    """
    least_small = F.ceil(F.col("n") * percent / 100)
    sure = math.floor(k * percent / 100)  # sets up to this size have partners that are sketched in full
    least = F.when(F.col("n") <= sure, least_small).otherwise(F.lit(k // 2))
    values = nodes.select("node", "n", F.least("n", F.lit(k)).alias("size"), F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    shared = values.join(common, "v")
    w = Window.partitionBy("node")  # at most k rows each
    ranked = shared.withColumn("own", F.col("size") - F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("f", "v"))).withColumn("typical", F.sum("f").over(w))
    return ranked.where(F.col("r") + F.col("own") <= F.col("size") - least + 1).select("v", "node", "n", "typical")


def sketch_estimate(a, b, k: int):
    """Share of the k smallest values of the union that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return both / F.size(union)


def verified(pairs: DataFrame, members: DataFrame, texts: DataFrame, k: int, percent: int, width: int, slack: float, cache_shingles: int = 1_000_000) -> DataFrame:
    """Pairs (a, b) that the sketches of `members` (node, sketch) allow and the full sets of `texts` (node, text) confirm."""
    side = lambda x: members.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
    # Hashes are ordered as unsigned numbers; flipping the sign bit keeps that order for signed ones.
    flip = lambda c: F.transform(c, lambda v: v.bitwiseXOR(F.lit(NO_ID)))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(sketch_estimate(flip("sa"), flip("sb"), k) >= percent / 100 - slack)
    likely = staged(likely.select("a", "b"), "pairs")
    of = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    full = likely.join(of("b"), "b").join(of("a"), "a").select("a", "b", "ta", "tb")

    @lean
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        held = 0

        def full_set(node: pa.Scalar, text: pa.Scalar) -> np.ndarray:
            nonlocal held
            key = node.as_py()
            if key not in known:
                if held > cache_shingles:
                    known.clear()
                    held = 0
                known[key] = shingle_hashes(text.as_py(), width)
                held += len(known[key])
            return known[key]

        for batch in batches:
            ok = []
            for a, b, ta, tb in zip(*batch.columns):
                left, right = full_set(a, ta), full_set(b, tb)
                both = len(np.intersect1d(left, right, assume_unique=True))
                ok.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return full.mapInArrow(check, "a binary, b binary")


def own_shingles(long_nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """node, own: how many shingles of its full set no other node of `long_nodes` (node) has."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nid, text in zip(batch.column(0), batch.column(1)):
                s = shingle_hashes(text.as_py(), width).view(np.int64)
                for at in range(0, len(s), 1 << 20):
                    part = s[at:at + (1 << 20)]
                    yield pa.record_batch([pa.array(np.full(len(part), nid.as_py(), dtype=np.int64)), pa.array(part)], names=["nid", "s"])

    some = texts.join(long_nodes.select("node").distinct(), "node")
    rows = some.select(F.xxhash64("node").alias("nid"), "text").mapInArrow(run, "nid long, s long")
    single = rows.groupBy("s").agg(F.count("*").alias("f"), F.bit_xor("nid").alias("nid")).where("f = 1")
    own = single.groupBy("nid").agg(F.count("*").alias("own"))
    return staged(some.select("node", F.xxhash64("node").alias("nid")).join(own, "nid").select("node", "own"), "own")


def node_rows(base: DataFrame) -> DataFrame:
    """node, id0, h, n, sketch: one line per node, with the least of its rows."""
    rows = base.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("id0", "h")).alias("x"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    return rows.select("node", "x.*", "n", "sketch")  # size and sketch are the same in all rows of a node


def text_rows(members: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text: the texts of `members` (node, id0, h), so that whole tables of texts are read and dealt once and not at every turn."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id0"), F.xxhash64("text").alias("h"), "text")
    return rows.join(members.select("node", "id0", "h"), ["id0", "h"]).dropDuplicates(["id0", "h"]).select("node", "text")


def cross_pairs(marked: DataFrame, near, short: int) -> DataFrame:
    """a, b: all pairs of nodes across the components of each list.

    Two nodes share many lists if they share one: in lists of over `short`
    members a pair is made in the first of its long lists only, so that the
    rows made are the pairs themselves. Short lists may repeat a pair.
    """
    long_rows = F.col("members") > short
    per = marked.where(long_rows).groupBy("node").agg(F.sort_array(F.collect_set("v")).alias("vs"))  # at most k values
    rows = marked.join(per, "node", "left").withColumn("vs", F.when(long_rows, F.col("vs")))
    few = rows.where("label != most").select("v", F.col("node").alias("x"), F.col("n").alias("na"), F.col("own").alias("oa"), F.col("label").alias("lx"), F.col("vs").alias("vx"))
    every = rows.select("v", F.col("node").alias("y"), F.col("n").alias("nb"), F.col("own").alias("ob"), F.col("label").alias("ly"), F.col("vs").alias("vy"), (F.col("label") == F.col("most")).alias("head"))
    once = (F.col("head") | (F.col("x") < F.col("y"))) & (F.col("vx").isNull() | (F.get(F.array_intersect("vx", "vy"), F.lit(0)) == F.col("v")))
    return few.join(every, "v").where((F.col("lx") != F.col("ly")) & near & once).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """node, label: least node of each connected component, by least neighbour labels and pointer jumps."""
    both = staged(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(seen, "node").select("node", "label", F.least("label", "m").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        new = staged(step.join(jump, "low").select("node", "label", F.least("low", "up").alias("low")), "labels")
        if not new.where("low != label").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", F.col("low").alias("label"))


def find_groups(docs: DataFrame, k: int = 48, percent: int = 85, width: int = 5, slack: float = 0.35, heads: int = 8, short: int = 32) -> DataFrame:
    """doc_id, id0, h, n_shingles, component_id, kept per row of `docs` (doc_id, text).

    component_id is the least id of the rows that links lead to. Texts without
    words (null too) have an empty set and stand alone. Rows without id can be
    linked; alone they have a null component and are kept, next to a row with
    an id they are not. Repeated rows get equal results. Lists of more than
    `short` members also use the nodes' own shingles to rule pairs out.
    """
    base = staged(sketches(docs, k, width), "sketches")
    nodes = staged(node_rows(base), "nodes")
    lists = staged(inverted_lists(nodes, k, percent), "lists")
    # What two sets can share at most, as their own shingles are not shared.
    most_shared = F.least(F.col("na") - F.col("oa"), F.col("nb") - F.col("ob"))
    near = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (100 * most_shared >= percent * (F.col("na") + F.col("nb") - most_shared))
    total, label, edges, tested, own, members, texts, before, turn = nodes.count(), None, None, None, None, None, None, math.inf, 0
    while True:
        marked = lists.withColumn("label", F.col("node")) if label is None else lists.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        sizes = marked.groupBy("v", "label").agg(F.count("*").alias("c"))
        most = sizes.groupBy("v").agg(F.max(F.struct("c", "label"))["label"].alias("most"), F.count("*").alias("parts"), F.sum("c").alias("members"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("open"))
        marked = staged(marked.join(most.where("parts > 1"), "v"), "marked")
        if label is None:
            marked = marked.withColumn("own", F.lit(0).cast("long"))
        else:  # counted once: later rounds have no other nodes in their long lists
            own = own_shingles(marked.where(F.col("members") > short), texts, width) if own is None else own
            counted = F.when(F.col("members") > short, F.coalesce("own", F.lit(0))).otherwise(F.lit(0)).cast("long")
            marked = staged(marked.join(own, "node", "left").withColumn("own", counted), "marked")
        left = marked.groupBy("v").agg(F.max("open").alias("open")).agg(F.sum("open")).first()[0] or 0
        if not left:
            break
        if members is None:  # later turns have no other nodes
            members = staged(nodes.join(marked.select("node").distinct(), "node").select("node", "id0", "h", "sketch"), "members")
            texts = staged(text_rows(members, docs), "texts")
        # Pairs across components are few, or turns no longer lessen them: compare all of them.
        last = left <= 2 * total or left > 0.8 * before
        if last:
            pairs = cross_pairs(marked, near, short).distinct()
        else:  # lists differ in their heads, so that a node of a large group meets several others
            o = F.xxhash64("node", F.pmod("v", F.lit(heads)) + turn * heads) if turn else -F.col("typical")
            few = marked.groupBy("v").agg(F.min(F.struct(o.alias("o"), "node", "n", "own", "label")).alias("x"))
            few = few.select("v", F.col("x.node").alias("x"), F.col("x.n").alias("na"), F.col("x.own").alias("oa"), F.col("x.label").alias("lx"))
            every = marked.select("v", F.col("node").alias("y"), F.col("n").alias("nb"), F.col("own").alias("ob"), F.col("label").alias("ly"))
            pairs = few.join(every, "v").where((F.col("lx") != F.col("ly")) & near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = staged(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "stars")
        found = staged(verified(pairs, members, texts, k, percent, width, slack), "edges")
        tested = pairs if tested is None else tested.unionByName(pairs)
        edges = found if edges is None else edges.unionByName(found)
        label = components(edges)
        if last:
            break
        before, turn = left, turn + 1
    if label is None:
        label = nodes.select("node", F.col("node").alias("label")).limit(0)
    named = base.select("doc_id", "id0", "h", "node", "n_shingles").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = staged(named, "named")
    least = named.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "label", "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "id0", "h", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """`docs` with one document of each group; repeated rows (same id and text) become one."""
    groups = find_groups(docs, **params)
    gone = groups.where("NOT kept").select("id0", "h").distinct()
    on = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == gone["id0"]) & (F.xxhash64(docs["text"]) == gone["h"])
    return docs.join(gone, on, "left_anti").dropDuplicates(["doc_id", "text"])
