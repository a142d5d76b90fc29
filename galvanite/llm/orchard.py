"""Centroid clustering on integer vectors with Orchard's nearest-neighbour search.

Every centroid has the list of the other centroids, nearest first. A search
walks the list of its current centroid and jumps to another list as soon as it
finds a closer centroid. No centroid farther from the current one than twice
the current distance can be as close, so the walk ends strictly beyond that.
All vectors of a batch walk at the same time.

Distances are compared as exact integers. Tasks add up their vectors, so a
round shuffles one line per centroid and task; the driver holds the centroids
(k x dims numbers) and nothing that grows with the rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galvanite.llm.shared import staged

LONG = (1 << 63) - 1


def safe(dims: int) -> int:
    """Components up to here keep four times a squared distance within 62 bits."""
    return math.isqrt((1 << 62) // (16 * dims))


def kept(vectors: DataFrame, dims: int = 64) -> DataFrame:
    """vec_id and embedding (doubles) of rows with `dims` components, none of them null, NaN or infinite; more columns are dropped."""
    e = F.col("embedding").cast("array<double>")
    finite = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).where(finite).select("vec_id", e.alias("embedding"))


def whole(values: list[float], scale: int) -> list[int]:
    """floor(scale * x) without rounding, for any finite x and a scale that is a power of two."""
    return [math.floor(scale * x) if abs(x) < 2.0**52 else int(x) * scale for x in values]


def integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """Rows of floor(scale * x): int64 where all are safe, else Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * scale)
    if not scaled.size or np.abs(scaled).max() <= safe(flat.shape[1]):
        return scaled.astype(np.int64)
    return np.array([whole(row, scale) for row in flat.tolist()], dtype=object)


def fitting(rows: list[list[int]], dims: int) -> np.ndarray:
    big = any(abs(x) > safe(dims) for row in rows for x in row)
    return np.array(rows, dtype=object if big else np.int64).reshape(len(rows), dims)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows."""
    gap = a - b
    return (gap * gap).sum(axis=1) if gap.dtype == object else np.einsum("ij,ij->i", gap, gap)


class Neighbours:
    """Centroids with their sorted lists of neighbours."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        k = len(centroids)
        apart = [squared(centroids, np.repeat(centroids[i:i + 1], k, axis=0)) for i in range(k)]
        self.near = np.array([[j for j in sorted(range(k), key=lambda j: (row[j], j)) if j != i] for i, row in enumerate(apart)], dtype=np.int64).reshape(k, max(k - 1, 0))
        self.apart = np.stack([apart[i][self.near[i]] for i in range(k)]) if k else np.zeros((0, 0))

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and squared distance of each row (ties: the smaller number), and the number of distances computed."""
        n, k = len(x), len(self.c)
        if x.dtype != self.c.dtype:
            x = x.astype(object)
        at = np.zeros(n, dtype=np.int64)
        best = squared(x, self.c[at])
        seen = np.zeros((n, k), dtype=bool)
        seen[:, 0] = True
        place = np.zeros(n, dtype=np.int64)
        live, made = np.arange(n), n
        while len(live) and k > 1:
            live = live[place[live] < k - 1]
            live = live[(self.apart[at[live], place[live]] <= 4 * best[live]).astype(bool)]
            if not len(live):
                break
            other = self.near[at[live], place[live]]
            place[live] += 1
            fresh = ~seen[live, other]
            rows, other = live[fresh], other[fresh]
            seen[rows, other] = True
            far = squared(x[rows], self.c[other])
            made += len(rows)
            closer = ((far < best[rows]) | ((far == best[rows]) & (other < at[rows]))).astype(bool)
            rows = rows[closer]
            at[rows], best[rows], place[rows] = other[closer], far[closer], 0
        return at, best, made


def batches_of(batch: pa.RecordBatch, dims: int, scale: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end, integer rows) in parts that keep the copies of a batch small; outsize vectors come one by one."""
    flat = batch.column(batch.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    for at in range(0, len(flat), 2048):
        part = integers(flat[at:at + 2048], scale)
        yield at, at + len(part), part


def starts(vectors: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    """The `k` vectors with the smallest sha256 of seed and id, in that order; null ids come last, ties by the components."""
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "embedding").limit(k).collect()  # k rows
    return [whole(r["embedding"], scale) for r in rows]


def moved(vectors: DataFrame, centroids: np.ndarray, scale: int) -> list[list[int]]:
    """Centroids after one round: the floor of the exact mean of each one's vectors, empty ones unchanged."""
    k, dims = centroids.shape
    lists = Neighbours(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = [0] * k, [[0] * dims for _ in range(k)]
        for batch in batches:
            for _, _, x in batches_of(batch, dims, scale):
                at = lists.search(x)[0]
                for c in np.unique(at).tolist():
                    own = x[at == c]
                    n[c] += len(own)
                    sums[c] = [a + int(b) for a, b in zip(sums[c], own.sum(axis=0))]
        used = [c for c in range(k) if n[c]]
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([n[c] for c in used], pa.int64()), pa.array([[str(v) for v in sums[c]] for c in used], pa.list_(pa.string()))], names=["c", "n", "sums"])

    def total(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rows = [[int(v) for v in s] for s in part["sums"]]
        return pd.DataFrame({"c": [int(part["c"].iloc[0])], "n": [int(part["n"].sum())], "sums": [[str(sum(col)) for col in zip(*rows)]]})

    shape = "c int, n long, sums array<string>"
    sums = vectors.select("embedding").mapInArrow(add, shape)  # one line per centroid and task
    # First within 64 parts of the tasks, then over these: no task meets the sums of all tasks.
    sums = sums.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("c", "part").applyInPandas(total, shape)
    out = [list(map(int, row)) for row in centroids.tolist()]
    for r in sums.groupBy("c").applyInPandas(total, shape).collect():  # at most k rows
        out[r["c"]] = [int(v) // r["n"] for v in r["sums"]]
    return out


def assign(vectors: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """vec_id, cluster and squared distance of every vector; distances beyond a long are held at its largest value."""
    dims = centroids.shape[1]
    lists = Neighbours(centroids)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in batches_of(batch, dims, scale):
                at, best, _ = lists.search(x)
                best = np.minimum(best, LONG).astype(np.int64)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(at, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(find, f"vec_id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 40, dims: int = 64, rounds: int = 5, seed: str = "2:", scale: int = 256) -> tuple[DataFrame, list[list[int]]]:
    """Assignment (vec_id, cluster, distance) of the kept vectors and the final centroids.

    Vectors of another length, null ones and those with null or non-finite
    components are left out. Repeated rows count as often as they come, null
    ids stay null. With fewer than `k` kept vectors each starts a centroid; an
    empty table gives no centroid and no rows.
    """
    use = kept(vectors, dims)
    centroids = fitting(starts(use, k, seed, scale), dims)
    if not len(centroids):
        return use.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = fitting(moved(use, centroids, scale), dims)
    return assign(use, centroids, scale), [list(map(int, row)) for row in centroids.tolist()]


def cluster_report(vectors: DataFrame, k: int = 40, dims: int = 64, rounds: int = 5, seed: str = "2:", scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector; see `cluster`.

    Inertias beyond a long are held at its largest value.
    """
    rows, centroids = cluster(vectors, k, dims, rounds, seed, scale)
    rows = staged(rows, "clusters")
    spark = rows.sparkSession
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    named = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    held = lambda c: F.least(c, F.lit(LONG).cast("decimal(38,0)")).cast("long")
    # At most k rows on either side; the one window runs over those.
    each = sums.join(named, "cluster").select("cluster", held(F.col("s")).alias("cluster_inertia"), held(F.sum("s").over(Window.partitionBy(F.lit(0)))).alias("inertia"), "centroid_sha256")
    return rows.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
