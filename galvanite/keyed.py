"""Building blocks for keyed tables whose groups may be of any size.

A plain window or `percentile` puts all rows of one key into one task. The
helpers here look first whether any key is larger than the group limit. If
none is, they return the plain plan. Otherwise they return a plan whose tasks
hold blocks of a key, with the small per-block results carried over by a
broadcast table of at most (rows / limit) lines.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from galvanite.session import cut_lineage, group_limit

#: Rows of one block of a key that is split; a task sorts a block and keeps it for its windows.
BLOCK_ROWS = 1_000_000

_hot_seen: dict[tuple, bool] = {}
_small: list[frozenset] = []


@contextmanager
def checked_once(df: DataFrame, keys: Sequence[str], growth: int = 1) -> Iterator[None]:
    """Look at the group sizes once for a chain of steps on the same keys.

    If no key of `df` exceeds the limit divided by `growth` (the largest
    factor by which a step inside multiplies the rows of a key), the steps
    inside need no check of their own for these keys or finer ones.
    """
    limit = max(1, group_limit(df.sparkSession) // growth)
    small = not has_hot_group(df, keys, limit)
    if small:
        _small.append(frozenset(keys))
    try:
        yield
    finally:
        if small:
            _small.pop()


def has_hot_group(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """True when some key holds more than `limit` rows (one small job).

    The answer only chooses between two exact plans, so it may be remembered.
    """
    if limit is None or limit >= group_limit(df.sparkSession):
        if any(known <= set(keys) for known in _small):
            return False
    limit = limit or group_limit(df.sparkSession)
    sized = df.select(*keys)
    token = (sized.sparkSession.sparkContext.applicationId, sized.semanticHash(), tuple(keys), limit)
    if token not in _hot_seen:
        if len(_hot_seen) > 512:
            _hot_seen.clear()
        sizes = sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        top = sizes.agg(F.max("_n")).first()[0]
        _hot_seen[token] = (top or 0) > limit
    return _hot_seen[token]


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join that matches null keys too and keeps the left key columns.

    Without keys the right side must be a one-row aggregate; it is read as a
    scalar subquery.
    """
    if not keys:
        one = right.select(F.struct(*right.columns).alias("_one"))
        out = left.withColumn("_one", one.scalar())
        return out.select(*left.columns, *[F.col(f"_one.{c}").alias(c) for c in right.columns])
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"_r_{k}" for k in keys])


def with_group(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Add group aggregates to every row.

    Aggregate and join instead of a window: the sums are combined before the
    shuffle and adaptive execution splits a skewed join side.
    """
    if not keys:
        return with_total(df, *aggs)
    return attach(df, df.groupBy(*keys).agg(*aggs), keys)


def with_few(df: DataFrame, keys: Sequence[str], *aggs: Column, most: int = 100_000) -> DataFrame:
    """`with_group` for keys that may be few and large.

    Up to `most` keys their values are broadcast and the rows stay where they
    are; a join by key would bring all rows of a key into one task.
    """
    if not keys:
        return with_total(df, *aggs)
    groups = cut_lineage(df.groupBy(*keys).agg(*aggs))
    return attach(df, F.broadcast(groups) if groups.count() <= most else groups, keys)


def with_total(df: DataFrame, *aggs: Column) -> DataFrame:
    """Add aggregates over the whole table (one row) to every row."""
    one = df.agg(F.struct(*aggs).alias("_total"))
    out = df.withColumn("_total", one.scalar())
    names = one.schema["_total"].dataType.names
    return out.select(*df.columns, *[F.col(f"_total.{c}").alias(c) for c in names])


class Ordered:
    """Rows of each key in a total order.

    `order` must end with a column that makes the order unique within a key.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        limit: int | None = None,
        split: bool | None = None,
    ):
        self.df = df
        self.keys = list(keys)
        self.order = list(order)
        self.limit = limit or group_limit(df.sparkSession)
        self.block = min(self.limit, BLOCK_ROWS)
        self.split = has_hot_group(df, keys, self.limit) if split is None else split

    def _plain(self, reverse: bool = False) -> WindowSpec:
        cols = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.keys).orderBy(*cols)

    def positions(self, name: str = "i", count: str | None = None) -> DataFrame:
        """Add the 0-based position and, if named, the number of rows of the key."""
        if not self.split:
            out = self.df.withColumn(name, F.row_number().over(self._plain()).cast("long") - 1)
            if count:
                out = out.withColumn(count, F.count(F.lit(1)).over(Window.partitionBy(*self.keys)))
            return out
        rows = self.df.count()
        parts = max(2, math.ceil(rows / self.block) * 2)
        ranged = cut_lineage(
            self.df.repartitionByRange(parts, *self.keys, *self.order).withColumn(
                "_kx_c", F.spark_partition_id()
            )
        )
        sizes = ranged.groupBy(*self.keys, "_kx_c").agg(F.count(F.lit(1)).alias("_kx_m"))
        before = Window.partitionBy(*self.keys).orderBy("_kx_c")
        starts = sizes.withColumn(
            "_kx_before", F.sum("_kx_m").over(before.rowsBetween(Window.unboundedPreceding, -1))
        ).where(F.col("_kx_before") > 0)
        # A key has a start above 0 only in parts after its first one, so this
        # table has fewer rows than there are parts.
        local = Window.partitionBy(*self.keys, "_kx_c").orderBy(*self.order)
        out = ranged.withColumn("_kx_at", F.row_number().over(local).cast("long") - 1)
        out = attach(out, F.broadcast(starts.drop("_kx_m")), [*self.keys, "_kx_c"])
        out = out.withColumn(name, F.col("_kx_at") + F.coalesce("_kx_before", F.lit(0)))
        if count:
            totals = sizes.groupBy(*self.keys).agg(F.sum("_kx_m").alias(count))
            out = attach(out, totals, self.keys)
        return out.drop("_kx_c", "_kx_at", "_kx_before")

    def _blocks(self) -> DataFrame:
        return self.positions("_kx_i").withColumn("_kx_b", F.floor(F.col("_kx_i") / F.lit(self.block)))

    def spread_blocks(self, halo: int) -> DataFrame:
        """Rows with a block `_kx_t` and a flag `_kx_home`; a block also holds copies
        of up to `halo` rows of its neighbours. For kernels that need little
        context beyond their block."""
        if not self.split:
            return self.positions("_kx_i").select("*", F.lit(0).cast("long").alias("_kx_t"), F.lit(True).alias("_kx_home"))
        at = F.col("_kx_i") % F.lit(self.block)
        copies = F.array_compact(
            F.array(
                F.col("_kx_b"),
                F.when((at < halo) & (F.col("_kx_b") > 0), F.col("_kx_b") - 1),
                F.when(at >= self.block - halo, F.col("_kx_b") + 1),
            )
        )
        spread = self._blocks().withColumn("_kx_t", F.explode(copies))
        return spread.withColumn("_kx_home", F.col("_kx_t") == F.col("_kx_b")).drop("_kx_b")

    def frame(self, cols: dict[str, Callable[[WindowSpec], Column]], halo: int = 1) -> DataFrame:
        """Window columns that look at most `halo` rows back or ahead."""
        if not self.split:
            w = self._plain()
            return self.df.select("*", *[f(w).alias(n) for n, f in cols.items()])
        spread = self.spread_blocks(halo)
        w = Window.partitionBy(*self.keys, "_kx_t").orderBy("_kx_i")
        out = spread.select("*", *[f(w).alias(n) for n, f in cols.items()])
        return out.where("_kx_home").select(*self.df.columns, *cols)

    def running(
        self,
        cols: dict[str, tuple[str, Column]],
        reverse: bool = False,
        exclusive: bool = False,
    ) -> DataFrame:
        """Running aggregates from the first row (or the last, `reverse`).

        Each entry is name -> (how, value); `how` is sum, min, max, or last
        (latest non-null value). `exclusive` leaves the current row out.
        """
        end = -1 if exclusive else 0
        if not self.split:
            w = self._plain(reverse).rowsBetween(Window.unboundedPreceding, end)
            return self.df.select("*", *[_running(h, v).over(w).alias(n) for n, (h, v) in cols.items()])
        blocks = self._blocks().select("*", *[v.alias(f"_kx_v_{n}") for n, (_, v) in cols.items()])
        at = F.col("_kx_i") if not reverse else -F.col("_kx_i")
        totals = blocks.groupBy(*self.keys, "_kx_b").agg(
            *[
                (
                    F.max_by(F.col(f"_kx_v_{n}"), F.when(F.col(f"_kx_v_{n}").isNotNull(), at))
                    if h == "last"
                    else _running(h, F.col(f"_kx_v_{n}"))
                ).alias(f"_kx_s_{n}")
                for n, (h, _) in cols.items()
            ]
        )
        ordered = F.col("_kx_b").desc() if reverse else F.col("_kx_b").asc()
        prior = Window.partitionBy(*self.keys).orderBy(ordered)
        prior_rows = prior.rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            *self.keys,
            "_kx_b",
            F.row_number().over(prior).alias("_kx_first"),
            *[_running(h, F.col(f"_kx_s_{n}")).over(prior_rows).alias(f"_kx_c_{n}") for n, (h, _) in cols.items()],
        ).where(F.col("_kx_first") > 1)
        w = (
            Window.partitionBy(*self.keys, "_kx_b")
            .orderBy(F.col("_kx_i").desc() if reverse else F.col("_kx_i").asc())
            .rowsBetween(Window.unboundedPreceding, end)
        )
        out = blocks.select(
            "*", *[_running(h, F.col(f"_kx_v_{n}")).over(w).alias(f"_kx_l_{n}") for n, (h, _) in cols.items()]
        )
        # Only keys with several blocks have a carry: rows / limit lines.
        out = attach(out, F.broadcast(carry.drop("_kx_first")), [*self.keys, "_kx_b"])
        return out.select(
            *self.df.columns,
            *[_combine(h, F.col(f"_kx_c_{n}"), F.col(f"_kx_l_{n}")).alias(n) for n, (h, _) in cols.items()],
        )


def _running(how: str, value: Column) -> Column:
    if how == "sum":
        return F.sum(value)
    if how == "min":
        return F.min(value)
    if how == "max":
        return F.max(value)
    if how == "last":
        return F.last(value, ignorenulls=True)
    raise ValueError(how)


def _combine(how: str, before: Column, local: Column) -> Column:
    if how == "sum":
        return F.when(before.isNull(), local).when(local.isNull(), before).otherwise(before + local)
    if how == "min":
        return F.least(before, local)
    if how == "max":
        return F.greatest(before, local)
    return F.coalesce(local, before)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], limit: int | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, one column per wanted name."""
    keys = list(keys)
    limit = limit or group_limit(df.sparkSession)
    if not has_hot_group(df, keys, limit):
        return df.groupBy(*keys).agg(
            *[F.percentile(F.col(value).cast("double"), q).alias(n) for n, q in wanted.items()]
        )
    return counted_quantiles(counted_values(df, keys, value), keys, value, wanted, limit)


def counted_values(df: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """Rows per key and value (null too) as `_kx_w`, counted before the shuffle; written, so that the rows are read once."""
    return cut_lineage(df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("_kx_w")))


def counted_quantiles(
    counted: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], limit: int | None = None
) -> DataFrame:
    """Quantiles of `value`, where each line of `counted` stands for `_kx_w` rows; keys without values get nulls.

    The counts are summed in value order; a quantile is read at its two
    neighbouring positions.
    """
    keys = list(keys)
    summed = counted.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum("_kx_w").alias("_kx_w"))
    cum = Ordered(summed, keys, [value], limit).running({"_kx_cum": ("sum", F.col("_kx_w"))})
    cum = attach(cum, summed.groupBy(*keys).agg(F.sum("_kx_w").alias("_kx_n")), keys)
    picks = []
    for n, q in wanted.items():
        pos = (F.col("_kx_n") - 1) * F.lit(float(q))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("_kx_cum") > at) & (F.col("_kx_cum") - F.col("_kx_w") <= at)
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_kx_{side}_{n}"))
        picks.append(F.max(pos - F.floor(pos)).alias(f"_kx_f_{n}"))
    got = cum.groupBy(*keys).agg(*picks)
    out = got.select(
        *keys,
        *[
            (F.col(f"_kx_lo_{n}") + F.col(f"_kx_f_{n}") * (F.col(f"_kx_hi_{n}") - F.col(f"_kx_lo_{n}"))).alias(n)
            for n in wanted
        ],
    )
    return attach(counted.select(*keys).distinct(), out, keys) if keys else out


def weighted_median(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str, limit: int | None = None
) -> DataFrame:
    """First value whose cumulative weight reaches half of the total, per key."""
    keys = list(keys)
    summed = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_kx_w"))
    cum = Ordered(summed, keys, [value], limit).running({"_kx_cum": ("sum", F.col("_kx_w"))})
    cum = with_group(cum, keys, F.sum("_kx_w").alias("_kx_total"), F.max(value).alias("_kx_top"))
    # Rounding may leave the last sum just below half of nothing: use the top.
    hit = F.min(F.when(F.col("_kx_cum") >= F.col("_kx_total") / 2, F.col(value)))
    return cum.groupBy(*keys).agg(F.coalesce(hit, F.max("_kx_top")).alias(name))


def fold_sorted(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[tuple], object], schema: str, dealt: bool = False
) -> DataFrame:
    """Walk the rows of each key in order and give what the walker returns.

    For rules that carry a state from row to row and cannot be combined. The
    rows stream through sorted tasks, so a key of any size takes constant
    memory, apart from what the walker keeps. `start` makes a walker from the
    key values; its `add(row)` and `end()` return lists of output tuples, and
    a row is a tuple in the order of the columns. `dealt` rows of a key are in
    one partition already.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    keys = list(keys)
    at = [df.columns.index(k) for k in keys]
    fields = StructType.fromDDL(schema).fields
    names = [f.name for f in fields]
    types = [to_arrow_type(f.dataType) for f in fields]

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, walker, out = None, None, []

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                key = tuple("nan" if isinstance(row[i], float) and row[i] != row[i] else row[i] for i in at)
                if walker is None or key != now:
                    if walker is not None:
                        out += walker.end()
                    now, walker = key, start(tuple(row[i] for i in at))
                out += walker.add(row)
                if len(out) >= 10_000:
                    yield packed()
                    out = []
        if walker is not None:
            out += walker.end()
        if out:
            yield packed()

    whole = df if dealt else df.repartition(*keys)
    return whole.sortWithinPartitions(*keys, *order).mapInArrow(walk, schema)


def map_keys(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], work: Callable, adds: str
) -> DataFrame:
    """Rows of `df` with new columns that a numpy function works out from the ordered rows of each key.

    `work` gets one float array per column of `values` and returns the rows it
    keeps (positions, or None for all) and one array per new column of `adds`.
    Keys stay whole and come one after the other in sorted tasks: with many
    short keys a data frame for each would take most of the time.
    """
    from pyspark.sql.types import StructType

    keys = list(keys)
    types = dict(df.dtypes)
    new = [f.name for f in StructType.fromDDL(adds).fields]
    schema = "".join(f"`{c}` {types[c]}, " for c in df.columns) + adds
    names = df.columns

    def packed(parts: list) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = pa.Table.from_batches(parts).combine_chunks()
        first = np.flatnonzero(table["_kx_at"].to_numpy() == 1)
        columns = [table[c].to_numpy().astype(float) for c in values]
        kept, made = [], []
        for a, b in zip(first, [*first[1:], len(table)]):
            at, got = work(*[c[a:b] for c in columns])
            kept.append(np.arange(a, b) if at is None else a + at)
            made.append(got)
        out = table.select(names).take(pa.array(np.concatenate(kept).astype(np.int64)))
        for i, name in enumerate(new):
            out = out.append_column(name, pa.array(np.concatenate([m[i] for m in made]).astype(float), from_pandas=False))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    def walk(batches: Iterator) -> Iterator:
        import numpy as np

        held = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(len(names)).to_numpy(zero_copy_only=False) == 1)
            if len(starts):
                cut = int(starts[-1])
                held.append(batch.slice(0, cut))
                if sum(len(h) for h in held):
                    yield from packed(held)
                held = []
                batch = batch.slice(cut)
            held.append(batch)
        if held:
            yield from packed(held)

    whole = df.repartition(*keys) if keys else df.repartition(1)
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return whole.withColumn("_kx_at", at).sortWithinPartitions(*keys, "_kx_at").mapInArrow(walk, schema)
