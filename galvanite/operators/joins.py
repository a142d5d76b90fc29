"""Joins, lookups, merges and set operations on keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.keyed import Ordered, attach, with_group
from galvanite.operators.select import edit_ratio


def attach_attributes(df: DataFrame, attrs: DataFrame, name: str, aliases: DataFrame | None = None) -> DataFrame:
    """Attributes by dataset name, then by alias, then by the reverse alias.

    Names are compared without case. `aliases` has columns `name`, `alias`.
    The three lookups are folded into one: every way to reach an attribute
    row becomes a (name, rank) entry and the best rank is kept before the join.
    """
    values = [c for c in attrs.columns if c != name]
    low = attrs.withColumn("_k", F.lower(F.col(name)))
    ways = low.select("_k", F.lit(0).alias("_rank"), F.struct(*values).alias("_a"))
    if aliases is not None:
        al = aliases.select(F.lower("name").alias("_n"), F.lower("alias").alias("_al"))
        ways = ways.unionByName(
            low.join(al, F.col("_k") == F.col("_al")).select(F.col("_n").alias("_k"), F.lit(1).alias("_rank"), F.struct(*values).alias("_a"))
        ).unionByName(
            low.join(al, F.col("_k") == F.col("_n")).select(F.col("_al").alias("_k"), F.lit(2).alias("_rank"), F.struct(*values).alias("_a"))
        )
    best = ways.groupBy("_k").agg(F.min_by("_a", "_rank").alias("_a"))
    out = attach(df.withColumn("_k", F.lower(F.col(name))), best, ["_k"])
    return out.select(*df.columns, "_a.*")


def combine_fit_attrs(fits: DataFrame, attrs: DataFrame, dataset: str, first: Sequence[str] = ()) -> DataFrame:
    """Full join of fits and attributes; priority columns lead.

    Columns of both sides are taken from the fit, else from the attributes.
    """
    shared = [c for c in attrs.columns if c in fits.columns and c != dataset]
    right = attrs.select(dataset, *[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in attrs.columns if c != dataset])
    both = fits.join(right, dataset, "full")
    for c in shared:
        both = both.withColumn(c, F.coalesce(c, f"_r_{c}")).drop(f"_r_{c}")
    lead = [c for c in first if c in both.columns]
    return both.select(dataset, *[c for c in lead if c != dataset], *[c for c in both.columns if c not in (dataset, *lead)])


def params_with_std(columns: Sequence[str]) -> list[str]:
    """Parameter columns that have a deviation partner."""
    return [c for c in columns if f"{c}_std" in columns]


def align_arrays(df: DataFrame, keys: Sequence[str], name: str, values: str, mode: str = "common", min_len: int = 1) -> DataFrame:
    """Arrays of the chosen length as long rows (keys, name, row_idx, value).

    `mode`: `common` keeps the most frequent length of the key, `max` the
    longest, `all` every array. Arrays shorter than `min_len` are left out.
    """
    rows = df.select(*keys, name, F.col(values).alias("_v"), F.size(values).alias("_len")).where(F.col("_len") >= min_len)
    if mode != "all":
        counts = rows.groupBy(*keys, "_len").agg(F.count(F.lit(1)).alias("_n"))
        pick = F.max("_len") if mode == "max" else F.max_by("_len", F.struct("_n", "_len"))
        chosen = counts.groupBy(*keys).agg(pick.alias("_want"))
        rows = attach(rows, chosen, list(keys)).where(F.col("_len") == F.col("_want"))
    return rows.select(*keys, name, F.posexplode("_v").alias("row_idx", "value"))


def align_columns(long: DataFrame, keys: Sequence[str], name: str, columns: Sequence[str]) -> DataFrame:
    """Long arrays side by side by row position."""
    return long.groupBy(*keys, "row_idx").agg(*[F.max(F.when(F.col(name) == c, F.col("value"))).alias(c) for c in columns])


def map_channels(
    samples: DataFrame, mapping: DataFrame, keys: Sequence[str], row: Sequence[str], standards: Sequence[str],
    raw: str = "channel", value: str = "value",
) -> DataFrame:
    """Copy raw channels into standard ones by a mapping; missing gives null.

    `mapping` has (keys, raw_channel, std_channel, multiplier).
    """
    m = mapping.select(*keys, F.col("raw_channel").alias(raw), "std_channel", F.coalesce("multiplier", F.lit(1.0)).alias("_mul"))
    hit = attach(samples, m, [*keys, raw])
    val = F.col(value) * F.col("_mul")
    return hit.groupBy(*keys, *row).agg(*[F.max(F.when(F.col("std_channel") == s, val)).alias(s) for s in standards])


def pchip_fill(df: DataFrame, keys: Sequence[str], x: str, value: str) -> DataFrame:
    """Fill nulls inside a series by monotone cubic interpolation over x."""
    from galvanite.plans.interpolation import interpolate_at

    known = df.where(F.col(value).isNotNull()).select(*keys, x, value)
    wanted = df.where(F.col(value).isNull()).select(*keys, x)
    filled = interpolate_at(known, wanted, keys, x, value, "pchip", extrapolate=False)
    out = attach(df, filled.withColumnRenamed(value, "_filled"), [*keys, x])
    return out.withColumn(value, F.coalesce(value, "_filled")).drop("_filled")


def condition_deltas(
    df: DataFrame, keys: Sequence[str], condition: str, order: Sequence[str], values: Sequence[str],
    temp: str | None = None, base: str = "pre", conditions: Sequence[str] = ("pre", "dh", "dry"),
) -> DataFrame:
    """(v1 - v2) / v_base for every pair of conditions of a key.

    Rows pair by position and the shorter side cycles, so each pair of
    conditions is an equi join on (key, position). A missing base value is
    interpolated over temperature. Pairs follow the listed condition order.
    """
    gk = [*keys, *([temp] if temp else [])]
    rows = Ordered(df, [*gk, condition], order).positions("_i", "_n")
    firsts = rows.where((F.col(condition) == base) & (F.col("_i") == 0)).select(*gk, *[F.col(v).cast("double").alias(f"_b_{v}") for v in values])
    if temp:
        grid = df.select(*gk).distinct()
        series = attach(grid, firsts, gk)
        for v in values:
            series = pchip_fill(series, keys, temp, f"_b_{v}")
        firsts = series
    parts = []
    for i, a in enumerate(conditions):
        for b in conditions[i + 1:]:
            left = rows.where(F.col(condition) == a)
            right = rows.where(F.col(condition) == b)
            sizes = attach(
                left.groupBy(*gk).agg(F.max("_n").alias("_na")), right.groupBy(*gk).agg(F.max("_n").alias("_nb")), gk, "inner"
            )

            def stretched(side: DataFrame, mine: str, other: str, tag: str) -> DataFrame:
                # Row i of the shorter side serves positions i, i + n, i + 2n, ...
                full = attach(side, sizes, gk, "inner")
                last = F.greatest(F.col(mine), F.col(other)) - 1
                at = F.explode(F.sequence(F.col("_i"), last, F.col(mine)))
                return full.select(*gk, at.alias("_at"), *[F.col(v).cast("double").alias(f"_{tag}_{v}") for v in values])

            both = attach(stretched(left, "_na", "_nb", "a"), stretched(right, "_nb", "_na", "z"), [*gk, "_at"], "inner")
            both = attach(both, firsts, gk)
            parts.append(both.select(
                *gk, F.lit(f"{a}-{b}").alias(condition), F.col("_at").alias("position"),
                *[F.try_divide(F.col(f"_a_{v}") - F.col(f"_z_{v}"), F.col(f"_b_{v}")).alias(v) for v in values],
            ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def complete_grid(df: DataFrame, keys: Sequence[str], axis: str, required: Sequence, min_present: int = 2) -> DataFrame:
    """Add a null row for each required axis value a group lacks.

    Only groups with at least `min_present` distinct axis values grow.
    """
    have = df.groupBy(*keys).agg(F.count_distinct(axis).alias("_n"))
    wanted = F.array(*[F.lit(r) for r in required]).cast(f"array<{dict(df.dtypes)[axis]}>")
    grid = have.where(F.col("_n") >= min_present).select(*keys, F.explode(wanted).alias(axis))
    missing = attach(grid, df.select(*keys, axis).distinct(), [*keys, axis], "left_anti")
    return df.unionByName(missing, allowMissingColumns=True)


def conditional_update(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str], where: Column | str) -> DataFrame:
    """Overwrite columns where the condition (on source values) holds."""
    cond = F.expr(where) if isinstance(where, str) else where
    src = source.where(cond).select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_s_{c}") for c in columns])
    out = attach(target, src, list(keys))
    return out.select(*[
        (F.when(F.coalesce("_hit", F.lit(False)), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c))
        for c in target.columns
    ])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace all old rows of the same keys; the rest stays."""
    gone = new.select(*keys).distinct()
    return attach(old, gone, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def nearest_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, targets: Sequence[float], ties: Sequence[str], rule: str = "lookup"
) -> DataFrame:
    """Per key and target the matching value and its tie columns.

    `lookup`: on a key whose values rise and reach the target, the first value
    >= target; otherwise, and always with rule `nearest`, the smallest
    distance. All targets are answered in one aggregation.
    """
    rows = df
    if rule == "lookup":
        seq = Ordered(df, keys, order)
        rows = seq.frame({"_prev": lambda w: F.lag(value).over(w)})
        rows = with_group(
            rows, keys, F.coalesce(F.bool_and(F.col("_prev") <= F.col(value)), F.lit(True)).alias("_mono"), F.max(value).alias("_max")
        )
    item = F.struct(F.col(value).alias("value"), *ties)
    aggs = []
    for k, t in enumerate(targets):
        near = F.min_by(item, F.struct(F.abs(F.col(value) - F.lit(float(t))), *order))
        if rule == "lookup":
            first = F.min_by(item, F.when(F.col(value) >= t, F.struct(*order)))
            near = F.when(F.bool_and("_mono") & (F.max("_max") >= t), first).otherwise(near)
        aggs.append(near.alias(f"_t{k}"))
    got = rows.groupBy(*keys).agg(*aggs)
    items = F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"_t{k}").alias("m")) for k, t in enumerate(targets)])
    return got.select(*keys, F.explode(items).alias("_x")).select(*keys, "_x.target", "_x.m.*")


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], tie: str, split: bool | None = None
) -> DataFrame:
    """Latest right row at or before each left row: a union and a running last."""
    ls = left.select(*keys, at, F.col(tie).alias("_tie"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    rs = right.select(*keys, at, F.lit(None).cast(dict(left.dtypes)[tie]).alias("_tie"), F.lit(0).alias("_side"), F.struct(*values).alias("_r"))
    both = ls.unionByName(rs, allowMissingColumns=True)
    got = Ordered(both, keys, [at, "_side", "_tie"], split=split).running({"_last": ("last", F.col("_r"))})
    return got.where(F.col("_side") == 1).select("_l.*", *[F.col(f"_last.{v}").alias(f"asof_{v}") for v in values])


def fuzzy_names(df: DataFrame, name: str, targets: Sequence[str], cutoff: float = 0.2, ratio=edit_ratio) -> DataFrame:
    """Best target above the cutoff for each distinct name.

    The targets are a literal list, so names need no shuffle beyond their
    own distinct.
    """
    names = df.select(name).where(F.col(name).isNotNull()).distinct()
    scored = F.transform(
        F.array(*[F.lit(t) for t in targets]), lambda t: F.struct((-ratio(F.col(name), t)).alias("r"), t.alias("target"))
    )
    best = names.withColumn("_b", F.array_min(scored))
    return best.where(-F.col("_b.r") >= cutoff).select(name, F.col("_b.target").alias("target"), (-F.col("_b.r")).alias("score"))


def split_by_verdict(df: DataFrame, verdict: DataFrame, keys: Sequence[str], accepted: str = "accepted") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows by the verdict of their key."""
    good = verdict.where(F.col(accepted)).select(*keys)
    return attach(df, good, list(keys), "left_semi"), attach(df, good, list(keys), "left_anti")


def curve_params(segments: DataFrame, params: DataFrame, keys: Sequence[str], fit: str, fallback: str, channels: Sequence[str]) -> DataFrame:
    """Parameters of each channel of a segment, with a fallback fit.

    `params` has (keys, fit, channel, equation, params). Both fits are
    reduced to one row per segment before the join.
    """
    use = params.where(F.col("fit").isin(fit, fallback) & F.col("channel").isin(*channels))
    aggs = []
    for c in channels:
        for col in ("equation", "params"):
            pick = lambda f, c=c, col=col: F.max_by(
                F.col(col), F.when((F.col("fit") == f) & (F.col("channel") == c), F.lit(1))
            )
            aggs.append(F.coalesce(pick(fit), pick(fallback)).alias(f"{c}_{col}"))
    return attach(segments, use.groupBy(*keys).agg(*aggs), list(keys))


def dedupe_versions(
    df: DataFrame, fingerprint: Sequence[Column], prefer: Sequence[Column], group: str = "fingerprint"
) -> DataFrame:
    """Mark the active row among equal measurements and number the group.

    Copies are compared by a 128-bit fingerprint; the choice is a max over
    structs, combined before the shuffle, however many copies there are.
    """
    # Nulls keep a place of their own, so (null, a) and (a, null) differ.
    digest = F.md5(F.to_json(F.array(*[c.cast("string") for c in fingerprint])))
    rows = df.withColumn(group, digest).withColumn("_pref", F.struct(*prefer))
    rows = with_group(rows, [group], F.max("_pref").alias("_best"), F.count(F.lit(1)).alias("versions"))
    return rows.withColumn("is_active", F.col("_pref") == F.col("_best")).drop("_pref", "_best")


def merge_unique_groups(df: DataFrame, levels: Sequence[str], keep: Sequence[str] = (), sep: str = "/") -> DataFrame:
    """Shortest key path: a level is left out of the path where its parent
    group has only one value of it."""
    path = []
    rows = df
    for i, lv in enumerate(levels):
        parent = list(levels[:i])
        rows = with_group(rows, parent, (F.coalesce(F.min(lv) != F.max(lv), F.lit(False)) | F.lit(lv in keep)).alias(f"_v{i}"))
        path.append(F.when(F.col(f"_v{i}"), F.col(lv).cast("string")))
    return rows.withColumn("path", F.concat_ws(sep, *path)).select(*df.columns, "path")


def flip_levels(path: Column, a: int, b: int, sep: str = "/") -> Column:
    """Path with two levels swapped (0-based)."""
    parts = F.split(path, sep)
    return F.array_join(
        F.transform(parts, lambda p, i: F.when(i == a, F.get(parts, b)).when(i == b, F.get(parts, a)).otherwise(p)), sep
    )


def truncate_path(path: Column, depth: int, sep: str = "/") -> Column:
    return F.substring_index(path, sep, depth)


def fill_from_reference(df: DataFrame, ref: DataFrame, keys: Sequence[str], overwrite_locked: bool = False,
                        factors: tuple[float, float] = (0.1, 10.0)) -> DataFrame:
    """Missing value, std, locks and bounds from the same reference parameter."""
    cols = [c for c in ("value", "std", "lock", "bnd_low", "bnd_high", "bnd_low_lock", "bnd_high_lock") if c in ref.columns]
    r = ref.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in cols])
    out = attach(df, r, list(keys))
    for c in cols:
        mine = F.col(c) if c in df.columns else F.lit(None)
        val = F.coalesce(mine, F.col(f"_r_{c}"))
        if overwrite_locked and "lock" in cols and c != "lock":
            val = F.when(F.coalesce("_r_lock", F.lit(False)), F.coalesce(F.col(f"_r_{c}"), mine)).otherwise(val)
        out = out.withColumn(f"_n_{c}", val)
    for c in cols:
        out = out.withColumn(c, F.col(f"_n_{c}"))
    out = out.drop(*[f"_n_{c}" for c in cols], *[f"_r_{c}" for c in cols])
    for c, f in (("bnd_low", factors[0]), ("bnd_high", factors[1])):
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(c, F.col("value") * f))
    return out


def metadata_precedence(*sources: Column | None, default: float | None = None) -> Column:
    """First given value: in the data, else stored, else keyword, else default."""
    cols = [c for c in sources if c is not None]
    return F.coalesce(*cols, F.lit(default)) if default is not None else F.coalesce(*cols)


def merged_attributes(left: Column, right: Column) -> Column:
    """Attribute maps merged, the right one wins."""
    kept = F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)


# --- set operations -----------------------------------------------------------

def union_datasets(parts: dict[str, DataFrame], name: str = "dataset", sort: Sequence[str] = ()) -> DataFrame:
    """Stack datasets with a name column."""
    out = None
    for n, df in parts.items():
        named = df.withColumn(name, F.lit(n))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out.orderBy(*sort) if sort else out


def union_keep_first(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the first, then rows of the second with new keys only."""
    return first.unionByName(attach(second, first.select(*keys).distinct(), list(keys), "left_anti"))


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def missing_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).distinct().exceptAll(b.select(*keys).distinct())
