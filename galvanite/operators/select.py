"""Projections, filters and predicates on datasets and their columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.keyed import attach, quantiles

# Fixed value: loosening steps of the fuzzy column search.
CUTOFFS = (0.6, 0.5, 0.4, 0.3, 0.2)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - levenshtein / longer length, ignoring case."""
    low_a, low_b = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(low_a), F.length(low_b), F.lit(1))
    return 1 - F.levenshtein(low_a, low_b) / longest


def block_ratio() -> Callable[[Column, Column], Column]:
    """Matching-block ratio of two texts (2 M / T) as a vectorised function."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([
            None if x is None or y is None else SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b)
        ])

    return ratio


def _scored(target: str, steps: Sequence[float]):
    def score(c: Column) -> Column:
        ratio = edit_ratio(c, F.lit(target))
        tier = F.when(c == target, 0).when(F.lower(c) == target.lower(), 1)
        for k, cut in enumerate(steps):
            tier = tier.when(ratio >= cut, 2 + k)
        return F.struct(tier.alias("tier"), (-ratio).alias("r"), c.alias("c"))

    return score


def select_fuzzy(
    columns: DataFrame, targets: Sequence[str], dataset: str = "dataset_id", column: str = "column", cutoff: float = 0.6
) -> DataFrame:
    """Map wanted names to the columns of every dataset.

    Exact matches win, then matches without case, then the best edit ratio at
    cutoffs loosened in steps of 0.1 down to 0.2. Longer targets choose first
    and no column is used twice. One row per dataset holds its distinct column
    names (a header), so the choice is a fold over the literal targets.
    """
    heads = columns.groupBy(dataset).agg(F.collect_set(column).alias("_cols"))
    rows = heads.withColumn("_used", F.array().cast("array<string>"))
    steps = [c for c in CUTOFFS if c <= cutoff + 1e-9]
    for t in sorted(targets, key=lambda x: (-len(x), x)):
        free = F.array_except("_cols", "_used")

        ranked = F.filter(F.transform(free, _scored(t, steps)), lambda s: s["tier"].isNotNull())
        rows = rows.withColumn(f"_m_{t}", F.array_min(ranked))
        rows = rows.withColumn(
            "_used", F.when(F.col(f"_m_{t}").isNotNull(), F.array_append("_used", F.col(f"_m_{t}.c"))).otherwise(F.col("_used"))
        )
    found = F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(f"_m_{t}.c").alias("column"), F.col(f"_m_{t}.tier").alias("tier"))
        for t in targets
    ])
    return rows.select(dataset, F.explode(found).alias("m")).select(dataset, "m.*").where(F.col("column").isNotNull())


def rename_merge(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by a map; sources that share a name are merged by first non-null."""
    out: dict[str, list[str]] = {}
    for c in df.columns:
        out.setdefault(mapping.get(c, c), []).append(c)
    return df.select(*[(F.coalesce(*cs) if len(cs) > 1 else F.col(cs[0])).alias(n) for n, cs in out.items()])


def merge_common(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Merge `X_0` into `X` only where both are never non-null together."""
    both = df.agg(*[
        F.coalesce(F.max((F.col(a).isNotNull() & F.col(b).isNotNull()).cast("int")), F.lit(0)).alias(f"{a}|{b}")
        for a, b in pairs.items()
    ]).first()
    for a, b in pairs.items():
        if both[f"{a}|{b}"] == 0:
            df = df.withColumn(a, F.coalesce(a, b)).drop(b)
    return df


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep one of the columns that hold identical values.

    One pass hashes every column by value; only columns with an equal digest
    are compared row by row in a second pass.
    """
    types = dict(df.dtypes)
    digest = df.agg(*[F.bit_xor(F.xxhash64(F.to_json(F.struct(*df.columns)), F.col(c))).alias(c) for c in df.columns]).first()
    pairs = [
        (a, b)
        for i, a in enumerate(df.columns)
        for b in df.columns[i + 1:]
        if digest[a] == digest[b] and types[a] == types[b]
    ]
    if not pairs:
        return df
    same = df.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"{a}|{b}") for a, b in pairs]).first()
    gone = {b for a, b in pairs if same[f"{a}|{b}"] is not False}
    return df.select(*[c for c in df.columns if c not in gone])


def minimise_keys(df: DataFrame, keys: Sequence[str], mode: str = "common") -> list[str]:
    """Key columns that are needed.

    `common` drops levels with a single value (one is kept); `minimize` also
    drops, from the right, every level without which rows stay unique.
    """
    counts = key_counts(df, keys).first()
    varied = [k for k in keys if counts[k] > 1] or list(keys[:1])
    if mode == "common":
        return varied
    total = df.select(*keys).distinct().count()
    for k in keys:
        if counts[k] == total:
            return [k]
    kept = list(varied)
    for k in reversed(varied):
        trial = [x for x in kept if x != k]
        if trial and df.select(*trial).distinct().count() == total:
            kept = trial
    return kept


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct values of each key level and of the whole key."""
    return df.agg(
        *[F.count_distinct(k).alias(k) for k in keys], F.count_distinct(F.struct(*keys)).alias("key"),
    )


def flatten_columns(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct fields as plain columns with joined names."""
    from pyspark.sql.types import StructType

    def leaves(schema, path):
        for f in schema.fields:
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, [*path, f.name])
            else:
                yield [*path, f.name]

    return df.select(*[
        F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema, [])
    ])


def flatten_keys(keys: Sequence[str], sep: str = "_") -> Column:
    return F.concat_ws(sep, *[F.col(k).cast("string") for k in keys])


def manage(df: DataFrame, columns: Sequence[str] | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """Select, rename, then drop rows that are null in every varying column."""
    if columns:
        df = df.select(*columns)
    if mapping:
        df = rename_merge(df, mapping)
    spread = df.agg(*[
        (F.coalesce(F.min(c) != F.max(c), F.lit(False))).alias(c) for c in df.columns
    ]).first()
    varied = [c for c in df.columns if spread[c]]
    return df.dropna(how="all", subset=varied) if varied else df


def band_filter(df: DataFrame, freq: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(freq).between(low, high))


def _holds(text: str):
    return lambda part: F.contains(part, F.lit(text.lower()))


def select_keys(keys: Sequence[str], selectors: Sequence[str], mode: str = "any") -> Column:
    """True where any (or each) selector occurs in some key part."""
    parts = F.array(*[F.lower(F.col(k).cast("string")) for k in keys])
    tests = [F.exists(parts, _holds(s)) for s in selectors]
    return reduce((lambda a, b: a | b) if mode == "any" else (lambda a, b: a & b), tests)


def select_any_of(keys: Sequence[str], selector_sets: Sequence[Sequence[str]]) -> Column:
    """Union of several selector sets, each of which must hold in full."""
    return reduce(lambda a, b: a | b, [select_keys(keys, s, "all") for s in selector_sets])


def drop_by_text(df: DataFrame, keys: Sequence[str], texts: Sequence[str], inclusive: bool = False) -> DataFrame:
    """Leave out (or keep only) datasets whose key contains one of the texts."""
    name = flatten_keys(keys)
    hit = reduce(lambda a, b: a | b, [F.contains(name, F.lit(t)) for t in texts])
    return df.where(hit if inclusive else ~hit)


# Statistics that a target expression may call.
STATISTICS = ("mean", "median", "min", "max", "std", "sum", "count")


def target_rows(df: DataFrame, expr: str) -> DataFrame:
    """Rows where an expression holds; `@median(x)` reads a column statistic.

    `==` alone takes all rows; an expression that cannot be resolved takes
    none.
    """
    if expr.strip() == "==":
        return df
    wanted = set(re.findall(r"@(\w+)\((\w+)\)", expr))
    if any(fn not in STATISTICS or c not in df.columns for fn, c in wanted):
        return df.limit(0)
    text = re.sub(r"@(\w+)\((\w+)\)", r"_\1_\2", expr)
    rows = df
    plain = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "sum": F.sum, "count": F.count}
    aggs = [plain[fn](c).alias(f"_{fn}_{c}") for fn, c in sorted(wanted) if fn != "median"]
    if aggs:
        rows = attach(rows, df.agg(*aggs), [])
    for fn, c in sorted(wanted):
        if fn == "median":
            rows = attach(rows, quantiles(df, [], c, {f"_median_{c}": 0.5}), [])
    try:
        return rows.where(F.expr(text)).select(*df.columns)
    except Exception as exc:
        if type(exc).__name__ in ("AnalysisException", "ParseException"):
            return df.limit(0)
        raise


def drop_nulls_and_values(df: DataFrame, null_values: Sequence = (), drop_on: str = "all", unique: bool = False) -> DataFrame:
    """Drop all-null (or any-null) rows after listed values became null."""
    if null_values:
        df = df.select(*[F.when(~F.col(c).isin(*null_values), F.col(c)).alias(c) for c in df.columns])
    df = df.dropna(how=drop_on)
    return df.dropDuplicates() if unique else df


def drop_empty_columns(df: DataFrame, families: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Drop columns (with their family) whose values are all null."""
    lead = list(families) if families else df.columns
    filled = df.agg(*[F.count(c).alias(c) for c in lead]).first()
    gone = set()
    for c in lead:
        if filled[c] == 0:
            gone |= {c, *(families[c] if families else ())}
    return df.select(*[c for c in df.columns if c not in gone])


def untranspose(
    df: DataFrame, keys: Sequence[str], field: str, values: Sequence[str], fields: Sequence[str], point: str = "point"
) -> DataFrame:
    """One row per field with many value columns -> one column per field.

    Rows in which every field is null or zero are dropped.
    """
    names = F.array(*[F.lit(v) for v in values])
    long = df.select(*keys, field, *values).unpivot([*keys, field], list(values), "_slot", "_v")
    long = long.withColumn(point, F.array_position(names, F.col("_slot")) - 1)
    wide = long.groupBy(*keys, point).agg(*[F.max(F.when(F.col(field) == f, F.col("_v"))).alias(f) for f in fields])
    some = reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(0)) != 0 for f in fields])
    return wide.where(some)


def constant_columns(df: DataFrame, names: Sequence[str]) -> dict:
    """Columns with one value, as attributes."""
    got = df.agg(*[F.min(c).alias(f"{c}_lo") for c in names], *[F.max(c).alias(f"{c}_hi") for c in names]).first()
    return {c: got[f"{c}_lo"] for c in names if got[f"{c}_lo"] is not None and got[f"{c}_lo"] == got[f"{c}_hi"]}


def params_long(df: DataFrame, keys: Sequence[str], params: Sequence[str], suffixes: Sequence[str] = ("values", "std")) -> DataFrame:
    """`<p>_values`, `<p>_std` columns -> one row per parameter."""
    items = F.array(*[
        F.struct(
            F.lit(p).alias("param"),
            *[(F.col(f"{p}_{s}") if f"{p}_{s}" in df.columns else F.lit(None)).cast("double").alias(s) for s in suffixes],
        )
        for p in params
    ])
    return df.select(*keys, F.explode(items).alias("_p")).select(*keys, "_p.*")


def params_wide(df: DataFrame, keys: Sequence[str], params: Sequence[str], columns: Sequence[str] = ("values", "std")) -> DataFrame:
    """Inverse of `params_long`; a missing parameter gives null."""
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col("param") == p, F.col(c))).alias(f"{p}_{c}") for p in params for c in columns
    ])


def rename_from_attribute(datasets: DataFrame, attrs: DataFrame, dataset: str, attribute: str, sep: str = "_") -> DataFrame:
    """New dataset names from an attribute, made unique by a counter.

    Several values of the attribute are joined in order.
    """
    from galvanite.operators.windows import ensure_unique

    vals = attrs.where(F.col("key") == attribute).select(dataset, "value").distinct()
    names = vals.groupBy(dataset).agg(F.array_join(F.array_sort(F.collect_set("value")), sep).alias("_name"))
    rows = attach(datasets.select(dataset).distinct(), names, [dataset])
    rows = rows.withColumn("_name", F.coalesce("_name", F.col(dataset).cast("string")))
    return ensure_unique(rows, "_name", [dataset], name="new_name").drop("_name")
