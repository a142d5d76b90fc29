"""Writing datasets and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galvanite.keyed import attach
from galvanite.plans.circuit_fits import predict


def write_datasets(df: DataFrame, root: str, name: str, keys: Sequence[str] = (), fmt: str = "parquet", mode: str = "overwrite",
                   attrs: DataFrame | None = None, target_rows: int = 5_000_000) -> None:
    """One table of datasets, partitioned by key columns, attributes beside it.

    Rows are spread by the keys and a salt sized from the row count, so one
    large key is written by several tasks.
    """
    writer_df = df
    if keys:
        sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(target_rows))).alias("_parts"))
        salted = attach(df, sizes, list(keys)).withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.col("_parts")))
        writer_df = salted.repartition(*keys, "_salt").drop("_parts", "_salt")
    writer = writer_df.write.mode(mode).option("maxRecordsPerFile", target_rows)
    if keys:
        writer = writer.partitionBy(*keys)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(f"{root}/{name}")
    if attrs is not None:
        attrs.write.mode(mode).parquet(f"{root}/{name}_attrs")


def write_results(root: str, mode: str = "overwrite", **tables: DataFrame) -> None:
    """Named result tables, each partitioned by what it has of kind, fit_no."""
    for name, df in tables.items():
        write_datasets(df, root, name, [k for k in ("kind", "fit_no") if k in df.columns], mode=mode)


def write_by_prefix(df: DataFrame, root: str, keys: Sequence[str], depths: Sequence[int], everything: bool = True, fmt: str = "parquet") -> None:
    """One output per distinct key prefix at each depth, and all rows."""
    for d in depths:
        write_datasets(df, root, f"depth_{d}", list(keys[:d]), fmt)
    if everything:
        write_datasets(df, root, "all", (), fmt)


def export_with_prediction(sweeps: DataFrame, fits: DataFrame, keys: Sequence[str], freq: str, models: Sequence[str], root: str, name: str = "export") -> None:
    """Sweeps with the prediction columns of their stored fit."""
    write_datasets(predict(sweeps, fits, keys, freq, models), root, name, ["model"])
