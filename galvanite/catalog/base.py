"""Registry helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galvanite.functions.ieee import finite

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that gives the same rows."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs: user_id, order (ts, event_id), seconds `t` since 2024-01-01."""
    df = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return df.select("user_id", "ts", "event_id", "event_type", "value", ((micros - 1704067200000000) / 1e6).alias("t"))


USER = ["user_id"]
ORDER = ["ts", "event_id"]
FLAGS = ["l_returnflag", "l_linestatus"]

# Events with position, size and seconds, for the SQL twins.
EV = """ev AS (SELECT user_id, ts, event_id, event_type, value, (epoch_us(ts) - 1704067200000000) / 1e6 AS t,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def round_product(x: Column, digits: int) -> Column:
    """Rounded as the product, like the SQL: a decimal text of the number rounds other ties."""
    shift = 10.0**digits
    return F.coalesce(finite(F.round(x * shift) / shift), x)


def rounded(df: DataFrame, digits: dict[str, int] | int, products: bool = False) -> DataFrame:
    """Round double columns so that the last digits of sums do not matter; `products` by `round_product`."""
    cols = []
    for name, kind in df.dtypes:
        d = digits if isinstance(digits, int) else digits.get(name)
        if d is not None and kind in ("double", "float"):
            x = F.col(f"`{name}`")
            cols.append(((round_product(x, d) if products else F.round(x, d)) + F.lit(0.0)).alias(name))
        else:
            cols.append(F.col(f"`{name}`"))
    return df.select(*cols)


def significant_digits(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round doubles to significant digits (mantissa text, for wide ranges)."""
    return df.select(*[
        (F.format_string(f"%.{digits - 1}e", F.col(f"`{n}`")).cast("double").alias(n) if k == "double" else F.col(f"`{n}`"))
        for n, k in df.dtypes
    ])
