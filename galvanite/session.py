"""Session helpers: builder defaults, lineage cutting and group-size limits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

GROUP_LIMIT_KEY = "spark.galvanite.groupLimit"
DEFAULT_GROUP_LIMIT = 4_000_000


def build_session(app: str = "galvanite", **conf) -> SparkSession:
    """Session with adaptive execution and UTC time; `conf` overrides."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, val in {**defaults, **conf}.items():
        builder = builder.config(key, val)
    return builder.getOrCreate()


def group_limit(spark: SparkSession) -> int:
    """Largest number of rows of one key that a single task may order."""
    return int(spark.conf.get(GROUP_LIMIT_KEY, str(DEFAULT_GROUP_LIMIT)))


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; on a local master without one, a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder of the cluster."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_to_files(df: DataFrame) -> DataFrame:
    """Like `cut_lineage`, by way of Parquet files in the same folder.

    A checkpointed table keeps the size that was estimated for its plan, and a
    join multiplies such sizes: in a long chain of joins with tables made from
    themselves the estimate doubles its digits at every step, until the
    optimizer only multiplies. Files have their own size.
    """
    path = f"{_shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Inside, a join broadcasts a side by the rows that reach it and not by the bytes of the files they come from.

    Positions and times of runs take 1 MB of Parquet for 275 MB of rows, so
    the planner would send tables of millions of rows through the driver.
    Adaptive execution sees the size of the shuffled rows and decides then.
    """
    planned, seen = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit, limit_seen = spark.conf.get(planned), spark.conf.get(seen, None)
    spark.conf.set(seen, limit_seen or limit)
    spark.conf.set(planned, "-1")
    try:
        yield
    finally:
        spark.conf.set(planned, limit)
        if limit_seen is None:
            spark.conf.unset(seen)
