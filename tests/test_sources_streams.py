import os
import time

import pandas as pd
from pyspark.sql import functions as F

from galvanite.sources import readers as R
from galvanite.sources import writers as Wr
from galvanite.streaming import devices as X


def test_delimited_and_blocks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("freq;re;im\n1;2.5;3\n10;2;1\n")
    (tmp_path / "b.csv").write_text("freq;re;im\n5;1;3\n")
    df = R.read_delimited(spark, str(tmp_path), glob="*.csv")
    assert df.columns == ["freq", "re", "im", "dataset_id"]
    assert sorted((r["dataset_id"], r["freq"]) for r in df.collect()) == [("a", 1), ("a", 10), ("b", 5)]
    text = "sample: glass\narea = 25\n" + "\n".join(f"{i},{i * 2},{i * 3}" for i in range(8)) + "\n"
    (tmp_path / "c.txt").write_text(text)
    blocks = R.split_text_blocks(spark, str(tmp_path), ",", "*.txt")
    attrs = {r["key"]: r["value"] for r in R.comment_attributes(blocks, ["dataset_id"]).collect()}
    assert attrs == {"sample": "glass", "area": "25"}
    data = R.data_block_values(blocks, ["dataset_id"], ",", ["x", "y", "z"])
    assert data.count() == 8 and data.agg(F.sum("z")).first()[0] == 84


def test_scan_filters_and_stats(spark, tmp_path):
    for n in ("run1.txt", "run2.txt", "skip.txt"):
        (tmp_path / n).write_text("x\ny\n")
    df = R.scan_text(spark, str(tmp_path), "*.txt", pattern="^run")
    assert {r[0] for r in df.select("dataset_id").collect()} == {"run1", "run2"}
    assert R.file_stats(df).where("file_size > 0").count() == 2


def test_write_and_read(spark, tmp_path):
    df = spark.createDataFrame([("s", 60.0, 1, 1.5), ("s", 65.0, 2, 2.5)], "sample string, temp double, segment int, v double")
    attrs = spark.createDataFrame([("s", "area", "25")], "sample string, key string, value string")
    Wr.write_datasets(df, str(tmp_path), "points", ["sample", "temp"], attrs=attrs)
    back = R.read_results(spark, str(tmp_path), "points")
    assert sorted(map(tuple, back.select("sample", "temp", "segment", "v").collect())) == sorted(map(tuple, df.collect()))
    Wr.write_by_prefix(df, str(tmp_path / "p"), ["sample", "temp"], [1, 2])
    assert sorted(os.listdir(tmp_path / "p")) == ["all", "depth_1", "depth_2"]
    Wr.write_results(str(tmp_path / "r"), params=df.withColumn("fit_no", F.lit(1)))
    assert spark.read.parquet(str(tmp_path / "r" / "params")).count() == 2


def stream_dir(spark, tmp_path):
    ts = pd.date_range("2024-01-01", periods=40, freq="10s")
    vals = [20 + (i if i < 20 else 20) + (0.01 if i % 2 else 0) for i in range(40)]
    df = spark.createDataFrame(pd.DataFrame({"ts": ts, "device": "d1", "signal": ["a", "b"] * 20, "value": vals}))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_log_stream(spark, tmp_path):
    df, stream = stream_dir(spark, tmp_path)
    q = X.log_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), low=25)
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.where("value >= 25").count()


def test_combined_signal_stream_equals_batch(spark, tmp_path):
    df, stream = stream_dir(spark, tmp_path)
    make = lambda d: X.combine_signals(d, ["device"], "ts", "signal", "value", ["a", "b"], "1 minute", late="10 minutes")
    q = make(stream).writeStream.format("memory").queryName("combined").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    trim = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    assert trim(spark.table("combined").collect()) == trim(make(df).collect())


def test_calm_stretches(spark, tmp_path):
    df, _ = stream_dir(spark, tmp_path)
    got = X.calm_stretches(df, ["device"], ["ts"], "ts", "value", 0.5, 60.0)
    assert got.where("stable").count() == 1


def test_cut_to_files_forgets_estimated_sizes(spark):
    """Joins of a table with itself doubled the digits of its estimated size at every step, checkpoints or not."""
    from pyspark.sql import functions as F

    from galvanite.keyed import attach
    from galvanite.session import cut_to_files

    df = spark.range(4).select("id", F.col("id").cast("double").alias("v"))
    for _ in range(40):
        df = cut_to_files(attach(df, df.groupBy("id").agg(F.max("v").alias("top")), ["id"]).select("id", (F.col("v") + F.col("top")).alias("v")))
    assert {r["id"]: r["v"] for r in df.collect()} == {k: k * 2.0**40 for k in range(4)}
