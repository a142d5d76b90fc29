"""Trends of all key prefixes from one reduction; common parts of long names."""

import random

import pytest
from pyspark.sql import functions as F

from galvanite.functions import text as X
from galvanite.operators import regress as R
from galvanite.plans import pipeline as P


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_every_prefix_has_its_trend(spark, depth):
    rng = random.Random(depth)
    keys = [f"k{i}" for i in range(depth)]
    rows = []
    for i in range(300):
        t = float(rng.choice([20, 40, 60, 80, 100]))
        y = rng.choice([1, 1, 1, -1]) * 10 ** rng.uniform(-2, 1) * 2 ** (t / 20)
        rows.append((*[f"{'abcd'[j]}{rng.randint(0, 1)}" for j in range(depth)], None if i % 41 == 0 else t, 0.0 if i % 37 == 0 else y, None if i % 53 == 0 else y * 3, rng.choice([-1.0, 1.0])))
    df = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in keys) + ", temp double, r double, s double, ref double").cache()
    got = {(r["group_id"], r["column"]): r for r in P.point_trends({"points": df}, keys, "temp", ["r", "s"], "ref").collect()}
    levels = [[], *[keys[:k] for k in range(1, depth + 1)], *[[k] for k in keys[1:]]]
    side = F.when(F.col("ref") < 0, "neg").otherwise("pos")
    spread = None
    for lv in levels:
        for head in (F.lit("points"), F.concat_ws(" ", F.lit("points"), side)):
            part = df.withColumn("group_id", F.concat_ws(" ", head, *lv))
            spread = part if spread is None else spread.unionByName(part)
    want = R.arrhenius_points(spread, ["group_id"], "temp", ["r", "s"]).collect()
    assert {(r["group_id"], r["column"]) for r in want} == set(got)
    for r in want:
        g = got[r["group_id"], r["column"]]
        assert g["n"] == r["n"]
        for c in ("A", "Ea", "r2", "rss", "aicc"):
            assert g[c] == pytest.approx(r[c], rel=1e-8, abs=1e-12), (c, r, g)
    df.unpersist()


def test_rows_are_read_once(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 2).cast("string").alias("b"), (F.col("id") % 9).alias("temp"), (F.col("id") + 1.0).alias("r"), F.lit(1.0).alias("ref")).write.parquet(str(tmp_path / "p"))
    out = P.point_trends({"p": spark.read.parquet(str(tmp_path / "p"))}, ["a", "b"], "temp", ["r"], "ref")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.lower() and "explode" in plan.lower()


def common_by_hand(names):
    toks = [[t for t in n.replace("-", "_").replace(" ", "_").split("_") if t] for n in names]
    runs = [{tuple(ts[i:j]) for i in range(len(ts)) for j in range(i + 1, len(ts) + 1)} for ts in toks]
    shared = set.intersection(*runs)
    return min(("_".join(r) for r in shared), key=lambda s: (-s.count("_"), -len(s), s), default=None)


def test_common_tokens_by_hand(spark):
    rng = random.Random(3)
    rows = []
    for k in range(25):
        core = "_".join(rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.randint(0, 4)))
        for _ in range(rng.randint(1, 5)):
            rows.append((k, "-".join([rng.choice("abc") for _ in range(rng.randint(0, 5))]) + "_" + core + " " + " ".join(rng.choice("abd") for _ in range(rng.randint(0, 5)))))
    got = {r["k"]: (r["names"], r["common"]) for r in X.common_tokens(spark.createDataFrame(rows, "k int, name string"), ["k"], "name").collect()}
    for k in range(25):
        names = {n for q, n in rows if q == k}
        assert got[k] == (len(names), common_by_hand(names)), (k, names)


def test_common_run_of_long_names(spark):
    rng = random.Random(4)
    core = [f"t{rng.randint(0, 9)}" for _ in range(6000)]
    rows = [(1, " ".join([f"x{i}{j}" for j in range(2000 + 10 * i)] + core + [f"y{i}{j}" for j in range(2000)])) for i in range(5)]
    got = X.common_tokens(spark.createDataFrame(rows, "k int, name string"), ["k"], "name").first()
    assert (got["names"], got["common"]) == (5, "_".join(core))
