"""What failed or differed on tables of a gigabyte."""

import inspect
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from galvanite.catalog.scalars import scaled
from galvanite.operators import channels as C
from galvanite.plans import circuit_fits as CF
from galvanite.plans.kernels import circuit_impedance, resample_counts
from tests.conftest import SF


def test_run_pipeline_broadcasts_no_rows_by_file_size(spark, monkeypatch):
    """Axes of runs are tiny as Parquet and large in the driver; no join may be planned on the bytes of the files."""
    from galvanite.plans import pipeline as P

    class Reached(Exception):
        pass

    plans = []

    def cut(df, keep=P.cut_to_files):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    def reached(*args, **kw):
        raise Reached

    monkeypatch.setattr(P, "cut_to_files", cut)
    monkeypatch.setattr(P, "settled_mean", reached)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(Reached):
        entry.queries()["standardise_runs"](spark, SF)
    joins = [p for p in plans if "Join" in p]
    assert joins and not any("BroadcastHashJoin" in p for p in joins)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == limit
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None


def test_trend_deals_rows_and_lines_twice_each(spark):
    """Every table that is dealt or kept lies on disk: the rows by group and for the join, the lines by sample and for the join."""
    rows = [(i, f"s{i % 7}", ("pre", "dry", "dh")[i % 3], float(i % 11), 1e9 * 0.9 ** (i % 11) * (1 + i % 5), (-2.0, 2.0)[i % 2], (1e-9, 1.0)[i % 13 == 0]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, sample_name string, condition string, temp double, resistance double, voltage double, multiplier double")
    plan = C.enforce_trend(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4
    assert plan.count("Scan ExistingRDD") <= 2


def test_bootstrap_makes_all_resamples(spark, monkeypatch):
    """The query leaves the number of resamples to the operator, which has the 500 of the reference."""
    asked = []
    monkeypatch.setattr(CF, "bootstrap_circuits", lambda *args, **kw: asked.append(kw))
    entry.queries()["bootstrap_circuits"](spark, SF)
    assert asked == [{}]
    monkeypatch.undo()
    assert inspect.signature(CF.bootstrap_circuits).parameters["replicates"].default == 500


@pytest.mark.parametrize("options", [{}, {"weighted": False, "loss": "cauchy"}, {"band": (2.0, 300.0)}])
def test_resamples_are_fitted_together_as_one_by_one(spark, options):
    rng = np.random.default_rng(3)
    model, rows, drawn = "R0-p(R1,C1)", [], []
    for key in (1, 2):
        f = np.repeat(np.logspace(0, 3, 12), 4)
        z = circuit_impedance(model, {"R0": 10.0 * key, "R1": 900.0, "C1": 2e-6}, f)
        mine = [(key, i, float(f[i]), float(z[i].real * (1 + rng.normal() / 50)), float(z[i].imag * (1 + rng.normal() / 50))) for i in range(len(f))]
        rows += mine
        drawn += [(*r, b) for b in range(5) for r, k in zip(mine, resample_counts(len(mine), b)) for _ in range(k)]
    sweeps = spark.createDataFrame(rows, "k long, id long, f double, re double, im double")
    starts = [(n, float(v), lb, ub) for n, v, lb, ub in (("R0", 5, 0.1, 1e4), ("R1", 500, 1.0, 1e6), ("C1", 1e-5, 1e-9, 1e-1))]
    start = spark.createDataFrame([(k, s, n, v * (1 + s), lb, ub, False) for k in (1, 2) for s in (0, 1) for n, v, lb, ub in starts], "k long, start_no int, param string, value double, lb double, ub double, locked boolean")
    got = {(r["k"], r["replicate"], r["param"]): r["value"] for r in CF.resampled_fits(sweeps.repartition(3), ["k"], ["id"], "f", "re", "im", model, start, 5, **options).collect()}
    expanded = spark.createDataFrame(drawn, "k long, id long, f double, re double, im double, replicate int")
    each = start.crossJoin(spark.range(5).selectExpr("cast(id as int) as replicate"))
    want = {(r["k"], r["replicate"], r["param"]): r["value"] for r in CF.fit_circuits(expanded, ["k", "replicate"], "f", "re", "im", model, each, **options).collect()}
    assert len(want) == 30 and got == pytest.approx(want, rel=1e-5)


def matches_sql(spark, folder, name, events, digits=12):
    """The rows of a query on (event_id, user_id, event_type, value) and those of its SQL; null, NaN and infinite are told apart."""
    at = pa.array([datetime(2024, 1, 1) + timedelta(seconds=i) for i in range(len(events))], pa.timestamp("us"))
    columns = [pa.array(c, t) for c, t in zip(zip(*events), (pa.int64(), pa.int64(), pa.string(), pa.float64()))]
    pq.write_table(pa.table([*columns, at], ["event_id", "user_id", "event_type", "value", "ts"]), folder / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    plain = lambda v: v if v is None or not isinstance(v, float) else f"{v + 0.0:.{digits}g}"
    want = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in entry.queries()[name](spark, str(folder)).collect()), key=repr) == want


def test_scaled_numbers_round_ties_as_sql(spark):
    x = np.random.default_rng(6).uniform(1e5, 1e6, 1_000_000)
    ties = x[x * 1e6 - np.floor(x * 1e6) == 0.5].tolist()
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in ties]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ties)], "i int, x double")
    assert len(ties) > 20 and [r["y"] for r in df.select("i", scaled(F.col("x"), 1.0).alias("y")).orderBy("i").collect()] == want


def test_edges_of_datasets_with_missing_frequencies(spark, tmp_path):
    values = [None, 3.0, 0.0, 12.5, None, 7.25, float("nan"), 0.01]
    matches_sql(spark, tmp_path, "dc_corrected_forms", [(i, i % 3, "view", values[i * 5 % 8]) for i in range(150)])


KINDS = ["click", "view", "error", "signup"]


def test_raw_channels_round_ties_and_sign_as_sql(spark, tmp_path):
    values = [None, 0.0, float("nan"), 1.1713567838937466e-06, 1.1707121269864576e-06, 1.6296052799935796e-06, 81.92, 50.0, -3.25]
    matches_sql(spark, tmp_path, "raw_to_standard", [(i, 1, KINDS[i % 4], values[i // 4]) for i in range(4 * len(values))], 17)


def test_forms_round_ties_and_magnitudes_as_sql(spark, tmp_path):
    big = np.random.default_rng(9).uniform(1e8, 1e9, 400).tolist()
    values = [None, 0.0, float("nan"), 1.1108666426341752e-06, 1.861181815553247e-06, 7.73305398373164e-06, 8634769.267760696, 4038875.702981551, *big]
    matches_sql(spark, tmp_path, "with_forms", [(i, 1, "view", v) for i, v in enumerate(values)], 17)
