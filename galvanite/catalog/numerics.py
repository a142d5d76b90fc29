"""Numeric jobs: fits, spectra, interpolation, circuits on the given tables."""

from pyspark.sql import functions as F

from galvanite.catalog.base import EV, ORDER, USER, events, query, rounded, significant_digits, table
from galvanite.plans import circuit_fits as C
from galvanite.plans import decays as D
from galvanite.plans import fits as T
from galvanite.plans import interpolation as I
from galvanite.plans import peaks as K
from galvanite.plans import spectra as S
from galvanite.keyed import Ordered


def positions(spark, sf):
    ev = events(spark, sf)
    return Ordered(ev, USER, ORDER).positions("i", "n")


@query("dft_bins", f"""WITH {EV}, k AS (SELECT *, unnest([0, 1, 2, 3]) AS k FROM ev)
SELECT user_id, max(n) AS n, k, round(sum(value * cos(2 * pi() * ((k * i) % n) / n)), 6) + 0.0 AS re, round(-sum(value * sin(2 * pi() * ((k * i) % n) / n)), 6) + 0.0 AS im FROM k WHERE k < n GROUP BY user_id, k""")
def dft_bins(spark, sf):
    return rounded(S.dft_bins(positions(spark, sf), USER, "i", "n", "value", [0, 1, 2, 3]), 6)


@query("spectrum", f"""WITH {EV}, k AS (SELECT a.user_id, a.n, b.i AS k, a.i, a.value FROM ev a JOIN ev b ON a.user_id = b.user_id)
SELECT user_id, k AS bin, round(sum(value * cos(2 * pi() * ((k * i) % n) / n)), 5) + 0.0 AS re, round(-sum(value * sin(2 * pi() * ((k * i) % n) / n)), 5) + 0.0 AS im FROM k GROUP BY 1, 2""")
def spectrum(spark, sf):
    return rounded(S.spectrum(positions(spark, sf), USER, "i", "value"), 5)


@query("detect_period", None)
def detect_period(spark, sf):
    return rounded(S.detect_period(events(spark, sf), USER, ORDER, "value"), 8)


@query("initial_guess_linear", """SELECT user_id, round(regr_slope(value, t) * 1e6, 6) AS a0, round(regr_intercept(value, t), 6) AS b0 FROM (SELECT user_id, value, (epoch_us(ts) - 1704067200000000) / 1e6 AS t FROM events) GROUP BY 1""")
def initial_guess_linear(spark, sf):
    out = T.guess_linear(events(spark, sf), USER, "t", "value")
    return rounded(out.select("user_id", (F.col("a0") * 1e6).alias("a0"), "b0"), 6)


@query("initial_guess_exp", """WITH ev AS (SELECT user_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT user_id, value, (epoch_us(ts) - 1704067200000000) / 1e6 AS t FROM events)),
e AS (SELECT user_id, arg_min(i, {'m': abs(value), 'i': i}) AS lo, arg_max(i, {'m': abs(value), 'i': -i}) AS hi, max(n) AS n, max_by(value, i) AS last FROM ev GROUP BY 1),
b AS (SELECT ev.*, CASE WHEN greatest(lo, hi) < e.n * 0.75 THEN last ELSE max(CASE WHEN i = greatest(lo, hi) THEN value END) OVER (PARTITION BY ev.user_id) END AS b0, greatest(2, floor(ev.n * 0.05)) AS m FROM ev JOIN e ON e.user_id = ev.user_id),
a AS (SELECT *, CASE WHEN abs(value - b0) = 0 THEN 1e-32 ELSE abs(value - b0) END AS adj FROM b),
s AS (SELECT user_id, greatest(coalesce(-1 / regr_slope(CASE WHEN i >= n - 12 * m THEN ln(adj) END, CASE WHEN i >= n - 12 * m THEN t END), 1e-8), 1e-8) AS tau, sign(avg(CASE WHEN i < 2 * m THEN value END) - avg(CASE WHEN i >= n - 2 * m THEN value END)) AS sg, max(t) AS te FROM a GROUP BY 1)
SELECT a.user_id, round(max(b0), 6) AS b0, round(max(tau), 2) AS tau0 FROM a JOIN s ON s.user_id = a.user_id GROUP BY a.user_id""")
def initial_guess_exp(spark, sf):
    ev = events(spark, sf)
    out = T.guess_exponential(ev, USER, "t", "value")
    return rounded(out.select("user_id", "b0", "tau0"), {"b0": 6, "tau0": 2})


def _grid_sql(rounds: int = 6) -> str:
    """The refined grid in SQL: a key takes part in a round while its step is above the tolerance."""
    best = lambda c, step: f"""SELECT user_id, arg_min(tau, {{'r': rss, 't': tau}}) AS tau, min(rss) AS rss, max(step) {step} AS step FROM (SELECT d.user_id, tau, max(step) AS step,
  coalesce(greatest(regr_syy(value, exp(-t / tau)) - regr_slope(value, exp(-t / tau)) * regr_sxy(value, exp(-t / tau)), 0), 'inf'::DOUBLE) AS rss FROM d JOIN {c} ON {c}.user_id = d.user_id GROUP BY 1, 2) GROUP BY 1"""  # noqa: E731
    parts = [f"""WITH d AS MATERIALIZED (SELECT user_id, value, (epoch_us(ts) - 1704067200000000) / 1e6 AS t FROM events),
s AS (SELECT user_id, log10((hi - lo) / n / 10) AS a, (log10((hi - lo) * 10) - log10((hi - lo) / n / 10)) / 30 AS step FROM (SELECT user_id, min(t) AS lo, max(t) AS hi, count(*) AS n FROM d GROUP BY 1) WHERE n >= 3 AND hi > lo),
c0 AS (SELECT user_id, pow(10, a + step * k) AS tau, step FROM (SELECT *, unnest(range(31)) AS k FROM s)), b0 AS MATERIALIZED ({best("c0", "")})"""]
    for r in range(1, rounds + 1):
        parts.append(f"""c{r} AS (SELECT user_id, pow(10, log10(tau) - step + 2 * step * k / 12) AS tau, step FROM (SELECT *, unnest(range(13)) AS k FROM b{r - 1} WHERE step > 1e-4)),
b{r} AS MATERIALIZED ({best(f"c{r}", "/ 6")} UNION ALL SELECT * FROM b{r - 1} WHERE step <= 1e-4)""")
    return ", ".join(parts) + f" SELECT user_id, round(rss, 3) AS rss, step <= 1e-4 AS converged FROM b{rounds}"


@query("grid_fit", _grid_sql())
def grid_fit(spark, sf):
    return rounded(T.grid_fit(events(spark, sf), USER, "t", "value", "exp").select("user_id", "rss", "converged"), 3)


@query("fit_curves", None)
def fit_curves(spark, sf):
    df = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_quantity") / 50).alias("t"), (F.col("l_extendedprice") / 1e5).alias("y"))
    return T.fit_curves(df, ["l_suppkey"], "t", "y", "exp").select("l_suppkey", "p", "error", "rounds", "converged")


@query("fit_prepare", None)
def fit_prepare(spark, sf):
    ev = events(spark, sf)
    return T.prepare_bounds(T.guess_linear(ev, USER, "t", "value"), USER, ["a0", "b0"])


@query("interpolate_linear", f"""WITH v AS (SELECT user_id, floor(value) AS x, avg(event_id) AS y FROM events GROUP BY 1, 2), k AS (SELECT *, lead(x) OVER w AS xn, lead(y) OVER w AS yn FROM v WINDOW w AS (PARTITION BY user_id ORDER BY x))
SELECT user_id, x + 0.5 AS x, round(y + (yn - y) * 0.5 / (xn - x), 5) AS y FROM k WHERE xn IS NOT NULL""")
def interpolate_linear(spark, sf):
    v = events(spark, sf).groupBy("user_id", F.floor("value").cast("double").alias("x")).agg(F.avg("event_id").alias("y"))
    got = I.interpolate_at(v, v.select("user_id", (F.col("x") + 0.5).alias("x")), USER, "x", "y", "linear", extrapolate=False)
    return rounded(got.where(F.col("y").isNotNull()), {"y": 5})


@query("interpolate_pchip", """WITH v AS (SELECT user_id, floor(value) AS x, avg(event_id) AS y FROM events GROUP BY 1, 2),
k AS (SELECT *, x - lag(x) OVER w AS h0, lead(x) OVER w - x AS h1, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS s0, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s1 FROM v WINDOW w AS (PARTITION BY user_id ORDER BY x)),
e AS (SELECT *, lead(h1) OVER w AS hb1, lead(s1) OVER w AS sb1, lag(h0) OVER w AS hb0, lag(s0) OVER w AS sb0 FROM k WINDOW w AS (PARTITION BY user_id ORDER BY x)),
q AS (SELECT *, ((2 * h1 + hb1) * s1 - h1 * sb1) / (h1 + hb1) AS df, ((2 * h0 + hb0) * s0 - h0 * sb0) / (h0 + hb0) AS dl FROM e),
d AS (SELECT *, CASE WHEN s0 IS NULL AND s1 IS NULL THEN 0 WHEN s0 IS NULL AND sb1 IS NULL THEN s1 WHEN s1 IS NULL AND sb0 IS NULL THEN s0
 WHEN s0 IS NULL THEN CASE WHEN sign(df) <> sign(s1) THEN 0 WHEN sign(s1) <> sign(sb1) AND abs(df) > 3 * abs(s1) THEN 3 * s1 ELSE df END
 WHEN s1 IS NULL THEN CASE WHEN sign(dl) <> sign(s0) THEN 0 WHEN sign(s0) <> sign(sb0) AND abs(dl) > 3 * abs(s0) THEN 3 * s0 ELSE dl END
 WHEN sign(s0) * sign(s1) <= 0 THEN 0 ELSE (3 * h1 + 3 * h0) / ((2 * h1 + h0) / s0 + (h1 + 2 * h0) / s1) END AS d FROM q),
n AS (SELECT *, lead(x) OVER w AS xn, lead(y) OVER w AS yn, lead(d) OVER w AS dn FROM d WINDOW w AS (PARTITION BY user_id ORDER BY x)), t AS (SELECT *, xn - x AS h, 0.5 / (xn - x) AS t FROM n WHERE xn IS NOT NULL)
SELECT user_id, x + 0.5 AS x, round((1 + 2 * t) * (1 - t) * (1 - t) * y + t * (1 - t) * (1 - t) * h * d + t * t * (3 - 2 * t) * yn + t * t * (t - 1) * h * dn, 6) AS y FROM t""")
def interpolate_pchip(spark, sf):
    v = events(spark, sf).groupBy("user_id", F.floor("value").cast("double").alias("x")).agg(F.avg("event_id").alias("y"))
    got = I.interpolate_at(v, v.select("user_id", (F.col("x") + 0.5).alias("x")), USER, "x", "y", "pchip", extrapolate=False)
    return rounded(got.where(F.col("y").isNotNull()), {"y": 6})


@query("interpolate_cubic", None)
def interpolate_cubic(spark, sf):
    v = events(spark, sf).groupBy("user_id", F.floor("value").cast("double").alias("x")).agg(F.avg("event_id").alias("y"))
    return rounded(I.interpolate_at(v, v.select("user_id", (F.col("x") + 0.5).alias("x")), USER, "x", "y", "cubic", extrapolate=False), 4)


@query("regrid_log", None)
def regrid_log(spark, sf):
    v = events(spark, sf).groupBy("user_id", F.col("value").alias("freq")).agg(F.avg("event_id").alias("y"))
    return rounded(I.regrid_log(v, USER, "freq", "y", 5), 4)


def hourly(spark, sf):
    """Daily series per event type: time in days, mean value."""
    ev = events(spark, sf)
    return ev.groupBy("event_type", F.floor(F.col("t") / 21600).cast("double").alias("t")).agg(F.avg("value").alias("current"), F.lit(2.0).alias("voltage"))


@query("decay_from_data", None)
def decay_from_data(spark, sf):
    return rounded(D.decay_from_data(hourly(spark, sf), ["event_type"], "t", "current", "voltage", method="pchip"), 4)


@query("prepare_decay", """WITH d AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
m AS (SELECT *, avg(CASE WHEN i > n - 1 - greatest(1, floor(n * 0.075)) THEN value END) OVER (PARTITION BY user_id) AS ss FROM d)
SELECT user_id, i, round((value - ss) * (0.5 - 0.5 * cos(2 * pi() * i / n)), 6) + 0.0 AS decay, round(ss, 6) AS ss_decay FROM m""")
def prepare_decay(spark, sf):
    rows = positions(spark, sf).select("user_id", "i", F.col("i").cast("double").alias("t"), F.lit(1.0).alias("dt"), F.col("value").alias("decay"))
    out = D.prepare_decay(rows, USER, 0.075, window="hann", pad=False)
    return rounded(out.select("user_id", "i", "decay", "ss_decay"), 6)


@query("decay_from_fit", None)
def decay_from_fit(spark, sf):
    fits = table(spark, sf, "supplier").select("s_suppkey", F.array(F.lit(1.0), F.abs("s_acctbal") / 1000 + 0.5, F.lit(0.1)).alias("c"), F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)).alias("v"))
    return D.decay_from_fit(fits, ["s_suppkey"], "c", "v").groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("points"), F.max("decay").alias("top"))


@query("permittivity", None)
def permittivity(spark, sf):
    rows = positions(spark, sf).select("user_id", F.col("i").cast("int").alias("i"), F.col("i").cast("double").alias("t"), F.lit(1.0).alias("dt"), F.col("value").alias("decay"))
    prep = D.prepare_decay(rows, USER, 0.075, pad=True)
    return rounded(S.permittivity(prep, USER, "log", 100, "pchip").select("user_id", "freq", "re", "im"), 5)


@query("find_wide_peaks", None)
def find_wide_peaks(spark, sf):
    df = events(spark, sf).groupBy("user_id", F.floor("value").alias("freq")).agg(F.avg("event_id").alias("y")).where("freq > 0")
    return K.find_wide_peaks(df, USER, "freq", "y", min_width=1.0, min_prominence=100.0)


@query("peak_trend", None)
def peak_trend(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("temp"), F.col("l_extendedprice").alias("peak_freq"), (F.col("l_discount") + 0.01).alias("weight"))
    return K.peak_trend(df, ["l_returnflag"])


@query("trend_candidates", """WITH r AS (SELECT l_returnflag, l_quantity AS t, ln(l_extendedprice) AS y, l_discount + 0.01 AS w FROM lineitem), q AS (SELECT *, quantile_cont(w, 0.10) OVER (PARTITION BY l_returnflag) AS w10, quantile_cont(w, 0.40) OVER (PARTITION BY l_returnflag) AS w40 FROM r),
k AS (SELECT l_returnflag, 0 AS frac, t, y, w FROM q UNION ALL SELECT l_returnflag, 10, t, y, w FROM q WHERE w >= w10 UNION ALL SELECT l_returnflag, 40, t, y, w FROM q WHERE w >= w40)
SELECT l_returnflag, frac, count(*) AS points, round((sum(w*w) * sum(w*w*t*y) - sum(w*w*t) * sum(w*w*y)) / (sum(w*w) * sum(w*w*t*t) - pow(sum(w*w*t), 2)), 8) AS m FROM k GROUP BY 1, 2""")
def trend_candidates(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("temp"), F.col("l_extendedprice").alias("peak_freq"), (F.col("l_discount") + 0.01).alias("weight"))
    out = K.trend_candidates(df, ["l_returnflag"], "temp", "peak_freq", "weight", ["weight"])
    keep = (F.col("frac") == 0) | ((F.col("step") == 10) & F.col("frac").isin(10, 40))
    return rounded(out.where(keep).select("l_returnflag", F.col("frac").cast("int"), "points", "m"), {"m": 8})


def sweeps(spark, sf):
    """Sweeps per supplier: RC arc sampled at the quantities, with noise."""
    w = F.col("f") * 1e-2
    df = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_quantity") * 4).alias("f"), (F.col("l_tax") * 10).alias("noise"))
    return df.select("l_suppkey", "f", (10 + 1000 / (1 + w * w) + F.col("noise")).alias("re"), (-1000 * w / (1 + w * w)).alias("im"))


@query("collapse_sweeps", """SELECT l_suppkey, l_quantity * 4 AS f, round(avg(10 + 1000 / (1 + pow(l_quantity * 4 * 1e-2, 2)) + l_tax * 10), 6) AS re, count(*)::DOUBLE AS w_re FROM lineitem GROUP BY 1, 2""")
def collapse_sweeps(spark, sf):
    out = C.collapse_sweeps(sweeps(spark, sf), ["l_suppkey"], "f", "re", "im", weighted=False)
    return rounded(out.select("l_suppkey", "f", "re", "w_re"), {"re": 6})


@query("linkk", None)
def linkk(spark, sf):
    return C.linkk(sweeps(spark, sf), ["l_suppkey"], "f", "re", "im").select("l_suppkey", "m", "mu", "rms", "converged")


def rc_start(df, key):
    p = [("R0", 5.0, 0.1, 1e4), ("R1", 500.0, 1.0, 1e6), ("C1", 1e-5, 1e-9, 1e-1)]
    items = F.array(*[F.struct(F.lit(n).alias("param"), F.lit(v).alias("value"), F.lit(a).alias("lb"), F.lit(b).alias("ub")) for n, v, a, b in p])
    return df.select(key).distinct().select(key, F.lit(0).alias("start_no"), F.explode(items).alias("x")).select(key, "start_no", "x.*", F.lit(False).alias("locked"))


@query("circuit_fit_batch", None)
def circuit_fit_batch(spark, sf):
    df = sweeps(spark, sf)
    return C.fit_circuits(df, ["l_suppkey"], "f", "re", "im", "R0-p(R1,C1)", rc_start(df, "l_suppkey")).select("l_suppkey", "param", "value", "std")


@query("bootstrap_rows", """SELECT user_id, replicate, count(*) AS draws FROM (SELECT user_id, unnest([0, 1, 2]) AS replicate FROM events) GROUP BY 1, 2""")
def bootstrap_rows(spark, sf):
    return T.bootstrap_rows(events(spark, sf), USER, ORDER, 3).groupBy("user_id", "replicate").agg(F.count(F.lit(1)).alias("draws"))


@query("confidence_band", None)
def confidence_band(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", F.col("l_extendedprice").alias("y"))
    line = T.guess_linear(df, ["l_returnflag"], "l_quantity", "y").select("l_returnflag", F.array("a0", "b0").alias("p"))
    out = T.confidence_band(df, ["l_returnflag"], "l_quantity", "y", "linear", line)
    return rounded(out.select("l_returnflag", "l_quantity", "low", "high").distinct(), 2)


@query("corner_band", None)
def corner_band(spark, sf):
    from galvanite.operators.aggregates import band_percentiles

    params = table(spark, sf, "customer").select("c_mktsegment", "c_custkey", F.create_map(F.lit("R0"), F.abs("c_acctbal") + 1).alias("value"), F.create_map(F.lit("R0"), F.lit(1.0)).alias("std"))
    rows = C.corner_sweeps(C.corner_params(params, ["c_mktsegment", "c_custkey"], ["R0"]), ["c_mktsegment", "c_custkey"], "R0", [1.0, 10.0])
    return rounded(band_percentiles(rows, ["c_mktsegment"], "freq", "re"), 4)


@query("fit_batch_select", """WITH f AS (SELECT o_orderpriority || '_' || (o_orderkey % 7) AS name, o_totalprice AS value FROM orders), u AS (SELECT regexp_replace(name, '_\\d+$', '') AS stem, max(regexp_extract(name, '_(\\d+)$', 1)::INT) AS top FROM f GROUP BY 1)
SELECT name, round(value, 2) AS value, stem || '_' || (top + 1) AS next_name FROM f JOIN u ON u.stem = regexp_replace(name, '_\\d+$', '') WHERE regexp_matches(name, 'URGENT')""")
def fit_batch_select(spark, sf):
    fits = table(spark, sf, "orders").select(F.concat_ws("_", "o_orderpriority", (F.col("o_orderkey") % 7).cast("string")).alias("name"), F.col("o_totalprice").alias("value"))
    return rounded(C.batch_selection(fits, "name", "URGENT"), 2)


@query("material_params", """SELECT c_custkey, round(c_acctbal * 25 / 0.05, 4) AS rho FROM customer""")
def material_params(spark, sf):
    fits = table(spark, sf, "customer").select("c_custkey", F.lit("R1").alias("param"), F.col("c_acctbal").alias("value"), F.lit(1.0).alias("std"))
    return rounded(C.material_params(fits, F.lit(25.0), F.lit(0.05)).select("c_custkey", F.col("material_value").alias("rho")), 4)


@query("export_prediction", """SELECT l_suppkey, f, round(10 + 500 / (1 + pow(2 * pi() * f * 500 * 1e-5, 2)), 6) AS pr_re FROM (SELECT l_suppkey, l_quantity * 4 AS f FROM lineitem)""")
def export_prediction(spark, sf):
    df = sweeps(spark, sf)
    fits = df.select("l_suppkey").distinct().select("l_suppkey", F.lit("R0-p(R1,C1)").alias("model"), F.explode(F.array(
        *[F.struct(F.lit(n).alias("param"), F.lit(v).alias("value")) for n, v in (("R0", 10.0), ("R1", 500.0), ("C1", 1e-5))])).alias("x")).select("l_suppkey", "model", "x.*")
    return rounded(C.predict(df, fits, ["l_suppkey"], "f", ["R0-p(R1,C1)"]).select("l_suppkey", "f", "pr_re"), {"pr_re": 6})


@query("fit_jobs", None)
def fit_jobs(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_quantity") / 50).alias("t"), (F.col("l_extendedprice") / 1e5).alias("y"))
    jobs = [{"model": "exp"}, {"model": "exp", "targets": "error > @median(error)", "bias": 0.2}]
    return T.run_fit_jobs(df, ["l_returnflag", "l_linestatus"], "t", "y", jobs, group=["l_returnflag"]).select("l_returnflag", "l_linestatus", "p", "error", "fit_no", "rounds", "converged")


@query("refine_breakpoints", None)
def refine_breakpoints(spark, sf):
    from galvanite.plans.pipeline import refine_breakpoints as refine

    rows = positions(spark, sf).withColumn("v", F.when(F.floor(F.col("i") / 20) % 2 == 0, 100.0).otherwise(-100.0) + F.col("value") / 1e4)
    period = rows.select("user_id").distinct().withColumn("period", F.lit(20))
    return refine(rows.select("user_id", "i", "v"), USER, ["i"], "v", period)


@query("peak_results", None)
def peak_results(spark, sf):
    p = [("R0", F.lit(10.0)), ("R1", F.abs("s_acctbal") + 10), ("C1", F.lit(1e-5))]
    val = F.create_map(*[x for n, v in p for x in (F.lit(n), v)])
    std = F.create_map(*[x for n, v in p for x in (F.lit(n), v * 0.05)])
    params = table(spark, sf, "supplier").select("s_suppkey", val.alias("value"), std.alias("std"))
    return rounded(C.peak_results(params, ["s_suppkey"], "R0-p(R1,C1)", [10.0 ** (k / 8 - 2) for k in range(57)]).select("s_suppkey", "f_peak", "R", "R_std"), 6)


@query("model_stats", None)
def model_stats(spark, sf):
    df = sweeps(spark, sf).withColumnRenamed("f", "freq").groupBy("l_suppkey", "freq").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    params = df.select("l_suppkey").distinct().withColumn("value", F.create_map(F.lit("R0"), F.lit(10.0), F.lit("R1"), F.lit(1000.0), F.lit("C1"), F.lit(1.6e-6)))
    return C.model_stats(df, params, ["l_suppkey"], "R0-p(R1,C1)", ["p(R1,C1)"], [10.0 ** (k / 8) for k in range(33)])


@query("bootstrap_circuits", None)
def bootstrap_circuits(spark, sf):
    df = sweeps(spark, sf).withColumn("id", F.xxhash64("f", "re"))
    return C.bootstrap_circuits(df, ["l_suppkey"], ["f", "id"], "f", "re", "im", "R0-p(R1,C1)", rc_start(df, "l_suppkey"))


@query("peak_summary", None)
def peak_summary(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_returnflag", "l_suppkey", F.col("l_linenumber").alias("temp"), F.col("l_extendedprice").alias("peak_freq"), (F.col("l_discount") + 0.01).alias("weight"),
        F.col("l_quantity").alias("width"), F.col("l_tax").alias("prominence"))
    best, every = K.peak_summary(df, ["l_returnflag", "l_suppkey"], ["l_returnflag"], "temp", normalise=[["l_returnflag", "temp"]])
    return best.select("l_returnflag", "l_suppkey", "peak_freq", "m", "b")


@query("standardise_runs", None)
def standardise_runs(spark, sf):
    """Square-wave runs built on the events: volts, amperes and a thermocouple per event."""
    from galvanite.plans.pipeline import standardise_runs as standardise

    rows = positions(spark, sf).where("n >= 48")
    half = F.floor(F.col("i") / 12)
    sign = F.when(half % 2 == 0, 1.0).otherwise(-1.0)
    decay = F.exp(-(F.col("i") % 12) / 4.0)
    value = F.array(
        F.struct(F.lit("v").alias("channel"), (2.0 * sign).alias("value")),
        F.struct(F.lit("i").alias("channel"), (sign * (2e-9 + 3e-9 * decay) * (1 + F.col("value") * 1e-6)).alias("value")),
        F.struct(F.lit("tc").alias("channel"), (F.lit(0.0012) + F.col("value") * 1e-9).alias("value")))
    runs = rows.select((F.col("user_id") % 7).cast("string").alias("sample_name"), F.lit("pre").alias("condition"), (F.lit(60.0) + F.col("user_id") % 3).alias("temp"),
                       F.col("user_id").alias("run"), F.col("i").alias("row_idx"), F.timestamp_seconds(F.col("i")).alias("ts"), F.explode(value).alias("x"))
    out = standardise(runs.select("sample_name", "condition", "temp", "run", "row_idx", "ts", "x.*"), ["sample_name", "condition", "temp", "run"], "ts")
    return out["segments"].groupBy("sample_name", "run", "segment").agg(F.count(F.lit(1)).alias("rows"), F.avg("resistance").alias("resistance"))
