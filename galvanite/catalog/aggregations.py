"""Aggregations on the given tables."""

from pyspark.sql import functions as F

from galvanite.catalog.base import EV, FLAGS, ORDER, USER, events, query, rounded, table
from galvanite.operators import aggregates as A
from galvanite.operators import channels as C


@query("settled_mean", f"""WITH {EV}, s AS (SELECT *, floor(n * 0.6) AS lo, n - greatest(1, floor(n * 0.05)) AS hi FROM ev)
SELECT user_id, max(n) AS rows, round(avg(CASE WHEN n < 4 OR lo >= hi OR (i >= lo AND i < hi) THEN value END), 6) AS value,
  min_by(ts, i) AS first_ts FROM s GROUP BY user_id""")
def settled_mean(spark, sf):
    return rounded(A.settled_mean(events(spark, sf), USER, ORDER, ["value"], "ts"), 6)


@query("polarity_aggregate", """WITH o AS (SELECT o_orderpriority, o_totalprice, o_totalprice - 150000 AS ref FROM orders),
a AS (SELECT o_orderpriority, avg(CASE WHEN NOT (ref < 0) THEN o_totalprice END) AS pm, stddev_samp(CASE WHEN NOT (ref < 0) THEN o_totalprice END) AS ps,
 avg(CASE WHEN ref < 0 THEN o_totalprice END) AS nm, stddev_samp(CASE WHEN ref < 0 THEN o_totalprice END) AS ns FROM o GROUP BY 1)
SELECT o_orderpriority, round(coalesce(pm, avg(pm) OVER ()), 4) AS "pos o_totalprice", round(coalesce(ps, avg(ps) OVER ()), 4) AS "pos o_totalprice_std",
 round(coalesce(nm, avg(nm) OVER ()), 4) AS "neg o_totalprice", round(coalesce(ns, avg(ns) OVER ()), 4) AS "neg o_totalprice_std" FROM a""")
def polarity_aggregate(spark, sf):
    df = table(spark, sf, "orders").withColumn("ref", F.col("o_totalprice") - 150000)
    return rounded(A.polarity_aggregate(df, ["o_orderpriority"], ["o_totalprice"], "ref"), 4)


@query("segment_stats", f"""WITH {EV}, a AS (SELECT user_id, max(n) AS n, max_by(t, i) AS time,
  arg_min({{'i': i, 'v': value}}, {{'m': abs(value), 'i': i}}) AS lo, arg_max({{'i': i, 'v': value}}, {{'m': abs(value), 'i': -i}}) AS hi,
  min_by(value, i) AS first_v, max_by(value, i) AS last_v FROM ev GROUP BY user_id),
b AS (SELECT *, CASE WHEN lo.i < hi.i THEN lo ELSE hi END AS a, CASE WHEN lo.i < hi.i THEN hi ELSE lo END AS z, floor(n / 4) AS q FROM a)
SELECT user_id, round(time, 6) AS time, CASE WHEN q >= 1 THEN CASE WHEN a.i <= q THEN a.v ELSE first_v END END AS value_0,
 CASE WHEN q >= 1 THEN CASE WHEN z.i > 3 * q THEN z.v ELSE last_v END END AS value_f FROM b""")
def segment_stats(spark, sf):
    return rounded(A.segment_stats(events(spark, sf), USER, ORDER, "t", ["value"]), {"time": 6})


@query("stats_summary", """WITH l AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS error, l_tax > 0.04 AS up FROM lineitem),
s AS (SELECT l_returnflag, l_linestatus, sum(up::INT)::BIGINT AS updated, avg(error) AS m, stddev_samp(error) AS s, min(error) AS lo, max(error) AS hi, quantile_cont(error, 0.5) AS md,
 avg(error) FILTER (up) AS um, stddev_samp(error) FILTER (up) AS us, min(error) FILTER (up) AS ulo, max(error) FILTER (up) AS uhi, quantile_cont(error, 0.5) FILTER (up) AS umd
 FROM l GROUP BY 1, 2
 UNION ALL SELECT 'all', l_linestatus, sum(up::INT)::BIGINT, avg(error), stddev_pop(error), min(error), max(error), quantile_cont(error, 0.5),
 avg(error) FILTER (up), stddev_pop(error) FILTER (up), min(error) FILTER (up), max(error) FILTER (up), quantile_cont(error, 0.5) FILTER (up) FROM l GROUP BY l_linestatus)
SELECT l_returnflag, l_linestatus, updated, round(m, 4) AS error_mean, round(s, 4) AS error_std, lo AS error_min, hi AS error_max, round(md, 4) AS error_median,
 round(um, 4) AS error_umean, round(us, 4) AS error_ustd, ulo AS error_umin, uhi AS error_umax, round(umd, 4) AS error_umedian FROM s""")
def stats_summary(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("error"), (F.col("l_tax") > 0.04).alias("up"))
    out = A.stats_summary(df, "l_returnflag", "l_linestatus", ["error"], "up")
    return rounded(out, {c: 4 for c in out.columns if c.endswith(("mean", "std", "median"))})


@query("group_points", """WITH g AS (SELECT unnest([l_returnflag, l_linestatus, l_returnflag || ' ' || l_linestatus]) AS group_id, l_quantity FROM lineitem)
SELECT group_id, count(*) AS points, round(avg(l_quantity), 6) AS mean_qty FROM g GROUP BY 1""")
def group_points(spark, sf):
    df = table(spark, sf, "lineitem").select(*FLAGS, "l_quantity")
    spread = A.group_points(df, [["l_returnflag"], ["l_linestatus"], FLAGS])
    return rounded(spread.groupBy("group_id").agg(F.count(F.lit(1)).alias("points"), F.avg("l_quantity").alias("mean_qty")), 6)


@query("trimmed_midpoint", """WITH l AS (SELECT l_returnflag, l_linestatus, unnest([l_extendedprice, l_tax]) AS x, unnest(['p', 't']) AS c FROM lineitem),
q AS (SELECT l_returnflag, l_linestatus, c, quantile_cont(log10(CASE WHEN abs(x) > 0 THEN abs(x) END), 0.25) AS a,
 quantile_cont(log10(CASE WHEN abs(x) > 0 THEN abs(x) END), 0.75) AS b FROM l GROUP BY 1, 2, 3)
SELECT l_returnflag, l_linestatus, round(pow(10, avg((a + b) / 2)), 6) AS midpoint FROM q GROUP BY 1, 2""")
def trimmed_midpoint(spark, sf):
    return rounded(A.trimmed_midpoint(table(spark, sf, "lineitem"), FLAGS, ["l_extendedprice", "l_tax"]), 6)


@query("weighted_median", """WITH s AS (SELECT l_returnflag, l_linestatus, l_quantity AS x, sum(l_extendedprice) AS w FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY x) AS cum, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus) AS tot FROM s)
SELECT l_returnflag, l_linestatus, min(CASE WHEN cum >= tot / 2 THEN x END) AS median FROM c GROUP BY 1, 2""")
def weighted_median(spark, sf):
    return A.weighted_median_of(table(spark, sf, "lineitem"), FLAGS, "l_quantity", "l_extendedprice")


@query("most_frequent", """WITH c AS (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS k FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY k DESC, l_quantity) AS r FROM c)
SELECT l_returnflag, l_linestatus, l_quantity AS mode, k AS occurrences FROM r WHERE r = 1""")
def most_frequent(spark, sf):
    return A.most_frequent(table(spark, sf, "lineitem"), FLAGS, "l_quantity")


@query("edge_means", """WITH r AS (SELECT user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(avg(CASE WHEN i < greatest(1, floor(n * 0.05)) THEN event_id END), 6) AS z_zero,
 round(avg(CASE WHEN i >= n - greatest(1, floor(n * 0.05)) THEN event_id END), 6) AS z_infinity FROM r GROUP BY user_id""")
def edge_means(spark, sf):
    return rounded(A.edge_means(events(spark, sf), USER, ["value", "event_id"], {"event_id": "z"}), 6)


@query("merge_close_points", """WITH r AS (SELECT user_id, value, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS p FROM events),
g AS (SELECT *, sum(CASE WHEN abs(value - p) > 0.01 * (value + p) / 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS chain FROM r)
SELECT user_id, chain, count(*) AS points, round(avg(value), 6) AS value, round(avg(event_id), 6) AS event_id FROM g GROUP BY 1, 2""")
def merge_close_points(spark, sf):
    return rounded(A.merge_close_points(events(spark, sf), USER, ["value", "event_id"], "value", ["event_id"], 0.01), 6)


@query("classify_channels", """WITH a AS (SELECT user_id, event_type, min(abs(value)) AS lo, max(abs(value)) AS hi FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS channel, CASE WHEN (lo > 1.9 AND lo < 2.1 AND hi > 1.9 AND hi < 2.1) OR (lo > 2.8 AND lo < 3.0 AND hi > 2.8 AND hi < 3.0) THEN 'voltage'
 WHEN hi < 1e-8 THEN 'current' WHEN lo > 0 AND hi > 0 AND log10(lo) > -8 AND log10(lo) < -5 AND log10(hi) > -8 AND log10(hi) < -5 THEN 'unknown' ELSE 'unpicked' END AS role FROM a""")
def classify_channels(spark, sf):
    means = events(spark, sf).withColumnRenamed("event_type", "channel")
    traits = means.groupBy("user_id", "channel").agg(F.min(F.abs("value")).alias("min_abs"), F.max(F.abs("value")).alias("max_abs"))
    return C.classify_channels(traits).select("user_id", "channel", "role")


@query("decay_verdict", f"""WITH {EV}, a AS (SELECT user_id, max(n) AS rows, regr_slope(CASE WHEN i >= n // 2 THEN abs(value) END, CASE WHEN i >= n // 2 THEN t END) AS m,
 max(CASE WHEN i >= n // 2 THEN abs(value) END) AS mx, max(CASE WHEN i = n // 2 THEN sign(value - 20) END)::DOUBLE AS polarity FROM ev GROUP BY user_id),
b AS (SELECT user_id, user_id % 10 AS grp, rows, polarity, CASE WHEN rows < 4 THEN 0.0 ELSE m / mx END AS slope FROM a),
c AS (SELECT *, rows >= 4 AND coalesce(slope >= 1e-7, false) AS acc FROM b),
d AS (SELECT *, bool_or(acc) OVER (PARTITION BY grp, polarity) AS anyacc, row_number() OVER (PARTITION BY grp, polarity ORDER BY abs(1e-7 - slope), user_id) AS r FROM c)
SELECT user_id, grp, rows, polarity, round(slope, 12) AS slope, acc OR (NOT anyacc AND r = 1) AS accepted FROM d""")
def decay_verdict(spark, sf):
    df = events(spark, sf).withColumn("grp", F.col("user_id") % 10).withColumn("v", F.col("value") - 20)
    return rounded(A.decay_verdict(df, ["user_id", "grp"], ORDER, "t", "value", "v", ["grp"], 1e-7), {"slope": 12})


@query("cycling_test", f"""WITH {EV}, s AS (SELECT user_id, sign(value - 20) AS g, lag(sign(value - 20)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p, event_type FROM ev)
SELECT user_id, event_type, CASE WHEN count(*) < 2 THEN false ELSE bool_and(CASE WHEN p IS NOT NULL THEN g = -p END) END AS cycling FROM s GROUP BY 1, 2""")
def cycling_test(spark, sf):
    return A.cycling_test(events(spark, sf).withColumn("v", F.col("value") - 20), ["user_id", "event_type"], ORDER, "v")


@query("rank_datasets", "SELECT user_id, max(value) AS score FROM events GROUP BY user_id")
def rank_datasets(spark, sf):
    return A.rank_datasets(events(spark, sf), USER, "value")


@query("describe_bootstrap", """SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS value,
 round((quantile_cont(l_quantity, 0.95) - quantile_cont(l_quantity, 0.05)) / 2, 6) AS std FROM lineitem GROUP BY 1, 2""")
def describe_bootstrap(spark, sf):
    return rounded(A.describe_bootstrap(table(spark, sf, "lineitem"), FLAGS, "l_quantity", 90), 6)


@query("band_percentiles", """SELECT l_returnflag, l_quantity, round(quantile_cont(l_extendedprice, 0.025), 6) AS low, round(quantile_cont(l_extendedprice, 0.975), 6) AS high,
 round(avg(l_extendedprice) + 1e-7, 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std FROM lineitem GROUP BY 1, 2""")
def band_percentiles(spark, sf):
    out = A.band_percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    # Means of cents often end in an exact half: move off it before rounding.
    return rounded(out.withColumn("mean", F.col("mean") + 1e-7), {"low": 6, "high": 6, "mean": 4, "std": 4})


@query("nyquist_band", """WITH b AS (SELECT l_returnflag, l_extendedprice AS x, l_tax AS y, min(l_extendedprice) OVER w AS lo, max(l_extendedprice) OVER w AS hi,
 greatest(1, round((log10(max(l_quantity) OVER w) - log10(min(l_quantity) OVER w)) * 50)) AS bins FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)),
c AS (SELECT l_returnflag, x, y, least(floor((x - lo) / (hi - lo) * bins), bins - 1)::BIGINT AS bin FROM b)
SELECT l_returnflag, bin, round(avg(x) + 1e-7, 4) AS "real", count(*) AS points, round(quantile_cont(y, 0.025), 6) AS low, round(quantile_cont(y, 0.975), 6) AS high FROM c GROUP BY 1, 2""")
def nyquist_band(spark, sf):
    out = A.nyquist_band(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", "l_tax")
    return rounded(out.withColumn("real", F.col("real") + 1e-7), {"real": 4, "low": 6, "high": 6})


@query("array_attrs", """WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 1) + 0.0) AS a FROM embeddings)
SELECT vec_id, list_min(a) AS low, a[1] AS first, CASE WHEN len(list_distinct(a)) = 1 THEN a[1] END AS only FROM a""")
def array_attrs(spark, sf):
    vals = F.transform("embedding", lambda x: F.round(x.cast("double"), 1) + F.lit(0.0))
    return table(spark, sf, "embeddings").select(
        "vec_id", A.array_attrs(vals, "min").alias("low"), A.array_attrs(vals, "first").alias("first"), A.array_attrs(vals).alias("only")
    )


@query("rank_periods", """WITH m AS (SELECT user_id, event_type AS channel, (count(*) // 2) AS period, count(*) AS n, max(value) AS strength, avg(value) AS snr, min(value) + 1 AS sharpness FROM events GROUP BY 1, 2),
k AS (SELECT * FROM m WHERE strength >= 1 AND period > 0 AND floor(n / period) < period),
cm AS (SELECT user_id, arg_min(period, {'a': -c, 'p': period}) AS common FROM (SELECT user_id, period, count(*) AS c FROM k GROUP BY 1, 2) GROUP BY 1),
av AS (SELECT user_id, avg(period) AS mean FROM k GROUP BY 1),
ce AS (SELECT k.user_id, arg_min(period, {'a': abs(period - mean), 'p': period}) AS centre FROM k JOIN av USING (user_id) GROUP BY 1),
d AS (SELECT k.*, abs(period - common) AS dc, abs(period - centre) AS da FROM k JOIN cm USING (user_id) JOIN ce USING (user_id)),
p AS (SELECT user_id, period, max(strength) AS a, max(snr) AS b, max(sharpness) AS c, max(dc) AS dc, max(da) AS da FROM d GROUP BY 1, 2),
r AS (SELECT user_id, period, rank() OVER (PARTITION BY user_id ORDER BY a DESC) + rank() OVER (PARTITION BY user_id ORDER BY b DESC) + rank() OVER (PARTITION BY user_id ORDER BY c DESC)
 + rank() OVER (PARTITION BY user_id ORDER BY dc) + rank() OVER (PARTITION BY user_id ORDER BY da) AS r FROM p),
best AS (SELECT user_id, arg_min(period, {'r': r, 'p': period}) AS period FROM r GROUP BY 1),
cand AS (SELECT d.user_id, d.period, d.channel, rank() OVER (PARTITION BY d.user_id ORDER BY strength DESC) + rank() OVER (PARTITION BY d.user_id ORDER BY snr DESC) + rank() OVER (PARTITION BY d.user_id ORDER BY sharpness DESC) AS r
 FROM d JOIN best ON d.user_id = best.user_id AND d.period = best.period)
SELECT user_id, max(period) AS period, arg_min(channel, {'r': r, 'c': channel}) AS channel FROM cand GROUP BY 1""")
def rank_periods(spark, sf):
    m = events(spark, sf).groupBy("user_id", F.col("event_type").alias("channel")).agg(
        F.expr("count(*) div 2").alias("period"), F.count(F.lit(1)).alias("n"), F.max("value").alias("strength"), F.avg("value").alias("snr"), (F.min("value") + 1).alias("sharpness"))
    return A.rank_periods(m.where("period > 0"), USER, "n")


@query("infer_roles", None)
def infer_roles(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_orderkey"), F.col("l_linenumber"), F.pow(F.lit(10.0), F.col("l_orderkey") / 1e4).alias("frequency"),
        F.col("l_extendedprice").alias("a"), (-F.col("l_tax") * 1000).alias("b"))
    traits = C.column_traits(df, ["l_returnflag"], ["l_orderkey", "l_linenumber"], ["frequency", "a", "b"])
    return C.infer_roles(traits, ["l_returnflag"])


@query("resolve_channels", None)
def resolve_channels(spark, sf):
    df = events(spark, sf).select("user_id", F.lit(60.0).alias("temp"), F.col("event_type").alias("channel"), F.to_date("ts").alias("segment"), "value")
    means = df.groupBy("user_id", "temp", "channel", "segment").agg(F.avg("value").alias("value"))
    run = ["user_id", "temp"]
    return C.resolve_channels(C.channel_traits(means, run, ["segment"]), means, run, ["segment"], "temp", trend=["user_id"])


@query("infer_multiplier", None)
def infer_multiplier(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("sample_name"), F.when(F.col("l_linestatus") == "F", "pre").otherwise("dry").alias("condition"),
        F.col("l_linenumber").alias("temp"), "l_orderkey", (F.col("l_quantity") / 10).alias("raw_current"),
        F.when(F.col("l_tax") > 0.02, F.col("l_quantity") * 1e-10).alias("current"))
    return C.infer_multiplier(df).groupBy("sample_name", "condition", "temp", "multiplier").agg(F.count(F.lit(1)).alias("rows"))


def _trend_walk(name: str, p: int, fix: str) -> str:
    """SQL: mean and least resistance before each temperature of one polarity, and its bar."""
    raised = f"list_transform(g.v, lambda x: CASE WHEN x >= w.m THEN x / pow(10, {fix} + ceil(log10(x / (w.m * 0.99)))) ELSE x END)"
    return f"""{name}w(s, c, k, m, l) AS (SELECT s, c, k, 10 * list_avg(v), 10 * v[1] FROM g WHERE k = 1 AND p = {p}
  UNION ALL SELECT w.s, w.c, w.k + 1, CASE WHEN g.v[-1] >= w.l THEN list_avg({raised}) ELSE list_avg(g.v) END, CASE WHEN g.v[-1] >= w.l THEN list_min({raised}) ELSE g.v[1] END
  FROM {name}w w JOIN g ON g.s = w.s AND g.c = w.c AND g.k = w.k AND g.p = {p} LEFT JOIN f{name} ON f{name}.s = w.s AND f{name}.c = w.c),
{name}b AS MATERIALIZED (SELECT g.s, g.c, g.p, g.t, w.m FROM {name}w w JOIN g ON g.s = w.s AND g.c = w.c AND g.k = w.k AND g.p = {p} WHERE g.v[-1] >= w.l)"""


_INTO = "CASE WHEN min(e) < -10 THEN -10 - min(e) WHEN max(e) > -8 THEN -8 - max(e) ELSE 0 END"
_SHIFT = "CASE WHEN open AND r >= m THEN ceil(log10(r / (m * 0.99))) ELSE 0 END"


@query("enforce_trend", f"""WITH RECURSIVE d AS (SELECT l_orderkey, l_linenumber, l_suppkey AS s, CASE l_returnflag WHEN 'A' THEN 'pre' WHEN 'R' THEN 'dry' ELSE 'dh' END AS c, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END AS p,
  l_quantity AS t, 1e12 * l_extendedprice / l_quantity * pow(10, -l_quantity / 4) AS r, l_linenumber < 7 AS open, CASE WHEN l_linenumber < 7 THEN -9 ELSE 0 END AS e0 FROM lineitem),
g AS MATERIALIZED (SELECT s, c, p, t, list(r ORDER BY r) AS v, row_number() OVER (PARTITION BY s, c, p ORDER BY t) AS k FROM d WHERE open GROUP BY s, c, p, t),
fx AS (SELECT s, c, 0 AS fix FROM d GROUP BY s, c),
{_trend_walk("x", -1, "fx.fix")},
d1 AS MATERIALIZED (SELECT d.*, {_SHIFT} AS sh FROM d LEFT JOIN xb USING (s, c, p, t)),
fy AS MATERIALIZED (SELECT s, c, {_INTO} AS fix FROM (SELECT s, c, e0 + sh AS e FROM d1 WHERE open AND (s, c) IN (SELECT (s, c) FROM g WHERE p = -1)) GROUP BY s, c),
{_trend_walk("y", 1, "coalesce(fy.fix, 0)")},
d2 AS MATERIALIZED (SELECT d1.* EXCLUDE (sh), coalesce(fy.fix, 0) AS fix, sh + {_SHIFT} AS sh FROM d1 LEFT JOIN fy USING (s, c) LEFT JOIN yb USING (s, c, p, t)),
fz AS MATERIALIZED (SELECT s, c, {_INTO} AS more FROM (SELECT s, c, e0 + sh + fix AS e FROM d2 WHERE open AND (s, c) IN (SELECT (s, c) FROM g WHERE p = 1)) GROUP BY s, c),
d3 AS MATERIALIZED (SELECT d2.*, CASE WHEN open THEN sh + fix + coalesce(more, 0) ELSE 0 END AS total FROM d2 LEFT JOIN fz USING (s, c)),
n AS MATERIALIZED (SELECT s, max(CASE WHEN a >= b THEN ceil(log10(a / (b * 0.99))) END) AS need FROM (SELECT s, t, avg(r / pow(10, total)) FILTER (c = 'dh' AND open) AS a, avg(r / pow(10, total)) FILTER (c IN ('pre', 'dry')) AS b FROM d3 GROUP BY s, t) GROUP BY s),
d4 AS MATERIALIZED (SELECT d3.*, CASE WHEN c = 'dh' AND need > 0 THEN need ELSE 0 END AS up, need FROM d3 LEFT JOIN n USING (s)),
fl AS (SELECT s, {_INTO} AS last FROM (SELECT s, e0 + total + up AS e FROM d4 WHERE open AND need > 0) GROUP BY s)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN open THEN e0 + total + up + coalesce(last, 0) ELSE 0 END AS BIGINT) AS exponent,
  round(log10(CASE WHEN open THEN r / pow(10, total + up + coalesce(last, 0)) ELSE r END), 6) AS log_resistance FROM d4 LEFT JOIN fl USING (s)""")
def enforce_trend(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "pre").when(F.col("l_returnflag") == "R", "dry").otherwise("dh")
    falling = 1e12 * F.col("l_extendedprice") / F.col("l_quantity") * F.pow(F.lit(10.0), -F.col("l_quantity") / 4)
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("sample_name"), kind.alias("condition"), F.col("l_quantity").alias("temp"), falling.alias("resistance"),
        F.when(F.col("l_orderkey") % 2 == 0, 2.0).otherwise(-2.0).alias("voltage"), F.when(F.col("l_linenumber") < 7, 1e-9).otherwise(1.0).alias("multiplier"))
    out = C.enforce_trend(df)
    return rounded(out.select("l_orderkey", "l_linenumber", F.round(F.log10("multiplier")).cast("long").alias("exponent"), F.log10("resistance").alias("log_resistance")), 6)
