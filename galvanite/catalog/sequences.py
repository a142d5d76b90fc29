"""Ordered-sequence operators on events (runs are users)."""

from pyspark.sql import functions as F

from galvanite.catalog.base import EV, ORDER, USER, events, query, rounded, table
from galvanite.operators import cleaning as CL
from galvanite.operators import windows as W
from galvanite.plans import interpolation as I
from galvanite.sources import readers as S
from galvanite.streaming import devices as X

OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


@query("difference_gradient", f"""SELECT user_id, event_id, round(CASE WHEN lag(value) {OVER}) IS NULL THEN lead(value) {OVER}) - value
 WHEN lead(value) {OVER}) IS NULL THEN value - lag(value) {OVER}) ELSE (lead(value) {OVER}) - lag(value) {OVER})) / 2 END, 6) AS gradient FROM events""")
def difference_gradient(spark, sf):
    return rounded(W.gradient(events(spark, sf), USER, ORDER, "value").select("user_id", "event_id", "gradient"), 6)


@query("moving_average", f"""WITH {EV} SELECT user_id, event_id, round(CASE WHEN i = 0 THEN avg(value) {OVER} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)
 WHEN i = 1 THEN avg(value) {OVER} ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) WHEN n - 1 - i = 0 THEN value WHEN n - 1 - i = 1 THEN avg(value) {OVER} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
 ELSE avg(value) {OVER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS moving_average FROM ev""")
def moving_average(spark, sf):
    return rounded(W.moving_average(events(spark, sf), USER, ORDER, "value", 5).select("user_id", "event_id", "moving_average"), 6)


def _savgol_sql() -> str:
    n, half = 7, 3
    lag = lambda k: "value" if k == 0 else (f"lag(value, {-k}) {OVER})" if k < 0 else f"lead(value, {k}) {OVER})")
    dot = lambda coef, shift: " + ".join(f"({float(c)!r}) * ({lag(shift + k)})" for k, c in enumerate(coef))
    text = f"({dot(W.savgol_coefficients(n, 2), -half)})"
    for k in range(half):
        text = (f"CASE WHEN i = {k} THEN {dot(W.savgol_coefficients(n, 2, at=k), -k)} WHEN i = n - 1 - {k} THEN "
                f"{dot(W.savgol_coefficients(n, 2, at=n - 1 - k), -(n - 1 - k))} ELSE {text} END")
    return f"WITH {EV} SELECT user_id, event_id, round(CASE WHEN n > 7 THEN {text} ELSE value END, 5) AS smooth FROM ev"


@query("savgol", _savgol_sql())
def savgol(spark, sf):
    return rounded(W.savgol(events(spark, sf), USER, ORDER, "value", 7, 2).select("user_id", "event_id", "smooth"), 5)


@query("savgol_fraction", None)
def savgol_fraction(spark, sf):
    return rounded(W.savgol_fraction(events(spark, sf), USER, ORDER, "value", 0.1, 2).select("user_id", "event_id", "smooth"), 5)


STEPS = f"""{EV}, sg AS (SELECT *, avg((value > 0)::INT) OVER (PARTITION BY user_id) AS share FROM ev),
st AS (SELECT user_id, i, n, (lead(value) OVER (PARTITION BY user_id ORDER BY i) - value) * CASE WHEN share > 0.5 THEN 1 ELSE -1 END AS d FROM sg)"""


@query("decay_start", f"""WITH {STEPS}, f AS (SELECT *, coalesce(d < 0, false) AS fall FROM st), g AS (SELECT *, sum(CASE WHEN fall AND NOT coalesce(pf, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
 FROM (SELECT *, lag(fall) OVER (PARTITION BY user_id ORDER BY i) AS pf FROM f)),
r AS (SELECT user_id, run, min(i) AS s, count(*) AS len FROM g WHERE fall GROUP BY 1, 2), a AS (SELECT user_id, max(len) AS top, count(*) AS runs, min_by(len, s) AS first_len FROM r GROUP BY 1),
p AS (SELECT r.user_id, CASE WHEN max(runs) <= 1 THEN 0 WHEN max(first_len) = max(top) THEN max(CASE WHEN len = top THEN s END) ELSE min(CASE WHEN len = top THEN s END) END AS ds FROM r JOIN a USING (user_id) GROUP BY 1)
SELECT u.user_id, coalesce(ds, 0)::BIGINT AS decay_start FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN p ON p.user_id = u.user_id""")
def decay_start(spark, sf):
    return W.decay_start(events(spark, sf), USER, ORDER, "value")


@query("first_fall", f"""WITH {EV}, s AS (SELECT user_id, i, lead(abs(value)) OVER (PARTITION BY user_id ORDER BY i) < abs(value) AS f FROM ev)
SELECT user_id, coalesce(min(CASE WHEN f THEN i END), 0)::BIGINT AS first_fall FROM s GROUP BY 1""")
def first_fall(spark, sf):
    return W.first_fall(events(spark, sf), USER, ORDER, "value")


@query("settle_limit", f"""WITH {STEPS} SELECT user_id, CASE WHEN max(n) < 3 THEN 0 ELSE coalesce(max(CASE WHEN abs(d) >= 60 THEN i END) + 1, 0) END::BIGINT AS settle_limit FROM st GROUP BY 1""")
def settle_limit(spark, sf):
    return W.settle_limit(events(spark, sf), USER, ORDER, "value", 60.0)


@query("skew_limit", f"""WITH {STEPS}, a AS (SELECT user_id, i, n, abs(d) AS a FROM st WHERE d IS NOT NULL), r AS (SELECT user_id, i, n, avg(a) OVER w / quantile_cont(a, 0.5) OVER w AS r FROM a WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
p AS (SELECT user_id, coalesce(min(CASE WHEN r < 1.3 AND i < n - 2 THEN i END), max(n) - 1)::BIGINT AS s FROM r GROUP BY 1)
SELECT u.user_id, coalesce(s, 0)::BIGINT AS skew_limit FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN p ON p.user_id = u.user_id""")
def skew_limit(spark, sf):
    return W.skew_limit(events(spark, sf), USER, ORDER, "value", 1.3)


@query("trim_voltage", f"""WITH {EV}, m AS (SELECT *, median(value) OVER (PARTITION BY user_id) AS med FROM ev), o AS (SELECT *, coalesce(abs(value / med - 1) > 0.5, false) AS bad FROM m),
l AS (SELECT *, min(CASE WHEN NOT bad THEN i END) OVER (PARTITION BY user_id) AS a, max(CASE WHEN NOT bad THEN i END) OVER (PARTITION BY user_id) AS z FROM o),
s AS (SELECT *, least(coalesce(a, n), n - 3) AS st FROM l), e AS (SELECT *, greatest(coalesce(z + 1, 0), st + 3) AS en FROM s),
k AS (SELECT * FROM e WHERE n < 5 OR (i >= st AND i < en))
SELECT user_id, event_id, round(CASE WHEN n < 5 THEN t ELSE t - min_by(t, i) OVER (PARTITION BY user_id) END, 6) AS t FROM k""")
def trim_voltage(spark, sf):
    out = W.trim_voltage(events(spark, sf), USER, ORDER, "value", "t", threshold=0.5)
    return rounded(out.select("user_id", "event_id", "t"), 6)


@query("trim_current", f"""WITH {EV}, m AS (SELECT *, median(value) OVER (PARTITION BY user_id) AS med, lag(value) OVER (PARTITION BY user_id ORDER BY i) AS p, lead(value) OVER (PARTITION BY user_id ORDER BY i) AS x FROM ev),
r AS (SELECT *, coalesce(CASE WHEN i = 0 THEN (x - value) / med ELSE (value - p) / med END > 0.25, false) AS up FROM m),
e AS (SELECT *, greatest(coalesce(max(CASE WHEN NOT up THEN i END) OVER (PARTITION BY user_id) + 1, 0), 3) AS en FROM r)
SELECT user_id, event_id, round(t, 6) AS t FROM e WHERE n < 5 OR i < en""")
def trim_current(spark, sf):
    out = CL.trim_current(events(spark, sf), USER, ORDER, "value", "t", reset_time=False)
    return rounded(out.select("user_id", "event_id", "t"), 6)


@query("grubbs_clip", None)
def grubbs_clip(spark, sf):
    df = events(spark, sf).withColumn("lv", F.log("value"))
    return CL.grubbs_clip(df, USER, ORDER, "lv").where("removed").select("user_id", "event_id", "outlier")


@query("clean_segments", None)
def clean_segments(spark, sf):
    df = events(spark, sf).withColumn("v", F.lit(2.0))
    return CL.clean_segments(df, USER, ORDER, "v", "value", "t", stable_voltage=True, check_start=True).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first_event"))


@query("ensure_unique", """WITH r AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS i FROM part)
SELECT p_partkey, CASE WHEN i > 0 THEN p_name || '_' || i ELSE p_name END AS unique_label FROM r""")
def ensure_unique(spark, sf):
    return W.ensure_unique(table(spark, sf, "part"), "p_name", ["p_partkey"]).select("p_partkey", "unique_label")


@query("rank_quantiles", """SELECT user_id, event_id, round((rank() OVER w + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0) / count(*) OVER (PARTITION BY user_id), 9) AS quantile
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value)""")
def rank_quantiles(spark, sf):
    return rounded(W.rank_quantiles(events(spark, sf), USER, "value").select("user_id", "event_id", "quantile"), 9)


@query("best_flags", """SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1)::INT::DOUBLE AS best_value,
 (row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id) = 1)::INT::DOUBLE AS best_t FROM (SELECT *, epoch_us(ts) AS t FROM events)""")
def best_flags(spark, sf):
    out = W.best_flags(events(spark, sf), USER, ["event_id"], ["value"], ["t"])
    return out.select("user_id", "event_id", "best_value", "best_t")


@query("normalise_weights", """WITH m AS (SELECT user_id, event_id, value, min(value) OVER a AS la, max(value) OVER a AS ha, min(value) OVER b AS lb, max(value) OVER b AS hb FROM events
 WINDOW a AS (PARTITION BY user_id), b AS (PARTITION BY event_type))
SELECT user_id, event_id, round((CASE WHEN ha = la THEN 0.1 ELSE least(greatest((value - la) / (ha - la), 0.1), 1) END + CASE WHEN hb = lb THEN 0.1 ELSE least(greatest((value - lb) / (hb - lb), 0.1), 1) END) / 2, 9) AS norm_weight FROM m""")
def normalise_weights(spark, sf):
    out = W.normalise_weights(events(spark, sf), "value", [["user_id"], ["event_type"]], 0.1)
    return rounded(out.select("user_id", "event_id", "norm_weight"), 9)


@query("bias_to_group", """SELECT user_id, event_id, round(pow(abs(value - 20), 0.7) * pow(avg(abs(value - 20)) OVER (PARTITION BY user_id), 0.3) * sign(value - 20), 6) AS v FROM events""")
def bias_to_group(spark, sf):
    out = W.bias_to_group(events(spark, sf).withColumn("v", F.col("value") - 20), USER, ["v"], 0.3)
    return rounded(out.select("user_id", "event_id", "v"), 6)


@query("polarity_column", "SELECT event_id, sign(value - 20)::DOUBLE AS polarity FROM events")
def polarity_column(spark, sf):
    return events(spark, sf).withColumn("v", F.col("value") - 20).select("event_id", W.polarity("v").alias("polarity"))


@query("order_by_frequency", f"""WITH r AS (SELECT user_id, event_id, value, abs(value) AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT user_id, max(m) AS top, min_by(m, pos) AS dc, max_by(m, pos) AS inf FROM r GROUP BY 1),
v AS (SELECT r.user_id, value, CASE WHEN abs(top - dc) > 1e-6 * abs(top) AND inf > dc THEN n - 1 - pos ELSE pos END AS pos, abs(top - dc) > 1e-6 * abs(top) AND inf > dc AS reversed FROM r JOIN f ON f.user_id = r.user_id)
SELECT r.user_id, r.pos, r.event_id, v.value, v.reversed FROM r JOIN v ON r.user_id = v.user_id AND r.pos = v.pos""")
def order_by_frequency(spark, sf):
    df = events(spark, sf).select("user_id", "event_id", "value")
    return W.order_by_frequency(df, USER, ["event_id"], ["value"], F.abs("value"))


@query("standard_order", "SELECT p_partkey, p_brand, p_type FROM part")
def standard_order(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return W.standard_order(df, {"p_type": "string", "p_brand": "string"}, {"p_type": ["ECONOMY", "STANDARD"]}, ["p_partkey"])


@query("sort_parameters", """WITH g AS (SELECT l_orderkey, l_linenumber, avg(l_extendedprice) AS r, avg(l_tax) AS c FROM lineitem GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY r, l_linenumber) AS k FROM g), b AS (SELECT l_orderkey, l_linenumber AS new, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM g)
SELECT a.l_orderkey, b.new AS number, round(unnest([r, c]), 6) AS value, unnest(['R', 'C']) AS role FROM a JOIN b ON a.l_orderkey = b.l_orderkey AND a.k = b.k""")
def sort_parameters(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("number")).agg(F.avg("l_extendedprice").alias("R"), F.avg("l_tax").alias("C"))
    long = g.unpivot(["l_orderkey", "number"], ["R", "C"], "role", "value")
    return rounded(W.sort_groups(long, ["l_orderkey"], "number", "R", "role").select("l_orderkey", "number", "value", "role"), 6)


@query("sort_exponentials", """WITH p AS (SELECT vec_id, list_transform(list_append(embedding, 0.5), lambda x: x::DOUBLE) AS p, len(embedding) // 2 AS n FROM embeddings),
o AS (SELECT vec_id, p, n, list_sort(list_transform(range(n), lambda i: {'tau': p[2 * i + 2], 'i': i})) AS o FROM p),
r AS (SELECT vec_id, list_concat(flatten(list_transform(o, lambda e: [p[2 * e.i + 1], p[2 * e.i + 2]])), p[2 * n + 1:]) AS v FROM o)
SELECT vec_id, unnest(range(len(v)))::INT AS pos, unnest(v) AS value FROM r""")
def sort_exponentials(spark, sf):
    """All components as pairs of amplitude and time constant, and an offset behind them."""
    p = W.sort_exponentials(F.array_append(F.col("embedding").cast("array<double>"), F.lit(0.5)))["params"]
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(p).alias("pos", "value"))


@query("downsample", f"""WITH {EV}, m AS (SELECT *, n - 1 AS len, 20 AS m0, (n - 1) / 20.0 AS raw FROM ev),
k AS (SELECT *, CASE WHEN raw < 1 THEN NULL ELSE 20 END AS m FROM m)
SELECT user_id, event_id FROM k WHERE len <= 20 OR floor(ceil(i * m / len) * len / m) = i""")
def downsample(spark, sf):
    return W.downsample(events(spark, sf), USER, ORDER, 20).select("user_id", "event_id")


@query("series_offset", f"""SELECT user_id, event_id, round(coalesce(sum(value) {OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS "offset" FROM events""")
def series_offset(spark, sf):
    return rounded(W.series_offset(events(spark, sf), USER, ORDER, "value").select("user_id", "event_id", "offset"), 6)


@query("time_axis", f"""WITH {EV}, z AS (SELECT *, t - min(t) OVER (PARTITION BY user_id) AS s FROM ev), f AS (SELECT user_id, regr_slope(s, i) AS m, corr(s, i) AS r FROM z GROUP BY 1)
SELECT z.user_id, event_id, round(CASE WHEN r >= 0.9 THEN m * i ELSE s END, 4) AS t2 FROM z JOIN f ON f.user_id = z.user_id""")
def time_axis(spark, sf):
    df = events(spark, sf).drop("t")
    return rounded(W.time_axis(df, USER, ORDER, "ts", "t2").select("user_id", "event_id", "t2"), 4)


@query("segment_rows", f"""WITH {EV}, b AS (SELECT *, sum((value > 100)::INT) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM ev)
SELECT user_id, event_id, segment, round(t - min(t) OVER (PARTITION BY user_id, segment), 6) AS t FROM b""")
def segment_rows(spark, sf):
    out = W.segment_rows(events(spark, sf), USER, ORDER, F.col("value") > 100, "t")
    return rounded(out.select("user_id", "event_id", "segment", "t"), 6)


@query("arc_points", """WITH r AS (SELECT user_id, value AS f, event_id AS re, abs(-(event_id % 97))::DOUBLE AS z, abs((event_id % 97) / (event_id * event_id + (event_id % 97) * (event_id % 97))::DOUBLE) AS y,
 row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT user_id, value, min(event_id) + 1 AS event_id FROM events GROUP BY 1, 2)),
p AS (SELECT user_id, arg_max(i, {'z': z, 'i': -i}) AS pz, arg_max(i, {'z': y, 'i': -i}) AS py, max(n) AS n FROM r GROUP BY 1),
q AS (SELECT user_id, CASE WHEN pz > 0 AND pz < n - 1 THEN pz WHEN py > 0 AND py < n - 1 THEN py ELSE 0 END AS p FROM p),
h AS (SELECT r.*, p, log10(f) AS lf, max(CASE WHEN i = p THEN z END) OVER (PARTITION BY r.user_id) / 2 AS half FROM r JOIN q ON q.user_id = r.user_id),
g AS (SELECT *, lag(lf) OVER w AS lf0, lag(z) OVER w AS z0 FROM h WINDOW w AS (PARTITION BY user_id ORDER BY i)),
x AS (SELECT *, CASE WHEN sign(z0 - half) * sign(z - half) < 0 THEN lf0 + (lf - lf0) * (half - z0) / (z - z0) END AS x FROM g)
SELECT user_id, max(CASE WHEN i = p THEN f END) AS f_peak, (2 * (max(re) - max(CASE WHEN i = p THEN re END)))::DOUBLE AS "R", round(min(CASE WHEN i > p THEN x END) - min(CASE WHEN i <= p THEN x END), 6) AS fwhm FROM x GROUP BY 1""")
def arc_points(spark, sf):
    df = events(spark, sf).groupBy("user_id", F.col("value").alias("f")).agg((F.min("event_id") + 1).cast("double").alias("re"))
    out = W.arc_points(df.withColumn("im", -(F.col("re") % 97)), USER, "f", "re", "im")
    return rounded(out.select("user_id", "f_peak", "R", "fwhm"), {"fwhm": 6})


@query("arc_minima", f"""WITH {EV}, p AS (SELECT *, -value AS m, arg_max(i, {{'m': -value, 'i': -i}}) OVER (PARTITION BY user_id) AS p FROM ev),
g AS (SELECT user_id, arg_min(event_id, {{'m': m, 'i': i}}) FILTER (i < p) AS a, arg_min(event_id, {{'m': m, 'i': i}}) FILTER (i >= p) AS b FROM p GROUP BY 1)
SELECT user_id, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN a < b THEN a ELSE b END AS low_real, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN a > b THEN a ELSE b END AS high_real FROM g""")
def arc_minima(spark, sf):
    return W.arc_minima(events(spark, sf), USER, ORDER, "event_id", "value")


@query("decade_labels", f"""WITH d AS (SELECT user_id, event_id, value, floor(log10(abs(value))) AS d, lag(floor(log10(abs(value)))) {OVER}) AS p FROM events)
SELECT user_id, event_id, coalesce(d <> p, true) OR value = 5.0 AS marked FROM d""")
def decade_labels(spark, sf):
    return W.decade_labels(events(spark, sf), USER, ORDER, "value", [5.0]).select("user_id", "event_id", "marked")


@query("linear_fill", f"""WITH {EV}, k AS (SELECT *, CASE WHEN value > 20 THEN value END AS v FROM ev),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS bv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER w AS bi, first_value(v IGNORE NULLS) OVER z AS fv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER z AS fi FROM k
 WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(coalesce(v, bv + (fv - bv) * (i - bi) / (fi - bi)::DOUBLE, bv, fv), 6) AS v FROM b""")
def linear_fill(spark, sf):
    df = events(spark, sf).withColumn("v", F.when(F.col("value") > 20, F.col("value")))
    return rounded(W.linear_fill(df, USER, ORDER, "v").select("user_id", "event_id", "v"), 6)


@query("x_intercepts", f"""WITH {EV}, p AS (SELECT *, -(value - 20) AS m, arg_max(i, {{'m': -(value - 20), 'i': -i}}) OVER (PARTITION BY user_id) AS p FROM ev),
g AS (SELECT user_id, arg_min(event_id, {{'m': m, 'i': i}}) FILTER (i < p) AS a, arg_min(event_id, {{'m': m, 'i': i}}) FILTER (i >= p) AS b FROM p GROUP BY 1),
h AS (SELECT user_id, CASE WHEN a IS NULL OR b > a THEN b ELSE a END AS hi FROM g),
r AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY i) AS e0, lag(m) OVER (PARTITION BY user_id ORDER BY i) AS m0 FROM p),
x AS (SELECT user_id, CASE WHEN sign(m0) * sign(m) < 0 THEN e0 + (event_id - e0) * (0 - m0) / (m - m0) END AS root FROM r),
n AS (SELECT x.user_id, arg_min(root, abs(root - hi)) AS near, max(hi) AS hi FROM x JOIN h ON h.user_id = x.user_id GROUP BY 1)
SELECT user_id, round(CASE WHEN abs(near - hi) <= 0.1 * abs(hi) THEN near ELSE hi END, 5) AS x_intercept FROM n""")
def x_intercepts(spark, sf):
    df = events(spark, sf).withColumn("im", F.col("value") - 20).withColumn("re", F.col("event_id").cast("double"))
    return rounded(I.x_intercepts(df, USER, ORDER, "re", "im"), 5)


# Lines of several datasets, each with a separator of its own; some begin with a header.
MIXED_LINES = """l AS (SELECT 'c' || c_nationkey AS dataset, CAST(c_custkey AS BIGINT) AS no, concat_ws(s, c_custkey, c_name, c_acctbal, c_mktsegment) AS line
  FROM (SELECT *, CASE c_nationkey % 3 WHEN 0 THEN ';' WHEN 1 THEN '|' ELSE ',' END AS s FROM customer)
  UNION ALL SELECT DISTINCT 'c' || c_nationkey, CAST(-1 AS BIGINT), concat_ws(CASE c_nationkey % 3 WHEN 0 THEN ';' WHEN 1 THEN '|' ELSE ',' END, 'key', 'name', 'balance', 'segment') FROM customer WHERE c_nationkey % 2 = 0
  UNION ALL SELECT 'd-' || lang, doc_id, concat_ws(chr(9), doc_id, lang, n_chars) FROM documents
  UNION ALL SELECT DISTINCT 'd-' || lang, CAST(-1 AS BIGINT), concat_ws(chr(9), 'id', 'lang', 'chars') FROM documents)"""


@query("parse_delimited", rf"""WITH {MIXED_LINES},
k AS (SELECT dataset, no, CASE WHEN regexp_replace(line, '[\w.+\-:"''()\[\]/%\\#]|\s', '', 'g') <> '' THEN regexp_extract_all(regexp_replace(line, '[\w.+\-:"''()\[\]/%\\#]|\s', '', 'g'), '.') ELSE regexp_extract_all(trim(line), '\s+') END AS ms FROM l),
m AS (SELECT dataset, no, unnest(ms) AS sep, unnest(range(len(ms))) AS pos FROM k),
c AS (SELECT dataset, sep, count(*) AS n, min(no) AS f, arg_min(pos, no * 1000 + pos) AS g FROM m GROUP BY 1, 2),
s AS (SELECT dataset, sep FROM c QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, f, g) = 1),
t AS (SELECT l.*, sep, string_split(line, sep) AS cells, no = min(no) OVER (PARTITION BY dataset) AS is_first FROM l JOIN s USING (dataset)),
h AS (SELECT dataset, cells AS names, len(list_filter(cells, lambda x: regexp_matches(x, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'))) = 0 AS header FROM t WHERE is_first),
x AS (SELECT dataset, no, unnest(cells) AS cell, unnest(range(len(cells))) AS position, names, header FROM t JOIN h USING (dataset) WHERE NOT (is_first AND header))
SELECT dataset, no, CAST(position AS INTEGER) AS position, CASE WHEN header THEN names[position + 1] ELSE CAST(position AS VARCHAR) END AS name, trim(cell) AS cell, TRY_CAST(cell AS DOUBLE) AS number FROM x WHERE trim(cell) <> ''""")
def parse_delimited(spark, sf):
    cust, docs = table(spark, sf, "customer"), table(spark, sf, "documents")
    mark = F.element_at(F.array(F.lit(";"), F.lit("|"), F.lit(",")), F.col("c_nationkey") % 3 + 1)
    of = F.concat(F.lit("c"), F.col("c_nationkey").cast("string"))
    joined = lambda sep, *cells: F.array_join(F.array(*[c.cast("string") for c in cells]), "\x01") if sep is None else F.concat_ws(sep, *cells)
    with_mark = lambda *cells: F.replace(joined(None, *cells), F.lit("\x01"), mark)
    lang, first = F.concat(F.lit("d-"), F.col("lang")), F.lit(-1).cast("long")
    lines = cust.select(of.alias("dataset"), F.col("c_custkey").alias("no"), with_mark(*[F.col(c) for c in ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")]).alias("line"))
    lines = lines.union(cust.where("c_nationkey % 2 = 0").select(of, first, with_mark(*map(F.lit, ("key", "name", "balance", "segment")))).distinct())
    lines = lines.union(docs.select(lang, "doc_id", joined("\t", *[F.col(c).cast("string") for c in ("doc_id", "lang", "n_chars")])))
    lines = lines.union(docs.select(lang, first, joined("\t", *map(F.lit, ("id", "lang", "chars")))).distinct())
    return S.parse_delimited(lines, ["dataset"], ["no"])


@query("split_text_blocks", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
s AS (SELECT doc_id, no, length(line) - length(replace(line, ' ', '')) AS seps FROM l WHERE trim(line) <> ''),
b AS (SELECT doc_id, no, seps, sum(CASE WHEN seps <> p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM (SELECT *, lag(seps) OVER (PARTITION BY doc_id ORDER BY no) AS p FROM s)),
z AS (SELECT doc_id, block, count(*) AS block_lines, max(seps) AS m FROM b GROUP BY 1, 2), a AS (SELECT *, avg(block_lines) OVER (PARTITION BY doc_id) AS mean, count(*) OVER (PARTITION BY doc_id) AS n FROM z)
SELECT doc_id, block, block_lines, (block_lines > mean AND m > 1) OR n = 1 AS is_data FROM a""")
def split_text_blocks(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.trim("line") != "")
    out = S.block_lines(lines, ["doc_id"], ["no"], "line", " ")
    return out.select("doc_id", "block", "block_lines", "is_data").distinct()


@query("latest_versions", """WITH m AS (SELECT o_custkey, max({'d': o_orderdate, 'p': o_totalprice}) AS m FROM orders GROUP BY 1)
SELECT orders.o_custkey, o_orderkey FROM orders JOIN m ON m.o_custkey = orders.o_custkey WHERE {'d': o_orderdate, 'p': o_totalprice} = m.m""")
def latest_versions(spark, sf):
    return S.latest_versions(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_totalprice"]).select("o_custkey", "o_orderkey")


@query("combine_signals", """SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, round(avg(value), 6) AS value, count(*) AS readings, round(avg(value) FILTER (event_type = 'click'), 6) AS click_mean,
 round(avg(value) FILTER (event_type = 'view'), 6) AS view_mean FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2""")
def combine_signals(spark, sf):
    out = X.combine_signals(events(spark, sf), USER, "ts", "event_type", "value", ["click", "view"], "1 day")
    return rounded(out, 6)


@query("calm_stretches", f"""WITH {EV}, s AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY i) AS p FROM ev), g AS (SELECT *, sum(CASE WHEN abs(value - p) > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS stretch FROM s)
SELECT user_id, stretch, count(*) AS readings, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS seconds, round(max(value) - min(value), 6) AS "range", max(t) - min(t) >= 100000 AND max(value) - min(value) <= 30 AS stable FROM g GROUP BY 1, 2""")
def calm_stretches(spark, sf):
    out = X.calm_stretches(events(spark, sf), USER, ORDER, "ts", "value", 30.0, 100000.0)
    return rounded(out, {"range": 6})


@query("stability_rule", f"""WITH RECURSIVE {EV}, e AS MATERIALIZED (SELECT user_id, event_id, i, epoch_us(ts) / 1e6 AS s, value AS v FROM ev),
r(user_id, event_id, i, v, elapsed, spread, tol, here, stable, since, low, high, kept, began, step) AS (
  SELECT user_id, event_id, i, v, 0.0::DOUBLE, 0.0::DOUBLE, 12.0::DOUBLE, 0::BIGINT, false, s, v, v, v, s, 0::BIGINT FROM e WHERE i = 0
  UNION ALL SELECT user_id, event_id, i, v, elapsed, spread, tol, step, ok, CASE WHEN ok THEN s ELSE since END, CASE WHEN ok THEN v ELSE low END, CASE WHEN ok THEN v ELSE high END,
    CASE WHEN ok THEN v ELSE kept END, CASE WHEN ok THEN s ELSE began END, step + ok::BIGINT
  FROM (SELECT *, s - since AS elapsed, s - since >= 60000 AS ok
    FROM (SELECT user_id, event_id, i, v, s, spread, kept, began, step, CASE WHEN spread > tol AND s - began > 150000 THEN least(spread, 2 * tol) ELSE tol END AS tol,
        CASE WHEN spread > tol THEN s ELSE since END AS since, CASE WHEN spread > tol THEN kept ELSE low END AS low, CASE WHEN spread > tol THEN kept ELSE high END AS high
      FROM (SELECT e.*, r.tol, r.since, r.began, r.step, CASE WHEN e.v >= 1 THEN least(low, e.v) ELSE low END AS low, CASE WHEN e.v >= 1 THEN greatest(high, e.v) ELSE high END AS high,
          CASE WHEN e.v >= 1 THEN e.v ELSE kept END AS kept, CASE WHEN e.v >= 1 THEN greatest(high, e.v) - least(low, e.v) ELSE high - low END AS spread
        FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))))
SELECT user_id, event_id, round(v, 6) AS value, round(elapsed, 3) AS elapsed, round(spread, 6) AS spread, round(tol, 6) AS tol, here AS step, stable FROM r""")
def stability_rule(spark, sf):
    out = X.stability_batch(events(spark, sf), USER, ORDER, "ts", "value", 12.0, 60000.0, 150000.0, floor=1.0).drop("ts")
    return rounded(out, {"value": 6, "elapsed": 3, "spread": 6, "tol": 6})


@query("reading_limits", "SELECT event_id, value FROM events WHERE value >= 5 AND value <= 100")
def reading_limits(spark, sf):
    return X.within_limits(events(spark, sf), "value", 5, 100).select("event_id", "value")
