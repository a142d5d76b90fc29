"""Joins, lookups, merges and set operations on the given tables."""

from pyspark.sql import functions as F

from galvanite.catalog.base import ORDER, USER, events, query, rounded, table
from galvanite.keyed import attach
from galvanite.operators import joins as J
from galvanite.operators import select as P


@query("attach_attributes", """SELECT o_orderkey, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def attach_attributes(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.format_string("Customer#%09d", "o_custkey").alias("name"))
    cust = table(spark, sf, "customer").select(F.upper("c_name").alias("name"), "c_mktsegment", "c_nationkey")
    return J.attach_attributes(orders, cust, "name").select("o_orderkey", "c_mktsegment", "c_nationkey")


@query("combine_fit_attrs", """SELECT coalesce(c_nationkey, s_nationkey) AS nation, customers, suppliers, round(coalesce(bal, sbal), 4) AS bal
FROM (SELECT c_nationkey, count(*) AS customers, avg(c_acctbal) AS bal FROM customer WHERE c_nationkey < 20 GROUP BY 1) a
FULL JOIN (SELECT s_nationkey, count(*) AS suppliers, avg(s_acctbal) AS sbal FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON c_nationkey = s_nationkey""")
def combine_fit_attrs(spark, sf):
    a = table(spark, sf, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"), F.avg("c_acctbal").alias("bal"))
    b = table(spark, sf, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"), F.avg("s_acctbal").alias("bal"))
    return rounded(J.combine_fit_attrs(a, b, "nation", ["bal"]), 4)


@query("align_datasets", """WITH e AS (SELECT vec_id, label, embedding FROM embeddings)
SELECT label, vec_id, pos - 1 AS row_idx, v AS value FROM (SELECT label, vec_id, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS v FROM e)""")
def align_datasets(spark, sf):
    out = J.align_arrays(table(spark, sf, "embeddings"), ["label"], "vec_id", "embedding", "common", 3)
    return out.withColumn("row_idx", F.col("row_idx").cast("long"))


@query("align_columns", """SELECT label, pos - 1 AS row_idx, max(CASE WHEN half = 0 THEN v END) AS even, max(CASE WHEN half = 1 THEN v END) AS odd
FROM (SELECT label, vec_id % 2 AS half, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2""")
def align_columns(spark, sf):
    df = table(spark, sf, "embeddings").withColumn("side", F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd"))
    long = J.align_arrays(df, ["label"], "side", "embedding", "all")
    return J.align_columns(long, ["label"], "side", ["even", "odd"]).withColumn("row_idx", F.col("row_idx").cast("long"))


@query("map_channels", """SELECT user_id, event_id, max(CASE WHEN event_type = 'click' THEN value END) AS voltage, max(CASE WHEN event_type = 'view' THEN value * 0.001 END) AS current FROM events GROUP BY 1, 2""")
def map_channels(spark, sf):
    ev = events(spark, sf)
    channels = ev.select("user_id", F.col("event_type").alias("raw_channel")).distinct()
    mapping = channels.where(F.col("raw_channel").isin("click", "view")).withColumn(
        "std_channel", F.when(F.col("raw_channel") == "click", "voltage").otherwise("current")).withColumn("multiplier", F.when(F.col("raw_channel") == "view", 0.001))
    return J.map_channels(ev.withColumnRenamed("event_type", "channel"), mapping, USER, ["event_id"], ["voltage", "current"])


@query("condition_deltas", """WITH r AS (SELECT l_suppkey AS k, l_returnflag AS c, l_extendedprice AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS n FROM lineitem
 WINDOW w AS (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
b AS (SELECT k, v AS b FROM r WHERE c = 'A' AND i = 0), s AS (SELECT k, c, max(n) AS n FROM r GROUP BY 1, 2),
p AS (SELECT a.k, a.c AS c1, z.c AS c2, a.n AS na, z.n AS nz, unnest(range(greatest(a.n, z.n))) AS pos FROM s a JOIN s z ON a.k = z.k AND a.c < z.c)
SELECT p.k AS l_suppkey, c1 || '-' || c2 AS l_returnflag, pos AS position, round((x.v - y.v) / b, 8) AS l_extendedprice FROM p JOIN r x ON x.k = p.k AND x.c = c1 AND x.i = pos % na JOIN r y ON y.k = p.k AND y.c = c2 AND y.i = pos % nz LEFT JOIN b ON b.k = p.k""")
def condition_deltas(spark, sf):
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    out = J.condition_deltas(df, ["l_suppkey"], "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], ["l_extendedprice"], base="A", conditions=("A", "N", "R"))
    return rounded(out, {"l_extendedprice": 8})


@query("complete_grid", """WITH g AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS bal FROM customer WHERE c_nationkey % 3 <> 0 OR c_mktsegment <> 'BUILDING' GROUP BY 1, 2),
n AS (SELECT c_nationkey FROM g GROUP BY 1 HAVING count(DISTINCT c_mktsegment) >= 2),
w AS (SELECT c_nationkey, unnest(['BUILDING', 'MACHINERY', 'FURNITURE']) AS c_mktsegment FROM n)
SELECT c_nationkey, c_mktsegment, round(bal, 4) AS bal FROM g UNION ALL SELECT w.c_nationkey, w.c_mktsegment, NULL FROM w ANTI JOIN g ON g.c_nationkey = w.c_nationkey AND g.c_mktsegment = w.c_mktsegment""")
def complete_grid(spark, sf):
    g = table(spark, sf, "customer").where("c_nationkey % 3 <> 0 OR c_mktsegment <> 'BUILDING'").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("bal"))
    return rounded(J.complete_grid(g, ["c_nationkey"], "c_mktsegment", ["BUILDING", "MACHINERY", "FURNITURE"]), 4)


@query("conditional_update", """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def conditional_update(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    source = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit("big").alias("o_orderstatus"))
    return J.conditional_update(orders, source, ["o_orderkey"], ["o_orderstatus"], "o_totalprice > 200000")


@query("upsert_rows", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT o_custkey, o_orderkey, o_totalprice * 2 FROM orders WHERE o_orderstatus = 'P'""")
def upsert_rows(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    new = orders.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return J.upsert(orders.drop("o_orderstatus"), new, ["o_custkey"])


@query("nearest_lookup", """WITH t AS (SELECT unnest([5.0, 50.0, 1000.0])::DOUBLE AS target), m AS (SELECT user_id, max(value) AS mx FROM events GROUP BY 1),
d AS (SELECT e.user_id, target, value, event_id, row_number() OVER (PARTITION BY e.user_id, target ORDER BY CASE WHEN mx >= target THEN CASE WHEN value >= target THEN 0 ELSE 1 END ELSE 0 END,
 CASE WHEN mx >= target THEN value ELSE abs(value - target) END, event_id) AS r FROM events e, t, m WHERE m.user_id = e.user_id)
SELECT user_id, target, value, event_id FROM d WHERE r = 1""")
def nearest_lookup(spark, sf):
    return J.nearest_rows(events(spark, sf), USER, ["value", "event_id"], "value", [5.0, 50.0, 1000.0], ["event_id"])


@query("nearest_value", """WITH t AS (SELECT unnest([5.0, 50.0])::DOUBLE AS target), d AS (SELECT user_id, target, value, event_id, row_number() OVER (PARTITION BY user_id, target ORDER BY abs(value - target), ts, event_id) AS r FROM events, t)
SELECT user_id, target, value, event_id FROM d WHERE r = 1""")
def nearest_value(spark, sf):
    return J.nearest_rows(events(spark, sf), USER, ORDER, "value", [5.0, 50.0], ["event_id"], "nearest")


@query("asof_values", """SELECT a.event_id, b.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_values(spark, sf):
    ev = events(spark, sf)
    got = J.asof_join(ev.where("event_type = 'purchase'"), ev.where("event_type = 'view'"), USER, "ts", ["value"], "event_id")
    return got.select("event_id", "asof_value")


@query("fuzzy_names", """WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT unnest(['red ring', 'large widget', 'small bolt']) AS target),
s AS (SELECT p_name, target, 1 - levenshtein(lower(p_name), lower(target)) / greatest(length(p_name), length(target), 1)::DOUBLE AS score FROM n, t),
r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, target) AS r FROM s) SELECT p_name, target, round(score, 9) AS score FROM r WHERE r = 1 AND score >= 0.2""")
def fuzzy_names(spark, sf):
    return rounded(J.fuzzy_names(table(spark, sf, "part"), "p_name", ["red ring", "large widget", "small bolt"]), 9)


@query("semi_anti_split", """SELECT 'accepted' AS side, user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING avg(value) > 20)
UNION ALL SELECT 'rejected', user_id, event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING avg(value) > 20)""")
def semi_anti_split(spark, sf):
    ev = events(spark, sf).select("user_id", "event_id", "value")
    verdict = ev.groupBy("user_id").agg((F.avg("value") > 20).alias("accepted"))
    good, bad = J.split_by_verdict(ev, verdict, USER)
    return good.select(F.lit("accepted").alias("side"), "user_id", "event_id").unionByName(bad.select(F.lit("rejected").alias("side"), "user_id", "event_id"))


@query("curve_param_join", """SELECT o_custkey, coalesce(max(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN o_totalprice END), max(CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN o_totalprice END)) AS urgent
FROM orders GROUP BY 1""")
def curve_param_join(spark, sf):
    orders = table(spark, sf, "orders")
    top = orders.groupBy("o_custkey", F.col("o_orderstatus").alias("fit"), F.col("o_orderpriority").alias("channel")).agg(F.max("o_totalprice").alias("params"))
    segs = orders.select("o_custkey").distinct()
    out = J.curve_params(segs, top.withColumn("equation", F.lit("exp")), ["o_custkey"], "F", "O", ["1-URGENT"])
    return out.select("o_custkey", F.col("`1-URGENT_params`").alias("urgent"))


@query("dedupe_versions", """WITH g AS (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS versions, max(doc_id) OVER (PARTITION BY text) AS m FROM documents)
SELECT doc_id, versions, doc_id = m AS is_active FROM g""")
def dedupe_versions(spark, sf):
    out = J.dedupe_versions(table(spark, sf, "documents"), [F.col("text")], [F.col("doc_id")])
    return out.select("doc_id", "versions", "is_active")


@query("merge_unique_groups", """WITH v AS (SELECT p_brand, p_type, min(p_type) OVER (PARTITION BY p_brand) <> max(p_type) OVER (PARTITION BY p_brand) AS v1, (SELECT min(p_brand) <> max(p_brand) FROM part) AS v0, p_partkey FROM part)
SELECT p_partkey, concat_ws('/', CASE WHEN v0 THEN p_brand END, CASE WHEN v1 THEN p_type END) AS path FROM v""")
def merge_unique_groups(spark, sf):
    df = table(spark, sf, "part").select("p_brand", "p_type", "p_partkey")
    return J.merge_unique_groups(df, ["p_brand", "p_type"]).select("p_partkey", "path")


@query("flip_levels", """SELECT p_partkey, p_type || '/' || p_brand AS flipped, p_brand AS short FROM part""")
def flip_levels(spark, sf):
    path = F.concat_ws("/", "p_brand", "p_type")
    return table(spark, sf, "part").select("p_partkey", J.flip_levels(path, 0, 1).alias("flipped"), J.truncate_path(path, 1).alias("short"))


@query("fill_from_reference", """WITH r AS (SELECT c_mktsegment, avg(c_acctbal) AS v FROM customer GROUP BY 1), f AS (SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, v) AS value FROM customer JOIN r USING (c_mktsegment))
SELECT c_custkey, round(value, 4) AS value, round(value * 0.1, 4) AS bnd_low FROM f""")
def fill_from_reference(spark, sf):
    cust = table(spark, sf, "customer")
    ref = cust.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("value"))
    df = cust.select("c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("value"), F.lit(None).cast("double").alias("bnd_low"))
    return rounded(J.fill_from_reference(df, ref, ["c_mktsegment"]).select("c_custkey", "value", "bnd_low"), 4)


@query("metadata_precedence", """SELECT doc_id, coalesce(toxic, quality, 7)::INT AS flag FROM documents LEFT JOIN labels USING (doc_id)""")
def metadata_precedence(spark, sf):
    both = attach(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])
    return both.select("doc_id", J.metadata_precedence(F.col("toxic"), F.col("quality"), F.lit(7)).cast("int").alias("flag"))


@query("union_datasets", """SELECT 'a' AS dataset, user_id, value, NULL::VARCHAR AS event_type FROM events WHERE value < 10 UNION ALL SELECT 'b', user_id, value, event_type FROM events WHERE value >= 10""")
def union_datasets(spark, sf):
    ev = events(spark, sf)
    return J.union_datasets({"a": ev.where("value < 10").select("user_id", "value"), "b": ev.where("value >= 10").select("user_id", "value", "event_type")}, sort=["value"])


@query("union_keep_first", """SELECT user_id, event_id, 0 AS source FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id, 1 FROM events e WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click')""")
def union_keep_first(spark, sf):
    ev = events(spark, sf).select("user_id", "event_id", "event_type")
    a = ev.where("event_type = 'click'").select("user_id", "event_id", F.lit(0).alias("source"))
    b = ev.where("event_type = 'view'").select("user_id", "event_id", F.lit(1).alias("source"))
    return J.union_keep_first(a, b, USER)


@query("key_set_ops", """SELECT 'common' AS kind, user_id FROM (SELECT user_id FROM events WHERE value > 150 INTERSECT SELECT user_id FROM events WHERE value < 0.5)
UNION ALL SELECT 'missing', user_id FROM (SELECT user_id FROM events WHERE value > 150 EXCEPT SELECT user_id FROM events WHERE value < 0.5)""")
def key_set_ops(spark, sf):
    ev = events(spark, sf)
    a, b = ev.where("value > 150"), ev.where("value < 0.5")
    return J.common_keys(a, b, USER).select(F.lit("common").alias("kind"), "user_id").unionByName(J.missing_keys(a, b, USER).select(F.lit("missing").alias("kind"), "user_id"))
