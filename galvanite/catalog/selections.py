"""Projections, filters and predicates on the given tables."""

from pyspark.sql import functions as F

from galvanite.catalog.base import EV, FLAGS, USER, events, query, rounded, table
from galvanite.functions import text as X
from galvanite.functions.forms import with_forms
from galvanite.operators import select as P


@query("select_fuzzy", """SELECT p_brand AS dataset_id, 'Blue bolt' AS target, arg_min("column", {'t': tier, 'r': -r, 'c': "column"}) AS "column" FROM (
SELECT DISTINCT p_brand, p_name AS "column", r, CASE WHEN p_name = 'Blue bolt' THEN 0 WHEN lower(p_name) = 'blue bolt' THEN 1 WHEN r >= 0.6 THEN 2 WHEN r >= 0.5 THEN 3 WHEN r >= 0.4 THEN 4 WHEN r >= 0.3 THEN 5 WHEN r >= 0.2 THEN 6 END AS tier
FROM (SELECT *, 1 - levenshtein(lower(p_name), 'blue bolt') / greatest(length(p_name), 9)::DOUBLE AS r FROM part)) WHERE tier IS NOT NULL GROUP BY 1""")
def select_fuzzy(spark, sf):
    cols = table(spark, sf, "part").select(F.col("p_brand").alias("dataset_id"), F.col("p_name").alias("column"))
    return P.select_fuzzy(cols, ["Blue bolt"]).select("dataset_id", "target", "column")


@query("rename_merge", """SELECT o_orderkey AS id, coalesce(CASE WHEN o_totalprice > 200000 THEN o_orderpriority END, o_orderstatus) AS label FROM orders""")
def rename_merge(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, F.col("o_orderpriority")).alias("a"), "o_orderstatus")
    return P.rename_merge(df, {"o_orderkey": "id", "a": "label", "o_orderstatus": "label"})


@query("drop_duplicate_columns", "SELECT l_orderkey, l_quantity, l_tax FROM lineitem")
def drop_duplicate_columns(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", F.col("l_quantity").alias("again"), "l_tax")
    return P.drop_duplicate_columns(df)


@query("key_counts", """SELECT count(DISTINCT l_returnflag) AS l_returnflag, count(DISTINCT l_linestatus) AS l_linestatus, count(DISTINCT l_linenumber) AS l_linenumber,
 (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem)) AS key FROM lineitem""")
def key_counts(spark, sf):
    return P.key_counts(table(spark, sf, "lineitem"), [*FLAGS, "l_linenumber"])


@query("flatten_names", "SELECT l_orderkey AS \"k.a\", l_linenumber AS \"k.b\", l_returnflag || '_' || l_linestatus AS name FROM lineitem")
def flatten_names(spark, sf):
    df = table(spark, sf, "lineitem").select(F.struct(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b")).alias("k"), P.flatten_keys(FLAGS).alias("name"))
    return P.flatten_columns(df)


@query("manage_dataframe", "SELECT doc_id AS id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def manage_dataframe(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return P.manage(df, ["doc_id", "quality", "toxic"], {"doc_id": "id"})


@query("band_filter", "SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 60")
def band_filter(spark, sf):
    return P.band_filter(events(spark, sf), "value", 10, 60).select("event_id", "value")


@query("regex_predicate", """SELECT doc_id FROM documents WHERE regexp_matches(text, 'the', 'is') AND (regexp_matches(text, 'ing', 'is') OR regexp_matches(text, 'est', 'is')) AND NOT regexp_matches(text, 'zzz|license', 'is')""")
def regex_predicate(spark, sf):
    cond = X.search(F.col("text"), ["the", "ing|est"], reject=["not zzz|license"])
    return table(spark, sf, "documents").where(cond).select("doc_id")


@query("search_pattern", """SELECT doc_id FROM documents WHERE regexp_matches(text, 'the', 'is') AND NOT regexp_matches(text, 'license', 'is')""")
def search_pattern(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").rlike(X.search_pattern(["the", "not license"]))).select("doc_id")


@query("route_groups", """SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'red', 'i') AND regexp_matches(p_name, 'ring', 'i') THEN 'red rings' WHEN regexp_matches(p_name, 'widget|bolt', 'i') THEN 'parts' ELSE 'residuals' END AS grp FROM part""")
def route_groups(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.route(F.col("p_name"), {"red rings": ["red", "ring"], "parts": "widget|bolt"}).alias("grp"))


@query("key_selection", """SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red') OR (contains(lower(p_name), 'ring') AND contains(lower(p_type), 'eco'))""")
def key_selection(spark, sf):
    keys = ["p_name", "p_type"]
    return table(spark, sf, "part").where(P.select_keys(keys, ["red"]) | P.select_any_of(keys, [["ring", "eco"]])).select("p_partkey")


@query("expr_target", """SELECT event_id FROM events WHERE value > (SELECT median(value) FROM events) AND value < (SELECT avg(value) + 2 * stddev_samp(value) FROM events)""")
def expr_target(spark, sf):
    return P.target_rows(events(spark, sf), "value > @median(value) AND value < @mean(value) + 2 * @std(value)").select("event_id")


@query("null_and_value_drop", """SELECT DISTINCT q, t FROM (SELECT CASE WHEN l_quantity NOT IN (1, 2) THEN l_quantity END AS q, CASE WHEN l_tax NOT IN (1, 2) THEN l_tax END AS t FROM lineitem) WHERE q IS NOT NULL OR t IS NOT NULL""")
def null_and_value_drop(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"))
    return P.drop_nulls_and_values(df, [1.0, 2.0], "all", unique=True)


@query("untranspose", """WITH g AS (SELECT user_id, event_type, min(value) AS a, avg(value) AS b, max(value) AS c FROM events GROUP BY 1, 2),
u AS (SELECT user_id, event_type, unnest([0, 1, 2]) AS point, unnest([a, b, c]) AS v FROM g)
SELECT user_id, point, round(max(CASE WHEN event_type = 'click' THEN v END), 6) AS click, round(max(CASE WHEN event_type = 'view' THEN v END), 6) AS view FROM u GROUP BY 1, 2
HAVING coalesce(max(CASE WHEN event_type = 'click' THEN v END), 0) <> 0 OR coalesce(max(CASE WHEN event_type = 'view' THEN v END), 0) <> 0""")
def untranspose(spark, sf):
    g = events(spark, sf).groupBy("user_id", "event_type").agg(F.min("value").alias("a"), F.avg("value").alias("b"), F.max("value").alias("c"))
    out = P.untranspose(g, USER, "event_type", ["a", "b", "c"], ["click", "view"])
    return rounded(out.withColumn("point", F.col("point").cast("int")), 6)


@query("with_forms", """WITH z AS (SELECT event_id, value AS f, value AS re, -value / 2 AS im FROM events)
SELECT event_id, round(sqrt(re * re + im * im), 6) AS mag, round(log10(sqrt(re * re + im * im)), 8) AS log_mag, round(re / (re * re + im * im) * 2, 8) AS twice_y FROM z""")
def forms(spark, sf):
    df = events(spark, sf).withColumn("im", -F.col("value") / 2)
    out = with_forms(df, "value", "value", "im", {"mag": "Z.mag", "log_mag": "log10(Z.mag)", "twice_y": "Y.real * 2"})
    return rounded(out.select("event_id", "mag", "log_mag", "twice_y"), {"mag": 6, "log_mag": 8, "twice_y": 8}, products=True)


@query("drop_exclusive_runs", "SELECT p_partkey FROM part WHERE NOT (contains(p_brand || '_' || p_type, 'Brand#1') OR contains(p_brand || '_' || p_type, 'ECO'))")
def drop_exclusive_runs(spark, sf):
    return P.drop_by_text(table(spark, sf, "part"), ["p_brand", "p_type"], ["Brand#1", "ECO"]).select("p_partkey")


@query("params_long", """SELECT l_orderkey, l_linenumber, unnest(['R0', 'C0', 'L0']) AS param, unnest([l_quantity, l_tax, NULL]) AS "values", unnest([l_discount, NULL, NULL]) AS std FROM lineitem""")
def params_long(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("R0_values"), F.col("l_discount").alias("R0_std"), F.col("l_tax").alias("C0_values"))
    return P.params_long(df, ["l_orderkey", "l_linenumber"], ["R0", "C0", "L0"])


@query("params_wide", """SELECT l_orderkey, l_linenumber, max(l_quantity) AS "R0_values", max(l_discount) AS "R0_std" FROM lineitem GROUP BY 1, 2""")
def params_wide(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit("R0").alias("param"), F.col("l_quantity").alias("values"), F.col("l_discount").alias("std"))
    return P.params_wide(df, ["l_orderkey", "l_linenumber"], ["R0"])


@query("drop_empty_columns", "SELECT l_orderkey, l_tax AS \"C0_values\" FROM lineitem")
def drop_empty_columns(spark, sf):
    nothing = F.lit(None).cast("double")
    df = table(spark, sf, "lineitem").select("l_orderkey", nothing.alias("R0_values"), F.col("l_discount").alias("R0_std"), F.col("l_tax").alias("C0_values"))
    return P.drop_empty_columns(df, {"R0_values": ["R0_std"], "C0_values": []})


@query("rename_from_attribute", """WITH n AS (SELECT c_custkey, coalesce(a, c_custkey::VARCHAR) AS name FROM customer LEFT JOIN (SELECT c_custkey, c_mktsegment AS a FROM customer WHERE c_acctbal > 0) USING (c_custkey)),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY c_custkey) - 1 AS i FROM n) SELECT c_custkey, CASE WHEN i > 0 THEN name || '_' || i ELSE name END AS new_name FROM r""")
def rename_from_attribute(spark, sf):
    cust = table(spark, sf, "customer")
    attrs = cust.where("c_acctbal > 0").select("c_custkey", F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value"))
    return P.rename_from_attribute(cust, attrs, "c_custkey", "segment")
