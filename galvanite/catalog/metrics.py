"""Error metrics: true = quantity, predicted = 51 - 500 * discount, weight = tax."""

from pyspark.sql import functions as F

from galvanite.catalog.base import FLAGS, query, rounded, table
from galvanite.operators import metrics as M

BASE = """b AS (SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_quantity AS t, 20 + 100 * l_discount AS p, l_tax AS w FROM lineitem),
n AS (SELECT *, w * count(*) OVER g / sum(w) OVER g AS wn, sum(w * t) OVER g / sum(w) OVER g AS mean FROM b WINDOW g AS (PARTITION BY l_returnflag, l_linestatus))"""

EXPR = {
    "r2_score": "1 - sum(wn * (t - p) * (t - p)) / sum(wn * (t - mean) * (t - mean))",
    "mean_abs_err": "sum(w * abs(t - p)) / sum(w)",
    "total_abs_err": "sum(wn * abs(t - p))",
    "mean_squared_err": "sum(w * (t - p) * (t - p)) / sum(w)",
    "total_squared_err": "sum(wn * (t - p) * (t - p))",
    "root_mean_squared_err": "sqrt(sum(w * (t - p) * (t - p)) / sum(w))",
    "root_mean_abs_err": "sqrt(sum(w * abs(t - p)) / sum(w))",
    "mean_abs_perc_err": "sum(w * abs(t - p) / abs(t)) / sum(w)",
    "total_abs_perc_err": "sum(wn * abs(t - p) / abs(t))",
    "mean_log_error": "sum(w * (ln(1 + t) - ln(1 + p))) / sum(w)",
    "total_log_error": "sum(wn * (ln(1 + t) - ln(1 + p)))",
    "mean_squared_log_error": "sum(w * pow(ln(1 + t) - ln(1 + p), 2)) / sum(w)",
    "total_squared_log_error": "sum(wn * pow(ln(1 + t) - ln(1 + p), 2))",
    "mean_log10_error": "sum(w * (log10(1 + t) - log10(1 + p))) / sum(w)",
    "total_log10_error": "sum(wn * (log10(1 + t) - log10(1 + p)))",
    "mean_squared_log10_error": "sum(w * pow(log10(1 + t) - log10(1 + p), 2)) / sum(w)",
    "total_squared_log10_error": "sum(wn * pow(log10(1 + t) - log10(1 + p), 2))",
    "mean_poisson_dev": "sum(w * 2 * (t * ln(t / p) + p - t)) / sum(w)",
    "mean_gamma_dev": "sum(w * 2 * (ln(p / t) + t / p - 1)) / sum(w)",
}


def rows(spark, sf):
    return table(spark, sf, "lineitem").select(
        *FLAGS, "l_orderkey", "l_linenumber", F.col("l_quantity").alias("t"), (20 + 100 * F.col("l_discount")).alias("p"), F.col("l_tax").alias("w"))


def _register(name: str, expr: str) -> None:
    digits = 3 if name.startswith("total") else 6

    @query(name, f"WITH {BASE} SELECT l_returnflag, l_linestatus, round({expr}, {digits}) AS {name} FROM n GROUP BY 1, 2")
    def run(spark, sf):
        return rounded(M.error_metrics(rows(spark, sf), FLAGS, "t", "p", "w", [name]), digits)


for _name, _expr in EXPR.items():
    _register(_name, _expr)


@query("median_abs_err", """WITH s AS (SELECT l_returnflag, l_linestatus, abs(l_quantity - (20 + 100 * l_discount)) AS e, sum(l_tax) AS w FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY e) AS cum, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus) AS tot FROM s)
SELECT l_returnflag, l_linestatus, round(min(CASE WHEN cum >= tot / 2 THEN e END), 6) AS median_abs_err FROM c GROUP BY 1, 2""")
def median_abs_err(spark, sf):
    return rounded(M.median_abs_err(rows(spark, sf), FLAGS, "t", "p", "w"), 6)


ROWS = {
    "residuals": "(t - p) * wn", "squared_err": "(t - p) * (t - p) * wn", "abs_err": "abs(t - p) * wn", "max_err": "abs(t - p) * wn",
    "abs_perc_err": "abs(t - p) / abs(t) * wn", "log_error": "(ln(1 + t) - ln(1 + p)) * wn", "squared_log_error": "pow(ln(1 + t) - ln(1 + p), 2) * wn",
    "log10_error": "(log10(1 + t) - log10(1 + p)) * wn", "squared_log10_error": "pow(log10(1 + t) - log10(1 + p), 2) * wn",
}


@query("row_errors", f"WITH {BASE} SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in ROWS.items()) + " FROM n")
def row_errors(spark, sf):
    out = M.row_errors(rows(spark, sf), FLAGS, "t", "p", "w", list(ROWS))
    return rounded(out.select("l_orderkey", "l_linenumber", *ROWS), 6)


@query("z_scores", """WITH b AS (SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_quantity - (20 + 100 * l_discount) AS e, l_tax AS w FROM lineitem),
m AS (SELECT *, sum(w * e) OVER g / sum(w) OVER g AS mu FROM b WINDOW g AS (PARTITION BY l_returnflag, l_linestatus)),
s AS (SELECT *, sqrt(sum(w * (e - mu) * (e - mu)) OVER g / sum(w) OVER g) AS sd FROM m WINDOW g AS (PARTITION BY l_returnflag, l_linestatus))
SELECT l_orderkey, l_linenumber, round((e - mu) / sd, 6) AS z_scores, round(abs((e - mu) / sd), 6) AS abs_z_scores FROM s""")
def z_scores(spark, sf):
    out = M.row_errors(rows(spark, sf), FLAGS, "t", "p", "w", ["z_scores", "abs_z_scores"])
    return rounded(out.select("l_orderkey", "l_linenumber", "z_scores", "abs_z_scores"), 6)


@query("mod_z_scores", """WITH m AS (SELECT user_id, event_id, value, median(value) OVER (PARTITION BY user_id) AS med FROM events),
d AS (SELECT *, abs(value - med) AS dev FROM m), a AS (SELECT *, median(dev) OVER (PARTITION BY user_id) AS mad FROM d)
SELECT user_id, event_id, round(CASE WHEN mad = 0 THEN 0 ELSE 0.6744897501960817 * (value - med) / mad END, 6) AS mod_z FROM a""")
def mod_z_scores(spark, sf):
    out = M.modified_z_scores(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "value")
    return rounded(out.select("user_id", "event_id", "mod_z"), 6)


@query("dataset_error", """WITH d AS (SELECT l_returnflag, l_quantity AS f, avg(l_extendedprice) AS re, avg(l_tax) AS im FROM lineitem GROUP BY 1, 2),
u AS (SELECT l_returnflag, unnest([re, im]) AS t, unnest([re * 1.1, im * 0.8]) AS p FROM d WHERE f BETWEEN 2 AND 40)
SELECT l_returnflag, round(avg(abs(t - p) / abs(t)), 6) AS mean_abs_perc_err FROM u GROUP BY 1""")
def dataset_error(spark, sf):
    data = table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_quantity").alias("f")).agg(
        F.avg("l_extendedprice").alias("re"), F.avg("l_tax").alias("im"))
    model = data.select("l_returnflag", "f", (F.col("re") * 1.1).alias("re"), (F.col("im") * 0.8).alias("im"))
    return rounded(M.dataset_error(data, model, ["l_returnflag"], "f", ["re", "im"], "mean_abs_perc_err", (2, 40)), 6)


@query("param_error_propagation", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * sqrt(coalesce(pow(l_discount / l_quantity, 2), 0) + pow(l_tax / l_extendedprice, 2)), 10) AS err FROM lineitem""")
def param_error_propagation(spark, sf):
    return rounded(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", M.propagated_error("l_extendedprice", [("l_quantity", "l_discount"), ("l_extendedprice", "l_tax")]).alias("err")), 10)


@query("aicc", """WITH s AS (SELECT l_returnflag, l_linestatus, sum(pow(l_quantity - (20 + 100 * l_discount), 2)) AS rss, regr_syy(l_quantity, l_quantity) AS tss, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, round(rss, 2) AS rss, round(tss, 2) AS tss, n, round(1 - rss / tss, 8) AS r2, round(n * ln(rss / n) + 4 + 12.0 / (n - 3), 4) AS aicc FROM s""")
def aicc(spark, sf):
    out = M.sums_of_squares(rows(spark, sf), FLAGS, "t", "p").withColumn("aicc", M.aicc(F.col("rss"), F.col("n"), 2))
    return rounded(out, {"rss": 2, "tss": 2, "r2": 8, "aicc": 4})
