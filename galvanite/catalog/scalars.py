"""Column functions on the given tables."""

from pyspark.sql import functions as F

from galvanite.catalog.base import EV, FLAGS, USER, events, query, round_product, rounded, significant_digits, table
from galvanite.functions import circuits as C
from galvanite.functions import forms as M
from galvanite.functions import standard as D
from galvanite.functions import text as X
from galvanite.functions import units as U
from galvanite.functions.complexnum import Cx

# Complex pair used below: re = extended price, im = -1000 * tax, f = quantity.
ZSQL = "SELECT l_orderkey, l_linenumber, l_quantity AS f, l_extendedprice AS re, -1000 * l_tax AS im FROM lineitem"


def z_rows(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("f"), F.col("l_extendedprice").alias("re"), (-1000 * F.col("l_tax")).alias("im"))


def scaled(col, factor: float, digits: int = 6):
    return round_product(col * factor, digits) + F.lit(0.0)


@query("complex_components", f"""SELECT l_orderkey, l_linenumber, round(sqrt(re * re + im * im), 4) AS mag, round(degrees(atan2(im, re)), 8) AS phase, round(-im / re, 9) AS slope, -im + 0.0 AS imag,
 round(re * re - im * im, 4) AS sq_re, round(2 * re * im + 0.0, 4) AS sq_im FROM ({ZSQL})""")
def complex_components(spark, sf):
    z = Cx(F.col("re"), F.col("im"))
    s, sq = z.with_sign(-1), z * z
    return rounded(z_rows(spark, sf).select("l_orderkey", "l_linenumber", z.mag.alias("mag"), z.phase.alias("phase"), s.slope.alias("slope"), (s.imag + 0.0).alias("imag"),
                                            sq.re.alias("sq_re"), (sq.im + 0.0).alias("sq_im")), {"mag": 4, "phase": 8, "slope": 9, "sq_re": 4, "sq_im": 4})


@query("impedance_forms", f"""WITH z AS ({ZSQL}), k AS (SELECT *, 2 * pi() * f AS w, 8.85418782e-14 * 25 / 0.05 AS c0, re * re + im * im AS m FROM z)
SELECT l_orderkey, l_linenumber, round(re / m * 1e6, 6) AS y_re, round(-im / m * 1e6 + 0.0, 6) AS y_im, round(-w * c0 * im * 1e6 + 0.0, 6) AS m_re, round(w * c0 * re * 1e6, 6) AS m_im,
 round(-im / (w * m) * 1e9 + 0.0, 6) AS c_re, round(-re / (w * m) * 1e9, 6) AS c_im, round(-im / (w * c0 * m) + 0.0, 4) AS er_re, round(re / (w * c0 * m), 4) AS er_im,
 round(re / m / 500 * 1e9, 6) AS s_re, round(re * 500, 2) AS r_re FROM k""")
def impedance_forms(spark, sf):
    z = Cx(F.col("re"), F.col("im"))
    s = M.Sample(F.col("f"), 25.0, 0.05)
    g = lambda n: M.from_impedance(z, n, s)
    y, m, c, e, sg, r = (g(n) for n in ("Y", "M", "C", "e_r", "sigma", "rho"))
    return z_rows(spark, sf).select(
        "l_orderkey", "l_linenumber", scaled(y.real, 1e6).alias("y_re"), scaled(y.imag, 1e6).alias("y_im"), scaled(m.real, 1e6).alias("m_re"), scaled(m.imag, 1e6).alias("m_im"),
        scaled(c.real, 1e9).alias("c_re"), scaled(c.imag, 1e9).alias("c_im"), scaled(e.real, 1, 4).alias("er_re"), scaled(e.imag, 1, 4).alias("er_im"),
        scaled(sg.real, 1e9).alias("s_re"), scaled(r.real, 1, 2).alias("r_re"))


@query("dc_corrected_forms", """WITH z AS (SELECT user_id, event_id, value AS f, value + 1 AS re, -(event_id % 13)::DOUBLE AS im, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT *, 2 * pi() * f AS w, re * re + im * im AS m, 8.85418782e-14 AS e0 FROM z),
p AS (SELECT *, re / m AS sig, -im / (w * e0 * m) AS er, greatest(1, floor(n * 0.05)) AS take FROM k),
e AS (SELECT *, avg(CASE WHEN i < take THEN sig END) OVER (PARTITION BY user_id) AS sdc, avg(CASE WHEN i >= n - take THEN er END) OVER (PARTITION BY user_id) AS einf FROM p)
SELECT user_id, event_id, round((-1 * (-re / (w * e0 * m) + sdc / (e0 * w))) * 1e-9 + 0.0, 6) AS corr_im, round((er - einf) * 1e-9 + 0.0, 6) AS chi_re, round(sdc * 1e6, 6) AS dc FROM e""")
def dc_corrected_forms(spark, sf):
    df = events(spark, sf).select("user_id", "event_id", F.col("value").alias("f"), (F.col("value") + 1).alias("re"), (-(F.col("event_id") % 13)).cast("double").alias("im"))
    rows = M.with_edge_constants(df, USER, ["f", "event_id"], "re", "im")
    s = M.Sample(F.col("f"), sigma_dc=F.col("sigma_dc"), eps_inf=F.col("eps_inf"))
    z = Cx(F.col("re"), F.col("im"))
    return rows.select("user_id", "event_id", scaled(M.from_impedance(z, "e_r_corr", s).imag, 1e-9).alias("corr_im"),
                       scaled(M.from_impedance(z, "chi", s).real, 1e-9).alias("chi_re"), scaled(F.col("sigma_dc"), 1e6).alias("dc"))


@query("loss_forms", f"""WITH z AS ({ZSQL}) SELECT l_orderkey, l_linenumber, CASE WHEN im = 0 THEN NULL ELSE round(re / -im, 6) END AS dissipation_factor, round(degrees(atan2(re, -im)), 6) AS loss_angle FROM z""")
def loss_forms(spark, sf):
    got = M.loss_forms(Cx(F.col("re"), F.col("im")), M.Sample(F.col("f")))
    df = z_rows(spark, sf).select("l_orderkey", "l_linenumber", "im", *[got[k].alias(k) for k in ("dissipation_factor", "loss_angle")])
    return rounded(df.withColumn("dissipation_factor", F.when(F.col("im") != 0, F.col("dissipation_factor"))).drop("im"), 6)


@query("inverse_forms", f"""WITH z AS ({ZSQL}) SELECT l_orderkey, l_linenumber, 9::BIGINT AS forms, round(re, 2) AS re, round(im, 2) + 0.0 AS im FROM z""")
def inverse_forms(spark, sf):
    z = Cx(F.col("re"), F.col("im"))
    s = M.Sample(F.col("f"), 25.0, 0.05, sigma_dc=F.lit(1e-9), eps_inf=F.lit(3.0))
    names = [n for n in M.FORM_NAMES if n != "impedance"]
    back = [M.to_impedance(M.from_impedance(z, n, s), n, s) for n in names]
    ok = [((F.abs(b.re - F.col("re")) <= 1e-6 * F.col("re")) & (F.abs(b.im - F.col("im")) <= 1e-6 * F.col("re"))).cast("long") for b in back]
    return z_rows(spark, sf).select("l_orderkey", "l_linenumber", sum(ok, F.lit(0)).cast("long").alias("forms"),
                                    (F.round(back[1].re, 2) + 0.0).alias("re"), (F.round(back[1].im, 2) + 0.0).alias("im"))


@query("convert_checked", """SELECT user_id, event_id, round(value / (value * value + (value / 2) * (value / 2)), 9) AS re_out, value < 0 AS conjugated, true AS phase_ok FROM events""")
def convert_checked(spark, sf):
    df = events(spark, sf).withColumn("im", -F.col("value") / 2)
    out = M.convert_checked(df, USER, "value", "value", "im", "impedance", "admittance")
    return rounded(out.select("user_id", "event_id", "re_out", "conjugated", "phase_ok"), 9)


@query("signed_logs", "SELECT event_id, round(CASE WHEN value = 20 THEN 0 ELSE sign(value - 20) * log10(abs(value - 20)) END, 9) AS lg, round(CASE WHEN value = 20 THEN 0 ELSE sign(value - 20) * ln(abs(value - 20)) END, 9) AS ln FROM events")
def signed_logs(spark, sf):
    v = F.col("value") - 20
    return rounded(events(spark, sf).select("event_id", M.signed_log(v, True).alias("lg"), M.signed_log(v).alias("ln")), 9)


@query("rc_conversions", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * l_tax = 0 THEN 0 ELSE round(1 / (2 * pi() * l_quantity * l_tax), 9) END AS f, CASE WHEN l_quantity * l_tax = 0 THEN 0 ELSE round(1 / (l_quantity * l_tax), 9) END AS w FROM lineitem""")
def rc_conversions(spark, sf):
    q, t = F.col("l_quantity"), F.col("l_tax")
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.inverse_product(q, t).alias("f"), C.inverse_product(q, t, two_pi=False).alias("w")), 9)


@query("rc_pairs", """WITH p AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 'R' ELSE 'C' END AS name, value, lead(CASE WHEN event_type = 'click' THEN 'R' ELSE 'C' END) OVER w AS nn, lead(value) OVER w AS nv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(value * nv, 8) AS rc, round(1 / (2 * pi() * value * nv), 8) AS f_rc FROM p WHERE name = 'R' AND nn = 'C'""")
def rc_pairs(spark, sf):
    df = events(spark, sf).withColumn("name", F.when(F.col("event_type") == "click", "R").otherwise("C"))
    return rounded(C.rc_pairs(df, USER, ["ts", "event_id"], "name", "value").select("user_id", "rc", "f_rc"), 8)


@query("circuit_equivalents", """WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS r1, l_quantity AS c1, l_extendedprice / 3 AS r2, l_quantity * 5 AS c2 FROM lineitem)
SELECT l_orderkey, l_linenumber, round(r1 + r2, 5) AS ra, round(c1 * c2 / (c1 + c2), 7) AS ca, round(r1 * r2 * (r1 + r2) * pow(c1 + c2, 2) / pow(r1 * c1 - r2 * c2, 2), 3) AS rb, round(pow(r1 * c1 - r2 * c2, 2) / ((c1 + c2) * pow(r1 + r2, 2)), 7) AS cb,
 round(greatest(r2, 0), 5) AS back_r1, round(c2, 5) AS back_c1 FROM p""")
def circuit_equivalents(spark, sf):
    r1, c1 = F.col("l_extendedprice"), F.col("l_quantity")
    ra, ca, rb, cb = C.voigt_to_maxwell(r1, c1, r1 / 3, c1 * 5)
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ra.alias("ra"), ca.alias("ca"), rb.alias("rb"), cb.alias("cb"))
    df = C.with_voigt(df, ["ra", "ca", "rb", "cb"], ["back_r1", "back_c1", "back_r2", "back_c2"]).drop("back_r2", "back_c2")
    return rounded(df, {"ra": 5, "ca": 7, "rb": 3, "cb": 7, "back_r1": 5, "back_c1": 5})


@query("split_rc", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * 10 / 11, 6) AS r1, round(l_quantity * 11 / 10, 6) AS c1, round(l_extendedprice / 11, 6) AS r2, round(l_quantity * 11, 6) AS c2 FROM lineitem""")
def split_rc(spark, sf):
    parts = C.split_rc(F.col("l_extendedprice"), F.col("l_quantity"), 2)
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", parts.alias("p"))
    return rounded(df.select("l_orderkey", "l_linenumber", *[F.get("p", F.lit(i))[n].alias(f"{n}{i + 1}") for i in (0, 1) for n in ("r", "c")]), 6)


@query("join_rc", """SELECT l_suppkey, round(sum(l_extendedprice), 2) AS "R", round(exp(sum(l_extendedprice * ln(l_extendedprice * l_quantity)) / sum(l_extendedprice)) / sum(l_extendedprice), 8) AS "C" FROM lineitem GROUP BY 1""")
def join_rc(spark, sf):
    return rounded(C.join_rc(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity"), {"R": 2, "C": 8})


@query("circuit_impedance", """WITH p AS (SELECT c_custkey, abs(c_acctbal) + 1 AS r1, unnest([0.01, 1.0, 100.0])::DOUBLE AS freq FROM customer), w AS (SELECT *, 2 * pi() * freq * r1 * 1e-4 AS x FROM p)
SELECT c_custkey, freq, round(10 + r1 / (1 + x * x), 6) AS re, round(-r1 * x / (1 + x * x), 6) AS im FROM w""")
def circuit_impedance(spark, sf):
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias("dataset_id"), F.lit("R0-p(R1,C1)").alias("model"),
                                             F.create_map(F.lit("R0"), F.lit(10.0), F.lit("R1"), F.abs("c_acctbal") + 1, F.lit("C1"), F.lit(1e-4)).alias("params"))
    out = C.evaluate_models(df, ["R0-p(R1,C1)"], [0.01, 1.0, 100.0])
    return rounded(out.select(F.col("dataset_id").alias("c_custkey"), "freq", "re", "im"), 6)


@query("time_functions", """SELECT event_id, round(3 * exp(-t / 1e5) + 1, 9) AS e1, round(3 * exp(-t / 1e5) + 2 * exp(-t / 1e6) + 1, 9) AS e2, round(3 * exp(-pow(t / 1e5, 0.5)) + 1, 9) AS st, round(2 * pow(CASE WHEN t = 0 THEN 1e-32 ELSE t END, -0.5) + 1, 9) AS pw
FROM (SELECT event_id, (epoch_us(ts) - 1704067200000000) / 1e6 AS t FROM events)""")
def time_functions(spark, sf):
    t, n = F.col("t"), lambda x: F.lit(float(x))
    return rounded(events(spark, sf).select(
        "event_id", U.exponential_curve(t, n(3), n(1e5), n(1)).alias("e1"), U.multi_exponential_curve(t, F.array(n(3), n(1e5), n(2), n(1e6), n(1))).alias("e2"),
        U.stretched_curve(t, n(3), n(1e5), n(0.5), n(1)).alias("st"), U.power_curve(t, n(2), n(0.5), n(1)).alias("pw")), 9)


@query("unit_convert", """SELECT p_partkey, round(p_size * 100.0::DOUBLE, 6) AS cm, round(p_size * 1e4, 4) AS cm2, round(p_retailprice * 25.4, 4) AS mm FROM part""")
def unit_convert(spark, sf):
    size = F.col("p_size").cast("double")
    return rounded(table(spark, sf, "part").select(
        "p_partkey", U.convert_units(size, "m", "cm").alias("cm"), U.convert_units(size, "m", "cm", 2).alias("cm2"),
        U.convert_quantity(F.concat(F.col("p_retailprice").cast("string"), F.lit(" [inch]")), "mm").alias("mm")), {"cm": 6, "cm2": 4, "mm": 4})


@query("name_parts", r"""SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)', 1) AS condition, regexp_extract(c_name, '(\d+)$', 1)::BIGINT AS run FROM customer""")
def name_parts(spark, sf):
    df = X.dataset_name_parts(table(spark, sf, "customer"), "c_name", [(r"[A-Za-z]+", "condition"), (r"\d+", "number")])
    return df.select("c_custkey", "condition", X.run_number(F.col("c_name")).alias("run"))


@query("url_parts", r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, CASE WHEN regexp_extract(url, '/(\d+)', 1) = '' THEN NULL ELSE regexp_extract(url, '/(\d+)', 1) END AS item FROM pages""")
def url_parts(spark, sf):
    df = table(spark, sf, "pages")
    return df.select("page_id", X.first_match(F.col("url"), [r"^https?://([^/]+)"]).alias("host"), X.first_match(F.col("url"), [r"/(\d+)"]).alias("item"))


@query("number_text", """WITH v AS (SELECT o_orderkey, o_totalprice AS v, floor(log10(o_totalprice) / 3) * 3 AS p FROM orders)
SELECT o_orderkey, printf('%.5f', pow(10, log10(v) - p)) || CASE p WHEN 0 THEN '' WHEN 3 THEN 'k' WHEN 6 THEN 'M' END AS eng, upper(printf('%.2e', v)) AS sci FROM v""")
def number_text(spark, sf):
    v = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", X.engineering(v, 5).alias("eng"), X.scientific(v).alias("sci"))


@query("text_clean", r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(regexp_replace(p_brand || ' ' || p_name, '[^A-Za-z0-9_\s-]', '', 'g')), '[-\s]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS slug FROM part""")
def text_clean(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"))


@query("typed_values", """SELECT event_id, CASE WHEN floor(value) = value THEN 'int' ELSE 'float' END AS kind, value AS number FROM events""")
def typed_values(spark, sf):
    v = X.typed_value(F.col("value").cast("string"))
    return events(spark, sf).select("event_id", v["kind"].alias("kind"), v["number"].alias("number"))


@query("common_text", """WITH n AS (SELECT DISTINCT p_brand, p_name, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS toks FROM part),
s AS (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM n), e AS (SELECT *, unnest(range(1, len(toks) - i + 2)) AS len FROM s),
t AS (SELECT DISTINCT p_brand, p_name, len, array_to_string(list_slice(toks, i, i + len - 1), '_') AS run FROM e),
c AS (SELECT p_brand, count(*) AS names FROM n GROUP BY 1), k AS (SELECT p_brand, run, len, count(*) AS k FROM t GROUP BY 1, 2, 3),
b AS (SELECT k.p_brand, arg_min(run, {'s': -len, 'l': -length(run), 't': run}) AS common FROM k JOIN c ON c.p_brand = k.p_brand WHERE k = names GROUP BY 1)
SELECT c.p_brand, names, common FROM c LEFT JOIN b ON b.p_brand = c.p_brand""")
def common_text(spark, sf):
    return X.common_tokens(table(spark, sf, "part"), ["p_brand"], "p_name")


@query("frequency_grid", """WITH s AS (SELECT s_suppkey, log10(s_suppkey + 1) AS a, log10((s_suppkey + 1) * 100) AS b FROM supplier), g AS (SELECT *, floor(1 + 4 * abs(a - b))::INT AS n FROM s), e AS (SELECT *, unnest(range(n)) AS i FROM g)
SELECT s_suppkey, round(pow(10, a + i * (b - a) / (n - 1)), 6) AS freq FROM e""")
def frequency_grid(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") + 1.0).alias("lo"), ((F.col("s_suppkey") + 1.0) * 100).alias("hi"))
    # Rounded as the product, like the SQL: a decimal text of the number rounds other ties.
    return U.decade_grid(df, "lo", "hi", 4).select("s_suppkey", (F.round(F.col("freq") * 1e6) / 1e6).alias("freq"))


def _poly(x: str, coef) -> str:
    out = repr(float(coef[-1]))
    for c in list(reversed(coef))[1:]:
        out = f"({out} * {x} + {float(c)!r})"
    return out


_a0, _a1, _a2 = U.K_EXPONENTIAL
_WARM = f"({_poly('t', U.K_FORWARD_POSITIVE)} + {_a0} * exp({_a1} * (t - {_a2}) * (t - {_a2})))"
_INV = f"CASE WHEN m < 0 THEN {_poly('m', U.K_INVERSE[0][2])} WHEN m < 20.644 THEN {_poly('m', U.K_INVERSE[1][2])} ELSE {_poly('m', U.K_INVERSE[2][2])} END"


@query("thermocouple", f"""WITH v AS (SELECT event_id, least(value, 1372.0) AS t FROM events), m AS (SELECT event_id, {_WARM} AS mv FROM v), a AS (SELECT event_id, mv, mv AS m FROM m)
SELECT event_id, round(mv, 8) AS mv, round({_INV}, 6) AS celsius FROM a""")
def thermocouple(spark, sf):
    df = events(spark, sf).select("event_id", U.celsius_to_millivolt(F.col("value")).alias("mv"))
    return rounded(df.withColumn("celsius", U.millivolt_to_celsius(F.col("mv"))), {"mv": 8, "celsius": 6})


@query("raw_to_standard", """WITH r AS (SELECT event_id, CASE WHEN event_type = 'click' THEN value END AS rv, CASE WHEN event_type IN ('view', 'click') THEN value * 1e-3 END AS rc, CASE WHEN event_type = 'error' THEN value END AS rr FROM events),
v AS (SELECT *, coalesce(rv, 2.0 * sign(coalesce(rv, rc, 1.0))) AS voltage FROM r), c AS (SELECT *, coalesce(rc, voltage / rr) AS current FROM v)
SELECT event_id, round(voltage, 6) AS voltage, round(current, 9) AS current, round(coalesce(rr, voltage / current), 6) AS resistance, round(voltage * sqrt(2), 6) AS voltage_rms FROM c""")
def raw_to_standard(spark, sf):
    kind, v = F.col("event_type"), F.col("value")
    df = events(spark, sf).select("event_id", F.when(kind == "click", v).alias("raw_voltage"), F.when(kind.isin("view", "click"), v * 1e-3).alias("raw_current"), F.when(kind == "error", v).alias("raw_resistance"))
    out = D.raw_to_standard(df).select("event_id", "voltage", "current", "resistance", "voltage_rms")
    return rounded(out, {"voltage": 6, "current": 9, "resistance": 6, "voltage_rms": 6}, products=True)


@query("bounds_validate", """SELECT l_orderkey, l_linenumber, round(least(l_quantity, l_discount * 400), 6) AS lb, round(greatest(l_quantity, l_discount * 400), 6) AS ub, round(least(greatest(l_tax * 400, least(l_quantity, l_discount * 400)), greatest(l_quantity, l_discount * 400)), 6) AS p0 FROM lineitem""")
def bounds_validate(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("lb"), (F.col("l_tax") * 400).alias("p0"), (F.col("l_discount") * 400).alias("ub"))
    return rounded(D.validate_bounds(df), 6)


@query("model_text", r"""WITH m AS (SELECT DISTINCT 'R' || (p_size % 3) || '-p(R' || (p_size % 5 + 3) || ',C' || (p_size % 5 + 3) || ')' AS model FROM part)
SELECT model, len(regexp_extract_all(model, '(ICPE|CPE|R|C|L|K)(\d+)'))::BIGINT AS num_params, true AS valid FROM m""")
def model_text(spark, sf):
    n = (F.col("p_size") % 5 + 3).cast("string")
    df = table(spark, sf, "part").select(F.concat(F.lit("R"), (F.col("p_size") % 3).cast("string"), F.lit("-p(R"), n, F.lit(",C"), n, F.lit(")")).alias("model"))
    return C.model_checks(df).select("model", F.col("num_params").cast("long"), "valid")


@query("model_groups", r"""WITH m AS (SELECT DISTINCT p_size % 3 AS a, p_size % 5 + 3 AS b FROM part), t AS (SELECT 'R' || a || '-p(R' || b || ',C' || b || '-L' || b || ')' AS model, unnest(['R' || a, 'p(R' || b || ',C' || b || '-L' || b || ')']) AS part, unnest([0, 1]) AS pos FROM m) SELECT * FROM t""")
def model_groups(spark, sf):
    n = (F.col("p_size") % 5 + 3).cast("string")
    df = table(spark, sf, "part").select(F.concat(F.lit("R"), (F.col("p_size") % 3).cast("string"), F.lit("-p(R"), n, F.lit(",C"), n, F.lit("-L"), n, F.lit(")")).alias("model"))
    return C.series_groups(df)


@query("sanitize_std", """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 0 WHEN l_extendedprice * 100 = 0 THEN 0 WHEN log10(abs(l_extendedprice * 100 / l_tax)) > greatest(floor(abs(log10(l_tax))), 6) * 0.75 THEN 0 ELSE round(l_extendedprice * 100, 2) END AS std FROM lineitem""")
def sanitize_std(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(df.select("l_orderkey", "l_linenumber", D.sane_std(F.col("l_tax"), F.col("l_extendedprice") * 100).alias("std")), 2)


@query("convert_fit_section", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'R0-K1' ELSE 'R0-C1' END AS model, round(CASE WHEN c_custkey % 2 = 0 THEN (abs(c_acctbal) + 1) * 1e-3 END, 9) AS tau FROM customer""")
def convert_fit_section(spark, sf):
    model = F.when(F.col("c_custkey") % 2 == 0, "R0-p(R1,C1)").otherwise("R0-C1")
    fits = table(spark, sf, "customer").select("c_custkey", model.alias("model"), F.create_map(
        F.lit("R0"), F.lit(1.0), F.lit("R1"), F.abs("c_acctbal") + 1, F.lit("C1"), F.lit(1e-3)).alias("params"))
    out = C.convert_section(fits, ["c_custkey"], "p(R1,C1)", "K1", ["R1", "C1"], ["K1_0", "K1_1"], C.rc_to_k)
    return rounded(out.select("c_custkey", "model", F.col("params")["K1_1"].alias("tau")), 9)
