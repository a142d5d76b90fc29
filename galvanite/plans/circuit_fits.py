"""Circuit models on many sweeps: fits, Kramers-Kronig test, statistics.

Rows of a sweep with the same frequency enter a least-squares fit only
through their weight sum and weighted mean, so they are combined before any
task sees a dataset; a task then holds one row per distinct frequency.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.functions.circuits import model_impedance, model_parameters
from galvanite.functions.complexnum import Cx
from galvanite.keyed import Ordered, attach, has_hot_group, map_keys, quantiles, with_group
from galvanite.operators.aggregates import describe_bootstrap
from galvanite.operators.windows import arc_points
from galvanite.plans.fits import bootstrap_rows
from galvanite.plans.kernels import bounded_least_squares, bounded_least_squares_lanes, circuit_impedance, resample_counts
from galvanite.session import cut_lineage


def collapse_sweeps(df: DataFrame, keys: Sequence[str], freq: str, re: str, im: str, weighted: bool = True, band: tuple[float, float] | None = None) -> DataFrame:
    """(keys, f, re, im, w_re, w_im): weighted means per distinct frequency.

    With `weighted` a row counts by |part| / max |part| of its dataset.
    """
    rows = df.where(F.col(freq).between(*band)) if band else df
    rows = rows.select(*keys, F.col(freq).cast("double").alias("f"), F.col(re).cast("double").alias("re"), F.col(im).cast("double").alias("im"))
    if weighted:
        rows = with_group(rows, keys, F.max(F.abs("re")).alias("_mr"), F.max(F.abs("im")).alias("_mi"))
        wr = F.coalesce(F.try_divide(F.abs("re"), F.col("_mr")), F.lit(1.0))
        wi = F.coalesce(F.try_divide(F.abs("im"), F.col("_mi")), F.lit(1.0))
        rows = rows.withColumn("w_re", wr).withColumn("w_im", wi)
    else:
        rows = rows.withColumn("w_re", F.lit(1.0)).withColumn("w_im", F.lit(1.0))
    return rows.groupBy(*keys, "f").agg(
        F.coalesce(F.try_divide(F.sum(F.col("w_re") * F.col("re")), F.sum("w_re")), F.avg("re")).alias("re"),
        F.coalesce(F.try_divide(F.sum(F.col("w_im") * F.col("im")), F.sum("w_im")), F.avg("im")).alias("im"),
        F.sum("w_re").alias("w_re"), F.sum("w_im").alias("w_im"),
    )


#: Numbers of a parameter of a start.
GIVEN = ["value", "lb", "ub", "locked"]


def _starts(start: DataFrame, keys: list[str], names: Sequence[str]) -> DataFrame:
    """A line per key and start: the numbers of each parameter as columns `_value0`, `_lb0`, ..."""
    begin = start.groupBy(*keys, "start_no").agg(*[
        F.max(F.when(F.col("param") == n, F.struct("value", "lb", "ub", F.coalesce("locked", F.lit(False)).alias("locked")))).alias(n) for n in names
    ])
    numbers = [F.col(f"`{n}`.{x}").cast("double").alias(f"_{x}{j}") for j, n in enumerate(names) for x in GIVEN]
    return cut_lineage(begin.select(*keys, "start_no", *numbers))


def fit_circuits(
    sweeps: DataFrame, keys: Sequence[str], freq: str, re: str, im: str, model: str, start: DataFrame, weighted: bool = True,
    band: tuple[float, float] | None = None, log_scale: bool = True, sequential: bool = False, iterations: int = 1, loss: str = "linear",
) -> DataFrame:
    """Bounded fit of one circuit to every dataset and start.

    `start` has (keys, start_no, param, value, lb, ub, locked). Locked
    parameters are constants. `sequential` fits one parameter at a time;
    further iterations restart from the result with bounds moved to it. The
    best start per dataset is returned in long form.
    """
    keys = list(keys)
    flat = collapse_sweeps(sweeps, keys, freq, re, im, weighted, band)
    if has_hot_group(flat, keys):
        raise ValueError("a sweep has more distinct frequencies than the group limit; restrict the band")
    names = model_parameters(model)
    # Starts are independent, so they spread over tasks by (dataset, start); each row carries the few numbers of its start.
    given, begin = GIVEN, _starts(start, keys, names)
    rows = attach(flat, begin, keys, "inner")

    def solve(f, real, imag, w_real, w_imag, *start) -> tuple:
        data, wt = np.concatenate([real, imag]), np.sqrt(np.concatenate([w_real, w_imag]))
        vals, lb, ub, locked = np.array([x[0] for x in start]).reshape(len(names), len(given)).T
        stds, cost = np.zeros(len(vals)), np.inf
        free = [j for j in range(len(names)) if locked[j] != 1]
        for _ in range(max(1, iterations)):
            for part in ([[j] for j in free] if sequential else [free]):
                logs = np.array([log_scale and vals[j] > 0 and lb[j] >= 0 for j in part], dtype=bool)

                def spread(q, part=part, logs=logs):
                    full = vals.copy()
                    full[part] = np.where(logs, 10.0 ** np.where(logs, q, 0), q)
                    return full

                def residual(q):
                    z = circuit_impedance(model, dict(zip(names, spread(q))), f)
                    return wt * (np.concatenate([z.real, z.imag]) - data)

                def scaled(x):
                    return np.where(logs, np.log10(np.maximum(x[part], 1e-300)), x[part])

                p, sd, cost = bounded_least_squares(residual, scaled(vals), scaled(lb), scaled(ub), loss)
                vals = spread(p)
                stds[part] = np.where(logs, vals[part] * np.log(10) * sd, sd)
            ratio_l, ratio_u = 0.1, 10.0
            if iterations > 1:
                lb = np.where(vals > 0, np.minimum(lb, vals * ratio_l), lb)
                ub = np.where(vals > 0, np.maximum(ub, vals * ratio_u), ub)
        return [0], [[cost], *([x] for x in vals), *([x] for x in stds)]

    values = ["f", "re", "im", "w_re", "w_im", *[f"_{x}{j}" for j in range(len(names)) for x in given]]
    adds = ", ".join(["cost double", *[f"_fit{j} double" for j in range(len(names))], *[f"_std{j} double" for j in range(len(names))]])
    got = map_keys(rows, [*keys, "start_no"], ["f"], values, solve, adds).select(
        *keys, "start_no", "cost", F.array(*[f"_fit{j}" for j in range(len(names))]).alias("values"), F.array(*[f"_std{j}" for j in range(len(names))]).alias("stds"))
    best = got.groupBy(*keys).agg(F.min_by(F.struct("start_no", "cost", "values", "stds"), F.struct("cost", "start_no")).alias("_b"))
    items = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("param"), F.col("_b.values").alias("value"), F.col("_b.stds").alias("std"))
    return best.select(*keys, F.lit(model).alias("model"), F.col("_b.start_no").alias("start_no"), F.col("_b.cost").alias("cost"), F.explode(items).alias("_x")).select(
        *keys, "model", "start_no", "cost", F.col("_x.param").alias("param"), F.col("_x.value").alias("value"), F.col("_x.std").alias("std"))


def predict(sweeps: DataFrame, fits: DataFrame, keys: Sequence[str], freq: str, models: Sequence[str]) -> DataFrame:
    """Add `pr_re` and `pr_im` of the stored fit to the rows of each dataset."""
    wide = fits.groupBy(*keys, "model").agg(F.map_from_entries(F.collect_list(F.struct("param", "value"))).alias("_p"))
    rows = attach(sweeps, wide, keys)
    re = im = None
    for m in models:
        z = model_impedance(m, {p: F.col("_p")[p] for p in model_parameters(m)}, F.col(freq))
        hit = F.col("model") == m
        re = F.when(hit, z.re) if re is None else re.when(hit, z.re)
        im = F.when(hit, z.im) if im is None else im.when(hit, z.im)
    return rows.select(*sweeps.columns, "model", re.alias("pr_re"), im.alias("pr_im"))


def bootstrap_circuits(sweeps: DataFrame, keys: Sequence[str], order: Sequence[str], freq: str, re: str, im: str, model: str, start: DataFrame,
                       replicates: int = 500, interval: float | None = None, **kw) -> DataFrame:
    """Refit on resamples and summarise each parameter.

    The task of a sweep draws its resamples as counts of its rows and fits
    them together. Sweeps above the group limit are drawn row by row, as are
    fits in several rounds.
    """
    keys = list(keys)
    if has_hot_group(sweeps, keys) or kw.get("sequential") or kw.get("iterations", 1) > 1:
        sample = bootstrap_rows(sweeps, keys, order, replicates)
        reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
        fits = fit_circuits(sample, [*keys, "replicate"], freq, re, im, model, start.withColumn("replicate", reps), **kw)
    else:
        fits = resampled_fits(sweeps, keys, order, freq, re, im, model, start, replicates, **kw)
    return describe_bootstrap(fits, [*keys, "param"], "value", interval)


#: Numbers of one array while the resamples of a sweep are fitted; a larger product of resamples and rows is worked off in parts.
LANE_CELLS = 1_000_000


def resampled_fits(
    sweeps: DataFrame, keys: Sequence[str], order: Sequence[str], freq: str, re: str, im: str, model: str, start: DataFrame, replicates: int,
    weighted: bool = True, band: tuple[float, float] | None = None, log_scale: bool = True, sequential: bool = False, iterations: int = 1, loss: str = "linear",
) -> DataFrame:
    """(keys, replicate, cost, param, value): the best fit of each resample of each sweep."""
    keys, names = list(keys), model_parameters(model)
    begin = _starts(start, keys, names)
    rows = sweeps.select(*keys, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).cast("double").alias(n) for c, n in ((freq, "f"), (re, "re"), (im, "im"))])
    rows = attach(rows, begin, keys, "inner")

    def solve(f, real, imag, *numbers) -> tuple:
        vals, lb, ub, locked = np.array([x[0] for x in numbers]).reshape(len(names), len(GIVEN)).T
        free = [j for j in range(len(names)) if locked[j] != 1]
        logs = np.array([log_scale and vals[j] > 0 and lb[j] >= 0 for j in free], dtype=bool)
        by_f = np.argsort(f, kind="stable")
        if band:
            by_f = by_f[(f[by_f] >= band[0]) & (f[by_f] <= band[1])]
        found = []
        part = max(1, LANE_CELLS // max(len(f), 1))
        for first in range(0, replicates if len(by_f) else 0, part):
            drawn = np.arange(first, min(first + part, replicates))
            counts = np.stack([resample_counts(len(f), b) for b in drawn])[:, by_f]
            some = counts.any(axis=1)
            drawn, counts = drawn[some], counts[some]
            grid, heads = np.unique(f[by_f], return_index=True)
            means = [_collapsed(counts, x[by_f], heads, weighted) for x in (real, imag)]
            data, wt = (np.concatenate([m[i] for m in means], axis=1) for i in (0, 1))

            def spread(q):
                full = np.tile(vals, (len(q), 1))
                full[:, free] = np.where(logs, 10.0 ** np.where(logs, q, 0), q)
                return full

            def residual(q, at):
                full = spread(q)
                z = circuit_impedance(model, {n: full[:, [j]] for j, n in enumerate(names)}, grid[None, :])
                return np.where(wt[at] > 0, wt[at] * (np.concatenate([z.real, z.imag], axis=1) - data[at]), 0.0)

            def scaled(x):
                return np.where(logs, np.log10(np.maximum(x[free], 1e-300)), x[free])

            with np.errstate(all="ignore"):
                p, cost = bounded_least_squares_lanes(residual, scaled(vals), scaled(lb), scaled(ub), len(drawn), loss)
                found.append(np.column_stack([drawn, cost, spread(p)]))
        lines = np.concatenate(found) if found else np.empty((0, 2 + len(names)))
        return np.zeros(len(lines), dtype=int), list(lines.T)

    values = ["f", "re", "im", *[f"_{x}{j}" for j in range(len(names)) for x in GIVEN]]
    adds = ", ".join(["_rep double", "cost double", *[f"_fit{j} double" for j in range(len(names))]])
    got = map_keys(rows, [*keys, "start_no"], [f"_o{i}" for i in range(len(order))], values, solve, adds)
    got = got.select(*keys, "start_no", F.col("_rep").cast("int").alias("replicate"), "cost", F.array(*[f"_fit{j}" for j in range(len(names))]).alias("values"))
    if has_hot_group(begin, keys, 1):
        got = got.groupBy(*keys, "replicate").agg(F.min_by(F.struct("cost", "values"), F.struct("cost", "start_no")).alias("_b")).select(*keys, "replicate", "_b.*")
    items = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("param"), F.col("values").alias("value"))
    return got.select(*keys, "replicate", "cost", F.explode(items).alias("_x")).select(*keys, "replicate", "cost", F.col("_x.param").alias("param"), F.col("_x.value").alias("value"))


def _collapsed(counts: np.ndarray, x: np.ndarray, heads: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Mean and root of the weight sum per resample and frequency, as `collapse_sweeps` has them for its rows."""
    known = ~np.isnan(x)
    size = np.where(known, np.abs(x), 0.0)
    top = (np.where(counts > 0, size, 0.0)).max(axis=1, keepdims=True)
    one = np.where(known & (top > 0), size / np.where(top > 0, top, 1.0), 1.0) if weighted else np.ones(counts.shape)
    w = counts * one
    total = np.add.reduceat(w, heads, axis=1)
    mean = np.add.reduceat(w * np.where(known, x, 0.0), heads, axis=1) / np.where(total > 0, total, 1.0)
    return mean, np.sqrt(total)


def linkk(
    sweeps: DataFrame, keys: Sequence[str], freq: str, re: str, im: str, c: float = 0.85, max_m: int = 200, fit_type: str = "complex", add_cap: bool = False
) -> DataFrame:
    """Kramers-Kronig test by RC elements with log-spaced time constants.

    Rows weigh 1 / |Z|. M grows from 1 until mu = 1 - sum |R < 0| / sum |R >= 0|
    falls to c. Output: keys, m, mu, taus, elements (R0, R_k.., [1/C0], L0), rms,
    and `converged`, which is false for sweeps whose mu stays above c for all
    of `max_m` terms.
    """
    keys = list(keys)
    x, y = F.col(re).cast("double"), F.col(im).cast("double")
    w = F.try_divide(F.lit(1.0), x * x + y * y)
    flat = sweeps.where(F.col(freq) > 0).groupBy(*keys, F.col(freq).cast("double").alias("f")).agg(
        F.sum(w).alias("w"), F.try_divide(F.sum(w * x), F.sum(w)).alias("re"), F.try_divide(F.sum(w * y), F.sum(w)).alias("im")
    ).where(F.col("w").isNotNull())
    if has_hot_group(flat, keys):
        raise ValueError("a sweep has more distinct frequencies than the group limit; restrict the band")
    types = dict(flat.dtypes)
    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + "m int, mu double, taus array<double>, elements array<double>, rms double, converged boolean"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("f")
        f, wt = pdf["f"].to_numpy(), np.sqrt(pdf["w"].to_numpy())
        omega = 2 * np.pi * f
        z = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        mu, m, el, taus = 1.0, 0, np.zeros(0), np.zeros(0)
        while mu > c and m < max_m:
            m += 1
            lo, hi = 1 / omega.max(), 1 / omega.min()
            taus = np.array([lo]) if m == 1 else np.logspace(np.log10(lo), np.log10(hi), m)
            cols = [np.ones_like(omega, dtype=complex)] + [1 / (1 + 1j * omega * t) for t in taus]
            if add_cap:
                cols.append(-1j / omega)
            cols.append(1j * omega * 1.0)
            a = np.array(cols).T
            parts, rhs = [], []
            if fit_type in ("real", "complex"):
                parts.append(a.real * wt[:, None])
                rhs.append(z.real * wt)
            if fit_type in ("imag", "complex"):
                parts.append(a.imag * wt[:, None])
                rhs.append(z.imag * wt)
            mat, vec = np.vstack(parts), np.concatenate(rhs)
            norm = np.linalg.norm(mat, axis=0)
            norm[norm == 0] = 1.0
            el = np.linalg.lstsq(mat / norm, vec, rcond=None)[0] / norm
            r = el[1: 1 + m]
            pos = np.abs(r[r >= 0]).sum()
            mu = 1 - np.abs(r[r < 0]).sum() / pos if pos else 0.0
        fit = a @ el
        out = pdf.iloc[:1][keys].copy()
        out["m"], out["mu"], out["taus"], out["elements"] = m, mu, [taus.tolist()], [el.tolist()]
        out["rms"] = float(np.sqrt(np.mean(np.abs(fit - z) ** 2)))
        out["converged"] = bool(mu <= c)
        return out

    return flat.groupBy(*keys).applyInPandas(solve, schema)


def linkk_model(df: DataFrame) -> DataFrame:
    """Circuit text and parameter map of a Kramers-Kronig result."""
    n = F.size("taus")
    cap = F.size("elements") == n + 3
    ks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("K"), i.cast("string")))
    model = F.concat(F.lit("R0-L0"), F.when(cap, "-C0").otherwise(""), F.lit("-"), F.array_join(ks, "-"))
    entries = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(
        F.struct(F.concat(F.lit("K"), i.cast("string"), F.lit("_0")).alias("key"), F.get("elements", i + 1).alias("value")),
        F.struct(F.concat(F.lit("K"), i.cast("string"), F.lit("_1")).alias("key"), F.get("taus", i).alias("value")),
    )))
    base = F.array(
        F.struct(F.lit("R0").alias("key"), F.get("elements", F.lit(0)).alias("value")),
        F.struct(F.lit("L0").alias("key"), F.element_at("elements", -1).alias("value")),
    )
    return df.withColumn("model", model).withColumn("params", F.map_from_entries(F.concat(base, entries)))


def corner_params(params: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """All combinations value - std / value + std of a few parameters.

    `params` has (keys, map value, map std); 2^k rows per dataset for the k
    named parameters of one circuit.
    """
    out = params.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(names) - 1))))
    for j, n in enumerate(names):
        bit = F.getbit("corner", F.lit(j))
        out = out.withColumn(n, F.col("value")[n] + F.when(bit == 1, 1.0).otherwise(-1.0) * F.col("std")[n])
    return out.select(*keys, "corner", *names)


def corner_sweeps(corners: DataFrame, keys: Sequence[str], model: str, freqs: Sequence[float]) -> DataFrame:
    names = model_parameters(model)
    rows = corners.withColumn("freq", F.explode(F.array(*[F.lit(float(f)) for f in freqs])))
    z = model_impedance(model, {n: F.col(n) for n in names}, F.col("freq"))
    return rows.select(*keys, "corner", "freq", z.re.alias("re"), z.im.alias("im"))


def material_params(fits: DataFrame, area: Column, thickness: Column, eps0: float = 8.8541878128e-14) -> DataFrame:
    """rho and epsilon of each R and C parameter with their deviations."""
    is_r, is_c = F.col("param").rlike("^R"), F.col("param").rlike("^C\\d")
    scale = F.when(is_r, area / thickness).when(is_c, thickness / (area * eps0))
    return fits.withColumn("material", F.when(is_r, "rho").when(is_c, "epsilon")).withColumn(
        "material_value", F.col("value") * scale).withColumn("material_std", F.col("std") * scale)


def peak_results(params: DataFrame, keys: Sequence[str], model: str, freqs: Sequence[float]) -> DataFrame:
    """Arc peak f, tau, R, C, quality with the spread over all +-std corners."""
    names = model_parameters(model)
    mid = params.select(*keys, F.lit(-1).alias("corner"), *[F.col("value")[n].alias(n) for n in names])
    every = mid.unionByName(corner_params(params, keys, names))
    arcs = arc_points(corner_sweeps(every, keys, model, freqs), [*keys, "corner"], "freq", "re", "im")
    main = F.col("corner") == -1
    aggs = []
    for c in ("f_peak", "tau", "R", "C", "Q_f", "Q_tau"):
        aggs += [F.max(F.when(main, F.col(c))).alias(c), ((F.max(F.when(~main, F.col(c))) - F.min(F.when(~main, F.col(c)))) / 2).alias(f"{c}_std")]
    return arcs.groupBy(*keys).agg(*aggs)


def model_stats(sweeps: DataFrame, params: DataFrame, keys: Sequence[str], model: str, parts: Sequence[str], freqs: Sequence[float]) -> DataFrame:
    """Arc peaks of the data, the model and each of its series parts."""
    data = arc_points(sweeps, keys, "freq", "re", "im").select(*keys, F.lit("data").alias("source"), "f_peak", "tau", "R", "C")
    grid = params.withColumn("freq", F.explode(F.array(*[F.lit(float(f)) for f in freqs])))
    out = data
    for m in [model, *[p for p in parts if p != model]]:
        z = model_impedance(m, {p: F.col("value")[p] for p in model_parameters(m)}, F.col("freq"))
        rows = grid.select(*keys, "freq", z.re.alias("re"), z.im.alias("im"))
        out = out.unionByName(arc_points(rows, keys, "freq", "re", "im").select(*keys, F.lit(m).alias("source"), "f_peak", "tau", "R", "C"))
    return out


def batch_selection(fits: DataFrame, key: str, pattern: str | None = None, new_values: DataFrame | None = None) -> DataFrame:
    """Stored fits to run again, with overrides and the next free number.

    Names of Kramers-Kronig results are left out. An overridden value keeps
    the ratio std / value. `next_name` adds one to the largest number used
    for the same stem.
    """
    rows = fits.where(~F.col(key).rlike("(?i)linkk"))
    if pattern:
        rows = rows.where(F.col(key).rlike(pattern))
    if new_values is not None:
        rows = attach(rows, new_values.select("param", F.col("value").alias("_new")), ["param"])
        ratio = F.try_divide(F.col("std"), F.col("value"))
        rows = rows.withColumn("std", F.when(F.col("_new").isNotNull(), F.col("_new") * ratio).otherwise(F.col("std")))
        rows = rows.withColumn("value", F.coalesce("_new", "value")).drop("_new")
    stem = F.regexp_replace(key, r"_(\d+)$", "")
    num = F.coalesce(F.regexp_extract(key, r"_(\d+)$", 1).try_cast("long"), F.lit(0))
    used = fits.select(stem.alias("_stem"), num.alias("_num")).groupBy("_stem").agg(F.max("_num").alias("_top"))
    rows = attach(rows.withColumn("_stem", stem), used, ["_stem"])
    return rows.withColumn("next_name", F.concat_ws("_", "_stem", (F.col("_top") + 1).cast("string"))).drop("_stem", "_top")
