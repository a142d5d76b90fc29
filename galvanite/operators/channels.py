"""Recognise what each raw channel of a run measures.

Input is the table of segment means (run keys, segment, channel, value). It is
reduced to one line of traits per (run, channel); the passes then run over the
few channels of a run, in order, as window columns on one partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galvanite.functions.units import millivolt_to_celsius
from galvanite.keyed import Ordered, attach, fold_sorted, with_group
from galvanite.operators.aggregates import cycling_test, most_frequent
from galvanite.session import cut_lineage

# Voltage bands, largest certain current, range of uncertain
# currents (log10), temperature readings of the two input kinds.
VOLTAGE_BANDS = ((1.9, 2.1), (2.8, 3.0))
SURE_CURRENT = 1e-8
MAYBE_CURRENT = (-8.0, -5.0)
TEMP_READING = {"auxin": 0.03, "other": 0.003}
CURRENT_UNIT = 1e-5
MULTIPLIERS = (1.0, 1e-8, 1e-9, 1e-10)
ROOT2 = math.sqrt(2.0)
NAMES = ("voltage", "current")


def suffix_kind(channel: Column) -> Column:
    """`.r` is a magnitude, `.y` an rms value, anything else the plain one."""
    return F.when(channel.endswith(".r"), "abs").when(channel.endswith(".y"), "rms").otherwise("")


def channel_base(channel: Column) -> Column:
    return F.regexp_replace(channel, r"\.[^.]*$", "")


def channel_traits(means: DataFrame, run: Sequence[str], order: Sequence[str], channel: str = "channel", value: str = "value") -> DataFrame:
    """One line per (run, channel): range of |value|, sign cycling, readings."""
    gk = [*run, channel]
    rows = means.where(F.col(value).isNotNull())
    mag = F.abs(F.col(value))
    base = rows.groupBy(*gk).agg(
        F.min(mag).alias("min_abs"), F.max(mag).alias("max_abs"), F.count(F.lit(1)).alias("n"), F.avg(mag).alias("mean_abs"),
    )
    factor = F.when(F.col(channel).contains("auxin"), 1e2).otherwise(1e3)
    temps = rows.select(*gk, millivolt_to_celsius(mag * factor, 30.0).alias("_c"), (mag * factor).alias("_mv"))
    temp = temps.groupBy(*gk).agg(F.avg("_c").alias("mean_celsius"), F.min("_c").alias("min_celsius"), F.max("_c").alias("max_celsius"), F.max("_mv").alias("max_mv"))
    cyc = cycling_test(rows, gk, order, value, pass_single=False)
    out = attach(attach(base, temp, gk), cyc, gk)
    return out.withColumn("kind", suffix_kind(F.col(channel))).withColumn("base", channel_base(F.col(channel)))


def classify_channels(traits: DataFrame, channel: str = "channel") -> DataFrame:
    """First pass: voltage by its bands, current by size, else unpicked."""
    lo, hi = F.col("min_abs"), F.col("max_abs")
    volts = reduce(lambda a, b: a | b, [(lo > a) & (lo < b) & (hi > a) & (hi < b) for a, b in VOLTAGE_BANDS])
    safe = lambda c: F.log10(F.when(c > 0, c))
    maybe = (safe(lo) < MAYBE_CURRENT[1]) & (safe(lo) > MAYBE_CURRENT[0]) & (safe(hi) < MAYBE_CURRENT[1]) & (safe(hi) > MAYBE_CURRENT[0])
    role = (
        F.when(F.col(channel).contains("fft"), "ignored").when(F.col(channel).contains("imps"), "resistance").when(volts, "voltage")
        .when(hi < SURE_CURRENT, "current").when(F.coalesce(maybe, F.lit(False)), "unknown").otherwise("unpicked")
    )
    return traits.withColumn("role", role)


def family_checks(means: DataFrame, run: Sequence[str], row: Sequence[str], channel: str = "channel", value: str = "value", tol: float = 0.05) -> DataFrame:
    """Whether plain, abs and rms channels of one base agree per run."""
    rows = means.withColumn("base", channel_base(F.col(channel))).withColumn("kind", suffix_kind(F.col(channel)))
    wide = rows.groupBy(*run, "base", *row).agg(*[F.max(F.when(F.col("kind") == k, F.col(value))).alias(f"_{k or 'plain'}") for k in ("", "abs", "rms")])
    close = lambda a, b: F.abs(a - b) <= 1e-12 + tol * F.abs(b)
    p, a, r = F.col("_plain"), F.col("_abs"), F.col("_rms")
    test = (
        F.coalesce(close(a, F.abs(p)), F.lit(True)) & F.coalesce(close(r, p * ROOT2), F.lit(True))
        & F.when(p.isNull(), F.coalesce(close(F.abs(r), a * ROOT2), F.lit(True))).otherwise(True)
    )
    return wide.groupBy(*run, "base").agg(F.bool_and(test).alias("consistent"))


def resolve_channels(
    traits: DataFrame, means: DataFrame, run: Sequence[str], row: Sequence[str], temp: str, channel: str = "channel", value: str = "value",
    trend: Sequence[str] = (),
) -> DataFrame:
    """All passes: (run, channel, role, std_channel, multiplier).

    1 ranges; a single small leftover next to a current is the temperature.
    2 cycling or consistent leftovers above 1e-5 are currents; then 1 again.
    3 the leftover nearest to the run temperature (within 4, or 15 where its
      name served before) is the temperature.
    4 a single leftover is temperature, current or unknown.
    5 among the rest, the one that rises most steadily over temperature.
    """
    run = list(run)
    w = Window.partitionBy(*run)
    rows = attach(classify_channels(traits, channel), family_checks(means, run, row, channel, value), [*run, "base"])
    # One line per (run, channel): small, and every pass reads it again.
    rows = cut_lineage(rows.withColumn("consistent", F.coalesce("consistent", F.lit(True))))
    left = F.col("role") == "unpicked"
    count_left = F.sum(left.cast("int")).over(w)
    has = lambda r: F.max((F.col("role") == r).cast("int")).over(w) == 1
    small = F.col("max_abs") < F.when(F.col(channel).contains("auxin"), TEMP_READING["auxin"]).otherwise(TEMP_READING["other"])

    def temp_rule(df: DataFrame) -> DataFrame:
        hit = left & (count_left == 1) & has("current") & ~has("temperature") & small & ~F.col("cycling")
        return df.withColumn("_hit", hit).withColumn("role", F.when(F.col("_hit"), "temperature").otherwise(F.col("role"))).drop("_hit")

    def current_rule(df: DataFrame, only: Column) -> DataFrame:
        kind_free = F.max(F.when(F.col("role") == "current", F.col("kind"))).over(Window.partitionBy(*run, "kind")).isNull()
        fits = (F.col("max_abs") >= CURRENT_UNIT) & F.col("consistent") & ((F.col("kind") != "") | F.col("cycling") | (F.col("n") < 2)) & kind_free
        ok = left & only & fits
        # One channel per slot: cycling ones first, then by name.
        order = Window.partitionBy(*run, "kind", "_ok").orderBy(F.col("cycling").desc(), channel)
        df = df.withColumn("_ok", ok).withColumn("_rank", F.row_number().over(order))
        return df.withColumn("role", F.when(F.col("_ok") & (F.col("_rank") == 1), "current").otherwise(F.col("role"))).drop("_ok", "_rank")

    def unknown_rule(df: DataFrame) -> DataFrame:
        df = temp_rule(df)
        df = df.withColumn("_one", left & (count_left == 1) & has("current"))
        df = current_rule(df, F.col("_one"))
        return df.withColumn("role", F.when(left & F.col("_one"), "unknown").otherwise(F.col("role"))).drop("_one")

    rows = temp_rule(rows)
    cycles = F.max((left & F.col("cycling")).cast("int")).over(w) == 1
    rows = rows.withColumn("_cyc", cycles)
    rows = current_rule(rows, F.col("_cyc")).drop("_cyc")
    rows = temp_rule(rows)
    rows = rows.withColumn("_late", has("temperature") & has("current"))
    rows = rows.withColumn("role", F.when(left & F.col("_late") & (count_left == 1), "unknown").otherwise(F.col("role"))).drop("_late")

    rows = cut_lineage(rows)
    # Pass 3. Names that served as temperature anywhere get the wider limit.
    used = rows.where(F.col("role") == "temperature").select(channel).distinct().withColumn("_used", F.lit(True))
    rows = attach(rows, used, [channel])
    limit = F.when(F.coalesce("_used", F.lit(False)), 15.0).otherwise(4.0)
    want = F.col(temp).cast("double")
    nearest = F.least(F.abs(F.col("min_celsius") - want), F.abs(F.col("max_celsius") - want), F.abs(F.col("mean_celsius") - want))
    able = left & ~has("temperature") & (F.col("max_mv") <= 3) & (nearest <= limit)
    rows = rows.withColumn("_able", F.coalesce(able, F.lit(False)))
    pick = Window.partitionBy(*run, "_able").orderBy(F.abs(F.col("mean_celsius") - want), channel)
    rows = rows.withColumn("_rank", F.row_number().over(pick))
    rows = rows.withColumn("role", F.when(F.col("_able") & (F.col("_rank") == 1), "temperature").otherwise(F.col("role"))).drop("_able", "_rank", "_used")
    rows = current_rule(rows, F.lit(True))
    rows = unknown_rule(rows)
    rows = cut_lineage(rows)
    # Pass 4 and 5.
    rows = unknown_rule(rows)
    if trend:
        # Share of rising steps of |mean| over the temperatures of its group.
        steps = Ordered(rows.select(*run, channel, "mean_abs"), [*trend, channel], [temp, *[k for k in run if k not in trend and k != temp]]).frame(
            {"_prev": lambda ww: F.lag("mean_abs").over(ww)}
        )
        rise = steps.groupBy(*trend, channel).agg(F.avg((F.col("mean_abs") >= F.col("_prev")).cast("double")).alias("_rise"))
        rows = attach(rows, rise, [*trend, channel])
    else:
        rows = rows.withColumn("_rise", F.lit(None).cast("double"))
    rows = rows.withColumn("_able", left & ~has("current"))
    pick = Window.partitionBy(*run, "_able").orderBy(F.col("_rise").desc_nulls_last(), channel)
    rows = rows.withColumn("_rank", F.row_number().over(pick))
    rows = rows.withColumn("role", F.when(F.col("_able") & (F.col("_rank") == 1), "current").otherwise(F.col("role"))).drop("_able", "_rank", "_rise")
    rows = unknown_rule(rows)
    std = F.when(F.col("role").isin(*NAMES, "resistance", "temperature"),
                 F.concat_ws("_", F.lit("raw"), "role", F.when((F.col("kind") != "") & F.col("role").isin(*NAMES), F.col("kind"))))
    factor = F.when((F.col("role") == "temperature") & F.col(channel).contains("auxin"), 0.1).otherwise(1.0)
    return rows.select(*run, channel, "role", std.alias("std_channel"), factor.alias("multiplier"))


# --- decade factors -------------------------------------------------------------

def _log_distance(a: Column, b: Column) -> Column:
    floor = F.lit(1e-20)
    return F.abs(F.log10(F.greatest(F.abs(a), floor)) - F.log10(F.greatest(F.abs(b), floor)))


def _nearest_factor(raw: Column, ref: Column, ceiling: Column | None = None) -> Column:
    """Factor that brings the raw value nearest to a reference in log10."""
    items = F.array(*[F.lit(m) for m in MULTIPLIERS])
    if ceiling is not None:
        items = F.filter(items, lambda m: F.greatest(F.abs(raw * m), F.lit(1e-20)) <= ceiling)
    ranked = F.transform(items, lambda m: F.struct(_log_distance(ref, raw * m).alias("d"), (-m).alias("m")))
    return F.when(ref.isNotNull(), -F.array_min(ranked)["m"])


def _trend_factor(raw: Column, at: Column, series: Column) -> Column:
    """Factor with the smoothest rising log series once the value is put in.

    `series` is an array of struct(t, v) with one entry per temperature of a
    group mean.
    """
    others = F.filter(series, lambda s: s["t"] != at)

    def score(m: Column) -> Column:
        full = F.array_sort(F.array_append(others, F.struct(at.alias("t"), F.abs(raw * m).alias("v"))))
        logs = F.transform(full, lambda s: F.log10(F.greatest(s["v"], F.lit(1e-20))))
        n = F.size(logs) - 1
        steps = F.zip_with(F.slice(logs, 2, F.greatest(n, F.lit(0))), F.slice(logs, 1, F.greatest(n, F.lit(0))), lambda b, a: b - a)
        mean = F.try_divide(F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x), n)
        sq = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        return F.when((n >= 1) & F.forall(steps, lambda x: x >= 0), F.sqrt(F.try_divide(sq, n)))

    items = F.transform(F.array(*[F.lit(m) for m in MULTIPLIERS]), lambda m: F.struct(score(m).alias("d"), (-m).alias("m")))
    ok = F.filter(items, lambda s: s["d"].isNotNull())
    enough = F.size(series) >= 1
    return F.when(enough & (F.size(ok) > 0), -F.array_min(ok)["m"])


def infer_multiplier(
    df: DataFrame, sample: str = "sample_name", condition: str = "condition", temp: str = "temp", raw: str = "raw_current",
    current: str = "current", paired: Sequence[str] = ("pre", "dry"), strict: bool = True,
) -> DataFrame:
    """Decade factor of raw currents above 1e-8 by vote.

    Votes: nearest to the row's own current, to the mean of the same (sample,
    condition, temp), to the mean over the paired conditions, and the
    smoothest rise over temperature for the condition and for the pair; with
    `strict` off also the means over all samples. Factor 1 is no vote; the
    most frequent vote wins. The series are group means, one per temperature.
    """
    sct = [sample, condition, temp]
    mag = F.abs(F.col(current))
    base = df.groupBy(*sct).agg(F.avg(mag).alias("_c"), F.avg(F.abs(F.col(raw))).alias("_raw"))
    base = base.withColumn("_c", F.when(F.col("_c") <= SURE_CURRENT, F.col("_c")))
    pair = base.where(F.col(condition).isin(*paired)).groupBy(sample, temp).agg(F.avg("_c").alias("_pair"))
    point = F.struct(F.col(temp).cast("double").alias("t"), F.col("_c").alias("v"))
    series = base.where(F.col("_c").isNotNull()).groupBy(sample, condition).agg(F.array_sort(F.collect_list(point)).alias("_series"))
    ppoint = F.struct(F.col(temp).cast("double").alias("t"), F.col("_pair").alias("v"))
    pseries = pair.where(F.col("_pair").isNotNull()).groupBy(sample).agg(F.array_sort(F.collect_list(ppoint)).alias("_pseries"))
    facts = attach(attach(attach(base, pair, [sample, temp]), series, [sample, condition]), pseries, [sample])
    in_pair = F.col(condition).isin(*paired)
    if not strict:
        ct = base.groupBy(condition, temp).agg(F.avg("_c").alias("_ct"))
        cpoint = F.struct(F.col(temp).cast("double").alias("t"), F.col("_ct").alias("v"))
        cseries = ct.where(F.col("_ct").isNotNull()).groupBy(condition).agg(F.array_sort(F.collect_list(cpoint)).alias("_cseries"))
        facts = attach(attach(facts, ct, [condition, temp]), cseries, [condition])
    # All votes but the row's own depend on the group only: one line each.
    at = F.col(temp).cast("double")
    votes = [
        _nearest_factor(F.col("_raw"), F.col("_c")),
        F.when(in_pair, _nearest_factor(F.col("_raw"), F.col("_pair"))).otherwise(_nearest_factor(F.col("_raw"), F.col("_pair"), F.col("_pair"))),
        _trend_factor(F.col("_raw"), at, F.col("_series")),
        _trend_factor(F.col("_raw"), at, F.when(in_pair, F.col("_pseries")).otherwise(F.col("_series"))),
    ]
    if not strict:
        votes += [_nearest_factor(F.col("_raw"), F.col("_ct")), _trend_factor(F.col("_raw"), at, F.col("_cseries"))]
    facts = cut_lineage(facts.select(*sct, "_raw", F.array(*votes).alias("_shared")))
    rows = attach(df, facts, sct)
    own = F.when(F.col(current) <= SURE_CURRENT, F.abs(F.col(current)))
    every = F.concat(F.array(_nearest_factor(F.col("_raw"), own)), F.coalesce("_shared", F.array().cast("array<double>")))
    cast = F.filter(every, lambda v: v.isNotNull() & (v != 1))
    tally = F.transform(F.array(*[F.lit(m) for m in MULTIPLIERS[1:]]), lambda m: F.struct(
        F.size(F.filter("_votes", lambda v: v == m)).alias("k"), (-F.array_position("_votes", m)).alias("first"), m.alias("m")))
    rows = rows.withColumn("_votes", cast)
    best = F.when(F.size("_votes") > 0, F.array_max(tally)["m"])
    wanted = (F.abs(F.col(raw)) > SURE_CURRENT) & F.col(raw).isNotNull()
    return rows.select(*df.columns, F.coalesce(F.when(wanted, best), F.lit(1.0)).alias("multiplier"))


class TrendWalker:
    """Rows of one (sample, condition) by polarity, temperature and resistance, negative polarity first.

    A row has the columns of `TREND_ROW`. Carries mean and least of the
    temperature before (ten times its own for the first one) and gives the
    mean as a bar where the largest resistance reaches the least one. Every
    temperature gives a line with its bar and the sums of its resistances;
    the end gives a line with what the factors move by and their range. Holds
    one temperature at a time.
    """

    def __init__(self, key: tuple):
        self.key, self.point, self.rows = key, None, []
        self.polarity, self.before, self.has = None, None, set()
        self.fix, self.low, self.high = 0.0, None, None
        self.able, self.rest = False, (None, None)

    def add(self, row: tuple) -> list[tuple]:
        point = row[2:4]
        out = []
        if self.point is None or not all(a == b or (a != a and b != b) for a, b in zip(point, self.point)):
            out = self._line()
            if point[0] != self.polarity:
                self._turn(point[0])
            self.point = point
        self.able, self.rest = row[9], row[10:12]
        self.rows.append(row[4:9])
        return out

    def end(self) -> list[tuple]:
        out = self._line()
        self._turn(None)
        self._move(1, self.low, self.high)
        return [*out, (*self.key, None, None, None, None, None, None, None, self.fix, self.low, self.high)]

    def _turn(self, polarity: float | None) -> None:
        """After the negative rows: the others, not yet shifted, count for the range too."""
        if self.polarity == -1:
            self._move(-1, _least(self.low, self.rest[0]), _largest(self.high, self.rest[1]))
        self.polarity, self.before = polarity, None

    def _move(self, polarity: int, low: float | None, high: float | None) -> None:
        if self.able and polarity in self.has and low is not None:
            low, high = low + self.fix, high + self.fix
            self.fix += -10 - low if low < -10 else -8 - high if high > -8 else 0.0

    def _line(self) -> list[tuple]:
        if not self.rows:
            return []
        (polarity, temp), rows = self.point, self.rows
        self.rows = []
        closed = [(v, n) for v, moves, n, _, _ in rows if not moves and v is not None]
        opened = [(v, n) for v, moves, n, _, _ in rows if moves and v is not None]
        bar = None
        if any(moves for _, moves, *_ in rows):
            self.has.add(polarity)
            bar = self._bar(opened) if temp is not None and polarity in (-1, 1) else None
        for v, moves, _, low, high in rows:
            if moves and low is not None:
                by = 0.0 if bar is None or v is None or not v >= bar else _decades(v, bar)
                self.low, self.high = _least(self.low, low + by), _largest(self.high, high + by)
        shifted = [(_shrunk(v, _decades(v, bar)) if bar is not None and v >= bar else v, n) for v, n in opened]
        sums = [x for part in (shifted, closed) for x in (sum((v * n for v, n in part), 0.0), sum(n for _, n in part))]
        return [(*self.key, polarity, temp, bar, *sums, None, None, None)]

    def _bar(self, values: list[tuple]) -> float | None:
        if not values:
            self.before = (math.nan, math.nan)
            return None
        mean, least = self.before or (10 * _mean(values), 10 * values[0][0])
        bar = None
        if values[-1][0] >= least:
            bar = mean
            values = [(_shrunk(v, self.fix + _decades(v, mean)) if v >= mean else v, n) for v, n in values]
        self.before = (_mean(values), min(v for v, _ in values))
        return bar


#: Columns of the rows that `TrendWalker` walks; the last three are those of the (sample, condition):
#: whether an open row has a resistance, and the factors (log10) of the open rows that are not negative.
TREND_ROW = ("s", "c", "p", "t", "r", "open", "n", "lo", "hi", "able", "lo_rest", "hi_rest")


def _mean(values: list[tuple]) -> float:
    return sum(v * n for v, n in values) / sum(n for _, n in values)


def _least(a: float | None, b: float | None) -> float | None:
    return b if a is None else a if b is None else min(a, b)


def _largest(a: float | None, b: float | None) -> float | None:
    return b if a is None else a if b is None else max(a, b)


def _decades(value: float, mean: float) -> float:
    ratio = value / (mean * 0.99) if mean else 0.0
    if not ratio > 0:
        return 0.0
    return float(math.ceil(math.log10(ratio))) if ratio < math.inf else float(2**63 - 1)


def _shrunk(value: float, decades: float) -> float:
    """value / 10^decades, also where the power is out of range."""
    try:
        return value / 10.0**decades
    except OverflowError:
        return value / math.inf
    except ZeroDivisionError:
        return value * math.inf


def enforce_trend(
    df: DataFrame, sample: str = "sample_name", condition: str = "condition", temp: str = "temp", resistance: str = "resistance",
    voltage: str = "voltage", multiplier: str = "multiplier",
) -> DataFrame:
    """Resistance has to fall with temperature; factors move by decades.

    Per (sample, condition) and polarity, negative first, each group from its
    own lowest temperature on: where the largest resistance reaches the least
    one of the temperature before, rows at or above its mean get their factor
    raised by ceil(log10(R / (.99 mean))) decades. The first temperature is
    compared with ten times itself. After each polarity the exponents of the
    (sample, condition) are moved into -10..-8, which the second polarity sees
    for the rows it raises. Then `dh` has to lie below `pre`/`dry` at the same
    temperature, by one shift per sample. Only rows with a known factor other
    than 1 move; a temperature without values ends the comparison with what
    was before it.

    The walk sees the distinct resistances with their counts, dealt once by
    (sample, condition), and leaves a line per temperature. What follows works
    on these lines, dealt once by sample, and the rows are joined with them.
    """
    open_ = F.coalesce(F.col(multiplier) != 1, F.lit(False))
    pol = F.signum(F.coalesce(F.col(voltage), F.lit(0.0)))
    value, lg = F.col(resistance).cast("double"), F.log10(F.when(F.col(multiplier) > 0, F.col(multiplier)))
    rows = df.select(
        F.col(sample).alias("s"), F.col(condition).alias("c"), pol.alias("p"), F.col(temp).alias("t"),
        F.when(~F.isnan(value), value).alias("r"), open_.alias("open"), lg.alias("lg"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    sc, order = ["s", "c"], ["p", "t", "r", "open"]
    short = rows.repartition(*sc).groupBy(*sc, *order).agg(F.count(F.lit(1)).alias("n"), F.min("lg").alias("lo"), F.max("lg").alias("hi"))
    of_pair, rest = Window.partitionBy(*sc), F.col("open") & (F.col("p") != -1)
    short = short.sortWithinPartitions(*sc, *order).withColumns({
        "able": F.coalesce(F.max(F.col("open") & F.col("r").isNotNull()).over(of_pair), F.lit(False)),
        "lo_rest": F.min(F.when(rest, F.col("lo"))).over(of_pair), "hi_rest": F.max(F.when(rest, F.col("hi"))).over(of_pair)}).select(*TREND_ROW)
    lines = fold_sorted(
        short, sc, order, TrendWalker,
        f"s {kinds['s']}, c {kinds['c']}, p double, t {kinds['t']}, bar double, moving double, n_moving long, still double, n_still long, fix double, lo double, hi double", dealt=True)
    # A line with `fix` stands for a (sample, condition), all others for a temperature.
    of_temp, of_sample = Window.partitionBy("s", "t"), Window.partitionBy("s")
    lines = lines.withColumn("whole", F.col("fix").isNotNull()).repartition("s").withColumn("fix", F.max("fix").over(of_pair))
    dh, other = F.col("c") == "dh", F.col("c").isin("pre", "dry")
    moved = F.try_divide(F.col("moving"), F.pow(F.lit(10.0), F.col("fix")))
    mean = lambda total, n: F.try_divide(F.sum(total).over(of_temp), F.sum(n).over(of_temp))
    lines = lines.withColumns({
        "dh": mean(F.when(dh, moved), F.when(dh, F.col("n_moving"))),
        "rest": mean(F.when(other, moved + F.col("still")), F.when(other, F.col("n_moving") + F.col("n_still")))})
    least = F.when(~F.col("whole") & F.col("t").isNotNull() & (F.col("dh") >= F.col("rest")), _decades_column(F.col("dh"), F.col("rest")))
    lines = lines.withColumn("need", F.max(least).over(of_sample))
    lines = lines.withColumn("raised", F.when(dh & (F.col("need") > 0), F.col("need")).otherwise(0.0))
    at = F.when(F.col("whole") & (F.col("need") > 0), F.col("fix") + F.col("raised"))
    lines = lines.withColumns({"_lo": F.min(F.col("lo") + at).over(of_sample), "_hi": F.max(F.col("hi") + at).over(of_sample)})
    named = lines.where(~F.col("whole")).select(
        F.col("s").alias(sample), F.col("c").alias(condition), F.col("p").alias("_p"), F.col("t").alias(temp), F.col("bar").alias("_bar"), (F.col("fix") + F.col("raised") + _into_range()).alias("_all"))
    out = attach(df.withColumn("_p", pol), named, [sample, condition, "_p", temp])
    own = F.when(value >= F.col("_bar"), _decades_column(value, F.col("_bar"))).otherwise(0.0)
    by = F.when(open_, F.pow(F.lit(10.0), F.coalesce(own, F.lit(0.0)) + F.col("_all"))).otherwise(1.0)
    keep = [c for c in df.columns if c not in (multiplier, resistance)]
    return out.select(*keep, (F.col(multiplier) * by).alias(multiplier), F.try_divide(value, by).alias(resistance))


def _decades_column(value: Column, mean: Column) -> Column:
    ratio = F.try_divide(value, mean * 0.99)
    return F.when(ratio > 0, F.ceil(F.log10(F.when(ratio > 0, ratio))).cast("double")).otherwise(0.0)


def _into_range() -> Column:
    """Decades that move the exponents `_lo`.._hi` into -10..-8."""
    return F.when(F.col("_lo") < -10, -10 - F.col("_lo")).when(F.col("_hi") > -8, -8 - F.col("_hi")).otherwise(0.0)


# --- roles of sweep columns -------------------------------------------------------

def column_traits(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Traits of every candidate column of a sweep, one line per column."""
    keys = list(keys)
    rows = df.select(*keys, *order, *[F.col(c).cast("double").alias(f"_c_{c}") for c in columns])
    logs = {c: F.when(F.col(f"_c_{c}") > 0, F.log10(F.when(F.col(f"_c_{c}") > 0, F.col(f"_c_{c}")))) for c in columns}
    steps = {}
    for c in columns:
        steps[f"_d_{c}"] = lambda w, v=F.col(f"_c_{c}"): v - F.lag(v).over(w)
        steps[f"_l_{c}"] = lambda w, lg=logs[c]: lg - F.lag(lg).over(w)
    rows = Ordered(rows, keys, list(order)).frame(steps)

    def traits(c: str, position: int) -> Column:
        v, step = F.col(f"_c_{c}"), F.col(f"_l_{c}")
        return F.struct(
            F.lit(c).alias("column"), F.count(v).alias("n"), F.avg((v >= 0).cast("double")).alias("positive"), F.max(F.abs(v)).alias("max_abs"),
            F.min(F.abs(v)).alias("min_abs"), F.abs(F.avg(F.signum(f"_d_{c}"))).alias("monotone"),
            F.when(F.avg(step) != 0, F.abs(F.try_divide(F.stddev_pop(step), F.avg(step)))).alias("log_spread"), F.lit(position).cast("long").alias("position"),
        )

    # All columns share the order of the rows, so these are sorted once and not once a column.
    base = rows.groupBy(*keys).agg(F.array(*[traits(c, k) for k, c in enumerate(columns, 1)]).alias("_t"), F.count(F.lit(1)).alias("_rows")).where("_rows > 0")
    return base.select(*keys, F.explode("_t").alias("_t")).select(*keys, "_t.*")


def infer_roles(traits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """freq, real/imag or mag/phase for the columns of every dataset.

    Frequency: positive, strictly monotone, with the most even log spacing.
    Phase: the column within +-360 degrees (or +-pi/2 ... rad) that is mostly
    negative while a positive companion is larger. Otherwise the two others
    are real and imaginary by sign and order. The windows run over the few
    columns of one dataset.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    able = (F.col("positive") == 1) & (F.col("monotone") > 0.95)
    rank = F.row_number().over(w.orderBy((~able).cast("int"), F.coalesce("log_spread", F.lit(1e9)), "position"))
    rows = traits.withColumn("_f", F.when((rank == 1) & able, True).otherwise(False))
    rest = rows.where(~F.col("_f"))
    rk = F.row_number().over(w.orderBy(F.col("positive").desc(), "position"))
    rest = rest.withColumn("_k", rk)
    second = F.max(F.when(F.col("_k") == 2, F.struct("max_abs", "positive"))).over(w)
    first = F.max(F.when(F.col("_k") == 1, F.struct("max_abs", "positive"))).over(w)
    polar = (first["positive"] == 1) & (second["max_abs"] <= 360) & (
        ((second["max_abs"] > 3.2) & (second["max_abs"] <= 91)) | (second["max_abs"] <= 1.6)) & (first["max_abs"] > 10 * second["max_abs"])
    role = F.when(F.col("_k") == 1, F.when(polar, "mag").otherwise("real")).when(F.col("_k") == 2, F.when(polar, "phase").otherwise("imag"))
    out = rest.select(*keys, "column", role.alias("role")).where(F.col("role").isNotNull())
    return rows.where("_f").select(*keys, "column", F.lit("freq").alias("role")).unionByName(out)
