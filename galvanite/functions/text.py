"""Text functions: search patterns, names, numbers, common parts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from galvanite.keyed import attach
from galvanite.session import cut_lineage

# Engineering prefixes, readable bytes encodings, condition names.
ENGINEERING = {-15: "f", -12: "p", -9: "n", -6: "u", -3: "m", 0: "", 3: "k", 6: "M", 9: "G", 12: "T"}
CONDITIONS = ("pre", "dh", "dry", "dryout")


def has_term(text: Column, term: str, regex: bool = True) -> Column:
    """One search term: `a|b` is OR, `not x` excludes; case is ignored."""
    if term.startswith("not "):
        return ~has_term(text, term[4:].strip(), regex)
    body = term.strip() if regex else re.escape(term.strip())
    return text.rlike("(?is)" + body)


def search(text: Column, terms: Sequence[str] | str, reject: Sequence[str] = (), regex: bool = True) -> Column:
    """All terms hold; the common reject terms are added to every search."""
    parts = [terms] if isinstance(terms, str) else list(terms)
    cond = F.lit(True)
    for t in [*parts, *reject]:
        cond = cond & has_term(text, t, regex)
    return cond


def search_pattern(terms: Sequence[str] | str, regex: bool = True) -> str:
    """The same search as one pattern of lookaheads for `rlike`."""
    out = "(?is)^"
    for t in [terms] if isinstance(terms, str) else terms:
        neg = t.startswith("not ")
        body = (t[4:] if neg else t).strip()
        body = body if regex else re.escape(body)
        out += f"(?!.*(?:{body}))" if neg else f"(?=.*(?:{body}))"
    return out


def route(text: Column, groups: dict[str, Sequence[str] | str], reject: Sequence[str] = (), rest: str = "residuals") -> Column:
    """Name of the first group whose search holds."""
    out = None
    for name, terms in groups.items():
        cond = search(text, terms, reject)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.coalesce(out, F.lit(rest)) if out is not None else F.lit(rest)


def slug(text: Column, sep: str = "-") -> Column:
    """Lower case, word characters only, runs of blanks and dashes joined."""
    plain = F.regexp_replace(F.lower(ascii_fold(text)), r"[^A-Za-z0-9_\s-]", "")
    joined = F.regexp_replace(plain, rf"[{re.escape(sep)}\s-]+", sep)
    return F.regexp_replace(joined, r"^[-_]+|[-_]+$", "")


# Accented Latin letters and their plain forms, in order.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def ascii_fold(text: Column) -> Column:
    """Plain letters for accented ones; other non-ASCII characters are dropped."""
    return F.regexp_replace(F.translate(text, ACCENTED, UNACCENTED), r"[^\x00-\x7F]", "")


def decode_bytes(data: Column) -> Column:
    """UTF-8 text of bytes, else single-byte text."""
    utf = F.try_validate_utf8(data) if hasattr(F, "try_validate_utf8") else F.decode(data, "UTF-8")
    return F.coalesce(utf.cast("string"), F.decode(data, "ISO-8859-1"))


def typed_value(text: Column) -> Column:
    """Text read as a value: struct(kind, number, flag, items)."""
    t = F.trim(text)
    num = t.try_cast("double")
    low = F.lower(t)
    flag = F.when(low == "true", True).when(low == "false", False)
    inner = F.regexp_extract(t, r"^[\[\(](.*)[\]\)]$", 1)
    items = F.when(inner != "", F.transform(F.split(inner, r"\s*,\s*"), lambda x: F.trim(x).try_cast("double")))
    kind = (
        F.when(t.isNull() | low.isin("none", ""), "null")
        .when(flag.isNotNull(), "bool")
        .when(num.isNotNull() & (F.floor(num) == num), "int")
        .when(num.isNotNull(), "float")
        .when(items.isNotNull(), "list")
        .otherwise("text")
    )
    return F.struct(kind.alias("kind"), num.alias("number"), flag.alias("flag"), items.alias("items"))


def exact_text(x: Column, pattern: str) -> Column:
    """Number in a format like `.2E`, rounded from its exact binary value, ties to even, as C's printf does.

    Java's formatter rounds the shortest decimal text of a number instead, ties up.
    """

    @pandas_udf("string")
    def write(values: pd.Series) -> pd.Series:
        return values.map(lambda v: format(v, pattern))

    x = x.cast("double")
    return F.when(F.abs(x) < float("inf"), write(x)).otherwise(x.cast("string"))


def scientific(x: Column, precision: int = 2) -> Column:
    return exact_text(x, f".{int(precision)}E")


def engineering(x: Column, precision: int = 2, space: str = "") -> Column:
    """Mantissa with a prefix of a power of 1000; other values as text."""
    x = x.cast("double")
    ok = (x > 0) & (x < float("inf"))
    lg = F.log10(F.when(ok, x))
    power = (F.floor(lg / 3) * 3).cast("int")
    prefixes = F.create_map(*[F.lit(v) for kv in ENGINEERING.items() for v in kv])
    body = exact_text(F.pow(F.lit(10.0), lg - power), f".{int(precision)}f")
    return F.when(ok, F.concat(body, F.lit(space), F.coalesce(prefixes[power], F.concat(F.lit("e"), power.cast("string"))))
                  ).otherwise(x.cast("string"))


def general_number(x: Column, precision: int = 2, upper: int = 3, lower: int | None = None) -> Column:
    """Plain text for moderate exponents, else mantissa and exponent."""
    x = x.cast("double")
    lower = -upper if lower is None else lower
    power = F.when(x != 0, F.floor(F.log10(F.abs(F.nullif(x, F.lit(0.0)))))).otherwise(0).cast("int")
    digits = F.greatest(F.lit(0), precision - power)
    fixed = None
    for d in range(0, precision - lower + 1):
        cell = F.format_string(f"%.{d}f", x)
        fixed = F.when(digits == d, cell) if fixed is None else fixed.when(digits == d, cell)

    def strip(c: Column) -> Column:
        return F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, r"\.?0+$", "")).otherwise(c)

    plain = F.when(F.floor(x) == x, F.format_string("%d", x.cast("long"))).otherwise(strip(fixed))
    mantissa = strip(F.format_string(f"%.{precision}f", x / F.pow(F.lit(10.0), power)))
    inside = (power > lower) & (power < upper)
    return F.when(inside, plain).otherwise(F.concat(mantissa, F.lit("e"), power.cast("string")))


def segment_name_parts(name: Column) -> Column:
    """Parts of `<sample><condition><temp>c_r<run>`; null where it does not fit."""
    pattern = r"^(.*\d)([a-zA-Z]+)(\d{2})c_(r\d+)"
    get = lambda i: F.regexp_extract(name, pattern, i)
    sample = F.trim(get(1))
    sodium = F.when(sample.rlike(r"^\d+$"), round_half_even_tens(sample.try_cast("double")).cast("int")).otherwise(0)
    return F.when(
        name.rlike(pattern),
        F.struct(
            sample.alias("sample_name"), get(2).alias("condition"), get(3).try_cast("double").alias("temp"),
            sodium.alias("sodium"), get(4).alias("run"),
        ),
    )


def round_half_even_tens(x: Column) -> Column:
    return F.bround(x / 10, 0) * 10


def dataset_name_parts(df: DataFrame, name: str, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """Pull parts out of a name in any order.

    Each pattern's first match is taken and blanked before the next pattern is
    tried; the order of the list is the order of precedence.
    """
    text = F.col(name)
    cols = []
    for pattern, part in patterns:
        found = F.regexp_extract(text, f"({pattern})", 1)
        cols.append(F.when(found != "", found).alias(part))
        text = F.regexp_replace(text, f"^(.*?)({pattern})", "$1 ")
    return df.select("*", *cols)


def condition_name(text: Column) -> Column:
    """Condition with synonyms resolved; unknown words give null."""
    low = F.lower(text)
    named = F.when(low.startswith("init"), "pre").when(low.startswith("post"), "dry").otherwise(low)
    return F.when(named.isin(*CONDITIONS), named)


# Run-number patterns in the order they are tried.
RUN_PATTERNS = (
    r"[_-]+r[_-]?(\d+)",
    r"[_-]+run[_-]?(\d+)",
    r"r[_-]?(\d+)",
    r"run[_-]?(\d+)",
    r"[_-]+(\d+)",
    r"(\d+)$",
)
FIT_PATTERNS = (r"[_-]+(f[_-]?\d+)$", r"[_-]+(fit[_-]?\d+)$", r"[_-]+(\d+)$", r"(\d+)$")


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    found = [F.regexp_extract(text, "(?i)" + p, 1) for p in patterns]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def run_number(text: Column) -> Column:
    return F.coalesce(first_match(text, RUN_PATTERNS).try_cast("long"), F.lit(0))


def fit_number(text: Column) -> Column:
    return first_match(text, FIT_PATTERNS)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


RUN_BASE, RUN_MODULUS = 0x9E3779B97F4A7C15F39CC0605CEDC835, (1 << 107) - 1


def run_marks(tokens: Column, length: Column) -> Column:
    """Distinct runs of `length` tokens as (mark, start): rolling hashes of 107 bits, the first start of each."""

    @pandas_udf("array<struct<mark: string, start: int>>")
    def marks(lists: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for toks, m in zip(lists, sizes):
            lead, seen, h = pow(RUN_BASE, int(m), RUN_MODULUS), {}, 0
            own = [int.from_bytes(blake2b(t.encode(), digest_size=13).digest()) for t in toks]
            for i, x in enumerate(own):
                h = (h * RUN_BASE + x) % RUN_MODULUS
                if i >= m:
                    h = (h - own[i - m] * lead) % RUN_MODULUS
                if i + 1 >= m:
                    seen.setdefault(h, i + 1 - m)
            out.append([{"mark": f"{k:x}", "start": at} for k, at in seen.items()])
        return pd.Series(out)

    return marks(tokens, length)


def common_tokens(df: DataFrame, keys: Sequence[str], name: str, sep: str = r"[_\s-]+") -> DataFrame:
    """Longest run of tokens shared by all names of a key; of equal ones the one with the longest text, then the least.

    If a run is shared, so are all parts of it. The length is therefore found
    by bisection, for all keys together: every round counts the rolling
    hashes of the runs of one length per key. A name gives as many hashes as
    it has tokens, and texts of runs are made for one name of a key only.
    """
    keys = list(keys)
    toks = F.filter(F.split(F.col(name), sep), lambda t: t != "")
    names = df.select(*keys, name).distinct().select(*keys, F.col(name).alias("_name"), F.coalesce(toks, F.array().cast("array<string>")).alias("_toks"))
    total = names.groupBy(*keys).agg(F.count(F.lit(1)).alias("names"), F.min(F.size("_toks")).alias("_high"))
    state = cut_lineage(total.select(*keys, "names", F.lit(0).alias("_low"), "_high"))

    def shared(lengths: DataFrame) -> DataFrame:
        """Runs of the length `_m` that all names of a key hold."""
        spread = attach(names, lengths.select(*keys, "names", "_m"), keys, "inner")
        spread = spread.select(*keys, "names", F.explode(run_marks(F.col("_toks"), F.col("_m"))["mark"]).alias("_mark"))
        return spread.groupBy(*keys, "_mark").agg(F.count(F.lit(1)).alias("_k"), F.max("names").alias("_all")).where("_k = _all")

    while not (open_ := state.where("_low < _high")).isEmpty():
        tried = open_.withColumn("_m", F.floor((F.col("_low") + F.col("_high") + 1) / 2).cast("int"))
        hit = shared(tried).select(*keys).distinct().withColumn("_hit", F.lit(True))
        moved = attach(tried, hit, keys).select(
            *keys, "names", F.when(F.col("_hit"), F.col("_m")).otherwise(F.col("_low")).alias("_low"), F.when(F.col("_hit"), F.col("_high")).otherwise(F.col("_m") - 1).alias("_high"))
        state = cut_lineage(state.where("_low >= _high").unionByName(moved))
    found = state.where("_low > 0").withColumn("_m", F.col("_low"))
    marks = shared(found).select(*keys, "_mark")
    one = attach(names.groupBy(*keys).agg(F.min_by("_toks", "_name").alias("_toks")), found.select(*keys, "_m"), keys, "inner")
    runs = one.select(*keys, "_toks", "_m", F.explode(run_marks(F.col("_toks"), F.col("_m"))).alias("_r"))
    runs = attach(runs.withColumn("_mark", F.col("_r.mark")), marks, [*keys, "_mark"], "left_semi")
    runs = runs.select(*keys, F.array_join(F.slice("_toks", F.col("_r.start") + 1, F.col("_m")), "_").alias("run"))
    best = runs.groupBy(*keys).agg(F.min_by("run", F.struct(-F.length("run"), F.col("run"))).alias("common"))
    return attach(total.drop("_high"), best, keys)


def without_common(text: Column, common: Column, sep: str = "_") -> Column:
    """Rest of a name after its common part is removed."""
    rest = F.replace(text, common, F.lit(""))
    return F.regexp_replace(rest, rf"^[{sep}\s]+|[{sep}\s]+$", "")


def path_overlap_trimmed(path: Column, base: Column) -> Column:
    """Path without the leading part that the base ends with."""
    p, b = F.split(path, "/"), F.split(base, "/")
    n = F.least(F.size(p), F.size(b))
    best = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, k: F.when(F.slice(p, 1, k) == F.slice(b, F.size(b) - k + 1, k), k).otherwise(acc),
    )
    return F.array_join(F.slice(p, best + 1, F.greatest(F.size(p) - best, F.lit(0))), "/")


def rename_joined(text: Column, pattern: str, sep: str = "_") -> Column:
    """Name rebuilt from all matches of a pattern, joined; unmatched names stay."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.when(F.size(found) > 0, F.array_join(found, sep)).otherwise(text)
