"""Benchmark decontamination with a distributed positional inverted index.

Column functions and joins only. Test texts become windows of consecutive
words. The corpus frequency of every test term picks the rarest terms of each
window; their postings (term, document, position) are stored. Offset-adjusted
lists are intersected, and what is left is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galvanite.llm.shared import ascii_lower, staged

NO_ID = -(1 << 63)
SMALL_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased words; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def checked_broadcast(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Broadcast a written table of at most `limit` lines; a larger one joins by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def keyed(docs: DataFrame) -> DataFrame:
    """id0 and h name a row by its id (null has a mark of its own) and text, so repeated rows share a key."""
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id0"), F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("words"))


def test_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """wid, window (words), items: distinct windows of the test texts; a shorter text is one window."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    rows = items.select("item", "words", F.explode(starts).alias("s")).select("item", F.slice("words", F.col("s"), F.lit(size)).alias("window"))
    return rows.groupBy("window").agg(F.collect_set("item").alias("items")).withColumn("wid", F.xxhash64("window"))


def corpus_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings term, id0, h, pos of the given terms."""
    words = keyed(docs).select("id0", "h", F.posexplode("words").alias("pos", "term"))
    return words.join(checked_broadcast(terms), "term")


def rarest_terms(docs: DataFrame, windows: DataFrame, lists: int) -> DataFrame:
    """wid, window, term, off, nth: the rarest places of each window by corpus frequency.

    A window with a term that the corpus lacks cannot occur and is left out.
    """
    places = windows.select("wid", F.posexplode("window").alias("off", "term"))
    terms = staged(places.select("term").distinct(), "terms")
    seen = keyed(docs).select(F.explode("words").alias("term")).join(checked_broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("freq"))
    counted = places.join(seen, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    rank = Window.partitionBy("wid").orderBy("freq", "off")
    counted = counted.withColumn("nth", F.row_number().over(rank)).withColumn("least", F.min("freq").over(Window.partitionBy("wid")))
    return counted.where((F.col("least") > 0) & (F.col("nth") <= lists)).select("wid", "term", "off", "nth")


def candidates(docs: DataFrame, windows: DataFrame, lists: int = 3) -> DataFrame:
    """id0, h, wid, start where the rarest terms of a window all stand at their offsets."""
    anchors = staged(rarest_terms(docs, windows, lists), "anchors")
    postings = staged(corpus_index(docs, anchors.select("term").distinct()), "postings")
    moved = postings.join(checked_broadcast(anchors), "term").select("id0", "h", "wid", (F.col("pos") - F.col("off")).alias("start"), "off").where("start >= 0")
    need = anchors.groupBy("wid").agg(F.count("*").alias("need"))
    # Bits of distinct offsets, so that repeated rows do not count twice.
    met = moved.groupBy("id0", "h", "wid", "start").agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("bits"))
    return met.join(checked_broadcast(need), "wid").where(F.bit_count("bits") >= F.col("need")).select("id0", "h", "wid", "start")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, size: int = 13, lists: int = 3) -> DataFrame:
    """id0, h, hits: array of (start, stop, items) of exact window occurrences per document that has any."""
    if size > 63:
        raise ValueError("windows of at most 63 words")
    windows = staged(test_windows(benchmark, size), "windows")
    found = candidates(docs, windows, lists).join(checked_broadcast(windows), "wid")
    per_doc = found.groupBy("id0", "h").agg(F.collect_list(F.struct("start", "window", "items")).alias("c"))
    full = keyed(docs).drop("doc_id").join(per_doc, ["id0", "h"])
    same = F.filter("c", lambda c: F.slice(F.col("words"), c["start"] + 1, F.size(c["window"])) == c["window"])
    spans = F.array_sort(F.transform(same, lambda c: F.struct(c["start"].alias("start"), (c["start"] + F.size(c["window"])).alias("stop"), c["items"].alias("items"))))
    return full.select("id0", "h", spans.alias("hits")).where(F.size("hits") > 0).dropDuplicates(["id0", "h"])


def proximity_matches(docs: DataFrame, benchmark: DataFrame, size: int = 13, lists: int = 3, slop: int = 4) -> DataFrame:
    """doc_id, wid, start, spread: windows whose rarest terms stand at their offsets give or take `slop` words.

    Adjusted positions fall into cells of `slop` + 1 words; a cell and the next
    one are looked at together, so nothing within the slop is missed.
    """
    windows = staged(test_windows(benchmark, size), "windows")
    anchors = staged(rarest_terms(docs, windows, lists), "anchors")
    postings = corpus_index(docs, anchors.select("term").distinct())
    at = postings.join(checked_broadcast(anchors), "term").select("id0", "wid", "off", (F.col("pos") - F.col("off")).alias("start"))
    cell = F.floor(F.col("start") / (slop + 1))
    both = at.withColumn("cell", F.explode(F.array(cell, cell - 1)))
    per_term = both.groupBy("id0", "wid", "cell", "off").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    met = per_term.groupBy("id0", "wid", "cell").agg(F.count("*").alias("n"), F.max("low").alias("last"), F.min("high").alias("first"))
    need = anchors.groupBy("wid").agg(F.count("*").alias("need"))
    near = met.join(need, "wid").where((F.col("n") == F.col("need")) & (F.col("last") - F.col("first") <= slop))
    return near.groupBy(F.nullif("id0", F.lit(NO_ID)).alias("doc_id"), "wid").agg(F.min(F.least("first", "last")).alias("start"), F.min(F.abs(F.col("last") - F.col("first"))).alias("spread"))


def judge_documents(docs: DataFrame, benchmark: DataFrame, size: int = 13, lists: int = 3) -> DataFrame:
    """Word counts and contamination per row of `docs`, with id0 and h for joins.

    Null texts have no words and are clean; null ids stay; repeated rows get
    equal results; without test items nothing is hit.
    """
    hits = phrase_matches(docs, benchmark, size, lists)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(s["stop"] - F.greatest(s["start"], a["to"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["to"], s["stop"]).cast("long").alias("to"))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda s: s["items"]))))
    counted = hits.select("id0", "h", F.aggregate("hits", zero, step)["n"].alias("n_hit"), items.alias("items"))
    out = keyed(docs).select("doc_id", "id0", "h", F.size("words").cast("long").alias("n_words")).join(counted, ["id0", "h"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumns({
        "n_items": F.size(items).cast("long"), "items_sha256": F.sha2(F.array_join(items, ","), 256)})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("items")
