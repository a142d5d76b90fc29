"""Reading instrument exports: directories, separators, text blocks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galvanite.functions.text import file_stem
from galvanite.keyed import Ordered, attach, with_group

# Characters that never separate columns.
NOT_SEPARATORS = r"[\w.+\-:\"'()\[\]/%\\#]"


def scan_text(spark: SparkSession, path: str | Sequence[str], glob: str | None = None, recursive: bool = False, pattern: str | None = None,
              ignore: str | None = None, whole: bool = False) -> DataFrame:
    """Lines (or whole files) below a directory with their dataset id.

    The glob prunes in the file listing; the patterns test the file name.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.text(list(path) if not isinstance(path, str) else path, wholetext=whole).select("value", "_metadata")
    df = df.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"),
                   F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("modified"),
                   F.col("_metadata.file_block_start").alias("block_start"))
    if pattern:
        df = df.where(F.col("file_name").rlike(pattern))
    if ignore:
        df = df.where(~F.col("file_name").rlike(ignore))
    return df.withColumn("dataset_id", file_stem(F.col("file_name")))


def scan_table(spark: SparkSession, path: str, fmt: str = "parquet", glob: str | None = None, recursive: bool = False, pattern: str | None = None, **options) -> DataFrame:
    """Every file of a format below a directory, one dataset per file stem."""
    reader = spark.read.format(fmt).options(**options).option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    df = df.select("*", F.col("_metadata.file_name").alias("_name"))
    if pattern:
        df = df.where(F.col("_name").rlike(pattern))
    return df.withColumn("dataset_id", file_stem(F.col("_name"))).drop("_name")


def file_stats(df: DataFrame) -> DataFrame:
    """Size and time facts per file."""
    return df.groupBy("dataset_id", "file_path").agg(F.max("file_size").alias("file_size"), F.max("modified").alias("modified"))


def numbered_lines(spark: SparkSession, path: str | Sequence[str], glob: str | None = None, recursive: bool = False, pattern: str | None = None, ignore: str | None = None) -> DataFrame:
    """Lines of text files with their number in the file, from 0.

    Files are read in splits. A split numbers its own lines; where it starts
    follows from the line counts of the splits before it, one line per split.
    So no file has to fit into a task. Rows of a split keep their order in
    the scan, and filters stay above it, since the ids are not deterministic
    for the optimizer.
    """
    lines = scan_text(spark, path, glob, recursive, pattern, ignore).withColumn("_at", F.monotonically_increasing_id())
    splits = lines.groupBy("file_path", "block_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = lines.join(splits.drop("_n"), ["file_path", "block_start"])
    return out.select("dataset_id", "file_path", (F.col("_at") - F.col("_first") + F.col("_before")).alias("line_no"), F.col("value").alias("line"))


def separator_marks(line: Column) -> Column:
    """Characters of a line that may separate columns; runs of white space where it has no such character."""
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    marks = F.regexp_extract_all(F.regexp_replace(text, "(?U)" + NOT_SEPARATORS + r"|\s", ""), F.lit("(?s)."), F.lit(0))
    return F.when(F.size(marks) > 0, marks).otherwise(F.regexp_extract_all(text, F.lit(r"\s+"), F.lit(0)))


def infer_separators(lines: DataFrame, keys: Sequence[str], order: Sequence[str], line: str = "line") -> DataFrame:
    """The most frequent separator of each dataset over all its lines (ties: the one seen first), "," where there is none."""
    keys = list(keys)
    marks = lines.select(*keys, *order, F.posexplode_outer(separator_marks(F.col(line))).alias("_at", "sep"))
    counts = marks.groupBy(*keys, "sep").agg(F.count("sep").alias("_n"), F.min(F.struct(*order, "_at")).alias("_first"))
    best = counts.groupBy(*keys).agg(F.min_by("sep", F.when(F.col("sep").isNotNull(), F.struct(-F.col("_n"), "_first"))).alias("sep"))
    return best.withColumn("sep", F.coalesce("sep", F.lit(",")))


def separator_pattern(sep: Column) -> Column:
    """Pattern of a separator column: blanks stand for any run of white space, all else for itself."""
    return F.when(sep.rlike(r"^\s+$") & (sep != "\t"), F.lit(r"\s+")).otherwise(F.concat(F.lit(r"\Q"), sep, F.lit(r"\E")))


def split_cells(line: Column, sep: Column) -> Column:
    """Trimmed cells of a line; a quoted cell may hold the separator and doubled quotes."""
    pattern = separator_pattern(sep)
    text = F.when(sep.rlike(r"^\s+$") & (sep != "\t"), F.regexp_replace(line, r"^\s+|\s+$", "")).otherwise(F.regexp_replace(line, r"[\r\n]+$", ""))
    plain = F.split(text, pattern)
    # After a separator, one of which is put in front: a quoted text, or whatever comes before the next separator.
    cell = F.concat(F.lit(r"\G"), pattern, F.lit(r'(\s*"(?:[^"]|"")*"\s*(?='), pattern, F.lit(r"|$)|(?:(?!"), pattern, F.lit(r").)*+)"))
    quoted = F.regexp_extract_all(F.concat(sep, text), cell, F.lit(1))
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r'^"(.*)"$', "$1"), '""', '"')
    return F.transform(F.when(F.contains(text, F.lit('"')), quoted).otherwise(plain), clean)


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
MOST_HEADER_LINES = 10


def infer_dialects(lines: DataFrame, keys: Sequence[str], order: Sequence[str], line: str = "line", sep: str | None = None, header: bool | None = None) -> DataFrame:
    """Separator, header lines and column names of each dataset, from all its lines.

    A dataset has several header lines if a line without any value follows
    within the first ten; else one if its first line holds no number. Names
    of several header lines are joined by "_"; columns without one are named
    by their position. Lines of white space only do not count. Everything is
    an aggregate per dataset, so a dataset of any size is combined before the
    shuffle.
    """
    keys, order = list(keys), list(order)
    full = lines.where(F.col(line).rlike(r"\S"))
    seps = full.groupBy(*keys).agg(F.lit(sep).alias("sep")) if sep is not None else infer_separators(full, keys, order, line)
    # Every task keeps the first lines of its own before the shuffle (a group limit of the plan).
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    heads = full.select(*keys, *order, F.col(line).alias("_line"), rank.alias("_r")).where(F.col("_r") <= MOST_HEADER_LINES + 1)
    heads = heads.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, "_line"))).alias("_head"))
    out = attach(heads, seps, keys)
    cells = F.transform("_head", lambda h: split_cells(h["_line"], F.col("sep")))
    empty = F.transform("_cells", lambda row: F.forall(row, lambda c: c == ""))
    gap = F.array_position(empty, True) - 1
    numbers = F.exists(F.get("_cells", F.lit(0)), lambda c: c.rlike(NUMBER))
    count = F.when(gap > 0, gap).when(numbers, 0).otherwise(1) if header is None else F.lit(int(header))
    out = out.withColumn("_cells", cells).withColumn("header_lines", count.cast("int"))
    width = F.array_max(F.transform("_cells", F.size))
    name = lambda i: F.array_join(F.filter(F.transform(F.slice("_cells", 1, F.col("header_lines")), lambda row: F.get(row, i)), lambda c: c.isNotNull() & (c != "")), "_")
    names = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.nullif(name(i), F.lit("")), i.cast("string")))
    return out.select(*keys, "sep", "header_lines", names.alias("names"), F.get("_head", F.col("header_lines")).alias("_body"))


def parse_delimited(lines: DataFrame, keys: Sequence[str], order: Sequence[str], line: str = "line", sep: str | None = None, header: bool | None = None) -> DataFrame:
    """Cells of mixed delimited datasets: keys, order, position, name, cell, number.

    Each dataset is split by its own separator and named by its own header
    (`infer_dialects`); header lines and lines without any value are left
    out, empty cells are null.
    """
    keys, order = list(keys), list(order)
    dialects = infer_dialects(lines, keys, order, line, sep, header)
    rows = attach(lines.select(*keys, *order, F.col(line).alias("_line")).where(F.col("_line").rlike(r"\S")), dialects, keys)
    body = rows.where(F.struct(*order) >= F.struct(*[F.col(f"_body.{c}") for c in order]))
    cells = body.select(*keys, *order, "names", F.posexplode(split_cells(F.col("_line"), F.col("sep"))).alias("position", "cell"))
    name = F.coalesce(F.get("names", F.col("position")), F.col("position").cast("string"))
    cell = F.nullif(F.col("cell"), F.lit(""))
    number = F.when(F.col("cell").rlike(NUMBER), F.col("cell").try_cast("double"))
    return cells.select(*keys, *order, "position", name.alias("name"), cell.alias("cell"), number.alias("number")).where(F.col("cell").isNotNull())


def widen_cells(cells: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per line, one typed column per name: whole numbers, doubles or text, whatever all its cells are.

    Names come in order of their first position; a repeated name of one
    dataset keeps its first cell. Only the names and their types reach the
    driver.
    """
    keys, order = list(keys), list(order)
    whole = F.col("cell").rlike(r"^[+-]?\d+$") & F.col("cell").try_cast("long").isNotNull()
    facts = cells.groupBy("name").agg(F.min("position").alias("p"), F.min(whole).alias("whole"), F.min(F.col("number").isNotNull()).alias("number"))
    found = facts.orderBy("p", "name").collect()
    row = cells.groupBy(*keys, *order).agg(*[F.min_by("cell", F.when(F.col("name") == r["name"], F.col("position"))).alias(f"_c{i}") for i, r in enumerate(found)])
    kind = lambda r: "long" if r["whole"] else "double" if r["number"] else "string"
    return row.select(*[F.col(f"_c{i}").cast(kind(r)).alias(r["name"]) for i, r in enumerate(found)], *keys, *order)


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, header: bool | None = None, schema=None, glob: str | None = None) -> DataFrame:
    """Delimited files, each with its own separator and header; one row per line with dataset_id.

    Columns of all files are united by name. Given separator, header and
    schema nothing has to be inferred and the files are read once.
    """
    if sep is not None and header is not None and schema is not None:
        reader = spark.read.option("sep", sep).option("header", str(header).lower()).option("ignoreLeadingWhiteSpace", "true").schema(schema)
        df = (reader.option("pathGlobFilter", glob) if glob else reader).csv(path)
        return df.select("*", F.col("_metadata.file_name").alias("_name")).withColumn("dataset_id", file_stem(F.col("_name"))).drop("_name")
    lines = numbered_lines(spark, path, glob)
    cells = parse_delimited(lines, ["dataset_id", "file_path"], ["line_no"], "line", sep, header)
    if schema is None:
        return widen_cells(cells, ["dataset_id", "file_path"], ["line_no"]).drop("file_path", "line_no")
    fields = (schema if not isinstance(schema, str) else _parsed(schema)).fields
    row = cells.groupBy("dataset_id", "file_path", "line_no").agg(*[F.min_by("cell", F.when(F.col("position") == i, 0)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])
    return row.select(*[f.name for f in fields], "dataset_id")


def _parsed(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def block_lines(lines: DataFrame, keys: Sequence[str], order: Sequence[str], line: str, sep: str | Column) -> DataFrame:
    """Runs of lines with an equal number of separators (one for all, or a column with that of each line).

    Adds `seps` (separators in the line), `block` and whether the block is
    data: longer than the mean block of its file and more than one separator,
    or the only block there is.
    """
    text = F.col(line)
    if isinstance(sep, str):
        count = ((F.length(text) - F.length(F.replace(text, F.lit(sep), F.lit("")))) / len(sep)).cast("long")
    else:
        count = F.regexp_count(text, separator_pattern(sep)).cast("long")
    rows = lines.withColumn("seps", count)
    first = Ordered(rows, keys, order)
    marked = first.frame({"_prev": lambda w: F.lag("seps").over(w)})
    change = F.coalesce(F.col("seps") != F.col("_prev"), F.lit(False)).cast("long")
    out = Ordered(marked.withColumn("_new", change), keys, order, split=first.split).running({"block": ("sum", F.col("_new"))}).drop("_prev", "_new")
    sizes = out.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("block_lines"), F.max("seps").alias("_s"))
    mean = sizes.groupBy(*keys).agg(F.avg("block_lines").alias("_mean"), F.count(F.lit(1)).alias("_n"))
    is_data = ((F.col("block_lines") > F.col("_mean")) & (F.col("_s") > 1)) | (F.col("_n") == 1)
    sizes = attach(sizes, mean, keys).withColumn("is_data", is_data)
    return attach(out, sizes.select(*keys, "block", "block_lines", "is_data"), [*keys, "block"])


def split_text_blocks(spark: SparkSession, path: str, sep: str | None = None, glob: str | None = None) -> DataFrame:
    """Lines of all text files with their block; one job over the directory.

    Files are read in splits; without `sep` each dataset is split by its own
    most frequent separator, given in the column `sep`.
    """
    lines = numbered_lines(spark, path, glob).where(F.trim("line") != "")
    keys, order = ["dataset_id"], ["file_path", "line_no"]
    if sep is not None:
        return block_lines(lines.withColumn("sep", F.lit(sep)), keys, order, "line", sep)
    return block_lines(attach(lines, infer_separators(lines, keys, order), keys), keys, order, "line", F.col("sep"))


def comment_attributes(blocks: DataFrame, keys: Sequence[str], line: str = "line", mark: str = r"[:=\t]") -> DataFrame:
    """`key<sep>value` lines of comment blocks as (keys, key, value)."""
    text = F.regexp_replace(line, r"^[\s#%;]+", "")
    parts = F.regexp_extract(text, rf"^([^{mark[1:-1]}]+?)\s*{mark}\s*(.*)$", 1)
    value = F.regexp_extract(text, rf"^([^{mark[1:-1]}]+?)\s*{mark}\s*(.*)$", 2)
    return blocks.where(~F.col("is_data")).select(*keys, F.trim(parts).alias("key"), F.trim(value).alias("value")).where(F.col("key") != "")


def data_block_values(blocks: DataFrame, keys: Sequence[str], sep: str | None, columns: Sequence[str], line: str = "line", order: str = "line_no") -> DataFrame:
    """Numeric columns of the data blocks; lines that hold no number drop out. Without `sep` the column of that name is used."""
    cells = F.split(F.col(line), re.escape(sep)) if sep is not None else split_cells(F.col(line), F.col("sep"))
    out = blocks.where("is_data").select(*keys, "block", order, *[F.trim(F.get(cells, F.lit(i))).try_cast("double").alias(c) for i, c in enumerate(columns)])
    return out.dropna(how="all", subset=list(columns))


def latest_versions(df: DataFrame, name: Sequence[str], criteria: Sequence[str]) -> DataFrame:
    """Rows of each name that hold the largest criteria in order, ties kept.

    The maximum of a struct is combined before the shuffle, so a name with
    very many versions needs no ordering.
    """
    top = df.groupBy(*name).agg(F.max(F.struct(*criteria)).alias("_top"))
    return attach(df, top, list(name)).where(F.struct(*criteria) == F.col("_top")).drop("_top")


def read_results(spark: SparkSession, root: str, kind: str, casts: dict[str, str] | None = None) -> DataFrame:
    """Saved result table of a kind; partition columns come back as keys."""
    df = spark.read.parquet(f"{root}/{kind}")
    for c, t in (casts or {"temp": "double", "sodium": "int", "segment": "int", "fit_no": "int"}).items():
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast(t))
    return df
