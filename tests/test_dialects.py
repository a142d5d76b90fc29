"""Mixed delimited files, line numbers across file splits, text blocks."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from galvanite.sources import readers as R


def cells_of(spark, datasets, **how):
    rows = [(d, i, line) for d, lines in datasets.items() for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "d string, i long, line string")
    out = collections.defaultdict(dict)
    for r in R.parse_delimited(df, ["d"], ["i"], **how).collect():
        out[r["d"], r["i"]][r["name"]] = r["cell"]
    return dict(out)


def test_each_dataset_has_its_own_dialect(spark):
    got = cells_of(spark, {
        "semi": ["freq;re;im", "1;2.5;3", "10;;-1e3"],
        "comma": ["1,2,3", "4,5,6"],
        "tab": ["a\tb", "1\t", "3\t4"],
        "blanks": ["x   y z", " 1  2   3 ", "4 5 6"],
        "one": ["value", "1.5", "2.5"],
        "quoted": ['name|note', '"a|b"|"say ""hi"""', '|"|"', "plain|text"],
        "multi": ["re|im", "ohm|", "|", "1|2"],
        "empty": ["", "  "],
        "late": ["", "p;q", "", "1;2"],
    })
    assert got["semi", 1] == {"freq": "1", "re": "2.5", "im": "3"} and got["semi", 2] == {"freq": "10", "im": "-1e3"}
    assert got["comma", 0] == {"0": "1", "1": "2", "2": "3"} and got["comma", 1]["2"] == "6"
    assert got["tab", 1] == {"a": "1"} and got["tab", 2] == {"a": "3", "b": "4"}
    assert got["blanks", 1] == {"x": "1", "y": "2", "z": "3"}
    assert got["one", 1] == {"value": "1.5"}
    assert got["quoted", 1] == {"name": "a|b", "note": 'say "hi"'} and got["quoted", 2] == {"note": "|"} and got["quoted", 3] == {"name": "plain", "note": "text"}
    assert got["multi", 3] == {"re_ohm": "1", "im": "2"}
    assert got["late", 3] == {"p": "1", "q": "2"}
    assert not [k for k in got if k[0] == "empty" or k in (("semi", 0), ("multi", 1), ("late", 1))]


def test_no_prefix_decides(spark):
    """The separator is the most frequent one of all lines, not of the first ones; ties go to the one seen first."""
    lines = ["a|b"] * 15 + ["1;2;3;4"] * 30
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)] + [("t", 0, "x;y|z"), ("n", 0, "word")], "d string, i long, line string")
    assert {r["d"]: r["sep"] for r in R.infer_separators(df, ["d"], ["i"]).collect()} == {"d": ";", "t": ";", "n": ","}


def test_dialects_keep_few_lines_before_the_shuffle(spark):
    df = spark.range(100_000).select((F.col("id") % 3).alias("d"), F.col("id").alias("i"), F.lit("1;2").alias("line"))
    plan = R.infer_dialects(df, ["d"], ["i"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert {(r["sep"], r["header_lines"]) for r in R.infer_dialects(df, ["d"], ["i"]).collect()} == {(";", 0)}


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1;2;3\n4;5;6\n")
    (tmp_path / "y.csv").write_text("k,v\n7,a\n8,b\n")
    (tmp_path / "z.csv").write_text("k\tv\tw\n9\tc\t2.5\n")
    df = R.read_delimited(spark, str(tmp_path), glob="*.csv")
    assert dict(df.dtypes) == {"0": "bigint", "1": "bigint", "2": "bigint", "k": "bigint", "v": "string", "w": "double", "dataset_id": "string"}
    got = {(r["dataset_id"], r["0"], r["k"], r["v"], r["w"]) for r in df.collect()}
    assert got == {("x", 1, None, None, None), ("x", 4, None, None, None), ("y", None, 7, "a", None), ("y", None, 8, "b", None), ("z", None, 9, "c", 2.5)}
    typed = R.read_delimited(spark, str(tmp_path), schema="a double, b string", glob="*.csv")
    assert sorted(map(tuple, typed.collect())) == [(1.0, "2", "x"), (4.0, "5", "x"), (7.0, "a", "y"), (8.0, "b", "y"), (9.0, "c", "z")]
    plain = R.read_delimited(spark, str(tmp_path), ",", True, "k long, v string", "y.csv")
    assert sorted(map(tuple, plain.collect())) == [(7, "a", "y"), (8, "b", "y")]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def long_files(tmp_path):
    texts = {"a.txt": "sample: glass\narea = 25\n\n" + "".join(f"{i},{i * 2},{i * 3}\n" for i in range(400)), "b.txt": "\n".join(f"line {i} é" if i % 5 else "" for i in range(300)), "c.txt": "only"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    return texts


def test_line_numbers_across_splits(spark, tmp_path, small_splits):
    texts = long_files(tmp_path)
    df = R.numbered_lines(spark, str(tmp_path))
    assert df.select("file_path").distinct().count() == 3 and R.scan_text(spark, str(tmp_path)).select("block_start").distinct().count() > 5
    got = {(r["dataset_id"], r["line_no"]): r["line"] for r in df.collect()}
    assert got == {(name[0], i): line for name, text in texts.items() for i, line in enumerate(text.rstrip("\n").split("\n"))}
    # A filter above must not change the numbers.
    assert {r["line_no"]: r["line"] for r in df.where("dataset_id = 'a' AND line_no >= 200").collect()} == {i: x for (d, i), x in got.items() if d == "a" and i >= 200}


def blocks_of(spark, path, sep):
    return sorted(map(tuple, R.split_text_blocks(spark, path, sep, "*.txt").select("dataset_id", "line_no", "line", "sep", "seps", "block", "block_lines", "is_data").collect()))


@pytest.mark.parametrize("sep", [",", None])
def test_blocks_do_not_depend_on_splits(spark, tmp_path, sep):
    long_files(tmp_path)
    whole = blocks_of(spark, str(tmp_path), sep)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        split = blocks_of(spark, str(tmp_path), sep)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert whole == split and {r[0] for r in whole} == {"a", "b", "c"}
    data = [r for r in whole if r[0] == "a" and r[-1]]
    assert len(data) == 400 and all(re.fullmatch(r"\d+,\d+,\d+", r[2]) for r in data)
    seps = {r[0]: r[3] for r in whole}
    assert seps == ({"a": ",", "b": " ", "c": ","} if sep is None else dict.fromkeys("abc", ","))
    values = R.data_block_values(R.split_text_blocks(spark, str(tmp_path), sep, "*.txt").where("dataset_id = 'a'"), ["dataset_id"], sep, ["x", "y", "z"])
    assert values.agg(F.sum("z"), F.count("*")).first()[:] == (3 * 399 * 200.0, 400)
