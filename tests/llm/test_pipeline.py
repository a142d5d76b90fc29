"""The corpus pipeline: every stage and the whole on a small corpus with nulls, copies and empty tables."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string"
PASSAGE = " ".join(f"passage{k}" for k in range(20))


def words(seed, n=80):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 4000, n))


def corpus():
    """(id, text, role in the test)"""
    rows = [(i, words(i), "plain") for i in range(40)]
    rows += [(100, words(3), "copy"), (101, words(3) + " end", "copy"), (102, None, "plain"), (103, "", "plain"), (104, "short text", "plain")]
    rows += [(110, f"{words(50, 20)} {PASSAGE} {words(51, 20)}", "contaminated"), (120, f"{words(60)} password = abcdefgh12 {words(61, 10)}", "secret")]
    rows += [(200 + i, f"{words(70 + i, 30)} vileslur vileslur vileslur", "toxic") for i in range(40)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows = corpus()
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "n") for i, t, _ in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(kind == "toxic")) for i, t, kind in rows if t], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_are_the_named_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]


def test_toxicity_stage(spark, docs, folder):
    out = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert out.columns == docs.columns
    assert ids(out) == sorted(i for i, _, kind in corpus() if kind != "toxic")


def test_near_dedup_stage(spark, docs, folder):
    out = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert sorted(out.columns) == sorted(docs.columns)

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}

    rows = [(i, shingles(t)) for i, t, _ in corpus()]
    group = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if i < j and a and b and 100 * len(a & b) >= 85 * len(a | b):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert ids(out) == sorted(i for i, g in group.items() if i == g)


def test_decontamination_stage(spark, docs, folder):
    out = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert out.columns == docs.columns
    assert ids(out) == sorted(i for i, _, kind in corpus() if kind != "contaminated")


def test_secrets_stage(spark, docs, folder):
    out = {r["doc_id"]: r for r in corpus_pipeline.mask_secrets(spark, docs, folder).collect()}
    for i, text, kind in corpus():
        if kind == "secret":
            assert "abcdefgh12" not in out[i]["text"] and out[i]["n_chars"] == len(out[i]["text"])
        else:
            assert out[i]["text"] == text


def test_repeated_rows_and_empty_tables(spark, docs, folder):
    twice = docs.union(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert ids(stage(spark, docs.limit(0), folder)) == []
        kept = ids(stage(spark, twice, folder))
        assert kept == sorted(ids(stage(spark, docs, folder)) * (1 if name == "near_dedup" else 2)) or name == "near_dedup" and set(kept) == set(ids(stage(spark, docs, folder)))


def test_whole_pipeline(spark, docs, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    left = [(i, t) for i, t, kind in corpus() if kind not in ("toxic", "contaminated", "copy")]
    assert {r["doc_id"] for r in out} == {i for i, _ in left}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {r["doc_id"]: r for r in out}
    for i, text in left:
        if i != 120:
            tokens = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
            assert (pieces[i]["length"], pieces[i]["ids_crc32"]) == (len(tokens), zlib.crc32(tokens.tobytes()))
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for at, size in sorted(parts):
            assert at == end
            end += size
        assert end <= 2048
