"""BPE, conversation repair and centroid clustering against the library, brute force and exact arithmetic."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from galvanite.llm import bpe, orchard, turns
from tests.conftest import SF

# BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def same(library, text):
    ids = bpe.encoder().encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    return np.frombuffer(ids, "<u4").tolist() == want and bpe.encoder().decode(ids).decode() == library.decode(want, skip_special_tokens=False)


ODD = ["", " ", "a" * 5000, "ab" * 3000 + "'", "Hello <|endoftext|>World's <|startoftext|><|endoftext|>", "ΣΑΣ İI ΟΔΟΣ", "a\x1cb\x85c᠎d", "</w> x</w>", "ﬁ é é",
       "Ƛ Ᲊ \U00010d50x", "it'S we'LL 12345 ͸", "😀😀👩‍👩‍👧", "\x00\x01", "don''t 's's", "ñandú 東京都 한국어 עברית العربية"]


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_bpe_odd_texts(library, text):
    assert same(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_bpe_any_text(library, text):
    assert same(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aaabbcdeehilnorstuthe'", max_size=60))
def test_bpe_merge_heavy_text(library, text):
    assert same(library, text)


def test_bpe_every_character(library):
    """All code points, in texts of 64: also those whose properties this Python does not know."""
    for at in range(0, 0x110000, 64):
        text = "".join(chr(c) + "a" for c in range(at, at + 64) if not 0xD800 <= c < 0xE000)
        assert same(library, text), hex(at)


def merged(table, ids):
    """Plain merging, the lowest rank first, the leftmost of equals."""
    ids = list(ids)
    while found := [(table.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in table.rank]:
        rank, i = min(found)
        ids[i:i + 2] = [table.made[rank]]
    return ids


def test_pair_table_against_plain_merging():
    merges = [(0, 0, 3), (3, 0, 4), (0, 1, 5), (1, 2, 6), (5, 2, 7), (3, 3, 8), (6, 6, 9), (4, 6, 10)]
    table = bpe.PairTable(merges)
    table.made = [c for _, _, c in merges]
    letters = lambda t: [t] if t not in table.parts else letters(table.parts[t][1]) + letters(table.parts[t][2])
    for a in range(11):
        for b in range(11):
            assert table.compatible(a, b) == (merged(table, letters(a) + letters(b)) == [a, b]), (a, b)


def test_bpe_refuses_other_files():
    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        bpe.PairTable([(0, 0, 1), (1, 1, 2), (1, 0, 3), (0, 1, 3)])


def test_bpe_documents(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Same text", "x"), (3, "Same text", "x"), (None, "word " * 60_000, "x"), (4, "A <|endoftext|>", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digest_documents(docs).collect()), key=repr)
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.digest_documents(docs.limit(0)).count() == 0
    back = docs.select(bpe.decode_column(bpe.encode_column(docs["text"])).alias("t")).collect()
    assert [r["t"] for r in back][:3] == ["", "", "same</w> text</w>"]


def test_bpe_all_documents(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["ids_sha256"] for r in bpe.digest_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for r in rows:
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids, dtype="<u4")
        assert got[r["doc_id"]] == hashlib.sha256(ids.tobytes()).hexdigest()


# conversations

STEP = {0: 2, 1: 2, 2: 3, 3: 2}
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """(cost, least edits) by comparing all pairs of cost and edits, from behind."""
    far = (10**9, "")

    def inserted(e):
        b = list(e)
        b[2], b[3] = min(e[2], (2 + e[3][0], "I" + e[3][1])), min(e[3], (2 + e[2][0], "I" + e[2][1]))
        return [min(e[q], (2 + b[2][0], "I" + b[2][1])) for q in (0, 1)] + b[2:]

    best = inserted([(0, ""), far, far, (0, "")])
    for first, fault in reversed(rows):
        now = []
        for q in range(4):
            ways = [(3 + best[q][0], "D" + best[q][1])]
            if fault not in ("b", "d"):
                add = int(fault == "t")
                if (q, first) in KEEPS:
                    c, s = best[KEEPS[q, first]]
                    ways.append((add + c, "K" + s))
                c, s = best[STEP[q]]
                ways.append((2 + add + c, "R" + s))
            now.append(min(ways))
        best = inserted(now)
    return best[0]


def repaired_by_hand(rows):
    by, out = {}, {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r, x))
    for c, each in by.items():
        d = []
        for t, r, x in each:
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            r, x = " " if r is None else r, " " if x is None else x
            x = "" if k == 1 else "".join(ch for ch in x if ch not in ".!?") if k == 2 else x
            d += [(t, "user" if k == 4 else r, x)] * (k != 0) * (1 + (k == 3))
        d.sort(key=lambda e: (e[0] is not None, e[0] or 0, e[1].encode(), e[2].encode()))
        seen, faults = set(), []
        for _, r, x in d:
            y = x.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not y else "d" if (r, x) in seen else "t" if y[-1] not in ".!?" else "")
            seen.add((r, x))
        firsts = [r[:1] or " " for _, r, _ in d]
        ts = [t for t, _, _ in d if t is not None]
        cost, audit = cheapest(list(zip(firsts, faults)))
        q, at, body = 0, iter(range(len(d))), []
        for e in audit:
            i = None if e == "I" else next(at)
            if e == "D":
                continue
            q = KEEPS[q, firsts[i]] if e == "K" else STEP[q]
            body.append((d[i][1] if e == "K" else "user" if q == 2 else "assistant") + ":" + (d[i][2] if i is not None else ""))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        out[c] = (max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest())
    return out


def repaired(df, **how):
    return {r["conv_id"]: tuple(r)[1:] for r in turns.repair_conversations(df, **how).collect()}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suatx "), st.sampled_from(["", "b", "d", "t"])), max_size=14))
def test_auction_is_exact(rows):
    lattice = turns.Lattice(rows, turns.TO_GO)
    cost = lattice.auction(0)
    edits, state = lattice.trace(0)
    assert (cost, edits + "I" * (turns.TO_GO[state] // 2)) == cheapest(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suat"), st.sampled_from(["", "b", "t"])), min_size=2, max_size=10), st.integers(1, 9))
def test_costs_of_stretches_chain(rows, cut):
    cut = min(cut, len(rows) - 1)
    whole = turns.costs_between(rows)
    assert turns.chained(turns.costs_between(rows[:cut]), turns.costs_between(rows[cut:])) == whole
    assert turns.backward(whole, turns.TO_GO)[0] == cheapest(rows)[0]


@pytest.fixture(scope="module")
def talk(spark):
    """Nulls everywhere, ties, repeated rows, foreign roles, conversations of one to hundreds of rows; more columns of clashing names."""
    rng = random.Random(3)
    rows = []
    for c in [None, *range(40)]:
        for _ in range(rng.choice([1, 2, 3, 8, 40, 150])):
            role = rng.choice(["system", "tool", None, "", "unknown", *["user", "assistant"] * 4])
            rows.append((c, rng.choice([None, *range(60)]), role, rng.choice(["Hi.", "Yes!", "what", " \t", "", None, "end ", "é.\n", *[f"t{i}." for i in range(40)]])))
    rows += [(99, t, "user", "same text.") for t in range(120)] + rows[:40]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, b int")


def test_repair_against_brute_force(talk):
    rows, df = talk
    want = repaired_by_hand(rows)
    assert repaired(df) == want
    assert repaired(df, rows_per_block=5, fan=3, limit=50) == want


def test_repair_without_rows(spark):
    gone = [(c, t) for c in range(300) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][0]
    df = spark.createDataFrame([(*gone, "user", "x.")], "conv_id long, turn long, role string, text string")
    assert repaired(df) == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert turns.repair_conversations(df.limit(0)).count() == 0


# clustering


def nearest(x, centroids):
    return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centroids))


def clustered(rows, k, dims, rounds, seed="2:", scale=256):
    """Exact clustering in Python integers."""
    use = [(i, e, [math.floor(scale * x) if abs(x) < 2**52 else int(x) * scale for x in e]) for i, e in rows
           if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(use, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest(), r[1]))
    cents = [r[2] for r in order[:k]]
    for _ in range(rounds):
        own = [[] for _ in cents]
        for _, _, v in use:
            own[nearest(v, cents)[1]].append(v)
        cents = [[sum(col) // len(o) for col in zip(*o)] if o else c for o, c in zip(own, cents)]
    got = [(i, *nearest(v, cents)[::-1]) for i, _, v in use]
    held = lambda n: min(n, 2**63 - 1)
    return sorted(((i, c, held(d), held(sum(held(e) for _, g, e in got if g == c)), held(sum(held(e) for _, _, e in got)), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in got), key=repr)


def report(spark, rows, **how):
    df = spark.createDataFrame([(i, e, "x", 7) for i, e in rows], "vec_id long, embedding array<double>, n string, cluster int")
    return sorted(map(tuple, orchard.cluster_report(df, **how).collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=1, max_size=9), st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=1, max_size=30))
def test_orchard_search_with_ties(centroids, points):
    at, far, made = orchard.Neighbours(np.array(centroids)).search(np.array(points))
    assert list(zip(far.tolist(), at.tolist())) == [nearest(p, centroids) for p in points]
    assert made <= len(points) * len(centroids)


def test_orchard_skips_far_centroids():
    rng = np.random.default_rng(1)
    centres = rng.integers(-10_000, 10_000, (60, 4))
    points = centres[rng.integers(0, 60, 500)] + rng.integers(-20, 20, (500, 4))
    _, _, made = orchard.Neighbours(centres).search(points)
    assert made < 500 * 60 / 2


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 4).tolist()) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, [0.5] * 4), (None, [0.25] * 4), (100, None), (101, []), (102, [1.0] * 3), (103, [1.0, None, 1.0, 1.0]), (104, [float("nan")] * 4), (105, [float("inf"), 0.0, 0.0, 0.0]),
             (106, [-0.0] * 4), (107, [2.0**-60] * 4), (108, [-(2.0**-60)] * 4)]
    assert report(spark, rows, k=6, dims=4, rounds=3) == clustered(rows, 6, 4, 3)
    assert report(spark, rows[:3], k=6, dims=4, rounds=3) == clustered(rows[:3], 6, 4, 3)
    assert report(spark, [(1, None)], k=6, dims=4) == []


def test_clusters_of_huge_vectors(spark):
    rows = [(i, [float(i) * s, 1.0, -(2.0**40)]) for i in range(8) for s in (1.0, 1e9, 1e30, 1e300)]
    assert report(spark, rows, k=5, dims=3, rounds=2) == clustered(rows, 5, 3, 2)


def test_clusters_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = clustered([(r["vec_id"], list(r["embedding"])) for r in df.collect()], 40, 64, 5)
    assert sorted(map(tuple, orchard.cluster_report(df).collect()), key=repr) == want
