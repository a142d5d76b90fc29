"""Token pieces against the tokenizer on whole texts."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from galvanite.llm import packing
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_memo_gives_the_ids_of_the_library():
    library, memo = Tokenizer.from_file(PATH), packing.PieceMemo(PATH, room=50)
    odd = ["", "<|endoftext|>a <|endoftext|>", "  \n\n x\t y  ", "͸ Ƛ Ᲊ", "a\x1cb\x85c", "don't 's '", "x" * 5000, " 12 345x é😀"]
    odd += ["".join(chr(c) + "a " for c in range(k, k + 256) if not 0xD800 <= c < 0xE000) for k in range(0, 0x110000, 256)]
    for at in range(0, len(odd), 100):
        part = odd[at:at + 100]
        assert [np.frombuffer(b, "<u4").tolist() for b in memo.encode(part)] == [library.encode(t, add_special_tokens=False).ids for t in part]


def test_other_kinds_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    memo = packing.PieceMemo(path)
    assert not memo.able
    assert np.frombuffer(memo.encode(["Some Text"])[0], "<u4").tolist() == Tokenizer.from_file(path).encode("Some Text", add_special_tokens=False).ids


def test_pieces_of_all_documents(spark):
    library = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids) + 1, 2048)]
        want += [(r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(tuple, packing.token_pieces(docs).collect())) == sorted(want)


def test_lean_steps_give_memory_back():
    from galvanite.llm import shared

    kept = []

    def run(batches):
        blocks = [np.ones(12_000) for _ in range(3_000)]  # 96 KB each, in the common heap
        kept.extend(blocks[::50])
        yield from batches

    def resident() -> float:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    before = resident()
    assert list(shared.lean(run)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 100
