"""BPE encoding by backtracking over longest matches, decoding by an offset table.

A sequence of tokens is the one that merging in order of rank gives exactly
if every two neighbours are compatible: merging their joined text gives the
two again. So no merge is ever replayed on a text. An Aho-Corasick automaton
names all tokens that begin at each place of a word; the encoder takes the
longest one that is compatible with the token before it, and steps back where
none is. The encoding of a prefix is unique, therefore a place that failed
once is never entered again and a word takes linear time.

Whether two tokens are compatible is answered from their merge trees: the
right edge of the left one and the left edge of the right one grow in order
of rank, and a merge across the border must never come first.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

END = "Ā"  # one character beyond all bytes; marks the end of a word
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 as it is, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class PairTable:
    """Merge trees of a vocabulary and, kept as they are asked for, the compatible pairs."""

    def __init__(self, merges: list[tuple[int, int, int]], room: int = 1 << 18):
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.parts = {c: (r, a, b) for r, (a, b, c) in enumerate(merges)}
        self.known: dict[tuple[int, int], bool] = {}
        self.room = room
        if len(self.parts) < len(merges):
            raise ValueError("two merges make the same token")
        for c, (r, a, b) in self.parts.items():
            if max(self.born(a), self.born(b)) >= r or self.meeting(a, b) != (a, b):
                raise ValueError(f"token {c} does not encode to itself")

    def born(self, token: int) -> int:
        return self.parts[token][0] if token in self.parts else -1

    def edge(self, token: int, side: int) -> list[int]:
        """Tokens at the outer edge, from the single letter up to the token itself; side 1 is left, 2 is right."""
        out = [token]
        while out[-1] in self.parts:
            out.append(self.parts[out[-1]][side])
        return out[::-1]

    def meeting(self, left: int, right: int) -> tuple[int, int] | None:
        """The first pair that merges across the border, if any."""
        a, b = self.edge(left, 2), self.edge(right, 1)
        i = j = 0
        while True:
            grow_a = self.born(a[i + 1]) if i + 1 < len(a) else NEVER
            grow_b = self.born(b[j + 1]) if j + 1 < len(b) else NEVER
            # Equal merges run from left to right: the border comes after the left side, before the right one.
            across = self.rank.get((a[i], b[j]), NEVER)
            if across < grow_a and across <= grow_b and across < NEVER:
                return a[i], b[j]
            if grow_a == grow_b == NEVER:
                return None
            step = min(grow_a, grow_b)
            i, j = i + (grow_a == step), j + (grow_b == step)

    def compatible(self, left: int, right: int) -> bool:
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) >= self.room:
                self.known.clear()
            found = self.known[left, right] = self.meeting(left, right) is None
        return found


class Words(dict):
    """Ids of words as little-endian bytes, made when first asked for; emptied when full, long words are not kept."""

    def __init__(self, encode, room: int, longest: int = 64):
        super().__init__()
        self.encode, self.room, self.longest = encode, room, longest

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word), dtype="<u4").tobytes()
        if len(word) <= self.longest:
            if len(self) >= self.room:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Encoder and decoder of one vocabulary file of the tokenizers library.

    Supported are byte-level BPE files with an end-of-word mark, lower case,
    NFC and one splitting pattern; others raise ValueError.
    """

    def __init__(self, path: str, room: int = 300_000):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split, level = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])[:2]
        plain = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if (model["type"], steps, split.get("type"), level.get("type"), spec["decoder"]) != ("BPE", ["NFC", "Replace", "Lowercase"], "Split", "ByteLevel", None) \
                or not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["dropout"] or not (split["invert"] and plain):
            raise ValueError(f"{path}: another kind of tokenizer")
        suffix, letters, vocab = model["end_of_word_suffix"], byte_letters(), model["vocab"]

        def as_bytes(token: str) -> str:
            body = token.removesuffix(suffix)
            return "".join(chr(letters[c]) for c in body) + END * (body != token)

        self.tokens = {as_bytes(t): i for t, i in vocab.items()}
        if len(self.tokens) < len(vocab):
            raise ValueError(f"{path}: two tokens of one text")
        self.pairs = PairTable([(vocab[a], vocab[b], vocab[a + b]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])])
        self.automaton = ahocorasick.Automaton()
        for t, i in self.tokens.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = Words(self.encode_word, room)
        self.usual = set(map(chr, range(128)))
        self.path = path
        self.exact = None
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        each = [(names[i] + " ").encode() if i in names else b"" for i in range(max(names, default=-1) + 1)]
        self.sizes = np.array([len(b) for b in each], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])[:-1].astype(np.int64)
        self.letters = np.frombuffer(b"".join(each), dtype=np.uint8)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the splitting pattern."""
        return self.encode_bytes(word.encode().decode("latin-1") + END)

    def encode_bytes(self, text: str) -> list[int]:
        whole = self.tokens.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        begins: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, (token, size) in self.automaton.iter(text):
            begins[last + 1 - size].append((token, last + 1))
        out: list[int] = []
        starts: list[int] = []
        failed = bytearray(n + 1)
        at, compatible = 0, self.pairs.compatible
        while at < n:
            left = begins[at]  # shortest first; what was tried is gone
            while left:
                token, end = left.pop()
                if not failed[end] and (not out or compatible(out[-1], token)):
                    out.append(token)
                    starts.append(at)
                    at = end
                    break
            else:
                failed[at] = 1
                out.pop()
                at = starts.pop()
        return out

    def words_of(self, text: str) -> list[str]:
        if text.isascii():
            return self.pattern.findall(text.lower())
        if fresh := set(text) - self.usual:
            self.usual |= {c for c in fresh if unicodedata.category(c) != "Cn"}
            if fresh - self.usual:
                return self.words_beyond(text)
        # The capital sigma is lowered by itself, without a look at its place in the word.
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def words_beyond(self, text: str) -> list[str]:
        """Texts with characters that this Python does not know yet: their properties are asked of the library."""
        from tokenizers import Tokenizer

        if self.exact is None:
            tok = Tokenizer.from_file(self.path)
            self.exact = tok.normalizer, tok.pre_tokenizer
        text = self.exact[0].normalize_str(text)
        return [text[a:b] for _, (a, b) in self.exact[1].pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """Ids of a text, little-endian unsigned 32-bit."""
        ids = self.words
        if self.marks is None or not self.marks.search(text):
            return b"".join(map(ids.__getitem__, self.words_of(text)))
        out = []
        for k, part in enumerate(self.marks.split(text)):
            out += [self.special[part].to_bytes(4, "little")] if k % 2 else map(ids.__getitem__, self.words_of(part))
        return b"".join(out)

    def decode(self, ids: bytes, step: int = 1 << 16) -> bytes:
        """UTF-8 text of ids: the tokens as the vocabulary writes them, one space between; ids without a token are left out."""
        out = []
        numbers = np.frombuffer(ids, dtype="<u4")
        for at in range(0, len(numbers), step):
            part = numbers[at:at + step]
            part = part[part < len(self.sizes)].astype(np.int64)
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            place = np.repeat(self.offsets[part] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
            out.append(self.letters[place].tobytes())
        return b"".join(out)[:-1]


@lru_cache(maxsize=4)
def encoder(path: str | None = None) -> Encoder:
    """One encoder per worker process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Encoder(str(path))


def encode_column(text: Column, tokenizer: str | None = None) -> Column:
    """Binary column of ids, little-endian unsigned 32-bit; a null text counts as empty."""

    @pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(tokenizer)
        for texts in batches:
            yield texts.map(bpe.encode)

    return encode(F.coalesce(text, F.lit("")))


def decode_column(ids: Column, tokenizer: str | None = None) -> Column:
    """Text of a binary column of ids; null ids count as none."""

    @pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(tokenizer)
        for each in batches:
            yield each.map(lambda b: bpe.decode(b).decode())

    return decode(F.coalesce(ids, F.lit("").cast("binary")))


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids (binary) and decoded text of every row, in one pass.

    Null texts count as empty and give no ids, null doc_ids stay null,
    repeated rows are encoded alike, an empty table gives an empty result,
    further columns of `docs` are ignored. A text is encoded whole, however
    long it is. `tokenizer` is a file path that every worker can read; unset,
    the installed word_bpe_49k.json.
    """

    @pandas_udf("ids binary, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = encoder(tokenizer)
        for texts in batches:
            for at in range(0, len(texts), 256):  # results leave in small parts
                ids = [bpe.encode(t) for t in texts.iloc[at:at + 256]]
                yield pd.DataFrame({"ids": ids, "decoded": [bpe.decode(b).decode() for b in ids]})

    return docs.select("doc_id", both(F.coalesce(F.col("text"), F.lit(""))).alias("_bpe")).select("doc_id", "_bpe.ids", "_bpe.decoded")


def digest_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; see `round_trip`."""
    return round_trip(docs, tokenizer).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
