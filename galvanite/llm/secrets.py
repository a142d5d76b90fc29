"""Secret scan: fixed patterns and assignment-aware lexing.

The lexer turns source and configuration syntax into (name, literal) pairs,
follows names that are assigned other names (constants), and scores a literal
by how sensitive its target names are and how random it looks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Base patterns, kinds in the order of the digest, least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "lexed")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# Parts of names and their weight for a literal assigned to them.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "accesskey": 3, "privatekey": 3, "credential": 2, "auth": 1, "signingkey": 2, "connectionstring": 2}

# A run of name characters before an assignment; it starts no run inside another one, so the search is linear.
_TARGET = re.compile(r"""(?<![\w$.-])([\w$.-]++)["'\]]{0,2}[\x20\t]*+(?::=|=>|=(?![=~])|:(?![:/]))[\x20\t]*+""", re.A)
_NAME = re.compile(r"(?<![\w$])[A-Za-z_$][\w$.-]+", re.A)
_QUOTED = re.compile(r"""[bBfFrRuU]{0,2}(?:"([^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+)"|'([^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+)')""")
_TRIPLE = re.compile(r"""[bBfFrRuU]{0,2}(\"{3}|'{3})""")
# Of signs of equality only padding at the end belongs to a bare value.
_BARE = re.compile(r"""[A-Za-z0-9+/_.$-]++(?:==(?![=\w+/.$"'-])|=(?=[\x20\t]*+(?:[\r\n,;)\]}#<]|\Z)))?""", re.A)
_BLOCK = re.compile(r"[|>][-+0-9]{0,2}[\x20\t]*+(?:#[^\n]*+)?\r?\n")
_LINE = re.compile(r"([\x20\t]*+)([^\n]*+)\n?")
_PEM = re.compile(r"-----(BEGIN|END) [A-Z0-9\x20]{0,40}?PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"(?:(?:\s|\\[rn])*+[A-Za-z0-9+/=]{16,}+)*+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, by start, then kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def weight_of(name: str) -> int:
    flat = re.sub(r"[^a-z0-9]", "", name.lower())
    return max((w for part, w in SENSITIVE.items() if part in flat), default=0)


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def literal_score(names: list[str], value: str) -> float:
    """Weight of the most sensitive name, raised by entropy and by mixed characters."""
    best = max(map(weight_of, names), default=0)
    if not best or len(value) < 8 or " " in value:
        return 0.0
    mixed = bool(re.search(r"[0-9]", value)) + bool(re.search(r"[A-Za-z]", value)) - 1
    return best + entropy(value) / 2 + mixed


def block_span(text: str, key: int, at: int) -> tuple[int, int]:
    """Span of the lines from `at` on: deeper than the line of `key`, and at least as deep as the first of them."""
    depth = len(_LINE.match(text, text.rfind("\n", 0, key) + 1)[1])
    first = end = None
    while at < len(text):
        line = _LINE.match(text, at)
        if line[2].strip():
            if len(line[1]) <= depth:
                break
            depth = len(line[1]) - 1 if first is None else depth
            first, end = line.start(2) if first is None else first, line.start(2) + len(line[2].rstrip())
        at = line.end()
    return (at, at) if first is None else (first, end)


def pem_spans(text: str) -> list[tuple[int, int]]:
    """Private keys from their first to their last line; one without a last line as far as its body goes."""
    marks = list(_PEM.finditer(text))
    out = []
    for i, m in enumerate(marks):
        if m[1] == "BEGIN":
            last = marks[i + 1] if i + 1 < len(marks) else None
            out.append((m.start(), last.end() if last and last[1] == "END" else _BODY.match(text, m.end()).end()))
    return out


def lexed_spans(text: str, least_score: float = 4.5) -> list[tuple[int, int, str]]:
    """Literals whose target names, followed through constants and chains, make them look secret; private keys."""
    literals: dict[str, tuple[int, int, str]] = {}
    names: dict[tuple[int, int], list[str]] = {}
    values: dict[tuple[int, int], str] = {}

    def put(targets: list[str], span: tuple[int, int], bare: bool = False) -> None:
        value = text[slice(*span)]
        if "\n" in value:
            value = "".join(line.strip() for line in value.split("\n"))
        known = literals.get(value) if bare else None
        if known:  # a name that stands for an earlier literal
            names[known[:2]] += targets
        else:
            known = (*span, value)
            names.setdefault(span, []).extend(targets)
            values[span] = value
        literals.update(dict.fromkeys(targets, known))

    at, waiting = 0, None  # a bare value waits, as it may be the next target of a chain
    while m := _TARGET.search(text, at):
        targets: list[str] = []
        if waiting:
            if waiting[1][1] == m.end(1):
                targets = waiting[0]
            else:
                put(*waiting, bare=True)
            waiting = None
        name, at = _NAME.search(m[1]), m.end()
        if name:
            targets.append(name[0])
        if not targets:
            continue
        if (q := _TRIPLE.match(text, at)) and (end := text.find(q[1], q.end())) >= 0:
            at = q.end()  # the lines of the literal can hold assignments as well
            put(targets, (at, end))
        elif q := _QUOTED.match(text, at):
            put(targets, q.span(1 if q[1] is not None else 2))
            at = q.end()
        elif q := _BLOCK.match(text, at):
            at = q.end()
            put(targets, block_span(text, m.start(), at))
        elif q := _BARE.match(text, at):
            waiting = (targets, q.span())
    if waiting:
        put(*waiting, bare=True)
    found = [span for span, value in values.items() if literal_score(names[span], value) >= least_score]
    return [(a, b, "lexed") for a, b in dict.fromkeys(found + pem_spans(text))]


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, base and lexed spans)."""
    base = base_spans(text)
    return base, sorted(base + lexed_spans(text), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCAN = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_column(text: Column) -> Column:
    """Struct of counts, digest and spans; null counts as empty."""

    @pandas_udf(SCAN)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base, every = all_spans(t)
                kinds = Counter(k for _, _, k in base)
                rows.append((kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan(F.coalesce(text, F.lit("")))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text). Null ids stay null; repeated rows repeat; other columns are not read."""
    return docs.select("doc_id", scan_column(F.col("text")).alias("s")).select("doc_id", "s.*")


def redact_column(text: Column, mark: str = "[SECRET]") -> Column:
    """The text with every found span replaced by `mark`; overlapping spans merge; null stays null."""

    @pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                if t is None:
                    out.append(None)
                    continue
                parts, at = [], 0
                for a, b, _ in all_spans(t)[1]:
                    if a >= at:
                        parts += [t[at:a], mark]
                    at = max(at, b)
                out.append("".join([*parts, t[at:]]))
            yield pd.Series(out, dtype=object)

    return redact(text)
