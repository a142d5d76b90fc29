"""Conversation structure repair as shortest paths found by auction.

The rows of a conversation and the state of the role pattern `(s?(ua)+)?` span
a lattice: keeping, re-roling or deleting a row leads to the next row,
inserting a turn stays before it. Edits have small integer costs. The auction
algorithm keeps a price per node and a path from the start: it extends the
path over an arc whose cost equals the difference of prices, else raises the
price of the last node to what its best arc offers and contracts. At the end
every cheapest path consists of such tight arcs only, and the least string of
edits is traced along those that lead to the goal.

A conversation is cut into blocks of rows. Where it has more than one block,
each block gives the cheapest costs between its states; these are combined
over blocks of blocks, so that no task holds more than `fan` of them. Then the
costs to go at its border give each block a lattice of its own again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from galvanite.keyed import Ordered, attach
from galvanite.llm.shared import staged

# States are nothing yet, after s, after u, after a; costs of edits.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
ROLES = {"u": "user", "a": "assistant"}
TURN = {NOTHING: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}  # where an inserted or re-roled turn leads
KEEP = {(NOTHING, "s"): AFTER_S, (NOTHING, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
TO_GO = [0, 4, 2, 0]  # behind the last row
FAR = 1 << 40
SPACES = " \t\n\x0b\x0c\r"


class Lattice:
    """Nodes 4 * row + state; `rows` are pairs (initial, fault) with fault '', 'b', 'd' or 't'."""

    def __init__(self, rows: list[tuple[str, str]], to_go: list[int]):
        self.rows, n = rows, len(rows)
        self.price = [0] * (4 * n) + list(to_go)
        # First prices: the cheapest edit of every row still to come, or no way at all.
        rest = min(to_go)
        for i in range(n - 1, -1, -1):
            fault = rows[i][1]
            rest += DELETE if fault in ("b", "d") else TRUNCATED if fault == "t" else 0
            for q in range(4):
                self.price[4 * i + q] = rest
        self.close()

    def close(self) -> None:
        """Nodes that cannot reach the goal are infinitely far."""
        last = 4 * len(self.rows)
        if max(self.price[last:]) < FAR:
            return
        for v in range(last - 4, -1, -4):
            open_ = [any(self.price[w] < FAR for _, w, _ in self.arcs(v + q, inserts=False)) for q in range(4)]
            for _ in range(2):
                open_ = [open_[q] or open_[TURN[q]] for q in range(4)]
            for q in range(4):
                if not open_[q]:
                    self.price[v + q] = FAR

    def arcs(self, v: int, inserts: bool = True) -> list[tuple[int, int, str]]:
        """(cost, node, edit) from a node before the end, in the order of the letters."""
        i, q = divmod(v, 4)
        first, fault = self.rows[i]
        out = [(DELETE, v + 4, "D")]
        if inserts:
            out.append((INSERT, v - q + TURN[q], "I"))
        if fault not in ("b", "d"):
            add = TRUNCATED if fault == "t" else 0
            if (q, first) in KEEP:
                out.append((add, v - q + 4 + KEEP[q, first], "K"))
            out.append((REROLE + add, v - q + 4 + TURN[q], "R"))
        return out

    def auction(self, start: int) -> int:
        """Cost from `start` to the goal; prices stay valid for later starts."""
        price, last, path = self.price, 4 * len(self.rows), [start]
        while path[-1] < last:
            v = path[-1]
            offer, to = min((cost + price[w], w) for cost, w, _ in self.arcs(v))
            if offer <= price[v]:
                path.append(to)
                continue
            price[v] = min(offer, FAR)
            if price[v] == FAR:
                return FAR
            if len(path) > 1:
                path.pop()
        return price[start]

    def trace(self, start: int) -> tuple[str, int]:
        """The least string of edits on tight arcs after an auction from `start`, and the end state."""
        price, last = self.price, 4 * len(self.rows)
        tight: dict[int, list[tuple[str, int]]] = {}
        todo = [start]
        while todo:
            v = todo.pop()
            if v in tight or v >= last:
                continue
            tight[v] = [(edit, w) for cost, w, edit in self.arcs(v) if price[v] == cost + price[w] < FAR]
            todo += [w for _, w in tight[v]]
        # Nodes from which tight arcs reach the end, later rows first; within a row two insertions follow each other at most.
        good: set[int] = set()
        for i in sorted({v // 4 for v in tight}, reverse=True):
            own = [v for v in range(4 * i, 4 * i + 4) if v in tight]
            for _ in range(3):
                good |= {v for v in own if any(w >= last or w in good for _, w in tight[v])}
        out, v = [], start
        while v < last:
            edit, v = min((e, w) for e, w in tight[v] if w >= last or w in good)
            out.append(edit)
        return "".join(out), v - last


def applied(rows: list[tuple[str, str, str, str]], edits: str, state: int) -> list[str]:
    """Repaired `role:text` entries of rows (initial, fault, role, text)."""
    out, at = [], iter(rows)
    for e in edits:
        if e == "I":
            state = TURN[state]
            out.append(ROLES["u" if state == AFTER_U else "a"] + ":")
            continue
        first, _, role, text = next(at)
        if e == "K":
            state = KEEP[state, first]
            out.append(f"{role}:{text}")
        elif e == "R":
            state = TURN[state]
            out.append(ROLES["u" if state == AFTER_U else "a"] + ":" + text)
    return out


def costs_between(rows: list[tuple[str, str]]) -> list[int]:
    """Cheapest costs from every state before the rows to every state behind them (16 numbers, by row)."""
    out = [[FAR] * 4 for _ in range(4)]
    for end in range(4):
        lattice = Lattice(rows, [0 if q == end else FAR for q in range(4)])
        for q in range(4):
            out[q][end] = lattice.auction(q) if lattice.price[q] < FAR else FAR
    return [x for row in out for x in row]


def chained(a: list[int], b: list[int]) -> list[int]:
    """Costs over two stretches."""
    x, y = np.reshape(a, (4, 4)), np.reshape(b, (4, 4))
    return np.minimum((x[:, :, None] + y[None, :, :]).min(axis=1), FAR).ravel().tolist()


def backward(costs: list[int], to_go: list[int]) -> list[int]:
    """Costs to go before a stretch from those behind it."""
    return np.minimum((np.reshape(costs, (4, 4)) + np.array(to_go)).min(axis=1), FAR).tolist()


def scan(blocks: DataFrame, value: str, join: Callable, carry: Callable, first: Column, reverse: bool, fan: int, name: str) -> DataFrame:
    """Add `name`: the state that enters each block from the side before it (`reverse`: behind it).

    `blocks` has conv, b (0, 1, ...) and the array `value`; `join` combines two
    neighbouring values, `carry` takes a state over a value, `first` enters at
    the border of the conversation. Only `fan` blocks meet in a task at once:
    the rest goes through blocks of blocks.
    """
    many = blocks.agg(F.max("b")).first()[0] or 0
    grouped = blocks.select("conv", F.floor(F.col("b") / fan).alias("g"), F.struct("b", F.col(value).alias("v")).alias("e")).groupBy("conv", "g").agg(F.sort_array(F.collect_list("e")).alias("es"))
    if many < fan:
        entered = grouped.withColumn("s", first)
    else:
        @pandas_udf("array<long>")
        def total(lists: pd.Series) -> pd.Series:
            return pd.Series([reduce(join, [list(e["v"]) for e in es]) for es in lists])

        grouped = staged(grouped.withColumn("t", total("es")), "scan")
        upper = scan(grouped.select("conv", F.col("g").alias("b"), "t"), "t", join, carry, first, reverse, fan, "s")
        entered = attach(grouped.drop("t"), upper.select("conv", F.col("b").alias("g"), "s"), ["conv", "g"])

    @pandas_udf("array<struct<b: long, s: array<long>>>")
    def along(lists: pd.Series, states: pd.Series) -> pd.Series:
        out = []
        for es, s in zip(lists, states):
            s, own = list(s), []
            for e in reversed(es) if reverse else es:
                own.append({"b": e["b"], "s": s})
                s = carry(list(e["v"]), s)
            out.append(own)
        return pd.Series(out)

    each = entered.select("conv", F.explode(along("es", "s")).alias("x")).select("conv", F.col("x.b").alias("b"), F.col("x.s").alias(name))
    return attach(blocks, each, ["conv", "b"])


BLOCK = "audit string, body string, cost long"


def repair_column(rows: Column, start: Column, to_go: Column, is_last: Column) -> Column:
    """Edits, repaired entries and cost to go of a block from its start state and the costs behind it."""

    @pandas_udf(BLOCK)
    def repair(blocks: pd.Series, starts: pd.Series, goals: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for es, start, goal, last in zip(blocks, starts, goals, ends):
            each = [(e["first"], e["fault"], e["role"], e["text"]) for e in es]
            lattice = Lattice([r[:2] for r in each], [int(x) for x in goal])
            cost = lattice.auction(int(start))
            edits, state = lattice.trace(int(start))
            if last:
                edits += "I" * (TO_GO[state] // INSERT)
            out.append((edits, "\n".join(applied(each, edits, int(start))), cost))
        return pd.DataFrame(out, columns=["audit", "body", "cost"])

    return repair(rows, start, to_go, is_last)


def costs_column(rows: Column) -> Column:
    """`costs_between` of every block."""

    @pandas_udf("array<long>")
    def costs(blocks: pd.Series) -> pd.Series:
        return pd.Series([costs_between([(e["first"], e["fault"]) for e in es]) for es in blocks])

    return costs(rows)


def ends_column(rows: Column, to_go: Column) -> Column:
    """The state behind a block for each of the four states before it, along the least cheapest edits."""

    @pandas_udf("array<long>")
    def ends(blocks: pd.Series, goals: pd.Series) -> pd.Series:
        out = []
        for es, goal in zip(blocks, goals):
            lattice = Lattice([(e["first"], e["fault"]) for e in es], [int(x) for x in goal])
            own = []
            for q in range(4):
                lattice.auction(q)
                own.append(lattice.trace(q)[1])
            out.append(own)
        return pd.Series(out)

    return ends(rows, to_go)


def damage(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text after damage by crc32 of `conv_id:turn` modulo 20; nulls read as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", "role", "text", F.explode(copies).alias("copy"))


def faults(rows: DataFrame, limit: int) -> DataFrame:
    """Position i and number n of the rows per conversation, the first fault of each, and its part in gaps and illegal pairs."""
    ordered = Ordered(rows, ["conv"], ["turn", "role", "text", "copy"], limit)
    rows = ordered.positions("i", "n").withColumn("mark", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    at = Ordered(rows, ["conv"], ["i"], limit, ordered.split)
    if ordered.split:
        # A text may fill a whole conversation: the least position is combined before the shuffle, and joined by position.
        least = rows.groupBy("conv", "mark").agg(F.min("i").alias("i")).select("conv", "i", F.lit(True).alias("new"))
        rows = attach(staged(rows, "turns"), least, ["conv", "i"])
        at = Ordered(rows, ["conv"], ["i"], limit, True)
    else:
        rows = rows.withColumn("new", F.row_number().over(Window.partitionBy("conv", "mark").orderBy("i")) == 1)
        at = Ordered(rows, ["conv"], ["i"], limit, False)
    first = F.coalesce(F.nullif(F.substring("role", 1, 1), F.lit("")), F.lit(" "))
    rows = at.frame({"before": lambda w: F.lag(F.struct("turn", first.alias("first"))).over(w)}, 1)
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    fault = F.when(last == "", "b").when(~F.coalesce("new", F.lit(False)), "d").when(~last.isin(".", "!", "?"), "t").otherwise("")
    pair = F.concat("before.first", first)
    return rows.select(
        "conv", "i", "n", "turn", "role", "text", first.alias("first"), fault.alias("fault"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).cast("long").alias("illegal"),
        (F.col("turn").isNotNull() & (F.col("before").isNull() | ~F.col("turn").eqNullSafe(F.col("before.turn")))).cast("long").alias("new_turn"))


def streamed(blocks: DataFrame) -> DataFrame:
    """conv, audit, repaired_sha256 of conversations of many blocks: read in order, a block at a time."""
    kind = blocks.schema["conv"].dataType
    shape = T.StructType([T.StructField("conv", kind), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, now, audit, digest, some = False, None, [], hashlib.sha256(), False

        def row(conv_type):
            return pa.record_batch([pa.array([now], conv_type), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv", "audit", "repaired_sha256"])

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for conv, edits, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not open_ or conv != now:
                    if open_:
                        yield row(conv_type)
                    open_, now, audit, digest, some = True, conv, [], hashlib.sha256(), False
                audit.append(edits)
                if body:
                    digest.update((b"\n" if some else b"") + body.encode())
                    some = True
        if open_:
            yield row(conv_type)

    return blocks.repartition("conv").sortWithinPartitions("conv", "b").select("conv", "audit", "body").mapInArrow(read, shape)


SUMS = ["blank", "duplicate", "truncated", "illegal", "turns"]


def report_short(blocks: DataFrame) -> DataFrame:
    """Conversations of one block."""
    whole = blocks.withColumn("r", repair_column(F.col("es"), F.lit(NOTHING), F.array(*map(F.lit, TO_GO)), F.lit(True)))
    return whole.select("conv", *SUMS, "low", "high", "r.cost", "r.audit", F.sha2(F.col("r.body").cast("binary"), 256).alias("repaired_sha256"))


def report_long(blocks: DataFrame, rows_per_block: int, fan: int) -> DataFrame:
    """Conversations of many blocks."""
    coded = staged(blocks.select("conv", "b", F.transform("es", lambda e: F.struct(e["first"].alias("first"), e["fault"].alias("fault"))).alias("es")), "coded")
    goals = scan(staged(coded.select("conv", "b", costs_column(F.col("es")).alias("v")), "costs"), "v", chained, backward, F.array(*[F.lit(x).cast("long") for x in TO_GO]), True, fan, "to_go")
    goals = staged(goals.select("conv", "b", "to_go"), "goals")
    ends = staged(attach(coded, goals, ["conv", "b"]).select("conv", "b", "to_go", ends_column(F.col("es"), F.col("to_go")).alias("v")), "ends")
    entered = scan(ends, "v", lambda a, b: [b[x] for x in a], lambda ends, state: [ends[state[0]]], F.array(F.lit(NOTHING).cast("long")), False, fan, "start")
    each = attach(blocks, entered.select("conv", "b", "to_go", F.col("start")[0].alias("start")), ["conv", "b"])
    each = each.withColumn("r", repair_column(F.col("es"), F.col("start"), F.col("to_go"), F.col("b") == F.floor((F.col("n") - 1) / rows_per_block)))
    each = staged(each.select("conv", "b", *SUMS, "low", "high", "r.cost", "r.audit", "r.body"), "repaired")
    total = each.groupBy("conv").agg(*[F.sum(c).alias(c) for c in SUMS], F.min("low").alias("low"), F.max("high").alias("high"), F.min_by("cost", "b").alias("cost"))
    return attach(total, streamed(each), ["conv"]).select("conv", *SUMS, "low", "high", "cost", "audit", "repaired_sha256")


def repair_conversations(turns: DataFrame, rows_per_block: int = 64, fan: int = 1024, limit: int = 200_000) -> DataFrame:
    """One row per conversation of `turns` (conv_id, turn, role, text) after damage, with its faults and cheapest repair.

    Null turns come first, rows of one turn are taken by role and text, null
    roles and texts read as one space, null conv_ids form a conversation. A
    conversation without rows after damage gets zeros, an empty audit and the
    hash of nothing; an empty table gives an empty result; further columns are
    ignored. Conversations of any size are worked on in blocks of
    `rows_per_block` rows; above `limit` rows they are also ordered in several
    tasks. Only the hash of a conversation of many blocks reads them one after
    the other, in constant memory.
    """
    rows = faults(damage(turns), limit)
    blocks = rows.groupBy("conv", F.floor(F.col("i") / rows_per_block).alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("i", "first", "fault", "role", "text"))).alias("es"), F.max("n").alias("n"),
        *[F.sum((F.col("fault") == name[0]).cast("long")).alias(name) for name in SUMS[:3]],
        F.sum("illegal").alias("illegal"), F.sum("new_turn").alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    blocks = staged(blocks, "turn-blocks")
    out = report_short(blocks.where(F.col("n") <= rows_per_block))
    many = blocks.where(F.col("n") > rows_per_block)
    if not many.isEmpty():
        out = out.unionByName(report_long(many, rows_per_block, fan))
    every = turns.select(F.col("conv_id").alias("conv")).distinct()
    nothing = hashlib.sha256(b"").hexdigest()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return attach(every, out, ["conv"]).select(
        F.col("conv").alias("conv_id"), zero(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps"),
        *[zero(F.col(c)).alias(c) for c in (*SUMS[:4], "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
