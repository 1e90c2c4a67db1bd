"""Repair of conversation structure with a suffix-shared automaton.

A conversation is a string of row signatures: the role's initial and the row's fault, nine letters in
all.  What its best repair is from some row on depends on nothing but the letters from there to the
end and the grammar's state.  So distinct signatures are read from the end in sorted order, where
equal endings are neighbours: each node, a distinct ending, gets its cost-to-go and its best audit for
the grammar's four states once, from the node after it, for all conversations that end like this.

Rows are dealt by ranges of (conversation, turn), so that a conversation of any length is spread over
tasks, in blocks of a bounded number of rows.  Blocks of one conversation are linked by their
cost-to-go vectors: a min-plus product a block, then one pass over blocks, not rows, from the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import joined_back, partitions, trimmed, written

#: Rows and bytes of text in a block, and blocks given back at once.
BLOCK_ROWS, BLOCK_BYTES, AT_ONCE = 256, 1 << 20, 64
SPACE = " \t\n\v\f\r"
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a.  The state after the role that each of them needs.
NEXT = (2, 2, 3, 2)
#: Cost-to-go, audit and last state of what follows the last row, by state: nothing, or what the grammar lacks.
END = "end"
ENDING = ((0, 6, 3, 0), ("", "II", "I", ""), (0, 3, 3, 3))
FAR = 1 << 60


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with ``copies`` (0: dropped) after one of five kinds of damage, by a hash of conversation and turn; nulls are one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies")
    )


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in ranges of (conversation, turn, digest of role and text), nulls first, sorted; equal rows may part anywhere."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    keyed = rows.select("conv_id", "turn", "role", "text", "copies", digest.alias("digest"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "digest", "row"]
    return keyed.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)


class Block:
    """Some rows of one conversation, one after the other."""

    def __init__(self, conv_id: object, number: int):
        self.conv_id, self.number, self.size, self.illegal = conv_id, number, 0, 0
        self.initials, self.marks, self.roles, self.texts = [], [], [], []
        self.seen: dict[bytes, int] = {}
        self.turns: list[int] = []  # distinct ones, rising

    def add(self, turn: int | None, role: str, text: str, digest: bytes) -> None:
        shown = text.rstrip(SPACE)
        mark = "b" if not shown else "d" if digest in self.seen else "." if shown[-1] in ".!?" else "t"
        self.seen.setdefault(digest, len(self.marks))
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if self.initials and self.initials[-1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        self.initials.append(initial)
        self.marks.append(mark)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)

    def row(self, part: int, is_open: bool) -> tuple:
        ends = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        marks, initials = "".join(self.marks), "".join(self.initials)
        at, digests = [*self.seen.values()] if is_open else [], [*self.seen] if is_open else []
        return (self.conv_id, part, self.number, is_open, *ends, len(self.turns), self.illegal, initials, marks, signature(marks, initials), at, digests, self.roles, self.texts)


KINDS = (
    ("part", "int", pa.int32()), ("b", "int", pa.int32()), ("open", "boolean", pa.bool_()), ("turn_from", "long", pa.int64()), ("turn_to", "long", pa.int64()), ("turns", "long", pa.int64()),
    ("illegal", "long", pa.int64()), ("initials", "string", pa.string()), ("marks", "string", pa.string()), ("sig", "string", pa.string()), ("at", "array<int>", pa.list_(pa.int32())),
    ("digests", "array<binary>", pa.list_(pa.binary())), ("roles", "array<string>", pa.list_(pa.string())), ("texts", "array<string>", pa.list_(pa.string())),
)


def signature(marks: str, initials: str) -> str:
    """x: must go; else the role's initial (o: another), as a capital letter where the row is truncated."""
    return "".join("x" if m in "bd" else i.upper() if m == "t" else i for m, i in zip(marks, initials, strict=True))


def blocks_of(rows: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of every conversation; ``open`` ones may have others of their conversation before or after them."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, block, more, ready, kind = TaskContext.get().partitionId(), 0, None, True, [], None

        def out() -> pa.RecordBatch:
            columns = list(zip(*ready, strict=True))
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, t) for c, (_, _, t) in zip(columns[1:], KINDS, strict=True))], names=["conv_id", *(k for k, _, _ in KINDS)])

        for b in batches:
            kind = b.schema.field("conv_id").type
            for conv_id, turn, role, text, copies, digest in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "digest")), strict=True):
                if block is None:
                    block = Block(conv_id, number)
                elif conv_id != block.conv_id or copies and (len(block.marks) >= block_rows or block.size > BLOCK_BYTES):
                    same = conv_id == block.conv_id
                    ready.append(block.row(part, more or same))  # a range's first conversation may begin in the one before
                    more, number = same, number + 1
                    block = Block(conv_id, number)
                    if len(ready) >= AT_ONCE:
                        yield out()
                for _ in range(copies):
                    block.add(turn, role, text, digest)
        if block is not None:
            ready.append(block.row(part, True))
        if ready:
            yield out()

    return ordered(rows).mapInArrow(work, ", ".join([f"conv_id {conv_type}", *(f"{k} {t}" for k, t, _ in KINDS)]))


def costs_before(letter: str, after: np.ndarray) -> np.ndarray:
    """Cost-to-go [state, ...] before a row of that letter from that behind it."""
    kept = np.full_like(after, FAR)
    own = 4 + after
    if letter != "x":
        extra, initial = 3 * letter.isupper(), letter.lower()
        for q, n in enumerate(NEXT):
            if initial == "ua"[n - 2]:  # the role that leads to state n
                kept[q] = extra + after[n]
        if initial == "s":
            kept[0] = extra + after[1]
        own = np.minimum(own, np.minimum(kept, 3 + extra + after[list(NEXT)]))
    two = np.minimum(own, 3 + own[[2, 2, 3, 2]])
    return np.minimum(two, 6 + own[[3, 3, 2, 3]])


@lru_cache(1 << 12)
def product(sig: str) -> tuple[int, ...]:
    """The least cost from each state before some rows to each state after them, without what may be inserted after the last."""
    costs = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(costs, 0)
    for letter in reversed(sig):
        costs = np.minimum(costs_before(letter, costs), FAR)
    return tuple(costs.ravel().tolist())


Node = tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...]]


def before(letter: str, after: Node) -> Node:
    """The node of a row in front of another node: by state the least cost, of its audits the first in ASCII order, and the state at the end."""
    cost, audit, end = after
    own = []
    extra, initial = 3 * letter.isupper(), letter.lower()
    for q, n in enumerate(NEXT):
        ways = [(4 + cost[q], "D", q)]
        if letter != "x":
            to = n if initial == "ua"[n - 2] else 1 if initial == "s" and q == 0 else None
            if to is not None:
                ways.append((extra + cost[to], "K", to))
            ways.append((3 + extra + cost[n], "R", n))
        best, edit, to = min(ways)
        own.append((best, edit + audit[to], end[to]))
    out = [*own]
    for q in (2, 3, 0, 1):  # an inserted row leads to 2 or 3; those two never both insert
        n = NEXT[q]
        best, rest, last = own[n] if q in (2, 3) else out[n]
        out[q] = min(own[q], (3 + best, "I" + rest, last), key=lambda w: (w[0], w[1][:1]))
    return tuple(w[0] for w in out), tuple(w[1] for w in out), tuple(w[2] for w in out)


def automaton(pairs: DataFrame) -> DataFrame:
    """Distinct (sig, exit), n -> costs, audits and ends by state.  Signatures come sorted from their ends, so each node on the way is made once."""

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_exit, path, nodes = None, "", []
        for b in batches:
            found: list[Node] = []
            for exit_, reverse in zip(b.column("exit").to_pylist(), b.column("reverse").to_pylist(), strict=True):
                if exit_ != last_exit:
                    vector = None if exit_ == END else tuple(int(v) for v in exit_.split(","))
                    last_exit, path, nodes = exit_, "", [ENDING if vector is None else (vector, ("",) * 4, (0, 1, 2, 3))]
                shared = 0
                while shared < min(len(path), len(reverse)) and path[shared] == reverse[shared]:
                    shared += 1
                del nodes[shared + 1 :]
                for letter in reverse[shared:]:
                    nodes.append(before(letter, nodes[-1]))
                path = reverse
                found.append(nodes[-1])
            columns = [pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array([f[2] for f in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("sig"), b.column("exit"), b.column("n"), *columns], names=["sig", "exit", "n", "costs", "audits", "ends"])

    counted = pairs.groupBy("sig", "exit").agg(F.count("*").alias("n")).withColumn("reverse", F.reverse("sig"))
    ranged = counted.repartitionByRange(partitions(pairs.sparkSession), "exit", "reverse").sortWithinPartitions("exit", "reverse")
    return ranged.mapInArrow(work, "sig string, exit string, n long, costs array<long>, audits array<string>, ends array<int>")


def by_conversation(blocks: DataFrame, falling: bool = False) -> DataFrame:
    """Blocks of a conversation one after the other in one task; conversations are dealt by key."""
    place = [F.col(c).desc() if falling else F.col(c) for c in ("part", "b")]
    return blocks.repartition(partitions(blocks.sparkSession), "conv_id").sortWithinPartitions("conv_id", *place)


def repeated_elsewhere(blocks: DataFrame) -> DataFrame:
    """part, b, later: places of rows whose role and text stand in an earlier block of the conversation."""
    digests = blocks.select("conv_id", "part", "b", F.explode(F.arrays_zip("at", "digests")).alias("x")).select("conv_id", "part", "b", F.col("x.at").alias("at"), F.col("x.digests").alias("digest"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("part", "b"))  # a row a block, not a row
    return digests.withColumn("nth", nth).where("nth > 1").groupBy("part", "b").agg(F.collect_list("at").alias("later"))


def with_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        marks, sigs, products = [], [], []
        for own, initials, later in zip(*(b.column(c).to_pylist() for c in ("marks", "initials", "later")), strict=True):
            own = list(own)
            for i in later or ():
                own[i] = "b" if own[i] == "b" else "d"
            marks.append("".join(own))
            sigs.append(signature(marks[-1], initials))
            products.append(product(sigs[-1]))
        keep = ["conv_id", "part", "b"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(marks, pa.string()), pa.array(sigs, pa.string()), pa.array(products, pa.list_(pa.int64()))], names=[*keep, "marks", "sig", "product"])


def with_exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each conversation's last block to its first: the cost-to-go behind the block, less its least value, and before it."""
    last, behind = object(), None
    for b in batches:
        exits, entries = [], []
        for conv_id, costs in zip(b.column("conv_id").to_pylist(), b.column("product").to_pylist(), strict=True):
            if last is not conv_id and last != conv_id:
                behind = None
            vector = np.array(ENDING[0] if behind is None else behind, np.int64)
            exits.append(END if behind is None else ",".join(str(v) for v in (vector - vector.min()).tolist()))
            behind = np.minimum((np.array(costs, np.int64).reshape(4, 4) + vector).min(axis=1), FAR)
            entries.append(int(behind[0]))
            last = conv_id
        keep = ["conv_id", "part", "b", "marks", "sig"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(exits, pa.string()), pa.array(entries, pa.int64())], names=[*keep, "exit", "cost"])


class Repaired:
    """One conversation's result, block after block."""

    def __init__(self, conv_id: object):
        self.conv_id, self.state, self.hash, self.any, self.cost = conv_id, 0, hashlib.sha256(), False, None
        self.audit: list[str] = []
        self.counts = dict.fromkeys("bdt.", 0)
        self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def add(self, r: dict) -> None:
        self.cost = r["cost"] if self.cost is None else self.cost
        for m in self.counts:
            self.counts[m] += r["marks"].count(m)
        self.illegal += r["illegal"]
        if r["initials"]:
            self.illegal += self.initial is not None and self.initial + r["initials"][0] not in ("su", "ua", "au")
            self.initial = r["initials"][-1]
        if r["turns"]:
            self.turns += r["turns"] - (self.last == r["turn_from"])
            self.first, self.last = r["turn_from"] if self.first is None else self.first, r["turn_to"]
        audit, at, state, lines = r["audits"][self.state], 0, self.state, []
        for edit in audit:
            if edit != "D":
                role, text = ("assistant" if state == 2 else "user"), "" if edit == "I" else r["texts"][at]
                if edit == "K":
                    role = r["roles"][at]
                state = 1 if edit == "K" and r["initials"][at] == "s" else NEXT[state]
                lines.append(f"{role}:{text}")
            at += edit != "I"
        if lines:
            self.hash.update(("\n" * self.any + "\n".join(lines)).encode("utf-8", "surrogatepass"))
            self.any = True
        self.audit.append(audit)
        self.state = r["ends"][self.state]

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *(self.counts[m] for m in "bdt"), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@trimmed
def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, ready, kind = None, [], None

    def out() -> pa.RecordBatch:
        columns = list(zip(*ready, strict=True))
        ready.clear()
        kinds = [kind, *[pa.int64()] * len(RESULT), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", *RESULT, "audit", "repaired_sha256"])

    for b in batches:
        kind = b.schema.field("conv_id").type
        for i in range(b.num_rows):
            r = {c: b.column(c)[i].as_py() for c in b.schema.names}
            if own is None or own.conv_id != r["conv_id"]:
                if own is not None:
                    ready.append(own.row())
                own = Repaired(r["conv_id"])
            own.add(r)
        if ready:
            yield out()
    if own is not None:
        ready.append(own.row())
        yield out()


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row a conversation.

    rows: conv_id, turn, role, text and, where rows stand for several or none, copies.  A null role or
    text is one space, rows without conv_id are one conversation, rows without turn come first.  Rows
    of one turn come in the order of a digest of role and text, equal ones next to each other.  A
    conversation without rows (copies 0) has zeros, no audit and the hash of nothing.  Other columns
    are left out; no rows give no rows.  Conversations are held a block at a time; only their hash and
    the audit itself are made by one task each, block by block, as their definitions ask for.
    """
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1).alias("copies")
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies)
    conv_type = given.schema["conv_id"].dataType.simpleString()
    blocks = written(blocks_of(given, block_rows), "conversation-blocks")
    parted = blocks.where("open")
    slim = parted.select("conv_id", "part", "b", "marks", "initials").join(repeated_elsewhere(parted), ["part", "b"], "left")
    products = slim.mapInArrow(with_marks, f"conv_id {conv_type}, part int, b int, marks string, sig string, product array<long>")
    exits = written(by_conversation(products, falling=True).mapInArrow(with_exits, f"conv_id {conv_type}, part int, b int, marks string, sig string, exit string, cost long"), "conversation-exits")
    whole = blocks.where("NOT open").withColumn("exit", F.lit(END))
    nodes = written(automaton(whole.select("sig", "exit").unionByName(exits.select("sig", "exit"))), "conversation-automaton")
    result = f"conv_id {conv_type}, {', '.join(f'{c} long' for c in RESULT)}, audit string, repaired_sha256 string"
    shown = ["conv_id", "illegal", "turn_from", "turn_to", "turns", "initials", "marks", "roles", "texts", "cost", "audits", "ends"]
    closed = joined_back(whole.drop("at", "digests"), nodes, ["sig", "exit"], "n").withColumn("cost", F.col("costs")[0])
    linked = joined_back(exits, nodes, ["sig", "exit"], "n").join(parted.drop("conv_id", "marks", "sig", "at", "digests", "open"), ["part", "b"])
    return closed.select(*shown).mapInArrow(finished, result).unionByName(by_conversation(linked).select(*shown).mapInArrow(finished, result))
