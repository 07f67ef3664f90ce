"""Conversation structure repair: bidirectional Dijkstra over the lattice of edits.

A node of the lattice is a number of rows read and a state of the pattern of roles; an edge keeps, re-roles or deletes
the next row or inserts one. A forward heap starts before the first row, a reverse heap at the ends the pattern
accepts. Both go on until no path as cheap as the best crossing can be left, so every crossing of that cost is
known, and the least concatenation of an audit from the front and one from the back is the answer.

Conversations of more than ``SEGMENT`` rows are searched a segment at a time, from each state to each state, and the
segments are put together in order; a task holds one byte a row and the audit, never the texts.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import read

BLANKS = " \t\n\x0b\x0c\r"
SEGMENT = 64       # rows searched at once
REMEMBERED = 20_000  # searches a task remembers
# What an edit costs, and the states of the pattern (s?(ua)+)?: nothing, s, u, a.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
STATES, ACCEPTED = 4, (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
GONE = "x"         # code of a row that has to be deleted; others are u a s o, in capitals if truncated
NAMES = {"u": "user", "a": "assistant"}


def row_edits(code: str) -> list[tuple[str, int, int, int]]:
    """Edits of a row as (letter, cost, state before, state after)."""
    found = [("D", DELETE, q, q) for q in range(STATES)]
    if code != GONE:
        more = TRUNCATED if code.isupper() else 0
        for (q, role), to in NEXT.items():
            if role == code.lower():
                found.append(("K", more, q, to))
            if role in NAMES:
                found.append(("R", REROLE + more, q, to))
    return found


INSERTS = [("I", INSERT, q, to) for (q, role), to in NEXT.items() if role in NAMES]


def by_state(edits: list, forward: bool) -> list[list[tuple[str, int, int]]]:
    here, there = (2, 3) if forward else (3, 2)
    return [[(e[0], e[1], e[there]) for e in edits if e[here] == q] for q in range(STATES)]


class Side:
    """One of the two searches: the cheapest and then least audit found so far of each node."""

    def __init__(self, codes: str, forward: bool, starts: list[tuple[int, int]]):
        self.codes, self.forward, self.step = codes, forward, 1 if forward else -1
        self.edits = {c: by_state(row_edits(c), forward) for c in set(codes)}
        self.inserts = by_state(INSERTS, forward)
        self.label = {node: (0, "") for node in starts}
        self.heap = [(0, 0, q, i) for i, q in starts]
        self.settled = set()
        heapq.heapify(self.heap)

    def least(self) -> float:
        """Cost of the next node; a node that was settled at a lower cost is passed over."""
        while self.heap and (self.heap[0][3], self.heap[0][2]) in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self) -> Iterator[tuple[int, int]]:
        """Settles the next node and yields those it reaches. Of equal costs the one with fewer rows read comes first: a free
        edit reads a row, so an audit is final when its node is settled."""
        cost, read_rows, q, i = heapq.heappop(self.heap)
        self.settled.add((i, q))
        audit = self.label[i, q][1]
        at = i if self.forward else i - 1
        moves = [(letter, price, i, to, 0) for letter, price, to in self.inserts[q]]
        if 0 <= at < len(self.codes):
            moves += [(letter, price, i + self.step, to, 1) for letter, price, to in self.edits[self.codes[at]][q]]
        for letter, price, j, to, rows in moves:
            found = (cost + price, audit + letter if self.forward else letter + audit)
            if (j, to) not in self.label or found < self.label[j, to]:
                self.label[j, to] = found
                heapq.heappush(self.heap, (found[0], read_rows + rows, to, j))
                yield j, to


def search(codes: str, start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """The least cost, and the least audit of that cost, that lead from one state over all rows to one of the goals."""
    ahead = Side(codes, True, [(0, start)])
    behind = Side(codes, False, [(len(codes), q) for q in goals])
    best = min((0.0 for node in ahead.label if node in behind.label), default=float("inf"))
    while (f := ahead.least()) + (b := behind.least()) <= best and f + b < float("inf"):
        side, other = (ahead, behind) if f <= b else (behind, ahead)
        for node in side.settle():
            if node in other.label:
                best = min(best, side.label[node][0] + other.label[node][0])
    crossings = [
        (cost + behind.label[node][0], audit + behind.label[node][1])
        for node, (cost, audit) in ahead.label.items() if node in behind.label
    ]
    return min(crossings, default=None)


class Audit:
    """The cheapest edits of a conversation whose rows come one by one."""

    def __init__(self, find=search):
        self.find, self.open = find, []
        self.head: list[str] = []        # what all audits below begin with
        self.states = {0: (0, "")}       # state after the closed segments -> least cost and audit

    def add(self, code: str) -> None:
        if len(self.open) == SEGMENT:
            self.close(tuple((q,) for q in range(STATES)))
        self.open.append(code)

    def close(self, goals) -> None:
        codes, self.open = "".join(self.open), []
        after = {}
        for q, (cost, audit) in self.states.items():
            for goal in goals:
                if found := self.find(codes, q, goal):
                    label = (cost + found[0], audit + found[1])
                    after[goal] = min(label, after.get(goal, label))
        shared = os.path.commonprefix([audit for _, audit in after.values()])
        self.head.append(shared)
        self.states = {goal[0]: (cost, audit[len(shared):]) for goal, (cost, audit) in after.items()}

    def result(self) -> tuple[int, str]:
        self.close((ACCEPTED,))
        (cost, audit), = self.states.values()
        return cost, "".join(self.head) + audit


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in, by the remainder of a CRC of id and turn.

    Nulls of role and text become one space, and count as one in the CRC. Rows that are dropped stay with a null ``role``, so that their
    conversation is not forgotten; every other row has a role.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    role, text = named("role"), named("text")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).when(F.col("kind") != 0, F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _facts(rows: DataFrame) -> DataFrame:
    """What the search needs of a row: its initial, its first fault, and where it stands. No text."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    repeated = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    return rows.select("conv_id", "turn", "digest", F.substring("role", 1, 1).alias("initial"), last.alias("last")).select(
        "conv_id", "turn", "digest", "initial",
        F.when(F.col("last") == "", "blank").when(repeated, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("").alias("fault"),
    )


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, position long, edit string, role string, text string"


class Conversation:
    """Facts of a conversation as its rows pass in order, then its repaired rows as the texts pass."""

    def __init__(self, find):
        self.audit, self.faults, self.illegal = Audit(find), {"blank": 0, "duplicate": 0, "truncated": 0}, 0
        self.first = self.newest = self.before = None
        self.distinct = 0
        self.edits = None

    def fact(self, turn, initial: str, fault: str) -> None:
        if turn is not None and turn != self.newest:
            self.first = turn if self.first is None else self.first
            self.newest, self.distinct = turn, self.distinct + 1
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        code = initial if initial in ("u", "a", "s") else "o"
        self.audit.add(GONE if fault in ("blank", "duplicate") else code.upper() if fault else code)

    def resolve(self) -> None:
        if self.edits is None:
            self.cost, self.edits = self.audit.result()
            self.at = self.position = 0
            self.offset = (len(self.edits) - self.edits.count("D")) % 2  # an odd number of rows begins with a system row

    def _wanted(self) -> str:
        return NAMES["ua"[(self.position - self.offset) % 2]]

    def row(self, role: str | None, text: str | None) -> Iterator[tuple[int, str, str, str]]:
        """The repaired rows up to and with this one; with no row, those after the last."""
        self.resolve()
        while self.at < len(self.edits):
            edit = self.edits[self.at]
            if edit != "I" and role is None:
                return
            self.at += 1
            if edit != "D":
                yield self.position, edit, role if edit == "K" else self._wanted(), "" if edit == "I" else text
                self.position += 1
            if edit != "I":
                return

    def summary(self) -> tuple:
        gaps = 0 if self.first is None else min(self.newest - self.first + 1 - self.distinct, 2**63 - 1)
        return gaps, *self.faults.values(), self.illegal, self.cost, self.edits


def repaired(rows: DataFrame, turns: bool = False) -> DataFrame:
    """One row a conversation with its faults, the cheapest edits and a digest of the result; with ``turns`` the repaired rows.

    ``rows`` has ``conv_id, turn, role, text``; rows with a null role only name their conversation. Rows are taken by turn, nulls first; those of one turn by
    a digest of role and text, so equal rows stand together. A null id is a conversation of its own. A null text counts as one
    space, and an empty role has an initial that no pattern allows. Repeated rows are faults, as all that repeat an earlier one.
    Gaps beyond a long
    count as the largest long. A conversation without rows has zeros, an empty audit and the digest of the empty string. An empty table gives no rows;
    other columns are never read.

    Texts move once, by conversation, behind the facts of their conversation, and pass the task in a stream: what it
    holds of a conversation is a byte a row and the audit, however long the conversation or its texts are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text")
    ).withColumn("digest", F.unhex(F.md5(F.concat(F.col("role"), F.lit(":"), F.col("text")).cast("binary"))))
    none = F.lit(None).cast("string")
    known = plain.where("role IS NOT NULL")
    facts = _facts(known).select("conv_id", F.lit(1).alias("part"), "turn", "digest", F.col("initial").alias("role"), F.col("fault").alias("text"))
    named = plain.where("role IS NULL").select("conv_id").distinct().select(
        "conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), none.alias("role"), none.alias("text")
    )
    texts = known.select("conv_id", F.lit(2).alias("part"), "turn", "digest", "role", "text")
    stream = named.union(facts).union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = lru_cache(REMEMBERED)(search)
        schema = TURN_TYPES if turns else SUMMARY_TYPES
        current, name, digest, out, size = None, None, None, [], 0

        def tell(made):
            nonlocal size
            for position, edit, role, text in made:
                digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
                if turns:
                    out.append((name, position, edit, role, text))
                    size += len(text)

        def end():
            if current is not None:
                tell(current.row(None, None))
                if not turns:
                    out.append((name, *current.summary(), digest.hexdigest()))

        def flush():
            nonlocal out, size
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
            return batch

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "part", "turn", "role", "text")]
            for conv, part, turn, role, text in zip(*columns):
                if current is None or conv != name:
                    end()
                    current, name, digest = Conversation(find), conv, hashlib.sha256()
                if part == 1:
                    current.fact(turn, role, text)
                elif part == 2:
                    tell(current.row(role, text))
                if len(out) >= 4096 or size > 1 << 22:
                    yield flush()
        end()
        if out:
            yield flush()

    return stream.select("conv_id", "part", "turn", "role", "text").mapInArrow(run, TURNS if turns else SUMMARY)


_ARROW = {"long": pa.int64(), "string": pa.string()}
SUMMARY_TYPES, TURN_TYPES = (
    pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in s.split(", "))]) for s in (SUMMARY, TURNS)
)


def op13_conversation_repair(spark, folder) -> DataFrame:
    return repaired(damaged(read(spark, folder, "conversations")))
