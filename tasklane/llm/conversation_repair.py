"""Repair of conversation structure by cheapest edits.

A conversation should read ``(system? (user assistant)+)?``. Its rows are
kept, given another role or deleted, and empty rows are put between them; the
cheapest edits are a shortest path over the lattice of (rows done, state of
the pattern). Integer costs make it a case for the auction algorithm: a path
grows from its origin along the arc that its last node prefers; where that
arc costs more than the node's price, the price rises and the path shrinks by
that node. When the path arrives, prices are an optimal dual: every arc of
every shortest path is tight (its cost is the difference of its prices). The
least audit, in ASCII order, is then read off the tight arcs from the start.

Long conversations are solved in segments from the end, each from all states
at its border to the border behind it, so the auction's work stays in
proportion to the rows.

Structure and text go apart. Faults come from digests, and one task reads a
conversation's rows in order and holds a few bytes for each (its audit, a
single value of the result, is as long). Texts are sorted behind their
conversation's audit and pass through a running SHA-256; a task never holds
more of them than an Arrow batch. SHA-256 of one conversation can't be split;
all else about a large one is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasklane.llm.common import arrow_map, prepare, table

SEGMENT = 64               # rows of a long conversation solved at once
DELETE, REROLE, INSERT, UNFINISHED = 3, 2, 2, 1

# First letters of a role: 0 s, 1 u, 2 a, 3 another. Faults as the code's
# last two bits.
OTHER = 3
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
_GONE = -1                 # a row that is there for its conversation's id

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
_NEXT = (2, 2, 3, 2)       # by an inserted row, or one with another role
_KEEPS = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
_ENDS = (0, 3)
_ROLE = {2: "user", 3: "assistant"}

_AUDIT = T.StructType([
    T.StructField("conv_id", T.LongType()),
    *[T.StructField(c, T.LongType()) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    T.StructField("audit", T.StringType())])
_REPAIRED = T.StructType([*_AUDIT, T.StructField("repaired_sha256",
                                                 T.StringType())])


def _row_arcs(code: int, state: int) -> list[tuple[str, int, int]]:
    """Edits at a row, ascending by letter: letter, state behind it, cost.
    An insertion leaves the row to come."""
    role, fault = code >> 2, code & 3
    arcs = [("D", state, DELETE), ("I", _NEXT[state], INSERT)]
    if fault in (SOUND, TRUNCATED):
        extra = UNFINISHED if fault == TRUNCATED else 0
        if role in _KEEPS[state]:
            arcs.append(("K", _KEEPS[state][role], extra))
        arcs.append(("R", _NEXT[state], REROLE + extra))
    return arcs


# Node 4 * row + state; an arc's target by its distance from the node.
_ARCS = [[[(letter, (0 if letter == "I" else 4) + to - state, cost)
           for letter, to, cost in _row_arcs(code, state)]
          for state in range(4)] for code in range(16)]
_LEAST = [min(c for s in range(4) for letter, _, c in _row_arcs(code, s)
              if letter != "I") for code in range(16)]


def auction(arcs: list[list[tuple[int, int]]], price: list[int], origin: int,
            goal: int) -> None:
    """Raise ``price`` until it is an optimal dual for ``origin``: shortest
    distances to ``goal`` along the path, and nowhere more than the arcs
    allow. ``arcs[node]``: (target, cost), cycles cost more than 0.
    ``price`` must allow all arcs before and does so after."""
    path = [origin]
    while path[-1] != goal:
        node = path[-1]
        best, to = min([(cost + price[j], j) for j, cost in arcs[node]])
        if price[node] < best:             # contract
            price[node] = best
            if len(path) > 1:
                path.pop()
        else:                              # extend
            path.append(to)


def _segment(codes: bytes, behind: list[int | None]
             ) -> tuple[list[int], list[str | None]]:
    """Distances from the four states before ``codes`` to the end, and for
    each node the edit that the least audit takes there (None: dead end).
    ``behind``: distances from the states behind the segment; None: no end."""
    n = len(codes)
    goal = 4 * n + 4
    arcs: list[list[tuple[int, int]]] = []
    for row, code in enumerate(codes):
        for state in range(4):
            node = 4 * row + state
            arcs.append([(node + d, c) for _, d, c in _ARCS[code][state]])
    for far in behind:
        arcs.append([] if far is None else [(goal, far)])
    last = None in behind                  # behind the last row: insertions
    if last:
        for state in range(4):
            arcs[4 * n + state].append((4 * n + _NEXT[state], INSERT))
    base = min(x for x in behind if x is not None)
    price = [base] * (4 * n + 4) + [0]
    for row in range(n - 1, -1, -1):
        base += _LEAST[codes[row]]
        price[4 * row:4 * row + 4] = [base] * 4
    for state in range(4):
        auction(arcs, price, state, goal)
    # Tight arcs from which the goal is reached by tight arcs.
    take: list[str | None] = [None] * goal
    for state in (0, 3, 2, 1):             # insertions: s over u to a
        node = 4 * n + state
        if behind[state] is not None and price[node] == behind[state]:
            take[node] = "."
        elif last and price[node] == INSERT + price[
                to := 4 * n + _NEXT[state]] and take[to]:
            take[node] = "I"
    for row in range(n - 1, -1, -1):
        by_state = _ARCS[codes[row]]
        for _ in range(3):                 # over up to two insertions
            for state in (3, 2, 1, 0):
                node = 4 * row + state
                for letter, d, cost in by_state[state]:
                    if take[node + d] and price[node] == cost + price[
                            node + d]:
                        take[node] = letter
                        break
    return price[:4], take[:4 * n + 4]


def _solve(codes: bytes) -> tuple[int, str]:
    """Cost of the cheapest edits and the least of their audits."""
    cuts = list(range(0, len(codes), SEGMENT)) or [0]
    behind: list[int | None] = [
        0 if s in _ENDS else None for s in range(4)]
    takes = []
    for a in reversed(cuts):
        distance, take = _segment(codes[a:a + SEGMENT], behind)
        behind = list(distance)
        takes.append((a, take))
    out, state = [], 0
    for a, take in reversed(takes):
        n = min(SEGMENT, len(codes) - a)
        node = state
        while take[node] != ".":
            letter = take[node]
            out.append(letter)
            if node >= 4 * n:              # behind the last row
                node = 4 * n + _NEXT[node - 4 * n]
                continue
            node += next(d for x, d, _ in _ARCS[codes[a + node // 4]][
                node % 4] if x == letter)
        state = node - 4 * n
    return behind[0], "".join(out)


_known = lru_cache(maxsize=1 << 16)(_solve)


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """``codes``: a byte for each row, 4 * role + fault. Short conversations
    often agree in them, so a task keeps the latest answers."""
    return _known(codes) if len(codes) <= 32 else _solve(codes)


class _Audit:
    """What is known of the conversation at hand."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes = conv_id, bytearray()
        self.faults, self.illegal = [0] * 4, 0
        self.first = self.last = None
        self.turns = 0

    def add(self, turn: int | None, code: int) -> None:
        if code == _GONE:
            return
        if self.codes:
            pair = self.codes[-1] >> 2, code >> 2
            self.illegal += pair not in ((0, 1), (1, 2), (2, 1))
        self.codes.append(code)
        self.faults[code & 3] += 1
        if turn is not None and turn != self.last:      # ascending
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1

    def row(self) -> tuple:
        cost, audit = cheapest_edits(bytes(self.codes)) if self.codes else (
            0, "")
        gaps = 0 if self.first is None else (
            self.last - self.first + 1 - self.turns)
        return (self.conv_id, gaps, self.faults[BLANK],
                self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal,
                cost, audit)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema,
                                             strict=True)], schema=schema)


def _audit_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema):
    own = None
    for batch in batches:
        done = []
        for conv_id, turn, code in zip(*(batch.column(c).to_pylist() for c in
                                         ("conv_id", "turn", "code")),
                                       strict=True):
            if own is None or conv_id != own.conv_id:
                if own is not None:
                    done.append(own.row())
                own = _Audit(conv_id)
            own.add(turn, code)
        if done:
            yield _batch(done, schema)
    if own is not None:
        yield _batch([own.row()], schema)


class _Repair:
    """Runs the repaired rows of a conversation through SHA-256."""

    def __init__(self, found: tuple):
        self.found, self.audit = found, found[-1]
        self.at = self.state = 0
        self.first, self.hash = True, hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:".encode())
        self.hash.update(text.encode())
        self.first = False

    def _insertions(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            self._put(_ROLE[self.state], "")

    def add(self, role: str, text: str) -> None:
        self._insertions()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = _KEEPS[self.state]["sua".index(role[0])]
            self._put(role, text)
        elif letter == "R":
            self.state = _NEXT[self.state]
            self._put(_ROLE[self.state], text)

    def row(self) -> tuple:
        self._insertions()
        return *self.found, self.hash.hexdigest()


def _repair_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema):
    own = None
    names = _AUDIT.names
    for batch in batches:
        done = []
        text, role = batch.column("text"), batch.column("role")
        kind = batch.column("kind").to_pylist()
        found = zip(*(batch.column(c).to_pylist() for c in names),
                    strict=True)
        for i, values in enumerate(found):
            if kind[i] == 0:
                if own is not None:
                    done.append(own.row())
                own = _Repair(values)
            else:
                own.add(role[i].as_py(), text[i].as_py())
        if done:
            yield _batch(done, schema)
    if own is not None:
        yield _batch([own.row()], schema)


_SPACE = " \t\n\x0b\x0c\r"


def _structure(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn`` and the code of each row, sorted within
    conversations, each in one partition; no texts."""
    end = F.rtrim(F.col("text"), F.lit(_SPACE))
    blank = end == ""
    first = F.substring("role", 1, 1)
    role = F.when(first == "s", 0).when(first == "u", 1).when(
        first == "a", 2).otherwise(OTHER)
    seen = F.row_number().over(W.partitionBy(
        "conv_id", "role", "digest", "gone").orderBy("turn")) > 1
    fault = F.when(F.col("blank"), BLANK).when(seen, DUPLICATE).when(
        F.col("cut"), TRUNCATED).otherwise(SOUND)
    plain = rows.select(
        "conv_id", "turn", "role", "digest", "gone", blank.alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"),
        role.alias("initial"))
    return plain.select(
        "conv_id", "turn", "role", "digest", F.when(
            F.col("gone"), _GONE).otherwise(F.col("initial") * 4 + fault)
        .alias("code")).repartition("conv_id").sortWithinPartitions(
            "conv_id", "turn", "role", "digest")


def repair(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """One row for each ``conv_id`` of ``rows`` (``conv_id``, ``turn``,
    ``role``, ``text``): faults counted, the cheapest edits, the SHA-256 of
    the repaired conversation.

    Rows are taken by turn (nulls first), then role, then the text's MD5. A
    null role or text is a space, so such a row is re-roled or deleted; null
    ids are one conversation. Rows that repeat are duplicates but for the
    first, whatever their turns. Roles count by their first letter; an empty
    role has none. Rows for which ``gone`` holds are left out, but their
    conversation has a row: with zeros, an empty audit and the hash of
    nothing if no other is left. An empty table gives no rows. Long
    conversations and texts are defined alike; other columns aren't read."""
    prepare(rows.sparkSession)
    whole = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.coalesce(gone if gone is not None else F.lit(False), F.lit(False))
        .alias("gone")).withColumn("digest", F.unhex(F.md5("text")))
    found = arrow_map(_structure(whole).select("conv_id", "turn", "code"),
                      _audit_batches, _AUDIT)
    null = {c: F.lit(None).cast(t) for c, t in (
        ("turn", "long"), ("role", "string"), ("text", "string"),
        ("digest", "binary"))}
    audits = found.select(F.lit(0).alias("kind"), *_AUDIT.names,
                          *[v.alias(c) for c, v in null.items()])
    texts = whole.where(~F.col("gone")).select(
        F.lit(1).alias("kind"), "conv_id",
        *[F.lit(None).cast(f.dataType).alias(f.name)
          for f in _AUDIT if f.name != "conv_id"], *null)
    both = audits.unionByName(texts).repartition("conv_id") \
        .sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return arrow_map(both.select("kind", *_AUDIT.names, "role", "text"),
                     _repair_batches, _REPAIRED)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by their digest: one row in twenty each is
    marked ``gone``, emptied, stripped of ``[.!?]``, repeated, or a user's."""
    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.encode(F.concat_ws(":", plain("conv_id"),
                                        plain("turn")), "UTF-8")) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate(
        plain("text"), ".!?", "")).otherwise(plain("text"))
    return rows.select(
        "conv_id", "turn",
        F.when(case == 4, "user").otherwise(plain("role")).alias("role"),
        text.alias("text"), (case == 0).alias("gone"),
        F.explode(F.sequence(F.lit(1), F.when(case == 3, 2).otherwise(1)))
        .alias("copy"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repair(damaged(table(spark, sf_dir, "conversations")),
                  F.col("gone"))
