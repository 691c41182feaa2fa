"""Conversation structure repair: the cheapest edits that make the roles of a
conversation alternate, found by a checkpointed dynamic program.

A well-formed conversation has role initials ``(s?(ua)+)?``: nothing, or an
optional system turn and then pairs of user and assistant.  Edits keep a row
(K, free), give it the role user or assistant (R, 3), delete it (D, 4; blank
rows and repeats of an earlier row must go) or insert an empty user or
assistant row (I, 3); a truncated row that stays adds 3.  Of the cheapest edit
lists the one whose initials come first in ASCII order is taken.

Four states describe what has been written so far (nothing; a system turn; a
user turn last; an assistant turn last).  Going backward over the rows gives
for each state what the rest costs.  Only every ``sqrt(n)``-th of these
vectors is stored; walking forward, the vectors of one block at a time are
computed again from its checkpoint, and in every state the first edit in ASCII
order is taken that is *tight*, that is, whose cost and rest add up to the
state's.  So a conversation of n rows holds O(sqrt(n)) vectors, and a byte of
code for each row.

Spark does the rest.  Rows without their texts (a digest instead) are summed
by conversation, turn, role and digest, so any number of copies is one row
with a count; a grouped minimum, not a window, says which of them comes first.
These rows are dealt by conversation, sorted and streamed through the program.
Then the texts are dealt the same way, behind the edit list of their
conversation, and hashed one after the other.  A conversation's result holds
a letter for each of its rows and one hash over all of its text in order, so
its rows must meet in one stream; that stream holds a byte a row and one
Arrow batch of text, never the conversation (Spark's sort spills to disk).

Defined results: within a turn, rows go by role and then by the SHA-256 of
their text, null turns first.  A role or text that is null counts as one
space.  A role without an initial (empty) can not be kept.  A null ``conv_id``
is a conversation of its own.  A conversation without rows has zeros, no edits
and the hash of the empty string; an empty table gives an empty result.  Other
columns than the four are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import Tables, cut_lineage, ship_package

RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")
#: What stands for white space, and for an end of a sentence, in a text.
_SOLID, _STOPS = "[^\\x20\\x09-\\x0D]", "[.!?]"

INF = 1 << 60
#: State reached by writing a system, user or assistant turn (None: not allowed).
_AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The role a state needs next when a row is given one or inserted.
_NEEDS = ("user", "user", "assistant", "user")
_NEXT = (2, 2, 3, 2)
#: Costs when no row is left: nothing written, or an assistant turn last.
_END = (0, 6, 3, 0)
GIVE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3

# A row's code: kind of its initial (0 s, 1 u, 2 a, 3 other), 4 if it must go, 8 if it is truncated.
_KINDS = "sua"
GONE, CUT = 4, 8


def row_code(initial: str, gone: bool, cut: bool) -> int:
    kind = _KINDS.find(initial) if initial else -1
    return (kind if kind >= 0 else 3) | GONE * gone | CUT * cut


def _choices(code: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of consuming a row, in ASCII order."""
    found = [("D", DELETE, state)]
    if not code & GONE:
        extra = CUT_OFF if code & CUT else 0
        kind = code & 3
        kept = _AFTER[_KINDS[kind]][state] if kind < 3 else None
        if kept is not None:
            found.append(("K", extra, kept))
        found.append(("R", GIVE + extra, _NEXT[state]))
    return found


_TABLE = [[_choices(code, state) for state in range(4)] for code in range(16)]


def back(code: int, rest: tuple[int, ...]) -> tuple[int, ...]:
    """The state costs before a row, from those after it."""
    cost = [min(c + rest[to] for _, c, to in _TABLE[code][state]) for state in range(4)]
    after_u, after_a = cost[2], cost[3]
    cost[2] = min(after_u, INSERT + after_a)
    cost[3] = min(after_a, INSERT + after_u)
    cost[0] = min(cost[0], INSERT + cost[2])
    cost[1] = min(cost[1], INSERT + cost[2])
    return tuple(cost)


def repair(codes: bytes) -> tuple[int, str]:
    """Cost and edits of one conversation, given its rows' codes."""
    n = len(codes)
    step = max(1, math.isqrt(n))
    checkpoints = {n: _END}
    rest = _END
    for i in range(n - 1, -1, -1):
        rest = back(codes[i], rest)
        if i % step == 0:
            checkpoints[i] = rest
    total, state, audit = rest[0], 0, []

    def insert_while_tight(here: tuple[int, ...], cheaper) -> None:
        nonlocal state
        while not cheaper(state) and here[state] == INSERT + here[_NEXT[state]]:
            audit.append("I")
            state = _NEXT[state]

    for start in range(0, n, step):
        end = min(start + step, n)
        block = [checkpoints[end]]
        for i in range(end - 1, start - 1, -1):
            block.append(back(codes[i], block[-1]))
        block.reverse()
        for i in range(start, end):
            here, then = block[i - start], block[i - start + 1]
            # D comes before I, and I before K and R
            insert_while_tight(here, lambda s: here[s] == DELETE + then[s])  # noqa: B023
            for edit, cost, to in _TABLE[codes[i]][state]:
                if here[state] == cost + then[to]:
                    audit.append(edit)
                    state = to
                    break
    insert_while_tight(_END, lambda s: _END[s] == 0)
    return total, "".join(audit)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``times`` (0: dropped, 2: repeated) of
    every row, by crc32 of ``conv_id:turn``."""
    one = F.lit(" ")
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    key = F.concat(F.coalesce(conv.cast("string"), one), F.lit(":"), F.coalesce(turn.cast("string"), one))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), one)
    return rows.select(
        conv.alias("conv_id"), turn.alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), one)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, _STOPS, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("kind"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _counted(rows: DataFrame) -> DataFrame:
    """A row for each conversation, turn, role and text: how often it stands
    there, whether it is the first of its role and text, its faults."""
    last = F.regexp_extract(F.col("text"), f"({_SOLID})[\\x20\\x09-\\x0D]*\\z", 1)
    narrow = rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), F.col("times").cast("long").alias("times"),
        (~F.col("text").rlike(_SOLID)).alias("blank"), (~last.rlike(_STOPS)).alias("cut"))
    key = ["conv_id", "turn", "role", "digest"]
    summed = narrow.groupBy(*key).agg(F.sum("times").alias("times"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    there = summed.where(F.col("times") > 0)
    # the least turn, nulls first
    first = there.groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))).alias("m"))
    marks = first.select("conv_id", F.col("m.turn").alias("turn"), "role", "digest", F.lit(0).cast("long").alias("times"),
                         F.lit(None).cast("boolean").alias("blank"), F.lit(None).cast("boolean").alias("cut"), F.lit(1).alias("first"))
    marked = summed.withColumn("first", F.lit(0)).unionByName(marks)
    return marked.groupBy(*key).agg(F.sum("times").alias("times"), F.max("blank").alias("blank"), F.max("cut").alias("cut"),
                                    (F.max("first") == 1).alias("first"))


class _Conversation:
    """The rows of one conversation as they come by, in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes = conv_id, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least: int | None = None
        self.most: int | None = None
        self.last: str | None = None

    def add(self, turn: int | None, initial: str, times: int, first: bool, blank: bool, cut: bool) -> None:
        if not times:
            return
        if turn is not None and turn != self.most:  # in order, so a new turn
            self.least = turn if self.least is None else self.least
            self.most, self.turns = turn, self.turns + 1
        if blank:
            self.blank += times
            self.codes += bytes([row_code(initial, True, False)]) * times
        else:
            again = times - first
            self.duplicate += again
            if first:
                self.truncated += cut
                self.codes.append(row_code(initial, False, cut))
            self.codes += bytes([row_code(initial, True, False)]) * again
        fits = ("su", "ua", "au")
        self.illegal += self.last is not None and self.last + initial not in fits
        self.illegal += (times - 1) * (initial + initial not in fits)
        self.last = initial

    def result(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        cost, audit = repair(bytes(self.codes))
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted counted rows in, one row a conversation out."""
    schema = pa.schema([(n, pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
                       + [("audit", pa.string())])
    done: list[tuple] = []
    now: _Conversation | None = None
    letters = 0

    def packed() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*done), schema)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        names = ("conv_id", "turn", "initial", "times", "first", "blank", "cut")
        for conv, *row in zip(*(batch.column(n).to_pylist() for n in names)):
            if now is None or conv != now.conv_id:
                if now is not None:
                    done.append(now.result())
                    letters += len(done[-1][-1])
                now = _Conversation(conv)
                if len(done) >= 2000 or letters > 1 << 22:
                    yield packed()
                    done, letters = [], 0
            now.add(*row)
    if now is not None:
        done.append(now.result())
    if done:
        yield packed()


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edit list of each conversation (kind 0) and then its rows in order
    (kind 1) in, the hash of the repaired conversation out."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    ids: list = []
    hashes: list[str] = []
    audit, at, state, digest, begun = "", 0, 0, hashlib.sha256(), False

    def write(role: str, text: str) -> None:
        nonlocal begun
        digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
        begun = True

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            write(_NEEDS[state], "")
            state, at = _NEXT[state], at + 1

    def close() -> None:
        inserts()
        hashes.append(digest.hexdigest())

    for batch in batches:
        for conv, kind, edits, role, text, times in zip(*(batch.column(n).to_pylist() for n in (
                "conv_id", "kind", "audit", "role", "text", "times"))):
            if kind == 0:
                if ids:
                    close()
                ids.append(conv)
                audit, at, state, digest, begun = edits, 0, 0, hashlib.sha256(), False
                if len(ids) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[:-1], pa.int64()), pa.array(hashes, pa.string())], schema=schema)
                    ids, hashes = ids[-1:], []
                continue
            for _ in range(times):
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    write(role, text)
                    state = _AFTER[role[0]][state]
                elif edit == "R":
                    write(_NEEDS[state], text)
                    state = _NEXT[state]
    if ids:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], schema=schema)


def repair_conversations(rows: DataFrame, times: str | None = None) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text):
    faults, the edits and the hash of what they make.  ``times`` names a column
    that says how often a row stands there (0: its conversation is known, but
    the row is gone)."""
    spark = rows.sparkSession
    ship_package(spark)
    one = F.lit(" ")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), one).alias("role"),
                       F.coalesce(F.col("text").cast("string"), one).alias("text"),
                       (F.col(times) if times else F.lit(1)).cast("int").alias("times"))
    counted = _counted(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest",
                                    F.substring("role", 1, 1).alias("initial"), "times", "first", "blank", "cut")
    tables = Tables(spark)
    plan = tables.write(
        counted.repartition("conv_id").sortWithinPartitions(*_order())
        .mapInArrow(_plan, RESULT.removesuffix(", repaired_sha256 string")), "repairs")
    texts = rows.where(F.col("times") > 0).select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text",
        "times", F.lit("").alias("audit"))
    lists = plan.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                        F.lit(None).cast("binary").alias("digest"), F.lit("").alias("text"), F.lit(0).alias("times"), "audit")
    hashes = (lists.unionByName(texts).repartition("conv_id").sortWithinPartitions(*_order())
              .select("conv_id", "kind", "audit", "role", "text", "times")
              .mapInArrow(_hash, "conv_id long, repaired_sha256 string"))
    joined = plan.alias("p").join(hashes.alias("h"), F.col("p.conv_id").eqNullSafe(F.col("h.conv_id")))
    out = cut_lineage(joined.select("p.*", "h.repaired_sha256"), "repaired")
    tables.drop()
    return out
