"""Conversation repair against a plain search over all edit lists."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import pytest

from riskfold.llm import conversation_repair as cr
from riskfold.llm.queries import op12_conversation_repair
from tests.conftest import SF_MID

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Faults and the cheapest, then ASCII-least, edits by forward search over
    (role initials written so far collapse to four endings)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    ends = {"": (0, "", ())}  # what the written initials end in -> (cost, audit, repaired rows)

    def step(end, initial):
        new = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((end, initial))
        return new

    def better(found, end, value):
        if end not in found or value[:2] < found[end][:2]:
            found[end] = value

    def inserted(found):
        for _ in range(3):
            for end, (cost, audit, done) in list(found.items()):
                for role in ("user", "assistant"):
                    if new := step(end, role[0]):
                        better(found, new, (cost + 3, audit + "I", done + (f"{role}:",)))
        return found

    ends = inserted(ends)
    for (_, _, role, text), fault in zip(rows, faults):
        found = {}
        for end, (cost, audit, done) in ends.items():
            better(found, end, (cost + 4, audit + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            if new := step(end, role[:1]):
                better(found, new, (cost + extra, audit + "K", done + (f"{role}:{text}",)))
            for other in ("user", "assistant"):
                if new := step(end, other[0]):
                    better(found, new, (cost + 3 + extra, audit + "R", done + (f"{other}:{text}",)))
        ends = inserted(found)
    cost, audit, done = min(v for end, v in ends.items() if end in ("", "a"))
    turns = [t for _, t, _, _ in rows if t is not None]
    initials = [r[2][:1] for r in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())


def want(rows, damaged=True):
    left = plain_damage(rows) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    return {conv: plain_repair([r for r in left if r[0] == conv]) for conv in {r[0] for r in rows}}


def got(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def test_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op12_conversation_repair(spark, SF_MID)) == want(rows)


def odd_rows():
    import random

    rng = random.Random(7)
    roles = ["system", "user", "assistant", "tool", "", None, "user", "assistant"]
    texts = ["Yes.", "No", "", " \t\n", None, "What?  ", "Go! \x0b", "x" * 5000 + ".", "ends with nbsp ", "é!", "a\nb."]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randrange(14))]
    rows += [(900, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(2500)]           # long
    rows += [(901, 5, "user", "Again.")] * 400 + [(901, 6 + i, "user", "Again.") for i in range(50)]  # one row over and over
    rows += [(902, None, None, None)] * 3
    rows += [(c, 0, "user", "Hello.") for c in range(2000, 2060)]  # some lose their only row
    return rows


@pytest.mark.parametrize("damaged", [True, False])
def test_odd_conversations(spark, damaged):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS digest", "1 AS times", "2 AS kind", "'K' AS audit")
    out = got(cr.repair_conversations(cr.damage(df), times="times") if damaged else cr.repair_conversations(df))
    assert out == want(rows, damaged)
    if damaged:
        empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert empty in out.values()


def test_empty_table(spark):
    assert cr.repair_conversations(cr.damage(spark.createDataFrame([], SCHEMA)), times="times").count() == 0


@pytest.mark.parametrize("n", range(7))
def test_every_short_list_of_codes(n):
    """All conversations of up to a few rows, against trying every edit list."""
    kinds = [0, 1, 2, 3, cr.GONE | 1, cr.CUT | 2] if n < 5 else [0, 1, 2, cr.GONE | 1]
    for codes in itertools.product(kinds, repeat=n):
        cost, audit = cr.repair(bytes(codes))
        heap = {(0, ""): (0, "")}  # (row, end) -> best
        for i in range(n + 1):
            for end in ("", "s", "u", "a", "u"):  # inserts go round once
                if (i, end) in heap:
                    c, a = heap[i, end]
                    nxt = "a" if end == "u" else "u"
                    heap[i, nxt] = min(heap.get((i, nxt), (1 << 30, "")), (c + 3, a + "I"))
            if i == n:
                break
            code, extra = codes[i], 3 * bool(codes[i] & cr.CUT)
            for end in ("", "s", "u", "a"):
                if (i, end) not in heap:
                    continue
                c, a = heap[i, end]
                options = [(end, c + 4, a + "D")]
                if not code & cr.GONE:
                    initial = "sua?"[code & 3]
                    if end + initial in ("s", "u", "su", "ua", "au"):
                        options.append((initial, c + extra, a + "K"))
                    options.append(("a" if end == "u" else "u", c + 3 + extra, a + "R"))
                for to, cc, aa in options:
                    heap[i + 1, to] = min(heap.get((i + 1, to), (1 << 30, "")), (cc, aa))
        assert (cost, audit) == min(heap[n, end] for end in ("", "a") if (n, end) in heap)


def test_checkpoints_bound_what_is_held():
    assert cr.repair(bytes([1, 2] * 50_000)) == (0, "K" * 100_000)
