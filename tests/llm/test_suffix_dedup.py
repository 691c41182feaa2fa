"""Repeated passages against a plain window table; suffix order against sorting."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskfold.llm import common, induced_sort, suffix_dedup
from riskfold.llm.queries import op4_suffix_dedup
from tests.conftest import SF_MID
from tests.llm.helpers import docs


def brute(rows):
    least = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for p in range(len(raw) - 49):
            w = raw[p:p + 50]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if least[raw[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        spans = sum(gone[p] and not (p and gone[p - 1]) for p in range(len(raw)))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_all_documents_against_window_table(spark):
    src = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op4_suffix_dedup(spark, SF_MID).collect())
    assert got == brute([(r.doc_id, r.text) for r in src])


def test_odd_texts(spark):
    r = random.Random(2)
    words = ["ab", "é", "zz", "longer", "x"]
    passage = " ".join(r.choice(words) for _ in range(40))
    texts = [None, "", "a" * 49, "a" * 50, "a" * 51, "b" + "a" * 300, "abab" * 40, "ba" * 80, passage, "x " + passage, passage[:70] + "Q" + passage[70:],
             passage * 3, "\0" * 60, "\0" * 49 + "\1", "é" * 25, "é" * 40, passage, "tail " + passage[-49:], "tail " + passage[-50:]]
    texts += [passage[r.randrange(60):][:r.randrange(20, 120)] + str(r.random()) for _ in range(40)]
    d = docs(spark, texts, first=-3).withColumn("grp", F.lit("clash")).withColumn("kept", F.lit(1))
    rows = suffix_dedup.remove_repeats(d, with_text=True).collect()
    want = brute([(i - 3, t) for i, t in enumerate(texts)])
    assert sorted(tuple(x)[:5] for x in rows) == want
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in rows)
    assert suffix_dedup.remove_repeats(d.limit(0)).count() == 0


def test_repeated_ids_with_other_texts(spark):
    r = random.Random(4)
    other = "".join(r.choice("abcdefgh ") for _ in range(200))
    passage = "".join(r.choice("ABCDEFGH ") for _ in range(73))
    rows = [(1, passage), (7, passage + "01234"), (7, other), (7, other), (7, None), (9, other + passage), (None, other), (7, "x" + other)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x)[:4] for x in suffix_dedup.remove_repeats(d).collect()), key=lambda x: (x[0] is None, x))
    assert got == [(1, 73, 0, 0), (7, 0, 0, 0), (7, 78, 73, 1), (7, 200, 0, 0), (7, 200, 0, 0), (7, 201, 0, 0), (9, 273, 273, 1), (None, 200, 0, 0)]
    left = sorted((x.doc_id, x.text) for x in suffix_dedup.strip_repeats(d).where("doc_id = 7 and text is not null").collect())
    assert left == sorted([(7, "01234"), (7, other), (7, other), (7, "x" + other)])


def test_strip_keeps_columns_of_any_name(spark):
    r = random.Random(6)
    passage = "".join(r.choice("ABCDEFGH ") for _ in range(80))
    rows = [("3", passage, 1, "p", None), ("12", "x" + passage, 2, "q", 5), ("12", None, 3, "r", None), (None, passage, 4, "s", 1), ("20", "", 5, "t", 2)]
    d = spark.createDataFrame(rows, "doc_id string, text string, GRP int, key string, row long")
    out = suffix_dedup.strip_repeats(d)
    assert out.schema == d.schema
    # ids are compared as numbers, so 12 is not the smaller one
    assert sorted(map(tuple, out.collect()), key=lambda x: x[2]) == [rows[0], ("12", "x", 2, "q", 5), *rows[2:]]
    assert suffix_dedup.strip_repeats(d.limit(0)).count() == 0


def hot_texts():
    """A third of all texts hold one phrase among other words each; patterns
    that repeat inside a window; whole copies."""
    r = random.Random(8)
    phrase = "the quick brown fox jumps"
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    noise = lambda n: " ".join(word() for _ in range(n))
    texts = [noise(12) + " " + phrase + " " + noise(12) for _ in range(60)]
    texts += [r.choice("ab")[:1] * r.randrange(3) + phrase + " over the lazy dog by the river" + r.choice(["", "x", "xy"]) + noise(3) for _ in range(60)]
    texts += [noise(2) + pattern * r.randrange(5, 30) + noise(2) for pattern in ("ab", "-", "lorem ", "0123456789", phrase) for _ in range(8)]
    texts += [r.choice(texts) for _ in range(20)] + [noise(20) for _ in range(30)]
    return texts


@pytest.mark.parametrize("hot", [0, 40])
def test_hot_grams_against_brute_force(spark, hot):
    texts = hot_texts()
    got = sorted(tuple(x) for x in suffix_dedup.remove_repeats(docs(spark, texts), hot=hot).collect())
    assert got == brute(list(enumerate(texts)))


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_hot_contexts_are_split_by_what_windows_share(block, monkeypatch):
    texts = hot_texts()
    raws = [t.encode() for t in texts]
    joined = b"".join(raws)
    _, h, first, stop = suffix_dedup.contexts_of(raws)
    pieces = [joined[a:b + 49] for a, b in zip(first, stop, strict=True)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    number, skip, windows, deal = suffix_dedup.split_hot(pieces, h)
    seen, key = set(), {}
    for i, a, n, d in zip(number.tolist(), skip.tolist(), windows.tolist(), deal.tolist(), strict=True):
        for p in range(a, a + n):
            assert (i, p) not in seen and p + 50 <= len(pieces[i])
            seen.add((i, p))
            assert key.setdefault((h[i], pieces[i][p:p + 50]), d) == d
    assert len(seen) == sum(len(p) - 49 for p in pieces)
    # windows dealt together share all but less than STEP bytes, so one phrase's contexts go to many places
    together: dict[int, set[bytes]] = {}
    for (i, p), d in ((w, d) for i, a, n, d in zip(number.tolist(), skip.tolist(), windows.tolist(), deal.tolist(), strict=True)
                      for w, d in (((i, p), d) for p in range(a, a + n))):
        parts = {pieces[i][p + k:p + k + 47] for k in range(4)}
        together[d] = together.get(d, parts) & parts
    assert all(together.values())
    hot = np.argmax(np.bincount(np.unique(h, return_inverse=True)[1]))
    mine = np.unique(h, return_inverse=True)[1][number] == hot
    assert len(np.unique(number[mine])) > 50 and len(np.unique(deal[mine])) > 100


def test_repeated_rows(spark):
    d = docs(spark, ["q" * 80, "q" * 80, "q" * 80]).withColumn("doc_id", F.lit(4).cast("long"))
    got = [tuple(x) for x in suffix_dedup.remove_repeats(d.union(docs(spark, ["q" * 80], first=9))).collect()]
    assert sorted(x[:4] for x in got) == [(4, 80, 0, 0)] * 3 + [(9, 80, 80, 1)]


@pytest.mark.parametrize("seed", range(60))
def test_induced_order_and_common_prefixes(seed, monkeypatch):
    r = random.Random(seed)
    letters = r.choice([b"a", b"ab", b"abc", bytes(range(256)), b"\x00\xff"])
    strings = [bytes(r.choice(letters) for _ in range(r.randint(1, r.choice([3, 30, 90])))) for _ in range(r.randint(1, 30))]
    strings += [r.choice(strings) for _ in range(r.randint(0, 10))]
    depth = r.choice([3, 8, 50])
    monkeypatch.setattr(induced_sort, "CHUNK", r.choice([16, 200, 1 << 18]))
    with induced_sort.InducedSorter(depth, r.choice([0, 1000, 1 << 20])) as sorter:
        for i in range(0, len(strings), 7):
            sorter.add(strings[i:i + 7])
        got = [(int(a), int(n)) for w in sorter.sort() for a, n in zip(w["at"], w["lcp"], strict=True)]
    suffixes, at = {}, 0
    for s in strings:
        suffixes |= {at + i: s[i:] for i in range(len(s))}
        at += len(s) + 1
    assert sorted(p for p, _ in got) == sorted(suffixes)
    for (p, _), (q, n) in zip(got[:-1], got[1:], strict=True):
        a, b = suffixes[p], suffixes[q]
        common = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert a[:depth] >= b[:depth] and min(common, depth) == min(n, depth)


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_contexts_cover_every_window_once(block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    r = random.Random(5)
    raws = [bytes(r.choice(b"ab c") for _ in range(r.choice([0, 10, 49, 50, 51, 200, 900]))) for _ in range(60)]
    text, h, first, stop = suffix_dedup.contexts_of(raws)
    begins = [sum(map(len, raws[:i])) for i in range(len(raws))]
    seen, key = set(), {}
    joined = b"".join(raws)
    for t, g, a, b in zip(text, h, first, stop, strict=True):
        for p in range(a, b):
            assert begins[t] <= p and p + 50 <= begins[t] + len(raws[t]) and p not in seen
            seen.add(p)
            assert key.setdefault(joined[p:p + 50], g) == g
    assert len(seen) == sum(max(0, len(x) - 49) for x in raws)


def packed_contexts(rows):
    raws = [t.encode() for _, t in rows]
    begins = [sum(map(len, raws[:i])) for i in range(len(raws))]
    text, _, first, stop = suffix_dedup.contexts_of(raws)
    joined = b"".join(raws)
    pieces = [joined[a:b + 49] for a, b in zip(first, stop, strict=True)]
    base = np.array(begins, np.int64)[text]
    ids = np.array([i for i, _ in rows], np.int64)[text]
    return suffix_dedup._pack(ids, ids, first - base, stop - first, pieces), len(pieces)


@pytest.mark.parametrize("rows,chunk", [(16, 16), (300, 200), (1 << 17, 1 << 18)])
def test_shard_in_blocks(rows, chunk, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ROWS", rows)
    monkeypatch.setattr(induced_sort, "CHUNK", chunk)
    r = random.Random(rows)
    phrase = "".join(r.choice("abcdef ") for _ in range(90))
    texts = [(i, phrase[r.randrange(30):][:r.randrange(50, 90)] * r.randrange(1, 3) + str(r.random()) + phrase[:60] + "".join(r.choice("ab") for _ in range(70)))
             for i in range(60)] + [(i, phrase * 2) for i in range(60, 90)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 4, pa.int32()), pa.nulls(4, pa.int32()), pa.nulls(4, pa.int64()), pa.nulls(4, pa.int64()),
                                        pa.array([packed_contexts(texts[i::4])[0] for i in range(4)], pa.binary())],
                                       ["grp", "row", "first", "stop", "contexts"])
    found = pa.Table.from_batches(list(suffix_dedup._settle(iter([batch]))))
    spans = suffix_dedup._spans(found)
    got = []
    for i, t in texts:
        left, runs = suffix_dedup.cut(t.encode(), spans.get(i, []))
        got.append((i, len(t), len(t) - len(left), runs, hashlib.sha256(left).hexdigest()))
    assert got == brute(texts)


def test_shard_keeps_no_contexts_in_memory():
    r = random.Random(3)
    packed = [packed_contexts([(i, "".join(r.choice("abcdefgh ") for _ in range(20_000)))]) for i in range(40)]
    with induced_sort.InducedSorter(50) as sorter:
        shard = suffix_dedup._Shard(sorter)
        tracemalloc.start()
        for p, _ in packed:
            shard.add(0, p)
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
    assert held < 50 * sum(n for _, n in packed)


def test_shards_follow_the_input(spark, monkeypatch):
    few = suffix_dedup._groups(docs(spark, ["x" * 1000]))
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 10)
    assert suffix_dedup._groups(docs(spark, ["x" * 1000])) == (few[0], 100) and few[1] < 100


def test_only_contexts_that_share_their_gram_are_sorted(monkeypatch):
    r = random.Random(8)
    text = lambda n: bytes(r.choice(b"abcdefgh ") for _ in range(n))
    alone, start = text(60), text(54)
    pieces = [alone, alone, start + b"x", start + b"y"]                # the last two share their first five windows
    windows = [len(p) - 49 for p in pieces]
    monkeypatch.setattr(suffix_dedup, "_first_gram", lambda raw, at: np.array([bytes(raw[i:i + 9]) == start[:9] for i in at], np.uint64))
    with induced_sort.InducedSorter() as sorter:
        shard = suffix_dedup._Shard(sorter)
        shard.add(0, suffix_dedup._pack(np.arange(4), np.arange(4), np.zeros(4), np.array(windows), pieces))
        found = sorted(tuple(x) for rows in shard.repeats() for x in rows.tolist())
        assert found == [(0, 1, 0, 11), (0, 3, 0, 5)]
        assert sorter.n == 2 * (len(start) + 2)                        # equal ones need no sort, nor does what shares no gram


def test_the_gram_of_a_context_is_that_of_its_first_window():
    raws = [t.encode() for t in hot_texts()]
    _, h, first, _ = suffix_dedup.contexts_of(raws)
    data = np.frombuffer(b"".join(raws), np.uint8)
    assert np.array_equal(suffix_dedup._first_gram(data, first), h)


def test_workers_give_freed_memory_back(monkeypatch):
    events = []

    def tables(batches):
        held = Held()
        yield from batches
        del held

    class Held:
        def __del__(self):
            events.append("freed")

    real = common.release_memory
    monkeypatch.setattr(common, "release_memory", lambda: events.append("released"))
    batch = pa.record_batch({"x": [1]})
    assert list(common.releasing(tables)(iter([batch]))) == [batch]
    assert events == ["freed", "released"]
    real()
