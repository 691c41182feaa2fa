"""Token counts and packing against direct encoding."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskfold.llm import packing, token_counts
from riskfold.llm.queries import op6_best_fit_packing, op8_token_counts, tokenizer_file
from tests.conftest import SF_SMALL
from tests.llm.helpers import docs

ODD = [None, "", " ", "  ", "\n\n a", "a  b\t\tc ", "it's  we'll DON'T", "x<|endoftext|> y", "a  <|endoftext|>b", "naïve Σ ΟΔΟΣ İ",
       "\x1c a\x1fb", "1234 5.6", "é é", "a b  c", "🙂🙂 ok", "w" * 5000, "dup dup", "dup dup", "<|startoftext|>q"]


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))


def expected_counts(tok, texts):
    return [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_counts_of_odd_texts(spark, byte_bpe):
    df = docs(spark, ODD).withColumn("n_tokens", F.lit("clash")).withColumn("frequent", F.lit(1))
    got = {r.doc_id: r for r in token_counts.count_tokens(df, tokenizer_file("byte_bpe_50k.json"), limit=5, frequent=4).collect()}
    want = expected_counts(byte_bpe, ODD)
    assert [got[i].n_tokens for i in range(len(ODD))] == want
    assert [got[i].n_bytes for i in range(len(ODD))] == [len((t or "").encode()) for t in ODD]
    assert [got[i].over_limit for i in range(len(ODD))] == [n > 5 for n in want]


def test_counts_of_all_documents(spark, byte_bpe):
    src = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in op8_token_counts(spark, SF_SMALL).collect()}
    want = expected_counts(byte_bpe, [r.text for r in src])
    assert got == {r.doc_id: (n, n > 1024) for r, n in zip(src, want, strict=True)}


def test_cache_overflow_keeps_counts(byte_bpe):
    counter = token_counts.GroupCounts(byte_bpe, {"a": 1}, capacity=3)
    texts = [f"word{i} other{i * 7} a" for i in range(50)]
    assert [counter.count([t])[0] for t in texts] == expected_counts(byte_bpe, texts)


def test_empty_tables(spark):
    none = docs(spark, ["x"]).limit(0)
    assert token_counts.count_tokens(none, tokenizer_file("byte_bpe_50k.json")).count() == 0
    assert packing.pack(none, tokenizer_file("word_bpe_49k.json")).count() == 0


def check_packing(rows, texts, tok, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts.items():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted(by_doc.pop(doc_id), key=lambda r: r.piece)
        assert [(p.piece, p.start, p.length) for p in parts] == [
            (k, at, min(capacity, len(ids) - at)) for k, at in enumerate(range(0, len(ids), capacity))]
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes())
    assert not by_doc
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_seq)


def test_packing_of_all_documents(spark, word_bpe):
    src = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = op6_best_fit_packing(spark, SF_SMALL).collect()
    used = check_packing(rows, {r.doc_id: r.text for r in src}, word_bpe, 4096)
    assert used <= -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_of_odd_texts(spark, word_bpe):
    df = docs(spark, ODD).withColumn("length", F.lit("clash")).withColumn("bucket", F.lit(None).cast("int"))
    rows = packing.pack(df, tokenizer_file("word_bpe_49k.json"), capacity=8).collect()
    check_packing(rows, dict(enumerate(ODD)), word_bpe, 8)


def test_small_word_cache_keeps_ids(word_bpe):
    words = packing.WordIds(word_bpe, capacity=4)
    texts = [*(t or "" for t in ODD), "Été été. the THE, the. naïve!! x|| a's don't ß ÿ. µ ª é\u0301 e\u0301 ...a -b- a_b 1a $9", "the été the x"] * 2
    for t in texts:
        assert words.encode([t])[0].tolist() == word_bpe.encode(t, add_special_tokens=False).ids, t
    for got, t in zip(words.encode(texts), texts, strict=True):
        assert got.tolist() == word_bpe.encode(t, add_special_tokens=False).ids


def smallest_number(sizes, capacity):
    """Fewest sequences, by trying every placement."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= sizes[i]:
                rest = list(bins)
                rest.remove(room)
                go(i + 1, [*rest, room - sizes[i]])
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_dominance_keeps_the_optimum(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 20, 50])
    sizes = sorted((r.randint(1 + capacity // 5, capacity) for _ in range(r.randint(1, 9))), reverse=True)
    histogram = {s: sizes.count(s) for s in sizes}
    plan = packing.Plan(capacity, histogram)
    fixed = plan.reduce()
    rest = [s for s, n in plan.left.items() for _ in range(n)]
    assert fixed + smallest_number(sorted(rest, reverse=True), capacity) == smallest_number(sizes, capacity)


def test_words_are_kept_together_and_survive_a_full_cache():
    """op6: ids of many words are stored at once, through shrinking too."""
    from riskfold.llm.packing import WordIds
    from riskfold.llm.queries import tokenizer_file
    from riskfold.llm.token_counts import load_tokenizer

    tokenizer = load_tokenizer(tokenizer_file("word_bpe_49k.json"))
    words = WordIds(tokenizer, capacity=20)
    texts = [" ".join(f"Wort{'aäéß'[i % 4]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}!? plain Straße, x{i}" for i in range(j, j + 40)) for j in range(0, 400, 20)]
    for _ in range(2):
        for text in texts:
            assert words.encode([text, ""])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    words._put([len(words.starts), len(words.starts) + 1], [2, 1], [7, 8, 9])
    assert words.ids[words.used - 3:words.used].tolist() == [7, 8, 9]


def test_new_words_are_spelled_together(word_bpe, monkeypatch):
    words = packing.WordIds(word_bpe)
    spelled = []
    monkeypatch.setattr(words, "_spelled", lambda letters: spelled.append(letters) or packing.WordIds._spelled(words, letters))
    letters = [chr(c) for c in range(0xC0, 0x100)]
    texts = ["The " + " ".join(letters), " ".join(f"a{c}{c.lower()}z!?" for c in letters), "one\x1ctwo\nthree the\n", "K İz Σ ...", "\x1f\n\n"]
    for got, t in zip(words.encode(texts), texts, strict=True):
        assert got.tolist() == word_bpe.encode(t, add_special_tokens=False).ids, t
    assert len(spelled) == 1                                 # not once for each new word


def test_packing_holds_the_words_of_a_small_slice(spark, monkeypatch):
    """A worker splits at most a megabyte of text at once, and gives freed memory back when a task ends."""
    import pyarrow as pa

    from riskfold.llm import packing

    class Words:
        seen: list[int] = []

        def encode(self, texts):
            self.seen.append(sum(map(len, texts)))
            return [np.zeros(1, np.uint32) for _ in texts]

    rows = ["word " * 20_000] * 30 + ["x" * (3 << 20)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(31)), "text": rows})
    found = [i for b in packing._piece_batches(iter([batch]), Words(), 4096, 1) for i in b.column("doc_id").to_pylist()]
    assert found == list(range(31))
    assert sum(Words.seen) == sum(map(len, rows)) and max(Words.seen[:-1]) <= 1 << 20 and Words.seen[-1] == 3 << 20
    given = []
    monkeypatch.setattr(packing, "releasing", lambda fn: given.append(fn) or fn)
    packing.token_pieces(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "unused.json")
    assert len(given) == 1
