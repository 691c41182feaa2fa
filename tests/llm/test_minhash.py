"""Near-duplicate classes against comparing all texts, and the estimator."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from riskfold.llm import minhash
from riskfold.llm.components import components
from riskfold.llm.queries import op9_near_duplicates
from tests.conftest import SF_MID
from tests.llm.helpers import docs


def shingle_counts(text):
    words = (text or "").split()
    if not words:
        return Counter()
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def similarity(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def brute_classes(texts: dict[int, str | None], least=0.8):
    sets = {i: shingle_counts(t) for i, t in texts.items()}
    sums = {i: sum(s.values()) for i, s in sets.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts, key=lambda i: sums[i])
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if sums[i] < least * sums[j]:
                break
            if root(i) != root(j) and similarity(sets[i], sets[j]) >= least:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in texts}


def test_all_documents_against_all_pairs(spark):
    src = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.class_id for r in op9_near_duplicates(spark, SF_MID).collect()}
    assert got == brute_classes({r.doc_id: r.text for r in src})


def test_large_families_and_odd_texts(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [r.choice(words) for _ in range(150)]
    texts: list[str | None] = [None, "", " \n", "one", "one", "two words", "a b c d", "a b  c\nd", "rep eat " * 3000, "rep eat " * 2990]
    for _ in range(300):  # a family whose members drift from each other
        copy = list(base)
        for _ in range(r.randint(0, 4)):
            copy[r.randrange(150)] = r.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(r.choice(words) for _ in range(60)) for _ in range(40)]
    d = docs(spark, texts, first=5).withColumn("class_id", F.lit("clash")).withColumn("keys", F.lit(1))
    want = brute_classes({5 + i: t for i, t in enumerate(texts)})
    old = minhash.BLOCK
    try:
        minhash.BLOCK = 16  # several blocks in a bucket
        got = {x.doc_id: x.class_id for x in minhash.near_duplicates(d).collect()}
    finally:
        minhash.BLOCK = old
    assert got == want
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def test_hot_keys_are_bounded_and_dealt_in_pieces(spark):
    sizes = spark.range(1, 20_001).select(F.col("id").alias("key"), F.when(F.col("id") == 5, 50_000).otherwise(2).cast("long").alias("n"))
    hot = minhash._hot_keys(sizes)
    share = -(-(50_000 + 2 * 19_999) // minhash.HOT_KEYS)
    assert [tuple(r) for r in hot.collect()] == [(5, -(-50_000 // share))]
    rows = minhash._with_pieces(sizes.where("key < 8").select("key"), hot)
    assert minhash._by_piece(rows).groupBy("key").count().where("key = 5").first()["count"] == -(-50_000 // share)
    even = minhash._hot_keys(sizes.withColumn("n", F.lit(7)))
    assert even.count() == 0 or even.count() < minhash.HOT_KEYS
    assert minhash._hot_keys(sizes.limit(0)).count() == 0


def test_repeated_rows_keep_their_number(spark):
    d = docs(spark, ["x y z a b c"] * 3).withColumn("doc_id", F.lit(7).cast("long"))
    assert [tuple(r) for r in minhash.near_duplicates(d).collect()] == [(7, 7)] * 3


def test_share_of_equal_coordinates_is_the_similarity():
    r = random.Random(1)
    a = [str(r.randrange(40)) for _ in range(400)]
    b = a[:330] + [str(r.randrange(60)) for _ in range(60)]
    hashes = minhash.WordHashes()
    sig = minhash.dart_signatures(2, *minhash.counted(*minhash.shingles([" ".join(a), " ".join(b)], hashes, 1)), 2048)
    ca, cb = Counter(a), Counter(b)
    want = similarity(ca, cb)
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 2048)
    ga, gb = minhash.grams(" ".join(a), hashes, 1), minhash.grams(" ".join(b), hashes, 1)
    assert abs(minhash.jaccard(ga, gb) - want) < 1e-12


def test_signatures_do_not_depend_on_the_batch():
    hashes = minhash.WordHashes()
    texts = ["a b c d e f g", "q " * 500, "", "z"]
    together = minhash.dart_signatures(4, *minhash.counted(*minhash.shingles(texts, hashes)), 64)
    for i, t in enumerate(texts):
        alone = minhash.dart_signatures(1, *minhash.counted(*minhash.shingles([t], hashes)), 64)
        assert (alone[0] == together[i]).all()


def test_components_of_random_graphs(spark):
    r = random.Random(3)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    linked = {i for a, b in pairs if a != b for i in (a, b)}
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: root(i) for i in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
