"""The pipeline against brute-force versions of its stages, and null ids."""

from __future__ import annotations

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from riskfold.llm import langid, packing, quality, suffix_dedup, token_counts
from riskfold.llm.queries import tokenizer_file
from tests.conftest import SF_SMALL
from tests.llm.helpers import docs
from tests.llm.test_minhash import brute_classes
from tests.llm.test_pii import brute as brute_pii
from tests.llm.test_tokens import check_packing


def strip(texts):
    """Texts without the bytes of 50-byte strings that a smaller id has."""
    least = {}
    for i, t in texts.items():
        raw = t.encode()
        for p in range(len(raw) - 49):
            w = raw[p:p + 50]
            least[w] = min(least.get(w, i), i)
    out = {}
    for i, t in texts.items():
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if least[raw[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        out[i] = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_stages_against_brute_force(spark):
    src = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    extra = docs(spark, ["", "12 !! 34", None, "### 1.2.3.4"], first=900_000, langs=[None] * 4)
    table = src.unionByName(extra)
    rows = {r.doc_id: r.text for r in table.collect()}
    first = corpus_pipeline.language_id(spark, table, SF_SMALL)
    assert first.columns == table.columns
    kept = {r.doc_id: r.text for r in first.collect()}
    assert not {900_000, 900_001, 900_002, 900_003} & set(kept)
    assert len(kept) >= 0.98 * src.count() and all(rows[i] == t for i, t in kept.items())
    state = first
    for name, stage in corpus_pipeline.STAGES[1:4]:
        state = stage(spark, state, SF_SMALL)
        got = {r.doc_id: r.text for r in state.collect()}
        if name == "near_duplicates":
            classes = brute_classes(kept)
            kept = {i: t for i, t in kept.items() if classes[i] == i}
        elif name == "repeated_passages":
            kept = strip(kept)
        else:
            kept = {i: brute_pii(t)[0] for i, t in kept.items()}
        assert got == kept, name
        assert state.columns == table.columns
    packed = corpus_pipeline.sequences(spark, state, SF_SMALL).collect()
    check_packing(packed, kept, Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), 4096)


def test_no_known_language_keeps_texts_with_letters(spark):
    d = docs(spark, ["plain words", "12 !! 34", "", None, "Straße und Haus", "слово"], langs=[None] * 6)
    ids = sorted(r.doc_id for r in d.collect())
    kept = sorted(r.doc_id for r in corpus_pipeline.language_id(spark, d, SF_SMALL).collect())
    assert kept == [ids[0], ids[4], ids[5]]


def test_rows_repeated_with_their_id_are_kept_once(spark):
    d = docs(spark, ["one text of some words " * 9, "another text, quite other words here " * 9, None])
    lone = docs(spark, ["a text without an id " * 7]).withColumn("doc_id", F.lit(None).cast("long")).select(*d.columns)
    twice = d.unionByName(lone).unionByName(d).unionByName(lone).unionByName(d)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, twice, SF_SMALL).select(*d.columns).collect()]
    want = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, d.unionByName(lone), SF_SMALL).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, want)) and len(kept) == 4
    assert corpus_pipeline.near_duplicates(spark, twice, SF_SMALL).columns == d.columns


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_null_ids_everywhere(spark):
    texts = ["the same text " * 20, "the same text " * 20, None, "other words here " * 9]
    d = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 1, F.col("doc_id") + (1 << 60)))
    d = d.withColumn("grp", F.lit("clash")).withColumn("lang_score", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(1 + (1 << 60), 1, 0), (None, 0, 0), (3 + (1 << 60), 0, 1)], "doc_id long, quality int, toxic int")
    ids = sorted(str(r.doc_id) for r in d.collect())
    same = lambda df: sorted(str(r.doc_id) for r in df.collect()) == ids
    assert same(quality.fit_and_score(d, labels)) and same(langid.fit_and_identify(d))
    assert same(token_counts.count_tokens(d, tokenizer_file("byte_bpe_50k.json")))
    assert same(packing.pack(d, tokenizer_file("word_bpe_49k.json"))) and same(suffix_dedup.remove_repeats(d))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, SF_SMALL)
        assert out.count() <= 4 and stage(spark, d.limit(0), SF_SMALL).count() == 0
