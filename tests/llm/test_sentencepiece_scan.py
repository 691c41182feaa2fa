"""Encoding against the library, by words and by chunks, and decoding."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from riskfold.llm import sentencepiece_scan as scan
from riskfold.llm.queries import op10_sentencepiece, tokenizer_file
from tests.conftest import SF_SMALL
from tests.llm.helpers import docs

PATH = tokenizer_file("piece_bpe_32k.model")
ODD = [None, "", " ", "  a", "a  b", "a \n b", "\n\n  x  ", "é é 日本語テキスト です", "<s> <0x41>", "w" * 500, "🙂🙂  🙂", "a▁b", "▁▁",
       "x\0y  \t z", "中" * 50 + "文章 が", "    def f(x):\n        return  x", "abcabcabc" * 60, "dup", "dup", " " * 77, "a " * 300]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    return scan.Pieces(PATH)


def random_texts(n=200):
    r = random.Random(1)
    return ["".join(r.choice("abe tin\n  é▁🙂0.") for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_words_equal_the_library(library, pieces):
    words = scan.WordPieces(pieces, capacity=50)
    for t in [*(t or "" for t in ODD), *random_texts(), *(" " * k for k in range(120))]:
        assert words.encode(t).tolist() == library.encode(t), t


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40])
def test_chunks_equal_the_library(library, pieces, size):
    for t in [t or "" for t in ODD] + random_texts(120):
        plain = t.replace(scan.MARK, " ")
        if not plain:
            continue
        text, edges = scan.MARK + plain.replace(" ", scan.MARK), [0, *(e + 1 for e in scan.chunk_edges(plain, size)[1:])]
        reach = 2 * pieces.longest
        chunks = [scan.Chunk(pieces, text[max(0, a - reach):a] + text[a:b] + text[b:b + reach], min(a, reach), min(a, reach) + b - a)
                  for a, b in zip(edges[:-1], edges[1:], strict=True)]
        ids = []
        for c, (a, b) in zip(chunks, scan.edge_states([c.matrix() for c in chunks]), strict=True):
            ids += pieces.ids(c.trace(c.states(c.left)[a], c.states(c.right)[b]))
        assert ids == library.encode(t), t


def test_products_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random(s) < 0.4, -np.inf, rng.integers(-5, 1, s).astype(float)) for s in ((2, 3), (3, 4), (4, 2)))
    assert np.array_equal(scan.max_plus(scan.max_plus(a, b), c), scan.max_plus(a, scan.max_plus(b, c)))


def test_checksums_of_joined_parts():
    r = random.Random(2)
    for _ in range(30):
        a, b = r.randbytes(r.randint(0, 40)), r.randbytes(r.randint(0, 3000))
        assert scan.crc_of_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("size", [1 << 16, 16])
def test_tables_equal_the_library(spark, library, size):
    texts = ODD + random_texts(40)
    d = docs(spark, texts).withColumn("ids", F.lit("clash")).withColumn("chunk", F.lit(1))
    encoded = scan.encode(d, PATH, size=size, with_ids=True)
    rows = {r.doc_id: r for r in encoded.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode(t or "")
        assert list(rows[i].ids or []) == want and rows[i].n_tokens == len(want) and rows[i].round_trip
        assert rows[i].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
    back = {r.doc_id: r.text for r in scan.decode(encoded, PATH).collect()}
    assert all(back[i] == (t or "").replace(scan.MARK, " ") for i, t in enumerate(texts))
    assert scan.encode(d.limit(0), PATH, size=size).count() == 0


def test_repeated_rows_and_null_ids(spark, library):
    d = docs(spark, ["ab cd " * 9] * 3).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.lit(5)).cast("long"))
    rows = scan.encode(d, PATH, size=16).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, len(library.encode("ab cd " * 9)))] + [(5, len(library.encode("ab cd " * 9)))] * 2


def test_all_documents_equal_the_library(spark, library):
    src = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in op10_sentencepiece(spark, SF_SMALL).collect()}
    for r in src:
        want = library.encode(r.text or "")
        assert rows[r.doc_id].n_tokens == len(want) and rows[r.doc_id].round_trip
        assert rows[r.doc_id].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
