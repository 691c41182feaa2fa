"""Token counts by a two-tier map-side lookup.

Texts fall into *pre-token groups*: a run of non-space characters with the
one space before it, or a run of white space.  A byte-level BPE tokenizer
never merges across such a group, so a text's token count is the sum of its
groups' counts.  Tier one is a compact table of the corpus's most frequent
groups with their counts, broadcast to every worker; tier two is each
worker's own cache, filled by encoding what tier one misses.  No pre-token
is ever shuffled: the frequent groups come from bounded per-partition
summaries that are merged in a tree.

Defined cases: null or empty text counts 0 tokens; repeated rows are counted
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from riskfold.llm.common import documents, ship_package, text_batches

#: Entries of the broadcast table.  Its size is proven: at most this many
#: strings of at most LONGEST_GROUP characters.
FREQUENT = 50_000
#: Groups longer than this are encoded every time and never kept.
LONGEST_GROUP = 48
#: Entries of a worker's cache; a full cache starts again.
CACHE_ENTRIES = 400_000
#: Entries of one partition's summary before its rare groups are dropped.
SUMMARY_ENTRIES = 200_000

_GROUP = re.compile(r" ?\S+|\s+(?!\S)|\s")
# separators that Python counts as white space and the tokenizer does not
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def _groups(text: str) -> list[str]:
    return _GROUP.findall(text)


def _summary(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """One row per partition: its most frequent groups, at most ``keep``."""
    counts: Counter[str] = Counter()
    for batch in batches:
        for part in text_batches(batch):
            for text in part.column("text").to_pylist():
                counts.update(_groups(text))
            while len(counts) > SUMMARY_ENTRIES:  # lossy counting: the rarest go first
                floor = int(np.partition(np.fromiter(counts.values(), np.int64), len(counts) // 2)[len(counts) // 2])
                counts = Counter({k: v for k, v in counts.items() if v > floor})
    blob = _pack({k: v for k, v in counts.most_common(keep) if len(k) <= LONGEST_GROUP})
    yield pa.RecordBatch.from_pydict({"summary": pa.array([blob], pa.binary())})


def _pack(counts: dict[str, int]) -> bytes:
    return zlib.compress(pickle.dumps(counts), 1)


def _merge(a: bytes, b: bytes, keep: int) -> bytes:
    both = Counter(pickle.loads(zlib.decompress(a)))
    both.update(pickle.loads(zlib.decompress(b)))
    return _pack(dict(both.most_common(keep)))


def frequent_groups(docs: DataFrame, keep: int = FREQUENT) -> list[str]:
    """The (approximately) most frequent pre-token groups of all texts, most
    frequent first.  Approximation only costs cache misses, never counts."""
    ship_package(docs.sparkSession)
    summaries = documents(docs).select("text").mapInArrow(lambda it: _summary(it, keep), "summary binary")
    blobs = summaries.rdd.map(lambda r: bytes(r[0]))
    if blobs.getNumPartitions() == 0:
        return []
    merged = blobs.treeAggregate(_pack({}), lambda a, b: _merge(a, b, keep), lambda a, b: _merge(a, b, keep), depth=3)
    return [k for k, _ in Counter(pickle.loads(zlib.decompress(merged))).most_common(keep)]


class GroupCounts:
    """Both tiers inside one worker."""

    def __init__(self, tokenizer, frequent: dict[str, int], capacity: int = CACHE_ENTRIES):
        self.tokenizer, self.frequent, self.capacity = tokenizer, frequent, capacity
        self.specials = special_strings(tokenizer)
        self.cache = dict(frequent)

    def whole(self, text: str) -> bool:
        """Texts whose groups cannot be counted apart: a special string or an
        odd separator is inside."""
        return any(s in text for s in self.specials) or any(c in text for c in _ODD_SPACE)

    def encode_lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        flat: list[str] = []
        ends = np.empty(len(texts), np.int64)
        direct = []
        for i, text in enumerate(texts):
            if self.whole(text):
                direct.append(i)
            else:
                flat += _groups(text)
            ends[i] = len(flat)
        lengths = list(map(self.cache.get, flat))
        missed = [i for i, n in enumerate(lengths) if n is None]
        if missed:
            new = list({flat[i] for i in missed})
            found: dict[str, int] = {}
            for at in range(0, len(new), 20_000):
                part = new[at:at + 20_000]
                found.update(zip(part, self.encode_lengths(part), strict=True))
            for i in missed:
                lengths[i] = found[flat[i]]
            if len(self.cache) + len(found) > self.capacity:
                self.cache = dict(self.frequent)
            self.cache.update((k, v) for k, v in found.items() if len(k) <= LONGEST_GROUP)
        sums = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])
        starts = np.concatenate([[0], ends[:-1]]) if len(texts) else ends
        out = (sums[ends] - sums[starts]).tolist()
        for i in direct:
            out[i] = self.encode_lengths([texts[i]])[0]
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of
    every document.  ``tokenizer_path`` names a byte-level BPE file that every
    worker can open."""
    spark = docs.sparkSession
    ship_package(spark)
    tokenizer = load_tokenizer(tokenizer_path)
    groups = frequent_groups(docs, frequent)
    table = GroupCounts(tokenizer, {})
    lengths = table.encode_lengths(groups) if groups else []
    shared = spark.sparkContext.broadcast({k: n for k, n in zip(groups, lengths, strict=True) if not table.whole(k)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = GroupCounts(load_tokenizer(tokenizer_path), shared.value)
        for batch in batches:
            for part in text_batches(batch):
                texts = part.column("text").to_pylist()
                tokens = counter.count(texts)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"),
                    pc.cast(pc.binary_length(part.column("text")), pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
