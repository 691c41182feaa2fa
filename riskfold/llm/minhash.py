"""Near-duplicate classes by weighted dart signatures.

A text is the multiset of its shingles of five words.  Over every shingle
stands a region as high as its count, and hashed darts -- a Poisson process
whose points depend on the shingle and the height only -- fall into it at
hashed times.  For each of K coordinates the earliest dart below the counts
is kept, so two texts agree in a coordinate with a probability equal to their
weighted Jaccard similarity, and the work follows the number of shingles.

Equal texts are collapsed first.  Texts that agree in a whole band of
coordinates are candidates:

1. each is compared with the least text of its buckets, and links found so
   give first components;
2. buckets that still hold several components are dealt in blocks, and all
   pairs of different components are compared inside the tasks, which emit
   the links alone.

So no candidate pair with a possible new link is left out, none is emitted
just to be compared, and no bucket meets in one task: the rows of a key with
more than a fixed share of all rows are dealt in pieces.  The comparison is
exact.

Defined cases: a text of fewer than five words is one shingle; null and
empty texts, and texts without a word, are copies of each other; rows that
repeat a doc_id share its class; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import Tables, cut_lineage, documents, releasing, ship_package, text_batches
from riskfold.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 4
#: Texts of one block in the exact comparison of a bucket.
BLOCK = 128
#: A key with more than this part of all rows of the buckets is dealt in pieces.
HOT_KEYS = 4096

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words; equal in every process, kept in a cache."""

    def __init__(self, capacity: int = 400_000):
        self.known: dict[str, int] = {}
        self.capacity = capacity

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.capacity:
            self.known = {}
        got = list(map(self.known.get, words))
        if None in got:
            for word in {w for w, h in zip(words, got, strict=True) if h is None}:
                self.known[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
            got = list(map(self.known.get, words))
        return np.array(got, np.uint64)


def shingles(texts: list[str], hashes: WordHashes, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of every shingle of every text, in order of the texts."""
    flat: list[str] = []
    counts = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.split()
        counts[i] = len(words)
        flat += words
    word = hashes(flat)
    owner = np.repeat(np.arange(len(texts)), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    place = np.arange(len(word))
    left = ends - place                       # words from here to the text's end
    first = place == ends - np.repeat(counts, counts)
    starts = np.flatnonzero((left >= size) | first)
    h = np.zeros(len(starts), np.uint64)
    for k in range(size):
        inside = left[starts] > k
        at = np.minimum(starts + k, max(len(word) - 1, 0))
        h = np.where(inside, mix(h * _GOLD + word[at] + np.uint64(k)) if len(word) else h, h)
    return owner[starts], h


def counted(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) with their counts."""
    if not len(h):
        return owner, h, np.zeros(0)
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (x[1:] != x[:-1])])
    at = np.flatnonzero(new)
    return o[at], x[at], np.diff(np.concatenate([at, [len(x)]])).astype(float)


def dart_signatures(n: int, owner: np.ndarray, element: np.ndarray, weight: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """(n, k) signatures of weighted sets given as (owner, element, weight);
    a set without elements has a signature of zeros.

    The region of an element is cut at heights 1, 2, 4 ...; each layer is a
    Poisson process in time with the layer's height as its rate, made by
    adding hashed exponential gaps.  A dart counts if its hashed height lies
    below the weight.  Times up to a horizon that gives every coordinate a
    dart with high probability are looked at; sets with an empty coordinate
    are done again with twice the horizon."""
    signature = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, weight, n)
    todo = total > 0
    horizon = np.where(todo, k * (np.log(k) + 2) / np.maximum(total, 1e-300), 0.0)
    while todo.any():
        mine = todo[owner]
        o, e, w = owner[mine], element[mine], weight[mine]
        layer_o, layer_key, layer_low, layer_high, layer_w = [], [], [], [], []
        low, high, level = 0.0, 1.0, 0
        while len(o):
            layer_o.append(o)
            layer_key.append(mix(e ^ mix(np.full(len(e), level * 2 + 1 + (seed << 20), np.uint64))))
            layer_low.append(np.full(len(e), low))
            layer_high.append(np.full(len(e), high))
            layer_w.append(w)
            up = w > high
            o, e, w = o[up], e[up], w[up]
            low, high, level = high, high * 2, level + 1
        o, key = np.concatenate(layer_o), np.concatenate(layer_key)
        lo, hi, w = np.concatenate(layer_low), np.concatenate(layer_high), np.concatenate(layer_w)
        time = np.zeros(len(o))
        until = horizon[o]
        got_slot, got_time, got_dart = [], [], []
        step = 0
        while len(o):
            step += 1
            dart = mix(key + np.uint64(step * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
            unit = ((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
            time = time - np.log(unit) / (hi - lo)
            keep = time < until
            if not keep.all():
                o, key, lo, hi, w, time, until, dart = (v[keep] for v in (o, key, lo, hi, w, time, until, dart))
            more = mix(dart ^ _M2)
            height = lo + (hi - lo) * ((more >> np.uint64(11)).astype(np.float64) * 2.0 ** -53)
            below = height < w
            got_slot.append((o * k + ((more & np.uint64(0x7FF)) % np.uint64(k)).astype(np.int64))[below])
            got_time.append(time[below])
            got_dart.append(dart[below])
        slot, when, dart = np.concatenate(got_slot), np.concatenate(got_time), np.concatenate(got_dart)
        earliest = np.full(n * k, np.inf)
        np.minimum.at(earliest, slot, when)
        first = when == earliest[slot]
        flat = np.zeros(n * k, np.uint64)
        flat[slot[first]] = dart[first]
        full = todo & np.isfinite(earliest.reshape(n, k)).all(1)
        signature[full] = flat.reshape(n, k)[full]
        todo = todo & ~full
        horizon = horizon * 2
    return signature


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """(n, bands) 64-bit keys; the band's number is part of its key."""
    n, k = signature.shape
    rows = signature.reshape(n, bands, k // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (n, bands))
    for i in range(rows.shape[2]):
        key = mix(key * _M1 + rows[:, :, i])
    return key.view(np.int64)


def grams(text: str, hashes: WordHashes, size: int = WORDS) -> np.ndarray:
    """A multiset as a sorted set: the i-th copy of a shingle is an element
    of its own, so weighted and plain similarity agree."""
    owner, h = shingles([text], hashes, size)
    h = np.sort(h)
    if not len(h):
        return h
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    copy = np.arange(len(h)) - np.repeat(start, np.diff(np.concatenate([start, [len(h)]])))
    return np.sort(np.where(copy == 0, h, mix(h + copy.astype(np.uint64) * _GOLD)))


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Similarity of two sets given as sorted arrays; 0 at once where the
    sizes alone rule out ``least``."""
    small, large = sorted((len(a), len(b)))
    if large == 0 or small < least * large:
        return 0.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (small + large - common)


# -- Spark --------------------------------------------------------------------

def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = WORDS) -> DataFrame:
    """doc_id, copy_of (fingerprint of the text), keys (band keys; null for a
    text without words)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in text_batches(batch, 2 << 20):
                texts = part.column("text").to_pylist()
                owner, element, weight = counted(*shingles(texts, hashes, size))
                keys = band_keys(dart_signatures(len(texts), owner, element, weight, bands * rows), bands)
                some = np.bincount(owner, minlength=len(texts)) > 0
                copy_of = [hashlib.blake2b(t.encode("utf-8", "replace") if ok else b"", digest_size=16).digest()
                           for t, ok in zip(texts, some, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(copy_of, pa.binary()), pa.array(some), lists], ["doc_id", "copy_of", "some", "keys"])

    made = documents(docs).mapInArrow(releasing(run), "doc_id long, copy_of binary, some boolean, keys array<long>")
    return made.select("doc_id", "copy_of", F.when(F.col("some"), F.col("keys")).alias("keys"))


def _gram_table(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, grams of the ``wanted`` nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in text_batches(batch, 2 << 20):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([grams(t, hashes, size).tobytes() for t in part.column("text").to_pylist()], pa.binary())],
                    ["node", "grams"])

    mine = documents(docs).join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return mine.mapInArrow(releasing(run), "node long, grams binary").dropDuplicates(["node"])


def _leader_links(pairs: DataFrame, table: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that are at least ``similarity`` alike."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) >= similarity
                    for x, y in zip(f["ga"], f["gb"], strict=True)]
            yield f.loc[keep, ["a", "b"]]

    a = table.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    b = table.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ga", "gb").mapInPandas(run, "a long, b long")


def _hot_keys(sizes: DataFrame) -> DataFrame:
    """key, pieces of the keys that have more than their share, a HOT_KEYS-th
    of all rows: a piece for each such share.  Fewer than HOT_KEYS keys can
    have so many, so the table has a fixed bound.  ``sizes`` has key, n."""
    share = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS))
    return sizes.where(F.col("n") > share).select("key", F.ceil(F.col("n") / share).cast("int").alias("pieces"))


def _with_pieces(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with the number of pieces of their key."""
    return rows.join(F.broadcast(hot), "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))


def _by_piece(per_key: DataFrame) -> DataFrame:
    """A row per key (with its ``pieces``) as one for each of its pieces."""
    return per_key.withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)"))).drop("pieces")


def _block_links(members: DataFrame, table: DataFrame, similarity: float) -> DataFrame:
    """Links between different components (root) of one bucket (key).

    ``members`` has key, piece, pieces, node, root, keys.  A bucket is dealt in blocks by
    the rank of its nodes' hash; every pair of blocks is one task's group, and
    a pair of texts is compared in the first band that it shares only."""
    size = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.first("pieces").alias("pieces"))
    dealt = (members.join(_by_piece(size), ["key", "piece"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    # block i meets every block j; the pair is known by (smaller, larger)
    met = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "root", "keys")
    full = met.join(table, "node")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["node"]).reset_index(drop=True)
        key, same = f["key"].iloc[0], f["one"].iloc[0] == f["two"].iloc[0]
        node, root, block = f["node"].to_numpy(), f["root"].to_numpy(), f["block"].to_numpy()
        sets = [np.frombuffer(g, np.uint64) for g in f["grams"]]
        length = np.array([len(s) for s in sets])
        keys = np.stack(f["keys"].to_numpy())
        band = int(np.argmax(keys[0] == key))
        out = []
        for i in range(len(f) - 1):
            rest = slice(i + 1, None)
            try_ = (root[rest] != root[i]) & (same | (block[rest] != block[i]))
            try_ &= np.minimum(length[rest], length[i]) >= similarity * np.maximum(length[rest], length[i])
            if band:
                try_ &= ~(keys[rest, :band] == keys[i, :band]).any(1)
            for j in np.flatnonzero(try_) + i + 1:
                if jaccard(sets[i], sets[j], similarity) >= similarity:
                    out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return full.groupBy("key", "one", "two").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, size: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class: documents linked,
    over any number of steps, by texts at least ``similarity`` alike."""
    made = cut_lineage(signatures(docs, bands, rows, size), "signatures")
    texts = cut_lineage(made.groupBy("copy_of").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")), "texts")
    buckets = texts.where(F.col("keys").isNotNull()).select("node", "keys", F.explode("keys").alias("key"))
    tables = Tables(docs.sparkSession)
    shared = tables.write(buckets.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    # every join by key goes by (key, piece), so no task gets all rows of a hot key
    hot = tables.write(_hot_keys(shared), "hot-keys")
    dealt = _with_pieces(buckets, hot).withColumn("piece", F.pmod(F.xxhash64("node"), "pieces").cast("int"))
    leaders = _by_piece(_with_pieces(shared.select("key", "leader"), hot))
    members = tables.write(dealt.join(leaders, ["key", "piece"]), "buckets")
    table = tables.write(_gram_table(docs, members.select("node").distinct(), size), "grams")
    pairs = members.where("node <> leader").groupBy("node").agg(F.min("leader").alias("b")).select(F.col("node").alias("a"), "b")
    links = tables.write(_leader_links(pairs, table, similarity), "links")
    first = components(links)
    rooted = members.join(first, "node", "left").select("key", "piece", "pieces", "node", "keys", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.first("pieces").alias("pieces")).where("x <> y")
    open_ = tables.write(rooted.join(_by_piece(mixed.select("key", "pieces")), ["key", "piece"], "left_semi"), "open")
    found = tables.write(_block_links(open_, table, similarity), "links")
    final = components(links.unionByName(found))
    tables.drop()                             # only the signatures, the texts and the components are read from here on
    classes = texts.select("copy_of", "node").join(final, "node", "left").select("copy_of", F.coalesce("root", "node").alias("class_id"))
    return made.select("doc_id", "copy_of").join(classes, "copy_of").select("doc_id", "class_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that have a near duplicate of smaller
    doc_id in their class; columns as they are.  Of rows that repeat both id
    and text (null ids are equal) one stays; other rows without an id stay."""
    # a written table, so its size decides the join: texts are not shuffled for a few repeated ids
    again = cut_lineage(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again")), "repeated-ids")
    single = docs
    if not again.isEmpty():
        same = docs["doc_id"].eqNullSafe(again["again"])
        single = docs.join(again, same, "left_anti").unionByName(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    gone = near_duplicates(docs, **options).where("doc_id <> class_id").select("doc_id").distinct()
    return single.join(gone, "doc_id", "left_anti").select(*docs.columns)
