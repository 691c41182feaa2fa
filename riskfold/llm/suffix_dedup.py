"""Removal of repeated byte passages by value and by suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller doc_id.  Matches never cross documents.

Dealing.  Every window of LENGTH bytes picks its least hashed gram of GRAM
bytes.  Equal windows pick equal grams, and neighbours mostly share one, so
the text falls into *contexts*: a gram's hash with the stretch of bytes whose
windows picked it.

1. Grams that occur in two documents or more are found: each batch of texts
   sends the distinct grams of each group of documents, dealt by hash.
2. Each group of documents cuts out the contexts of those grams.  A context
   that occurs several times in the group is settled for all but its least
   document, so a passage shared by a third of all documents is sent once
   per group of documents, not once per document.
3. Contexts are dealt by gram to shards.  A shard sorts all their suffixes by
   external induced sorting (``induced_sort``) and reads matches off the
   common prefixes: in a run of suffixes that share LENGTH bytes all but
   those of the least document are repeats.  Shards follow the bytes of the
   input; a shard's text, queues, rows and least documents are on the
   executor's disk while it runs.  Contexts of a gram with more than ``HOT``
   of them are split by the gram's place in the window, in steps of ``STEP``,
   and dealt by all bytes that the windows of a step share; what still meets
   in one shard differs in fewer than STEP bytes, and equal ones are one.
   Of these, only such are sorted as share their gram with another.
4. Each row's repeated windows are joined to spans and cut.

A row is known by its group of documents and its place there in the order of
(doc_id, text), so rows that repeat an id have windows of their own.

Step 1 leaves out only windows that certainly occur in one document.  Equal
contexts are collapsed by value, in step 2 within a group and in step 3
within a shard; the sorted suffixes decide contexts that overlap in part.

Defined cases: null text is empty; texts shorter than LENGTH are kept whole;
of rows with the same doc_id none counts as the smaller document, whether
their texts are the same or not; rows
without a doc_id are kept whole and match nothing; an empty table gives no
rows; other columns are ignored, and pass through ``strip_repeats``.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import documents, releasing, ship_package, text_batches
from riskfold.llm.induced_sort import InducedSorter, Queue
from riskfold.llm.minhash import mix

LENGTH = 50
GRAM = 20
#: Text of one group of documents.
GROUP_BYTES = 16 << 20
#: Windows that are hashed at once; a worker's arrays have about this length.
BLOCK = 1 << 18
#: Grams are dealt, and contexts sorted, in this many shards per shuffle partition at least,
SHARDS = 2
#: and in one for so much text.
SHARD_BYTES = 16 << 20
#: Contexts of a shard that are in memory at once.
ROWS = 1 << 17
#: Counters of a shard's grams: those that share one only send some more contexts to the sort.
COUNTERS = 1 << 22
#: A gram with more contexts is split by its place in the window, in these steps.
HOT = 1 << 14
STEP = 4

_BASE = 0x9E3779B97F4A7C15
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


# -- windows ---------------------------------------------------------------

def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from every place (the last ones are short)."""
    power, h, k = _BASE, _TABLE[data], 1
    doubled = [(1, h, power)]
    while 2 * k <= size:
        h = h.copy()
        h[:-k] = h[:-k] * np.uint64(power) + doubled[-1][1][k:] if k < len(h) else h[:-k]
        power, k = power * power % (1 << 64), 2 * k
        doubled.append((k, h, power))
    out, done = None, 0
    for k, h, power in reversed(doubled):
        if done + k > size:
            continue
        if out is None:
            out = h.copy()
        else:
            out[:len(out) - done] = out[:len(out) - done] * np.uint64(power) + h[done:] if done < len(out) else 0
        done += k
    return mix(out)


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` hashes from every place."""
    out, k = h.copy(), 1
    while 2 * k <= width:
        out[:-k] = np.minimum(out[:-k], out[k:].copy()) if k < len(out) else out[:-k]
        k *= 2
    rest = width - k
    if rest and rest < len(out):
        out[:-rest] = np.minimum(out[:-rest], out[rest:].copy())
    return out


def contexts_of(raws: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, gram hash, first window, last window + 1) of every
    context, windows counted from the start of all texts joined."""
    sizes = np.array([len(r) for r in raws], np.int64)
    data = np.frombuffer(b"".join(raws), np.uint8)
    ends = np.cumsum(sizes)
    long = sizes >= length
    begins, lasts = (ends - sizes)[long], (ends - length + 1)[long]    # of each text's windows
    found, hashes, before = [], [], None
    for lo in range(0, len(data), BLOCK):
        hi = min(len(data), lo + BLOCK)
        least = least_of(gram_hashes(data[lo:hi + length - 1], gram), length - gram + 1)[:hi - lo]
        new = np.concatenate([[least[0] != before], least[1:] != least[:-1]])
        new[begins[np.searchsorted(begins, lo):np.searchsorted(begins, hi)] - lo] = True
        at = np.flatnonzero(new)
        inside = np.searchsorted(begins, at + lo, "right") - 1            # windows of no text are left out
        at = at[(inside >= 0) & (at + lo < np.append(lasts, 0)[inside])]
        found.append(at + lo)
        hashes.append(least[at])
        before = least[-1]
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    first = np.concatenate(found)
    stop = np.append(first[1:], len(data))
    text = np.searchsorted(ends, first, "right")
    return text, np.concatenate(hashes), first, np.minimum(stop, (ends - length + 1)[text])


# -- step 1: grams of two documents or more ----------------------------------

_GRAMS = "bucket int, hashes binary, groups binary, notes binary"
#: A gram's note: its contexts in one batch and group (up to 127), and a bit for two documents or more.
_SEVERAL = 1 << 7


def _named(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A gram's bucket and its four bytes in there.  With more buckets for
    more text the two together stay as good as unique; two grams of one name
    only send some more windows to the sort."""
    return (h % np.uint64(buckets)).astype(np.int32), (h >> np.uint64(32)).astype(np.uint32)


def _key(bucket: np.ndarray, name: np.ndarray) -> np.ndarray:
    return (bucket.astype(np.uint64) << np.uint64(32)) | name.astype(np.uint64)


def _gram_rows(groups: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("doc_id")))
            for part in text_batches(batch, 4 << 20):
                raws = [t.encode("utf-8", "replace") for t in part.column("text").to_pylist()]
                text, h, _, _ = contexts_of(raws)
                if not len(h):
                    continue
                ids = np.array(part.column("doc_id").to_pylist(), np.int64)[text]
                group = np.array(part.column("grp").to_pylist(), np.int32)[text]
                order = np.lexsort((ids, h))
                h, ids, group = h[order], ids[order], group[order]
                new = np.concatenate([[True], h[1:] != h[:-1]])
                number = np.cumsum(new) - 1
                starts = np.flatnonzero(new)
                stops = np.concatenate([starts[1:], [len(h)]]) - 1
                several = (ids[starts] != ids[stops])[number]
                order = np.lexsort((group, number))
                h, group, several = h[order], group[order], several[order]
                keep = np.concatenate([[True], (h[1:] != h[:-1]) | (group[1:] != group[:-1])])
                times = np.diff(np.append(np.flatnonzero(keep), len(keep)))
                notes = np.minimum(times, _SEVERAL - 1).astype(np.uint8) | np.where(several[keep], _SEVERAL, 0).astype(np.uint8)
                bucket, name = _named(h[keep], buckets)
                order = np.argsort(bucket, kind="stable")
                h, group, notes, bucket = name[order], group[keep][order], notes[order], bucket[order]
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[cuts[:-1]], pa.int32()),
                    pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([group[a:b].astype(_narrow(groups)).tobytes() for a, b in spans], pa.binary()),
                    pa.array([notes[a:b].tobytes() for a, b in spans], pa.binary())], ["bucket", "hashes", "groups", "notes"])
    return run


def _narrow(groups: int):
    return np.uint16 if groups <= 1 << 16 else np.int32


def _repeated(groups: int, hot: int):
    def run(table: pa.Table) -> pa.Table:
        return _repeated_grams(table, groups, hot)
    return run


def _repeated_grams(table: pa.Table, groups: int, hot: int) -> pa.Table:
    """Of one bucket: the repeated grams of each group of documents, and
    those of them with more than ``hot`` contexts in all groups."""
    hashes = [np.frombuffer(b, np.uint32) for b in table.column("hashes").to_pylist()]
    h = np.concatenate(hashes)
    group = np.concatenate([np.frombuffer(b, _narrow(groups)) for b in table.column("groups").to_pylist()])
    notes = np.concatenate([np.frombuffer(b, np.uint8) for b in table.column("notes").to_pylist()])
    batch = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
    order = np.argsort(h, kind="stable")          # batches stay in order within a gram
    h, group, notes, batch = h[order], group[order], notes[order], batch[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    stops = np.concatenate([new[1:], [len(h)]])
    twice = np.logical_or.reduceat(notes >= _SEVERAL, new) | (batch[new] != batch[stops - 1])
    many = np.add.reduceat((notes % _SEVERAL).astype(np.int64), new) > hot
    some = np.repeat(twice, stops - new)
    h, group, many = h[some], group[some], np.repeat(many, stops - new)[some]
    order = np.lexsort((h, group))
    h, group, many = h[order], group[order], many[order]
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(h) else np.zeros(1, int)
    h = _key(np.full(len(h), table.column("bucket")[0].as_py()), h)
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pa.table({"grp": pa.array(group[cuts[:-1]], pa.int32()),
                     "grams": pa.array([np.unique(h[a:b]).tobytes() for a, b in spans], pa.binary()),
                     "hot": pa.array([np.unique(h[a:b][many[a:b]]).tobytes() for a, b in spans], pa.binary())})


# -- step 2: contexts ----------------------------------------------------------

_PARTS = pa.schema([("part", pa.int32()), ("grp", pa.int32()), ("row", pa.int32()), ("first", pa.int64()), ("stop", pa.int64()),
                    ("contexts", pa.binary())])
_WINDOWS = pa.schema([("grp", pa.int32()), ("row", pa.int32()), ("first", pa.int64()), ("stop", pa.int64())])


def _places(ids: pa.ChunkedArray, texts: pa.ChunkedArray) -> np.ndarray:
    """Each row's place in its group, by (doc_id, text), rows without an id
    last: the same whenever the group is read."""
    order = pc.sort_indices(pa.table({"id": ids, "text": texts}), sort_keys=[("id", "ascending"), ("text", "ascending")]).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def _pack(docs: np.ndarray, rows: np.ndarray, first: np.ndarray, windows: np.ndarray, pieces: list[bytes]) -> bytes:
    """Many contexts of one group as one compressed value."""
    raw = b"".join([np.int64(len(docs)).tobytes(), *(v.astype(np.int64).tobytes() for v in (docs, rows, first, windows)), *pieces])
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    raw = pa.decompress(packed[8:], decompressed_size=int(np.frombuffer(packed[:8], np.int64)[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    docs, rows, first, windows = np.frombuffer(raw[8:8 + 32 * n], np.int64).reshape(4, n)
    ends = 8 + 32 * n + np.cumsum(windows + LENGTH - 1)
    begins = ends - (windows + LENGTH - 1)
    return docs, rows, first, windows, [raw[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]


def split_hot(pieces: list[bytes], h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of hot grams, ``h`` their hashes, as shorter ones: (number of
    the context, first window in it, windows, hash to deal by).

    The gram's first place in a window is known from the window alone.  Those
    with places from ``step * STEP`` on, below the next step, share the bytes
    from that far before the gram on, LENGTH - STEP + 1 of them, and are dealt
    by these.  Equal windows thus get equal hashes."""
    found: list[tuple[np.ndarray, ...]] = []
    waiting: list[tuple[int, int, bytes]] = []
    held = 0

    def close() -> None:
        owner = np.repeat(np.arange(len(waiting)), [len(p) for _, _, p in waiting])
        data = np.frombuffer(b"".join(p for _, _, p in waiting), np.uint8)
        ends = np.cumsum([len(p) for _, _, p in waiting])
        left = ends[owner] - np.arange(len(data))
        grams = np.array([h[i] for i, _, _ in waiting], np.uint64)[owner]
        place = np.where((gram_hashes(data, GRAM) == grams) & (left >= GRAM), np.arange(len(data)), len(data))
        place = np.minimum.accumulate(place[::-1])[::-1]
        at = np.flatnonzero(left >= LENGTH)                   # the windows
        step = (place[at] - at) // STEP
        shared = gram_hashes(data, LENGTH - STEP + 1)[place[at] - step * STEP]
        deal = mix(shared + step.astype(np.uint64) * np.uint64(_BASE))
        new = np.ones(len(at), bool)
        new[1:] = (deal[1:] != deal[:-1]) | (owner[at[1:]] != owner[at[:-1]])
        heads = np.flatnonzero(new)
        mine = owner[at[heads]]
        number, skipped = (np.array([w[i] for w in waiting], np.int64) for i in (0, 1))
        begins = ends - np.array([len(p) for _, _, p in waiting])
        found.append((number[mine], skipped[mine] + at[heads] - begins[mine], np.diff(np.append(heads, len(at))), deal[heads]))

    for i, piece in enumerate(pieces):
        for lo in range(0, len(piece) - LENGTH + 1, BLOCK):    # a window run of any length, in blocks
            part = piece[lo:lo + BLOCK + LENGTH - 1]
            if held + len(part) > 2 * BLOCK and waiting:
                close()
                waiting, held = [], 0
            waiting.append((i, lo, part))
            held += len(part)
    if waiting:
        close()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _cut_contexts(buckets: int, parts: int):
    def run(docs: pa.Table, grams: pa.Table) -> pa.Table:
        return _contexts_of_group(docs.filter(pc.is_valid(docs.column("doc_id"))), grams, buckets, parts)
    return run


def _open_and_settled(doc: np.ndarray, row: np.ndarray, first: np.ndarray, stop: np.ndarray, pieces: list[bytes]) -> tuple:
    """Of contexts in the order of documents: which are open, and (row, first,
    stop) of those that a smaller document has too; neighbours are one."""
    least: dict[bytes, int] = {}
    known = np.array([least.setdefault(p, d) for p, d in zip(pieces, doc.tolist(), strict=True)], np.int64)
    done = np.flatnonzero(known != doc)
    joins = np.zeros(len(done), bool)
    joins[1:] = (row[done[1:]] == row[done[:-1]]) & (first[done[1:]] == stop[done[:-1]])
    heads = np.flatnonzero(~joins)
    tails = np.append(heads[1:], len(done))[:len(heads)] - 1
    return np.flatnonzero(known == doc), (row[done[heads]], first[done[heads]], stop[done[tails]])


def _grams_of(grams: pa.Table, column: str) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in grams.column(column).to_pylist()]))


def _among(some: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which ``keys`` are in the sorted ``some``."""
    if not len(some):
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def _contexts_of_group(docs: pa.Table, grams: pa.Table, buckets: int, parts: int) -> pa.Table:
    """Contexts of one group of documents: a row of packed contexts for each
    part, and rows of settled ones, whose windows [first, stop) are all
    repeats (neighbours are one row)."""
    if not docs.num_rows or not grams.num_rows:
        return _PARTS.empty_table()
    grp = grams.column("grp")[0].as_py()
    wanted, hot = _grams_of(grams, "grams"), _grams_of(grams, "hot")
    ids = np.array(docs.column("doc_id").to_pylist(), np.int64)
    places = _places(docs.column("doc_id"), docs.column("text"))
    raws = [t.encode("utf-8", "replace") for t in docs.column("text").to_pylist()]
    joined = b"".join(raws)
    begins = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    text, h, first, stop = contexts_of(raws)
    named = _key(*_named(h, buckets))
    keep = _among(wanted, named)
    text, h, named, first, stop = text[keep], h[keep], named[keep], first[keep], stop[keep]
    order = np.argsort(places[text], kind="stable")          # by document, then by row
    text, h, named, first, stop = text[order], h[order], named[order], first[order], stop[order]
    doc, row, base = ids[text], places[text], begins[text]
    pieces = [joined[a:b] for a, b in zip(first.tolist(), (stop + LENGTH - 1).tolist(), strict=True)]
    first, stop = first - base, stop - base
    open_, settled = _open_and_settled(doc, row, first, stop, pieces)
    split = _among(hot, named[open_])
    warm, open_ = open_[split], open_[~split]
    kept = [(doc[open_], row[open_], first[open_], stop[open_], h[open_])]
    held = [pieces[i] for i in open_.tolist()]
    if len(warm):
        number, skip, windows, deal = split_hot([pieces[i] for i in warm.tolist()], h[warm])
        whole = warm[number]
        doc, row, start = doc[whole], row[whole], first[whole] + skip
        short = [pieces[i][a:b] for i, a, b in zip(whole.tolist(), skip.tolist(), (skip + windows + LENGTH - 1).tolist(), strict=True)]
        open_, more = _open_and_settled(doc, row, start, start + windows, short)
        settled = tuple(np.concatenate(c) for c in zip(settled, more, strict=True))
        kept.append((doc[open_], row[open_], start[open_], (start + windows)[open_], deal[open_]))
        held += [short[i] for i in open_.tolist()]
    doc, row, first, stop, h = (np.concatenate(c) for c in zip(*kept, strict=True))
    part = (h % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0, [True]])) if len(part) else np.zeros(1, int)
    packed = [_pack(doc[w], row[w], first[w], stop[w] - first[w], [held[i] for i in w.tolist()])
              for w in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]
    none, whose = [None] * len(packed), settled[0]
    columns = [pa.array([*part[order][cuts[:-1]].tolist(), *((grp + whose) % parts).tolist()], pa.int32()),
               pa.array([grp] * (len(packed) + len(whose)), pa.int32()),
               *(pa.array([*none, *c.tolist()], f.type) for c, f in zip(settled, list(_PARTS)[2:5], strict=True)),
               pa.array([*packed, *[None] * len(whose)], pa.binary())]
    return pa.table(columns, schema=_PARTS)


# -- step 3: shards --------------------------------------------------------------

#: A context that came: digest, document, its group and row, first window, windows, place of its bytes.
_CAME = np.dtype([("a", np.uint64), ("b", np.uint64), ("doc", np.int64), ("grp", np.int32), ("row", np.int32), ("first", np.int64),
                  ("windows", np.int64), ("at", np.int64)])
#: The same once equal ones have one number.
_ROW = np.dtype([("doc", np.int64), ("grp", np.int32), ("row", np.int32), ("first", np.int64), ("windows", np.int64), ("k", np.int64)])
#: A distinct context: its least document, windows, place of its bytes, counter of its gram.
_HEAD = np.dtype([("doc", np.int64), ("windows", np.int64), ("at", np.int64), ("slot", np.int32)])


class _Shard:
    """Contexts of one shard: equal ones are sorted once.  What came, its
    bytes and what is known of each distinct context are files beside the
    sorter's text; ``ROWS`` rows of them are in memory at a time."""

    def __init__(self, sorter: InducedSorter):
        self.sorter = sorter
        self.came, self.raw = self._file("came"), self._file("raw")
        self.n, self.bytes = 0, 0

    def _path(self, name: str) -> str:
        return os.path.join(self.sorter.disk.folder, f"shard-{name}")

    def _file(self, name: str):
        return open(self._path(name), "wb")  # noqa: SIM115  the folder goes with the sorter

    def _blocks(self, name: str, dtype: np.dtype) -> Iterator[np.ndarray]:
        with open(self._path(name), "rb") as file:
            while len(block := np.fromfile(file, dtype, ROWS)):
                yield block

    def _map(self, name: str, dtype, n: int) -> np.ndarray:
        return np.memmap(self._path(name), dtype, "r", shape=(n,)).view(np.ndarray)

    def add(self, grp: int, packed: bytes) -> None:
        docs, places, first, windows, pieces = _unpack(packed)
        rows = np.empty(len(docs), _CAME)
        rows["grp"], rows["row"] = grp, places
        digests = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in pieces), np.uint64).reshape(-1, 2)
        sizes = windows + LENGTH - 1
        rows["a"], rows["b"], rows["doc"], rows["first"], rows["windows"] = digests[:, 0], digests[:, 1], docs, first, windows
        rows["at"] = self.bytes + np.cumsum(sizes) - sizes
        self.came.write(rows.tobytes())
        self.raw.writelines(pieces)
        self.n += len(rows)
        self.bytes += int(sizes.sum())

    def _bins(self) -> Iterator[np.ndarray]:
        """What came, equal contexts together, about ``ROWS`` rows at a time."""
        bits = min(9, max(0, self.n // ROWS).bit_length())
        if not bits:
            yield from self._blocks("came", _CAME)
            return
        files = [self._file(f"bin{i}") for i in range(1 << bits)]
        for block in self._blocks("came", _CAME):
            place = block["a"] >> np.uint64(64 - bits)
            block = block[np.argsort(place, kind="stable")]
            ends = np.cumsum(np.bincount(place.astype(np.int64), minlength=len(files)))
            for file, lo, hi in zip(files, [0, *ends[:-1]], ends, strict=True):
                file.write(block[lo:hi].tobytes())
        os.remove(self._path("came"))
        for i, file in enumerate(files):
            file.close()
            yield np.fromfile(self._path(f"bin{i}"), _CAME)
            os.remove(self._path(f"bin{i}"))

    def _distinct(self) -> tuple[int, int]:
        """Numbers the distinct contexts, and gives those that may share a
        window with another to the sorter, with their least document and
        where they begin in the sorted text; how many of both."""
        self.came.close()
        self.raw.close()
        raw = self._map("raw", np.uint8, self.bytes)
        k = 0
        times = np.zeros(COUNTERS, np.uint8)             # distinct contexts by their gram: none, one or more
        with self._file("rows") as rows, self._file("heads") as distinct:
            for came in self._bins():
                came = came[np.lexsort((came["doc"], came["b"], came["a"]))]
                new = np.ones(len(came), bool)
                new[1:] = (came["a"][1:] != came["a"][:-1]) | (came["b"][1:] != came["b"][:-1])
                heads = came[new]
                out = np.empty(len(came), _ROW)
                for name in ("doc", "grp", "row", "first", "windows"):
                    out[name] = came[name]
                out["k"] = k + np.cumsum(new) - 1
                rows.write(out.tobytes())
                for lo in range(0, len(heads), ROWS >> 4):
                    some = np.empty(len(heads[lo:lo + (ROWS >> 4)]), _HEAD)
                    for name in ("doc", "windows", "at"):
                        some[name] = heads[name][lo:lo + (ROWS >> 4)]
                    some["slot"] = _first_gram(raw, some["at"]) % np.uint64(COUNTERS)
                    slots, n = np.unique(some["slot"], return_counts=True)
                    times[slots] = np.minimum(times[slots] + n, 2)
                    distinct.write(some.tobytes())
                k += len(heads)
        begin, sorted_ = 0, 0
        with self._file("places") as places, self._file("least") as least, self._file("begins") as begins:
            for heads in self._blocks("heads", _HEAD):
                for lo in range(0, len(heads), ROWS >> 4):
                    some = heads[lo:lo + (ROWS >> 4)]
                    shared = times[some["slot"]] > 1
                    place, some = np.full(len(some), -1), some[shared]
                    sizes = some["windows"] + LENGTH
                    place[shared] = begin + np.cumsum(sizes) - sizes
                    places.write(place.tobytes())
                    if not len(some):
                        continue
                    least.write(some["doc"].tobytes())
                    begins.write(place[shared].tobytes())
                    self.sorter.add([raw[i:i + n].tobytes() for i, n in zip(some["at"].tolist(), (sizes - 1).tolist(), strict=True)])
                    begin += int(sizes.sum())
                    sorted_ += len(some)
        del raw
        os.remove(self._path("raw"))
        return k, sorted_

    def repeats(self) -> Iterator[np.ndarray]:
        """Rows grp, row, first, stop of repeated windows."""
        k, n = self._distinct()
        # per place of the sorted text: does a smaller document have the window?
        smaller = self.sorter.disk.array("smaller", np.bool_, self.sorter.n)
        if n:
            _mark(self.sorter, self._map("least", np.int64, n), self._map("begins", np.int64, n), smaller)
        heads, places = self._map("heads", _HEAD, k), self._map("places", np.int64, k)
        for block in self._blocks("rows", _ROW):
            first = heads["doc"][block["k"]]
            whole = block[block["doc"] > first]
            if len(whole):
                yield np.stack([whole["grp"], whole["row"], whole["first"], whole["first"] + whole["windows"]], 1)
            some = block[block["doc"] == first]
            some = some[places[some["k"]] >= 0]
            ends = np.cumsum(some["windows"])
            lo = 0
            while lo < len(some):                        # up to BLOCK windows at once, one row at least
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, "right")))
                yield _runs(some[lo:hi], places[some["k"][lo:hi]], smaller)
                lo = hi


def _first_gram(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gram that the window at each place picks, its context's own."""
    data = raw[at[:, None] + np.arange(LENGTH)]
    return gram_hashes(data.ravel(), GRAM).reshape(-1, LENGTH)[:, :LENGTH - GRAM + 1].min(1)


def _runs(rows: np.ndarray, places: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Rows grp, row, first, stop of the runs of windows that are marked in
    ``smaller``, where each row's windows lie from its place on."""
    ends = np.cumsum(rows["windows"])
    begins = ends - rows["windows"]
    marked = smaller[np.arange(ends[-1]) + np.repeat(places - begins, rows["windows"])]
    new, last = marked.copy(), marked.copy()
    new[1:] &= ~marked[:-1]
    new[begins] = marked[begins]
    last[:-1] &= ~marked[1:]
    last[ends - 1] = marked[ends - 1]
    heads = np.flatnonzero(new)
    mine = np.searchsorted(ends, heads, "right")
    shift = (rows["first"] - begins)[mine]
    return np.stack([rows["grp"][mine], rows["row"][mine], heads + shift, np.flatnonzero(last) + 1 + shift], 1)


def _mark(sorter: InducedSorter, least: np.ndarray, begins: np.ndarray, smaller: np.ndarray) -> None:
    """Marks the places whose first LENGTH bytes a smaller document has too.
    The run that is still open waits in a queue that spills."""
    def of(at: np.ndarray) -> np.ndarray:
        return least[np.searchsorted(begins, at, "right") - 1]

    waiting, n, low = Queue(sorter.disk), 0, 0

    def close() -> None:
        for chunk in waiting.take():
            if n > 1:
                smaller[chunk["at"][of(chunk["at"]) > low]] = True

    for wave in sorter.sort():
        if not len(wave):
            continue
        at, same = wave["at"], wave["lcp"] >= LENGTH
        some = np.flatnonzero(same | np.append(same[1:], True))
        docs = np.zeros(len(at), np.int64)
        docs[some] = of(at[some])
        starts = np.flatnonzero(~same)
        head = int(starts[0]) if len(starts) else len(at)
        if head:
            waiting.push(wave[:head].copy())
            low = min(low, int(docs[:head].min())) if n else int(docs[:head].min())
            n += head
        if not len(starts):
            continue
        close()
        tail = int(starts[-1])
        if tail > head:
            inner = docs[head:tail]
            lows = np.repeat(np.minimum.reduceat(inner, starts[:-1] - head), np.diff(starts))
            smaller[at[head:tail][inner > lows]] = True
        waiting.push(wave[tail:].copy())
        n, low = len(at) - tail, int(docs[tail:].min())
    close()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of dealt contexts -> repeated windows."""
    with InducedSorter(LENGTH) as sorter:
        shard = _Shard(sorter)
        for batch in batches:
            done = batch.filter(pc.is_null(batch.column("contexts")))
            if done.num_rows:
                yield done.select(_WINDOWS.names)
            for grp, packed in zip(batch.column("grp"), batch.column("contexts"), strict=True):
                if packed.is_valid:
                    shard.add(grp.as_py(), packed.as_py())
        if shard.n:
            for found in shard.repeats():
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(found.T, _WINDOWS, strict=True)],
                                                 schema=_WINDOWS)


# -- step 4: what is kept --------------------------------------------------------

_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                   ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _spans(windows: pa.Table) -> dict[int, list[tuple[int, int]]]:
    """Byte ranges that repeated windows cover, by row of the group."""
    spans: dict[int, list[tuple[int, int]]] = {}
    for row, first, stop in zip(*(windows.column(c).to_pylist() for c in ("row", "first", "stop")), strict=True):
        spans.setdefault(row, []).append((first, stop + LENGTH - 1))
    return spans


def cut(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """``raw`` without ``ranges``, and how many runs went."""
    kept, at, runs, last = [], 0, 0, -1
    for a, b in sorted(ranges):
        b = min(b, len(raw))
        if a >= b:
            continue
        if a > last:
            runs += 1
            kept.append(raw[at:a])
        last = max(last, b)
        at = max(at, b)
    kept.append(raw[at:])
    return b"".join(kept), runs


def _cut_out(with_text: bool):
    def run(docs: pa.Table, windows: pa.Table) -> pa.Table:
        spans = _spans(windows)
        out: tuple[list, ...] = ([], [], [], [], [], [])
        places = _places(docs.column("doc_id"), docs.column("text")).tolist()
        for place, doc, text in zip(places, docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
            raw = text.encode("utf-8", "replace")
            left, runs = cut(raw, spans.get(place, []))
            row = (doc, len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest(), left if with_text else None)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, _KEPT, strict=True)], schema=_KEPT)
    return run


def _strip(group: str, key: str):
    def run(docs: pa.Table, windows: pa.Table) -> pa.Table:
        spans = _spans(windows)
        texts = []
        places = _places(docs.column(key), pc.fill_null(docs.column("text"), "")).tolist()
        for place, text in zip(places, docs.column("text").to_pylist(), strict=True):
            ranges = spans.get(place)
            # a character that lost some of its bytes goes whole
            texts.append(cut(text.encode("utf-8", "replace"), ranges)[0].decode("utf-8", "ignore") if ranges and text else text)
        place = docs.schema.get_field_index("text")
        return docs.set_column(place, docs.schema.field(place), pa.array(texts, docs.schema.field(place).type)).drop_columns([group, key])
    return run


# -- Spark -------------------------------------------------------------------------

def _group_key(groups: int):
    """Group of a row; rows of one id, or without one, are spread by their text."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(groups)).cast("int")


def _groups(docs: DataFrame) -> tuple[int, int]:
    """Groups of documents and shards of grams, by the bytes of text."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(partitions, -(-int(total) // GROUP_BYTES)), max(SHARDS * partitions, -(-int(total) // SHARD_BYTES))


def repeated_windows(docs: DataFrame, groups: int, buckets: int, hot: int = HOT) -> DataFrame:
    """grp, row, first, stop: windows [first, stop) of each row that also
    start in a smaller document."""
    spark = docs.sparkSession
    ship_package(spark)
    dealt = documents(docs).withColumn("grp", _group_key(groups))
    grams = (dealt.mapInArrow(releasing(_gram_rows(groups, buckets)), _GRAMS)
             .groupBy("bucket").applyInArrow(_repeated(groups, hot), "grp int, grams binary, hot binary"))
    parts = dealt.groupBy("grp").cogroup(grams.groupBy("grp")).applyInArrow(
        _cut_contexts(buckets, buckets), "part int, grp int, row int, first long, stop long, contexts binary")
    # a part is a shard, so a group sends one value to each; settled contexts only pass through, dealt by row
    return parts.repartitionById(buckets, "part").mapInArrow(releasing(_settle), "grp int, row int, first long, stop long")


def remove_repeats(docs: DataFrame, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with
    ``with_text``, the bytes that are kept."""
    plain = documents(docs)
    groups, buckets = _groups(plain)
    windows = repeated_windows(plain, groups, buckets, hot)
    out = plain.withColumn("grp", _group_key(groups)).groupBy("grp").cogroup(windows.groupBy("grp")).applyInArrow(
        _cut_out(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``, all columns kept."""
    fresh = lambda name: name if name.lower() not in {c.lower() for c in docs.columns} else fresh("_" + name)
    group, key = fresh("grp"), fresh("key")
    groups, buckets = _groups(docs)
    windows = repeated_windows(docs, groups, buckets)
    keyed = docs.withColumn(group, _group_key(groups)).withColumn(key, F.col("doc_id").cast("long"))
    return keyed.groupBy(group).cogroup(windows.groupBy("grp")).applyInArrow(_strip(group, key), docs.schema)
