"""Best-fit packing of documents into fixed-length token sequences.

The instance is a histogram: how many pieces have each length from 1 to the
capacity.  It has at most ``capacity`` rows whatever the corpus, so it is the
only thing the driver sees.  Two steps work on it:

* dominance reduction (Martello and Toth): going down from the longest piece,
  a small set with it -- alone, a pair or a triple -- that provably dominates
  every other way to fill its sequence is fixed for good, for as many copies
  as the counts allow, and the instance shrinks;
* best-fit decreasing over what is left, on groups of equal sequences.

Both give *runs*: "pieces number a..b of length s go, q to a sequence, into
sequences x.. from offset o".  Spark numbers the pieces of each length and
every piece looks its place up in the broadcast runs.

Defined cases: null text is empty and holds the end token alone; repeated
rows are packed each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfold.llm.common import cut_lineage, documents, pieces_for, releasing, ship_package, text_batches
from riskfold.llm.token_counts import load_tokenizer

CAPACITY = 4096
END_ID = 1
#: Rows of one numbering bucket, so that a length shared by a third of all
#: pieces is still numbered in many tasks.
BUCKET_ROWS = 200_000
CACHE_WORDS = 300_000
#: Text whose words are Python objects at once, beside the cache.
SLICE_BYTES = 1 << 20
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


# -- tokens ---------------------------------------------------------------

class _Numbers(dict):
    """Word -> number, given out on first sight; new words wait in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = n = len(self)
        return n


class WordIds:
    """Ids of texts by a tokenizer that drops white space: a text's ids are
    those of its words in turn, and words are kept in a worker's cache.  A
    full cache keeps the words that it met more than once."""

    # a lower-cased word of these letters is one pre-token, signs behind it another
    _PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!#$%&*+,./:;=?@^_|~-]*)")
    _LINES = re.compile(f"^{_PLAIN.pattern}$|^.*$", re.MULTILINE)
    _OF_TOKEN = attrgetter("id")

    def __init__(self, tokenizer, capacity: int = CACHE_WORDS):
        self.tokenizer, self.capacity = tokenizer, capacity
        spell = tokenizer.pre_tokenizer.pre_tokenize_str
        # a letter is spelled as its bytes, each by a letter of that number or by one that is set for it
        letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        spelled = [(c.encode().decode("latin-1"), "".join(x for x, _ in spell(c))) for c in letters]
        self.spelling = [(by_number, as_set) for by_number, as_set in spelled if by_number != as_set]
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.parts: dict[str, bytes] = {}
        self.starts, self.lengths, self.hits = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _shrink(self) -> None:
        old, starts, lengths, hits, ids = self.numbers, self.starts, self.lengths, self.hits, self.ids
        floor = 1 if np.count_nonzero(hits > 1) <= self.capacity // 2 else int(np.sort(hits)[-(self.capacity // 2)])
        again = (hits > floor).tolist()
        kept = [w for w, k in old.items() if again[k]]
        at = np.array([old[w] for w in kept], np.int64)
        self._clear()
        for k, word in enumerate(kept):
            dict.__setitem__(self.numbers, word, k)
        n = lengths[at]
        self._put(np.arange(len(at)), n, ids[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())])

    def _spelled(self, letters: str) -> str:
        """Plain letters and line ends as the tokenizer's model spells them."""
        letters = letters.lower().encode().decode("latin-1")
        for by_number, as_set in self.spelling:
            letters = letters.replace(by_number, as_set)
        return letters

    def _part(self, spelled: str) -> bytes:
        """Ids of one pre-token of plain letters, as they are spelled, or of signs."""
        if len(self.parts) > self.capacity // 2:
            self.parts = {}
        ids = self.parts[spelled] = array("I", map(self._OF_TOKEN, self.tokenizer.model.tokenize(spelled))).tobytes()
        return ids

    def _put(self, numbers, sizes, ids) -> None:
        """Keeps the ids of some words, which follow one another in ``ids``."""
        if not len(numbers):
            return
        sizes = np.asarray(sizes, np.int64)
        n = int(sizes.sum())
        while numbers[-1] >= len(self.starts):
            self.starts, self.lengths, self.hits = (np.concatenate([v, np.zeros_like(v)]) for v in (self.starts, self.lengths, self.hits))
        while self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + n] = ids
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.lengths[numbers] = sizes
        self.used += n

    def _fill(self) -> None:
        fresh, self.numbers.fresh = self.numbers.fresh, []
        other, numbers, found = [], [], []
        first = len(self.numbers) - len(fresh)
        split = self._LINES.findall("\n".join(fresh))
        if len(split) != len(fresh):                     # a word with a line's end in it
            split = [m.groups() if (m := self._PLAIN.fullmatch(word)) else ("", "") for word in fresh]
        spelled = self._spelled("\n".join([letters for letters, _ in split])).split("\n")
        for k, (letters, (_, signs)) in enumerate(zip(spelled, split, strict=True), first):
            if not letters:
                other.append((k, fresh[k - first]))
                continue
            ids = self.parts.get(letters) or self._part(letters)
            if signs:
                ids += self.parts.get(signs) or self._part(signs)
            numbers.append(k)
            found.append(ids)
        self._put(numbers, np.fromiter(map(len, found), np.int64, len(found)) // 4, np.frombuffer(b"".join(found), np.uint32))
        for at in range(0, len(other), 20_000):
            part = other[at:at + 20_000]
            found = [enc.ids for enc in self.tokenizer.encode_batch_fast([w for _, w in part], add_special_tokens=False)]
            self._put([k for k, _ in part], [len(x) for x in found], [i for x in found for i in x])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > self.capacity or self.used > 16 * self.capacity:
            self._shrink()
        flat: list[str] = []
        ends = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            flat += [text] if any(c in text for c in _ODD_SPACE) else text.split()
            ends[i] = len(flat)
        at = np.fromiter(map(self.numbers.__getitem__, flat), np.int64, len(flat))
        if self.numbers.fresh:
            self._fill()
        if len(at):
            seen = np.bincount(at)
            self.hits[:len(seen)] += seen
        n = self.lengths[at]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.starts[at] - total[:-1], n) + np.arange(total[-1])]
        cuts = total[np.concatenate([[0], ends])]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


#: One cache per tokenizer file in a Python worker, kept from task to task.
_CACHES: dict[str, WordIds] = {}


def worker_cache(path: str) -> WordIds:
    if path not in _CACHES:
        _CACHES[path] = WordIds(load_tokenizer(path))
    return _CACHES[path]


def _piece_batches(batches: Iterator[pa.RecordBatch], words: WordIds, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_batches(batch, SLICE_BYTES):
            out: list[tuple] = []
            rows = part.column("text").to_pylist()
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), words.encode(rows), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    cut = ids[at:at + capacity]
                    out.append((doc_id, k, at, len(cut), zlib.crc32(cut.tobytes())))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids with the
    end id, cut into pieces of at most ``capacity``."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _piece_batches(batches, worker_cache(tokenizer_path), capacity, end_id)

    return documents(docs).mapInArrow(releasing(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


# -- the plan over the histogram -------------------------------------------

@dataclass
class Plan:
    """Runs: pieces ``first .. first + count`` of ``size`` go ``per_bin`` to a
    sequence, into sequences from ``bin``, starting at ``offset``."""

    capacity: int
    counts: dict[int, int]
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    bins: int = 0

    def __post_init__(self):
        self.left = dict(self.counts)
        self.sizes = sorted(s for s, n in self.left.items() if n > 0)

    def take(self, size: int, count: int, first_bin: int, per_bin: int, offset: int) -> None:
        self.runs.append((size, self.counts[size] - self.left[size], count, first_bin, per_bin, offset))
        self.left[size] -= count
        if self.left[size] == 0:
            del self.sizes[bisect.bisect_left(self.sizes, size)]

    def largest(self, room: int) -> int:
        """The longest size left that is at most ``room``; 0 if none."""
        i = bisect.bisect_right(self.sizes, room)
        return self.sizes[i - 1] if i else 0

    def fix(self, members: list[int], copies: int) -> None:
        """``copies`` sequences of exactly these sizes (equal ones adjacent)."""
        members, offset, i = sorted(members, reverse=True), 0, 0
        while i < len(members):
            q = members.count(members[i])
            self.take(members[i], q * copies, self.bins, q, offset)
            offset += q * members[i]
            i += q
        self.bins += copies

    def reduce(self) -> int:
        """Fix dominating sets; the number of sequences they fill."""
        before = self.bins
        tried = self.capacity + 1
        while (top := self.largest(tried - 1)) > 0:
            members = self.dominating(top)
            if members is None:
                tried = top
                continue
            need = {s: members.count(s) for s in members}
            copies = min(self.left[s] // q for s, q in need.items())
            # a rule holds while the sizes it looked at last; with each kind
            # kept above what one more check needs, many copies go at once
            spare = min((self.left[s] - 3) // q for s, q in need.items())
            self.fix(members, max(1, min(copies, spare)))
        return self.bins - before

    def without(self, *taken: int):
        """Sizes left as a sorted view when ``taken`` are set aside."""
        left = dict(self.left)
        for s in taken:
            left[s] -= 1
        return left

    def dominating(self, top: int) -> list[int] | None:
        room = self.capacity - top
        rest = self.without(top)

        def largest(limit: int, left: dict[int, int]) -> int:
            i = bisect.bisect_right(self.sizes, limit)
            while i and left[self.sizes[i - 1]] <= 0:
                i -= 1
            return self.sizes[i - 1] if i else 0

        best = largest(room, rest)
        if best == 0:
            return [top]                      # nothing fits with it
        if best == room:
            return [top, best]                # an exact fill replaces any other set
        smallest: list[int] = []
        for s in self.sizes:
            smallest += [s] * min(3 - len(smallest), rest[s])
            if len(smallest) == 3:
                break
        if len(smallest) < 2 or smallest[0] + smallest[1] > room:
            return [top, best]                # at most one more piece fits
        if len(smallest) == 3 and sum(smallest) <= room:
            return None                       # three more fit: no small set is proven
        # at most two more fit: the best pair and the largest second member
        pair, second = 0, 0
        for s in self.sizes:
            if s + smallest[0] > room:
                break
            rest[s] -= 1
            if rest[s] >= 0:
                mate = largest(min(room - s, s), rest)
                if mate:
                    pair, second = max(pair, s + mate), max(second, mate)
            rest[s] += 1
        if pair <= best:
            return [top, best]
        rest[best] -= 1
        third = largest(room - best, rest)
        if third and third >= second:
            return [top, best, third]
        return None

    def best_fit(self) -> None:
        """Best-fit decreasing on ranges of sequences with equal room."""
        ranges: dict[int, list[tuple[int, int]]] = {}
        rooms: list[int] = []

        def put(room: int, first: int, n: int) -> None:
            if n and room:
                if room not in ranges:
                    ranges[room] = []
                    bisect.insort(rooms, room)
                ranges[room].append((first, n))

        while self.sizes:
            size = self.sizes[-1]
            while self.left[size] > 0:
                i = bisect.bisect_left(rooms, size)
                if i < len(rooms):
                    room = rooms[i]
                    first, n = ranges[room].pop()
                    if not ranges[room]:
                        del ranges[room], rooms[i]
                else:
                    room, first, n = self.capacity, self.bins, -1
                per_bin, offset = room // size, self.capacity - room
                count = self.left[size]
                full = count // per_bin if n < 0 else min(n, count // per_bin)
                if full:
                    self.take(size, full * per_bin, first, per_bin, offset)
                    put(room - per_bin * size, first, full)
                rest = count - full * per_bin
                used = full
                if rest and (n < 0 or full < n) and rest < per_bin:
                    self.take(size, rest, first + full, per_bin, offset)
                    put(room - rest * size, first + full, 1)
                    used += 1
                if n < 0:
                    self.bins += used
                else:
                    put(room, first + used, n - used)
                if size not in self.left or self.left[size] == 0:
                    break


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY, reduce: bool = True) -> Plan:
    plan = Plan(capacity, {s: n for s, n in histogram.items() if n > 0})
    if reduce:
        plan.reduce()
    plan.best_fit()
    return plan


# -- Spark ------------------------------------------------------------------

def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces with their sequence_id and offset."""
    spark = docs.sparkSession
    pieces = cut_lineage(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    buckets = pieces_for(pieces.count(), BUCKET_ROWS, 64, 1 << 16)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {int(r[0]): int(r[1]) for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # <= capacity rows
    plan = plan_runs(histogram, capacity)
    runs = sorted(plan.runs)
    table = np.array(runs, np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)  # bounded by the number of lengths, not by the corpus

    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    numbered = (keyed.withColumn("inside", F.row_number().over(inside) - 1)
                .join(offsets, ["length", "bucket"])
                .withColumn("number", F.col("before") + F.col("inside")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = t[:, 0] * (1 << 44) + t[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            number, length = batch.column("number").to_numpy(), batch.column("length").to_numpy()
            r = t[np.searchsorted(keys, length * (1 << 44) + number, "right") - 1]
            k = number - r[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(r[:, 3] + k // r[:, 4]), pa.array(r[:, 5] + k % r[:, 4] * length)],
                [*batch.schema.names[:5], "sequence_id", "offset"])

    return (numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number")
            .mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
