"""External induced sorting of the suffixes of many short strings.

The text is kept on disk, and so are the queues: every byte value has a
first-in-first-out queue of suffix tuples (position, common prefix with the
tuple before it).  Suffixes are induced in waves -- all tuples that wait in
the queue of one byte at once -- so a wave is a few array operations, tuples
reach each queue in sorted order, and a queue of queues by byte value is a
priority queue over suffixes.  Beyond a memory budget the queues spill to one
temporary file, which is removed with the sorter.

* Seeds, the suffixes where a falling run turns to a rising one, are dealt by
  their first bytes and sorted within each part, eight bytes at a time, to
  ``depth`` bytes.  As only common prefixes up to ``depth`` are asked for,
  this takes the place of naming seeds and recursing on their names.
* The first pass goes up through the byte values and induces the falling
  suffixes; the second goes down and induces the rising ones.  Both carry the
  length of the common prefix with the neighbour: one more than the least
  value between the two suffixes that induced them.

A string ends at its separator, and a common prefix never goes past one.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes that queued tuples may take before they go to disk.
MEMORY = 48 << 20
CHUNK = 1 << 18
_MOST = 255
_TUPLE = np.dtype([("at", np.int64), ("lcp", np.uint8)])


class _Disk:
    """The temporary file of one sorter, and the bytes now held in memory."""

    def __init__(self, memory: int):
        self.folder = tempfile.mkdtemp(prefix="suffixes-")
        self.memory, self.held = memory, 0
        self.file = open(os.path.join(self.folder, "queues"), "w+b")  # noqa: SIM115  closed with the folder

    def array(self, name: str, dtype, n: int) -> np.ndarray:
        if n == 0:
            return np.zeros(0, dtype)
        return np.memmap(os.path.join(self.folder, name), dtype, "w+", shape=(n,)).view(np.ndarray)

    def write(self, chunk: np.ndarray) -> tuple[int, int]:
        self.file.seek(0, 2)
        at = self.file.tell()
        self.file.write(chunk.tobytes())
        return at, len(chunk)

    def read(self, at: int, n: int) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * _TUPLE.itemsize), _TUPLE)

    def close(self) -> None:
        self.file.close()
        shutil.rmtree(self.folder, ignore_errors=True)


class Queue:
    """Chunks of tuples, first in first out, in memory or on disk."""

    def __init__(self, disk: _Disk):
        self.disk, self.chunks = disk, []

    def push(self, chunk: np.ndarray) -> None:
        if not len(chunk):
            return
        if self.disk.held + chunk.nbytes > self.disk.memory:
            self.chunks.append(self.disk.write(chunk))
        else:
            self.disk.held += chunk.nbytes
            self.chunks.append(chunk)

    def __bool__(self) -> bool:
        return bool(self.chunks)

    def _load(self, chunk) -> np.ndarray:
        if isinstance(chunk, tuple):
            return self.disk.read(*chunk)
        self.disk.held -= chunk.nbytes
        return chunk

    def take(self) -> Iterator[np.ndarray]:
        """Chunks in order, those pushed meanwhile too, until none is left.
        Small neighbours are joined."""
        while self.chunks:
            joined, n = [], 0
            while self.chunks and n < CHUNK:
                joined.append(self._load(self.chunks.pop(0)))
                n += len(joined[-1])
            yield joined[0] if len(joined) == 1 else np.concatenate(joined)

    def take_back(self) -> Iterator[np.ndarray]:
        while self.chunks:
            yield self._load(self.chunks.pop())


class InducedSorter:
    """Suffixes of the strings given to ``add``, sorted, with common prefixes."""

    def __init__(self, depth: int = 50, memory: int = MEMORY):
        self.depth, self.disk = min(depth, _MOST - 8), _Disk(memory)
        self._text = open(os.path.join(self.disk.folder, "text"), "wb")  # noqa: SIM115
        self.n = 0

    def __enter__(self) -> InducedSorter:
        return self

    def __exit__(self, *_) -> None:
        if not self._text.closed:
            self._text.close()
        self.disk.close()

    def add(self, strings: Iterable[bytes]) -> None:
        """Append strings; each is followed by a separator (0, with bytes from 1)."""
        raw = list(strings)
        sizes = np.array([len(s) + 1 for s in raw], np.int64)
        out = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8).astype(np.uint16) + 1
        out[np.cumsum(sizes) - 1] = 0
        out.tofile(self._text)
        self.n += len(out)

    # -- arrays over the text, made block by block ---------------------------

    def _blocks(self) -> Iterator[tuple[int, int]]:
        """Ranges that end with a separator."""
        at = 0
        while at < self.n:
            end = min(self.n, at + CHUNK)
            while self.text[end - 1] != 0:
                more = min(self.n, end + CHUNK)
                zeros = np.flatnonzero(self.text[end:more] == 0)
                end = end + int(zeros[0]) + 1 if len(zeros) else more
            yield at, end
            at = end

    def prepare(self) -> None:
        self._text.close()
        path = os.path.join(self.disk.folder, "text")
        self.text = np.memmap(path, np.uint16, "r", shape=(self.n,)).view(np.ndarray) if self.n else np.zeros(0, np.uint16)
        self.rising = self.disk.array("rising", np.bool_, self.n)
        self.run = self.disk.array("run", np.uint8, self.n)       # equal bytes from here on, up to 255
        self.left = self.disk.array("left", np.uint8, self.n)     # bytes to the separator, up to 255
        for lo, hi in self._blocks():
            t = np.asarray(self.text[lo:hi])
            ends = np.flatnonzero(np.concatenate([t[1:] != t[:-1], [True]]))
            lengths = np.diff(np.concatenate([[-1], ends]))
            up = np.concatenate([t[ends[:-1] + 1] > t[ends[:-1]], [True]])
            up[t[ends] == 0] = True
            self.rising[lo:hi] = np.repeat(up, lengths)
            place = np.arange(len(t))
            self.run[lo:hi] = np.minimum(np.repeat(ends, lengths) - place + 1, _MOST)
            zeros = np.flatnonzero(t == 0)
            self.left[lo:hi] = np.minimum(zeros[np.searchsorted(zeros, place)] - place, _MOST)

    # -- seeds ----------------------------------------------------------------

    def _eight(self, at: np.ndarray, offset: int) -> np.ndarray:
        """Bytes at + offset ... + 7 as one number; nothing after a separator.
        A byte takes nine bits' worth of order in seven places of 257."""
        key = np.zeros(len(at), np.uint64)
        left = self.left[at]
        short = np.flatnonzero(left < offset + 7)
        for k in range(offset, offset + 7):
            c = self.text.take(at + k, mode="clip")
            c[short[left[short] <= k]] = 0
            key *= np.uint64(257)
            key += c
        return key

    def _sorted_seeds(self, at: np.ndarray) -> np.ndarray:
        """Tuples of seeds with one first byte, sorted to ``depth`` bytes."""
        key = self._eight(at, 0)
        order = np.argsort(key)
        at, key = at[order], key[order]
        lcp = np.zeros(len(at), np.int64)
        tied = np.concatenate([[False], key[1:] == key[:-1]])
        self._common(lcp, np.flatnonzero(~tied), key, np.arange(len(at)), 0)
        # groups of equal keys, ``some``, are sorted by the next bytes, others stay
        some, was, offset = np.arange(len(at)), tied, 7
        while offset < self.depth and was.any():
            grouped = was | np.append(was[1:], False)
            some, was = some[grouped], was[grouped]
            key = self._eight(at[some], offset)
            order = _sorted_in_groups(key, np.cumsum(~was))
            at[some] = at[some[order]]
            key = key[order]
            same = np.concatenate([[False], key[1:] == key[:-1]]) & was
            self._common(lcp, np.flatnonzero(was & ~same), key, some, offset)
            was = same
            offset += 7
        tied = some[was]
        lcp[tied] = _MOST
        lcp[1:] = np.minimum(lcp[1:], np.minimum(self.left[at[1:]], self.left[at[:-1]]))
        lcp[:1] = 0
        out = np.empty(len(at), _TUPLE)
        out["at"], out["lcp"] = at, np.minimum(lcp, self.depth)
        return out

    def _common(self, lcp: np.ndarray, i: np.ndarray, key: np.ndarray, some: np.ndarray, offset: int) -> None:
        """Common prefixes of neighbours ``i`` among ``some`` that part within
        these seven bytes."""
        i = i[i > 0]
        a, b, same = key[i - 1], key[i], np.full(len(i), offset, np.int64)
        for k in range(6, -1, -1):
            unit = np.uint64(257 ** k)
            same += a // unit == b // unit
        lcp[some[i]] = same

    def _deal_seeds(self) -> dict[int, Queue]:
        parts: dict[int, Queue] = {}
        for lo, hi in self._blocks():
            up = np.asarray(self.rising[lo:hi])
            at = np.flatnonzero(up[1:] & ~up[:-1]) + lo + 1
            chunk = np.zeros(len(at), _TUPLE)
            chunk["at"] = at
            for c, some in _dealt(chunk, self.text[at]):
                parts.setdefault(c, Queue(self.disk)).push(some)
        return parts

    def _seed_tuples(self, c: int, queue: Queue) -> Iterator[np.ndarray]:
        """Sorted seeds with first byte ``c``.  They are dealt once more by
        their second byte, so that a sort holds one such part, or some small
        ones."""
        if c == 0:
            for chunk in queue.take():
                out = chunk.copy()
                out["lcp"] = 0
                yield out
            return
        parts: dict[int, Queue] = {}
        for chunk in queue.take():
            for d, some in _dealt(chunk, self.text[chunk["at"] + 1]):
                parts.setdefault(d, Queue(self.disk)).push(some)
        held, n, begun = [], 0, False
        for d in sorted(parts):
            for some in parts[d].take():
                held.append(some["at"])
                n += len(some)
            if n < CHUNK and d != max(parts):
                continue
            out = self._sorted_seeds(np.concatenate(held))
            if begun:
                out["lcp"][0] = 1
            held, n, begun = [], 0, True
            yield out

    # -- induction --------------------------------------------------------------

    def sort(self) -> Iterator[np.ndarray]:
        """Tuples of all suffixes but the separators, from the largest to the
        smallest; ``lcp`` is the common prefix with the tuple before, exact
        up to ``depth``."""
        self.prepare()
        if self.n == 0:
            return
        seeds = self._deal_seeds()
        falling: dict[int, Queue] = {}
        induce = _Inducer(self, rising=False)
        for c in range(257):
            kept = falling.setdefault(c, Queue(self.disk))
            last = -1
            for wave in induce.waiting(c):
                induce.step(wave)
                kept.push(wave)
                last = int(wave["at"][-1])
            if c in seeds:
                for wave in self._seed_tuples(c, seeds[c]):
                    if last >= 0 and c:       # from the last falling to the first rising suffix
                        wave["lcp"][0] = min(int(self.run[last]), int(self.run[wave["at"][0]]), self.depth)
                    last = -1
                    induce.step(wave)
        induce = _Inducer(self, rising=True)
        for c in range(256, 0, -1):
            last = -1
            for wave in induce.waiting(c):
                induce.step(wave)
                last = int(wave["at"][-1])
                yield wave
            # the falling suffixes, backwards: a value now belongs to the other neighbour
            after = None
            for chunk in falling[c].take_back():
                wave = chunk[::-1].copy()
                own = chunk["lcp"][::-1]
                wave["lcp"][1:] = own[:-1]
                if after is not None:
                    wave["lcp"][0] = after
                elif last >= 0:
                    wave["lcp"][0] = min(int(self.run[last]), int(self.run[wave["at"][0]]), self.depth)
                else:
                    wave["lcp"][0] = 0
                after = own[-1]
                induce.step(wave)
                yield wave


def _dealt(chunk: np.ndarray, by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``chunk`` by the value of ``by`` (16 bits, which numpy sorts by radix)."""
    order = np.argsort(by, kind="stable")
    chunk, by = chunk[order], by[order]
    heads = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.zeros(0, int)
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(by)]):  # noqa: B905  no heads, no end
        yield int(by[a]), chunk[a:b].copy()


def _sorted_in_groups(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order by ``key`` within groups that rise by one."""
    if group[-1] >= 1 << 16:
        return np.lexsort((key, group))
    order = np.argsort(key)
    return order[np.argsort(group[order].astype(np.uint16), kind="stable")]


class _Inducer:
    """One pass: takes sorted tuples and queues the suffixes before them that
    are of the pass's kind."""

    def __init__(self, sorter: InducedSorter, rising: bool):
        self.s, self.rising = sorter, rising
        self.queues = [Queue(sorter.disk) for _ in range(257)]
        self.began = np.zeros(257, bool)
        self.least = np.full(257, _MOST, np.uint8)   # of the values since the last tuple of each queue

    def waiting(self, c: int) -> Iterator[np.ndarray]:
        return self.queues[c].take()

    def step(self, wave: np.ndarray) -> None:
        s = self.s
        lcp = np.ascontiguousarray(wave["lcp"])
        before = wave["at"] - 1
        c = s.text[before]                        # position -1 reads the last separator: never queued
        want = (before >= 0) & (c > 0) & (s.rising[before] == self.rising)
        src = np.flatnonzero(want)
        if len(src):
            dest = c[src]
            order = np.argsort(dest, kind="stable")   # 16 bits: by radix
            src, dest = src[order], dest[order].astype(np.int64)
            new = np.concatenate([[True], dest[1:] != dest[:-1]])
            begin = np.where(new, 0, np.concatenate([[0], src[:-1] + 1]))
            cuts = np.stack([begin, src + 1], 1).ravel()
            padded = np.concatenate([lcp, [np.uint8(_MOST)]])
            value = np.minimum.reduceat(padded, cuts)[::2]
            first = np.flatnonzero(new)
            heads = dest[first]
            value[first] = np.minimum(value[first], self.least[heads])
            value = np.minimum(value.astype(np.int64) + 1, s.depth)
            value[first[~self.began[heads]]] = 0
            out = np.empty(len(src), _TUPLE)
            out["at"], out["lcp"] = before[src], value
            stops = np.concatenate([first[1:], [len(src)]])
            for d, a, b in zip(heads, first, stops, strict=True):
                s_queue = self.queues[d]
                s_queue.push(out[a:b])
            self.least = np.minimum(self.least, lcp.min())
            rest = src[stops - 1] + 1
            tail = np.minimum.accumulate(padded[::-1])[::-1]
            self.least[heads] = tail[np.minimum(rest, len(lcp))]
            self.began[heads] = True
        elif len(lcp):
            self.least = np.minimum(self.least, lcp.min())
