"""SentencePiece BPE encoding and decoding by a max-plus scan.

A sequence of pieces is the BPE encoding of its text exactly if every two
neighbours are *compatible*: the merges of the two alone end in those two
pieces.  So encoding is a path problem on the lattice of pieces, with weight
0 for a compatible step and minus infinity for any other: the best path is
the encoding, and best paths of parts combine by max-plus matrix products.

A piece holds a space mark only at its start (runs of marks apart), so a word
is solved alone and kept in a worker's cache.  A giant document is split into
chunks at any character; a chunk yields the matrix of best weights from each
piece that may cross its left edge to each that may cross its right edge (one
state where a word ends there).  The matrices are combined associatively per
document, forwards and backwards, which names the one piece that crosses each
edge; then every chunk traces its own pieces back, independently.

Runs of space marks have pieces of equal score and follow their own rule.

Defined cases: null text is empty and has no ids; repeated rows are encoded
each; an empty table gives no rows; other columns are ignored.  U+2581 in a
text is a space mark, as it is for the library, and decodes to a space.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import cut_lineage, documents, ship_package, text_batches

MARK = "▁"
CHUNK_CHARS = 1 << 16
#: Words of a generation of a worker's cache (two are kept; some 200 bytes each).
CACHE_WORDS = 400_000
#: Compatible pairs that a worker remembers.
CACHE_PAIRS = 800_000
CUT = "cut"
_NEVER = -np.inf


class Pieces:
    """The pieces of a model, and what they merge to."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes_id = [0] * 256
        self.text: list[bytes] = []
        self.unknown = sp.unk_id()
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_id[int(piece[1:-1], 16)] = i
                self.text.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text.append(b"")
            else:
                self.id[piece] = i
                self.score[piece] = sp.get_score(i)
                self.text.append(piece.replace(MARK, " ").encode())
        self.letters = {c for p in self.id for c in p}
        self.longest = max((len(p) for p in self.id), default=1)
        #: pieces that are their own encoding
        self.standing = {p for p in self.id if len(p) == 1 or self.merged(p) == [p]}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.runs: dict[int, list[str]] = {}
        #: the pieces that may stand by themselves, numbered; every character
        #: of a piece is one of them, whether the model lists it or not
        self.order = sorted(self.standing | self.letters)
        self.many = len(self.order)
        self.lengths = [len(p) for p in self.order]
        #: the ids of each piece, as they are stored
        self.stored = np.dtype("<u2" if len(self.text) <= 1 << 16 else "<u4")
        self.packed = [self.pack([p]) for p in self.order]
        #: whether piece b may follow piece a, by a * many + b
        self.steps: dict[int, bool] = {}

        self._automaton = None

    def pack(self, pieces: list[str]) -> bytes:
        return np.array(self.ids(pieces), self.stored).tobytes()

    def automaton(self):
        """Finds the standing pieces in a text; built once in each worker."""
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for number, piece in enumerate(self.order):
                made.add_word(piece, number)
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def step(self, a: int, b: int) -> bool:
        if len(self.steps) > CACHE_PAIRS:
            self.steps.clear()
        first, second = self.order[a], self.order[b]
        fits = self.steps[a * self.many + b] = self.merged(first + second) == [first, second]
        return fits

    def merged(self, text: str) -> list[str]:
        """BPE of a short string by its definition: the best-scored merge
        first, the leftmost of equals."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs = {}
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def run(self, n: int) -> list[str]:
        """Pieces of ``n`` space marks in a row."""
        if n not in self.runs:
            wide = self.longest
            if n > 4 * wide and MARK * wide in self.id:
                return [MARK * wide] * (n // wide - 2) + self.run(n % wide + 2 * wide)
            self.runs[n] = self.merged(MARK * n)
        return self.runs[n]

    def ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif any(self.bytes_id):
                out += [self.bytes_id[b] for b in p.encode("utf-8", "replace")]
            else:
                out.append(self.unknown)
        return out

    def ending(self, text: str, end: int, first: int) -> Iterator[str]:
        """Pieces that end at ``end`` and start at ``first`` or later."""
        for n in range(1, min(self.longest, end - first) + 1):
            piece = text[end - n:end]
            if n == 1 or piece in self.standing:
                yield piece


def solve_word(pieces: Pieces, word: str) -> list[str]:
    """Pieces of a word (with its space mark, if any): the one path from its
    start whose steps are all compatible."""
    if word in pieces.standing:
        return [word]
    if not pieces.letters.issuperset(word):
        return _solve_around_unknown(pieces, word)
    return [pieces.order[t] for t in _path(pieces, word)]


def _path(pieces: Pieces, word: str) -> list[int]:
    """Numbers of the pieces of a word.  Every prefix of a word has one path,
    so one piece of it ends at each position.  The automaton names the standing
    pieces that end there, the longest first, and a position tests these few
    and no other substrings."""
    steps, many, lengths = pieces.steps, pieces.many, pieces.lengths
    last = [-1] * (len(word) + 1)
    for at, piece in pieces.automaton().iter(word):
        end = at + 1
        if last[end] >= 0:
            continue
        start = end - lengths[piece]
        if start:
            before = last[start]
            step = before * many + piece
            fits = steps.get(step)
            if fits is None:
                fits = pieces.step(before, piece)
            if not fits:
                continue
        last[end] = piece
    path, at = [], len(word)
    while at:
        path.append(last[at])
        at -= lengths[last[at]]
    path.reverse()
    return path


def _solve_around_unknown(pieces: Pieces, word: str) -> list[str]:
    """No piece holds a character that is in no piece, so it stands alone and
    the stretches between are words of their own."""
    out: list[str] = []
    stretch = 0
    for i, c in enumerate(word):
        if c not in pieces.letters:
            if i > stretch:
                out += solve_word(pieces, word[stretch:i])
            out.append(c)
            stretch = i + 1
    return out + (solve_word(pieces, word[stretch:]) if stretch < len(word) else [])


# -- documents of words ---------------------------------------------------------

class WordPieces:
    """Ids of whole texts, word by word, from a worker's cache of stored ids
    (two bytes an id).  A key is a word without its mark; a key that starts
    with a line end has no mark."""

    def __init__(self, pieces: Pieces, capacity: int = CACHE_WORDS):
        self.pieces, self.capacity = pieces, capacity
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _solve(self, key: str) -> bytes:
        p = self.pieces
        if key[:1] == "\n":
            return p.pack(["\n"]) + (self._word(key[1:]) if key[1:] else b"")
        return self._word(MARK + key)

    def _word(self, word: str) -> bytes:
        p = self.pieces
        if word in p.standing or not p.letters.issuperset(word):
            return p.pack(solve_word(p, word))
        packed = p.packed
        return b"".join([packed[t] for t in _path(p, word)])

    def _keys(self, text: str) -> list[str]:
        lines = text.split("\n")
        keys = lines[0].split(" ")
        for line in lines[1:]:
            words = line.split(" ")
            words[0] = "\n" + words[0]
            keys += words
        return keys

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.pieces.stored)
        text = text.replace(MARK, " ")
        keys = self._keys(text)
        known = self.known
        found = list(map(known.get, keys))
        if None in found:
            if len(known) > self.capacity:            # words met since the last turn stay within reach
                self.older, self.known = known, {}
                known = self.known
            for i, ids in enumerate(found):
                if ids is None:
                    key = keys[i]
                    ids = known.get(key)
                    if ids is None:
                        ids = self.older.get(key)
                        if ids is None:
                            ids = self._solve(key)
                        if len(key) <= 64:
                            known[key] = ids
                    found[i] = ids
        if "" in keys:
            found = self._with_runs(keys, found)
        return np.frombuffer(b"".join(found), self.pieces.stored)

    def _with_runs(self, keys: list[str], found: list[bytes]) -> list[bytes]:
        """Empty keys are marks in a row with the mark of the next word."""
        mark = self.pieces.pack([MARK])
        out, marks = [], 0
        for key, ids in zip(keys, found, strict=True):
            if key == "":
                marks += 1
                continue
            if marks:
                joins = key[0] != "\n" and ids[:len(mark)] == mark
                out.append(self.pieces.pack(self.pieces.run(marks + joins)))
                out.append(ids[len(mark):] if joins else ids)
                marks = 0
            else:
                out.append(ids)
        if marks:
            out.append(self.pieces.pack(self.pieces.run(marks)))
        return out


def decode_ids(pieces: Pieces, ids: np.ndarray, start: bool = True) -> bytes:
    """Text of ids; ``start``: the first mark is the one that encoding adds."""
    text = pieces.text
    out = b"".join([text[i] for i in ids.tolist()])
    return out[1:] if start and out[:1] == b" " else out


# -- chunks of giant documents ----------------------------------------------------

def chunk_edges(text: str, size: int) -> list[int]:
    """Edges about ``size`` characters apart, each inside a word or before the
    first space of a gap."""
    edges, p = [0], size
    while p < len(text):
        while p < len(text) and text[p - 1] == " ":
            p += 1
        if p >= len(text):
            break
        edges.append(p)
        p += size
    return [*edges, len(text)]


class Chunk:
    """A stretch ``text[left:right]`` of a marked text, with as much of its
    surroundings as pieces may cross.  ``text`` has marks for spaces."""

    def __init__(self, pieces: Pieces, text: str, left: int, right: int):
        self.p, self.text, self.left, self.right = pieces, text, left, right

    def _cut(self, at: int) -> bool:
        """No piece crosses ``at``."""
        t = self.text
        return at in (0, len(t)) or t[at] == MARK or t[at] not in self.p.letters or t[at - 1] not in self.p.letters

    def _bounds(self, at: int) -> tuple[int, int]:
        lo, hi = at - 1, at
        while not self._cut(lo) and at - lo < self.p.longest:
            lo -= 1
        while not self._cut(hi) and hi - at < self.p.longest - 1:
            hi += 1
        return lo, hi

    def states(self, at: int) -> list[tuple]:
        """What may cross edge ``at``: (piece, end), or the one state of a cut."""
        if self._cut(at):
            return [(CUT, at)]
        lo, hi = self._bounds(at)
        return [(piece, end) for end in range(at, hi + 1) for piece in self.p.ending(self.text, end, lo) if end - len(piece) < at]

    def _word_end(self, at: int) -> int:
        """The next cut after ``at``, at most one piece beyond the right edge."""
        end, last = at + 1, min(len(self.text), self.right + self.p.longest - 1)
        while end < last and not self._cut(end):
            end += 1
        return end

    def _reach(self, entries: list[tuple]) -> dict[tuple, np.ndarray]:
        """Weights from every entry state to every (piece, end) of the word
        that crosses the left edge."""
        n = len(entries)
        node: dict[tuple, np.ndarray] = {}
        by_end: dict[int, list[tuple]] = {}

        def put(key, weight):
            if key not in node:
                node[key] = weight
                by_end.setdefault(key[1], []).append(key)
            else:
                node[key] = np.maximum(node[key], weight)

        for i, state in enumerate(entries):
            unit = np.full(n, _NEVER)
            unit[i] = 0
            put(state, unit)
        for end in range(self.left + 1, self._word_end(self.left) + 1):
            for piece in self.p.ending(self.text, end, self.left):
                start = end - len(piece)
                weight = None
                for before in by_end.get(start, ()):
                    if before[0] == CUT or self.p.compatible(before[0], piece):
                        weight = node[before] if weight is None else np.maximum(weight, node[before])
                if weight is not None and weight.max() > _NEVER:
                    put((piece, end), weight)
        return node

    def matrix(self) -> np.ndarray:
        """Best weights from the states of the left edge to those of the right."""
        entries, exits = self.states(self.left), self.states(self.right)
        out = np.full((len(entries), len(exits)), _NEVER)
        stop = self._word_end(self.left)
        if entries[0][0] == CUT:
            into = np.zeros(1)
            stop = self.left
        else:
            node = self._reach(entries)
            if stop > self.right or (stop == self.right and exits[0][0] != CUT) or not self._cut(stop):
                for j, state in enumerate(exits):
                    if state in node:
                        out[:, j] = node[state]
                return out
            into = np.full(len(entries), _NEVER)
            for (_, end), weight in node.items():
                if end == stop:
                    into = np.maximum(into, weight)
        if exits[0][0] == CUT:
            out[:, 0] = into
            return out
        tail = Chunk(self.p, self.text, self._last_cut(), self.right)
        node = tail._reach([(CUT, tail.left)])
        onward = np.array([node[s][0] if s in node else _NEVER for s in exits])
        return into[:, None] + onward[None, :]

    def _last_cut(self) -> int:
        at = self.right - 1
        while not self._cut(at):
            at -= 1
        return at

    def trace(self, entry: tuple, exit_: tuple) -> list[str]:
        """Pieces after ``entry`` up to and with ``exit_``."""
        start = self.left if entry[0] == CUT else entry[1]
        head: list[str] = []
        if entry[0] != CUT and not (self._cut(start) and start <= self.right):
            stop = self._word_end(self.left)
            target = exit_ if exit_[0] != CUT and (stop > self.right or not self._cut(stop)) else None
            head, start = self._path(entry, target, stop)
            if target is not None:
                return head
        if exit_[0] == CUT:
            return head + self._between(start, self.right)
        at = self._last_cut()
        tail, _ = Chunk(self.p, self.text, at, self.right)._path((CUT, at), exit_, None)
        gap = at
        while gap > start and self.text[gap - 1] == MARK:
            gap -= 1
        if gap < at and tail[0] == MARK:          # the word's mark stays alone and joins the run before it
            return head + self._between(start, gap) + self.p.run(at - gap + 1) + tail[1:]
        return head + self._between(start, at) + tail

    def _path(self, entry: tuple, target: tuple | None, stop: int | None) -> tuple[list[str], int]:
        """The path from ``entry`` to ``target``, or to any piece that ends at ``stop``."""
        if entry == target:
            return [], entry[1]
        back: dict[tuple, tuple | None] = {entry: None}
        by_end = {entry[1]: [entry]}
        for end in range(entry[1] + 1, (target[1] if target else stop) + 1):
            for piece in self.p.ending(self.text, end, entry[1]):
                for before in by_end.get(end - len(piece), ()):
                    if before[0] == CUT or self.p.compatible(before[0], piece):
                        back[piece, end] = before
                        by_end.setdefault(end, []).append((piece, end))
                        break
        at = target if target else by_end[stop][0]
        end, out = at[1], []
        while at != entry:
            out.append(at[0])
            at = back[at]
        return out[::-1], end

    def _between(self, start: int, stop: int) -> list[str]:
        """Pieces of whole words and runs of marks."""
        out: list[str] = []
        for found in re.finditer(f"({MARK}*)([^{MARK}]*)", self.text[start:stop]):
            marks, word = len(found[1]), found[2]
            if not marks and not word:
                continue
            parts: list[str] = []
            if word:
                for k, some in enumerate(self._known_parts(word)):
                    parts += solve_word(self.p, (MARK if marks and k == 0 else "") + some) if some[0] in self.p.letters else (
                        ([MARK] if marks and k == 0 else []) + list(some))
            if marks:
                joins = not parts or parts[0] == MARK
                parts = self.p.run(marks if joins else marks - 1) + (parts[1:] if joins else parts) if marks > 1 or not parts else parts
            out += parts
        return out

    def _known_parts(self, word: str) -> list[str]:
        """Stretches of letters that occur in pieces, and of others."""
        out, at = [], 0
        for i in range(1, len(word) + 1):
            if i == len(word) or (word[i] in self.p.letters) != (word[at] in self.p.letters):
                out.append(word[at:i])
                at = i
        return out


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1)


def edge_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(entry, exit) state numbers of every chunk on the best path: forward
    and backward products, both associative, meet at each edge."""
    forward = [np.zeros((1, 1))]
    for m in matrices:
        forward.append(max_plus(forward[-1], m))
    backward = [np.zeros((1, 1))]
    for m in reversed(matrices):
        backward.append(max_plus(m, backward[-1]))
    backward.reverse()
    at = [int(np.argmax(f[0] + b[:, 0])) for f, b in zip(forward, backward, strict=True)]
    return list(zip(at[:-1], at[1:], strict=True))


# -- checksums of joined parts ------------------------------------------------------

def crc_of_joined(first: int, second: int, n: int) -> int:
    """crc32 of two byte strings joined, from theirs and the second's length:
    the first's register is run through ``n`` zero bytes by squaring."""
    def times(m, v):
        s, i = 0, 0
        while v:
            if v & 1:
                s ^= m[i]
            v >>= 1
            i += 1
        return s

    step = [0xEDB88320] + [1 << i for i in range(31)]     # one zero bit
    for _ in range(3):
        step = [times(step, c) for c in step]             # one zero byte
    while n:
        if n & 1:
            first = times(step, first)
        step = [times(step, c) for c in step]
        n >>= 1
    return first ^ second


# -- Spark ------------------------------------------------------------------------------

_MODELS: dict[str, tuple[Pieces, WordPieces]] = {}


def _model(path: str) -> tuple[Pieces, WordPieces]:
    """One model and cache per Python worker, kept from task to task."""
    if path not in _MODELS:
        pieces = Pieces(path)
        _MODELS[path] = pieces, WordPieces(pieces)
    return _MODELS[path]


def _digest(pieces: Pieces, ids: np.ndarray | list[int], start: bool) -> tuple[int, int, int, int]:
    """n_tokens, crc32 of the ids, crc32 and length of the decoded bytes."""
    array = np.asarray(ids, "<u4")
    raw = decode_ids(pieces, array, start)
    return len(ids), zlib.crc32(array.tobytes()), zlib.crc32(raw), len(raw)


def encode_small(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Texts of one chunk: doc_id, text_crc32 and the digest columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, words = _model(path)
        for batch in batches:
            for part in text_batches(batch, 2 << 20):
                texts = part.column("text").to_pylist()
                encoded = [words.encode(t) for t in texts]
                rows = list(zip(*(_digest(pieces, ids, True) for ids in encoded), strict=True))
                crc = [zlib.crc32(t.replace(MARK, " ").encode("utf-8", "replace")) for t in texts]
                cols = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in rows), pa.array(crc, pa.int64())]
                names = ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "n_decoded", "text_crc32"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([e.astype("i4") for e in encoded] if with_ids else [None] * len(texts), pa.list_(pa.int32()))], [*names, "ids"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, n_decoded long, text_crc32 long, ids array<int>")


_CHUNK = "doc_id long, copies long, text_hash long, chunk int, before string, own string, after string, text_crc32 long"


def _split(size: int, reach: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                plain = row.text.replace(MARK, " ")
                crc = zlib.crc32(plain.encode("utf-8", "replace"))
                text = MARK + plain.replace(" ", MARK)
                edges = [0, *(e + 1 for e in chunk_edges(plain, size)[1:])]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    yield pd.DataFrame([(row.doc_id, row.copies, row.text_hash, k, text[max(0, a - reach):a], text[a:b], text[b:b + reach], crc)],
                                       columns=[c.split()[0] for c in _CHUNK.split(", ")])
    return run


def _chunk(pieces: Pieces, row) -> Chunk:
    return Chunk(pieces, row.before + row.own + row.after, len(row.before), len(row.before) + len(row.own))


def encode_giant(docs: DataFrame, path: str, size: int = CHUNK_CHARS, with_ids: bool = False) -> DataFrame:
    """Texts of several chunks, by transfer matrices."""
    reach = 2 * Pieces(path).longest
    # rows of one id and text count as copies; a negative count marks a missing id
    once = docs.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")).select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.when(F.col("doc_id").isNull(), -F.col("n")).otherwise(F.col("n")).alias("copies"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("text_hash"), "text")
    split = once.select("doc_id", "copies", "text_hash", "text").mapInPandas(_split(size, reach), _CHUNK)
    key = ["doc_id", "text_hash"]
    # a chunk is little to move and much to solve: the number of tasks is fixed,
    # as Spark would join them by their bytes
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    chunks = cut_lineage(split.repartition(tasks, *key, "chunk"), "chunks")

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, _ = _model(path)
        for f in frames:
            yield pd.DataFrame({**{c: f[c] for c in (*key, "chunk")}, "matrix": [pickle.dumps(_chunk(pieces, r).matrix()) for r in f.itertuples()]})

    def join(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("chunk")
        states = edge_states([pickle.loads(m) for m in f["matrix"]])
        return pd.DataFrame({**{c: f[c] for c in (*key, "chunk")}, "entry": [a for a, _ in states], "leaves": [b for _, b in states]})

    named = (chunks.repartition(tasks, *key, "chunk").mapInPandas(matrices, "doc_id long, text_hash long, chunk int, matrix binary")
             .groupBy(*key).applyInPandas(join, "doc_id long, text_hash long, chunk int, entry int, leaves int"))

    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, _ = _model(path)
        for f in frames:
            out = []
            for r in f.itertuples():
                c = _chunk(pieces, r)
                ids = pieces.ids(c.trace(c.states(c.left)[r.entry], c.states(c.right)[r.leaves]))
                out.append((r.doc_id, r.text_hash, r.chunk, r.copies, *_digest(pieces, ids, r.chunk == 0), r.text_crc32, ids if with_ids else None))
            yield pd.DataFrame(out, columns=[*key, "chunk", "copies", "n_tokens", "ids_crc32", "decoded_crc32", "n_decoded", "text_crc32", "ids"])

    parts = "n_tokens long, ids_crc32 long, decoded_crc32 long, n_decoded long, text_crc32 long, ids array<int>"
    traced = chunks.join(named, [*key, "chunk"]).repartition(tasks, *key, "chunk").mapInPandas(trace, f"doc_id long, text_hash long, chunk int, copies long, {parts}")

    def total(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("chunk")
        ids_crc = text_crc = 0
        for r in f.itertuples():
            ids_crc = crc_of_joined(ids_crc, r.ids_crc32, 4 * r.n_tokens)
            text_crc = crc_of_joined(text_crc, r.decoded_crc32, r.n_decoded)
        one = (f["doc_id"].iloc[0], f["copies"].iloc[0], f["n_tokens"].sum(), ids_crc, text_crc, f["n_decoded"].sum(), f["text_crc32"].iloc[0],
               [i for ids in f["ids"] for i in ids] if with_ids else None)
        return pd.DataFrame([one], columns=["doc_id", "copies", "n_tokens", "ids_crc32", "decoded_crc32", "n_decoded", "text_crc32", "ids"])

    whole = traced.groupBy(*key).applyInPandas(total, f"doc_id long, copies long, {parts}")
    named_again = whole.withColumn("doc_id", F.when(F.col("copies") > 0, F.col("doc_id")))
    return named_again.withColumn("copy", F.explode(F.sequence(F.lit(1), F.abs("copies")))).drop("copies", "copy")


def encode(docs: DataFrame, path: str, size: int = CHUNK_CHARS, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    numbers), round_trip (the decoded ids give the text back) and, with
    ``with_ids``, the ids."""
    ship_package(docs.sparkSession)
    plain = documents(docs)
    small = encode_small(plain.where(F.length("text") <= size), path, with_ids)
    giant = encode_giant(plain.where(F.length("text") > size), path, size, with_ids)
    out = small.unionByName(giant).withColumn("round_trip", F.col("decoded_crc32") == F.col("text_crc32"))
    return out.select("doc_id", "n_tokens", "ids_crc32", "round_trip", *(["ids"] if with_ids else []))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of (doc_id, ids); bytes that are no UTF-8 are replaced."""
    ship_package(encoded.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, _ = _model(path)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "text": [
                "" if ids is None else decode_ids(pieces, np.asarray(ids, np.int64)).decode("utf-8", "replace") for ids in f["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
