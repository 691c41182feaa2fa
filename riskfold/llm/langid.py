"""Language identification by a bidirectional gated recurrent network.

The network reads the bytes of one word (a run of non-space characters, lower
case, in stretches of at most ``LONGEST`` bytes) in both directions, gives
every byte position a distribution over the languages, and a document's
distribution is the mean over all positions of its words that hold a letter.
It is trained in numpy by backpropagation through time on words drawn from a
bounded, documented number of labelled documents.

A word's position labels depend on the word alone, so a worker computes them
once per distinct word and keeps their sum in a cache.

Defined cases: null text, empty text and text without a letter give ``und``
with score 0; with no labelled document every text is ``und``; repeated rows
are labelled each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import crc_fold, releasing, ship_package, text_batches

#: Labelled documents per language that training may draw words from, and
#: words drawn from one document (spread over the whole text).
DOCS_PER_LANGUAGE = 800
WORDS_PER_DOC = 120
TRAINING_WORDS = 160_000
HIDDEN = 16
LONGEST = 24
STEPS = 700
BATCH = 256
CACHE_WORDS = 300_000
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


# -- the network ------------------------------------------------------------

def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _gru(table, u, b, seq):
    """Hidden states (T, B, H) of one direction and what backpropagation needs.
    ``table`` maps a byte to its three gate inputs; ``seq`` is (T, B)."""
    t_max, lanes = seq.shape
    h_size = u.shape[0]
    h = np.zeros((lanes, h_size), np.float32)
    states = np.empty((t_max, lanes, h_size), np.float32)
    tape = []
    for t in range(t_max):
        x = table[seq[t]]
        v = h @ u + b
        zr = _sigmoid(x[:, :2 * h_size] + v[:, :2 * h_size])
        z, r = zr[:, :h_size], zr[:, h_size:]
        vn = v[:, 2 * h_size:]
        n = np.tanh(x[:, 2 * h_size:] + r * vn)
        tape.append((h, z, r, vn, n))
        h = n + z * (h - n)
        states[t] = h
    return states, tape


def _gru_back(table, u, seq, tape, d_states):
    """Gradients of one direction by backpropagation through time."""
    h_size = u.shape[0]
    d_table, d_u, d_b = np.zeros_like(table), np.zeros_like(u), np.zeros(3 * h_size, np.float32)
    d_h = np.zeros_like(d_states[0])
    for t in range(len(tape) - 1, -1, -1):
        h, z, r, vn, n = tape[t]
        d_h = d_h + d_states[t]
        d_n = d_h * (1 - z) * (1 - n * n)
        d_z = d_h * (h - n) * z * (1 - z)
        d_r = d_n * vn * r * (1 - r)
        d_x = np.concatenate([d_z, d_r, d_n], 1)
        d_v = np.concatenate([d_z, d_r, d_n * r], 1)
        np.add.at(d_table, seq[t], d_x)
        d_u += h.T @ d_v
        d_b += d_v.sum(0)
        d_h = d_h * z + d_v @ u.T
    return d_table, d_u, d_b


@dataclass
class Network:
    languages: list[str]
    params: dict[str, np.ndarray]

    @classmethod
    def start(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        p = {}
        for side in ("f", "b"):
            p[f"table_{side}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            p[f"u_{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            p[f"bias_{side}"] = np.zeros(3 * hidden)
        p["out"] = rng.normal(0, 0.3, (2 * hidden, len(languages)))
        p["out_bias"] = np.zeros(len(languages))
        return cls(languages, {k: v.astype(np.float32) for k, v in p.items()})

    def positions(self, seq: np.ndarray, tape: bool = False):
        """(T, B, languages): the distribution at every position of equally
        long words, ``seq`` (T, B)."""
        p = self.params
        fwd, tape_f = _gru(p["table_f"], p["u_f"], p["bias_f"], seq)
        bwd, tape_b = _gru(p["table_b"], p["u_b"], p["bias_b"], seq[::-1])
        both = np.concatenate([fwd, bwd[::-1]], 2)
        logits = both @ p["out"] + p["out_bias"]
        probs = np.exp(logits - logits.max(2, keepdims=True))
        probs /= probs.sum(2, keepdims=True)
        return (probs, both, tape_f, tape_b) if tape else probs

    def gradients(self, seq: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions and its gradients."""
        p = self.params
        probs, both, tape_f, tape_b = self.positions(seq, tape=True)
        t_max, lanes, _ = probs.shape
        loss = float(-np.log(probs[:, np.arange(lanes), labels] + 1e-9).mean())
        d = probs.copy()
        d[:, np.arange(lanes), labels] -= 1
        d /= t_max * lanes
        flat = d.reshape(-1, d.shape[2])
        g = {"out": both.reshape(-1, both.shape[2]).T @ flat, "out_bias": flat.sum(0)}
        d_both = d @ p["out"].T
        h = d_both.shape[2] // 2
        g["table_f"], g["u_f"], g["bias_f"] = _gru_back(p["table_f"], p["u_f"], seq, tape_f, d_both[:, :, :h])
        g["table_b"], g["u_b"], g["bias_b"] = _gru_back(p["table_b"], p["u_b"], seq[::-1], tape_b, d_both[::-1, :, h:])
        return loss, g


def train(words: list[bytes], labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Adam over batches of equally long words."""
    net = Network.start(languages, seed=seed)
    rng = np.random.default_rng(seed)
    lengths = np.array([len(w) for w in words])
    groups = {n: np.flatnonzero(lengths == n) for n in np.unique(lengths)}
    arrays = {n: np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), n).T for n, at in groups.items()}
    order = np.array(sorted(groups))
    share = np.array([len(groups[n]) * n for n in order], float)
    share /= share.sum()
    m = {k: np.zeros_like(v) for k, v in net.params.items()}
    s = {k: np.zeros_like(v) for k, v in net.params.items()}
    for step in range(1, steps + 1):
        n = order[rng.choice(len(order), p=share)]
        pick = rng.integers(0, len(groups[n]), min(BATCH, 4 * len(groups[n])))
        _, grads = net.gradients(arrays[n][:, pick], labels[groups[n][pick]])
        rate = 0.02 * (1 - step / (steps + 1)) + 0.0005
        for k, g in grads.items():
            m[k] += 0.1 * (g - m[k])
            s[k] += 0.005 * (g * g - s[k])
            net.params[k] = net.params[k] - np.float32(rate) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.995 ** step)) + 1e-7)
    return net


# -- words --------------------------------------------------------------------

def stretches(word: str) -> list[bytes]:
    raw = word.encode("utf-8", "replace")
    return [raw[i:i + LONGEST] for i in range(0, len(raw), LONGEST)]


class WordLabels:
    """Summed position distributions of words, kept in a worker's cache."""

    def __init__(self, net: Network, capacity: int = CACHE_WORDS):
        self.net, self.capacity = net, capacity
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.sums = np.zeros((1 << 12, len(self.net.languages) + 1), np.float32)  # and the number of positions

    def _add(self, words: list[str]) -> None:
        base = len(self.index)
        while base + len(words) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        parts: list[bytes] = []
        owner: list[int] = []
        for k, word in enumerate(words):
            self.index[word] = base + k
            if _LETTER.search(word):
                cut = stretches(word)
                parts += cut
                owner += [base + k] * len(cut)
        owners, lengths = np.array(owner, np.int64), np.array([len(p) for p in parts], np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            for lo in range(0, len(at), 8192):
                some = at[lo:lo + 8192]
                seq = np.frombuffer(b"".join(parts[i] for i in some), np.uint8).reshape(len(some), n).T
                probs = self.net.positions(np.ascontiguousarray(seq)).sum(0)
                np.add.at(self.sums, owners[some], np.concatenate([probs, np.full((len(some), 1), n, np.float32)], 1))

    def documents(self, texts: list[str]) -> np.ndarray:
        """Per text, the mean distribution over its positions (zeros: none)."""
        if len(self.index) > self.capacity:
            self._reset()
        flat: list[str] = []
        ends = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            flat += text.lower().split()
            ends[i] = len(flat)
        at = list(map(self.index.get, flat))
        if None in at:
            self._add(list(dict.fromkeys(w for w, p in zip(flat, at, strict=True) if p is None)))
            at = list(map(self.index.get, flat))
        places = np.array(at, np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], ends])))
        cols = [np.bincount(owner, self.sums[places, k], len(texts)) for k in range(self.sums.shape[1])]
        return np.stack(cols[:-1], 1) / np.maximum(cols[-1], 1)[:, None]


# -- Spark ----------------------------------------------------------------------

def _drawn_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, words = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = [w for w in text.lower().split() if _LETTER.search(w)]
            step = max(1, -(-len(found) // WORDS_PER_DOC))
            for word in found[::step]:
                for part in stretches(word):
                    langs.append(lang)
                    words.append(part)
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary())], ["lang", "word"])


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, training_words: int = TRAINING_WORDS) -> Network | None:
    """A network from ``labelled`` (doc_id, text, lang).  Words come from about
    ``docs_per_language`` documents of each language, chosen by a hash of the
    id; the driver gets at most that many documents' drawn words."""
    ship_package(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count(F.lit(1))).collect()}  # one row per language
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, docs_per_language / counts[k])))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    drawn = rows.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")
    table = drawn.mapInArrow(_drawn_words, "lang string, word binary").toArrow()
    if table.num_rows == 0:
        return None
    pairs = sorted(zip(table.column("lang").to_pylist(), table.column("word").to_pylist(), strict=True))
    rng = np.random.default_rng(11)
    by_language: dict[str, list[bytes]] = {k: [] for k in languages}
    for lang, word in pairs:
        by_language[lang].append(word)
    words, labels = [], []
    each = max(1, training_words // len(languages))
    for k, lang in enumerate(languages):  # the same weight for every language
        own = by_language[lang]
        if own:
            words += [own[i] for i in rng.integers(0, len(own), each)] if len(own) > each else own * max(1, min(50, each // len(own)))
            labels += [k] * (len(words) - len(labels))
    return train(words, np.array(labels), languages)


def label_rows(docs: DataFrame, net: Network | None, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and two more, named by ``pred`` and ``score``."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = WordLabels(shared.value) if shared.value else None
        for batch in batches:
            for part in text_batches(batch, 4 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if labels:
                    dist = labels.documents(texts)
                    best = dist.argmax(1)
                    for i in np.flatnonzero(dist.sum(1) > 0):
                        langs[i] = labels.net.languages[best[i]]
                        scores[i] = min(1.0, float(dist[i, best[i]]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                                 [*part.schema.names, pred, score])

    schema = StructType([*docs.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())])
    return docs.mapInArrow(releasing(run), schema)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score, with every other column of ``docs`` dropped."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return label_rows(plain, net).select("doc_id", "lang_pred", "score")


def keep_identified(docs: DataFrame, over_chance: float = 1.2) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and a language with a mean
    position probability of ``over_chance`` times chance (one over the number
    of languages) or more, at most one half; columns as they are.  Where no
    network can be fitted, as no row has a language, all texts with a letter
    stay."""
    fresh = lambda name: name if name.lower() not in {c.lower() for c in docs.columns} else fresh("_" + name)
    pred, score = fresh("lang_pred"), fresh("lang_score")
    net = fit(training_rows(docs))
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    labelled = label_rows(docs, net, pred, score)
    return labelled.where((F.col(pred) != UNKNOWN) & (F.col(score) >= min(0.5, over_chance / len(net.languages)))).drop(pred, score)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that a network may learn from: ids whose crc32 is not 1 modulo 3."""
    return docs.select("doc_id", "text", "lang").where(crc_fold("doc_id", 3) != 1)


def fit_and_identify(docs: DataFrame) -> DataFrame:
    """Learn from the training rows of ``docs`` and label all of its rows."""
    out = identify(docs, fit(training_rows(docs)))
    return out.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
