"""Quality scores by kernel ridge regression on document statistics.

Every whole text becomes a short vector of statistics (character classes,
word, line and repetition measures).  Random Fourier features of the
standardised statistics approximate a Gaussian kernel; each partition sums
its part of the normal equations, the sums meet per row of the matrix, and
the driver solves one system of fixed size.  Raw ridge scores become
probabilities by isotonic regression on a fold that the ridge did not see.

Defined cases: null and empty texts have zero statistics and are scored like
any other; with no usable label every score is 0.5; repeated rows are scored
each, repeated labels all count; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import crc_fold, cut_lineage, documents, ship_package, text_batches

#: Cosine features; the normal equations have this many rows and columns and one more.
FEATURES = 256
#: Width of the Gaussian kernel on standardised statistics.
WIDTH = 4.0
RIDGE = 1e-3
#: Steps of the grid on which calibration counts labels (rows to the driver).
GRID = 2048
FOLDS = 5
THRESHOLD = 0.3

STATISTICS = [
    "log_bytes", "log_words", "log_lines", "letters", "upper", "digits", "spaces", "high_bytes",
    "stops", "commas", "exclaims", "bars", "marks", "quotes", "other_signs", "word_bytes",
    "line_words", "distinct_words", "distinct_lines", "sign_ended", "single_words", "capital_words",
]


def _classes() -> np.ndarray:
    """Byte -> class number."""
    kind = np.full(256, 9, np.int64)          # other signs
    kind[0:33] = 3                            # spaces and controls
    kind[[*range(ord("a"), ord("z") + 1)]] = 0
    kind[[*range(ord("A"), ord("Z") + 1)]] = 1
    kind[[*range(ord("0"), ord("9") + 1)]] = 2
    kind[128:] = 4                            # part of a wider character
    kind[[ord(c) for c in ".?"]] = 5
    kind[[ord(c) for c in ",;:"]] = 6
    kind[ord("!")] = 7
    kind[ord("|")] = 8
    kind[[ord(c) for c in "#$%&*@~^+=<>_"]] = 10
    kind[[ord(c) for c in "\"'()[]{}-"]] = 11
    return kind


_CLASS = _classes()


def text_statistics(texts: list[str]) -> np.ndarray:
    """(texts, statistics) of whole texts."""
    raws = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raws], np.int64)
    data = np.frombuffer(b"".join(r + b"\n" for r in raws), np.uint8)
    owner = np.repeat(np.arange(len(raws)), sizes + 1)
    kind = _CLASS[data]
    hist = np.bincount(owner * 12 + kind, minlength=len(raws) * 12).reshape(-1, 12).astype(float)
    hist[:, 3] -= 1                           # the added line end
    space = data <= 32
    begins = ~space & np.concatenate([[True], space[:-1]])
    ends = ~space & np.concatenate([space[1:], [True]])
    words = np.bincount(owner[begins], minlength=len(raws)).astype(float)
    sign_ended = np.bincount(owner[ends & (kind >= 5)], minlength=len(raws))
    single = np.bincount(owner[begins & ends], minlength=len(raws))
    capital = np.bincount(owner[begins & (kind == 1)], minlength=len(raws))
    lines = np.array([t.count("\n") + 1 if t else 0 for t in texts], float)
    distinct_words = np.array([len(set(t.split())) for t in texts], float)
    distinct_lines = np.array([len(set(t.split("\n"))) if t else 0 for t in texts], float)
    n, w, ln = np.maximum(sizes, 1), np.maximum(words, 1), np.maximum(lines, 1)
    return np.stack([
        np.log1p(sizes), np.log1p(words), np.log1p(lines), (hist[:, 0] + hist[:, 1]) / n,
        hist[:, 1] / n, hist[:, 2] / n, hist[:, 3] / n, hist[:, 4] / n, hist[:, 5] / w, hist[:, 6] / w, hist[:, 7] / w,
        hist[:, 8] / w, hist[:, 10] / w, hist[:, 11] / w, hist[:, 9] / w, (sizes - hist[:, 3]) / w,
        np.log1p(words / ln), distinct_words / w, distinct_lines / ln, sign_ended / w, single / w, capital / w], 1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``stats``, an array of the statistics of its text."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch, 4 << 20):
                stats = text_statistics(part.column("text").to_pylist())
                offsets = pa.array(np.arange(0, stats.size + 1, stats.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(stats.ravel()))],
                                                 ["doc_id", "stats"])

    return documents(docs).mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray            # of the cosine features and the constant
    knots: np.ndarray              # raw scores of the calibration blocks
    values: np.ndarray             # their probabilities
    seed: int = 5

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        n = len(self.weights) - 1
        freq = rng.normal(0, 1 / WIDTH, (len(self.mean), n))
        phase = rng.uniform(0, 2 * np.pi, n)
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.cos(x @ freq + phase) * np.sqrt(2 / n), np.ones((len(x), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["stats"].to_numpy()) if len(frame) else np.zeros((0, len(STATISTICS)))


def pool_adjacent(x: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: mean x and value of
    every block, for increasing ``x`` with ``total`` rows and ``ones`` ones."""
    blocks: list[list[float]] = []
    for a, n, k in zip(x, total, ones, strict=True):
        blocks.append([a * n, n, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], b[:, 2] / b[:, 1]


def fit(labelled: DataFrame, features: int = FEATURES) -> Model:
    """A model from ``labelled`` (doc_id, stats, label 0/1).  Rows whose id
    falls in fold 1 calibrate, all others fit the ridge."""
    width = len(STATISTICS)
    rows = cut_lineage(labelled.where(F.col("label").isNotNull()).select(
        "stats", F.col("label").cast("int").alias("label"), (crc_fold("doc_id", FOLDS) == 1).alias("calibrates")), "quality-rows")
    col = lambda i: F.get("stats", F.lit(i))
    moments = rows.where(~F.col("calibrates")).agg(
        F.count(F.lit(1)), *[F.avg(col(i)) for i in range(width)], *[F.stddev_pop(col(i)) for i in range(width)]).first()
    nothing = Model(np.zeros(width), np.ones(width), np.zeros(features + 1), np.zeros(0), np.zeros(0))
    if not moments[0]:
        return nothing
    scale = np.array(moments[1 + width:], float)
    model = Model(np.array(moments[1:1 + width], float), np.where(scale > 1e-9, scale, 1.0), np.zeros(features + 1), np.zeros(0), np.zeros(0))

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((features + 1, features + 2))
        for frame in frames:
            phi = model.features(_matrix(frame))
            total[:, :-1] += phi.T @ phi
            total[:, -1] += phi.T @ frame["label"].to_numpy(float)
        yield pd.DataFrame({"line": np.arange(features + 1), "sums": [r.tobytes() for r in total]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(b) for b in frame["sums"])
        return pd.DataFrame({"line": frame["line"][:1], "sums": [sums.tobytes()]})

    parts = rows.where(~F.col("calibrates")).select("stats", "label").mapInPandas(equations, "line int, sums binary")
    lines = parts.groupBy("line").applyInPandas(add, "line int, sums binary").collect()  # features + 1 rows
    system = np.stack([np.frombuffer(r.sums) for r in sorted(lines, key=lambda r: r.line)])
    gram, right = system[:, :-1], system[:, -1]
    ridge = np.eye(features + 1) * RIDGE * moments[0] / features
    ridge[-1, -1] = 1e-9
    model.weights = np.linalg.solve(gram + ridge, right)

    def grid(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = model.raw(_matrix(frame))
            yield pd.DataFrame({"step": np.floor(np.clip(raw, -0.5, 1.5) * GRID).astype(np.int32), "label": frame["label"]})

    def steps(which):
        counted = (rows.where(which).select("stats", "label").mapInPandas(grid, "step int, label int")
                   .groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")))
        return sorted(tuple(r) for r in counted.collect())  # at most 2 * GRID + 1 rows

    counted = steps(F.col("calibrates")) or steps(~F.col("calibrates"))
    x, n, ones = (np.array(c, float) for c in zip(*counted, strict=True))
    model.knots, model.values = pool_adjacent((x + 0.5) / GRID, n, ones)
    return model


def score_statistics(stats: DataFrame, model: Model) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(x))], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def fit_and_score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Learn from labels outside fold 0 and score every document: doc_id,
    held_out, score, predicted."""
    stats = cut_lineage(document_statistics(docs), "quality-stats")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("label"))
    learn = stats.join(known, "doc_id").where(crc_fold("doc_id", FOLDS) != 0)
    scored = score_statistics(stats, fit(learn))
    return scored.select("doc_id", (crc_fold("doc_id", FOLDS) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
