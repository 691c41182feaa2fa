"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are dealt to shards.  In a shard every dimension has a posting list
ordered by value and cut into segments of one quantised impact.  For a query
a segment's impact is the most that one of its postings adds to the score
above the least that the dimension can give; segments of all dimensions are
processed from the highest impact down, adding each posting's own
contribution to its row's accumulator.  After each round the leaders are
scored exactly, which gives a mark for the k-th best, and there is a proof:
a row whose accumulator and what its unseen dimensions can still add lie
below the mark is out.  Processing stops when few possible members remain (or
nothing is left), and exactly those are scored again in integers.

Defined cases: a vector that is null or holds a null or non-finite component
takes no part; a query with fewer than k other rows returns them all; ties
go to the smaller vec_id; rows that repeat a query's vec_id count as its own,
and the query is the greatest of their vectors; components beyond 2^62 are
clipped to it and scores to a long; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import pieces_for, ship_package
from riskfold.llm.vectors import best, matrix, usable

SHARD_ROWS = 8192
QUERY_ROWS = 8192
MOST_TASKS = 100_000
LEVELS = 8
ROUNDS = 16
#: Possible members per wanted row at which scoring them is cheaper than going on.
ENOUGH = 16


class ImpactIndex:
    """Posting segments of one shard's integer vectors (rows, dimensions)."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        n, dims = rows.shape
        self.order = np.argsort(rows, axis=0, kind="stable").T.copy()     # (dimensions, rows)
        self.values = np.take_along_axis(rows.T, self.order, 1).astype(np.float64)
        dim, start, stop, low, high = [], [], [], [], []
        for d in range(dims):
            values = self.values[d]
            span = max(1, int(values[-1]) - int(values[0]) + 1)
            level = ((values - values[0]) * LEVELS / span).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]]))
            ends = np.concatenate([cuts[1:], [n]])
            dim.append(np.full(len(cuts), d))
            start.append(cuts)
            stop.append(ends)
            low.append(rows[self.order[d, cuts], d])
            high.append(rows[self.order[d, ends - 1], d])
        self.dim, self.start, self.stop, self.low, self.high = (np.concatenate(v) for v in (dim, start, stop, low, high))
        self.least, self.most = rows.min(0), rows.max(0)
        self.largest = max(abs(int(self.least.min())), abs(int(self.most.max())))

    def search(self, query: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, scores) of the rows that may be among the best ``k``
        without the rows ``own``; every row that ties with the k-th is there."""
        n, dims = self.rows.shape
        barred = np.zeros(n, bool)
        barred[own] = True
        members = np.flatnonzero(~barred)
        wanted = min(k, len(members))
        self.rounds = 0
        if wanted <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.largest * max(1, int(np.abs(query).max())) * dims * dims >= 1 << 50:
            return members, _clipped(self.rows[members], query)           # past exact sums of doubles and longs
        floor = np.minimum(query * self.least, query * self.most)         # least contribution of each dimension
        weight = query[self.dim]
        impact = np.maximum(weight * self.low, weight * self.high) - floor[self.dim]  # what a posting can add at most
        order = np.argsort(-impact, kind="stable")
        base = int(floor.sum())
        unit = 1 << dims.bit_length()
        held = np.zeros(n)                                                # contributions times unit, plus dimensions met
        touched = np.zeros(dims, bool)
        best = np.zeros(0, np.int64)                                      # exact scores met so far, best ``wanted``
        scored = barred.copy()
        step = -(-len(order) // ROUNDS)
        for at in range(0, len(order), step):
            self.rounds += 1
            some = order[at:at + step]
            for d, a, b in zip(self.dim[some].tolist(), self.start[some].tolist(), self.stop[some].tolist(), strict=True):
                hit = self.order[d, a:b]                                  # every row is in a dimension's list once
                held[hit] += self.values[d, a:b] * float(query[d] * unit) + float(1 - floor[d] * unit)  # the posting's own contribution
            touched[self.dim[some]] = True
            left = order[at + step:]
            ahead = np.zeros(dims, np.int64)
            np.maximum.at(ahead, self.dim[left], impact[left])           # most that an unseen posting adds
            # the leaders' exact scores are a mark that the k-th best cannot miss
            open_ = np.floor(held[members] / unit)
            met = (held[members] - open_ * unit).astype(np.int64)
            lead = members[np.argpartition(-open_, wanted - 1)[:wanted]]
            lead = lead[~scored[lead]]
            scored[lead] = True
            best = np.sort(np.concatenate([best, self.rows[lead] @ query]))[-wanted:]
            # unseen for all rows: the untouched dimensions; of the others a row lacks some, at worst those with most ahead
            worst = np.concatenate([[0], np.cumsum(-np.sort(-ahead[touched]))]) + int(ahead[~touched].sum())
            room = worst[int(touched.sum()) - met]
            if len(best) == wanted:
                members = members[open_ + room + base >= best[0]]        # the others are proven out
            if len(members) <= ENOUGH * wanted:
                break
        return members, self.rows[members] @ query


def _clipped(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Scores in integers of any size, then clipped to a long."""
    q = [int(v) for v in query]
    exact = (sum(int(a) * b for a, b in zip(row, q, strict=True)) for row in rows)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in exact], np.int64)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _answer(index: ImpactIndex, ids: np.ndarray, batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    out = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    for query_id, y in zip(batch.column("vec_id").to_pylist(), matrix(batch.column("y"), np.int64), strict=True):
        members, scores = index.search(y, k, np.flatnonzero(ids == query_id))
        first = np.lexsort((ids[members], ~scores))[:k]                   # ~ falls as the score rises, without overflow
        for column, value in zip(out, (np.full(len(first), query_id), ids[members][first], scores[first]), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], schema=_FOUND)


def _search(k: int):
    """A partition's pieces one after the other, each with its vectors before
    its queries: the vectors become an index, the queries stream through it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, index, ids, held = None, None, None, []
        for batch in batches:
            pieces, asked = batch.column("piece").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((pieces[1:] != pieces[:-1]) | (asked[1:] != asked[:-1])) + 1
            for at, stop in zip([0, *cuts], [*cuts, len(pieces)], strict=True):
                if stop == at:
                    continue
                part = batch.slice(at, stop - at)
                if pieces[at] != piece:
                    piece, index, held = pieces[at], None, []
                if not asked[at]:
                    held.append(part)
                    continue
                if index is None:
                    if not held:                                          # no vectors were dealt to this shard
                        continue
                    rows = pa.Table.from_batches(held)
                    ids, index, held = rows.column("vec_id").to_numpy(), ImpactIndex(matrix(rows.column("y"), np.int64)), [held[0].slice(0, 0)]
                yield _answer(index, ids, part, k)
    return run


def top_k(table: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows whose vec_id is divisible
    by ``every``, the ``k`` other rows of greatest integer inner product of
    floor(scale * x)."""
    ship_package(table.sparkSession)
    edge = float(1 << 62)
    rows = usable(table).select("vec_id", F.transform(
        "x", lambda v: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), v * scale))).cast("long")).alias("y"))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("y").alias("y"))
    shards = pieces_for(rows.count(), SHARD_ROWS)
    blocks = pieces_for(asked.count(), QUERY_ROWS)
    # a piece is a shard and a block of queries: a shard is copied once for every QUERY_ROWS queries
    piece = lambda shard, block: (shard * F.lit(blocks) + block).alias("piece")
    shard = F.pmod(F.xxhash64("vec_id", "y"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64(F.lit("q"), "vec_id"), F.lit(blocks)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = rows.withColumn("block", every_of(blocks)).select(piece(shard, F.col("block")), F.lit(False).alias("asked"), "vec_id", "y")
    sent = asked.withColumn("shard", every_of(shards)).select(piece(F.col("shard"), block), F.lit(True).alias("asked"), "vec_id", "y")
    found = (base.unionByName(sent).repartitionById(min(shards * blocks, MOST_TASKS), "piece")
             .sortWithinPartitions("piece", "asked").mapInArrow(_search(k), "query_id long, vec_id long, score long"))
    return best(found, k)
