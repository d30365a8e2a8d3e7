"""Hard negatives by pruned inner-product search, in the manner of LEMP.

All rows are ordered by vector length and dealt into *length buckets* of at most ``BUCKET_ROWS`` neighbours.  A bucket keeps, for every
coordinate, the list of its unit vectors' values in ascending order.  A query asks for the ``k`` best rows whose score lies in
``[low, high]``, among the rows of its own label or of all others.  With the bucket's shortest and longest vector these bounds become
bounds of the angle; where the angle cannot be met the bucket is left out.  Otherwise the angle's range gives a feasible range of values
on each of the ``FOCUS`` coordinates that weigh most in the query; binary search cuts it out of the sorted list, the candidate sets are
intersected, and what is left is multiplied out exactly.  Pruning only ever leaves out rows that cannot count; the answer is exact.

Bounds start from a pilot, the ``PILOT`` rows with the smallest hash of their id: the k-th best score there is one that the answer
reaches for certain.  Each task raises them as it goes.

Anchors come in blocks of bounded size, one pass over the index each; of a task at most k rows per query leave it, and the best of all
tasks are taken in two steps, so no task sees more than its share of one query.

Defined results: rows with a null id, label, vector or component, or with a component that is not finite, take no part; a shorter vector
counts as filled up with zeros, an empty one scores 0 with all; rows repeated under one id are rows of their own, but not "other" rows for an
anchor of that id, and a repeated anchor repeats its answers; equal scores go by the smaller id; a positive below 0 has no negatives;
scores beyond 64 bits are held at the end of their range; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.topk import SCHEMA, Best, best_of_tasks
from tidemark.session import materialise, shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSITIVES, NEGATIVES = 5, 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
BUCKET_ROWS = 2048
#: Values of one bucket, for vectors of many components.
BUCKET_VALUES = 1 << 22
FOCUS = 4
PILOT = 4096
#: Anchors, and values of their vectors, that travel to the tasks at a time.
BLOCK_ANCHORS = 4096
BLOCK_VALUES = 1 << 22
#: Widens every range by far more than rounding can take from it.
SLACK = 1e-6
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
LEAST, MOST = -(2**63), 2**63 - 1
_EXACT = float(2**53)


class Queries:
    """Vectors with a label and bounds of the score."""

    def __init__(self, ids, labels, vectors: list[np.ndarray], low, high, same: bool, k: int):
        self.ids, self.labels, self.vectors = np.asarray(ids, np.int64), np.asarray(labels, np.int64), vectors
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)
        self.same, self.k = same, k
        with np.errstate(over="ignore", invalid="ignore"):
            self.norms = np.array([np.sqrt(v @ v) for v in vectors], float)
        self.peaks = [float(np.abs(v).max()) if len(v) else 0.0 for v in vectors]
        self.focus = [np.argsort(-np.abs(v), kind="stable")[:FOCUS] for v in vectors]

    def __len__(self) -> int:
        return len(self.vectors)


class Bucket:
    """Rows of similar length with a sorted list per coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        with np.errstate(all="ignore"):
            norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            self.unit = np.nan_to_num(vectors / norms[:, None])
        self.least, self.most = float(norms.min()), float(norms.max())
        self.peak = float(np.abs(vectors).max()) if vectors.size else 0.0
        self.order = np.argsort(self.unit, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(self.unit, self.order.T, 0).T.copy()

    def angles(self, queries: Queries, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest angle to a row of the bucket at which the score can lie between the bounds; crossed if it cannot."""
        low, high, norms = least.astype(float), queries.high.astype(float), queries.norms
        with np.errstate(all="ignore"):
            least = np.where(low > 0, low / (norms * self.most), low / (norms * self.least))
            most = np.where(high > 0, high / (norms * self.least), high / (norms * self.most))
        apart = (least > 1 + SLACK) | (most < -1 - SLACK) | (low > high)
        nearest, farthest = np.arccos(np.clip(most, -1, 1)) - SLACK, np.arccos(np.clip(least, -1, 1)) + SLACK
        flat = ~(norms > 0) | (self.least == 0)  # zero vectors have no angle
        nearest, farthest = np.where(flat, 0, nearest), np.where(flat, np.pi, farthest)
        apart = np.where(flat, low > high, apart)
        return np.where(apart, 1.0, nearest), np.where(apart, 0.0, farthest)

    def candidates(self, queries: Queries, q: int, nearest: float, farthest: float) -> np.ndarray:
        """Rows whose values on the query's focus coordinates are feasible at an angle of that range."""
        width, ranges = self.vectors.shape[1], []
        if queries.norms[q] > 0 and self.least > 0:
            for f in queries.focus[q]:
                if f >= width:
                    continue
                own = np.arccos(np.clip(queries.vectors[q][f] / queries.norms[q], -1, 1))
                low = -1.0 if own + nearest <= np.pi <= own + farthest else min(np.cos(own + nearest), np.cos(own + farthest))
                high = 1.0 if nearest <= own <= farthest else max(np.cos(own - nearest), np.cos(own - farthest))
                low, high = low - SLACK, high + SLACK
                a, b = np.searchsorted(self.sorted[f], [low, high])
                ranges.append((b - a, f, a, b, low, high))
        if not ranges:
            return np.arange(len(self.ids))
        ranges.sort()
        _, f, a, b, _, _ = ranges[0]
        rows = self.order[f][a:b]
        for _, f, _, _, low, high in ranges[1:]:
            values = self.unit[rows, f]
            rows = rows[(values >= low) & (values <= high)]
        return rows

    def scores(self, queries: Queries, q: int, rows: np.ndarray) -> np.ndarray:
        """Exact integer products: in doubles while no partial sum reaches 2^53, else in whole numbers of any size."""
        vector = queries.vectors[q]
        width = min(len(vector), self.vectors.shape[1])
        if self.peak * queries.peaks[q] * width < _EXACT:
            return (self.vectors[rows, :width] @ vector[:width]).astype(np.int64)
        whole = [int(x) for x in vector[:width]]
        sums = (sum(int(x) * y for x, y in zip(row, whole)) for row in self.vectors[rows, :width])
        return np.array([min(max(s, LEAST), MOST) for s in sums], np.int64)

    def search(self, queries: Queries, best: Best) -> None:
        nearest, farthest = self.angles(queries, best.least)
        tame = self.peak < 2.0**400
        for q in range(len(queries)):
            if tame and queries.peaks[q] < 2.0**400:
                if nearest[q] > farthest[q]:
                    continue
                rows = self.candidates(queries, q, nearest[q], farthest[q])
            else:
                rows = np.arange(len(self.ids))
            if queries.same:
                rows = rows[(self.labels[rows] == queries.labels[q]) & (self.ids[rows] != queries.ids[q])]
            else:
                rows = rows[self.labels[rows] != queries.labels[q]]
            if not len(rows):
                continue
            scores = self.scores(queries, q, rows)
            fits = (scores >= best.least[q]) & (scores <= queries.high[q])
            if fits.any():
                best.offer(q, scores[fits], self.ids[rows[fits]])


def _vectors(column: pa.Array) -> list[np.ndarray]:
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(ends) else []


def _buckets(batch: pa.RecordBatch) -> Iterator[Bucket]:
    """(id, label, vector) rows in slices of bounded size; shorter vectors are filled up with zeros."""
    ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    vectors, start, width = _vectors(batch.column(2)), 0, 0
    for i in range(len(ids) + 1):
        wider = max(width, len(vectors[i])) if i < len(ids) else width
        if i == len(ids) or i - start >= BUCKET_ROWS or (i > start and wider * (i + 1 - start) > BUCKET_VALUES):
            if i > start:
                matrix = np.zeros((i - start, width))
                for k in range(start, i):
                    matrix[k - start, : len(vectors[k])] = vectors[k]
                yield Bucket(ids[start:i], labels[start:i], matrix)
            start, wider = i, len(vectors[i]) if i < len(ids) else 0
        width = wider


def best_rows(index: DataFrame, box, k: int) -> DataFrame:
    """(query, score, id, rank) of the k best rows of each query in the broadcast ``box``; ``index`` has (id, label, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = box.value
        best = Best(queries.low, k)
        for batch in batches:
            for bucket in _buckets(batch):
                bucket.search(queries, best)
        yield best.batch()

    return best_of_tasks(index.select("id", "label", "vector").mapInArrow(run, SCHEMA), k)


def _answers(index: DataFrame, pilot: DataFrame, queries: Queries) -> DataFrame:
    """Best rows of the index, stored; bounds come from the pilot first."""
    sc = index.sparkSession.sparkContext
    box = sc.broadcast(queries)
    for r in best_rows(pilot, box, queries.k).where(F.col("rank") == queries.k).collect():
        queries.low[r["query"]] = max(queries.low[r["query"]], r["score"])
    box.destroy()
    box = sc.broadcast(queries)
    found = materialise(best_rows(index, box, queries.k), "negatives-best")
    box.destroy()
    return found


def integral(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component x, as doubles that hold whole numbers."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(scale)
        return F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    def good(x: Column) -> Column:
        return F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))

    return vector.isNotNull() & F.forall(vector, good)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT,
         high_percent: int = HIGH_PERCENT, pilot_rows: int = PILOT, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows of (id, label, vector).

    Negatives of a positive are rows of other labels that score between ``low_percent`` and ``high_percent`` of it.
    """
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull())
    rows = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>"), is_anchor.alias("anchor"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    index = materialise(rows.withColumn("length", length).repartitionByRange("length", "id").sortWithinPartitions("length"), "negatives-index")
    pilot = materialise(index.orderBy(F.xxhash64("id"), "id").limit(pilot_rows), "negatives-pilot")
    anchors = index.where("anchor").groupBy("id", "label", "vector").agg(F.count(F.lit(1)).alias("times"))
    anchors = materialise(anchors, "negatives-anchors")
    size = anchors.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vector")).alias("values")).first()
    n_blocks = max(1, -(-size["n"] // block_anchors), -(-(size["values"] or 0) // BLOCK_VALUES))
    block = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(n_blocks))
    path = shared_dir(rows.sparkSession, "negatives")
    for b in range(n_blocks):
        hits = _mine_block(index, pilot, anchors.where(block == b).toArrow(), positives, negatives, low_percent, high_percent)
        hits.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(RESULT).parquet(path)


def _mine_block(index: DataFrame, pilot: DataFrame, anchors: pa.Table, positives: int, negatives: int, low_percent: int,
                high_percent: int) -> DataFrame:
    spark = index.sparkSession
    ids, labels, times = (anchors.column(c).to_pylist() for c in ("id", "label", "times"))
    vectors = _vectors(anchors.column("vector").combine_chunks())
    every = len(ids)
    found = _answers(index, pilot, Queries(ids, labels, vectors, [LEAST] * every, [MOST] * every, True, positives))
    asked = sorted({(r["query"], r["score"]) for r in found.where("score >= 0").select("query", "score").collect()})
    who = [a for a, _ in asked]
    seek = Queries(
        [ids[a] for a in who], [labels[a] for a in who], [vectors[a] for a in who],
        [-(-low_percent * s // 100) for _, s in asked], [high_percent * s // 100 for _, s in asked], False, negatives,
    )
    wanted = _answers(index, pilot, seek)
    asked_rows = spark.createDataFrame([(q, a, s) for q, (a, s) in enumerate(asked)], "query int, anchor int, positive_score long")
    named = spark.createDataFrame([(a, i, t) for a, (i, t) in enumerate(zip(ids, times))], "anchor int, anchor_id long, times long")
    hits = found.select(F.col("query").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    hits = hits.join(named, "anchor").join(asked_rows, ["anchor", "positive_score"])
    hits = hits.join(wanted.select("query", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "query")
    hits = hits.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return hits.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def report(embeddings: DataFrame) -> DataFrame:
    """Anchors: ids divisible by 100.  Labels of ids divisible by 7 are moved on by one, scores are products of floor(256 * x)."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.where(usable(F.col("embedding"))).select(
        F.col("vec_id").alias("id"), moved.alias("label"), integral(F.col("embedding"), 256.0).alias("vector")
    )
    return mine(rows, F.col("id") % 100 == 0)
