"""The k best (score, id) of many queries: higher scores first, equal ones by the smaller id.

Tasks keep at most k rows per query; ties at the k-th place are settled by id before anything is left out, so the answer does not
depend on how rows were dealt.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "query int, part int, score long, id long"
PARTS = 256


class Best:
    """Best rows of each query so far; ``least[q]`` is the score from which a row can still enter."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = np.array(least, np.int64), k
        self.rows = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(len(self.least))]

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.rows[q][0], scores]), np.concatenate([self.rows[q][1], ids])
        if len(scores) > self.k:
            enough = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[enough], ids[enough]
        order = np.lexsort((ids, ~scores))[: self.k]
        self.rows[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], scores[order[-1]])

    def batch(self) -> pa.RecordBatch:
        """All rows, with a number of the task that only spreads the next step."""
        sizes = [len(s) for s, _ in self.rows]
        scores, ids = ([r[i] for r in self.rows] or [np.empty(0, np.int64)] for i in (0, 1))
        part = np.full(sum(sizes), TaskContext.get().partitionId() % PARTS)
        columns = [np.repeat(np.arange(len(sizes)), sizes), part, np.concatenate(scores), np.concatenate(ids)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["query", "part", "score", "id"])


def best_of_tasks(found: DataFrame, k: int) -> DataFrame:
    """(query, score, id, rank): first the best of some tasks each, then of all, so that no task sorts every task's rows of a query."""
    order = [F.desc("score"), F.asc("id")]
    for keys in (["query", "part"], ["query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("query", "score", "id", "rank")
