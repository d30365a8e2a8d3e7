"""Ranked lexical search by dense blocked matrix products.

Every item is a bag of terms.  The vocabulary of the items alone is looked for in the documents; a first pass stores, per document, its
number of terms and the counts of those it shares with the items, from which the corpus statistics are aggregated.  A second pass turns the
counts into impacts and multiplies *document tiles* (documents times terms) by *item tiles* (terms times items), dense float64 matrices.
An item tile is compact: its rows are the terms its items have and the documents at hand too.  Its rows are also cut so that for no item the
products can add up to 2^53; every partial sum is then a whole number that a double holds, in whatever order the library adds.  Tile
sums are added as 64-bit integers.  Each task keeps the best documents of each item, ties by id.

Items come in blocks of bounded text, one pair of passes each; statistics are those of all documents in every block.

Defined results: rows without an id take no part, neither documents nor items; a null or empty text has no terms, an item of that kind has no
rows; a term that stands several times in an item counts as often; documents repeated under one id are ranked one by one, items
repeated likewise; equal scores go by the smaller id; without documents or items there are no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.topk import SCHEMA, Best, best_of_tasks
from tidemark.session import materialise, shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP = 20
#: Text and number of the items of one block; what travels to the tasks at a time.
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 4096
#: Sizes of the tiles: documents, terms, items.
TILE_DOCS, TILE_TERMS, TILE_ITEMS = 1024, 4096, 64
#: A sum below this is exact in a double.
EXACT = 1 << 53
#: No impact of a term in a document reaches this.
IMPACT = 1_000_000
RESULT = "item_id long, rank int, doc_id long, score long"
#: Every ASCII byte but digits and letters separates terms; A-Z become small.
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TABLE).split()


class Tile:
    """Terms times items: ``terms`` are the numbers of its rows, ``items`` those of its columns."""

    def __init__(self, terms: list[int], items: list[int], values: dict[tuple[int, int], int]):
        self.terms, self.items = np.array(terms, np.int64), np.array(items, np.int64)
        row, column = {t: i for i, t in enumerate(terms)}, {k: i for i, k in enumerate(items)}
        self.matrix = np.zeros((len(terms), len(items)))
        for (term, item), value in values.items():
            self.matrix[row[term], column[item]] = value


def tiles_of(bags: list[dict[int, int]], weights: list[int], tile_terms: int = TILE_TERMS, tile_items: int = TILE_ITEMS,
             exact: int = EXACT) -> list[Tile]:
    """Item tiles whose sums stay below ``exact``; a count too large for that is spread over several of them."""
    tiles = []
    for first in range(0, len(bags), tile_items):
        items = list(range(first, min(first + tile_items, len(bags))))
        left: dict[int, dict[int, int]] = {}
        for k in items:
            for term, times in bags[k].items():
                if weights[term]:
                    left.setdefault(term, {})[k] = times
        room, rows, values = dict.fromkeys(items, exact - 1), [], {}
        queue = sorted(left)
        while queue:
            again = []
            for term in queue:
                cost = weights[term] * IMPACT
                if len(rows) < tile_terms and all(room[k] >= cost for k in left[term]):
                    rows.append(term)
                    for k, times in list(left[term].items()):
                        taken = min(times, room[k] // cost)
                        room[k] -= taken * cost
                        values[term, k] = taken * weights[term]
                        if taken == times:
                            del left[term][k]
                        else:
                            left[term][k] = times - taken
                if left[term]:
                    again.append(term)
            if not rows:
                raise ValueError("a term's weight leaves no exact product")
            tiles.append(Tile(rows, items, values))
            room, rows, values, queue = dict.fromkeys(items, exact - 1), [], {}, again
    return tiles


def _counts(docs: DataFrame, box) -> DataFrame:
    """(id, n, terms, counts): number of all terms, and the counts of those in the vocabulary."""
    lists = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = box.value
        for batch in batches:
            sizes, ends, terms, counts = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = terms_of(text.as_py() or b"")
                bag = Counter(words)
                found = [(numbers[w], c) for w, c in bag.items() if w in numbers]
                sizes.append(len(words))
                terms += [t for t, _ in found]
                counts += [c for _, c in found]
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            columns = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())).cast(lists) for v in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *columns], ["id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "id long, n long, terms array<int>, counts array<int>")


def _scores(batch: pa.RecordBatch, tiles: list[Tile], n_terms: int, n_items: int, documents: int, occurrences: int) -> Iterator[tuple]:
    """(item numbers, scores per document and item) of one document tile, all integers."""
    lengths = batch.column(1).to_pylist()
    scale = np.array([75 + 25 * n * documents // occurrences if n else 1 for n in lengths], np.int64)
    rows = np.repeat(np.arange(len(lengths)), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
    terms, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
    impacts = (1_000_000_000 * counts) // (1000 * counts + 12 * scale[rows])
    here = np.zeros(n_terms, bool)
    here[terms] = True
    sums: dict[int, np.ndarray] = {}
    for tile in tiles:
        shared = np.nonzero(here[tile.terms])[0]
        if not len(shared):
            continue
        place = np.full(n_terms, -1, np.int64)
        place[tile.terms[shared]] = np.arange(len(shared))
        columns = place[terms]
        inside = columns >= 0
        dense = np.zeros((len(lengths), len(shared)))
        dense[rows[inside], columns[inside]] = impacts[inside]
        product = (dense @ tile.matrix[shared]).astype(np.int64)
        first = int(tile.items[0])
        sums[first] = (tile.items, sums[first][1] + product) if first in sums else (tile.items, product)
    yield from sums.values()


def _ranked(counts: DataFrame, box, n_items: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, n_terms, documents, occurrences = box.value
        best = Best(np.ones(n_items), k)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(at, TILE_DOCS)
                ids = part.column(0).to_numpy()
                for items, scores in _scores(part, tiles, n_terms, n_items, documents, occurrences):
                    enter = scores >= best.least[items]
                    for column in np.nonzero(enter.any(axis=0))[0]:
                        rows = np.nonzero(enter[:, column])[0]
                        best.offer(int(items[column]), scores[rows, column], ids[rows])
        yield best.batch()

    return best_of_tasks(counts.where(F.size("terms") > 0).mapInArrow(run, SCHEMA), k)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _rank_block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """The best documents of one block of items, stored; ``items`` are rows of (id, text, times)."""
    spark = docs.sparkSession
    bags = [Counter(terms_of((r["text"] or "").encode())) for r in items]
    numbers = {w: i for i, w in enumerate(sorted({w for bag in bags for w in bag}))}
    vocabulary = spark.sparkContext.broadcast(numbers)
    counts = materialise(_counts(docs, vocabulary), "search-counts")
    vocabulary.destroy()
    total = counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("terms")).first()
    holding = {r["term"]: r["n"] for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = [weight(total["documents"], holding[t]) if t in holding else 0 for t in range(len(numbers))]
    tiles = tiles_of([{numbers[w]: c for w, c in bag.items()} for bag in bags], weights)
    box = spark.sparkContext.broadcast((tiles, len(numbers), total["documents"], total["terms"]))
    ranked = materialise(_ranked(counts, box, len(items), k), "search-ranked")
    box.destroy()
    named = spark.createDataFrame([(i, r["id"], r["times"]) for i, r in enumerate(items)], "query int, item_id long, times long")
    ranked = ranked.join(named, "query").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return ranked.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text",
         block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest scores above 0 for each item."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    items = items.select(F.col(item_id).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    items = materialise(items.groupBy("id", "text").agg(F.count(F.lit(1)).alias("times")), "search-items")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_blocks = max(1, -(-size["n"] // block_items), -(-(size["bytes"] or 0) // block_bytes))
    path = shared_dir(docs.sparkSession, "search")
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == b).collect()
        _rank_block(docs, block, k).write.mode("append").parquet(path)
    return docs.sparkSession.read.schema(RESULT).parquet(path)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return rank(docs, benchmark)
