"""Benchmark decontamination by suffix arrays over the training texts.

The documents stay where they are: each batch of a partition is a shard.  Its words become numbers (0 for a word that no
benchmark item has, and between documents), and its suffixes are sorted by their first ``WINDOW`` words, the *suffix array*; suffixes that
meet a 0 before the shortest window cannot match and are left out of it.  Every benchmark suffix is looked up by binary search, which gives
all places of its window at once; windows that continue each other on a diagonal join to the longest verbatim matches.  Nothing is shuffled.

The benchmark is the side that travels: in blocks of ``BLOCK_BYTES`` of text, each sent to the workers by itself.  One block is one pass over
the documents; the answers of several blocks are merged per document, at most one row per block.

Defined results: a null or empty text has no words and no hits; an item without words has no window; items that stand twice count once; an
item without an id marks words but is not listed; repeated documents are answered one by one; other columns are carried or ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

# The functions of this module travel with the task, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 2 << 20
#: After lower-casing A-Z, every ASCII byte but digits and letters separates words.
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_TABLE).split()


class Benchmark:
    """A block of items: vocabulary, and its distinct windows with the places they stand at."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.ids = [item for item, _ in rows]
        texts = [words_of(text) for _, text in rows]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, t in enumerate(texts):
            numbers = [self.vocabulary[w] for w in t]
            n = min(window, len(t))
            for at in range(len(t) - n + 1 if n else 0):
                places.setdefault(tuple(numbers[at:at + n]), []).append((k, at))
        windows = list(places)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.shortest = int(self.lengths.min()) if windows else window
        keys = np.zeros((len(windows), window), ">u4")
        for i, w in enumerate(windows):
            keys[i, :len(w)] = w
        self.low = _as_keys(keys)
        past = np.arange(window) >= self.lengths[:, None]
        self.high = _as_keys(np.where(past, np.uint32(0xFFFFFFFF), keys).astype(">u4"))
        self.starts = np.cumsum([0] + [len(places[w]) for w in windows])
        flat = [p for w in windows for p in places[w]]
        self.items = np.array([k for k, _ in flat], np.int64)
        self.offsets = np.array([at for _, at in flat], np.int64)


def _as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, whose order is that of the rows."""
    rows = np.ascontiguousarray(rows)
    return rows.view(f"S{4 * rows.shape[1]}").ravel() if len(rows) else np.zeros(0, f"S{4 * rows.shape[1]}")


class Shard:
    """Documents as one run of word numbers, with its suffix array."""

    def __init__(self, texts: list[str | None], bench: Benchmark):
        lists = [words_of(t) for t in texts]
        self.n_words = np.array([len(x) for x in lists], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words + 1)])  # one 0 behind each document
        size, width = int(self.first[-1]), bench.window
        numbers = np.zeros(size + width, np.uint32)
        get = bench.vocabulary.get
        for at, words in zip(self.first, lists):
            numbers[at:at + len(words)] = np.fromiter((get(w, 0) for w in words), np.uint32, len(words))
        at = np.arange(size + width)
        after = np.minimum.accumulate(np.where(numbers == 0, at, size + width)[::-1])[::-1]
        run = after - at
        places = np.flatnonzero(run[:size] >= bench.shortest)
        grid = numbers[places[:, None] + np.arange(width)]
        grid[np.arange(width) >= run[places][:, None]] = 0
        keys = _as_keys(grid.astype(">u4"))
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = places[order], keys[order]

    def search(self, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
        """Every (place, window) at which a window of the benchmark stands."""
        left = np.searchsorted(self.keys, bench.low, "left")
        counts = np.maximum(np.searchsorted(self.keys, bench.high, "right") - left, 0)
        which = np.repeat(np.arange(len(counts)), counts)
        step = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.suffixes[left[which] + step], which


def annotate(texts: list[str | None], bench: Benchmark) -> list[tuple[int, list[tuple[int, int]], list[tuple[str | None, int, int, int]]]]:
    """Per text: its number of words, the hit stretches (start, stop), and the longest matches (item, start, start in item, words)."""
    shard = Shard(texts, bench)
    place, which = shard.search(bench)
    edge = np.zeros(int(shard.first[-1]) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + bench.lengths[which], -1)
    hit = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])
    turns = np.diff(hit)
    starts, stops = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    stretches: list[list[tuple[int, int]]] = [[] for _ in texts]
    for d, a, b in zip(np.searchsorted(shard.first, starts, "right") - 1, starts, stops):
        stretches[d].append((int(a - shard.first[d]), int(b - shard.first[d])))

    # one row for each place and each item the window stands in; neighbours on a diagonal are one match
    copies = bench.starts[which + 1] - bench.starts[which]
    row = np.repeat(np.arange(len(which)), copies)
    entry = bench.starts[which[row]] + np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
    item, inside, at, n = bench.items[entry], bench.offsets[entry], place[row], bench.lengths[which[row]]
    order = np.lexsort((at, at - inside, item))
    item, inside, at, n = item[order], inside[order], at[order], n[order]
    matches: list[list[tuple[str | None, int, int, int]]] = [[] for _ in texts]
    if len(at):
        begins = np.ones(len(at), bool)
        begins[1:] = (item[1:] != item[:-1]) | ((at - inside)[1:] != (at - inside)[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(begins)
        tail = np.append(head[1:], len(at)) - 1
        docs = np.searchsorted(shard.first, at[head], "right") - 1
        for d, h, t in zip(docs, head, tail):
            matches[d].append((bench.ids[item[h]], int(at[h] - shard.first[d]), int(inside[h]), int(at[t] - at[h] + n[t])))
    return [(int(w), s, m) for w, s, m in zip(shard.n_words, stretches, matches)]


def _shards(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with some ``SHARD_BYTES`` of text each."""
    start, size, texts = 0, 0, []
    for i, value in enumerate(batch.column(column)):
        texts.append(value.as_py())
        size += len(texts[-1] or "")
        if size >= SHARD_BYTES:
            yield batch.slice(start, i + 1 - start), texts
            start, size, texts = i + 1, 0, []
    if texts:
        yield batch.slice(start), texts


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """The benchmark as broadcast blocks of bounded text, dealt by hash; as many as its size asks for."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(Benchmark([(r["i"], r["t"]) for r in rows.where(part == k).collect()], window)) for k in range(n)]


_ANSWER = pa.schema([
    ("n_words", pa.int64()),
    ("hits", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ("matches", pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64())]))),
])
_DDL = "n_words long, hits array<struct<start:long,stop:long>>, matches array<struct<item:string,start:long,item_start:long,n_words:long>>"


def _pass(rows: DataFrame, block, kind: str) -> DataFrame:
    """(row, id, text) against one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = block.value
        for batch in batches:
            for part, texts in _shards(batch, 2):
                found = annotate(texts, bench)
                columns = [
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([[{"start": a, "stop": b} for a, b in s] for _, s, _ in found], _ANSWER.field("hits").type),
                    pa.array([[dict(zip(("item", "start", "item_start", "n_words"), m)) for m in ms] for *_, ms in found], _ANSWER.field("matches").type),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["row", "id", *_ANSWER.names])

    return rows.mapInArrow(run, f"row long, id {kind}, {_DDL}")


def _united(hits):
    """Overlapping and touching stretches joined."""

    def step(acc, x):
        last = F.element_at(acc, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        more = F.concat(acc, F.array(x))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))
        return F.when(F.size(acc) == 0, more).when(x["start"] > last["stop"], more).otherwise(joined)

    return F.aggregate(F.array_sort(hits), F.array().cast("array<struct<start:bigint,stop:bigint>>"), step)


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``n_words``, ``hits`` (stretches of hit words) and ``matches`` (the longest verbatim matches)."""
    parts = blocks(benchmark, window=window, block_bytes=block_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if len(parts) == 1:
        return _pass(rows, parts[0], kind).drop("row").withColumnRenamed("id", id_col)
    rows = materialise(rows, "decontamination")  # the row numbers have to be the same in each pass
    answers = [_pass(rows, part, kind) for part in parts]
    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)
    out = every.groupBy("row").agg(
        F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
        F.flatten(F.collect_list("matches")).alias("matches"),
    )
    return out.select(F.col("id").alias(id_col), "n_words", _united(F.col("hits")).alias("hits"), "matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents in which a window of the benchmark stands; all columns, nothing shuffled."""
    column = docs.columns.index(text_col)
    for block in blocks(benchmark, window=window, block_bytes=block_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in _shards(batch, column):
                    yield part.filter(pa.array([not hits for _, hits, _ in annotate(texts, block.value)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_matches(docs, benchmark)
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item"]), lambda i: i.isNotNull())))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["stop"] - h["start"])
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0).cast("long"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), items.alias("_items"), longest.alias("longest")).select(
        "doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest",
    )
