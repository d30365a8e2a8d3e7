"""Exact substring dedup: every byte covered by a ``WIDTH``-byte string that also starts in a document with a smaller id goes.

Inserting one symbol of every document per round into one collection-wide transform needs as many rounds over all suffixes as the longest
document has bytes; the README says why that was given up.  What it is for, equal suffixes side by side, is reached by content instead:

1. Each window of ``WIDTH`` bytes is filed under the least hash of its ``GRAM``-byte grams, so equal windows are filed alike; neighbours
   under the same hash form a *stretch* of text.  A first pass sends only the hashes and finds those of two documents or more, as a
   filter of fixed size; it only saves work, a stretch that passes it wrongly finds no partner.
2. A second pass sends the stretches that pass to the task of their hash.  A stretch that stands as it is in a smaller document goes whole; the
   windows of the others are sorted and the least id of equal ones found.  A task holds the stretches of one hash at a time, at most
   those of ``HOT`` documents, some 100 MB.
3. Hashes in more than ``HOT`` documents are not gathered: their windows are aggregated one by one, combined before the shuffle, and
   joined back, in a join that Spark may split.
4. Covered parts meet their document, where they are united and cut out.

Defined results: a null or empty text has no bytes; texts shorter than ``WIDTH`` lose nothing; rows with one id are neither smaller nor larger
than each other; a row without an id loses nothing and takes nothing from others; other columns are not looked at.
"""

from __future__ import annotations

import gc
import sys
import time
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import filters
from tidemark.session import materialise

# The functions of this module travel with the task, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 50
GRAM = 16
HOT = 50_000
FILTER_BITS = 1 << 26
TOUCHED_BITS = 1 << 22
REPEATED_BITS = 1 << 20
SLICE = 1 << 20
STRETCH = 64
GROUP_BYTES = 8 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each position on, put together from powers of two."""
    n = len(data) - width + 1
    power, step, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if width & step:
            part = power[done:done + n]
            out = part.copy() if out is None else _mixed(out * np.uint64(0x9E3779B97F4A7C15) + part)
            done += step
        if done == width:
            return out
        power = _mixed(power[:-step] * np.uint64(0x9E3779B97F4A7C15) + power[step:])
        step *= 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each position on."""
    n, step = len(values) - width + 1, 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[:n], values[width - step:width - step + n])


def filed(data: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each stretch of windows; the last entry of the starts is the number of windows."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint64)
    starts, found = [], []
    for at in range(0, n, SLICE):
        part = np.frombuffer(data, np.uint8, min(SLICE, n - at) + width - 1, at)
        least = _least(_hashes(part, gram), width - gram + 1)
        turn = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        lengths = np.diff(np.append(turn, len(least)))
        copies = -(-lengths // STRETCH)
        first = np.repeat(turn, copies) + STRETCH * (np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies))
        starts.append(first + at)
        found.append(least[first])
    return np.append(np.concatenate(starts), n), np.concatenate(found)


def _filed_batch(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``filed`` for many texts; short ones are worked on together."""
    group: list[int] = []
    size = 0
    for i in range(len(texts) + 1):
        if group and (i == len(texts) or size + len(texts[i]) > SLICE):
            joined = b"".join(texts[k] for k in group)
            begin = np.cumsum([0] + [len(texts[k]) for k in group])
            if len(joined) >= WIDTH:
                least = _least(_hashes(np.frombuffer(joined, np.uint8), GRAM), WIDTH - GRAM + 1)
                for k, a, b in zip(group, begin, begin[1:]):
                    n = b - a - WIDTH + 1
                    if n > 0:
                        own = least[a:a + n]
                        turn = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                        lengths = np.diff(np.append(turn, n))
                        if lengths.max() > STRETCH:
                            copies = -(-lengths // STRETCH)
                            turn = np.repeat(turn, copies) + STRETCH * (np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies))
                        yield k, np.append(turn, n), own[turn]
            group, size = [], 0
        if i < len(texts):
            if len(texts[i]) > SLICE:
                yield i, *filed(texts[i])
            elif len(texts[i]) >= WIDTH:
                group.append(i)
                size += len(texts[i])


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _shared_hashes(rows: DataFrame):
    """Two filters of ``FILTER_BITS`` bits: hashes of several documents, and among them those of more than ``HOT``.

    What comes to the driver is at most ``FILTER_BITS`` / 64 pairs of numbers, whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            ids, texts = batch.column(0).to_pylist(), _bytes(batch.column(2))
            hashes, docs = [], []
            for k, _, found in _filed_batch(texts):
                found = np.unique(_short(found))
                hashes.append(found)
                docs.append(np.full(len(found), ids[k], np.int64))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(docs))], ["hash", "doc"])

    sent = rows.mapInArrow(run, "hash int, doc long")
    several = sent.groupBy("hash").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b")
    bit = F.col("hash").cast("long").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    words = several.groupBy(F.shiftrightunsigned(bit, 6).cast("int").alias("word")).agg(
        F.bit_or(one).alias("several"), F.bit_or(F.when(F.col("n") > HOT, one).otherwise(F.lit(0).cast("long"))).alias("hot")
    ).toArrow()
    out = np.zeros((2, FILTER_BITS // 64), np.uint64)
    at = words.column("word").to_numpy()
    out[0, at] = words.column("several").to_numpy().view(np.uint64)
    out[1, at] = words.column("hot").to_numpy().view(np.uint64)
    return out


def _release(rows: DataFrame) -> None:
    """Lets Spark's cleaner see that the frames of a pass are gone, so that its shuffle files go before the next ones come.

    What hands results over still holds the frame for a moment, so one collection alone frees nothing.
    """
    for _ in range(3):
        gc.collect()
        rows.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _short(hashes: np.ndarray) -> np.ndarray:
    """The part of a hash that is sent: its low bits, as the high ones of a least hash say little.  More stretches meet, and change no result."""
    return hashes.astype(np.uint32).view(np.int32)


def _long(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.uint32).astype(np.uint64)


def _passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64(FILTER_BITS - 1)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


_STRETCH = "hash int, hot boolean, doc long, mark long, at long, content binary"


def _stretches(rows: DataFrame, tables) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several, hot = shared.value
        for batch in _small(batches):
            ids, marks, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes(batch.column(2))
            out: list[list] = [[], [], [], [], [], []]
            for k, starts, found in _filed_batch(texts):
                good = np.flatnonzero(_passes(several, found))
                text = texts[k]
                begin, end = starts[good].tolist(), (starts[good + 1] + WIDTH - 1).tolist()
                out[0].append(_short(found[good]))
                out[1].append(_passes(hot, found[good]))
                out[2] += [ids[k]] * len(good)
                out[3] += [marks[k]] * len(good)
                out[4] += begin
                out[5] += [text[a:b] for a, b in zip(begin, end)]
            if out[4]:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1])), pa.array(out[2], pa.int64()),
                    pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.binary()),
                ], ["hash", "hot", "doc", "mark", "at", "content"])

    return rows.mapInArrow(run, _STRETCH)


def _windows(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each window, the row it belongs to, and its place there."""
    sizes = np.array([len(c) for c in contents], np.int64)
    hashes = _hashes(np.frombuffer(b"".join(contents), np.uint8), WIDTH)
    counts = sizes - WIDTH + 1
    row = np.repeat(np.arange(len(contents)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return hashes[np.repeat(np.cumsum(sizes) - sizes, counts) + place], row, place


def _covered(row: np.ndarray, place: np.ndarray, hit: np.ndarray, doc, mark, at) -> pa.RecordBatch:
    """Runs of covered windows of a row as byte ranges of its document."""
    row, place = row[hit], place[hit]
    begins = np.ones(len(row), bool)
    begins[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(begins)
    tail = np.append(head[1:], len(row))[:len(head)] - 1
    of = row[head]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[of]), pa.array(mark[of]), pa.array(at[of] + place[head]), pa.array(at[of] + place[tail] + WIDTH)], ["doc", "mark", "start", "stop"]
    )


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash: windows of the same content within a hash, covered where a smaller id has them too."""

    def settled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        content = rows.column("content").combine_chunks()
        key, doc, mark, at = (rows.column(c).to_numpy() for c in ("hash", "doc", "mark", "at"))
        coded = content.dictionary_encode()
        code = coded.indices.to_numpy()
        least = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(least, code, doc)
        whole = np.flatnonzero(doc > least[code])
        if len(whole):
            stop = at[whole] + pc.binary_length(content).to_numpy()[whole]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[whole], mark[whole], at[whole], stop)], ["doc", "mark", "start", "stop"])
        # the others are the first with their content; hashes that one document has alone are done
        left = np.flatnonzero(doc == least[code])
        head = np.flatnonzero(np.concatenate([[True], key[left][1:] != key[left][:-1]]))
        several = np.minimum.reduceat(doc[left], head) < np.maximum.reduceat(doc[left], head)
        left = left[np.repeat(several, np.diff(np.append(head, len(left))))]
        if len(left):
            found, row, place = _windows(content.take(pa.array(left)).to_pylist())
            found = _mixed(found ^ _long(key)[left][row])
            of = doc[left][row]
            order = np.argsort(found)
            begins = np.concatenate([[True], found[order][1:] != found[order][:-1]])
            lowest = np.minimum.reduceat(of[order], np.flatnonzero(begins))
            hit = np.zeros(len(row), bool)
            hit[order] = of[order] > lowest[np.cumsum(begins) - 1]
            yield _covered(row, place, hit, doc[left], mark[left], at[left])

    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        size += batch.nbytes
        if size >= GROUP_BYTES:
            table = pa.Table.from_batches(waiting)
            keys = table.column("hash").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last hash may go on in the next batch
            if cut:
                yield from settled(table.slice(0, cut))
            waiting = table.slice(cut).to_batches()
            size = sum(b.nbytes for b in waiting) if cut else size
    if waiting:
        yield from settled(pa.Table.from_batches(waiting))


_RANGE = "doc long, mark long, start long, stop long"


def _settle_hot(hot: DataFrame) -> DataFrame:
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 4096):
            found, row, place = _windows(batch.column(5).to_pylist())
            pick = lambda c: batch.column(c).to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_mixed(found ^ _long(pick(0))).view(np.int64)), pa.array(pick(2)), pa.array(pick(3)), pa.array(pick(4) + place)],
                ["window", "doc", "mark", "at"],
            )

    windows = hot.mapInArrow(explode, "window long, doc long, mark long, at long")
    least = windows.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    hit = windows.join(least, "window").where("doc > least")
    return hit.select("doc", "mark", F.col("at").alias("start"), (F.col("at") + WIDTH).alias("stop"))


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``doc``, ``mark`` and ``text``; the mark tells rows of one id apart by the hash of the text, and is 0 for other rows."""
    doc = F.col(id_col).cast("long")
    twice = docs.groupBy(doc.alias("doc")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("doc").alias("key"))
    table = filters.build(twice, "key", REPEATED_BITS)
    mark = F.when(filters.holds(table, F.xxhash64(doc), REPEATED_BITS), F.xxhash64(text_col)).otherwise(F.lit(0).cast("long"))
    return docs.select(F.col(id_col).alias("id"), doc.alias("doc"), mark.alias("mark"), F.col(text_col).alias("text"))


def covered(rows: DataFrame) -> DataFrame:
    """Byte ranges to remove from ``marked`` documents: ``doc``, ``mark``, ``start``, ``stop``; they may overlap."""
    rows = rows.select("doc", "mark", "text").where(F.col("doc").isNotNull() & (F.octet_length("text") >= WIDTH))
    tables = _shared_hashes(rows)
    _release(rows)
    found = _stretches(rows, tables)
    plain = found.where(~F.col("hot")) if tables[1].any() else found
    out = plain.drop("hot").repartition("hash").sortWithinPartitions("hash").mapInArrow(_settle, _RANGE)
    return out.unionByName(_settle_hot(found.where("hot"))) if tables[1].any() else out


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``spans`` (the maximal removed runs) and ``kept``, the bytes that remain."""
    rows = marked(docs, id_col, text_col)
    ranges = covered(rows).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    ranges = materialise(ranges, "covered")
    _release(docs)
    # texts that lose nothing need not meet their ranges; what the filter lets through wrongly finds none
    table = filters.build(ranges.select(F.xxhash64("doc", "mark").alias("key")), "key", TOUCHED_BITS)
    touched = F.coalesce(filters.holds(table, F.xxhash64("doc", "mark"), TOUCHED_BITS), F.lit(False))
    joined = rows.where(touched).join(ranges, ["doc", "mark"], "left").select("id", "text", "ranges")
    joined = joined.unionByName(rows.where(~touched).select("id", "text", F.lit(None).cast(ranges.schema["ranges"].dataType).alias("ranges")))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            sizes, spans, kept = [], [], []
            flat = batch.column(2).flatten()
            pairs = zip(flat.field(0).to_pylist(), flat.field(1).to_pylist())
            for data, n in zip(_bytes(batch.column(1)), pc.list_value_length(batch.column(2)).to_pylist()):
                cut = united(list(islice(pairs, n or 0)))
                at, parts = 0, []
                for a, b in cut:
                    parts.append(data[at:a])
                    at = b
                sizes.append(len(data))
                spans.append([{"start": a, "stop": b} for a, b in cut])
                kept.append(b"".join([*parts, data[at:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.mapInArrow(run, f"id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def report(docs: DataFrame) -> DataFrame:
    return remove(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
