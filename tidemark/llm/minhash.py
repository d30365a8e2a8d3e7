"""Near duplicates by SetSketch: exponentially spaced truncated minima, banded, estimated jointly by likelihood, verified on full sets.

A document is the set of its 5-word shingles.  Register i of its sketch is ``floor(1 - log_b(min over the set of an exponential))``, cut to
0 .. q + 1: mergeable (the larger register wins) and equal in two sketches about as often as the sets are alike.

1. Documents of equal words form a class; one sketch stands for it.
2. Registers are banded; classes that share a band share a bucket.  In buckets of up to ``ALL_PAIRS`` classes every pair is a candidate.  In
   larger ones the classes meet pivots: that with the most copies, the first, a random one, and then, ``ROUNDS`` times, the one with the
   highest estimates so far, the middle of the bucket.  Pairs off the middle share buckets of their own, those of what they have in common.
3. The likelihood of the registers above, below and equal, given both set sizes, is maximised over the similarity; pairs estimated from
   ``least_estimate`` on (4.7 standard deviations below the threshold) stay.
4. These are confirmed on the full sets, and linked classes are joined to components.
5. Pivots can miss a pair whose common bands are all in large buckets.  Classes of such buckets that are not yet in one component are
   compared by their rarest shingles: two linked sets share one among the first few of both, and what a template gives to all of its
   documents is not among them.

No bucket, class or component is gathered in one task or in the driver.  Intermediate tables are written to the shared folder.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; fewer than five words are one shingle; rows
with one id are one document, their rows are linked; a row without id takes no part (its component is null, it is kept); other columns
are carried by ``drop_near_duplicates`` and ignored otherwise; an empty table stays empty.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import filters
from tidemark.llm.components import components
from tidemark.session import materialise

# The functions of this module travel with the task, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
PERCENT = 85
REGISTERS = 125
#: Bands are as wide as the chance allows that a pair at the threshold meets in none.
MISSED = 1e-6
BASE, RATE, LIMIT = 1.001, 20.0, 65534
ALL_PAIRS = 16
ROUNDS = 2
DEVIATIONS = 4.7
CHUNK = 1 << 17
KNOWN_WORDS = 1 << 16
#: Of the filter that keeps texts without a candidate from being shuffled; 2^22 bits are half a megabyte.
FILTER_BITS = 1 << 22
#: Of the filter over rare shingles, and how many counters tell rare shingles from common ones; sharing a counter costs time, not results.
RARE_BITS = 1 << 24
COUNTERS = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None, width: int = SHINGLE) -> set[bytes]:
    w = words_of(text)
    return {b" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


class _Numbers(dict):
    """64-bit hashes of words; starts anew when full, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _constants() -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64)
    c = _mixed(n * np.uint64(0x9E3779B97F4A7C15))
    return c[:REGISTERS], c[REGISTERS:] | np.uint64(1)


def hashed_shingles(words: list[bytes], known: _Numbers, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles, repeats included; a text of fewer words is one shingle."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        h = np.concatenate([h, np.full(width - len(h), len(h), np.uint64)]) if len(h) else h
    if not len(h):
        return h
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = _mixed(out + h[k:k + n])
    return out


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Least 32-bit hash per register and set; ``starts`` are where the sets begin in ``values``."""
    xor, times = _constants()
    out = np.empty((len(starts), REGISTERS), np.uint32)
    for i in range(REGISTERS):
        v = (((values ^ xor[i]) * times[i]) >> np.uint64(32)).astype(np.uint32)
        out[:, i] = np.minimum.reduceat(v, starts)
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """Minima of uniforms as truncated, exponentially spaced minima of exponentials."""
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def per_band(percent: int = PERCENT) -> int:
    """Registers of a band: the most with which a pair at ``percent`` is missed with a chance of ``MISSED`` at most."""
    fits = [k for k in range(1, REGISTERS + 1) if (1 - (percent / 100) ** k) ** (REGISTERS // k) <= MISSED]
    return max(fits, default=1)


def least_estimate(percent: int = PERCENT) -> float:
    """The cut of the estimates, ``DEVIATIONS`` standard deviations of a share of equal registers below the threshold."""
    j = percent / 100
    return max(0.0, j - DEVIATIONS * (j * (1 - j) / REGISTERS) ** 0.5)


def band_keys(sketches: np.ndarray, width: int) -> np.ndarray:
    bands = REGISTERS // width
    out = np.zeros((len(sketches), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(width):
        out = _mixed(out + sketches[:, k:bands * width:width].astype(np.uint64))
    return out.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Similarity of the highest likelihood, from the registers above, below and equal and the known set sizes."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = REGISTERS - above - below
    u = size_a / (size_a + size_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    share = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, where = np.full(len(u), -np.inf), np.zeros(len(u))
    for step in np.linspace(0, 1, 101):
        j = top * step
        p, q = share(u - v * j), share(v - u * j)
        value = above * np.log(p) + below * np.log(q) + equal * np.log(np.clip(1 - p - q, 1e-9, 1))
        better = value > best
        best, where = np.where(better, value, best), np.where(better, j, where)
    return where


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: ``id``, ``n_shingles``, ``key`` of its words, ``sketch`` and ``bands``; the last three null for an empty set."""
    width = per_band(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Numbers()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                begin, total, sets, sizes, keys = at, 0, [], [], []
                while at < len(texts) and total < CHUNK:
                    words = words_of(texts[at].as_py())
                    at += 1
                    h = hashed_shingles(words, known)
                    sizes.append(len(np.unique(h)))
                    keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                    if words:
                        sets.append(h)
                        total += len(h)
                full = np.array([k is not None for k in keys], bool)
                rows = [None] * len(keys)
                bands: list = [None] * len(keys)
                if sets:
                    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
                    found = registers(minima(np.concatenate(sets), starts))
                    for i, r, b in zip(np.flatnonzero(full), found, band_keys(found, width)):
                        rows[i], bands[i] = r.tobytes(), b
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, len(keys)), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64()))],
                    ["id", "n_shingles", "key", "sketch", "bands"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, key binary, sketch binary, bands array<long>")


def _pairs(x: str, y: str) -> list:
    return [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(x, y) with ``estimate``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                side = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                j = estimate(side(2), side(4), batch.column(3).to_numpy(), batch.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(j)], ["x", "y", "estimate"])

    of = lambda end: classes.select(F.col("rep").alias(end), F.col("sketch").alias(f"s{end}"), F.col("n_shingles").alias(f"n{end}"))
    rows = pairs.join(of("x"), "x").join(of("y"), "y").select("x", "y", "sx", "nx", "sy", "ny")
    return rows.mapInArrow(run, "x long, y long, estimate double")


def candidates(classes: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Pairs (x, y) of classes with their estimates, each pair once; and (band, rep) of the large buckets."""
    rows = classes.select("rep", "copies", F.explode("bands").alias("band"))
    order = F.struct(F.col("copies"), -F.col("rep"))
    buckets = rows.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min("rep").alias("p1"), F.max_by("rep", order).alias("p2"), F.min_by("rep", F.xxhash64("rep", F.lit(1))).alias("p3"),
    ).where("n > 1")
    members = materialise(rows.select("band", "rep").join(buckets, "band"), "buckets")
    small = members.where(F.col("n") <= ALL_PAIRS).select("band", "rep")
    close = small.join(small.select("band", F.col("rep").alias("other")), "band").where("rep < other").select(F.col("rep").alias("x"), F.col("other").alias("y"))
    hot = members.where(F.col("n") > ALL_PAIRS)
    met = hot.select("rep", F.explode(F.array_distinct(F.array("p1", "p2", "p3"))).alias("pivot")).where("rep <> pivot").select(*_pairs("rep", "pivot"))
    known = materialise(_estimated(close.union(met).distinct(), classes), "estimates")
    for _ in range(ROUNDS):
        both = known.select("x", "y", "estimate").union(known.select("y", "x", "estimate"))
        height = both.groupBy(F.col("x").alias("rep")).agg(F.max("estimate").alias("_top"), F.count(F.when(F.col("estimate") >= least_estimate(percent), 1)).alias("near"))
        middle = hot.select("band", "rep").join(height, "rep").groupBy("band").agg(F.max_by("rep", F.struct("near", "_top", "rep")).alias("pivot"))
        more = hot.select("band", "rep").join(middle, "band").where("rep <> pivot").select(*_pairs("rep", "pivot")).distinct()
        more = more.join(known.select("x", "y"), ["x", "y"], "left_anti")
        known = materialise(known.union(_estimated(more, classes)), "estimates")
    return known, hot.select("band", "rep")


def _set_of(text: str | None, known: _Numbers) -> np.ndarray:
    return np.unique(hashed_shingles(words_of(text), known))


def _counters(texts: DataFrame) -> np.ndarray:
    """About how many documents each shingle is in, by the counter it falls on; ``COUNTERS`` numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = _Numbers(), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(1):
                np.add.at(counts, (_set_of(text.as_py(), known) % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["at", "n"])

    found = texts.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


def _rarest(texts: DataFrame, percent: int) -> DataFrame:
    """(rep, n, keys): of each set its size and, rarest first, as many shingles as must hold one of any linked set."""
    shared = texts.sparkSession.sparkContext.broadcast(_counters(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = _Numbers(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, keys = [], []
                for text in part.column(1):
                    found = _set_of(text.as_py(), known)
                    order = np.lexsort((found, counts[(found % np.uint64(COUNTERS)).astype(np.int64)]))
                    sizes.append(len(found))
                    keys.append(found[order[:len(found) + 1 - -(-percent * len(found) // 100)]].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["rep", "n", "keys"])

    return texts.mapInArrow(run, "rep long, n long, keys array<long>")


def unmet(hot: DataFrame, links: DataFrame, known: DataFrame, texts: DataFrame, percent: int) -> DataFrame | None:
    """Pairs (x, y) of classes of large buckets that may be linked, are in different components and not ``known``; each pair once."""
    if hot.isEmpty():
        return None
    labels = components(links).withColumnRenamed("node", "rep")
    members = hot.join(labels, "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
    several = members.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("band")
    apart = materialise(members.join(several, "band").select("rep", "component").distinct(), "apart")
    table = filters.build(apart.select(F.xxhash64("rep").alias("key")), "key", FILTER_BITS)
    sets = _rarest(texts.where(filters.holds(table, F.xxhash64("rep"), FILTER_BITS)), percent)
    rare = materialise(sets.join(apart, "rep"), "rare-shingles").select("rep", "component", "n", F.posexplode("keys").alias("i", "key"))
    # x is the smaller set; i shingles of a set are rarer than the first that both hold, so what both hold is among the n - i others
    enough = lambda common, sizes: (100 + percent) * common >= percent * sizes
    first = enough(F.col("n") - F.col("i"), 2 * F.col("n"))
    keys = rare.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.bool_or(first).alias("first")).where("a < b AND first")
    table = filters.build(keys.select("key"), "key", RARE_BITS)
    rare = rare.where(filters.holds(table, F.col("key"), RARE_BITS))
    side = lambda end, of: of.select("key", *[F.col(c).alias(f"{c}{end}") for c in ("rep", "component", "n", "i")])
    sizes = F.col("nx") + F.col("ny")
    met = (
        F.expr("componentx <> componenty AND (nx < ny OR nx = ny AND repx < repy)") & (100 * F.col("nx") >= percent * F.col("ny"))
        & enough(F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")), sizes) & enough(sizes - F.col("ix") - F.col("iy"), 2 * sizes)
    )
    x, y = side("x", rare.where(first)), side("y", rare)
    pairs = x.join(y, (x["key"] == y["key"]) & met).select(*_pairs("repx", "repy")).distinct()
    return pairs.join(known.select("x", "y"), ["x", "y"], "left_anti")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets overlap by ``percent``; ``texts`` is (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, set] = (None, set())
        for batch in batches:
            good = []
            for tx, ty in zip(batch.column(2), batch.column(3)):
                text = ty.as_py()
                if text != last[0]:
                    last = (text, shingles(text))
                one, other = shingles(tx.as_py()), last[1]
                common = len(one & other)
                good.append(100 * common >= percent * (len(one) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(good, pa.bool_()))

    of = lambda end: texts.select(F.col("rep").alias(end), F.col("text").alias(f"t{end}"))
    return pairs.join(of("x"), "x").join(of("y"), "y").select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``component_id`` and ``kept``."""
    every = materialise(sketch(docs, id_col, text_col, percent), "sketches")
    classes = every.where("key IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"),
    )
    classes = materialise(classes, "classes")
    # a representative's text: among rows of one id, that of the class; rows of one id are one document, so any may speak for it
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).where("text IS NOT NULL")

    def linked(estimates: DataFrame) -> DataFrame:
        pairs = estimates.where((F.col("estimate") >= least_estimate(percent)) & (F.col("x") != F.col("y"))).select("x", "y")
        pairs = materialise(pairs, "pairs")
        needed = filters.build(pairs.select(F.explode(F.array(F.xxhash64("x"), F.xxhash64("y"))).alias("key")), "key", FILTER_BITS)
        found = confirmed(pairs, texts.where(filters.holds(needed, F.xxhash64("rep"), FILTER_BITS)), percent)
        return materialise(found.select(F.col("x").alias("u"), F.col("y").alias("v")), "confirmed")

    known, hot = candidates(classes, percent)
    links = linked(known)
    more = unmet(hot, links, known, texts, percent)
    if more is not None:
        links = links.union(linked(_estimated(more, classes)))
    # rows of one id with different words: their classes share the document
    ids = every.where("key IS NOT NULL AND id IS NOT NULL").select("id", "key").distinct()
    several = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    joined = ids.join(several, "id").join(classes.select("key", "rep"), "key").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    groups = components(links.union(joined))
    labels = classes.select("key", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    labels = labels.select("key", F.coalesce("component", "rep").alias("label"))
    out = every.select("id", "n_shingles", "key").join(labels, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("label", "id"))
    kind = docs.schema[id_col].dataType
    return out.select(
        F.col("id").cast(kind).alias(id_col), "n_shingles", component.cast(kind).alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; all columns."""
    gone = near_duplicates(docs, id_col, text_col, percent).where(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
