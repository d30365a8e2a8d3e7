"""Quality rules: a log-likelihood ratio of hashed n-grams between trusted documents and the raw corpus.

Features are the words of a text and their adjacent pairs, hashed into ``buckets``.  Two multinomials are counted over
them: the *target* from the trusted documents (label ``quality`` 1 and ``toxic`` 0; at most ``labelled`` labels take part) and the *raw* one from every document.  A
document's score is the mean over its features of ``log(target / raw)``; it is kept from ``threshold`` on.  Counting is one pass
that combines before the shuffle (at most ``buckets`` rows per task), scoring reads a table of ``buckets`` numbers, the only
thing that passes through the driver; its size is a parameter and does not depend on the corpus.

The threshold is deterministic: it lies ``margin`` of the way from the mean score of trusted documents to that of documents
labelled quality 0, or, where no label names such a one, ``spread`` standard deviations below the trusted mean.

Defined results: a null or empty text has no words and fails the base rule; equal rows get equal answers; without labels nothing is
known of a target, and the base rules alone decide; other columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

SPACE = "[ \\t-\\r]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8

BUCKETS = 1 << 16
SMOOTHING = 1.0
LABELLED = 50_000
MARGIN = 1 / 3
SPREAD = 8.0


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def bind(value: Column, fn) -> Column:
    """Gives a name to a value that a lambda uses more than once: the one element of an array."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def shifted_pairs(hashes: Column, by: int) -> Column:
    """Hash of each element with the one ``by`` places later; ``by`` elements shorter than its input."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + by), n), lambda a, b: F.xxhash64(a, b))


def covered_words(windows: Column, width: int = WINDOW) -> Column:
    """Words inside windows that stand twice or more, the first occurrence included; ``windows`` has a hash per start.

    Sorted by hash, equal windows are neighbours; each start covers up to the next one, or its full width.
    """

    def starts_in(at: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            after = F.get(at, i + 1)["h"] == x["h"]
            before = F.get(at, i - 1)["h"] == x["h"]
            return F.coalesce(after, F.lit(False)) | F.coalesce(before, F.lit(False))

        return F.sort_array(F.transform(F.filter(at, twice), lambda x: x["i"]))

    def step(acc: Column, i: Column) -> Column:
        return F.struct((acc["n"] + F.least(F.lit(width), i + width - acc["end"])).alias("n"), (i + width).alias("end"))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("end"))
    return F.aggregate(bind(ordered, starts_in), nothing, step, lambda acc: acc["n"])


def with_hashes(rows: DataFrame) -> DataFrame:
    """``_text`` with ``_one`` and ``_two``, the hashes of its words and of its adjacent pairs of words."""
    rows = rows.withColumn("_one", F.transform(words_of(F.col("_text")), lambda w: F.xxhash64(w)))
    return rows.withColumn("_two", shifted_pairs(F.col("_one"), 1))


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measures(rows: DataFrame) -> DataFrame:
    """Base measures beside the hashes of ``with_hashes``.

    Eight words are hashed as four, pairs of pairs.  A window of eight that stands twice repeats five windows of four, so texts
    with fewer repeats among these, nearly all, need no windows of eight.
    """
    text, two, four = F.col("_text"), F.col("_two"), F.col("_four")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    rows = rows.withColumn("_four", shifted_pairs(two, 2)).withColumn("_lines", lines)
    repeats = F.size(four) - F.size(F.array_distinct(four)) >= WINDOW - 3
    return rows.select(
        "*",
        F.size("_one").cast("long").alias("n_words"),
        F.length(without(text, _SPACE_CHARS)).cast("long").alias("word_chars"),
        (F.octet_length(text) - F.octet_length(without(text, _SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, covered_words(shifted_pairs(four, 4))).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Model:
    """``ratios`` is a stored table of one row, whose array holds log(target / raw) of each bucket; documents scoring below ``threshold`` are
    rejected.  Without a target there is no such table."""

    buckets: int
    ratios: DataFrame | None
    threshold: float

    def scored(self, rows: DataFrame, name: str) -> DataFrame:
        """Adds the mean log ratio over the words and pairs of ``with_hashes``; 0 for a text without words."""
        if self.ratios is None:
            return rows.withColumn(name, F.lit(0.0))
        # read as a scalar, in one place: as a literal the table would fill plans and event log, used twice it would travel with the rows
        each = lambda a, h: a + F.get(F.col("_ratios"), F.pmod(h, F.lit(self.buckets)).cast("int"))
        total = F.aggregate(F.concat("_one", "_two"), F.lit(0.0), each)
        mean = F.when(F.size("_one") > 0, total / (F.size("_one") + F.size("_two"))).otherwise(F.lit(0.0))
        return rows.withColumn("_ratios", self.ratios.scalar()).withColumn(name, mean).drop("_ratios")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
        margin: float = MARGIN, spread: float = SPREAD, labelled: int = LABELLED) -> Model:
    """Raw counts over all documents, target counts and threshold from at most ``labelled`` labelled ones.

    The labels that take part, those with the smallest hash of their id, are broadcast; their number is the bound.
    """
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        (F.min(F.coalesce("quality", F.lit(0))) >= 1).alias("_good"), F.max(F.coalesce("toxic", F.lit(0))).alias("_toxic")
    ).select("_id", (F.col("_good") & (F.col("_toxic") == 0)).alias("_trusted"), (~F.col("_good")).alias("_poor"))
    marks = F.broadcast(marks.orderBy(F.xxhash64("_id"), "_id").limit(labelled))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    marked = texts.join(marks, "_id", "left")
    counts = (
        with_hashes(marked).select("_trusted", F.explode(F.concat("_one", "_two")).alias("_h"))
        .groupBy(F.pmod("_h", F.lit(buckets)).cast("int").alias("_b")).agg(F.count(F.lit(1)).alias("raw"), F.count(F.when(F.col("_trusted"), 1)).alias("target")).collect()
    )
    from math import log, sqrt

    raw, target = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r["_b"]], target[r["_b"]] = r["raw"], r["target"]
    n_raw, n_target = sum(raw), sum(target)
    if not n_target:
        return Model(buckets, None, float("-inf"))
    size = SMOOTHING * buckets
    values = [log((t + SMOOTHING) / (n_target + size)) - log((r + SMOOTHING) / (n_raw + size)) for t, r in zip(target, raw)]
    ratios = materialise(docs.sparkSession.createDataFrame([(values,)], "ratios array<double>"), "quality-ratios")
    model = Model(buckets, ratios, float("-inf"))
    scored = texts.join(marks, "_id").where((F.col("_trusted") | F.col("_poor")) & (F.col("_text") != ""))
    scored = model.scored(with_hashes(scored), "_s").select("_trusted", "_s")
    by = {r["_trusted"]: r for r in scored.groupBy("_trusted").agg(F.avg("_s").alias("mean"), F.stddev_pop("_s").alias("sd")).collect()}
    good, poor = by[True], by.get(False)
    if poor is not None and poor["mean"] < good["mean"]:
        threshold = good["mean"] - margin * (good["mean"] - poor["mean"])
    else:
        threshold = good["mean"] - spread * good["sd"]
    return Model(buckets, ratios, threshold)


def _assessed(rows: DataFrame, model: Model) -> DataFrame:
    """``_text`` and what stands beside it, with the base measures, ``_score``, ``base_failed`` and ``kept``."""
    out = model.scored(measures(with_hashes(rows)), "_score").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("_score") >= model.threshold))


def assess(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base measures, score and verdict of every document."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return _assessed(rows, model).select(F.col("_id").alias(id_col), *names, F.col("_score").alias("score"))


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents the verdict rejects; all columns as they are."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # the verdict passes through a generator, below which no filter moves: else its hashes would be made again for every use
    judged = _assessed(rows, model).select("_row", F.explode(F.array("kept")).alias("_kept"))
    return judged.where("_kept").select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return assess(docs, fit(docs, labels))
