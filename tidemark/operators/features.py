"""Feature preparation for sequence models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import char_vocabulary, code_points
from tidemark.operators.numbering import in_ranges, with_position, with_shuffled_rank
from tidemark.session import materialise


@dataclass(frozen=True)
class ScaleRule:
    """Max-abs scaling of ``field`` per group or over the whole table.

    ``dependent`` names another field whose fitted scale is reused.
    """

    field: str
    scale: str = "group"
    dependent: str = ""


def scale(table: DataFrame, rules: Sequence[ScaleRule], group: Sequence[str]) -> DataFrame:
    """Applies scaling rules; a scale of 0 counts as 1, fields not in the table are skipped.

    Scales are fitted by aggregation (partial maxima before the shuffle) and joined back, so a
    group that holds a third of all rows never meets in one task.  Every rule is fitted on the
    unscaled values.
    """
    known = [r for r in rules if r.field in table.columns and (not r.dependent or r.dependent in table.columns)]
    fitted = {r.field: r for r in known if not r.dependent}

    def source(r: ScaleRule) -> ScaleRule:
        return fitted[r.dependent] if r.dependent else r

    grouped = sorted({source(r).field for r in known if source(r).scale == "group"})
    whole = sorted({source(r).field for r in known if source(r).scale == "whole"})
    out = table
    if grouped:
        fits = table.groupBy(*group).agg(*[F.max(F.abs(f)).alias(f"_g_{f}") for f in grouped])
        out = out.join(fits, list(group))
    for f in whole:
        out = out.withColumn(f"_w_{f}", table.agg(F.max(F.abs(f))).scalar())
    scaled = {}
    for r in known:
        s = source(r)
        fit = F.col(f"_g_{s.field}" if s.scale == "group" else f"_w_{s.field}").cast("double")
        scaled[r.field] = F.col(r.field).cast("double") / F.when(fit == 0, 1.0).otherwise(fit)
    return out.withColumns(scaled).select(*table.columns)


def one_hot(table: DataFrame, column: str, levels: Sequence[str], at: int) -> DataFrame:
    """Indicator columns of known levels, inserted at position ``at``."""
    marks = [(F.col(column) == level).cast("bigint").alias(f"{column}_{level}") for level in levels]
    names = [F.col(x) for x in table.columns]
    return table.select(*names[:at], *[F.coalesce(m, F.lit(0)).alias(f"{column}_{v}") for m, v in zip(marks, levels)], *names[at:])


def pad_sequences(
    sequences: DataFrame, number: str, batch_size: int, max_steps: int | None = None, values: str = "steps"
) -> DataFrame:
    """Sequences padded with 0 to the longest of their batch; ``max_steps``, where given, keeps only the latest steps.

    Batches are runs of ``batch_size`` sequences in order of the unique number.  True lengths stay.
    """
    if max_steps is not None:
        last = F.least(F.size(values), F.lit(max_steps))
        sequences = sequences.withColumn(values, F.slice(values, F.size(values) - last + 1, last))
    placed = with_position(sequences, number, "_pos").withColumn(
        "batch", F.floor(F.col("_pos") / batch_size)
    )
    longest = placed.groupBy("batch").agg(F.max(F.size(values)).alias("_longest"))
    return (
        placed.withColumn("length", F.size(values).cast("bigint"))
        .join(longest, "batch")
        .withColumn(values, F.concat(values, F.array_repeat(F.lit(0.0), (F.col("_longest") - F.size(values)).cast("int"))))
        .drop("_pos", "_longest")
    )


def assign_folds(table: DataFrame, number: str, folds: int, validation: int) -> DataFrame:
    """Contiguous folds of equal size in order of the unique number; the remainder is dropped.

    Only the numbers are put in order; a row finds its fold among the first numbers of the folds, without a shuffle.
    """
    order = in_ranges(table, number, F.lit(1))
    size = order.total() // folds
    firsts = order.offsets("_pos").where((F.col("_pos") % max(size, 1) == 0) & (F.col("_pos") <= size * folds)).agg(F.array_sort(F.collect_list(number)))
    fold = F.size(F.filter(F.col("_firsts"), lambda first: first <= F.col(number))) - 1
    return (
        table.withColumn("_firsts", firsts.scalar())
        .withColumn("fold", fold.cast("bigint"))
        .where((F.col("fold") < folds) & F.lit(size > 0))
        .withColumn("role", F.when(F.col("fold") == validation, "valid").otherwise("train"))
        .drop("_firsts")
    )


# ---- windows over a corpus -------------------------------------------------------------
#
# The corpus is all texts run together in id order.  It is never built: each text knows its offset
# and cuts the windows it holds itself.


def corpus(table: DataFrame, number: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """Texts with their place in the corpus (number, text, chars, offset, total); the same without the texts; the size of the corpus.

    The texts are dealt by number once, for all that is cut from them.
    """
    order = in_ranges(table, number, F.length(text))
    total = order.total()
    places = order.offsets("offset", "chars").where("chars > 0").withColumn("total", F.lit(total).cast("bigint"))
    places = materialise(places, "places")
    return table.select(number, F.col(text).alias("text")).repartition(number).join(places, number), places, total


def _lane_parts(texts: DataFrame, steps: int, lanes: int) -> DataFrame:
    """Each text's share of each lane it meets.

    A lane is an equal run of the corpus; window ``step`` of a lane covers ``steps`` characters from
    its ``step``-th multiple and the character after them.  Adds ``low`` and ``high`` (first and last
    corpus place used), ``first_step`` (first window starting in the share), ``first`` (where it
    starts), ``inside`` (windows that lie in the share completely) and ``epochs``.
    """
    size = F.floor(F.col("total") / lanes)
    end = F.col("offset") + F.col("chars") - 1
    met = F.sequence(F.floor(F.col("offset") / F.col("size")), F.least(F.floor(end / F.col("size")), F.lit(lanes - 1)))
    parts = texts.withColumn("size", size).where(F.floor(F.col("offset") / F.col("size")) < lanes).withColumn("lane", F.explode(met))
    base = F.col("lane") * F.col("size")
    parts = parts.withColumn("epochs", F.floor((F.col("size") - 1) / steps)).withColumns(
        {"low": F.greatest(F.col("offset"), base), "high": F.least(end, base + F.col("epochs") * steps)}
    )
    parts = parts.where(F.col("low") <= F.col("high")).withColumn("first_step", F.ceil((F.col("low") - base) / steps))
    parts = parts.withColumn("first", base + F.col("first_step") * steps)
    return parts.withColumn("inside", F.greatest(F.floor((F.col("high") - F.col("first")) / steps), F.lit(0)))


def _cut(start: Column, stop: Column) -> Column:
    """Characters of the text between two corpus places, both included."""
    return F.substring(F.col("text"), (start - F.col("offset") + 1).cast("int"), (stop - start + 1).cast("int"))


def corpus_windows(texts: DataFrame, steps: int, lanes: int) -> DataFrame:
    """Windows of ``steps`` + 1 characters: (lane, step, text).

    Windows inside one text are cut there, all in one pass over it.  Only the beginnings and ends
    of texts, two short pieces per text and lane, are shuffled to join windows across borders; a
    window meets at most ``steps`` + 1 texts.
    """
    parts = _lane_parts(texts, steps, lanes)
    first, inside = F.col("first"), F.col("inside")
    run = _cut(first, first + inside * steps)
    chunks = F.regexp_extract_all(run, F.lit("(?s).{1,%d}" % steps), F.lit(0))
    count = inside.cast("int")
    whole = (
        parts.where(inside > 0)
        .select("lane", "first_step", "inside", chunks.alias("chunks"))
        .select(
            "lane",
            "first_step",
            F.posexplode(
                F.zip_with(
                    F.slice("chunks", 1, count), F.slice("chunks", 2, count), lambda a, b: F.concat(a, F.substring(b, 1, 1))
                )
            ).alias("k", "text"),
        )
        .select("lane", (F.col("first_step") + F.col("k")).alias("step"), "text")
    )
    tail = first + inside * steps
    head_piece = F.when(
        F.col("first_step") > 0,
        F.struct((F.col("first_step") - 1).alias("step"), _cut(F.col("low"), F.least(first, F.col("high"))).alias("piece")),
    )
    tail_piece = F.when(
        (first <= F.col("high")) & (F.col("first_step") + inside < F.col("epochs")),
        F.struct((F.col("first_step") + inside).alias("step"), _cut(tail, F.col("high")).alias("piece")),
    )
    pieces = parts.select("lane", "offset", F.explode(F.array(head_piece, tail_piece)).alias("p")).where(F.col("p").isNotNull())
    ordered = F.sort_array(F.collect_list(F.struct("offset", "p.piece")))
    joined = pieces.groupBy("lane", F.col("p.step").alias("step")).agg(
        F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text")
    )
    return whole.unionByName(joined)


def _targets(windows: DataFrame, steps: int, *keys: str) -> DataFrame:
    return windows.select(*keys, F.substring("text", 1, steps).alias("x"), F.substring("text", 2, steps).alias("y"))


def random_windows(table: DataFrame, steps: int, batch_size: int, seed: int, number: str = "doc_id") -> DataFrame:
    """Fixed-length windows with their next-step target in seeded random batches.

    (batch, slot, x, y); windows beyond the last full batch are left out.
    """
    texts, places, total = corpus(table.select(number, "text"), number)
    # window ids follow from offsets alone: each belongs to the text its first character is in
    last = F.least(F.floor((F.col("offset") + F.col("chars") - 1) / steps), F.floor((F.col("total") - 1) / steps) - 1)
    from_, to = F.ceil(F.col("offset") / steps), last
    ids = places.where(to >= from_).select(F.explode(F.sequence(from_, to)).alias("step"))
    count = max(total - 1, 0) // steps
    ranked = with_shuffled_rank(corpus_windows(texts, steps, 1), "step", seed, keys=ids, rows=count)
    return _targets(
        ranked.withColumn("batch", F.floor(F.col("rank") / batch_size))
        .withColumn("slot", F.col("rank") % batch_size)
        .where(F.col("batch") < count // batch_size),
        steps, "batch", "slot",
    )


def consecutive_windows(table: DataFrame, steps: int, lanes: int, number: str = "doc_id") -> DataFrame:
    """Windows of ``lanes`` parallel lanes of the corpus, step after step: (step, lane, x, y)."""
    return _targets(corpus_windows(corpus(table, number)[0], steps, lanes), steps, "step", "lane")


def encode_chars(table: DataFrame, number: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts as arrays of vocabulary ids.

    The vocabulary becomes one array indexed by code point (its size is bounded by Unicode), read
    by every row as a scalar, so texts are encoded in place without a shuffle.
    """
    vocabulary = char_vocabulary(table, text).select(F.ascii("ch").alias("point"), "char_id")
    top = vocabulary.agg(F.max("point").alias("top"))
    points = top.select(F.explode(F.sequence(F.lit(0), F.coalesce("top", F.lit(0)))).alias("point"))
    entries = points.join(vocabulary, "point", "left").agg(F.array_sort(F.collect_list(F.struct("point", F.col("char_id").cast("int").alias("id")))).alias("e"))
    dense = entries.select(F.transform("e", lambda e: e["id"]).alias("ids"))
    encoded = table.select(number, text).withColumn("_ids", dense.scalar())
    ids = F.transform(F.filter(code_points(F.col(text)), lambda ch: ch != ""), lambda ch: F.element_at(F.col("_ids"), F.ascii(ch) + 1))
    return encoded.select(number, ids.alias("char_ids"))
