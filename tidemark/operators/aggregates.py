"""Aggregations, distinct and pick-one-per-key.

Picks are aggregates (``max_by`` / ``min_by``), which combine before the shuffle: a key that holds a
third of all rows costs one partial row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def earliest(table: DataFrame, keys: Sequence[str], stamp: str, name: str) -> DataFrame:
    return table.groupBy(*keys).agg(F.min(stamp).alias(name))


def bounds(table: DataFrame, stamp: str, predicate: Column | None = None) -> DataFrame:
    rows = table if predicate is None else table.where(predicate)
    return rows.agg(F.min(stamp).alias(f"min_{stamp}"), F.max(stamp).alias(f"max_{stamp}"))


def distinct_keys(table: DataFrame, *keys: str) -> DataFrame:
    return table.select(*keys).distinct()


def repeated(table: DataFrame, *keys: str) -> DataFrame:
    """Keys occurring more than once, with their count."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def pick_max(table: DataFrame, keys: Sequence[str], measure: str | Column, arrival: str) -> DataFrame:
    """The row with the largest measure per key; the first to arrive wins ties."""
    value = F.col(measure) if isinstance(measure, str) else measure
    rest = [x for x in table.columns if x not in keys]
    best = F.max_by(F.struct(*rest), F.struct(value.alias("m"), (-F.col(arrival)).alias("a")))
    return table.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def pick_first(table: DataFrame, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """The first row per key in ``order``."""
    order = [order] if isinstance(order, str) else list(order)
    rest = [x for x in table.columns if x not in keys]
    return (
        table.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def value_lists(table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sorted distinct values per key.

    Meant for values from a short fixed list (report types, table names): the list of a key is
    bounded by that list however many rows the key has.
    """
    return table.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("values"))


def flag_sum(table: DataFrame, flag: Column, *keys: str) -> DataFrame:
    grouped = table.groupBy(*keys) if keys else table.groupBy()
    return grouped.agg(F.count_if(flag).alias("flagged"), F.count(F.lit(1)).alias("total"))


def invert_lists(table: DataFrame, label: str, members: str, order: str) -> DataFrame:
    """(label, list of members) to (member, label); the later list wins."""
    flat = table.select(order, label, F.explode(members).alias("member"))
    return flat.groupBy("member").agg(F.max_by(label, order).alias(label))


def dedupe(table: DataFrame) -> DataFrame:
    return table.distinct()


def code_points(text: str | Column) -> Column:
    """Characters of a text, one array element per code point ('' for an empty text)."""
    return F.split(text, "")


def char_vocabulary(table: DataFrame, text: str = "text") -> DataFrame:
    """Distinct characters with dense ids in code-point order.

    Each text is reduced to its distinct characters before the shuffle.  The vocabulary is bounded
    by the number of code points, which is why a single ordered pass may number it.
    """
    from pyspark.sql import Window

    chars = table.select(F.explode(F.array_distinct(code_points(text))).alias("ch")).where(F.col("ch") != "").distinct()
    point = F.ascii("ch")
    return chars.select("ch", (F.row_number().over(Window.orderBy(point)) - 1).cast("bigint").alias("char_id"))


def column_widths(table: DataFrame, columns: Sequence[str], margin: int, low: int, high: int) -> DataFrame:
    """Printed width per column: longest value plus margin, clamped to [low, high]."""
    longest = table.agg(*[F.max(F.length(F.col(c).cast("string"))).cast("bigint").alias(c) for c in columns])
    cells = longest.unpivot([], list(columns), "column_name", "longest")
    width = F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce("longest", F.lit(0)) + margin))
    return cells.select("column_name", width.cast("bigint").alias("width"))


def evaluate(
    scored: DataFrame, outputs: Sequence[tuple[str, str]], weights: Sequence[float], predicted: str, actual: str
) -> DataFrame:
    """Mean squared error per output, their weighted sum, and the share of rows with the right class.

    All of it comes out of one pass over the scored rows.
    """

    def error(p: str, y: str) -> Column:
        gap = F.col(p).cast("double") - F.col(y).cast("double")
        return F.avg(gap * gap)

    errors = [error(p, y).alias(f"mse_{i}") for i, (p, y) in enumerate(outputs)]
    hits = F.count_if(F.col(predicted).eqNullSafe(F.col(actual))) / F.count(F.lit(1))
    out = scored.agg(*errors, hits.alias("accuracy"), F.count(F.lit(1)).alias("n"))
    total = sum((F.col(f"mse_{i}") * F.lit(w) for i, w in enumerate(weights)), F.lit(0.0))
    return out.withColumn("loss", total)


def perplexity(scored: DataFrame, probability: str, *keys: str) -> DataFrame:
    """exp of the mean negative log probability."""
    grouped = scored.groupBy(*keys) if keys else scored.groupBy()
    return grouped.agg(F.exp(F.avg(-F.log(probability))).alias("perplexity"))


def weighted_perplexity(counts: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Perplexity of a frequency model per key, from counts per symbol.

    With n symbols and total t it is exp(Σ n·−ln(n/t) / t) = exp(ln t − Σ n·ln n / t), so one
    aggregate over the counts is enough and no total has to be joined back.
    """
    n = F.col(weight)
    return counts.groupBy(*keys).agg(
        F.exp(F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)).alias("perplexity")
    )
