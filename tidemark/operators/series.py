"""Window operators over price series.

A series is keyed by ``code`` and ordered by ``trade_date`` (one row per code and day, see
``Catalog.price``) or, for pivot lists, by ``pivot_seq``.  All windows here share
``partitionBy(code)`` so that a chain of them costs one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UP, DOWN = "上升", "下降"

# Fixed values of the trend job.
TREND_SETTINGS = {
    "minor_term": 14,
    "median_term": 36,
    "long_term": 400,
    "min_minor_rate": 3.0,
    "min_median_rate": 7.3,
    "min_long_rate": 60.0,
    "minor_average": 30,
    "median_average": 150,
    "long_average": 250,
    "long_horizon_days": 560,
}


def _series(order: str = "trade_date"):
    return Window.partitionBy("code").orderBy(order)


def with_record_id(prices: DataFrame) -> DataFrame:
    """Position in the series, from 0."""
    return prices.withColumn("record_id", (F.row_number().over(_series()) - 1).cast("bigint"))


def with_running_sum(prices: DataFrame, name: str = "running_sum") -> DataFrame:
    frame = _series().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return prices.withColumn(name, F.sum("close").over(frame))


def moving_averages(prices: DataFrame, terms: Mapping[str, int] | None = None) -> DataFrame:
    """Simple moving averages to 2 decimals; 0 while ``record_id`` is below the term.

    Each average is the difference of two running sums, so a row costs the same for a term of
    250 as for a term of 30 (a sliding frame would add up every row of the frame again).
    """
    terms = terms or {
        "short_ma": TREND_SETTINGS["minor_average"],
        "median_ma": TREND_SETTINGS["median_average"],
        "long_ma": TREND_SETTINGS["long_average"],
    }
    out = with_running_sum(with_record_id(prices))
    for name, term in terms.items():
        total = F.col("running_sum") - F.lag("running_sum", term).over(_series())
        out = out.withColumn(
            name,
            F.when(F.col("record_id") < term, F.lit(0))
            .otherwise(F.round(total / F.lit(term), 2))
            .cast("decimal(18,2)"),
        )
    return out


def with_oscillation(averages: DataFrame) -> DataFrame:
    """Distance of the close from its short average; 0 where that average is not defined."""
    return averages.withColumn(
        "oscillation",
        F.when(F.col("short_ma") == 0, F.lit(0)).otherwise(F.col("close") - F.col("short_ma")).cast("decimal(20,4)"),
    )


def tiny_trends(prices: DataFrame) -> DataFrame:
    """First row plus the last row of every run of rising (or flat) and falling closes.

    ``ascending`` is the direction of the run a row ends; for the first row, of the run it starts.
    """
    w = _series()
    df = with_record_id(prices)
    df = df.withColumn("step_up", F.col("close") >= F.lag("close").over(w))
    df = df.withColumn("next_up", F.lead("step_up").over(w))
    first = F.col("step_up").isNull()
    ends_run = F.col("next_up").isNull() | (F.col("next_up") != F.col("step_up"))
    single = first & F.col("next_up").isNull()
    return (
        df.where((first | ends_run) & ~single)
        .withColumn("ascending", F.when(first, F.col("next_up")).otherwise(F.col("step_up")))
        .drop("step_up", "next_up")
    )


def outgoing_direction(prices: DataFrame) -> DataFrame:
    """Series as a pivot list: ``ascending`` says whether the next close is at least this one."""
    df = with_record_id(prices)
    return df.withColumn("ascending", F.lead("close").over(_series()) >= F.col("close")).withColumn(
        "pivot_seq", F.col("record_id")
    )


def merge_trends(pivots: DataFrame, order: str = "pivot_seq") -> DataFrame:
    """Keep the first pivot, pivots whose direction differs from the previous one, and the last.

    Lists of fewer than two pivots describe no trend and vanish.
    """
    w = _series(order)
    first = F.lag(order).over(w).isNull()
    last = F.lead(order).over(w).isNull()
    changed = ~F.col("ascending").eqNullSafe(F.lag("ascending").over(w))
    return (
        pivots.select("*", first.alias("_first"), last.alias("_last"), changed.alias("_changed"))
        .where((F.col("_first") | F.col("_last") | F.col("_changed")) & ~(F.col("_first") & F.col("_last")))
        .drop("_first", "_last", "_changed")
    )


def drop_weak_pivots(pivots: DataFrame, min_rate: Column | float, order: str = "pivot_seq") -> DataFrame:
    """Keep the first and last pivot, marked extremes, and pivots followed by a large move.

    The move is the percentage change to the next pivot, rounded to two decimals; from a close of 0
    any rise is large.
    """
    limit = min_rate if isinstance(min_rate, Column) else F.lit(min_rate)
    w = _series(order)
    ahead = F.lead("close").over(w)
    rate = F.abs(F.round(F.try_divide(ahead - F.col("close"), F.col("close")) * 100, 2))
    first = F.lag(order).over(w).isNull()
    return (
        pivots.select("*", first.alias("_first"), ahead.isNull().alias("_last"), rate.alias("_rate"), ahead.alias("_ahead"))
        .where(
            (
                F.col("_first")
                | F.col("_last")
                | F.col("extreme")
                | F.coalesce(F.col("_rate") > limit.cast("decimal(18,4)"), F.col("_ahead") > 0)
            )
            & ~(F.col("_first") & F.col("_last"))
        )
        .drop("_first", "_last", "_rate", "_ahead")
    )


def override_pivots(pivots: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual extremes by (code, trade_date): ``overrides`` carries the flag that replaces ours."""
    fixes = overrides.select("code", "trade_date", F.col("extreme").alias("_fixed"))
    return (
        pivots.join(fixes, ["code", "trade_date"], "left")
        .withColumn("extreme", F.coalesce("_fixed", "extreme"))
        .drop("_fixed")
    )


def with_min_rate(series: DataFrame, parameters: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """Minimum change per (trend_name, code); codes without an own entry take the trend's default."""
    own = parameters.select("trend_name", "code", F.col("min_rate").alias("_own"))
    pairs: list[Column] = []
    for key, value in defaults.items():
        pairs += [F.lit(key), F.lit(float(value))]
    return (
        series.join(own, ["trend_name", "code"], "left")
        .withColumn("min_rate", F.coalesce("_own", F.create_map(*pairs)[F.col("trend_name")]))
        .drop("_own")
    )


def trend_segments(pivots: DataFrame, order: str = "record_id") -> DataFrame:
    """Join equal steps into segments.

    A step rises when its change, rounded to two decimals, is not negative (from a close of 0: when
    it rises at all).  The segment carries its start and end close, calendar and trading days, total
    change (unknown from 0); the last one of a series is still open (train_flag 0).  All stages reuse the distribution by ``code``.
    """
    w = _series(order)
    close = F.round("close", 4)
    prev = F.lag(close).over(w)
    step = pivots.select(
        "code",
        F.col(order).alias("_ord"),
        "record_id",
        "trade_date",
        close.alias("close"),
        prev.alias("_prev_close"),
        F.lag("trade_date").over(w).alias("_prev_date"),
        F.lag("record_id").over(w).alias("_prev_id"),
    ).where(F.col("_prev_close").isNotNull())
    change = F.round(F.try_divide(F.col("close") - F.col("_prev_close"), F.col("_prev_close")), 2)
    step = step.withColumn("_up", F.coalesce(change >= 0, F.col("close") > 0))
    w2 = Window.partitionBy("code").orderBy("_ord")
    step = step.withColumn("_turn", (~F.col("_up").eqNullSafe(F.lag("_up").over(w2))).cast("int"))
    step = step.withColumn(
        "_island", F.sum("_turn").over(w2.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    seg = step.groupBy("code", "_island").agg(
        F.min_by("_prev_date", "_ord").alias("start_date"),
        F.max_by("trade_date", "_ord").alias("end_date"),
        F.min_by("_prev_close", "_ord").alias("close"),
        F.max_by("close", "_ord").alias("end_close"),
        F.min_by("_prev_id", "_ord").alias("start_record_id"),
        F.max_by("record_id", "_ord").alias("_end_id"),
        F.first("_up").alias("_up"),
    )
    open_last = F.lead("_island").over(Window.partitionBy("code").orderBy("_island")).isNull()
    return seg.select(
        "code",
        "start_date",
        F.date_diff("end_date", "start_date").cast("bigint").alias("calendar_days"),
        "close",
        "end_close",
        F.when(open_last, 0).otherwise(1).cast("bigint").alias("train_flag"),
        "start_record_id",
        (F.col("_end_id") - F.col("start_record_id")).alias("trading_days"),
        F.round(F.try_divide(F.col("end_close") - F.col("close"), F.col("close")), 2)
        .cast("decimal(18,2)")
        .alias("change_rate"),
        F.when(F.col("_up"), UP).otherwise(DOWN).alias("direction"),
    )


def occurrence_suffix(rows: DataFrame, group: Sequence[str], label: str, order: str) -> DataFrame:
    """Second and later occurrences of a label inside its group get the suffix 1, 2, …"""
    n = F.row_number().over(Window.partitionBy(*group, label).orderBy(order))
    return rows.withColumn("_n", n).select(
        *rows.columns,
        F.when(F.col("_n") > 1, F.concat(F.col(label), (F.col("_n") - 1).cast("string")))
        .otherwise(F.col(label))
        .alias("numbered"),
    )


def next_labels(series: DataFrame, fields: Sequence[str], keep_last: bool, order: str = "trade_date") -> DataFrame:
    """Values of the following row as labels; the last row is dropped, or kept with zeros."""
    w = _series(order)
    ahead = F.lead(order).over(w)
    labels = [F.lead(f).over(w).alias(f"next_{f}") for f in fields]
    out = series.select("*", ahead.alias("_ahead"), *labels)
    if keep_last:
        out = out.na.fill(0, [f"next_{f}" for f in fields])
        for f in fields:  # decimals are not covered by na.fill
            out = out.withColumn(f"next_{f}", F.coalesce(F.col(f"next_{f}"), F.lit(0)))
    else:
        out = out.where(F.col("_ahead").isNotNull())
    return out.drop("_ahead")


def last_steps(series: DataFrame, steps: int, order: str = "trade_date") -> DataFrame:
    """Latest ``steps`` rows of each series (top-k per key: Spark prunes before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy("code").orderBy(F.desc(order)))
    return series.withColumn("_rank", rank).where(F.col("_rank") <= steps).drop("_rank")


def prior_period(table: DataFrame, keys: Sequence[str], period: str, measures: Sequence[str]) -> DataFrame:
    """Prior-period value of each measure, only where the previous row is exactly one period back."""
    w = Window.partitionBy(*keys).orderBy(period)
    gap_one = F.col(period) - F.lag(period).over(w) == 1
    return table.select("*", *[F.when(gap_one, F.lag(m).over(w)).alias(f"prev_{m}") for m in measures])


def averages_at_segment_end(segments: DataFrame, averages: DataFrame, column: str = "long_ma") -> DataFrame:
    """Long average in force on a segment's last day: the latest trading day not after it.

    Segment ends are marked inside the series itself and the value carried forward, so this
    as-of lookup needs neither a range join nor a second pass over the segments: both sides are
    united per code and read in date order.
    """
    marks = segments.withColumns(
        {
            "trade_date": F.col("end_date"),
            "_ma": F.lit(None).cast("decimal(18,2)"),
            "_mark": F.lit(1),
        }
    )
    known = averages.select(
        "code", "trade_date", F.col(column).cast("decimal(18,2)").alias("_ma"), F.lit(0).alias("_mark")
    )
    w = Window.partitionBy("code").orderBy("trade_date", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    return (
        marks.unionByName(known, allowMissingColumns=True)
        .withColumn("end_ma", F.last("_ma", ignorenulls=True).over(w))
        .where(F.col("_mark") == 1)
        .drop("trade_date", "_ma", "_mark")
    )
