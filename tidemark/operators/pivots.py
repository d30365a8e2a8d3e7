"""Trend steps over point lists in rows: each gathers a code's rows in one array, applies a rule of ``turns`` and deals the rows out again.

The arrays hold daily series or less, so they are bounded by the calendar; work is parallel across codes and stays in the JVM.  A chain of
steps keeps the distribution by ``code``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import turns as T

POINT_COLUMNS = ["pivot_seq", "record_id", "trade_date", "close", "ascending", "extreme"]


def daily_arrays(prices: DataFrame, *others: str) -> DataFrame:
    """One row per code with ``series``, its rows in date order."""
    rows = F.struct("trade_date", F.col("close").cast("decimal(18,4)").alias("close"))
    return prices.groupBy("code", *others).agg(F.array_sort(F.collect_list(rows)).alias("series"))


def point_arrays(pivots: DataFrame, *others: str) -> DataFrame:
    """One row per code with ``points``, its point list in order."""
    close = F.col("close").cast("decimal(18,4)").alias("close")
    extreme = F.col("extreme") if "extreme" in pivots.columns else F.lit(False)
    fields = F.struct(
        F.col("pivot_seq").cast("bigint").alias("pivot_seq"), F.col("record_id").cast("bigint").alias("record_id"), "trade_date", close, "ascending",
        extreme.alias("extreme"),
    )
    return pivots.groupBy("code", *others).agg(F.array_sort(F.collect_list(fields)).alias("points"))


def find_pivots(prices: DataFrame, term: int) -> DataFrame:
    """Turning points per code of a daily series (code, trade_date, close)."""
    found = daily_arrays(prices).select("code", F.inline(T.turning_points(F.col("series"), term)))
    return found.select("code", *POINT_COLUMNS[:-1])


def mark_extremes(pivots: DataFrame, term: int, min_rate: float) -> DataFrame:
    """Adds ``extreme`` to a pivot list; ``min_rate`` is overridden by a column of that name."""
    own = "min_rate" in pivots.columns
    lists = point_arrays(pivots, *(["min_rate"] if own else []))
    limit: Column = F.col("min_rate") if own else F.lit(float(min_rate))
    return lists.select("code", F.inline(T.with_extremes(F.col("points"), F.lit(term), limit))).select("code", *POINT_COLUMNS)


def fix_recent_long_trends(segments: DataFrame, as_of: str, horizon_days: int, up: str, down: str) -> DataFrame:
    """Corrects long trends begun within ``horizon_days`` before ``as_of``.

    Expects ``end_ma``, the long average in force at the segment's end.
    """
    recent = F.date_diff(F.lit(as_of).cast("date"), F.col("start_date")) <= horizon_days
    fields = F.struct(
        "start_record_id", "start_date", "calendar_days", "close", "end_close", "train_flag", "trading_days", "change_rate", "direction",
        F.lit(None).cast("bigint").alias("end_record_id"), F.col("end_ma").cast("decimal(18,2)").alias("end_ma"), recent.alias("recent"),
    )
    names = [f.split(":")[0] for f in T.RECENT[7:-1].replace("decimal(18,4)", "d").replace("decimal(18,2)", "d").split(",")]
    lists = segments.groupBy("code").agg(F.array_sort(F.collect_list(fields)).alias("_list"))
    ordered = F.transform("_list", lambda x: F.struct(*[x[n].alias(n) for n in names])).cast(f"array<{T.RECENT}>")
    out = lists.select("code", F.inline(T.with_recent_joined(ordered, up, down)))
    return out.drop("end_record_id", "end_ma", "recent")
