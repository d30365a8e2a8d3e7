"""Trend report over all codes at once: turning points, extremes, segments, long-trend fix.

The daily series are dealt by code once; every step after that is a rule of ``operators.turns`` on the arrays of one code, and the rows of the
report are dealt out at the end.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import pivots as P
from tidemark.operators import series as S
from tidemark.operators import turns as T

MINOR, MEDIAN, LONG = "短期趋势", "中期趋势", "长期趋势"
COLUMNS = [
    "code", "trend_name", "start_date", "calendar_days", "close", "end_close", "train_flag", "start_record_id",
    "trading_days", "change_rate", "direction",
]


def _series(prices: DataFrame, cfg: Mapping[str, float], rates: DataFrame | None, overrides: DataFrame | None) -> DataFrame:
    """One row per code: ``series``, the minimum change of each level, ``fixes`` of its points."""
    rows = P.daily_arrays(prices)
    defaults = {MINOR: cfg["min_minor_rate"], MEDIAN: cfg["min_median_rate"], LONG: cfg["min_long_rate"]}
    own = [F.max(F.when(F.col("trend_name") == level, F.col("min_rate").cast("double"))).alias(level) for level in defaults]
    if rates is not None:
        rows = rows.join(rates.groupBy("code").agg(*own), "code", "left")
    rows = rows.withColumns({
        level: F.coalesce(F.col(level), F.lit(float(rate))) if rates is not None else F.lit(float(rate)) for level, rate in defaults.items()
    })
    if overrides is not None:
        fixes = overrides.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("trade_date", "extreme"))).alias("fixes"))
        return rows.join(fixes, "code", "left")
    return rows


def _minor(cfg: Mapping[str, float]) -> Column:
    """Short-term turning points: search, merge, drop weak ones, merge again."""
    found = T.turning_points(F.col("series"), int(cfg["minor_term"]))
    return T.merged(T.without_weak(T.merged(found), F.col(MINOR)))


def _levels(lists: DataFrame, terms: Mapping[str, int]) -> DataFrame:
    """A row per code and level, with ``segments`` from the ``points`` of the code."""
    levels = [F.struct(F.lit(level).alias("trend_name"), F.lit(term).alias("term"), F.col(level).alias("min_rate")) for level, term in terms.items()]
    rows = lists.select(*[c for c in lists.columns if c not in terms], F.inline(F.array(*levels)))
    marked = T.with_extremes(F.col("points"), F.col("term"), F.col("min_rate"))
    if "fixes" in lists.columns:
        marked = F.when(F.col("fixes").isNull(), marked).otherwise(T.with_overrides(marked, F.col("fixes")))
    kept = T.without_weak(T.merged(marked), F.col("min_rate"))
    return rows.withColumn("segments", T.segments(kept, S.UP, S.DOWN))


def minor_pivots(prices: DataFrame, settings: Mapping[str, float], rates: DataFrame | None = None) -> DataFrame:
    """Rows of the short-term turning points."""
    cfg = {**S.TREND_SETTINGS, **settings}
    return _series(prices, cfg, rates, None).select("code", F.inline(_minor(cfg))).select("code", *P.POINT_COLUMNS)


def trend_report(
    prices: DataFrame,
    as_of: str,
    settings: Mapping[str, float] | None = None,
    overrides: DataFrame | None = None,
    rates: DataFrame | None = None,
) -> DataFrame:
    """Median and long trends of every code.

    ``prices`` is a daily series (code, trade_date, close); ``as_of`` stands for the day of the run; ``overrides`` (code, trade_date, extreme)
    replaces marks; ``rates`` holds minimum changes of single codes (trend_name, code, min_rate) that replace those of the settings.
    """
    cfg = {**S.TREND_SETTINGS, **(settings or {})}
    lists = _series(prices, cfg, rates, overrides)
    lists = lists.withColumn("points", _minor(cfg)).drop(MINOR)
    levels = _levels(lists, {MEDIAN: int(cfg["median_term"]), LONG: int(cfg["long_term"])})
    oldest = F.date_sub(F.lit(as_of).cast("date"), int(cfg["long_horizon_days"]))

    def judged(s: Column) -> Column:
        recent = (F.col("trend_name") == LONG) & (s["start_date"] >= oldest)
        average = T.average_at(F.col("series"), s["end_record_id"], int(cfg["long_average"]))
        return s.withField("end_ma", F.when(recent, average)).withField("recent", recent)

    segments = F.transform("segments", judged).cast(f"array<{T.RECENT}>")
    return levels.select("code", "trend_name", F.inline(T.with_recent_joined(segments, S.UP, S.DOWN))).select(*COLUMNS)


def level_segments(minor: DataFrame, level: str, term: int, min_rate: float) -> DataFrame:
    """Segments of one trend level from the rows of the short-term turning points."""
    lists = P.point_arrays(minor).withColumn(level, F.lit(float(min_rate)))
    return _levels(lists, {level: term}).select("code", F.inline("segments")).drop("end_record_id")
