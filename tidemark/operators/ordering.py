"""Sorts, top-k and set operations.

Global sorts end in a unique key, so that range partitions split even where all leading keys tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_mixed(table: DataFrame, order: Sequence[tuple[str, bool]], unique: str) -> DataFrame:
    """Sort by (column, descending) pairs."""
    keys = [F.desc(c) if down else F.asc(c) for c, down in order]
    return table.orderBy(*keys, F.asc(unique))


def digit_runs(name: Column) -> Column:
    return F.array_join(F.regexp_extract_all(name, F.lit("[0-9]+"), F.lit(0)), "")


def sort_by_digits(table: DataFrame, name: str, unique: str) -> DataFrame:
    return table.orderBy(digit_runs(F.col(name)), unique)


def ordered_sequences(series: DataFrame, features: Sequence[str], order: str = "trade_date") -> DataFrame:
    """One ordered array per code.

    For daily series (one row per code and calendar day); raw ticks are never gathered.
    """
    items = F.sort_array(F.collect_list(F.struct(order, *features)))
    return series.groupBy("code").agg(items.alias("steps"))


def sequence_lengths(sequences: DataFrame) -> DataFrame:
    return sequences.select("code", F.size("steps").cast("bigint").alias("steps")).orderBy(F.desc("steps"), "code")


def first_periods(
    table: DataFrame, keys: Sequence[str], order: Sequence[Column | str], annual: Column, annual_limit: int
) -> DataFrame:
    """First periods of each statement: one for interim reports, ``annual_limit`` for annual ones.

    The rank filter is pushed below the shuffle as a per-partition limit.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    limit = F.when(annual, annual_limit).otherwise(1)
    return (
        table.withColumn("_rank", rank)
        .where(F.col("_rank") <= annual_limit)
        .where(F.col("_rank") <= limit)
        .drop("_rank")
    )


def third_quarter_rows(table: DataFrame, doc: str, position: str, label: str, kind: str) -> DataFrame:
    """Column choice of third-quarter reports with surplus periods.

    ``kind='accounting'`` drops the prior-period column (by its name, else the second last one);
    ``kind='profit'`` keeps the year-to-date column: the named one, else the second last of five.
    """
    w = Window.partitionBy(doc)
    n = F.count(F.lit(1)).over(w)
    place = F.row_number().over(w.orderBy(position))
    if kind == "accounting":
        named = F.max((F.col(label) == "上期金额").cast("int")).over(w)
        drop = F.when(named == 1, F.col(label) == "上期金额").otherwise(place == n - 1)
        return (
            table.select("*", drop.alias("_drop"), n.alias("_n")).where((F.col("_n") <= 2) | ~F.col("_drop")).drop("_drop", "_n")
        )
    named = F.max((F.col(label) == "本报告期金额").cast("int")).over(w)
    keep = F.when(named == 1, F.col(label) == "本报告期金额").when(n == 5, place == n - 1).otherwise(place == 1)
    return table.select("*", keep.alias("_keep")).where("_keep").drop("_keep")


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def distinct_union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).distinct()
