"""Joins, lookups and set differences.

No broadcast hints: Spark broadcasts a side only after checking its size, and a sort-merge join
with skew splitting takes over beyond that.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_industry(securities: DataFrame, categories: DataFrame, as_of: str | None = None) -> DataFrame:
    """Securities with their industry ('' when unknown), stamped with the day of the run."""
    day = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    return (
        securities.join(categories, "name", "left")
        .withColumn("industry", F.coalesce("industry", F.lit("")))
        .withColumn("report_time", day)
    )


def with_listing_year(filings: DataFrame, listing: DataFrame, start: int) -> DataFrame:
    """Filings with the listing year of their (code, type); blank unless after ``start``."""
    known = listing.select("code", "report_type", F.col("listing_year").alias("_year"))
    year = F.when(F.col("_year") > start, F.col("_year").cast("string")).otherwise("")
    return filings.join(known, ["code", "report_type"], "left").withColumn("listing_year", year).drop("_year")


def after_listing(required: DataFrame, listing: DataFrame) -> DataFrame:
    """Required reports strictly later than the listing year; unlisted companies pass."""
    known = listing.select("code", "report_type", F.col("listing_year").alias("_year"))
    return (
        required.join(known, ["code", "report_type"], "left")
        .where(F.col("_year").isNull() | (F.col("report_time") > F.col("_year")))
        .drop("_year")
    )


def outstanding(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work not in the ledger yet."""
    return todo.join(done.select(*keys), list(keys), "left_anti")


def unresolved(requested: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(resolved.select(key), key, "left_anti")


def work_grid(codes: DataFrame, first_year: Column, last_year: Column, types: Sequence[str]) -> DataFrame:
    """Every (code, year, type) to process; years and types are short lists expanded in each row."""
    return codes.select(
        "code", F.explode(F.sequence(first_year, last_year)).alias("report_time")
    ).select("code", "report_time", F.explode(F.array(*[F.lit(t) for t in types])).alias("report_type"))


def resolve_names(requests: DataFrame, securities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Name → (code, kind) after alias mapping; '' where the security is unknown."""
    renamed = map_alias(requests, "name", aliases).withColumnRenamed("mapped", "_lookup")
    dim = securities.select(F.col("name").alias("_lookup"), "code", "kind")
    return (
        renamed.join(dim, "_lookup", "left")
        .withColumn("code", F.coalesce("code", F.lit("")))
        .withColumn("kind", F.coalesce("kind", F.lit("")))
        .withColumnRenamed("_lookup", "resolved_name")
    )


def map_alias(table: DataFrame, column: str, aliases: DataFrame | Mapping[str, str]) -> DataFrame:
    """Adds ``mapped``: the alias target, or the value itself where it has no alias."""
    if isinstance(aliases, DataFrame):
        dim = aliases.select(F.col("alias").alias(column), F.col("target").alias("_target"))
        return (
            table.join(dim, column, "left").withColumn("mapped", F.coalesce("_target", F.col(column))).drop("_target")
        )
    if not aliases:
        return table.withColumn("mapped", F.col(column))
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    return table.withColumn("mapped", F.coalesce(F.create_map(*pairs)[F.col(column)], F.col(column)))


def bind_scores(features: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features next to their predictions, matched by key and never by row position."""
    return features.join(scores, list(keys))


def override_fields(facts: DataFrame, repairs: DataFrame, keys: Sequence[str], schema: Sequence[str]) -> DataFrame:
    """Repaired values replace extracted ones field by field.

    ``facts`` and ``repairs`` have (*keys, field, value).  Repairs for fields outside ``schema``
    are rejected; repairs for fields nothing was extracted for are added.
    """
    on = [*keys, "field"]
    fixes = repairs.where(F.col("field").isin(*schema)).select(*on, F.col("value").alias("_fix"))
    return facts.join(fixes, on, "full").select(*on, F.coalesce("_fix", "value").alias("value"))


def rejected_repairs(repairs: DataFrame, schema: Sequence[str]) -> DataFrame:
    return repairs.where(~F.col("field").isin(*schema))


def override_tables(rows: DataFrame, repair_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole tables named by a repair take the repair's rows instead of the extracted ones."""
    kept = rows.join(repair_rows.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(repair_rows)


def completeness_gaps(required: DataFrame, produced: DataFrame, exempt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required tables neither produced nor exempted."""
    return required.join(produced.select(*keys), list(keys), "left_anti").join(
        exempt.select(*keys), list(keys), "left_anti"
    )
