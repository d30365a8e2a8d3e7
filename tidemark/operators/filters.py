"""Row selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import names as N


def drop_columns(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    return table.drop(*columns)


def keys_first(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key columns first, then the measures in their order."""
    return table.select(*keys, *[c for c in table.columns if c not in keys])


def in_values(table: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """IN filter: literals for a short list, a semi join for a table of values."""
    if isinstance(values, DataFrame):
        return table.join(values.select(F.col(values.columns[0]).alias(column)), column, "left_semi")
    return table.where(F.col(column).isin(*values))


def backfill_periods(columns: DataFrame, doc: str, position: str, year: Column, label: Column | None = None) -> DataFrame:
    """Report time of the i-th value column: year − i; a year given as the column's own label wins.

    ``position`` counts from 0 inside ``doc``.
    """
    fallback = (year - F.col(position)).cast("bigint")
    if label is not None:
        own = F.regexp_extract(label, r"^(\d{4})年$", 1)
        fallback = F.coalesce(F.nullif(own, F.lit("")).cast("bigint"), fallback)
    return columns.withColumn("report_time", F.concat(fallback.cast("string"), F.lit("年")))


def key_exists(probe: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each probe row with a flag telling whether its key occurs in the table."""
    known = table.select(*keys).distinct().withColumn("_known", F.lit(True))
    return probe.join(known, list(keys), "left").withColumn("present", F.coalesce("_known", F.lit(False))).drop("_known")


def has_rows(table: DataFrame) -> bool:
    return not table.isEmpty()


def table_exists(table: DataFrame, name: str) -> bool:
    """Whether the catalog of the table's session knows ``name``."""
    return table.sparkSession.catalog.tableExists(name)


def name_matches_all(table: DataFrame, name: str, pattern_groups: Sequence[Sequence[str]]) -> DataFrame:
    """Names in which every group of alternatives is found; an empty group asks nothing."""
    out = table
    for group in pattern_groups:
        if group:
            out = out.where(F.col(name).rlike("|".join(group)))
    return out


def drop_blacklisted(table: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Removes (name, year, type) combinations listed in a nested map.

    ``blacklist`` has (name, entries: map<type, array<year>>).  Keys are parsed once and compared
    by an anti join; no pattern is tried against every row.
    """
    entries = blacklist.select("name", F.explode("entries").alias("report_type", "years")).select(
        "name", "report_type", F.explode("years").alias("report_time")
    )
    return table.join(entries, ["name", "report_type", "report_time"], "left_anti")


def drop_excluded(table: DataFrame, name: str, exact: Sequence[str], patterns: Sequence[str]) -> DataFrame:
    """Removes exact names, then names holding any of the patterns."""
    out = table
    if exact:
        out = out.where(~F.col(name).isin(*exact))
    if patterns:
        out = out.where(~F.col(name).rlike("|".join(patterns)))
    return out


def valid_names(table: DataFrame, name: str) -> DataFrame:
    """Names whose report type can be parsed."""
    return table.where(N.report_type(F.col(name)).isNotNull())


def violations(
    table: DataFrame,
    key: str,
    checks: Mapping[str, str],
    members: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Values failing a full-match pattern or missing from a dimension: (key, column, value, reason)."""
    found = []
    for column, pattern in checks.items():
        value = F.col(column).cast("string")
        fails = ~F.coalesce(value.rlike(f"^(?:{pattern})$"), F.lit(False))
        cell = F.struct(F.lit(column).alias("column_name"), value.alias("value"), F.lit("pattern").alias("reason"))
        found.append(F.when(fails, cell))
    bad = table.select(key, F.explode(F.array_compact(F.array(*found))).alias("x")).select(key, "x.*")
    for column, dim in (members or {}).items():
        missing = table.join(dim.select(F.col(dim.columns[0]).alias(column)), column, "left_anti").select(
            key, F.lit(column).alias("column_name"), F.col(column).cast("string").alias("value"),
            F.lit("member").alias("reason"),
        )
        bad = bad.unionByName(missing)
    return bad


def split_train_score(table: DataFrame, flag: str, override: str, value: float) -> DataFrame:
    """Training rows (flag 1) and scoring rows (all, with a fixed value where flag is 0), tagged."""
    roles = F.explode(F.when(F.col(flag) == 1, F.array(F.lit("train"), F.lit("score"))).otherwise(F.array(F.lit("score"))))
    tagged = table.select("*", roles.alias("role"))
    fixed = F.when((F.col("role") == "score") & (F.col(flag) == 0), F.lit(value)).otherwise(F.col(override))
    return tagged.withColumn(override, fixed)


def drop_incomplete(table: DataFrame) -> DataFrame:
    return table.na.drop("any")


def fill_defaults(table: DataFrame, number: float = 0, text: str = "") -> DataFrame:
    """Nulls become 0 in number columns and empty text in text columns."""
    return table.na.fill(number).na.fill(text)


def page_budget(pages: DataFrame, key: str, order: str, end_flag: str, max_pages: int) -> DataFrame:
    """Pages of each key up to its end flag, at most ``max_pages`` + 1 of them.

    The budget is tested before a page is added, which admits one page more than the maximum.
    """
    w = Window.partitionBy(key).orderBy(order)
    ended_before = F.max(F.col(end_flag).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ranked = pages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_pages + 1)
    return ranked.withColumn("_ended", F.coalesce(ended_before, F.lit(0))).where(F.col("_ended") == 0).drop("_n", "_ended")
