"""Ratio tables per report type, as one job with the type as partition column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ratios as R
from tidemark.sources import sinks


def ratio_report(statement: DataFrame, report_types: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Ratios of the requested report types, compared year over year inside each type."""
    wanted = statement.where(F.col("report_type").isin(*report_types))
    keys = ["code", "report_type"]
    return R.ratios(R.with_prior(wanted, keys), groups, [*keys, "year"])


def build_ratio_tables(
    statement: DataFrame, report_types: Sequence[str], groups: Sequence[str], path: str
) -> DataFrame:
    """Stores the report, replacing only the partitions of the requested types."""
    sinks.replace_partitions(ratio_report(statement, report_types, groups), path, ["report_type"])
    return statement.sparkSession.read.parquet(path)
