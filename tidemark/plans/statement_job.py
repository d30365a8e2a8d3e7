"""Raw report tables of all documents to tidy facts, as one DataFrame job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import cells as C
from tidemark.operators import series as S
from tidemark.operators import statement as T


def usable(rows: DataFrame) -> DataFrame:
    """Tables of more than one row and one column."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return rows.withColumn("_n", n).where((F.col("_n") > 1) & (F.size("cells") > 1)).drop("_n")


def clean_statement(rows: DataFrame, spec: T.TableSpec, year: Column) -> DataFrame:
    """(doc_id, row_idx, label, report_time, period, raw, value) of every table, and a column per section heading.

    ``year`` is the report year, an expression over ``doc_id``.
    """
    rows = T.dealt(rows)
    rows = T.from_second_header(rows, spec) if spec.second_header else rows
    merged = T.drop_body_headers(T.label_years(T.merge_headers(T.preclean(rows, spec), spec)), spec)
    if spec.header_labels:
        merged = T.merge_header_labels(usable(merged), [*spec.header_words, *spec.header_labels])
    labelled = T.merge_labels(usable(merged), [*spec.labels, *spec.label_aliases, *spec.discard, *spec.header_words])
    facts = T.tidy(usable(labelled))
    named = T.alias_labels(T.discard_labels(facts, spec.discard), spec.label_pattern, spec.label_aliases)
    if spec.sections:
        named = T.section_columns(named, spec.sections, table=("doc_id", "period_idx"))
    numbered = S.occurrence_suffix(named, ["doc_id", "period_idx"], "label", "row_idx")
    if spec.known:
        numbered = numbered.where(F.col("numbered").isin(*spec.known))
    cleaned = C.final_clean(F.col("value"))
    return T.with_period(numbered, year).select(
        "doc_id", "row_idx", F.col("numbered").alias("label"), "report_time", "period",
        cleaned.alias("raw"), C.to_decimal(F.col("value")).alias("value"), *spec.sections,
    )
