"""Report tables to tidy facts.

Tables are kept in row form, (doc_id, row_idx, cells array<string>): tests on one row are array
expressions and need no shuffle.  Rules that look along a table are windows by ``doc_id``; a table
comes out of one stored text, which bounds the window whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import cells as C
from tidemark.functions import dates as D
from tidemark.functions import text as X


@dataclass(frozen=True)
class TableSpec:
    """Configuration of one report table; ``discard`` holds label words to be found and dropped.

    The last four switch steps on: ``second_header`` cuts what stands before the second header, ``header_labels`` are header texts broken over
    several columns, ``sections`` are headings among the labels that become columns, ``known`` the numbered labels that stay.
    """

    header_words: Sequence[str]
    header_pattern: str
    labels: Sequence[str] = ()
    label_pattern: str = ""
    label_aliases: Mapping[str, str] = field(default_factory=dict)
    discard: Sequence[str] = ()
    second_header: bool = False
    header_labels: Sequence[str] = ()
    sections: Sequence[str] = ()
    known: Sequence[str] = ()


def rows_from_nested(tables: DataFrame, table: str = "table") -> DataFrame:
    """Nested rows of strings to row form, nulls spelled 'None'."""
    rows = tables.select("doc_id", F.posexplode(table).alias("row_idx", "cells"))
    named = F.transform("cells", lambda x: F.coalesce(x, F.lit("None")))
    return rows.select("doc_id", F.col("row_idx").cast("bigint").alias("row_idx"), named.alias("cells"))


def cells_long(rows: DataFrame) -> DataFrame:
    """One row per cell: (doc_id, row_idx, col_idx, text)."""
    return rows.select("doc_id", "row_idx", F.posexplode("cells").alias("col_idx", "text")).select(
        "doc_id", "row_idx", F.col("col_idx").cast("bigint").alias("col_idx"), F.coalesce("text", F.lit("None")).alias("text")
    )


def rows_from_cells(cells: DataFrame) -> DataFrame:
    """Back to row form; a row is as wide as its table."""
    ordered = F.sort_array(F.collect_list(F.struct("col_idx", "text")))
    return cells.groupBy("doc_id", "row_idx").agg(F.transform(ordered, lambda s: s["text"]).alias("cells"))


def transpose(rows: DataFrame) -> DataFrame:
    """Rows become columns: in long form the two indices change places."""
    swapped = cells_long(rows).select(
        "doc_id", F.col("col_idx").alias("row_idx"), F.col("row_idx").alias("col_idx"), "text"
    )
    return rows_from_cells(swapped)


# ---- tests on one row ------------------------------------------------------------------


def first_cell(cells: Column) -> Column:
    return F.element_at(cells, 1)


def rest(cells: Column) -> Column:
    return F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))


def is_header(cells: Column, spec: TableSpec) -> Column:
    """First cell is a header word, or the rest run together matches the header pattern."""

    def test(row: Column) -> Column:
        word = first_cell(row).isin(*spec.header_words) & (first_cell(row) != "")
        return (F.size(row) > 1) & (word | X.contains_match(X.merge_all(rest(row)), spec.header_pattern))

    return X.bind(cells, test)


def all_invalid(cells: Column) -> Column:
    """More than one cell, none of them valid."""
    return X.bind(cells, lambda row: (F.size(row) > 1) & (X.merge_all(row) == ""))


def all_invalid_not_blank(cells: Column) -> Column:
    """No valid cell, but not a wholly blank row (blank rows drive merges)."""
    return X.bind(cells, lambda row: (X.merge_all(row) == "") & ~F.forall(row, lambda x: x == ""))


def no_none(cells: Column, skip_first: bool = False) -> Column:
    """No cell reads 'None'; the first is left out for the equity table."""

    def test(row: Column) -> Column:
        return (F.size(row) > 1) & F.forall(rest(row) if skip_first else row, lambda x: x != "None")

    return X.bind(cells, test)


# ---- steps along one table -------------------------------------------------------------

#: Table rows of one task, about.  Each step along a table sorts them anew, so a task holds as many sorted copies as there are steps.
TASK_ROWS = 1 << 16


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by table into as many parts as they need, so that a task's memory does not grow with their number.

    All steps along a table use this one exchange.  Its number of parts is fixed by a count: what Spark puts together by bytes alone
    holds millions of rows, as short cells compress well.
    """
    return rows.repartition(max(1, -(-rows.count() // TASK_ROWS)), "doc_id")


def _doc(order: str = "row_idx"):
    return Window.partitionBy("doc_id").orderBy(order)


def preclean(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Number cells from the first body row on are cleaned; brackets and blanks everywhere."""
    cells = F.col("cells")
    body = ~(all_invalid(cells) | is_header(cells, spec))
    whole = Window.partitionBy("doc_id")
    first_body = F.coalesce(F.min(F.when(body, F.col("row_idx"))).over(whole), F.max("row_idx").over(whole))
    cleaned = F.concat(F.slice(cells, 1, 1), C.preclean_row(rest(cells)))
    return (
        rows.withColumn("_first", first_body)
        .withColumn("cells", F.when(F.col("row_idx") >= F.col("_first"), cleaned).otherwise(cells))
        .withColumn("cells", F.transform("cells", X.normalise_brackets))
        .drop("_first")
    )


def _row_kind(cells: Column, spec: TableSpec) -> Column:
    return F.when(all_invalid_not_blank(cells), "I").when(is_header(cells, spec), "H").otherwise("B")


def merge_headers(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Leading rows without a header go; header rows in a row become one.

    Header rows, and invalid rows between or after them, form a group that ends at the next body
    row; the group collapses cell by cell into its first row.  A group no body row follows stays.
    """
    cells = F.col("cells")
    w = _doc()
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    leads = is_header(cells, spec) & ~all_invalid(cells)
    df = rows.withColumn("_kind", _row_kind(cells, spec)).withColumn("_led", F.max(leads.cast("int")).over(upto))
    df = df.where(F.col("_led") == 1)
    valid = F.when(F.col("_kind") != "I", F.col("_kind"))
    df = df.withColumn("_before", F.last(valid, ignorenulls=True).over(before))
    starts = (F.col("_kind") == "B") | ((F.col("_kind") == "H") & ~F.col("_before").eqNullSafe(F.lit("H")))
    df = df.withColumn("_group", F.sum(starts.cast("int")).over(upto))
    last_body = F.max(F.when(F.col("_kind") == "B", F.col("row_idx"))).over(Window.partitionBy("doc_id"))
    df = df.withColumn("_body_after", F.coalesce(last_body > F.col("row_idx"), F.lit(False)))
    df = df.withColumn("_head", F.first("_kind").over(Window.partitionBy("doc_id", "_group").orderBy("row_idx")) == "H")
    collapse = F.col("_head") & F.col("_body_after")
    others = [c for c in rows.columns if c not in ("doc_id", "row_idx", "cells")]
    groups = df.where(collapse).groupBy("doc_id", "_group").agg(
        F.sort_array(F.collect_list(F.struct("row_idx", "cells"))).alias("_list"), *[F.min_by(c, "row_idx").alias(c) for c in others]
    )
    folded = groups.select("doc_id", F.col("_list")[0]["row_idx"].alias("row_idx"), _merged_cells(F.col("_list")).alias("cells"), *others)
    return df.where(~collapse).select(*rows.columns).unionByName(folded.select(*rows.columns))


def _merged_cells(listed: Column) -> Column:
    """``fold_rows`` of an ordered list of (row_idx, cells)."""
    return fold_rows(F.transform(listed, lambda r: r["cells"]))


def fold_rows(listed: Column) -> Column:
    """Rows of a list merged cell by cell, top down: valid cells of a column run together.  One row stays as it is."""
    width = F.array_max(F.transform(listed, F.size))
    column = lambda i: F.transform(listed, lambda row: F.get(row, i))
    merged = F.transform(F.sequence(F.lit(0), width - 1), lambda i: X.merge_all(column(i)))
    return F.when(F.size(listed) == 1, F.element_at(listed, 1)).otherwise(merged)


def label_years(rows: DataFrame) -> DataFrame:
    """Year spellings of the first row to year labels."""
    first = F.min("row_idx").over(Window.partitionBy("doc_id"))
    years = F.transform("cells", D.year_label)
    return (
        rows.withColumn("_first", first)
        .withColumn("cells", F.when(F.col("row_idx") == F.col("_first"), years).otherwise(F.col("cells")))
        .drop("_first")
    )


def drop_body_headers(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Header rows below the first row go."""
    first = F.min("row_idx").over(Window.partitionBy("doc_id"))
    return (
        rows.withColumn("_first", first)
        .where((F.col("row_idx") == F.col("_first")) | ~is_header(F.col("cells"), spec))
        .drop("_first")
    )


def from_second_header(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Third-quarter rule: everything before the first header that follows a body row goes."""
    upto = _doc().rowsBetween(Window.unboundedPreceding, -1)
    kind = _row_kind(F.col("cells"), spec)
    df = rows.withColumn("_kind", kind)
    df = df.withColumn("_body", F.coalesce(F.max((F.col("_kind") == "B").cast("int")).over(upto), F.lit(0)))
    second = ((F.col("_kind") == "H") & (F.col("_body") == 1)).cast("int")
    seen = F.max(second).over(_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_seen", seen).where(F.col("_seen") == 1).drop("_kind", "_body", "_seen")


def alternation(labels: Sequence[str]) -> str:
    """Alternatives, longest first, so that a label never hides inside a longer one."""
    ordered = sorted(set(labels), key=lambda x: (-len(x), x))
    return "|".join("\\Q" + x + "\\E" for x in ordered)


def match_starts(text: Column, pattern: str) -> Column:
    """Offsets of all matches: gaps and matches in turn, summed up."""
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zero = F.lit(0)
    empty = F.struct(F.array().cast("array<int>").alias("out"), zero.alias("at"))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(lengths)).alias("gap"), lengths.alias("len"))
    return F.aggregate(
        pairs,
        empty,
        lambda acc, p: F.struct(
            F.concat(acc["out"], F.array(acc["at"] + p["gap"])).alias("out"),
            (acc["at"] + p["gap"] + p["len"]).alias("at"),
        ),
    )["out"]


def merge_labels(rows: DataFrame, labels: Sequence[str], skip_first: bool = False) -> DataFrame:
    """Rows whose label is broken over several rows become one.

    Labels are found in the label column run together; a row standing where a label starts opens a
    group, as does a blank label with values (it belongs to the label below it) and a row
    following a label that started inside an earlier row.  Rows of a group merge cell by cell into
    its first row.
    """
    label = X.normalise_label(first_cell(F.col("cells")))
    base = rows.withColumn("_label", label).withColumn("_len", X.valid_length(F.col("_label")))
    w = _doc()
    base = base.withColumn(
        "_at", F.coalesce(F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    )
    listed = F.sort_array(F.collect_list(F.struct("row_idx", "_at", "_len", "_label", "cells")))
    tables = base.groupBy("doc_id").agg(listed.alias("_rows"))
    valid = F.filter("_rows", lambda r: X.is_valid(r["_label"]))
    joined = F.array_join(F.transform(valid, lambda r: r["_label"]), "")
    row_type = tables.schema["_rows"].dataType.elementType.simpleString()
    row_events = F.transform(
        "_rows", lambda r: F.struct(r["_at"].alias("_at"), F.lit(None).cast("int").alias("_mark"), r.alias("_row"))
    )
    mark_events = F.transform(
        match_starts(joined, alternation(labels)),
        lambda at: F.struct(
            at.cast("bigint").alias("_at"), F.lit(1).alias("_mark"), F.lit(None).cast(row_type).alias("_row")
        ),
    )
    events = tables.select("doc_id", F.explode(F.concat(row_events, mark_events)).alias("_e")).select(
        "doc_id", "_e._at", "_e._mark", "_e._row.row_idx", "_e._row._len", "_e._row._label", "_e._row.cells"
    )
    along = Window.partitionBy("doc_id").orderBy("_at", F.col("_mark").asc_nulls_last(), "row_idx")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumns(
        {
            "_upto": F.coalesce(F.sum("_mark").over(upto), F.lit(0)),
            "_start": F.last(F.when(F.col("_mark") == 1, F.col("_at")), ignorenulls=True).over(upto),
        }
    ).where(F.col("_mark").isNull())
    at_start = F.coalesce(F.col("_start") == F.col("_at"), F.lit(False))
    opens = at_start & ((F.col("_len") > 0) | no_none(F.col("cells"), skip_first))
    events = events.withColumn("_opens", opens.cast("int")).withColumn("_inside", F.col("_upto") - at_start.cast("int"))
    same_place = Window.partitionBy("doc_id", "_at").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    by_row = _doc()
    events = events.withColumns(
        {
            "_first_here": F.coalesce(F.max("_opens").over(same_place), F.lit(0)) == 0,
            "_missed": F.coalesce(F.col("_inside") > F.lag("_upto").over(by_row), F.lit(False)),
        }
    )
    begins = ((F.col("_opens") == 1) & F.col("_first_here")) | F.col("_missed")
    events = events.withColumn(
        "_group", F.sum(begins.cast("int")).over(by_row.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    relabelled = F.concat(F.array("_label"), rest(F.col("cells")))
    groups = events.groupBy("doc_id", "_group").agg(F.sort_array(F.collect_list(F.struct("row_idx", relabelled.alias("cells")))).alias("_list"))
    return groups.select("doc_id", F.col("_list")[0]["row_idx"].alias("row_idx"), _merged_cells(F.col("_list")).alias("cells"))


def merge_header_labels(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Header labels broken over several columns become one: ``merge_labels`` on the transposed table.  Rows are numbered anew, from 0."""
    return transpose(merge_labels(transpose(rows), labels))


# ---- tidy facts ------------------------------------------------------------------------


def tidy(rows: DataFrame) -> DataFrame:
    """Row form with a header row to facts: (doc_id, row_idx, label, period, period_idx, value)."""
    w = Window.partitionBy("doc_id").orderBy("row_idx")
    head = F.first("cells").over(w)
    df = rows.withColumn("_head", head).withColumn("_n", F.row_number().over(w)).where(F.col("_n") > 1)
    pairs = F.arrays_zip(rest(F.col("_head")).alias("period"), rest(F.col("cells")).alias("value"))
    return df.select(
        "doc_id", "row_idx", first_cell(F.col("cells")).alias("label"), F.posexplode(pairs).alias("period_idx", "p")
    ).select(
        "doc_id", "row_idx", "label", F.col("p.period").alias("period"), F.col("period_idx").cast("bigint").alias("period_idx"),
        F.col("p.value").alias("value"),
    )


def discard_labels(rows: DataFrame, patterns: Sequence[str], label: str = "label") -> DataFrame:
    """Labels matching a discard pattern, and invalid ones, go."""
    out = rows.where(X.is_valid(F.col(label)))
    return out.where(~X.contains_match(F.col(label), "|".join(patterns))) if patterns else out


def alias_labels(rows: DataFrame, pattern: str, aliases: Mapping[str, str], label: str = "label") -> DataFrame:
    """Standardised, then aliased labels; a label the pattern does not find goes."""
    std = X.standardise(F.col(label), pattern, null_spellings=True)
    if aliases:
        pairs = [F.lit(x) for kv in aliases.items() for x in kv]
        std = F.coalesce(F.create_map(*pairs)[std], std)
    return rows.withColumn(label, std).where(F.col(label).isNotNull())


def clean_alias_table(aliases: DataFrame, pattern: str) -> DataFrame:
    """Configured aliases under the same rules as data: normalised, standardised, none to itself."""
    both = aliases.select(
        X.standardise(X.normalise_label(F.col("alias")), pattern).alias("alias"),
        X.standardise(X.normalise_label(F.col("target")), pattern).alias("target"),
    )
    return both.where((F.col("alias") != F.col("target")) & F.col("alias").isNotNull() & F.col("target").isNotNull()).distinct()


def keep_known_labels(rows: DataFrame, schema: DataFrame, label: str = "numbered") -> DataFrame:
    """Numbered labels that occur in the schema's own numbered list."""
    return rows.join(schema.select(F.col("field").alias(label)), label, "left_semi")


def section_columns(rows: DataFrame, headings: Sequence[str], label: str = "label", table: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Headings among row labels become columns.

    A row between two headings carries its label in the first heading's column and '' in the
    others; heading rows go, except the first row of the table.  ``table`` names the columns that tell tables apart.
    """
    w = Window.partitionBy(*table).orderBy("row_idx")
    is_heading = F.col(label).isin(*headings)
    section = F.last(F.when(is_heading, F.col(label)), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    df = rows.withColumn("_section", section).withColumn("_first", F.lag("row_idx").over(w).isNull())
    columns = [F.when(F.col("_section") == h, F.col(label)).otherwise("").alias(h) for h in headings]
    return df.where(~is_heading | F.col("_first")).select(*rows.columns, *columns)


def with_period(facts: DataFrame, year: Column) -> DataFrame:
    """Report year of each value column: its own label if that is a year, else year − i."""
    own = F.regexp_extract("period", "^([0-9]{4})年$", 1)
    fallback = (year - F.col("period_idx")).cast("bigint")
    return facts.withColumn("report_time", F.coalesce(F.nullif(own, F.lit("")).cast("bigint"), fallback))
