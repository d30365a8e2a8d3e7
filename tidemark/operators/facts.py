"""Table fragments and single facts from page text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.functions import text as X

# Patterns of facts in page text.
NUMBER = "[0-9][0-9,]*(?:[.][0-9]{1,4})?"
UNIT = "[（(]?(元|千元|万元|百万元|千万元|亿元)[）)]?"
COMPANY = "[\\u4E00-\\u9FA5]+[0-9A-Z]*[\\u4E00-\\u9FA5]*(?:股份有限公司|有限责任公司)"
UNIT_AFTER = "(元|千元|万元|百万元|千万元|亿元)"
PLACE = "[\\u4E00-\\u9FA5]+?(?:省|市|自治区)(?:[\\u4E00-\\u9FA5]+?市)?"


@dataclass(frozen=True)
class FragmentSpec:
    """Patterns that tell a table's fragments: alternatives are separated by '|'."""

    header_first: str
    field_first: str
    header_second: str
    header_third: str
    field_last: str


def _plain(text: Column) -> Column:
    return F.replace(F.translate(text, "()[]", "（）（）"), F.lit(" "), F.lit(""))


def _starts(alternatives: str) -> str:
    return "|".join("^" + a for a in alternatives.split("|"))


def _product(first: str, second: str) -> str:
    """Patterns of every pairing of two short alternative lists."""
    return "|".join("^" + a + b for a in first.split("|") for b in second.split("|"))


def fragment_texts(rows: DataFrame) -> DataFrame:
    """Per fragment: its first three columns and its first row, each run together.

    ``rows`` has (doc_id, page, frag, row_idx, cells); a fragment is a part of one page.
    """
    listed = F.sort_array(F.collect_list(F.struct("row_idx", "cells")))
    grouped = rows.groupBy("doc_id", "page", "frag").agg(listed.alias("rows"))

    def column(i: int) -> Column:
        return X.merge_all(F.transform("rows", lambda r: F.coalesce(F.get(r["cells"], F.lit(i)), F.lit(""))))

    return grouped.select(
        "doc_id", "page", "frag", "rows",
        _plain(column(0)).alias("first"), _plain(column(1)).alias("second"), _plain(column(2)).alias("third"),
        _plain(X.merge_all(F.element_at("rows", 1)["cells"])).alias("header"),
        F.size(F.element_at("rows", 1)["cells"]).alias("width"),
    )


def score_fragments(fragments: DataFrame, spec: FragmentSpec) -> DataFrame:
    """Adds ``score`` (0 to 4 patterns met) and ``ended`` (last label closes the first column)."""
    hits = [
        X.contains_match(F.col("first"), _product(spec.header_first, spec.field_first)),
        X.contains_match(F.col("second"), _starts(spec.header_second)),
        X.contains_match(F.col("third"), _starts(spec.header_third)),
        X.contains_match(F.col("header"), _product(spec.header_first, spec.header_second)),
    ]
    score = hits[0].cast("bigint") + hits[1].cast("bigint") + hits[2].cast("bigint") + hits[3].cast("bigint")
    last = "|".join(a + "$" for a in _plain_text(spec.field_last).split("|"))
    return fragments.withColumn("score", F.when(F.col("width") > 1, score).otherwise(0)).withColumn(
        "ended", X.contains_match(F.col("first"), last)
    )


def _plain_text(pattern: str) -> str:
    return pattern.translate(str.maketrans("()[]", "（）（）"))


def pick_fragments(scored: DataFrame) -> DataFrame:
    """Fragments taken per page, as (doc_id, page, picked array of frag, score, ended).

    On a table's first page an ended fragment with any score beats an open one, a higher score
    beats a lower; on later pages the first ended one is taken, else a higher score replaces what
    was gathered and an equal one is added to it.  The outcome depends on fragment order, so it is
    a fold over the page's fragments.
    """
    first_page = F.min("page").over(Window.partitionBy("doc_id"))
    listed = F.sort_array(F.collect_list(F.struct("frag", "score", "ended", "width")))
    pages = (
        scored.withColumn("_first", F.col("page") == first_page)
        .groupBy("doc_id", "page", "_first")
        .agg(listed.alias("frags"))
    )
    none = F.array().cast("array<bigint>")
    state = F.struct(
        none.alias("picked"), F.lit(0).cast("bigint").alias("score"), F.lit(False).alias("ended"), F.lit(False).alias("done")
    )

    def on_first(acc: Column, x: Column) -> Column:
        closes = x["ended"] & F.when(acc["ended"], (x["score"] > acc["score"]) & (acc["score"] > 0)).otherwise(x["score"] > 0)
        take = (x["width"] > 1) & (closes | (x["score"] > acc["score"]))
        return F.when(
            take, F.struct(F.array(x["frag"]).alias("picked"), x["score"].alias("score"), x["ended"].alias("ended"), acc["done"].alias("done"))
        ).otherwise(acc)

    def on_later(acc: Column, x: Column) -> Column:
        one = F.array(x["frag"])
        ended = F.struct(one.alias("picked"), acc["score"].alias("score"), F.lit(True).alias("ended"), F.lit(True).alias("done"))
        higher = F.struct(one.alias("picked"), x["score"].alias("score"), acc["ended"].alias("ended"), acc["done"].alias("done"))
        added = F.struct(
            F.concat(acc["picked"], one).alias("picked"), acc["score"].alias("score"), acc["ended"].alias("ended"), acc["done"].alias("done")
        )
        return (
            F.when(acc["done"] | (x["width"] <= 1), acc)
            .when(x["ended"], ended)
            .when(x["score"] > acc["score"], higher)
            .otherwise(added)
        )

    fold = F.when(F.col("_first"), F.aggregate("frags", state, on_first)).otherwise(F.aggregate("frags", state, on_later))
    return pages.select("doc_id", "page", fold.alias("r")).select("doc_id", "page", "r.picked", "r.score", "r.ended")


def stitch_pages(pages: DataFrame) -> DataFrame:
    """Pages that make up a document's table: (doc_id, page).

    Leading pages without a score do not open a table.  Pages up to the first ended one belong to
    it; the table restarts at an open page that scores higher, or equal after a page gap.  The best
    score so far is the running maximum over the opening page and open pages.
    """
    w = Window.partitionBy("doc_id").orderBy("page")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    df = pages.withColumn("_begun", F.max((F.col("score") > 0).cast("int")).over(upto)).where(F.col("_begun") == 1)
    df = df.withColumn("_over", F.coalesce(F.max(F.col("ended").cast("int")).over(before), F.lit(0))).where(F.col("_over") == 0)
    opening = F.lag("page").over(w).isNull()
    df = df.withColumn("_counts", F.when(opening | ~F.col("ended"), F.col("score")))
    best = F.max("_counts").over(before)
    gap = F.col("page") - F.lag("page").over(w)
    restart = ~F.col("ended") & ((F.col("score") > best) | ((F.col("score") == best) & (gap > 1)))
    df = df.withColumn("_island", F.sum(F.coalesce(restart, F.lit(False)).cast("int")).over(upto))
    last = F.max("_island").over(Window.partitionBy("doc_id"))
    return df.withColumn("_last", last).where(F.col("_island") == F.col("_last")).select("doc_id", "page", "score", "ended")


def stitched_rows(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """The table of each document: rows of the fragments picked on the pages that make it up, run together.

    ``rows`` are (doc_id, page, frag, row_idx, cells); the result is (doc_id, row_idx, page, cells), rows numbered anew.  A document's table is bounded by
    its text.
    """
    chosen = stitch_pages(pages).join(pages.select("doc_id", "page", "picked"), ["doc_id", "page"])
    parts = chosen.select("doc_id", "page", F.explode("picked").alias("frag"))
    found = rows.join(parts, ["doc_id", "page", "frag"])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "frag", "row_idx")) - 1
    return found.select("doc_id", place.cast("bigint").alias("row_idx"), "page", "cells")


def drop_long_edges(rows: DataFrame, keys: Sequence[str], longest: int, slack: int) -> DataFrame:
    """First and last row of a fragment whose label is longer than any known one, plus slack."""
    w = Window.partitionBy(*keys)
    label = F.replace(F.element_at("cells", 1), F.lit(" "), F.lit(""))
    edge = (F.col("row_idx") == F.min("row_idx").over(w)) | (F.col("row_idx") == F.max("row_idx").over(w))
    return rows.withColumn("_edge", edge).where(~F.col("_edge") | (F.length(label) <= longest + slack)).drop("_edge")


# ---- facts in running text -------------------------------------------------------------

VALUE_PATTERNS = {"number": NUMBER, "place": PLACE, "company": COMPANY}


def _named(fact: str):
    """Tags a (value, unit) pair with the fact it belongs to."""
    return lambda p: F.struct(F.lit(fact).alias("fact"), p["value"].alias("value"), p["unit"].alias("unit"))


def keyword_hits(lines: DataFrame, keywords: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Every hit of every keyword: (doc_id, page, pos, ord, fact, value, unit).

    ``keywords`` maps a keyword to (fact, kind of value).  A unit may stand before a number or after it; a dash in place of the value
    is a hit without one.  The list is short configuration; each line is read once and only hits leave the projection.
    """
    found = []
    for keyword, (fact, kind) in keywords.items():
        after = f"(?:\\s*{UNIT_AFTER})?" if kind == "number" else "()"
        pattern = f"\\Q{keyword}\\E(?:{UNIT})?\\s*(?:({VALUE_PATTERNS[kind]}){after}|[-－—])"
        values = F.regexp_extract_all("text", F.lit(pattern), F.lit(2))
        before, behind = (F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in (1, 3))
        units = F.zip_with(before, behind, lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b))
        found.append(F.transform(F.arrays_zip(values.alias("value"), units.alias("unit")), _named(fact)))
    hits = lines.select("doc_id", "page", "pos", F.posexplode(F.concat(*found)).alias("ord", "h"))
    return hits.select("doc_id", "page", "pos", "ord", "h.fact", "h.value", F.nullif(F.col("h.unit"), F.lit("")).alias("unit"))


def settle_facts(hits: DataFrame, unit_overrides: bool = False) -> DataFrame:
    """One value per fact: the first hit; with ``unit_overrides``, the last hit qualified by a unit, else the first hit."""
    place = F.struct("page", "pos", "ord")
    hits = hits.where(F.col("value") != "")  # a dash leaves the fact open
    if not unit_overrides:
        return hits.groupBy("doc_id", "fact").agg(F.min_by("value", place).alias("value"))
    qualified = F.col("unit").isNotNull()
    return hits.groupBy("doc_id", "fact").agg(
        F.coalesce(
            F.max_by(F.when(qualified, F.col("value")), F.when(qualified, place)), F.min_by("value", place)
        ).alias("value")
    )


def invalidate_before(hits: DataFrame, tables: DataFrame, facts: Sequence[str]) -> DataFrame:
    """Hits of the named facts count only after the table has appeared (``table_pos`` per document)."""
    known = hits.join(tables.select("doc_id", "table_pos"), "doc_id", "left")
    stale = F.col("fact").isin(*facts) & F.col("table_pos").isNotNull() & (F.col("pos") <= F.col("table_pos"))
    return known.where(~stale).drop("table_pos")


# The words before a company's code and before its short name.
CODE_WORDS, NAME_WORDS = "(?:公司代码|股票代码|证券代码)[：:]?", "(?:公司简称|股票简称|证券简称)[：:]?"


def reference_pairs(lines: DataFrame) -> DataFrame:
    """First code and short name of each document: ``公司代码：x 公司简称：y``, the two in the other order, or two codes and then two names, of which
    the first of each count."""
    text = F.col("text")
    forward = f"{CODE_WORDS}\\s*([0-9]+)(?:\\s+[0-9]+)?\\s+{NAME_WORDS}\\s*(\\S+)"
    backward = f"{NAME_WORDS}\\s*(\\S+)\\s+{CODE_WORDS}\\s*([0-9]+)"
    code = F.coalesce(N.first_match(forward, text, 1), N.first_match(backward, text, 2))
    name = F.coalesce(N.first_match(forward, text, 2), N.first_match(backward, text, 1))
    hit = lines.select("doc_id", "page", "pos", code.alias("code"), name.alias("name")).where(F.col("code").isNotNull())
    return hit.groupBy("doc_id").agg(F.min_by(F.struct("code", "name"), F.struct("page", "pos")).alias("r")).select("doc_id", "r.*")


def title_facts(lines: DataFrame) -> DataFrame:
    """Company, year and report type of each document's first title line."""
    pattern = f"({COMPANY})\\s*([0-9]{{4}}|[○一二三四五六七八九〇]{{4}})\\s*年\\s*(第一季度报告|半年度报告|第三季度报告|年度报告)"
    text = F.col("text")
    hit = lines.select(
        "doc_id", "page", "pos",
        X.collapse_repeats(N.first_match(pattern, text, 1)).alias("company"),
        X.chinese_digits(F.concat(N.first_match(pattern, text, 2), F.lit("年"))).alias("year_label"),
        N.first_match(pattern, text, 3).alias("report_type"),
    ).where(F.col("company").isNotNull())
    best = F.min_by(F.struct("company", "year_label", "report_type"), F.struct("page", "pos"))
    return hit.groupBy("doc_id").agg(best.alias("r")).select("doc_id", "r.*")


def unit_in_force(lines: DataFrame) -> DataFrame:
    """Unit and currency stated last at or before each line of a document."""
    unit = N.first_match("单位[:：]\\s*(元|千元|万元|百万元|千万元|亿元)", F.col("text"), 1)
    currency = N.first_match("币种[:：]\\s*([\\u4E00-\\u9FA5]+)", F.col("text"), 1)
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = lines.select("doc_id", "page", "pos", unit.alias("_u"), currency.alias("_c"))
    return named.select(
        "doc_id", "page", "pos",
        F.last("_u", ignorenulls=True).over(w).alias("unit"),
        F.last("_c", ignorenulls=True).over(w).alias("currency"),
    ).withColumn("multiplier", X.unit_multiplier(F.col("unit")))


def fill_facts(facts: DataFrame, names: DataFrame, fallbacks: Mapping[str, str]) -> DataFrame:
    """Empty facts take their fallback: a column of ``names`` or another fact.

    ``facts`` is wide, one row per document; ``names`` holds what its file name says.
    """
    joined = facts.join(names, "doc_id", "left")
    filled = {}
    for target, source in fallbacks.items():
        filled[target] = F.coalesce(X.valid_or_null(F.col(target)), X.valid_or_null(F.col(source)), F.lit(""))
    return joined.withColumns(filled).select(*facts.columns)


def facts_table(facts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wide facts to (doc_id, field, value); a document without any value is left out."""
    any_value = F.exists(F.array(*columns), X.is_valid)
    return facts.where(any_value).unpivot(["doc_id"], list(columns), "field", "value")
