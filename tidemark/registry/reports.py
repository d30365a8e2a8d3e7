"""Report table cleaning queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.operators import statement as T
from tidemark.plans.statement_job import clean_statement
from tidemark.registry import job
from tidemark.registry.ctes import define
from tidemark.registry.present import present

SPEC = T.TableSpec(
    header_words=["项目"],
    header_pattern="[0-9]{4}年|调整",
    labels=["营业收入", "净利润（元）", "一、总资产", "其中：研发", "备注", "负债合计"],
    label_pattern="[\\u4E00-\\u9FA5].*",
    label_aliases={"净利润（元）": "净利润", "一、总资产": "总资产"},
    discard=["备注"],
)

define("row_flags", """
    SELECT *, replace(c1, 'None', '') || replace(c2, 'None', '') AS tail,
           c0 = '项目' OR regexp_matches(replace(c1, 'None', '') || replace(c2, 'None', ''), '[0-9]{4}年|调整') AS is_header,
           c0 || replace(c1, 'None', '') || replace(c2, 'None', '') = '' AS all_invalid
    FROM report_rows""")


def joined(df, *keep):
    return present(df.select("doc_id", "row_idx", *keep, F.array_join("cells", "|").alias("cells")))


@job("cells_long", """
    SELECT doc_id, row_idx, CAST(i AS BIGINT) AS col_idx, ([c0, c1, c2])[i + 1] AS text
    FROM report_rows, LATERAL (SELECT unnest([0, 1, 2]) AS i)""")
def _cells(c):
    nested = c.report_rows().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("row_idx", "cells"))).alias("r"))
    tables = nested.select("doc_id", F.transform("r", lambda x: x["cells"]).alias("table"))
    return present(T.cells_long(T.rows_from_nested(tables)))


@job("header_rows", "SELECT doc_id, row_idx, is_header FROM row_flags")
def _header_rows(c):
    return present(c.report_rows().select("doc_id", "row_idx", T.is_header(F.col("cells"), SPEC).alias("is_header")))


@job("row_validity", """
    SELECT doc_id, row_idx, all_invalid, all_invalid AND NOT (c0 = '' AND c1 = '' AND c2 = '') AS not_blank,
           c0 <> 'None' AND c1 <> 'None' AND c2 <> 'None' AS no_none, c1 <> 'None' AND c2 <> 'None' AS no_none_rest FROM row_flags""")
def _validity(c):
    cells = F.col("cells")
    return present(
        c.report_rows().select(
            "doc_id", "row_idx", T.all_invalid(cells).alias("all_invalid"), T.all_invalid_not_blank(cells).alias("not_blank"),
            T.no_none(cells).alias("no_none"), T.no_none(cells, skip_first=True).alias("no_none_rest"),
        )
    )


@job("cells_preclean", """
    SELECT doc_id, row_idx, c0 || '|' || replace(CASE WHEN row_idx >= fb THEN p1 ELSE c1 END, ' ', '') || '|' ||
           replace(CASE WHEN row_idx >= fb THEN p2 ELSE c2 END, ' ', '') AS cells
    FROM clean_cells JOIN (
      SELECT doc_id, coalesce(min(row_idx) FILTER (NOT is_header AND NOT all_invalid), max(row_idx)) AS fb
      FROM row_flags GROUP BY doc_id) USING (doc_id)""")
def _preclean(c):
    return joined(T.preclean(c.report_rows(), SPEC))


@job("header_merge", """
    SELECT doc_id, row_idx, CASE WHEN row_idx = 0 AND n > 2 THEN '项目|2015.12.31（调整后）|2014' ELSE c0 || '|' || c1 || '|' || c2 END AS cells
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM report_rows) WHERE NOT (row_idx = 1 AND n > 2)""")
def _header_merge(c):
    return joined(T.merge_headers(c.report_rows(), SPEC))


@job("header_years", """
    SELECT doc_id, row_idx, CASE WHEN row_idx = 0 THEN '项目|2015年|2014年' ELSE c0 || '|' || c1 || '|' || c2 END AS cells
    FROM row_flags WHERE row_idx = 0 OR NOT is_header""")
def _header_years(c):
    return joined(T.drop_body_headers(T.label_years(c.report_rows()), SPEC))


define("label_rows", """
    SELECT doc_id, row_idx, c0, c1, c2, length(c0) AS n,
           coalesce(sum(length(c0)) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_
    FROM row_flags WHERE NOT is_header""")
define("label_starts", """
    SELECT doc_id, list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i - 1]), 0) AS s
    FROM (SELECT doc_id, list_transform(string_split_regex(t, r), lambda x: length(x)) AS gaps,
                 list_transform(regexp_extract_all(t, r), lambda x: length(x)) AS lens
          FROM (SELECT doc_id, string_agg(c0, '' ORDER BY row_idx) AS t,
                       '净利润（元）|其中：研发|一、总资产|营业收入|负债合计|备注' AS r FROM label_rows GROUP BY doc_id)),
         LATERAL (SELECT unnest(range(1, len(lens) + 1)) AS i)""")
define("label_groups", """
    SELECT *, sum(CASE WHEN (opens AND NOT coalesce(opened, false)) OR coalesce(below > upto_prev, false) THEN 1 ELSE 0 END)
                OVER (PARTITION BY doc_id ORDER BY row_idx) AS g
    FROM (SELECT *, bool_or(opens) OVER (PARTITION BY doc_id, at_ ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened,
                 lag(upto) OVER (PARTITION BY doc_id ORDER BY row_idx) AS upto_prev
          FROM (SELECT r.*, hit AND (n > 0 OR (c1 <> 'None' AND c2 <> 'None')) AS opens, upto, below
                FROM label_rows r JOIN (
                  SELECT r.doc_id, r.row_idx, count(s) FILTER (s <= at_) AS upto, count(s) FILTER (s < at_) AS below,
                         coalesce(bool_or(s = at_), false) AS hit
                  FROM label_rows r LEFT JOIN label_starts l ON l.doc_id = r.doc_id GROUP BY 1, 2) x
                  ON x.doc_id = r.doc_id AND x.row_idx = r.row_idx))""")


@job("label_merge", """
    SELECT doc_id, min(row_idx) AS row_idx, string_agg(c0, '' ORDER BY row_idx) || '|' ||
           CASE WHEN count(*) = 1 THEN any_value(c1) ELSE string_agg(CASE WHEN c1 = 'None' THEN '' ELSE c1 END, '' ORDER BY row_idx) END || '|' ||
           CASE WHEN count(*) = 1 THEN any_value(c2) ELSE string_agg(CASE WHEN c2 = 'None' THEN '' ELSE c2 END, '' ORDER BY row_idx) END AS cells
    FROM label_groups GROUP BY doc_id, g""")
def _label_merge(c):
    body = c.report_rows().where(~T.is_header(F.col("cells"), SPEC))
    return joined(T.merge_labels(body, SPEC.labels))


def labels(c):
    return c.report_rows().select("doc_id", "row_idx", F.col("cells")[0].alias("label"))


@job("label_discard", """
    SELECT doc_id, row_idx, c0 AS label FROM report_rows WHERE c0 NOT IN ('', 'None') AND NOT regexp_matches(c0, '^备注|合计$')""")
def _label_discard(c):
    return present(T.discard_labels(labels(c), ["^备注", "合计$"]))


@job("label_alias", """
    SELECT doc_id, row_idx, CASE l WHEN '净利润' THEN '归母净利润' WHEN '一' THEN '资产' ELSE l END AS label
    FROM (SELECT doc_id, row_idx, nullif(regexp_extract(c0, '[\\x{4E00}-\\x{9FA5}]+'), '') AS l FROM report_rows) WHERE l IS NOT NULL""")
def _label_alias(c):
    return present(T.alias_labels(labels(c), "[\\u4E00-\\u9FA5]+", {"净利润": "归母净利润", "一": "资产"}))


@job("alias_table_clean", """
    SELECT DISTINCT 'Brand' || split_part(p_brand, '#', 2) || '．' AS alias, p_type AS target FROM part
    WHERE 'Brand' || split_part(p_brand, '#', 2) || '．' <> p_type""")
def _alias_table(c):
    raw = c.table("part").select(
        F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".")).alias("alias"), F.col("p_type").alias("target")
    )
    return present(T.clean_alias_table(raw, "[A-Za-z]+[0-9]*．?"))


@job("label_whitelist", """
    SELECT doc_id, row_idx, numbered FROM (
      SELECT doc_id, row_idx, CASE WHEN n > 1 THEN c0 || (n - 1) ELSE c0 END AS numbered
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, c0 ORDER BY row_idx) AS n FROM report_rows))
    WHERE numbered IN ('收入', '收入1', '收入2', '营业', '净利润（元）', '净利润（元）1')""")
def _whitelist(c):
    known = ["收入", "收入1", "收入2", "营业", "净利润（元）", "净利润（元）1"]
    schema = c.spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in known])).alias("field"))
    numbered = S.occurrence_suffix(labels(c), ["doc_id"], "label", "row_idx")
    return present(T.keep_known_labels(numbered, schema), "doc_id", "row_idx", "numbered")


@job("section_columns", """
    SELECT doc_id, row_idx, c0 AS label, CASE WHEN s = '一、总资产' THEN c0 ELSE '' END AS "一、总资产",
           CASE WHEN s = '备注' THEN c0 ELSE '' END AS "备注"
    FROM (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row_idx) AS s
          FROM (SELECT *, CASE WHEN c0 IN ('一、总资产', '备注') THEN c0 END AS h FROM report_rows))
    WHERE h IS NULL OR row_idx = 0""")
def _sections(c):
    return present(T.section_columns(labels(c), ["一、总资产", "备注"]))


@job("second_header", """
    SELECT r.doc_id, row_idx, c0 || '|' || c1 || '|' || c2 AS cells FROM report_rows r JOIN (
      SELECT doc_id, min(row_idx) AS s FROM (
        SELECT *, bool_or(NOT is_header AND NOT all_invalid) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
        FROM row_flags) WHERE is_header AND b GROUP BY doc_id) x ON x.doc_id = r.doc_id AND r.row_idx >= x.s""")
def _second_header(c):
    return joined(T.from_second_header(c.report_rows(), SPEC))


@job("transpose_long", """
    SELECT doc_id, CAST(i AS BIGINT) AS row_idx, string_agg(([c0, c1, c2])[i + 1], '|' ORDER BY row_idx) AS cells
    FROM report_rows, LATERAL (SELECT unnest([0, 1, 2]) AS i) GROUP BY doc_id, i""")
def _transpose(c):
    return joined(T.transpose(c.report_rows()))


_VALID = "CASE WHEN {0} IN ('', 'None') THEN '' ELSE {0} END"
define("st_rows", f"""
    SELECT doc_id, row_idx, c0, c1, c2, length(c0) AS n,
           coalesce(sum(length(c0)) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_
    FROM (SELECT c.doc_id, c.row_idx, c.c0, CASE WHEN row_idx = 0 THEN '2015年（调整后）' ELSE replace(p1, ' ', '') END AS c1,
                 CASE WHEN row_idx = 0 THEN '2014年' ELSE replace(p2, ' ', '') END AS c2,
                 count(*) OVER (PARTITION BY c.doc_id) AS total, is_header
          FROM clean_cells c JOIN row_flags f USING (doc_id, row_idx))
    WHERE total > 2 AND (row_idx = 0 OR NOT is_header)""")

def _define_statement(name: str, periods: list[str], values: list[str]) -> None:
    """CTE ``{name}_facts`` from ``{name}_rows``: labels merged, named, one row per period; ``values`` are columns of ``{name}_merged``."""
    define(f"{name}_starts", f"""
        SELECT doc_id, list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i - 1]), 0) AS s
        FROM (SELECT doc_id, list_transform(string_split_regex(t, r), lambda x: length(x)) AS gaps,
                     list_transform(regexp_extract_all(t, r), lambda x: length(x)) AS lens
              FROM (SELECT doc_id, string_agg(c0, '' ORDER BY row_idx) AS t,
                           '净利润（元）|其中：研发|一、总资产|营业收入|负债合计|备注|项目' AS r FROM {name}_rows GROUP BY doc_id)),
             LATERAL (SELECT unnest(range(1, len(lens) + 1)) AS i)""")
    define(f"{name}_groups", f"""
        SELECT *, sum(CASE WHEN (opens AND NOT coalesce(opened, false)) OR coalesce(below > upto_prev, false) THEN 1 ELSE 0 END)
                    OVER (PARTITION BY doc_id ORDER BY row_idx) AS g
        FROM (SELECT *, bool_or(opens) OVER (PARTITION BY doc_id, at_ ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened,
                     lag(upto) OVER (PARTITION BY doc_id ORDER BY row_idx) AS upto_prev
              FROM (SELECT r.*, hit AND (n > 0 OR (c1 <> 'None' AND c2 <> 'None')) AS opens, upto, below
                    FROM {name}_rows r JOIN (
                      SELECT r.doc_id, r.row_idx, count(s) FILTER (s <= at_) AS upto, count(s) FILTER (s < at_) AS below,
                             coalesce(bool_or(s = at_), false) AS hit
                      FROM {name}_rows r LEFT JOIN {name}_starts l ON l.doc_id = r.doc_id GROUP BY 1, 2) x
                      ON x.doc_id = r.doc_id AND x.row_idx = r.row_idx))""")
    define(f"{name}_merged", f"""
        SELECT doc_id, min(row_idx) AS row_idx, string_agg(c0, '' ORDER BY row_idx) AS label,
               CASE WHEN count(*) = 1 THEN any_value(c1) ELSE string_agg({_VALID.format('c1')}, '' ORDER BY row_idx) END AS v1,
               CASE WHEN count(*) = 1 THEN any_value(c2) ELSE string_agg({_VALID.format('c2')}, '' ORDER BY row_idx) END AS v2
        FROM {name}_groups GROUP BY doc_id, g""")
    years = [2015 - i for i in range(len(periods))]
    define(f"{name}_named", f"""
        SELECT doc_id, row_idx, CASE l WHEN '净利润（元）' THEN '净利润' WHEN '一、总资产' THEN '总资产' ELSE l END AS label,
               unnest({periods}) AS period, unnest({years}) AS report_time, unnest([{', '.join(values)}]) AS v
        FROM (SELECT *, nullif(regexp_extract(label, '[\\x{{4E00}}-\\x{{9FA5}}].*'), '') AS l, min(row_idx) OVER (PARTITION BY doc_id) AS f FROM {name}_merged)
        WHERE row_idx > f AND l IS NOT NULL AND NOT contains(label, '备注')""")
    define(f"{name}_facts", f"SELECT *, row_number() OVER (PARTITION BY doc_id, period, label ORDER BY row_idx) AS k FROM {name}_named")


def _cleaned(facts: str, *more: str) -> str:
    columns = "".join(f', "{c}"' for c in more)
    return f"""
    SELECT doc_id, row_idx, CASE WHEN k > 1 THEN label || (k - 1) ELSE label END AS label, CAST(report_time AS BIGINT) AS report_time, period,
           r AS raw, CAST(TRY_CAST(replace(r, ',', '') AS DECIMAL(38,4)) AS DOUBLE) AS value{columns}
    FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(replace(v, 'None', ''), '/', ''), '（([0-9.,]+)）', '-\\1', 'g'),
                                   '[（）]', '', 'g'), '.*-$', '') AS r FROM {facts})"""


_define_statement("st", ["2015年（调整后）", "2014年"], ["v1", "v2"])


@job("statement_clean", _cleaned("st_facts"))
def _statement(c):
    return present(clean_statement(c.report_rows(), SPEC, F.lit(2015)))


define("sh_rows", """
    SELECT doc_id, row_idx, c0, c1, c2, length(c0) AS n,
           coalesce(sum(length(c0)) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_
    FROM (SELECT c.doc_id, c.row_idx, c.c0, CASE WHEN row_idx = s THEN '2015年' ELSE replace(p1, ' ', '') END AS c1,
                 CASE WHEN row_idx = s THEN '2014年' ELSE replace(p2, ' ', '') END AS c2, is_header, s,
                 count(*) FILTER (row_idx = s OR NOT is_header) OVER (PARTITION BY c.doc_id) AS total
          FROM clean_cells c JOIN row_flags f USING (doc_id, row_idx) JOIN (
            SELECT doc_id, min(row_idx) AS s FROM (
              SELECT *, bool_or(NOT is_header AND NOT all_invalid) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
              FROM row_flags) WHERE is_header AND b GROUP BY doc_id) x USING (doc_id)
          WHERE row_idx >= s)
    WHERE total > 1 AND (row_idx = s OR NOT is_header)""")
_define_statement("sh", ["2015年", "2014年"], ["v1", "v2"])


@job("statement_second_header", _cleaned("sh_facts"))
def _statement_second(c):
    """The job on tables cut before their second header."""
    return present(clean_statement(c.report_rows(), replace(SPEC, second_header=True), F.lit(2015)))


KNOWN = ("净利润", "净利润1", "总资产", "营业收入", "营业收入2", "其中：研发")


@job("statement_known", f"SELECT * FROM ({_cleaned('st_facts')}) WHERE label IN {KNOWN}")
def _statement_known(c):
    """The job with a list of the numbered labels that stay."""
    return present(clean_statement(c.report_rows(), replace(SPEC, known=KNOWN), F.lit(2015)))


define("st_sections", """
    SELECT *, CASE WHEN s = '总资产' THEN label ELSE '' END AS "总资产", CASE WHEN s = '净利润' THEN label ELSE '' END AS "净利润",
           row_number() OVER (PARTITION BY doc_id, period, label ORDER BY row_idx) AS k
    FROM (SELECT *, last_value(h IGNORE NULLS) OVER w AS s, lag(row_idx) OVER w AS before
          FROM (SELECT *, CASE WHEN label IN ('总资产', '净利润') THEN label END AS h FROM st_named) WINDOW w AS (PARTITION BY doc_id, period ORDER BY row_idx))
    WHERE h IS NULL OR before IS NULL""")


@job("statement_sections", _cleaned("st_sections", "总资产", "净利润"))
def _statement_sections(c):
    """The job with headings among the labels that become columns."""
    return present(clean_statement(c.report_rows(), replace(SPEC, sections=("总资产", "净利润")), F.lit(2015)))


define("sw_rows", f"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) - 1 AS row_idx, c0,
           {_VALID.format('c1')} || {_VALID.format('c2')} AS c1, '' AS c2, n, at_ FROM st_rows""")
_define_statement("sw", ["2015年（调整后）2014年"], ["v1"])


@job("statement_wide_header", _cleaned("sw_facts"))
def _statement_wide(c):
    """The job with a header text broken over two columns, found on the transposed table."""
    return present(clean_statement(c.report_rows(), replace(SPEC, header_labels=["2015年（调整后）2014年"]), F.lit(2015)))
