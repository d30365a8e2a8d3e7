"""Row selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import DISCARD_WORDS
from tidemark.operators import filters as S
from tidemark.registry import job
from tidemark.registry.ctes import define
from tidemark.registry.present import present

define("file_names", """
    SELECT ord, CASE ord % 6 WHEN 1 THEN replace(file_name, '.PDF', '摘要.PDF') WHEN 2 THEN replace(file_name, '年', '')
                     WHEN 3 THEN replace(file_name, '.PDF', '（英文）.PDF') ELSE file_name END AS raw_name FROM filings""")


def file_names(c):
    name = F.col("file_name")
    raw = (
        F.when(F.col("ord") % 6 == 1, F.replace(name, F.lit(".PDF"), F.lit("摘要.PDF")))
        .when(F.col("ord") % 6 == 2, F.replace(name, F.lit("年"), F.lit("")))
        .when(F.col("ord") % 6 == 3, F.replace(name, F.lit(".PDF"), F.lit("（英文）.PDF")))
        .otherwise(name)
    )
    return c.filings().select("ord", raw.alias("raw_name"))


@job("project_keys_first", "SELECT code, report_time, ord, CAST(size AS DOUBLE) AS size FROM filings")
def _keys_first(c):
    return present(S.keys_first(c.filings().select("ord", "size", "code", "report_time"), ["code", "report_time"]))


@job("report_drop_cols", "SELECT ord, report_time, code, name, report_type FROM filings")
def _drop_cols(c):
    return present(S.drop_columns(c.filings(), ["file_name", "publish_date", "size"]))


@job("period_backfill", """
    SELECT ord, CAST(i AS BIGINT) AS col_idx, CASE WHEN i = 2 AND ord % 4 = 0 THEN '2000年' ELSE (report_time - i) || '年' END AS report_time
    FROM filings, LATERAL (SELECT unnest([0, 1, 2]) AS i)""")
def _backfill(c):
    cols = c.filings().select("ord", "report_time", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("col_idx"))
    label = F.when((F.col("col_idx") == 2) & (F.col("ord") % 4 == 0), F.lit("2000年")).otherwise(F.lit("本期"))
    out = S.backfill_periods(
        cols.withColumnRenamed("report_time", "year").withColumn("label", label), "ord", "col_idx", F.col("year"),
        F.col("label"),
    )
    return present(out, "ord", "col_idx", "report_time")


@job("filter_in", """
    SELECT ord, code FROM filings WHERE report_type IN ('年度报告', '半年度报告')
      AND code IN (SELECT code FROM securities WHERE kind = '指数')""")
def _filter_in(c):
    typed = S.in_values(c.filings(), "report_type", ["年度报告", "半年度报告"])
    return present(
        S.in_values(typed, "code", c.securities().where(F.col("kind") == "指数").select("code")), "ord", "code"
    )


@job("exists_probe", """
    SELECT code, EXISTS (SELECT 1 FROM filings f WHERE f.code = s.code AND f.report_time = 1999) AS present FROM securities s""")
def _exists(c):
    probe = c.securities().select("code")
    return present(S.key_exists(probe, c.filings().where(F.col("report_time") == 1999), ["code"]))


@job("regex_select", """
    SELECT ord, file_name FROM filings WHERE regexp_matches(file_name, '00001|00002')
      AND regexp_matches(file_name, '年度报告') AND regexp_matches(file_name, '1997年|1999年')""")
def _regex_select(c):
    groups = [["00001", "00002"], ["年度报告"], ["1997年", "1999年"]]
    return present(S.name_matches_all(c.filings(), "file_name", groups), "ord", "file_name")


@job("blacklist_anti", """
    SELECT f.ord FROM filings f LEFT JOIN categories g ON g.name = f.name
    WHERE NOT (coalesce(g.industry, '') = 'NATION_7' AND ((f.report_type = '年度报告' AND f.report_time IN (1996, 1997))
               OR (f.report_type = '半年度报告' AND f.report_time IN (1999))))""")
def _blacklist(c):
    entries = F.create_map(
        F.lit("年度报告"), F.array(F.lit(1996).cast("bigint"), F.lit(1997).cast("bigint")),
        F.lit("半年度报告"), F.array(F.lit(1999).cast("bigint")),
    )
    banned = c.categories().where(F.col("industry") == "NATION_7").select("name", entries.alias("entries"))
    return present(S.drop_blacklisted(c.filings(), banned), "ord")


@job("exclude_patterns", """
    SELECT ord, raw_name FROM file_names WHERE raw_name NOT IN ('（000001）客户000001：1996年年度报告.PDF')
      AND NOT regexp_matches(raw_name, '摘要|英文|正文|公告')""")
def _exclude(c):
    return present(
        S.drop_excluded(
            file_names(c), "raw_name", ["（000001）客户000001：1996年年度报告.PDF"], DISCARD_WORDS
        )
    )


@job("valid_names", """
    SELECT ord, raw_name FROM file_names
    WHERE regexp_extract(raw_name, '[0-9]+年([\\x{4E00}-\\x{9FA5}]+)', 1) IN ('第一季度报告', '半年度报告', '第三季度报告', '年度报告')""")
def _valid(c):
    return present(S.valid_names(file_names(c), "raw_name"))


@job("quality_violations", """
    SELECT ord, 'raw_name' AS column_name, raw_name AS value, 'pattern' AS reason FROM file_names
    WHERE NOT regexp_full_match(raw_name, '（[0-9]+）.*：[0-9]+年(年度报告|半年度报告|第三季度报告)\\.PDF')
    UNION ALL
    SELECT n.ord, 'code', code, 'pattern' FROM file_names n JOIN filings f ON f.ord = n.ord
    WHERE NOT regexp_full_match(code, '0000[0-9]+')
    UNION ALL
    SELECT n.ord, 'code', code, 'member' FROM file_names n JOIN filings f ON f.ord = n.ord
    WHERE code NOT IN (SELECT code FROM securities WHERE kind <> '国债')""")
def _violations(c):
    table = file_names(c).join(c.filings().select("ord", "code"), "ord")
    return present(
        S.violations(
            table,
            "ord",
            {"raw_name": r"（[0-9]+）.*：[0-9]+年(年度报告|半年度报告|第三季度报告)\.PDF", "code": "0000[0-9]+"},
            {"code": c.securities().where(F.col("kind") != "国债").select("code")},
        )
    )


@job("train_score_split", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, 'train' AS role, CAST(close AS DOUBLE) AS span
    FROM px WHERE record_id % 7 <> 6
    UNION ALL SELECT code, CAST(trade_date AS VARCHAR), 'score',
      CASE WHEN record_id % 7 = 6 THEN 1.0 ELSE CAST(close AS DOUBLE) END FROM px""")
def _train_score(c):
    from tidemark.operators.series import with_record_id

    table = with_record_id(c.price()).select(
        "code", "trade_date", F.when(F.col("record_id") % 7 == 6, 0).otherwise(1).alias("train_flag"),
        F.col("close").cast("double").alias("span"),
    )
    return present(S.split_train_score(table, "train_flag", "span", 1.0), "code", "trade_date", "role", "span")


@job("dropna_any", """
    SELECT doc_id, n_chars, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM rated_docs
    WHERE doc_id IS NOT NULL AND n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL""")
def _dropna(c):
    rated = c.table("documents").join(c.table("labels"), "doc_id", "left").select("doc_id", "n_chars", "quality", "toxic")
    return present(S.drop_incomplete(rated))


@job("fillna_zero", """
    SELECT d.doc_id, coalesce(lang, '') AS lang, CAST(coalesce(quality, 0) AS BIGINT) AS quality
    FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang FROM documents) d
    LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _fillna(c):
    docs = c.table("documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"))
    return present(S.fill_defaults(docs.join(c.table("labels"), "doc_id", "left").select("doc_id", "lang", "quality")))


@job("page_budget", """
    SELECT doc_id, page FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS n,
             coalesce(max(CAST(ended AS INT)) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e
      FROM (SELECT doc_id, page, bool_or(contains(text, '江苏连云港市 ')) AND page % 2 = 1 AS ended FROM page_lines GROUP BY 1, 2))
    WHERE n <= 3 AND e = 0""")
def _page_budget(c):
    pages = c.page_lines().groupBy("doc_id", "page").agg(F.bool_or(F.contains("text", F.lit("江苏连云港市 "))).alias("ended"))
    pages = pages.withColumn("ended", F.col("ended") & (F.col("page") % 2 == 1))
    return present(S.page_budget(pages, "doc_id", "page", "ended", 2), "doc_id", "page")
