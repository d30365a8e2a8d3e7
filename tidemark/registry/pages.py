"""Fragment and fact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import facts as K
from tidemark.registry import job
from tidemark.registry.ctes import define
from tidemark.registry.present import present

SPEC = K.FragmentSpec(
    header_first="项目|收入|一、总资产",
    field_first="净利润|其中",
    header_second="2015|（|[1-4]",
    header_third="2014|[0-9]{2},",
    field_last="其中：研发|净利润（元）",
)

define("frag_rows", "SELECT *, row_idx // 30 AS page, (row_idx % 30) // 10 AS frag FROM report_rows")
define("frag_texts", """
    SELECT doc_id, page, frag, string_agg(c0, '' ORDER BY row_idx) AS f,
           string_agg(replace(replace(c1, ' ', ''), 'None', ''), '' ORDER BY row_idx) AS s,
           string_agg(replace(c2, 'None', ''), '' ORDER BY row_idx) AS t,
           arg_min(replace(c0 || replace(c1, 'None', '') || replace(c2, 'None', ''), ' ', ''), row_idx) AS h
    FROM frag_rows GROUP BY 1, 2, 3""")
define("frag_scores", """
    SELECT doc_id, page, frag,
           CAST(regexp_matches(f, '^(项目|收入|一、总资产)(净利润|其中)') AS BIGINT) + CAST(regexp_matches(s, '^(2015|（|[1-4])') AS BIGINT)
             + CAST(regexp_matches(t, '^(2014|[0-9]{2},)') AS BIGINT)
             + CAST(regexp_matches(h, '^(项目|收入|一、总资产)(2015|（|[1-4])') AS BIGINT) AS score,
           regexp_matches(f, '(其中：研发|净利润（元）)$') AS ended
    FROM frag_texts""")
define("frag_first", """
    SELECT doc_id, page, list_reduce(
        list_prepend({'frag': CAST(-1 AS BIGINT), 'score': CAST(0 AS BIGINT), 'ended': false},
                     list({'frag': frag, 'score': score, 'ended': ended} ORDER BY frag)),
        lambda a, x: CASE WHEN (x.ended AND NOT a.ended AND x.score > 0) OR (x.ended AND a.ended AND x.score > a.score AND a.score > 0)
                               OR x.score > a.score THEN x ELSE a END) AS r
    FROM frag_scores s WHERE page = (SELECT min(page) FROM frag_scores m WHERE m.doc_id = s.doc_id) GROUP BY 1, 2""")
define("frag_later", """
    SELECT doc_id, page, list_reduce(
        list_prepend({'picked': '', 'score': CAST(0 AS BIGINT), 'ended': false},
                     list({'picked': CAST(frag AS VARCHAR), 'score': score, 'ended': ended} ORDER BY frag)),
        lambda a, x: CASE WHEN a.ended THEN a
                          WHEN x.ended THEN {'picked': x.picked, 'score': a.score, 'ended': true}
                          WHEN x.score > a.score THEN {'picked': x.picked, 'score': x.score, 'ended': false}
                          ELSE {'picked': CASE WHEN a.picked = '' THEN x.picked ELSE a.picked || ',' || x.picked END,
                                'score': a.score, 'ended': false} END) AS r
    FROM frag_scores s WHERE page > (SELECT min(page) FROM frag_scores m WHERE m.doc_id = s.doc_id) GROUP BY 1, 2""")
define("frag_picks", """
    SELECT doc_id, page, CASE WHEN r.frag < 0 THEN '' ELSE CAST(r.frag AS VARCHAR) END AS picked, r.score AS score, r.ended AS ended FROM frag_first
    UNION ALL SELECT doc_id, page, r.picked, r.score, r.ended FROM frag_later""")


def fragments(c):
    rows = c.report_rows().select(
        "doc_id",
        F.floor(F.col("row_idx") / 30).cast("bigint").alias("page"),
        F.floor(F.col("row_idx") % 30 / 10).cast("bigint").alias("frag"),
        "row_idx",
        "cells",
    )
    return rows


def scored(c):
    return K.score_fragments(K.fragment_texts(fragments(c)), SPEC)


@job("fragment_score", "SELECT doc_id, page, frag, score FROM frag_scores")
def _score(c):
    return present(scored(c), "doc_id", "page", "frag", "score")


@job("fragment_end", "SELECT doc_id, page, frag, ended FROM frag_scores")
def _end(c):
    return present(scored(c), "doc_id", "page", "frag", "ended")


@job("fragment_pick", "SELECT doc_id, page, picked, score, ended FROM frag_picks")
def _pick(c):
    picked = K.pick_fragments(scored(c))
    return present(picked.withColumn("picked", F.array_join(F.col("picked").cast("array<string>"), ",")))


define("stitch", """
    SELECT *, max(CASE WHEN o IS NULL OR NOT ended THEN score END) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
    FROM (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY page) AS o
          FROM (SELECT *, coalesce(bool_or(ended) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over_
                FROM (SELECT *, bool_or(score > 0) OVER (PARTITION BY doc_id ORDER BY page) AS begun FROM frag_picks) WHERE begun) WHERE NOT over_)""")


@job("page_stitch", """
    SELECT doc_id, page, score, ended FROM (
      SELECT *, max(island) OVER (PARTITION BY doc_id) AS last_ FROM (
        SELECT *, sum(CASE WHEN NOT ended AND (score > best OR (score = best AND page - o > 1)) THEN 1 ELSE 0 END)
                    OVER (PARTITION BY doc_id ORDER BY page) AS island FROM stitch)) WHERE island = last_""")
def _stitch(c):
    return present(K.stitch_pages(K.pick_fragments(scored(c))))


@job("stitched_rows", """
    WITH kept AS (SELECT doc_id, page, picked FROM (
      SELECT *, max(island) OVER (PARTITION BY doc_id) AS last_ FROM (
        SELECT *, sum(CASE WHEN NOT ended AND (score > best OR (score = best AND page - o > 1)) THEN 1 ELSE 0 END)
                    OVER (PARTITION BY doc_id ORDER BY page) AS island FROM stitch)) WHERE island = last_)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, frag, row_idx) - 1 AS row_idx, page, c0 AS label
    FROM kept JOIN frag_rows USING (doc_id, page) WHERE list_contains(string_split(CAST(picked AS VARCHAR), ','), CAST(frag AS VARCHAR))""")
def _stitched_rows(c):
    table = K.stitched_rows(K.pick_fragments(scored(c)), fragments(c))
    return present(table.select("doc_id", "row_idx", "page", F.col("cells")[0].alias("label")))


@job("drop_long_edges", """
    SELECT doc_id, row_idx, c0 AS label FROM (
      SELECT *, row_idx = min(row_idx) OVER w OR row_idx = max(row_idx) OVER w AS edge FROM frag_rows WINDOW w AS (PARTITION BY doc_id, page, frag))
    WHERE NOT edge OR length(c0) <= 5""")
def _edges(c):
    kept = K.drop_long_edges(fragments(c), ["doc_id", "page", "frag"], 4, 1)
    return present(kept.select("doc_id", "row_idx", F.col("cells")[0].alias("label")))


KEYWORDS = {
    "在职员工的数量合计": ("staff", "number"),
    "研发投入金额": ("research", "number"),
    "注册地址": ("address", "place"),
}

define("hits", """
    SELECT doc_id, page, pos, 'staff' AS fact, regexp_extract(text, '在职员工的数量合计\\s*([0-9][0-9,]*(?:[.][0-9]{1,4})?)', 1) AS value, false AS q
    FROM page_lines WHERE regexp_matches(text, '在职员工的数量合计\\s*[0-9]')
    UNION ALL SELECT doc_id, page, pos, 'research', regexp_extract(text, '研发投入金额（元）\\s*([0-9][0-9,]*(?:[.][0-9]{1,4})?)', 1), true
    FROM page_lines WHERE regexp_matches(text, '研发投入金额（元）\\s*[0-9]')
    UNION ALL SELECT doc_id, page, pos, 'address', '江苏连云港市', false FROM page_lines WHERE contains(text, '注册地址 江苏连云港市')""")


@job("keyword_facts", """
    SELECT doc_id, fact, arg_min(value, pos) AS value FROM hits GROUP BY doc_id, fact""")
def _keyword(c):
    return present(K.settle_facts(K.keyword_hits(c.page_lines(), KEYWORDS)))


@job("fact_invalidate", """
    SELECT doc_id, fact, arg_min(value, pos) AS value
    FROM hits LEFT JOIN (SELECT doc_id, min(pos) AS tp FROM page_lines WHERE contains(text, '股份有限公司') GROUP BY doc_id) t USING (doc_id)
    WHERE NOT (fact IN ('staff', 'research') AND tp IS NOT NULL AND pos <= tp) GROUP BY doc_id, fact""")
def _invalidate(c):
    lines = c.page_lines()
    tables = lines.where(F.contains("text", F.lit("股份有限公司"))).groupBy("doc_id").agg(F.min("pos").alias("table_pos"))
    hits = K.keyword_hits(lines, KEYWORDS)
    return present(K.settle_facts(K.invalidate_before(hits, tables, ["staff", "research"])))


define("ref_pairs", """
    SELECT doc_id, arg_min(c, pos) AS code, arg_min(n, pos) AS name FROM (
      SELECT doc_id, pos, regexp_extract(text, '公司代码：\\s*([0-9]+)\\s+公司简称：\\s*([^\\s]+)', 1) AS c,
             regexp_extract(text, '公司代码：\\s*([0-9]+)\\s+公司简称：\\s*([^\\s]+)', 2) AS n FROM page_lines) WHERE c <> '' GROUP BY doc_id""")


@job("reference_pairs", "SELECT doc_id, code, name FROM ref_pairs")
def _pairs(c):
    return present(K.reference_pairs(c.page_lines()))


def _other_forms(lines):
    """Code and name in other orders, numbers with a unit behind them or a dash in their place, by the place of the line."""
    pair = "公司代码：([0-9]+) 公司简称：(\\S+)"
    text = F.when(F.col("pos") % 3 == 0, F.regexp_replace("text", pair, "股票简称 $2 股票代码 $1"))
    text = text.when(F.col("pos") % 3 == 1, F.regexp_replace("text", pair, "股票代码 $1 900$1 股票简称 $2 乙股")).otherwise(F.col("text"))
    staff = "(在职员工的数量合计) ([0-9,]+)"
    lines = lines.withColumn("text", text).withColumn(
        "text", F.when(F.col("pos") % 4 == 0, F.regexp_replace("text", staff, "$1 $2 万元"))
        .when(F.col("pos") % 4 == 1, F.regexp_replace("text", staff, "$1 - $2")).otherwise(F.col("text"))
    )
    return lines.withColumn("text", F.explode(F.array("text")))  # else the rewriting would be repeated in every pattern below


@job("reference_forms", "SELECT doc_id, code, name FROM ref_pairs")
def _reference_forms(c):
    return present(K.reference_pairs(_other_forms(c.page_lines())))


@job("keyword_forms", """
    SELECT doc_id, fact, coalesce(arg_max(value, pos) FILTER (q OR (fact = 'staff' AND pos % 4 = 0)), arg_min(value, pos)) AS value
    FROM hits WHERE NOT (fact = 'staff' AND pos % 4 = 1) GROUP BY doc_id, fact""")
def _keyword_forms(c):
    hits = K.keyword_hits(_other_forms(c.page_lines()), KEYWORDS)
    return present(K.settle_facts(hits, unit_overrides=True))


define("titles", """
    SELECT doc_id, arg_min(k, pos) AS k, arg_min(y, pos) || '年' AS year_label, arg_min(t, pos) AS report_type FROM (
      SELECT doc_id, pos, regexp_extract(text, '江江苏苏客户([0-9]+)股份有限公司', 1) AS k,
             regexp_extract(text, '股份有限公司 ([0-9]{4}) 年年度报告', 1) AS y, '年度报告' AS t FROM page_lines) WHERE y <> '' GROUP BY doc_id""")


@job("title_facts", """
    SELECT doc_id, '江苏客户' || CASE WHEN length(k) = 2 AND k[1] = k[2] THEN k[1] ELSE k END || '股份有限公司' AS company, year_label, report_type FROM titles""")
def _title(c):
    return present(K.title_facts(c.page_lines()))


@job("unit_in_force", """
    SELECT doc_id, pos, last_value(u IGNORE NULLS) OVER w AS unit, last_value(CASE WHEN u IS NOT NULL THEN '人民币' END IGNORE NULLS) OVER w AS currency,
           CAST(CASE last_value(u IGNORE NULLS) OVER w WHEN '千元' THEN 1000 WHEN '万元' THEN 10000 WHEN '亿元' THEN 100000000 ELSE 1 END AS BIGINT) AS multiplier
    FROM (SELECT *, nullif(regexp_extract(text, '单位：(元|千元|万元|亿元)', 1), '') AS u FROM page_lines)
    WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _unit(c):
    return present(K.unit_in_force(c.page_lines()), "doc_id", "pos", "unit", "currency", "multiplier")


def wide_facts(c):
    """One row per document: title facts, reference pair and address, null where nothing was found."""
    lines = c.page_lines()
    address = (
        K.settle_facts(K.keyword_hits(lines, {"注册地址": ("address", "place")})).select("doc_id", F.col("value").alias("registered"))
    )
    return (
        c.table("documents").select("doc_id")
        .join(K.title_facts(lines), "doc_id", "left")
        .join(K.reference_pairs(lines), "doc_id", "left")
        .join(address, "doc_id", "left")
        .select("doc_id", "year_label", "report_type", "code", "registered")
        .withColumn("address", F.lit(None).cast("string"))
    )


define("wide_facts", """
    SELECT d.doc_id, t.year_label, t.report_type, r.code, a.registered FROM documents d
    LEFT JOIN titles t ON t.doc_id = d.doc_id LEFT JOIN ref_pairs r ON r.doc_id = d.doc_id
    LEFT JOIN (SELECT DISTINCT doc_id, '江苏连云港市' AS registered FROM hits WHERE fact = 'address') a ON a.doc_id = d.doc_id""")


@job("fact_fallback", """
    SELECT doc_id, coalesce(year_label, '2020年') AS year_label, coalesce(report_type, CASE WHEN lang = 'en' THEN '半年度报告' ELSE '年度报告' END) AS report_type,
           coalesce(registered, '') AS address FROM wide_facts JOIN documents USING (doc_id)""")
def _fallback(c):
    facts = wide_facts(c)
    kind = F.when(F.col("lang") == "en", "半年度报告").otherwise("年度报告")
    names = c.table("documents").select("doc_id", F.lit("2020年").alias("name_year"), kind.alias("name_type"))
    filled = K.fill_facts(
        facts, names, {"year_label": "name_year", "report_type": "name_type", "address": "registered"}
    )
    return present(filled, "doc_id", "year_label", "report_type", "address")


@job("facts_unpivot", """
    SELECT doc_id, unnest(['year_label', 'report_type', 'code']) AS field, unnest([year_label, report_type, code]) AS value FROM wide_facts
    WHERE year_label IS NOT NULL OR report_type IS NOT NULL OR code IS NOT NULL""")
def _unpivot(c):
    return present(K.facts_table(wide_facts(c), ["year_label", "report_type", "code"]))
