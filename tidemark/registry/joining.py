"""Join and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.registry import job
from tidemark.registry.ctes import define
from tidemark.registry.present import present

TYPES = ["年度报告", "半年度报告", "第三季度报告"]

define("listing", "SELECT code, report_type, min(report_time) AS listing_year FROM ledger GROUP BY 1, 2")
define("grid", """
    SELECT DISTINCT code, y AS report_time, t AS report_type FROM securities,
      (SELECT unnest(range((SELECT min(report_time) FROM filings), (SELECT max(report_time) + 1 FROM filings))) AS y),
      (SELECT unnest(['年度报告', '半年度报告', '第三季度报告']) AS t)""")


def listing(c):
    return c.ledger().groupBy("code", "report_type").agg(F.min("report_time").alias("listing_year"))


def grid(c):
    filings = c.filings()
    return J.work_grid(
        c.securities().select("code"),
        filings.agg(F.min("report_time")).scalar(),
        filings.agg(F.max("report_time")).scalar(),
        TYPES,
    )


@job("join_left_industry", """
    SELECT s.name, code, kind, coalesce(industry, '') AS industry, '2024-02-01' AS report_time
    FROM securities s LEFT JOIN (SELECT * FROM categories WHERE industry <> 'NATION_4') g ON g.name = s.name""")
def _industry(c):
    known = c.categories().where(F.col("industry") != "NATION_4")
    return present(J.with_industry(c.securities(), known, "2024-02-01"))


@job("join_left_listing", """
    SELECT ord, CASE WHEN listing_year > 1996 THEN CAST(listing_year AS VARCHAR) ELSE '' END AS listing_year
    FROM filings f LEFT JOIN listing l ON l.code = f.code AND l.report_type = f.report_type""")
def _listing(c):
    return present(J.with_listing_year(c.filings(), listing(c), 1996), "ord", "listing_year")


@job("join_left_theta", """
    SELECT g.code, g.report_time, g.report_type FROM grid g
    LEFT JOIN listing l ON l.code = g.code AND l.report_type = g.report_type
    WHERE listing_year IS NULL OR g.report_time > listing_year""")
def _theta(c):
    return present(J.after_listing(grid(c), listing(c)), "code", "report_time", "report_type")


@job("todo_anti", """
    SELECT code, report_time, report_type FROM grid
    EXCEPT SELECT code, report_time, report_type FROM filings""")
def _todo(c):
    return present(J.outstanding(grid(c), c.filings(), ["code", "report_time", "report_type"]))


@job("unresolved", """
    SELECT DISTINCT name FROM securities WHERE name NOT IN (SELECT name FROM filings WHERE report_time = 1997)""")
def _unresolved(c):
    return present(J.unresolved(c.securities(), c.filings().where(F.col("report_time") == 1997), "name"))


@job("work_grid", "SELECT code, report_time, report_type FROM grid")
def _grid(c):
    return present(grid(c))


@job("dim_lookup", """
    SELECT r.ord, CASE WHEN ord % 9 = 0 THEN 'ST' || r.name ELSE r.name END AS name, r.name AS resolved_name,
           coalesce(s.code, '') AS code, coalesce(s.kind, '') AS kind
    FROM filings r LEFT JOIN (SELECT * FROM securities WHERE kind <> '国债') s ON s.name = r.name""")
def _dim_lookup(c):
    asked = c.filings().select(
        "ord", F.when(F.col("ord") % 9 == 0, F.concat(F.lit("ST"), "name")).otherwise(F.col("name")).alias("name")
    )
    aliases = c.securities().select(F.concat(F.lit("ST"), "name").alias("alias"), F.col("name").alias("target"))
    return present(J.resolve_names(asked, c.securities().where(F.col("kind") != "国债"), aliases))


@job("alias_map", """
    SELECT ord, report_type, CASE report_type WHEN '半年度报告' THEN '中期报告' WHEN '第三季度报告' THEN '季度报告'
           ELSE report_type END AS mapped FROM filings""")
def _alias(c):
    names = {"半年度报告": "中期报告", "第三季度报告": "季度报告"}
    return present(J.map_alias(c.filings(), "report_type", names), "ord", "report_type", "mapped")


@job("score_join_keys", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, CAST(close AS DOUBLE) AS close,
           CAST(lag(close) OVER (PARTITION BY code ORDER BY trade_date) AS DOUBLE) AS predicted
    FROM price QUALIFY lag(close) OVER (PARTITION BY code ORDER BY trade_date) IS NOT NULL""")
def _score_join(c):
    from tidemark.operators.series import next_labels

    scores = next_labels(c.price(), ["trade_date"], keep_last=False).select(
        "code", F.col("next_trade_date").alias("trade_date"), F.col("close").alias("predicted")
    )
    return present(J.bind_scores(c.price(), scores, ["code", "trade_date"]))


define("facts_long", """
    SELECT ord, field, value FROM (
      SELECT ord, 'name' AS field, name AS value FROM filings
      UNION ALL SELECT ord, 'size', CASE WHEN ord % 4 = 0 THEN NULL ELSE CAST(CAST(size AS DOUBLE) AS VARCHAR) END FROM filings)""")


def facts_long(c):
    size = F.when(F.col("ord") % 4 != 0, F.col("size").cast("double").cast("string"))
    pairs = F.array(
        F.struct(F.lit("name").alias("field"), F.col("name").alias("value")),
        F.struct(F.lit("size").alias("field"), size.alias("value")),
    )
    return c.filings().select("ord", F.explode(pairs).alias("p")).select("ord", "p.field", "p.value")


@job("override_fields", """
    SELECT l.ord, field, CASE WHEN field = 'name' AND day(publish_date) = 1 THEN '更名' || l.ord ELSE value END AS value
    FROM facts_long l JOIN filings f ON f.ord = l.ord
    UNION ALL SELECT ord, 'address', '地址' || ord FROM filings WHERE day(publish_date) = 1""")
def _override_fields(c):
    repairs = c.filings().where(F.dayofmonth("publish_date") == 1).select(
        "ord",
        F.explode(
            F.array(
                F.struct(F.lit("name").alias("field"), F.concat(F.lit("更名"), F.col("ord").cast("string")).alias("value")),
                F.struct(F.lit("address").alias("field"), F.concat(F.lit("地址"), F.col("ord").cast("string")).alias("value")),
                F.struct(F.lit("unknown").alias("field"), F.lit("x").alias("value")),
            )
        ).alias("p"),
    ).select("ord", "p.field", "p.value")
    return present(J.override_fields(facts_long(c), repairs, ["ord"], ["name", "address"]))


@job("override_table", """
    SELECT doc_id, row_idx, c0 AS label FROM report_rows
    WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')
    UNION ALL SELECT doc_id, 0, '更正' || doc_id FROM documents WHERE lang = 'de'""")
def _override_table(c):
    rows = c.report_rows().select("doc_id", "row_idx", F.col("cells")[0].alias("label"))
    repairs = c.table("documents").where(F.col("lang") == "de").select(
        "doc_id", F.lit(0).cast("bigint").alias("row_idx"),
        F.concat(F.lit("更正"), F.col("doc_id").cast("string")).alias("label"),
    )
    return present(J.override_tables(rows, repairs, ["doc_id"]))


@job("completeness_gap", """
    SELECT code, report_type FROM (SELECT DISTINCT code, t AS report_type FROM securities,
      (SELECT unnest(['年度报告', '半年度报告', '第三季度报告']) AS t)) r
    WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.code = r.code AND l.report_type = r.report_type)
      AND NOT EXISTS (SELECT 1 FROM securities s WHERE s.code = r.code AND kind = '国债' AND r.report_type = '第三季度报告')""")
def _gap(c):
    required = c.securities().select("code", F.explode(F.array(*[F.lit(t) for t in TYPES])).alias("report_type"))
    exempt = c.securities().where(F.col("kind") == "国债").select("code", F.lit("第三季度报告").alias("report_type"))
    return present(J.completeness_gaps(required, c.ledger(), exempt, ["code", "report_type"]))
