"""Date and year function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.registry import job
from tidemark.registry.ctes import define
from tidemark.registry.present import present

define("day_texts", """
    SELECT o_orderkey AS ord, report_type, report_time,
           CASE WHEN o_orderpriority = '1-URGENT' THEN year(d) || '/' || month(d) || '/' || day(d)
                ELSE year(d) || '-' || month(d) || '-' || day(d) END AS day_text,
           CASE o_orderpriority WHEN '1-URGENT' THEN year(d) || '' WHEN '2-HIGH' THEN strftime(d, '%Y.%m.%d')
                WHEN '3-MEDIUM' THEN strftime(d, '%Y-%m-%d') ELSE '本期' END AS period, d
    FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders) o JOIN filings ON ord = o_orderkey""")


def day_texts(c):
    day = F.col("o_orderdate").cast("date")
    urgent = F.col("o_orderpriority")
    text = F.when(urgent == "1-URGENT", F.date_format(day, "yyyy/M/d")).otherwise(F.date_format(day, "yyyy-M-d"))
    period = (
        F.when(urgent == "1-URGENT", F.date_format(day, "yyyy"))
        .when(urgent == "2-HIGH", F.date_format(day, "yyyy.MM.dd"))
        .when(urgent == "3-MEDIUM", F.date_format(day, "yyyy-MM-dd"))
        .otherwise("本期")
    )
    return c.table("orders").select(
        F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("status"), day.alias("d"),
        text.alias("day_text"), period.alias("period"),
    )


@job("period_range", """
    SELECT code, min(report_time) || '-01-01~' || max(report_time) || '-12-30' AS span FROM filings GROUP BY code""")
def _period_range(c):
    years = F.transform(F.sort_array(F.collect_set("report_time")), lambda y: F.concat(y.cast("string"), F.lit("年")))
    lists = c.filings().groupBy("code").agg(years.alias("years"))
    return present(lists.select("code", D.period_range(F.col("years")).alias("span")))


@job("year_label", """
    SELECT ord, CASE WHEN period = '本期' THEN period ELSE substr(period, 1, 4) || '年' END AS year_label FROM day_texts""")
def _year_label(c):
    return present(day_texts(c).select("ord", D.year_label(F.col("period")).alias("year_label")))


@job("all_years", """
    SELECT code, bool_and(y <> '本期') AS all_years FROM (
      SELECT DISTINCT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS code,
             CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') AND o_orderstatus = 'P' THEN '本期'
                  ELSE year(o_orderdate) || '年' END AS y FROM orders) GROUP BY code""")
def _all_years(c):
    vague = F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW") & (F.col("o_orderstatus") == "P")
    label = F.when(vague, "本期").otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit("年")))
    lists = (
        c.table("orders")
        .groupBy(F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("code"))
        .agg(F.collect_set(label).alias("labels"))
    )
    return present(lists.select("code", D.all_years(F.col("labels")).alias("all_years")))


@job("year_shift", """
    SELECT ord, (report_time + 1) || '年' AS next_year,
           CASE WHEN report_type = '年度报告' THEN report_time - 1 ELSE report_time END || '年' AS crawl_year FROM filings""")
def _year_shift(c):
    label = F.concat(F.col("report_time").cast("string"), F.lit("年"))
    return present(
        c.filings().select(
            "ord", D.year_plus(label, 1).alias("next_year"), D.crawl_year(label, F.col("report_type")).alias("crawl_year")
        )
    )


@job("year_range", """
    SELECT code, y AS year FROM (SELECT code, min(report_time) - 1 AS a, max(report_time) AS b FROM filings GROUP BY code),
      LATERAL (SELECT unnest(range(a, b + 1)) AS y)""")
def _year_range(c):
    spans = c.filings().groupBy("code").agg(
        F.concat(F.min("report_time").cast("string"), F.lit("年")).alias("a"),
        F.concat(F.max("report_time").cast("string"), F.lit("年")).alias("b"),
    )
    return present(spans.select("code", F.explode(D.year_range(F.col("a"), F.col("b"))).alias("year")))


@job("date_diff", """
    SELECT ord, date_diff('day', d, DATE '2001-12-31') AS days, date_diff('day', d, DATE '2001-12-31') * 86400 AS seconds
    FROM day_texts""")
def _date_diff(c):
    end = F.lit("2001/12/31")
    t = F.col("day_text")
    return present(
        day_texts(c).select(
            "ord", D.difference("days", t, end).alias("days"), D.difference("seconds", t, end).alias("seconds")
        )
    )


@job("date_shift", """
    SELECT ord, CAST(CAST(d AS TIMESTAMP) + to_seconds(n * 604800) AS VARCHAR) AS weeks,
           CAST(CAST(d AS TIMESTAMP) + to_seconds(n * 86400) AS VARCHAR) AS days,
           CAST(CAST(d AS TIMESTAMP) + to_seconds(n * 3600) AS VARCHAR) AS hours,
           CAST(CAST(d AS TIMESTAMP) + to_seconds(n * 60) AS VARCHAR) AS minutes
    FROM (SELECT ord, d, day(d) - 10 AS n FROM day_texts)""")
def _date_shift(c):
    n = F.dayofmonth("d") - 10

    def text(unit):
        return F.date_format(D.shift(unit, F.col("day_text"), n), "yyyy-MM-dd HH:mm:ss").alias(unit)

    return present(day_texts(c).select("ord", text("weeks"), text("days"), text("hours"), text("minutes")))


@job("last_weekday", """
    SELECT ord, CAST(CAST(d - CASE isodow(d) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS DATE) AS VARCHAR) AS weekday FROM day_texts""")
def _weekday(c):
    return present(day_texts(c).select("ord", D.last_weekday(F.col("d")).alias("weekday")))
