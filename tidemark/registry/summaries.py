"""Aggregation and distinct queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.operators import aggregates as A
from tidemark.operators import series as S
from tidemark.registry import job
from tidemark.registry.ctes import define
from tidemark.registry.present import present
from tidemark.registry.selection import file_names


@job("agg_min_by_key", "SELECT code, report_type, min(report_time) AS listing_year FROM filings GROUP BY 1, 2")
def _min_by_key(c):
    return present(A.earliest(c.filings(), ["code", "report_type"], "report_time", "listing_year"))


@job("agg_min_max", """
    SELECT CAST(min(publish_date) AS VARCHAR) AS min_publish_date, CAST(max(publish_date) AS VARCHAR) AS max_publish_date
    FROM filings WHERE report_type = '年度报告' AND code < '000500'""")
def _min_max(c):
    keep = (F.col("report_type") == "年度报告") & (F.col("code") < "000500")
    return present(A.bounds(c.filings(), "publish_date", keep))


@job("distinct_codes", "SELECT DISTINCT code FROM ticks")
def _distinct(c):
    return present(A.distinct_keys(c.ticks(), "code"))


@job("dup_keys", "SELECT code, report_time, count(*) AS n FROM filings GROUP BY 1, 2 HAVING count(*) > 1")
def _dup(c):
    return present(A.repeated(c.filings(), "code", "report_time"))


@job("argmax_size", """
    SELECT code, report_time, ord, CAST(size AS DOUBLE) AS size FROM filings
    QUALIFY row_number() OVER (PARTITION BY code, report_time ORDER BY size DESC, ord) = 1""")
def _argmax_size(c):
    table = c.filings().select("code", "report_time", "ord", "size")
    return present(A.pick_max(table, ["code", "report_time"], "size", "ord"))


@job("argmax_length", """
    SELECT prefix, ord, raw_name FROM (
      SELECT *, regexp_extract(raw_name, '[*A-Z]*[\\x{4E00}-\\x{9FA5}]+[A-Z0-9]*') || '：' ||
                regexp_extract(raw_name, '[0-9]+年') || regexp_extract(raw_name, '[0-9]+年([\\x{4E00}-\\x{9FA5}]+)', 1) AS prefix,
             regexp_extract(raw_name, '[0-9]+年([\\x{4E00}-\\x{9FA5}]+)', 1) AS t
      FROM file_names) WHERE t IN ('年度报告', '半年度报告', '第三季度报告')
    QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY length(raw_name) DESC, ord) = 1""")
def _argmax_length(c):
    table = (
        file_names(c)
        .where(N.report_type(F.col("raw_name")).isNotNull())
        .select(N.prefix(F.col("raw_name")).alias("prefix"), "ord", "raw_name")
    )
    return present(A.pick_max(table, ["prefix"], F.length("raw_name"), "ord"))


@job("collect_types", """
    SELECT code, string_agg(report_type, ',' ORDER BY report_type) AS types
    FROM (SELECT DISTINCT code, report_type FROM filings) GROUP BY code""")
def _collect_types(c):
    lists = A.value_lists(c.filings(), ["code"], "report_type")
    return present(lists.select("code", F.array_join("values", ",").alias("types")))


@job("flag_sum", """
    SELECT doc_id, count(*) FILTER (c0 IN ('', 'None')) AS flagged, count(*) AS total FROM report_rows GROUP BY doc_id""")
def _flag_sum(c):
    invalid = F.col("cells")[0].isin("", "None")
    return present(A.flag_sum(c.report_rows(), invalid, "doc_id"))


@job("invert_map", """
    SELECT member, arg_max(industry, ord) AS industry FROM (
      SELECT m AS member, s_name AS industry, s_suppkey AS ord
      FROM supplier, LATERAL (SELECT unnest([lpad(CAST(s_suppkey % 40 AS VARCHAR), 4, '0'),
                                             lpad(CAST(s_nationkey AS VARCHAR), 4, '0')]) AS m)) GROUP BY member""")
def _invert(c):
    lists = c.table("supplier").select(
        F.col("s_suppkey").alias("ord"),
        F.col("s_name").alias("industry"),
        F.array(
            F.lpad((F.col("s_suppkey") % 40).cast("string"), 4, "0"), F.lpad(F.col("s_nationkey").cast("string"), 4, "0")
        ).alias("members"),
    )
    return present(A.invert_lists(lists, "industry", "members", "ord"))


@job("dedupe_rows", "SELECT DISTINCT code, report_type, name FROM filings")
def _dedupe(c):
    return present(A.dedupe(c.filings().select("code", "report_type", "name")))


@job("dedupe_keep_first", """
    SELECT code, report_time, ord, file_name FROM filings
    QUALIFY row_number() OVER (PARTITION BY code, report_time ORDER BY ord) = 1""")
def _keep_first(c):
    return present(A.pick_first(c.filings().select("code", "report_time", "ord", "file_name"), ["code", "report_time"], "ord"))


@job("char_vocab", """
    SELECT ch, row_number() OVER (ORDER BY ord(ch)) - 1 AS char_id
    FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> ''""")
def _vocab(c):
    return present(A.char_vocabulary(c.table("documents")))


@job("width_profile", """
    SELECT 'name' AS column_name, CAST(least(30, greatest(8, max(length(name)) + 2)) AS BIGINT) AS width FROM filings
    UNION ALL SELECT 'file_name', CAST(least(30, greatest(8, max(length(file_name)) + 2)) AS BIGINT) FROM filings
    UNION ALL SELECT 'report_time', CAST(least(30, greatest(8, max(length(CAST(report_time AS VARCHAR))) + 2)) AS BIGINT) FROM filings""")
def _width(c):
    return present(A.column_widths(c.filings(), ["name", "file_name", "report_time"], margin=2, low=8, high=30))


define("naive", """
    SELECT code, trade_date, close, lag(close) OVER w AS p1, lag(close, 2) OVER w AS p2 FROM price
    WINDOW w AS (PARTITION BY code ORDER BY trade_date)""")


def naive_scores(c):
    """Yesterday's close as the forecast of today's, with direction classes."""
    w = S._series()
    table = c.price().select(
        "code", "trade_date", "close", F.lag("close").over(w).alias("p1"), F.lag("close", 2).over(w).alias("p2")
    )
    return table.where(F.col("p2").isNotNull())


@job("eval_metrics", """
    SELECT round(mse_0, 6) AS mse_0, round(mse_1, 6) AS mse_1, round(mse_0 * 1.0 + mse_1 * 5.0, 6) AS loss, accuracy, n FROM (
      SELECT CAST(sum((p1 - close) * (p1 - close)) AS DOUBLE) / count(*) AS mse_0,
             CAST(sum((p2 - close) * (p2 - close)) AS DOUBLE) / count(*) AS mse_1,
             count(*) FILTER ((p1 >= p2) = (close >= p1)) / count(*) AS accuracy, count(*) AS n
      FROM naive WHERE p2 IS NOT NULL)""")
def _metrics(c):
    scored = naive_scores(c).select(
        "close", "p1", "p2", (F.col("p1") >= F.col("p2")).alias("guess"), (F.col("close") >= F.col("p1")).alias("truth")
    )
    out = A.evaluate(scored, [("p1", "close"), ("p2", "close")], [1.0, 5.0], "guess", "truth")
    return present(out.select(*[F.round(x, 6).alias(x) for x in ("mse_0", "mse_1", "loss")], "accuracy", "n"))


@job("perplexity", """
    SELECT lang, round(exp(sum(m * -ln(m / t)) / t), 6) AS perplexity FROM (
      SELECT lang, m, sum(m) OVER (PARTITION BY lang) AS t FROM (
        SELECT lang, w, CAST(count(*) AS DOUBLE) AS m
        FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1, 2)) GROUP BY lang, t""")
def _perplexity(c):
    """Unigram perplexity per language: word counts first, so each word is scored once."""
    from tidemark.operators.aggregates import weighted_perplexity

    words = c.table("documents").select("lang", F.explode(F.split("text", " ")).alias("w"))
    counts = words.groupBy("lang", "w").agg(F.count(F.lit(1)).cast("double").alias("m"))
    return present(weighted_perplexity(counts, ["lang"], "m").select("lang", F.round("perplexity", 6).alias("perplexity")))
