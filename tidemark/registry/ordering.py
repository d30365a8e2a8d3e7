"""Sort, top-k and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ordering as O
from tidemark.registry import job
from tidemark.registry.ctes import define
from tidemark.registry.present import present


@job("sort_mixed", "SELECT code, report_time, report_type, ord FROM filings ORDER BY report_type DESC, code, report_time DESC, ord")
def _mixed(c):
    df = O.sort_mixed(c.filings(), [("report_type", True), ("code", False), ("report_time", True)], "ord")
    return present(df.select("code", "report_time", "report_type", "ord"))


@job("sort_digits", """
    SELECT ord, array_to_string(regexp_extract_all(file_name, '[0-9]+'), '') AS digits FROM filings ORDER BY digits, ord""")
def _digits(c):
    df = O.sort_by_digits(c.filings(), "file_name", "ord")
    return present(df.select("ord", O.digit_runs(F.col("file_name")).alias("digits")))


@job("group_sequences", """
    SELECT code, string_agg(CAST(trade_date AS VARCHAR) || '=' || CAST(close AS VARCHAR), ';' ORDER BY trade_date) AS steps
    FROM price GROUP BY code""")
def _sequences(c):
    seq = O.ordered_sequences(c.price(), ["close"])
    text = F.transform("steps", lambda s: F.concat(s["trade_date"].cast("string"), F.lit("="), s["close"].cast("string")))
    return present(seq.select("code", F.array_join(text, ";").alias("steps")))


@job("topn_periods", """
    SELECT code, report_type, report_time, ord FROM filings
    QUALIFY row_number() OVER (PARTITION BY code, report_type ORDER BY report_time DESC, ord)
            <= CASE WHEN report_type = '年度报告' THEN 3 ELSE 1 END""")
def _topn(c):
    df = O.first_periods(
        c.filings(), ["code", "report_type"], [F.desc("report_time"), "ord"], F.col("report_type") == "年度报告", 3
    )
    return present(df, "code", "report_type", "report_time", "ord")


define("quarter_columns", """
    SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) AS p,
           bool_or(label = '上期金额') OVER (PARTITION BY doc_id) AS has_prior,
           bool_or(label = '本报告期金额') OVER (PARTITION BY doc_id) AS has_current
    FROM (SELECT doc_id, row_idx, CASE c0 WHEN '收入' THEN '上期金额' WHEN '备注' THEN '本报告期金额' ELSE c0 END AS label
          FROM report_rows)""")


@job("third_quarter_columns", """
    SELECT 'accounting' AS kind, doc_id, row_idx FROM quarter_columns
    WHERE n <= 2 OR NOT CASE WHEN has_prior THEN label = '上期金额' ELSE p = n - 1 END
    UNION ALL
    SELECT 'profit', doc_id, row_idx FROM quarter_columns
    WHERE CASE WHEN has_current THEN label = '本报告期金额' WHEN n = 5 THEN p = n - 1 ELSE p = 1 END""")
def _third_quarter(c):
    """Value columns of a report (its rows stand for them): third-quarter choices."""
    cell = F.col("cells")[0]
    label = F.when(cell == "收入", F.lit("上期金额")).when(cell == "备注", F.lit("本报告期金额")).otherwise(cell)
    cols = c.report_rows().select("doc_id", "row_idx", label.alias("label"))
    parts = [
        O.third_quarter_rows(cols, "doc_id", "row_idx", "label", kind).select(F.lit(kind).alias("kind"), "doc_id", "row_idx")
        for kind in ("accounting", "profit")
    ]
    return present(parts[0].unionByName(parts[1]))


@job("sequence_lengths", "SELECT code, count(*) AS steps FROM price GROUP BY code ORDER BY steps DESC, code")
def _lengths(c):
    return present(O.sequence_lengths(O.ordered_sequences(c.price(), ["close"])))


@job("set_union_all", """
    SELECT code, name, kind, NULL AS industry FROM securities UNION ALL SELECT NULL, name, NULL, industry FROM categories""")
def _union_all(c):
    return present(O.union_all(c.securities(), c.categories()))


@job("set_except", "SELECT code, report_type FROM filings EXCEPT SELECT code, report_type FROM ledger")
def _except(c):
    return present(O.difference(c.filings().select("code", "report_type"), c.ledger().select("code", "report_type")))


@job("set_intersect", "SELECT code, report_type FROM filings INTERSECT SELECT code, report_type FROM ledger")
def _intersect(c):
    return present(O.intersection(c.filings().select("code", "report_type"), c.ledger().select("code", "report_type")))


@job("set_union", "SELECT code, report_type FROM filings UNION SELECT code, report_type FROM ledger")
def _union(c):
    return present(O.distinct_union(c.filings().select("code", "report_type"), c.ledger().select("code", "report_type")))
