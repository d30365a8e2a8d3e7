"""Price series, trends and window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.registry import job
from tidemark.registry.ctes import define
from tidemark.registry.present import present

define("px", """
    SELECT code, trade_date, close, CAST(close * 100 AS BIGINT) AS cents,
           row_number() OVER (PARTITION BY code ORDER BY trade_date) - 1 AS record_id FROM price""")
define("pxl", """
    SELECT code, trade_date, close, CAST(close * 100 AS BIGINT) AS cents,
           row_number() OVER (PARTITION BY code ORDER BY trade_date) - 1 AS record_id FROM price_long""")
define("avg_long", """
    SELECT code, trade_date, close, record_id, run,
           CASE WHEN record_id < 30 THEN 0 ELSE (2 * (run - lag(run, 30) OVER w) + 30) // 60 END AS short_c,
           CASE WHEN record_id < 150 THEN 0 ELSE (2 * (run - lag(run, 150) OVER w) + 150) // 300 END AS median_c,
           CASE WHEN record_id < 250 THEN 0 ELSE (2 * (run - lag(run, 250) OVER w) + 250) // 500 END AS long_c
    FROM (SELECT *, CAST(sum(cents) OVER (PARTITION BY code ORDER BY trade_date) AS BIGINT) AS run FROM pxl)
    WINDOW w AS (PARTITION BY code ORDER BY trade_date)""")
define("seg_steps", """
    SELECT *, sum(CASE WHEN up IS DISTINCT FROM prev_up THEN 1 ELSE 0 END)
                OVER (PARTITION BY code ORDER BY record_id) AS island
    FROM (SELECT *, lag(up) OVER (PARTITION BY code ORDER BY record_id) AS prev_up
          FROM (SELECT *, CASE WHEN pc = 0 THEN cents > 0 ELSE cents >= pc OR 200 * (pc - cents) < pc END AS up
                FROM (SELECT *, lag(cents) OVER w AS pc, lag(trade_date) OVER w AS pd, lag(record_id) OVER w AS pid
                      FROM px WINDOW w AS (PARTITION BY code ORDER BY trade_date)) WHERE pc IS NOT NULL))""")
define("segs", """
    SELECT code, pd AS start_date, date_diff('day', pd, ed) AS calendar_days, pc, ec, pid AS start_record_id,
           eid - pid AS trading_days, island,
           sign(ec - pc) * ((200 * abs(ec - pc) + pc) // nullif(2 * pc, 0)) / 100.0 AS change_rate,
           CASE WHEN up THEN '上升' ELSE '下降' END AS direction, ed
    FROM (SELECT code, island, arg_min(pd, record_id) AS pd, arg_max(trade_date, record_id) AS ed,
                 arg_min(pc, record_id) AS pc, arg_max(cents, record_id) AS ec,
                 min(pid) AS pid, max(record_id) AS eid, bool_and(up) AS up
          FROM seg_steps GROUP BY code, island)""")


@job("record_id", "SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, CAST(record_id AS BIGINT) AS record_id FROM px")
def _record_id(c):
    return present(S.with_record_id(c.price()), "code", "trade_date", "record_id")


@job("running_sum", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date,
           CAST(sum(close) OVER (PARTITION BY code ORDER BY trade_date) AS DOUBLE) AS running_sum FROM px""")
def _running_sum(c):
    return present(S.with_running_sum(c.price()), "code", "trade_date", "running_sum")


@job("moving_averages", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, CAST(record_id AS BIGINT) AS record_id,
           short_c / 100.0 AS short_ma, median_c / 100.0 AS median_ma, long_c / 100.0 AS long_ma FROM avg_long""")
def _moving_averages(c):
    return present(
        S.moving_averages(c.price_long()), "code", "trade_date", "record_id", "short_ma", "median_ma", "long_ma"
    )


@job("price_oscillation", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date,
           CAST(CASE WHEN short_c = 0 THEN 0 ELSE CAST(close * 100 AS BIGINT) - short_c END AS DOUBLE) / 100
             AS oscillation
    FROM avg_long""")
def _oscillation(c):
    return present(S.with_oscillation(S.moving_averages(c.price_long())), "code", "trade_date", "oscillation")


@job("tiny_trends", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, CAST(record_id AS BIGINT) AS record_id,
           CAST(CASE WHEN step_up IS NULL THEN next_up ELSE step_up END AS BIGINT) AS ascending
    FROM (SELECT *, lead(step_up) OVER (PARTITION BY code ORDER BY record_id) AS next_up
          FROM (SELECT *, cents >= lag(cents) OVER (PARTITION BY code ORDER BY record_id) AS step_up FROM px))
    WHERE (step_up IS NULL OR next_up IS NULL OR next_up <> step_up) AND NOT (step_up IS NULL AND next_up IS NULL)""")
def _tiny_trends(c):
    df = S.tiny_trends(c.price()).withColumn("ascending", F.col("ascending").cast("bigint"))
    return present(df, "code", "trade_date", "record_id", "ascending")


define("outgoing", """
    SELECT *, lead(cents) OVER (PARTITION BY code ORDER BY record_id) >= cents AS ascending FROM px""")


@job("merge_trends", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, CAST(record_id AS BIGINT) AS record_id
    FROM (SELECT *, lag(record_id) OVER w AS p, lead(record_id) OVER w AS n, lag(ascending) OVER w AS pa
          FROM outgoing WINDOW w AS (PARTITION BY code ORDER BY record_id))
    WHERE (p IS NULL OR n IS NULL OR ascending IS DISTINCT FROM pa) AND NOT (p IS NULL AND n IS NULL)""")
def _merge_trends(c):
    return present(S.merge_trends(S.outgoing_direction(c.price())), "code", "trade_date", "record_id")


@job("drop_weak_pivots", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, CAST(record_id AS BIGINT) AS record_id
    FROM (SELECT *, lag(record_id) OVER w AS p, lead(cents) OVER w AS n
          FROM pxl WINDOW w AS (PARTITION BY code ORDER BY record_id))
    WHERE (p IS NULL OR n IS NULL OR CASE WHEN cents = 0 THEN n > 0 ELSE (20000 * abs(n - cents) + cents) // (2 * cents) > 730 END)
      AND NOT (p IS NULL AND n IS NULL)""")
def _drop_weak(c):
    listed = S.outgoing_direction(c.price_long()).withColumn("extreme", F.lit(False))
    return present(S.drop_weak_pivots(listed, 7.3), "code", "trade_date", "record_id")


@job("pivot_overrides", """
    SELECT p.code, CAST(p.trade_date AS VARCHAR) AS trade_date, coalesce(o.extreme, p.record_id % 2 = 0) AS extreme
    FROM px p LEFT JOIN (
      SELECT code, trade_date, max(cents) > 1000 AS extreme FROM px
      WHERE extract(day FROM trade_date) IN (10, 20) GROUP BY code, trade_date) o
      ON p.code = o.code AND p.trade_date = o.trade_date""")
def _pivot_overrides(c):
    listed = S.with_record_id(c.price()).withColumn("extreme", F.col("record_id") % 2 == 0)
    manual = c.price().where(F.dayofmonth("trade_date").isin(10, 20)).select(
        "code", "trade_date", (F.col("close") > 10).alias("extreme")
    )
    return present(S.override_pivots(listed, manual), "code", "trade_date", "extreme")


@job("min_rate_param", """
    SELECT p.code, CAST(p.trade_date AS VARCHAR) AS trade_date, t.trend_name,
           CAST(coalesce(o.min_rate, t.rate) AS DOUBLE) AS min_rate
    FROM px p CROSS JOIN (VALUES ('短期趋势', 3.0), ('中期趋势', 7.3), ('长期趋势', 60.0)) t(trend_name, rate)
    LEFT JOIN (SELECT DISTINCT '短期趋势' AS trend_name, code, 1.2 AS min_rate FROM ticks WHERE close > 200) o
      ON o.trend_name = t.trend_name AND o.code = p.code""")
def _min_rate(c):
    levels = F.array(F.lit("短期趋势"), F.lit("中期趋势"), F.lit("长期趋势"))
    series = c.price().select("code", "trade_date", F.explode(levels).alias("trend_name"))
    own = (
        c.ticks().where(F.col("close") > 200).select("code").distinct()
        .select(F.lit("短期趋势").alias("trend_name"), "code", F.lit(1.2).alias("min_rate"))
    )
    defaults = {"短期趋势": 3.0, "中期趋势": 7.3, "长期趋势": 60.0}
    return present(S.with_min_rate(series, own, defaults), "code", "trade_date", "trend_name", "min_rate")


@job("trend_segments", """
    SELECT code, CAST(start_date AS VARCHAR) AS start_date, calendar_days, pc / 100.0 AS close, ec / 100.0 AS end_close,
           CAST(CASE WHEN island = max(island) OVER (PARTITION BY code) THEN 0 ELSE 1 END AS BIGINT) AS train_flag,
           CAST(start_record_id AS BIGINT) AS start_record_id, CAST(trading_days AS BIGINT) AS trading_days,
           CAST(change_rate AS DOUBLE) AS change_rate, direction
    FROM segs""")
def _trend_segments(c):
    return present(S.trend_segments(S.with_record_id(c.price())))


@job("trend_end_ma", """
    SELECT s.code, CAST(s.start_date AS VARCHAR) AS start_date, s.start_record_id,
           (SELECT max_by(CASE WHEN m.record_id < 5 THEN 0 ELSE m.c5 END, m.record_id) FROM (
              SELECT code, trade_date, record_id,
                     (2 * CAST(sum(cents) OVER (PARTITION BY code ORDER BY record_id ROWS 4 PRECEDING) AS BIGINT) + 5) // 10 AS c5
              FROM px) m WHERE m.code = s.code AND m.trade_date <= s.ed) / 100.0 AS end_ma
    FROM segs s""")
def _trend_end_ma(c):
    prices = c.price()
    segs = S.trend_segments(S.with_record_id(prices)).withColumn(
        "end_date", F.expr("date_add(start_date, cast(calendar_days as int))")
    )
    averages = S.moving_averages(prices, {"long_ma": 5})
    return present(S.averages_at_segment_end(segs, averages), "code", "start_date", "start_record_id", "end_ma")


@job("occurrence_suffix", """
    SELECT doc_id, row_idx, CASE WHEN n > 1 THEN c0 || (n - 1) ELSE c0 END AS numbered
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, c0 ORDER BY row_idx) AS n FROM report_rows)""")
def _occurrence(c):
    rows = c.report_rows().select("doc_id", "row_idx", F.col("cells")[0].alias("label"))
    return present(S.occurrence_suffix(rows, ["doc_id"], "label", "row_idx"), "doc_id", "row_idx", "numbered")


@job("next_labels_inner", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, CAST(close AS DOUBLE) AS close, CAST(n AS DOUBLE) AS next_close
    FROM (SELECT *, lead(close) OVER (PARTITION BY code ORDER BY trade_date) AS n FROM price) WHERE n IS NOT NULL""")
def _next_inner(c):
    return present(S.next_labels(c.price(), ["close"], keep_last=False), "code", "trade_date", "close", "next_close")


@job("next_labels_outer", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, CAST(close AS DOUBLE) AS close,
           CAST(coalesce(lead(close) OVER (PARTITION BY code ORDER BY trade_date), 0) AS DOUBLE) AS next_close FROM price""")
def _next_outer(c):
    return present(S.next_labels(c.price(), ["close"], keep_last=True), "code", "trade_date", "close", "next_close")


@job("last_t_steps", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, CAST(close AS DOUBLE) AS close
    FROM price QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) <= 8""")
def _last_steps(c):
    return present(S.last_steps(c.price(), 8), "code", "trade_date", "close")


@job("yoy_growth", """
    SELECT code, year, CASE WHEN py = year - 1 AND pr <> 0 THEN (CAST(revenue AS DOUBLE) - CAST(pr AS DOUBLE)) / CAST(pr AS DOUBLE) END
             AS revenue_growth,
           CASE WHEN py = year - 1 AND pp <> 0 THEN
             (CAST(total_assets AS DOUBLE) - CAST(pp AS DOUBLE)) / CAST(pp AS DOUBLE) END AS assets_growth
    FROM (SELECT *, lag(year) OVER w AS py, lag(revenue) OVER w AS pr, lag(total_assets) OVER w AS pp
          FROM statement WINDOW w AS (PARTITION BY code ORDER BY year))""")
def _yoy(c):
    table = S.prior_period(c.statement(), ["code"], "year", ["revenue", "total_assets"])

    def growth(m):
        now, before = F.col(m).cast("double"), F.col(f"prev_{m}").cast("double")
        return F.try_divide(now - before, before)

    return present(
        table.select(
            "code", "year", growth("revenue").alias("revenue_growth"), growth("total_assets").alias("assets_growth")
        )
    )
