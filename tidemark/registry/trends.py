"""Trend queries; their SQL follows the rules by recursion over lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import long_series as L
from tidemark.operators import pivots as P
from tidemark.operators import series as S
from tidemark.plans import trend_job
from tidemark.registry import job
from tidemark.registry.ctes import define
from tidemark.registry.present import present

TERM = 14


def _define_minor(name: str, base: str) -> None:
    """CTEs ``{name}_points`` and, merged and without weak ones, ``{name}_minor`` over a table (code, trade_date, cents, record_id)."""
    define(f"{name}_arr", f"""
        SELECT code, list(cents ORDER BY record_id) AS arr, list(trade_date ORDER BY record_id) AS days, count(*) AS n FROM {base} GROUP BY code""")
    seen = f"""
        SELECT w.code, w.n, at_, list_position(s, list_max(s)) - 1 AS hi, list_position(s, list_min(s)) - 1 AS lo
        FROM (SELECT v.code, v.n, at_, arr[at_ + 1 : at_ + {TERM}] AS s FROM {name}_walk v JOIN {name}_arr p ON p.code = v.code) w"""
    define(f"{name}_walk", f"""
        SELECT code, n, CAST(0 AS BIGINT) AS at_ FROM {name}_arr WHERE n >= 2
        UNION ALL
        SELECT code, n, at_ + CASE WHEN hi = lo THEN {TERM} WHEN least(hi, lo) = 0 THEN greatest(hi, lo) ELSE least(hi, lo) END
        FROM ({seen}) WHERE at_ + {TERM} < n""")
    define(f"{name}_turned", f"""
        SELECT code, n, at_, CASE WHEN hi <> lo AND at_ + {TERM} >= n THEN at_ + CASE WHEN least(hi, lo) = 0 THEN greatest(hi, lo) ELSE least(hi, lo) END END AS more
        FROM ({seen}) WHERE NOT (hi = lo AND at_ + {TERM} < n)""")
    define(f"{name}_points", f"""
        SELECT t.code, t.at_, row_number() OVER w - 1 AS seq, arr[t.at_ + 1] AS cents, days[t.at_ + 1] AS day,
               lead(arr[t.at_ + 1]) OVER w >= arr[t.at_ + 1] AS ascending
        FROM (SELECT code, at_ FROM {name}_turned UNION SELECT code, more FROM {name}_turned WHERE more IS NOT NULL
              UNION SELECT code, n - 1 FROM {name}_turned) t JOIN {name}_arr p ON p.code = t.code
        WINDOW w AS (PARTITION BY t.code ORDER BY t.at_)""")
    define(f"{name}_first", _merged(f"SELECT *, FALSE AS extreme FROM {name}_points"))
    define(f"{name}_minor", _merged(_strong(f"{name}_first", 300)))


def _merged(points: str) -> str:
    return f"""
        SELECT * EXCLUDE (before, after, prior) FROM (
          SELECT *, lag(at_) OVER w AS before, lead(at_) OVER w AS after, lag(ascending) OVER w AS prior
          FROM ({points}) WINDOW w AS (PARTITION BY code ORDER BY at_))
        WHERE (before IS NULL OR after IS NULL OR ascending IS DISTINCT FROM prior) AND NOT (before IS NULL AND after IS NULL)"""


def _strong(points: str, hundredths: int) -> str:
    """Points without weak ones; the minimum is given in hundredths of a percent."""
    return f"""
        SELECT * EXCLUDE (before, next) FROM (
          SELECT *, lag(at_) OVER w AS before, lead(cents) OVER w AS next FROM {points} WINDOW w AS (PARTITION BY code ORDER BY at_))
        WHERE (before IS NULL OR next IS NULL OR extreme
               OR CASE WHEN cents = 0 THEN next > 0 ELSE (20000 * abs(next - cents) + cents) // (2 * cents) > {hundredths} END)
          AND NOT (before IS NULL AND next IS NULL)"""


def _define_marked(name: str, level: str, term: int, hundredths: int) -> None:
    """CTE ``{name}_{level}_marked``: the minor points with their reversals marked."""
    define(f"{name}_{level}_list", f"""
        SELECT code, list(cents ORDER BY at_) AS c, list(at_ ORDER BY at_) AS r, count(*) AS m FROM {name}_minor GROUP BY code""")
    define(f"{name}_{level}_path", f"""
        SELECT code, CAST(0 AS BIGINT) AS at_, c[2] >= c[1] AS rising, CAST([] AS BIGINT[]) AS marks FROM {name}_{level}_list WHERE m >= 2
        UNION ALL
        SELECT code, CASE WHEN hi = lo THEN at_ + 2 ELSE greatest(hi, lo) END, CASE WHEN hi = lo THEN rising ELSE hi > lo END,
               CASE WHEN hi = lo THEN marks WHEN (hi > lo) <> rising THEN list_append(marks, least(hi, lo))
                    WHEN least(hi, lo) > at_ AND 10000 * abs(c[least(hi, lo) + 1] - c[at_ + 1]) > {hundredths} * c[at_ + 1]
                      THEN list_concat(marks, [at_, least(hi, lo)]) ELSE marks END
        FROM (SELECT *, at_ + list_position(s, list_max(s)) - 1 AS hi, at_ + list_position(s, list_min(s)) - 1 AS lo
              FROM (SELECT l.code, at_, rising, marks, c, c[at_ + 1 : len(list_filter(r, lambda x: x <= r[at_ + 2] + {term}))] AS s
                    FROM {name}_{level}_path p JOIN {name}_{level}_list l ON l.code = p.code WHERE r[at_ + 2] + {term} < r[m]))""")
    define(f"{name}_{level}_marked", f"""
        SELECT p.* EXCLUDE (extreme, k, n), k = 0 OR k = n - 1 OR list_contains(e.marks, k) AS extreme
        FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY at_) - 1 AS k, count(*) OVER (PARTITION BY code) AS n FROM {name}_minor) p
        JOIN (SELECT code, arg_max(marks, at_) AS marks FROM {name}_{level}_path GROUP BY code) e ON e.code = p.code""")


def _define_segments(name: str, points: str) -> None:
    """CTE ``{name}``: equal steps of a point list joined."""
    define(f"{name}_steps", f"""
        SELECT *, sum(CASE WHEN up IS DISTINCT FROM prior THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY at_) AS island
        FROM (SELECT *, lag(up) OVER (PARTITION BY code ORDER BY at_) AS prior
              FROM (SELECT *, CASE WHEN pc = 0 THEN cents > 0 ELSE cents >= pc OR 200 * (pc - cents) < pc END AS up
                    FROM (SELECT code, at_, cents, day, lag(cents) OVER w AS pc, lag(day) OVER w AS pd, lag(at_) OVER w AS pid
                          FROM ({points}) WINDOW w AS (PARTITION BY code ORDER BY at_)) WHERE pc IS NOT NULL))""")
    define(name, f"""
        SELECT code, island, arg_min(pd, at_) AS start_date, arg_max(day, at_) AS end_date, arg_min(pc, at_) AS pc, arg_max(cents, at_) AS ec,
               min(pid) AS start_id, max(at_) AS end_id, bool_and(up) AS up,
               CASE WHEN island = max(island) OVER (PARTITION BY code) THEN 0 ELSE 1 END AS train_flag
        FROM {name}_steps GROUP BY code, island""")


def _define_fixed(name: str, segments: str, base: str, as_of: str) -> None:
    """CTE ``{name}``: recent segments joined while they end on their side of the average of 250 rows."""
    define(f"{name}_judged", f"""
        SELECT s.*, date_diff('day', s.start_date, DATE '{as_of}') <= 560 AS recent, row_number() OVER (PARTITION BY s.code ORDER BY s.start_id) AS k,
               CASE WHEN s.end_id < 250 THEN 0 ELSE (2 * a.total + 250) // 500 END AS average
        FROM {segments} s JOIN (
          SELECT code, record_id, CAST(sum(cents) OVER (PARTITION BY code ORDER BY record_id ROWS 249 PRECEDING) AS BIGINT) AS total FROM {base}) a
        ON a.code = s.code AND a.record_id = s.end_id""")
    define(f"{name}_fold", f"""
        SELECT code, k, CASE WHEN recent THEN up END AS held, FALSE AS joins FROM {name}_judged WHERE k = 1
        UNION ALL
        SELECT code, k, CASE WHEN NOT recent THEN held WHEN held IS NULL THEN up WHEN fits THEN held ELSE NOT held END,
               recent AND held IS NOT NULL AND fits
        FROM (SELECT j.*, f.held, CASE WHEN f.held THEN j.ec >= j.average ELSE j.ec <= j.average END AS fits
              FROM {name}_fold f JOIN {name}_judged j ON j.code = f.code AND j.k = f.k + 1)""")
    define(name, f"""
        SELECT code, min(start_id) AS start_id, arg_min(start_date, k) AS start_date, sum(date_diff('day', start_date, end_date)) AS calendar_days,
               arg_min(pc, k) AS pc, arg_max(ec, k) AS ec, arg_min(train_flag, k) AS train_flag,
               sum(end_id - start_id) AS trading_days, arg_min(up, k) AS up
        FROM {name}_judged j
        JOIN (SELECT code, k, max(CASE WHEN NOT joins THEN k END) OVER (PARTITION BY code ORDER BY k) AS base FROM {name}_fold) f USING (code, k)
        GROUP BY code, base""")


_SEGMENT_COLUMNS = """
    code, CAST(start_date AS VARCHAR) AS start_date, CAST(calendar_days AS BIGINT) AS calendar_days, pc / 100.0 AS close, ec / 100.0 AS end_close,
    CAST(train_flag AS BIGINT) AS train_flag, CAST(start_id AS BIGINT) AS start_record_id, CAST(trading_days AS BIGINT) AS trading_days,
    CAST(sign(ec - pc) * ((200 * abs(ec - pc) + pc) // nullif(2 * pc, 0)) / 100.0 AS DOUBLE) AS change_rate,
    CASE WHEN up THEN '上升' ELSE '下降' END AS direction"""

define("pxa", """
    SELECT code, trade_date, close, CAST(close * 100 AS BIGINT) AS cents,
           row_number() OVER (PARTITION BY code ORDER BY trade_date) - 1 AS record_id FROM price_listed""")
_define_minor("xl", "pxl")
_define_marked("xl", "median", 36, 730)
_define_segments("xl_plain", _strong("xl_median_marked", 730))
_define_fixed("xl_fixed", "xl_plain", "pxl", "2001-08-01")
_define_minor("xa", "pxa")
_define_marked("xa", "median", 36, 730)
_define_marked("xa", "long", 400, 6000)
define("xa_median_merged", _merged("SELECT * FROM xa_median_marked"))
define("xa_long_merged", _merged("SELECT * FROM xa_long_marked"))
_define_segments("xa_median_segments", _strong("xa_median_merged", 730))
_define_segments("xa_long_segments", _strong("xa_long_merged", 6000))
_define_fixed("xa_long_fixed", "xa_long_segments", "pxa", "2001-08-01")


@job("pivots_minor", """
    WITH RECURSIVE found AS (
      SELECT code, seq AS pivot_seq, at_ AS record_id, CAST(day AS VARCHAR) AS trade_date, cents / 100.0 AS close,
             CAST(ascending AS BIGINT) AS ascending FROM xl_points)
    SELECT * FROM found""")
def _pivots_minor(c):
    df = P.find_pivots(c.price_long(), TERM)
    return present(df.withColumn("ascending", F.col("ascending").cast("bigint")))


@job("mark_extremes", """
    WITH RECURSIVE found AS (
      SELECT code, seq AS pivot_seq, at_ AS record_id, CAST(day AS VARCHAR) AS trade_date, cents / 100.0 AS close,
             CAST(ascending AS BIGINT) AS ascending, extreme FROM xl_median_marked)
    SELECT * FROM found""")
def _mark_extremes(c):
    minor = trend_job.minor_pivots(c.price_long(), S.TREND_SETTINGS)
    df = P.mark_extremes(minor, 36, 7.3)
    return present(df.withColumn("ascending", F.col("ascending").cast("bigint")))


@job("long_trend_fix", f"""
    WITH RECURSIVE found AS (SELECT {_SEGMENT_COLUMNS} FROM xl_fixed)
    SELECT * FROM found""")
def _long_trend_fix(c):
    prices = c.price_long()
    listed = S.drop_weak_pivots(
        P.mark_extremes(trend_job.minor_pivots(prices, S.TREND_SETTINGS), 36, 7.3), 7.3
    )
    segs = S.trend_segments(listed, order="pivot_seq").withColumn(
        "end_date", F.expr("date_add(start_date, cast(calendar_days as int))")
    )
    with_ma = S.averages_at_segment_end(segs, S.moving_averages(prices, {"long_ma": 250}))
    return present(P.fix_recent_long_trends(with_ma, "2001-08-01", 560, S.UP, S.DOWN))


@job("index_trend_report", f"""
    WITH RECURSIVE found AS (
      SELECT '{trend_job.LONG}' AS trend_name, {_SEGMENT_COLUMNS} FROM xa_long_fixed
      UNION ALL
      SELECT '{trend_job.MEDIAN}', {_SEGMENT_COLUMNS}
      FROM (SELECT *, date_diff('day', start_date, end_date) AS calendar_days, end_id - start_id AS trading_days FROM xa_median_segments))
    SELECT * FROM found""")
def _index_trend_report(c):
    return present(trend_job.trend_report(c.price_listed(), as_of="2001-08-01"))


# ---- one series of all ticks -------------------------------------------------------------

define("pxt", """
    SELECT 'all' AS code, ts AS trade_date, event_id, CAST(close * 100 AS BIGINT) AS cents, row_number() OVER (ORDER BY ts, event_id) - 1 AS record_id
    FROM ticks""")
_define_minor("xt", "pxt")
define("tick_sums", "SELECT *, CAST(sum(cents) OVER (ORDER BY record_id) AS BIGINT) AS run FROM pxt")


def _one_series(c):
    return c.ticks().withColumn("code", F.lit("all"))


@job("moving_averages_long", """
    SELECT CAST(event_id AS BIGINT) AS event_id, CAST(record_id AS BIGINT) AS record_id, run / 100.0 AS running_sum,
           CASE WHEN record_id < 30 THEN 0 ELSE (2 * (run - lag(run, 30) OVER w) + 30) // 60 END / 100.0 AS short_ma,
           CASE WHEN record_id < 250 THEN 0 ELSE (2 * (run - lag(run, 250) OVER w) + 250) // 500 END / 100.0 AS long_ma
    FROM tick_sums WINDOW w AS (ORDER BY record_id)""")
def _moving_averages_long(c):
    """Running sum and averages of a series that holds all rows of the table."""
    df = L.moving_averages(_one_series(c), {"short_ma": 30, "long_ma": 250}, ["ts", "event_id"])
    return present(df, "event_id", "record_id", "running_sum", "short_ma", "long_ma")


@job("pivots_long", """
    WITH RECURSIVE found AS (
      SELECT seq AS pivot_seq, at_ AS record_id, cents / 100.0 AS close, CAST(ascending AS BIGINT) AS ascending FROM xt_points)
    SELECT * FROM found""")
def _pivots_long(c):
    """Turning points of a series that holds all rows of the table."""
    df = L.find_pivots(_one_series(c), TERM, ["ts", "event_id"])
    return present(df.withColumn("ascending", F.col("ascending").cast("bigint")), "pivot_seq", "record_id", "close", "ascending")
