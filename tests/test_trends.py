"""Trend steps against small plain-Python models and their invariants."""

import itertools
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pivots as P
from tidemark.operators import series as S
from tidemark.plans import trend_job


def walk(rng, n):
    close, out = 100.0, []
    for _ in range(n):
        close = max(1.0, round(close * (1 + rng.uniform(-0.04, 0.04)), 2))
        out.append(close)
    return out


def frame(spark, series):
    rows = [
        (code, date(2020, 1, 1) + timedelta(days=i + i // 5 * 2), float(v))
        for code, values in series.items()
        for i, v in enumerate(values)
    ]
    df = spark.createDataFrame(rows, "code string, trade_date date, close double")
    return df.withColumn("close", F.col("close").cast("decimal(18,4)"))


def pivots_by_window(close, term):
    """Turning points by looking at whole windows; a flat window moves the point behind it."""
    n = len(close)
    if n < 2:
        return []

    def turn(at, window):
        top = max(window, key=lambda i: (close[i], -i))
        bottom = min(window, key=lambda i: (close[i], i))
        first, second = sorted((top, bottom))
        return second if first == at else first

    pivots = [0]
    while pivots[-1] + term < n:
        at = pivots[-1]
        found = turn(at, range(at, at + term))
        if found == at:
            pivots[-1] = at + term
        else:
            pivots.append(found)
    found = turn(pivots[-1], range(pivots[-1], n))
    for last in (found, n - 1):
        if last != pivots[-1]:
            pivots.append(last)
    return pivots


def extremes_by_stretch(record, close, term, min_rate):
    """Numbers of the marked points, by walking the list."""
    n, marked = len(close), {0, len(close) - 1}
    rising, at = close[1] >= close[0], 0
    while at + 1 < n and record[at + 1] + term < record[-1]:
        stretch = [i for i in range(at, n) if record[i] <= record[at + 1] + term]
        low = min(stretch, key=lambda i: (close[i], i))
        high = max(stretch, key=lambda i: (close[i], -i))
        if low == high:
            at += 2
            continue
        begin, end, up = min(low, high), max(low, high), high > low
        if up != rising:
            marked.add(begin)
        elif begin > at and abs(close[begin] - close[at]) * 100 > min_rate * close[at]:
            marked |= {at, begin}
        rising, at = up, end
    return marked


def stepped(rng, n):
    """A walk with flat stretches and repeated values."""
    out, close = [], 50.0
    while len(out) < n:
        close = max(1.0, close + rng.choice([-3, -2, -1, 0, 0, 1, 2, 3]))
        out += [close] * rng.choice([1, 1, 1, 2, 9])
    return out[:n]


def test_turning_points_equal_window_search(spark):
    rng = random.Random(3)
    for term in (3, 7, 14):
        series = {f"w{i}": walk(rng, rng.randint(1, 200)) for i in range(25)} | {f"s{i}": stepped(rng, rng.randint(1, 150)) for i in range(25)}
        series |= {"flat": [5.0] * 8, "pair": [5.0, 6.0], "fall": [6.0, 5.0], "one": [5.0], "rise": [float(x) for x in range(1, 11)]}
        rows = P.find_pivots(frame(spark, series), term).orderBy("code", "pivot_seq").collect()
        for code, close in series.items():
            mine = [r for r in rows if r["code"] == code]
            want = pivots_by_window(close, term)
            assert [r["record_id"] for r in mine] == want, (code, term, close)
            assert [r["pivot_seq"] for r in mine] == list(range(len(want)))
            assert [r["ascending"] for r in mine] == [close[b] >= close[a] for a, b in zip(want, want[1:])] + [None] * bool(want)


def test_extremes_equal_stretches(spark):
    rng = random.Random(5)
    lists = {"short": ([0, 10, 20, 30, 40, 90, 140], [10, 14, 12, 18, 11, 16, 9.0]), "two": ([0, 5], [1.0, 2.0])}
    for i in range(60):
        m = rng.randint(2, 60)
        record = list(itertools.accumulate([0] + [rng.randint(1, 30) for _ in range(m - 1)]))
        lists[f"c{i}"] = (record, walk(rng, m) if i % 2 else stepped(rng, m))
    rows = [(c, k, r, date(2020, 1, 1) + timedelta(days=r), float(x), True) for c, (rec, val) in lists.items() for k, (r, x) in enumerate(zip(rec, val))]
    df = spark.createDataFrame(rows, "code string, pivot_seq long, record_id long, trade_date date, close double, ascending boolean")
    df = df.withColumn("close", F.col("close").cast("decimal(18,4)"))
    for term in (20, 36, 400):
        got = {(r["code"], r["pivot_seq"]) for r in P.mark_extremes(df, term, 7.3).where("extreme").collect()}
        assert got == {(c, k) for c, (rec, val) in lists.items() for k in extremes_by_stretch(rec, val, term, 7.3)}
    one = P.mark_extremes(df.where("code = 'two' AND pivot_seq = 0"), 36, 7.3).collect()
    assert [r["extreme"] for r in one] == [False]


def fold(spark, rows):
    """Segments (day, close, end close, direction, average) of one code; those from day 100 on are recent."""
    data = [
        ("a", date(2020, 1, 1) + timedelta(days=d), 10, float(c), float(e), 1, d, 10, 0.0, way, None if ma is None else float(ma))
        for d, c, e, way, ma in rows
    ]
    df = spark.createDataFrame(
        data, "code string, start_date date, calendar_days long, close double, end_close double, train_flag long, "
        "start_record_id long, trading_days long, change_rate double, direction string, end_ma double")
    for c, kind in (("close", "decimal(18,4)"), ("end_close", "decimal(18,4)"), ("change_rate", "decimal(18,2)"), ("end_ma", "decimal(18,2)")):
        df = df.withColumn(c, F.col(c).cast(kind))
    out = P.fix_recent_long_trends(df, "2020-07-19", 100, S.UP, S.DOWN)
    assert "end_ma" not in out.columns and "recent" not in out.columns
    return out.orderBy("start_record_id").collect()


def test_recent_long_trends_fold(spark):
    out = fold(spark, [
        (1, 10, 20, S.UP, None), (2, 20, 15, S.DOWN, None), (103, 15, 22, S.UP, None),
        (104, 22, 21, S.DOWN, 18),  # still above the average: joins the rise
        (105, 21, 17, S.DOWN, 18),  # below it: the trend has turned
        (106, 17, 17.5, S.UP, 18),  # still below: joins the fall
    ])
    assert [r["start_record_id"] for r in out] == [1, 2, 103, 105]
    assert out[2]["end_close"] == 21 and out[2]["trading_days"] == 20 and float(out[2]["change_rate"]) == 0.4
    assert out[3]["end_close"] == 17.5 and out[3]["direction"] == S.DOWN and out[3]["calendar_days"] == 20


def test_long_trend_without_average_stays_apart(spark):
    assert len(fold(spark, [(101, 10, 12, S.UP, None), (102, 12, 11, S.DOWN, None)])) == 2


def test_report_is_one_exchange_by_code_without_python(spark, sf_dir):
    from tidemark.sources.catalog import Catalog

    daily = Catalog(spark, sf_dir).price_listed()
    report = trend_job.trend_report(daily, as_of="2001-08-01")
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the daily closes, and their series by code
    for node in ("Python", "Pandas", "Arrow", "Window", "Join"):
        assert node not in plan, node


@pytest.fixture(scope="module")
def prices(spark):
    rng = random.Random(11)
    series = {f"c{i}": walk(rng, n) for i, n in enumerate([1, 2, 60, 180, 400])}
    series["flat"] = [7.0] * 40
    series["rise"] = [float(x) for x in range(10, 50)]
    series["tiny_fall"] = [100.0, 99.6, 103.0, 104.0]
    return frame(spark, series).cache()


def test_segments_tile_each_series(prices):
    segments = S.trend_segments(S.with_record_id(prices)).collect()
    last = {r["code"]: r["n"] for r in prices.groupBy("code").agg((F.count("*") - 1).alias("n")).collect()}
    by_code = {}
    for s in segments:
        by_code.setdefault(s["code"], []).append(s)
    assert "c0" not in by_code  # one row makes no trend
    for code, rows in by_code.items():
        rows.sort(key=lambda r: r["start_record_id"])
        assert sum(r["trading_days"] for r in rows) == last[code]
        assert all(a["direction"] != b["direction"] for a, b in zip(rows, rows[1:]))
        assert all(a["end_close"] == b["close"] for a, b in zip(rows, rows[1:]))
        assert [r["train_flag"] for r in rows] == [1] * (len(rows) - 1) + [0]


def test_small_fall_counts_as_rise(prices):
    rows = S.trend_segments(S.with_record_id(prices.where("code = 'tiny_fall'"))).collect()
    assert len(rows) == 1 and rows[0]["direction"] == S.UP


def test_tiny_trends_model(prices):
    got = {(r["code"], r["record_id"]): r["ascending"] for r in S.tiny_trends(prices).collect()}
    data = {}
    for r in prices.orderBy("code", "trade_date").collect():
        data.setdefault(r["code"], []).append(float(r["close"]))
    want = {}
    for code, close in data.items():
        if len(close) < 2:
            continue
        ups = [b >= a for a, b in zip(close, close[1:])]
        want[(code, 0)] = ups[0]
        for i, up in enumerate(ups):
            if i + 1 == len(ups) or ups[i + 1] != up:
                want[(code, i + 1)] = up
    assert got == want


def test_averages_start_after_term(prices):
    rows = S.moving_averages(prices.where("code = 'rise'"), {"ma": 5}).orderBy("record_id").collect()
    assert [float(r["ma"]) for r in rows[:6]] == [0, 0, 0, 0, 0, 13.0]


def test_report_runs_per_code_and_keeps_order(prices):
    report = trend_job.trend_report(prices, as_of="2022-01-01").collect()
    assert {r["trend_name"] for r in report} == {trend_job.MEDIAN, trend_job.LONG}
    for name in (trend_job.MEDIAN, trend_job.LONG):
        rows = sorted((r for r in report if r["code"] == "c4" and r["trend_name"] == name), key=lambda r: r["start_record_id"])
        assert sum(r["trading_days"] for r in rows) == 399


def test_report_overrides_mark_pivots(prices, spark):
    minor = trend_job.minor_pivots(prices, S.TREND_SETTINGS)
    some = minor.where("code = 'c4'").orderBy("pivot_seq").collect()[2]
    manual = spark.createDataFrame([("c4", some["trade_date"], True)], "code string, trade_date date, extreme boolean")
    marked = S.override_pivots(P.mark_extremes(minor, 36, 7.3), manual)
    assert marked.where(F.col("code") == "c4").where(F.col("trade_date") == some["trade_date"]).first()["extreme"]


def test_as_of_average_on_missing_day(spark):
    averages = spark.createDataFrame(
        [("a", date(2020, 1, 3), 1.0), ("a", date(2020, 1, 6), 2.0)], "code string, trade_date date, long_ma double"
    )
    ends = spark.createDataFrame(
        [("a", date(2020, 1, 5)), ("a", date(2020, 1, 6)), ("a", date(2020, 1, 1))], "code string, end_date date"
    )
    got = {r["end_date"].day: r["end_ma"] for r in S.averages_at_segment_end(ends, averages).collect()}
    assert float(got[5]) == 1.0 and float(got[6]) == 2.0 and got[1] is None


def test_minimum_change_of_a_single_code(spark, prices):
    from tidemark.plans import trend_job as J

    rows = lambda df: sorted(map(str, df.collect()))
    settings = {"min_minor_rate": 40.0, "min_median_rate": 50.0, "min_long_rate": 90.0}
    plain = J.trend_report(prices, "2024-02-01")
    strict = J.trend_report(prices, "2024-02-01", settings)
    own = [("短期趋势", "c4", 40.0), ("中期趋势", "c4", 50.0), ("长期趋势", "c4", 90.0)]
    mixed = J.trend_report(prices, "2024-02-01", rates=spark.createDataFrame(own, "trend_name string, code string, min_rate double"))
    assert rows(mixed.where("code <> 'c4'")) == rows(plain.where("code <> 'c4'"))
    assert rows(mixed.where("code = 'c4'")) == rows(strict.where("code = 'c4'"))
