"""Series cut into pieces against the forms that give each code to one task."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import long_series as L
from tidemark.operators import pivots as P
from tidemark.operators import series as S


def walk(rng, n, flat):
    out, close = [], 50.0
    while len(out) < n:
        close = max(1.0, close + rng.choice([-3, -2, -1, 0, 0, 1, 2, 3]))
        out += [close] * (rng.choice([1, 1, 1, 2, 40]) if flat else 1)
    return out[:n]


@pytest.fixture(scope="module")
def prices(spark):
    rng = random.Random(8)
    sizes = {"one": 1, "two": 2, "block": 64, "next": 65, "some": 200, "hot": 3000}
    series = {f"{c}{f}": walk(rng, n, f) for c, n in sizes.items() for f in (False, True)} | {"equal": [7.0] * 300}
    rows = [(c, date(2000, 1, 1) + timedelta(days=i + i // 5 * 2), v) for c, values in series.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "code string, trade_date date, close double")
    return df.withColumn("close", F.col("close").cast("decimal(18,4)")).cache()


def rows_of(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


def test_records_and_running_sums(prices):
    columns = ("code", "trade_date", "record_id", "running_sum")
    assert rows_of(L.with_records(prices), *columns) == rows_of(S.with_running_sum(S.with_record_id(prices)), *columns)


@pytest.mark.parametrize("block", [40, 64, 1 << 14])
def test_moving_averages(prices, block):
    terms = {"a": 3, "b": 40}
    columns = ("code", "trade_date", "record_id", "a", "b")
    assert rows_of(L.moving_averages(prices, terms, block=block), *columns) == rows_of(S.moving_averages(prices, terms), *columns)


@pytest.mark.parametrize("term, block", [(3, 3), (7, 10), (14, 64), (14, 1 << 14)])
def test_turning_points(prices, term, block):
    columns = ("code", "pivot_seq", "record_id", "trade_date", "close", "ascending")
    assert rows_of(L.find_pivots(prices, term, block=block), *columns) == rows_of(P.find_pivots(prices, term), *columns)


def test_no_rows(prices):
    none = prices.limit(0)
    assert L.moving_averages(none, {"a": 3}).count() == 0 and L.find_pivots(none, 3).count() == 0


def test_blocks_must_hold_what_they_lend(prices):
    with pytest.raises(ValueError):
        L.with_blocks(L.with_records(prices), 5, before=6)


def test_one_code_is_no_single_task(spark):
    """Of a table with one code, no piece and no block holds more than a small share."""
    rows = spark.range(20000).select(F.lit("all").alias("code"), F.col("id").alias("at"), (F.col("id") % 17).cast("decimal(18,4)").alias("close"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        records = L.with_records(rows, ["at"])
        per_task = records.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        blocks = L.with_blocks(records, 500, before=14).groupBy("code", "_block").count().agg(F.max("count")).first()[0]
        shares = rows.repartitionByRange("code", "at").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) > 1 and max(r["count"] for r in shares) < 20000 * 0.5 and per_task < 20000
    assert blocks <= 514


def test_order_of_several_columns(spark):
    rng = random.Random(4)
    rows = [("all", i // 7, i % 7, float(rng.randint(1, 30))) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "code string, ts long, event_id long, close double").withColumn("close", F.col("close").cast("decimal(18,4)"))
    got = L.find_pivots(df, 5, ["ts", "event_id"], block=20)
    assert got.columns == ["code", "pivot_seq", "record_id", "ts", "event_id", "close", "ascending"]
    daily = df.withColumn("trade_date", F.expr("date_add(DATE '2000-01-01', cast(row_number() over (partition by code order by ts, event_id) as int))"))
    assert rows_of(got, "pivot_seq", "record_id", "close") == rows_of(P.find_pivots(daily, 5), "pivot_seq", "record_id", "close")
