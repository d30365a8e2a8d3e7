"""Streaming queries: the events table replayed as a file feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.registry import job
from tidemark.registry.present import present
from tidemark.session import materialise, shared_dir
from tidemark.streaming import incremental as I
from tidemark.streaming import moving_average as A
from tidemark.streaming import row_average as B


def feed(c):
    """Ticks as a stream of files (the pattern takes a single file as well as a folder of them)."""
    path = f"{c.root}/events.parque[t]"
    schema = c.table("events").schema
    raw = c.spark.readStream.schema(schema).parquet(path)
    return raw.select(
        F.col("user_id").cast("string").alias("code"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("value").cast("decimal(18,4)").alias("close"),
    )


@job("stream_incremental", """
    SELECT code, event_id, CAST(close AS DOUBLE) AS close FROM stored_ticks
    UNION ALL
    SELECT b.code, b.event_id, CAST(b.close AS DOUBLE) FROM batch_ticks b
    LEFT JOIN (SELECT code, max(ts) AS mark FROM stored_ticks GROUP BY code) m ON m.code = b.code
    WHERE mark IS NULL OR b.ts > mark""")
def _incremental(c):
    root = shared_dir(c.spark, "tick-store")
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    stored = c.ticks().where(F.col("ts") < cut).withColumn("ts", F.col("ts").cast("timestamp"))
    I.seed_store(stored, root, "code", "ts")
    late = feed(c).where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp"))
    I.run_incremental(late, root, "code", "ts", "event_id").awaitTermination()
    return present(I.read_store(c.spark, root), "code", "event_id", "close")


_DAYS = ("2024-01-15", "2024-01-17", "2024-01-20", "2024-01-21", "2024-01-24", "2024-01-26", "2024-01-29", "2024-02-02", "2100-01-01")


@job("stream_batches", """
    SELECT code, event_id, CAST(close AS DOUBLE) AS close FROM stored_ticks
    UNION ALL
    SELECT b.code, b.event_id, CAST(b.close AS DOUBLE) FROM batch_ticks b
    LEFT JOIN (SELECT code, max(ts) AS mark FROM stored_ticks GROUP BY code) m ON m.code = b.code
    WHERE mark IS NULL OR b.ts > mark""")
def _batches(c):
    """The feed in many batches, older ones merged: the ticks of a few days land as one file after the other."""
    root, landed = shared_dir(c.spark, "tick-store"), shared_dir(c.spark, "landed-ticks")
    ticks = c.ticks().withColumn("ts", F.col("ts").cast("timestamp"))
    I.seed_store(ticks.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp")), root, "code", "ts")
    for since, until in zip(_DAYS, _DAYS[1:]):
        part = ticks.where((F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("ts") < F.lit(until).cast("timestamp")))
        part.coalesce(1).write.mode("append").parquet(landed)
    arriving = c.spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    I.run_incremental(arriving, root, "code", "ts", "event_id", every=3).awaitTermination()
    return present(I.read_store(c.spark, root), "code", "event_id", "close")


@job("stream_moving_avg", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, CAST(sum(total) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE) AS average,
           CAST(sum(n) OVER w AS BIGINT) AS n
    FROM (SELECT code, CAST(ts AS DATE) AS trade_date, sum(close) AS total, count(*) AS n FROM ticks GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY code ORDER BY trade_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)""")
def _moving(c):
    root = shared_dir(c.spark, "tick-days")
    A.store_daily(feed(c), root).awaitTermination()
    return present(A.moving_average(A.current_days(c.spark, root), 7))


@job("stream_row_average", """
    SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, CAST(record_id AS BIGINT) AS record_id, CAST(close AS DOUBLE) AS close,
           short_c / 100.0 AS short_ma, median_c / 100.0 AS median_ma, long_c / 100.0 AS long_ma FROM avg_long""")
def _row_average(c):
    """Averages by rows on a feed: the daily closes of a year land as one file after the other."""
    root, landed = shared_dir(c.spark, "row-averages"), shared_dir(c.spark, "landed-closes")
    prices = materialise(c.price_long(), "closes")
    years = prices.agg(F.min(F.year("trade_date")).alias("a"), F.max(F.year("trade_date")).alias("b")).first()
    for year in range(years["a"], years["b"] + 1):
        prices.where(F.year("trade_date") == year).coalesce(1).write.mode("append").parquet(landed)
    arriving = c.spark.readStream.schema(prices.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    B.store_averages(arriving, root, {"short_ma": 30, "median_ma": 150, "long_ma": 250}, every=3).awaitTermination()
    return present(B.read_averages(c.spark, root))
