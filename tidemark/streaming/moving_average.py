"""Moving averages on a price feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.streaming import folders


def sliding_average(feed: DataFrame, span: str = "30 days", step: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Average close per code over sliding time windows, for append sinks.

    Ticks are first summed per code and step, so a tick enters one state row and not one for each
    window that covers it; the sliding windows then combine the daily rows.
    """
    daily = (
        feed.withWatermark("ts", delay)
        .groupBy(F.window("ts", step), "code")
        .agg(F.sum("close").alias("total"), F.count("close").alias("n"))
    )
    return (
        daily.groupBy(F.window(F.window_time("window"), span, step), "code")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        .select("code", F.col("window.end").alias("as_of"), (F.col("total") / F.col("n")).alias("average"), "n")
    )


def daily_totals(feed: DataFrame, delay: str = "1 day") -> DataFrame:
    """Running sum and count of closes per code and day."""
    return (
        feed.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("day"), "code")
        .agg(F.sum("close").alias("total"), F.count("close").alias("n"))
        .select("code", F.col("day.start").cast("date").alias("trade_date"), "total", "n")
    )


def newest(rows: DataFrame) -> DataFrame:
    """The row of the newest batch per code and day."""
    picked = rows.groupBy("code", "trade_date").agg(F.max_by(F.struct("total", "n"), "seq").alias("_row"), F.max("seq").alias("seq"))
    return picked.select("code", "trade_date", "_row.total", "_row.n", "seq")


def store_daily(feed: DataFrame, root: str, delay: str = "1 day", every: int = folders.EVERY) -> StreamingQuery:
    """Keeps daily totals up to date; each micro-batch stores the days it changed, older batches are merged to the newest rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("seq", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{root}/days/batch={batch_id}")
        folders.merge(batch.sparkSession, f"{root}/days", batch_id - 1, every, newest)

    return (
        daily_totals(feed, delay)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def current_days(spark: SparkSession, root: str) -> DataFrame:
    """Latest totals per code and day."""
    return newest(folders.read(spark, f"{root}/days")).drop("seq")


def moving_average(days: DataFrame, span_days: int) -> DataFrame:
    """Average tick of the last ``span_days`` calendar days, per code and day."""
    at = F.date_diff("trade_date", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("code").orderBy(at).rangeBetween(-(span_days - 1), 0)
    total, n = F.sum("total").over(w), F.sum("n").over(w)
    return days.select("code", "trade_date", (total.cast("double") / n).alias("average"), n.alias("n"))
