"""Daily feed into a stored table: newer than the high-water mark per key, late rows dropped.

Each micro-batch writes its own folder, ``rows/batch=N`` and ``marks/batch=N``, with overwrite.  A
batch run again after a failure replaces exactly what it wrote before, and only the marks of the
batch before it are read, so the cost of a batch does not grow with the table.  Older row folders are
merged, older marks deleted, once no batch can need them any more (see ``folders``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.readers import existing_paths
from tidemark.sources.sinks import append_newer
from tidemark.streaming import folders

SEED = "seed"


def seed_store(stored: DataFrame, root: str, key: str, stamp: str) -> None:
    """Stores rows the feed starts from, and their marks."""
    stored.write.mode("overwrite").parquet(f"{root}/rows/batch={SEED}")
    marks = stored.sparkSession.read.parquet(f"{root}/rows/batch={SEED}").groupBy(key).agg(F.max(stamp).alias(stamp))
    marks.write.mode("overwrite").parquet(f"{root}/marks/batch={SEED}")


def _marks_before(spark: SparkSession, root: str, batch_id: int) -> str:
    """Folder of the newest marks older than this batch (every batch writes its own)."""
    name = SEED if batch_id == 0 else str(batch_id - 1)
    return f"{root}/marks/batch={name}"


def append_batch(root: str, key: str, stamp: str, unique: str | None = None, every: int = folders.EVERY):
    """``foreachBatch`` writer for the feed.

    Rows repeated within a batch are dropped here; one repeated in a later batch is not newer than the mark of its key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _marks_before(spark, root, batch_id)
        known = existing_paths(spark, [before])
        if batch_id > 0 and not known:
            raise FileNotFoundError(f"marks of the batch before {batch_id} are missing: {before}")
        batch = batch.dropDuplicates([unique]) if unique else batch
        rows = f"{root}/rows/batch={batch_id}"
        if known:
            marks = spark.read.parquet(before)
            fresh = append_newer(marks, batch, key, stamp)
        else:
            fresh = batch
        fresh.write.mode("overwrite").parquet(rows)
        landed = spark.read.parquet(rows).groupBy(key).agg(F.max(stamp).alias(stamp))
        merged = landed if not known else spark.read.parquet(before).unionByName(landed).groupBy(key).agg(F.max(stamp).alias(stamp))
        merged.write.mode("overwrite").parquet(f"{root}/marks/batch={batch_id}")
        # this batch may run again, with the marks of the one before; what is older is final
        folders.merge(spark, f"{root}/rows", batch_id - 1, every)
        folders.drop_before(spark, f"{root}/marks", batch_id - 1)

    return write


def run_incremental(
    feed: DataFrame, root: str, key: str, stamp: str, unique: str, delay: str | None = None, event_time: str | None = None,
    every: int = folders.EVERY,
) -> StreamingQuery:
    """Starts the feed.

    Only the mark of a row's own key decides whether it is late.  A ``delay`` sets a watermark over all keys besides; what lags the newest
    row by more is then lost, whatever its key.
    """
    clean = feed
    if delay is not None:
        clean = feed.withWatermark(event_time or stamp, delay).dropDuplicatesWithinWatermark([unique])
    return (
        clean.writeStream.foreachBatch(append_batch(root, key, stamp, unique, every))
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """All stored rows."""
    return folders.read(spark, f"{root}/rows")
