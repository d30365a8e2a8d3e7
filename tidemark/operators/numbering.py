"""Exact running totals and positions over a whole table, without gathering it in one task.

Only keys and weights are put in order: dealt into ranges by sampled bounds, so the ranges are of even size however sparse or crowded the keys
are, and stored, so that a task run again finds the same ranges.  Each range's total is one row; a scan of these few rows gives what lies before a
range, a window inside the range does the rest.  The table itself moves once, when the answer is joined to it by key, or not at all
where Spark finds the answer small enough to send around.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

#: Rows of one bucket of a random order, about.
BUCKET_ROWS = 1 << 13


@dataclass(frozen=True)
class Ranges:
    """Stored rows (key, _w, _range): the number of a range ascends with the key, a key stands in one range."""

    rows: DataFrame
    key: str

    def total(self) -> int:
        return self.rows.agg(F.coalesce(F.sum("_w"), F.lit(0))).first()[0]

    def offsets(self, name: str, weight: str = "_w") -> DataFrame:
        """(key, name, weight): the sum of the weights of all smaller keys, and the key's own."""
        before = (Window.unboundedPreceding, -1)
        totals = self.rows.groupBy("_range").agg(F.sum("_w").alias("_t"))
        starts = totals.select("_range", F.coalesce(F.sum("_t").over(Window.orderBy("_range").rowsBetween(*before)), F.lit(0)).alias("_start"))
        inside = F.sum("_w").over(Window.partitionBy("_range").orderBy(self.key).rowsBetween(*before))
        # one row per shuffle partition
        placed = self.rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(starts), "_range")
        return placed.select(self.key, (F.col("_start") + F.col("_inside")).cast("bigint").alias(name), F.col("_w").alias(weight))


def in_ranges(table: DataFrame, key: str, weight: Column) -> Ranges:
    """Keys (unique) and weights of a table, dealt by sampled bounds and stored.

    They are stored once before, too, so that drawing the sample does not read the table a second time.
    """
    slim = materialise(table.select(key, F.coalesce(weight.cast("bigint"), F.lit(0)).alias("_w")), "keys")
    return Ranges(materialise(slim.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranges"), key)


def with_offset(table: DataFrame, key: str, weight: Column | str, name: str = "offset") -> DataFrame:
    """Adds the sum of ``weight`` over all rows with a smaller ``key`` (unique)."""
    amount = F.expr(weight) if isinstance(weight, str) else weight
    return table.join(in_ranges(table, key, amount).offsets(name).drop("_w"), key)


def with_position(table: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Adds the position, from 0, in ascending order of a unique key."""
    return with_offset(table, key, F.lit(1), name)


def with_shuffled_rank(table: DataFrame, key: str, seed: int, name: str = "rank", keys: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Adds the position of each row in a seeded random order.

    The order is that of a digest of seed and key.  Its first 32 bits cut even buckets of some ``BUCKET_ROWS`` rows; the table is dealt by bucket once
    and numbered inside.  ``keys`` may hold the same keys in a form that is cheaper to read than the table, ``rows`` their number.
    """
    slim = (table if keys is None else keys).select(key)
    n = slim.count() if rows is None else rows
    buckets = min(max(1, -(-n // BUCKET_ROWS)), (1 << 31) - 1)

    def bucketed(df: DataFrame) -> DataFrame:
        digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
        df = df.withColumn("_digest", digest)
        return df.withColumn("_bucket", F.shiftright(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("bigint") * buckets, 32))

    counts = bucketed(slim).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = in_ranges(counts, "_bucket", F.col("_n")).offsets("_first")
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", key)) - 1
    placed = bucketed(table).withColumn("_inside", inside).join(starts, "_bucket")
    return placed.withColumn(name, (F.col("_first") + F.col("_inside")).cast("bigint")).drop("_digest", "_bucket", "_first", "_inside", "_w")
