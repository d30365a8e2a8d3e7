"""Sinks: pure functions old × batch → new, and the file writers that store their result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.readers import existing_paths


def upsert_by_keyset(stored: DataFrame, batch: DataFrame, keys: Sequence[str], exact: bool = False) -> DataFrame:
    """Stored rows without the batch's keys, plus the batch.

    By default a stored row goes when *every one* of its key columns holds some value of the
    batch, which removes the cross product of the batch's key values.  The product itself is
    never formed: each key column is looked up in its own distinct value list.  ``exact=True``
    removes only the batch's own key tuples.
    """
    if exact:
        kept = stored.join(batch.select(*keys).distinct(), list(keys), "left_anti")
        return kept.unionByName(batch)
    flagged = stored
    for i, key in enumerate(keys):
        values = batch.select(key).where(F.col(key).isNotNull()).distinct().withColumn(f"_hit{i}", F.lit(True))
        flagged = flagged.join(values, key, "left")
    doomed = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_hit{i}"), F.lit(False)) for i in range(len(keys))])
    return flagged.where(~doomed).select(*stored.columns).unionByName(batch.select(*stored.columns))


def append_newer(stored: DataFrame, batch: DataFrame, key: str, stamp: str) -> DataFrame:
    """Batch rows newer than the stored high-water mark of their key; late rows are dropped."""
    marks = stored.groupBy(key).agg(F.max(stamp).alias("_mark"))
    return (
        batch.join(marks, key, "left")
        .where(F.col("_mark").isNull() | (F.col(stamp) > F.col("_mark")))
        .drop("_mark")
    )


def insert_unseen(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Batch rows whose key is not stored yet."""
    return batch.join(stored.select(*keys), list(keys), "left_anti")


def merge_ledger(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Union of two ledgers keeping the last row per key, newest batch last.

    The choice is an aggregate (partial maxima before the shuffle), so a key repeated without
    end costs one row per map task.
    """
    tagged = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    picked = tagged.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("_batch", order)).alias("_last")
    )
    return picked.select(*keys, "_last.*").select(*old.columns)


def ledger_add(ledger: DataFrame, items: DataFrame) -> DataFrame:
    return ledger.unionByName(items).distinct()


def ledger_remove(ledger: DataFrame, items: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ledger.join(items.select(*keys), list(keys), "left_anti")


def sorted_export(table: DataFrame, unique: str = "code") -> DataFrame:
    """Rows by kind and code run together, ties by code so that range partitions stay even."""
    return table.orderBy(F.concat("kind", "code"), unique)


# ---- declared schemas ------------------------------------------------------------------

# Declared column types of the report tables.
DECLARED_TYPES = {
    "INTEGER": T.StringType(),  # company codes keep their leading zeros
    "DATE": T.StringType(),
    "NUMERIC": T.DecimalType(38, 4),
}


def declared_type(text: str) -> T.DataType:
    head = text.strip().upper().split("(")[0].split(" ")[0]
    return DECLARED_TYPES.get(head, T.StringType())


def table_schema(
    key_columns: Mapping[str, str],
    header_columns: Sequence[str],
    measures: Sequence[str],
    measure_type: str = "NUMERIC",
) -> tuple[T.StructType, list[str]]:
    """Schema from configuration: keys, text columns made from headers, typed measures.

    A key column is one declared NOT NULL.  Repeated measure names get the suffix 1, 2, …
    Returns the schema and its key columns.
    """
    seen: dict[str, int] = {}
    fields: list[T.StructField] = []
    keys: list[str] = []
    for name, declared in key_columns.items():
        is_key = "NOT NULL" in declared.upper()
        fields.append(T.StructField(name, declared_type(declared), not is_key))
        if is_key:
            keys.append(name)
    fields += [T.StructField(name, T.StringType()) for name in header_columns]
    for name in measures:
        n = seen.get(name, 0)
        seen[name] = n + 1
        fields.append(T.StructField(f"{name}{n}" if n else name, declared_type(measure_type)))
    return T.StructType(fields), keys


# ---- writers ---------------------------------------------------------------------------


def _writer(table: DataFrame, mode: str, partitions: Sequence[str]):
    w = table.write.mode(mode)
    return w.partitionBy(*partitions) if partitions else w


def replace_table(table: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    _writer(table, "overwrite", partitions).parquet(path)


def append_table(table: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    _writer(table, "append", partitions).parquet(path)


def replace_partitions(table: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Overwrites only the partitions the table holds rows for."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_version(table: DataFrame, root: str, version: int, partitions: Sequence[str] = ()) -> str:
    """Stores ``table`` as a new version folder.

    A job whose result depends on the stored table cannot overwrite what it still reads; each run
    writes the next version and readers switch to it when its success marker is there.
    """
    path = f"{root.rstrip('/')}/version={version:08d}"
    _writer(table, "overwrite", partitions).parquet(path)
    return path


# ---- keyed rewrite -----------------------------------------------------------------------


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def store_buckets(table: DataFrame, root: str, key: str, buckets: int) -> None:
    """Stores a table in ``buckets`` partitions by a digest of its key."""
    replace_partitions(table.withColumn("_bucket", bucket_of(key, buckets)).hint("rebalance", "_bucket"), f"{root}/rows", ["_bucket"])


def upsert_buckets(spark: SparkSession, root: str, batch: DataFrame, batch_id: int, keys: Sequence[str], buckets: int, exact: bool = True) -> None:
    """``upsert_by_keyset`` into a table of ``store_buckets``; only partitions that the batch has keys of are read and written.

    The first key tells the partition.  New partitions are staged before any old one is replaced, so a run that was cut off is completed from the stage
    by running it again, and one that was completed does nothing.
    """
    staged, applied = f"{root}/staged/batch={batch_id}", f"{root}/applied/batch={batch_id}"
    if existing_paths(spark, [f"{applied}/_SUCCESS"]):
        return
    if not existing_paths(spark, [f"{staged}/_SUCCESS"]):
        batch = batch.withColumn("_bucket", bucket_of(keys[0], buckets))
        touched = [r[0] for r in batch.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
        stored = spark.read.parquet(f"{root}/rows").where(F.col("_bucket").isin(touched))
        upsert_by_keyset(stored, batch, keys, exact).write.mode("overwrite").parquet(staged)
    replace_partitions(spark.read.parquet(staged).hint("rebalance", "_bucket"), f"{root}/rows", ["_bucket"])
    spark.range(1).write.mode("overwrite").parquet(applied)


def read_buckets(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/rows").drop("_bucket")
