"""Filters of a fixed size over 64-bit keys, as column expressions.

A filter only saves work: it lets through every key it was built from, and few others as long as it is not crowded; what passes wrongly
must be harmless.  Its size is a parameter and does not grow with the input; it is stored as one row and read as a scalar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise


def _bits(key: Column, bits: int) -> list[Column]:
    mask = F.lit(bits - 1).cast("long")
    return [key.bitwiseAND(mask), F.shiftrightunsigned(key, 32).bitwiseAND(mask)]


def build(keys: DataFrame, key: str, bits: int) -> Column:
    """Filter of ``bits`` (a power of two, 64 at least) that holds the hashes in column ``key``; each sets two bits."""
    places = keys.select(F.explode(F.array(*_bits(F.col(key), bits))).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))
    words = places.groupBy(F.shiftrightunsigned("bit", 6).alias("word")).agg(F.bit_or(one).alias("set"))
    every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    packed = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0).cast("long")).alias("set")))).alias("all"))
    return materialise(packed.select(F.transform("all", lambda w: w["set"]).alias("table")), "filter").scalar()


def holds(table: Column, key: Column, bits: int) -> Column:
    test = F.lit(True)
    for bit in _bits(key, bits):
        word = F.get(table, F.shiftrightunsigned(bit, 6).cast("int"))
        test = test & (F.call_function("getbit", word, F.pmod(bit, F.lit(64)).cast("int")) == 1)
    return test
