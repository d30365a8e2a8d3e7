"""Matches with their positions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,stop:int,value:string>>"


def located(text: Column, pattern: Column | str) -> Column:
    """All matches of ``pattern`` as (start, stop, value), in code points, stop exclusive.

    The text between matches, split off, says where each one starts.
    """
    found = F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), stop.alias("stop"), x["m"].alias("value")))
        return F.struct(stop.alias("at"), F.concat(acc["out"], one).alias("out"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(pairs, nothing, step, lambda acc: acc["out"])
