"""Series steps for series that are too long for one task.

``series`` and ``pivots`` give each code to one task, which is right for daily closes.  Here a series of any length, or one code that holds all
rows, is cut into pieces along its order; a piece is summed up in a few numbers that combine associatively, the summaries of a
code are run through once, and every piece goes on from what stood before it:

* position and running sum: a piece's summary is its row count and total;
* averages over the last rows: pieces of ``block`` rows, each with the last rows of the one before (its *halo*);
* turning points: where the search leaves a piece depends only on where it enters, one of ``term`` rows; the summary is that map, and maps of
  consecutive pieces combine by application.

Rows are (code, close) with the columns ``order``, which must tell the rows of a code apart; results equal those of ``series`` and ``pivots``.
Pieces are stored before their numbers are used, so a task run again finds the same ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import turns as T
from tidemark.session import materialise

#: Rows of a piece with a halo; far more than any term.
BLOCK = 1 << 14


def with_records(rows: DataFrame, order: Sequence[str] = ("trade_date",), running: str = "running_sum") -> DataFrame:
    """Adds ``record_id``, the position from 0, the running sum of the closes, and ``n_rows``, the length of the series."""
    dealt = materialise(rows.repartitionByRange("code", *order).withColumn("_piece", F.spark_partition_id()), "pieces")
    sums = dealt.groupBy("code", "_piece").agg(F.count(F.lit(1)).alias("_n"), F.sum("close").alias("_t"))
    before = Window.partitionBy("code").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "code", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_t").over(before).alias("_sum"),
        F.sum("_n").over(Window.partitionBy("code")).alias("n_rows"),
    )
    inside = Window.partitionBy("code", "_piece").orderBy(*order)
    own = dealt.withColumns({
        "_place": F.row_number().over(inside) - 1,
        running: F.sum("close").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    total = F.when(F.col("_sum").isNull(), F.col(running)).otherwise(F.coalesce(F.col(running), F.lit(0)) + F.col("_sum"))
    return (
        own.join(starts, ["code", "_piece"])
        .withColumns({"record_id": (F.col("_first") + F.col("_place")).cast("bigint"), running: total})
        .drop("_piece", "_place", "_first", "_sum")
    )


def with_blocks(records: DataFrame, block: int, before: int = 0, after: int = 0) -> DataFrame:
    """Rows in blocks of ``block`` positions, ``_block``; the last ``before`` and the first ``after`` rows of a block stand in its neighbour too."""
    if max(before, after) > block:
        raise ValueError(f"a block of {block} rows is shorter than the rows it lends")
    own, place = F.floor(F.col("record_id") / block), F.col("record_id") % block
    where = F.array(own, F.when(place >= block - before, own + 1), F.when((place < after) & (own > 0), own - 1))
    last = F.floor((F.col("n_rows") - 1) / block)
    return records.withColumn("_block", F.explode(F.filter(where, lambda b: b <= last)))


def moving_averages(rows: DataFrame, terms: Mapping[str, int], order: Sequence[str] = ("trade_date",), block: int = BLOCK) -> DataFrame:
    """Simple moving averages as ``series.moving_averages`` gives them: 2 decimals, 0 while ``record_id`` is below the term."""
    block = max(block, *terms.values())
    placed = with_blocks(with_records(rows, order), block, before=max(terms.values()))
    w = Window.partitionBy("code", "_block").orderBy("record_id")
    out = {}
    for name, term in terms.items():
        total = F.col("running_sum") - F.lag("running_sum", term).over(w)
        out[name] = F.when(F.col("record_id") < term, F.lit(0)).otherwise(F.round(total / F.lit(term), 2)).cast("decimal(18,2)")
    return placed.withColumns(out).where(F.floor(F.col("record_id") / block) == F.col("_block")).drop("_block", "n_rows")


def _crossing(steps: Column, term: int) -> Column:
    """The map of a block: for a search that enters at row 0 … term - 1, the row of the next block at which it leaves; -1 if it ends inside.

    Read from the end: a row's way out is that of the row it goes on to, at most ``term`` rows ahead.
    """
    behind = F.sequence(F.lit(0), F.lit(term - 1))

    def step(ways: Column, x: Column) -> Column:
        way = F.when(x["whole"], F.get(ways, x["next"] - x["at"] - 1)).otherwise(-1)
        return F.concat(F.array(way), F.slice(ways, F.lit(1), F.lit(term - 1)))

    return F.aggregate(F.reverse(steps), behind, step)


def _entries(crossings: DataFrame) -> DataFrame:
    """(code, _block, entry): where the search enters each block it reaches; ``crossings`` has the map ``ways`` of every block.

    One row of ``term`` numbers per block meets in the task of its code.
    """
    maps = crossings.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("_block", "ways"))).alias("maps"))
    kind = "array<struct<_block:bigint,entry:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("seen"))

    def step(acc: Column, m: Column) -> Column:
        here = F.array(F.struct(m["_block"].alias("_block"), acc["at"].alias("entry")))
        way = F.when(acc["at"] < 0, -1).otherwise(F.get(m["ways"], acc["at"]))
        return F.struct(way.alias("at"), F.concat(acc["seen"], here).alias("seen"))

    found = F.aggregate("maps", start, step, lambda acc: F.filter(acc["seen"], lambda x: x["entry"] >= 0))
    return maps.select("code", F.inline(found))


def find_pivots(rows: DataFrame, term: int, order: Sequence[str] = ("trade_date",), block: int = BLOCK) -> DataFrame:
    """Turning points (code, pivot_seq, record_id, *order, close, ascending) as ``pivots.find_pivots`` gives them."""
    block = max(block, term)
    records = with_records(rows, order).where("n_rows >= 2")
    fields = F.struct("record_id", "close", *order)
    blocks = with_blocks(records, block, after=term).groupBy("code", "_block").agg(
        F.array_sort(F.collect_list(fields)).alias("rows"), F.max("n_rows").alias("n_rows")
    )
    first = F.col("_block") * block
    own = F.least(F.lit(block).cast("bigint"), F.col("n_rows") - first).cast("int")
    steps = T.let(T.turns_ahead(F.col("rows"), term), lambda turns: T.steps_of(F.slice(turns, F.lit(1), own), term, F.col("n_rows"), first))
    blocks = materialise(blocks.withColumn("steps", steps), "blocks")
    entries = _entries(blocks.select("code", "_block", _crossing(F.col("steps"), term).alias("ways")))

    def kept(seen: Column) -> Column:
        turns = F.transform("steps", lambda x: x["turn"])
        last = (F.col("n_rows") - 1 - first).cast("int")
        ends = ~F.get(F.col("steps"), F.get(seen, F.size(seen) - 1))["whole"]
        return F.transform(F.when(ends, T.closed(seen, turns, last)).otherwise(seen), lambda i: F.get(F.col("rows"), i))

    found = blocks.join(entries, ["code", "_block"]).select("code", "_block", T.let(T.followed(F.col("steps"), F.col("entry")), kept).alias("points"))
    found = materialise(found.where(F.size("points") > 0), "points")
    w = Window.partitionBy("code").orderBy("_block")
    marks = found.select("code", "_block", F.size("points").alias("_n"), F.col("points")[0]["close"].alias("_head")).select(
        "code", "_block", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"),
        F.lead("_head").over(w).alias("_next"),
    )

    def point(x: Column, k: Column) -> Column:
        ahead = F.coalesce(F.get(F.col("points"), k + 1)["close"], F.col("_next"))
        return F.struct(
            (F.col("_first") + k).cast("bigint").alias("pivot_seq"), x["record_id"].alias("record_id"), *[x[c].alias(c) for c in order],
            x["close"].alias("close"), (ahead >= x["close"]).alias("ascending"),
        )

    return found.join(marks, ["code", "_block"]).select("code", F.inline(F.transform("points", point)))
