"""Moving averages by rows on a feed of daily closes, the last closes of each code kept as keyed state.

The state of a code is bounded by the longest term: its last closes, the number of rows seen and the day of the newest one.  A row enters all averages
when it arrives, so one file and many small batches give the same rows.  Rows that are not newer than the newest day of their code come
too late and are left out.  State expires in the time of the feed: when the newest row of all codes is ``ttl_days`` past the last one of a code,
whose next row then starts a new series; rows that old are late for any code.

Rows cross to Python once, as Arrow batches, and only whole numbers are added there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.streaming import folders

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Closes enter the state as whole numbers of this fraction.
SCALE = 10_000


def last_closes(terms: tuple[int, ...], ttl_days: int):
    """State update of one code: sums of the last ``term`` closes, for several terms, as rows arrive."""

    def expire(state: GroupState, newest) -> None:
        state.setTimeoutTimestamp(int((pd.Timestamp(newest) + pd.Timedelta(days=ttl_days + 1)).timestamp() * 1000))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n_rows, newest, held = state.get if state.exists else (0, None, [])
        arrived = pd.concat(batches).sort_values("trade_date", kind="stable").drop_duplicates("trade_date", keep="last")
        if newest is not None:
            arrived = arrived[arrived["trade_date"] > newest]
        if not len(arrived):
            expire(state, newest)
            return
        closes = [*held, *arrived["units"].tolist()]
        sums = [0]
        for c in closes:
            sums.append(sums[-1] + c)
        ends = range(len(held) + 1, len(closes) + 1)
        out = pd.DataFrame({"code": key[0], "trade_date": arrived["trade_date"].tolist(), "units": arrived["units"].tolist()})
        out["record_id"] = range(n_rows, n_rows + len(arrived))
        for term in terms:
            out[f"sum_{term}"] = [sums[e] - sums[max(e - term, 0)] for e in ends]
        state.update((n_rows + len(arrived), out["trade_date"].iloc[-1], [int(c) for c in closes[-max(terms):]]))
        expire(state, out["trade_date"].iloc[-1])
        yield out

    return update


def row_averages(feed: DataFrame, terms: Mapping[str, int], ttl_days: int = 3650) -> DataFrame:
    """Averages of the last rows of each code, with the values ``series.moving_averages`` gives: (code, trade_date, close, record_id, …)."""
    units = F.round(F.col("close") * SCALE).cast("bigint")
    numbers = tuple(sorted(set(terms.values())))
    schema = "code string, trade_date date, units long, record_id long, " + ", ".join(f"sum_{t} long" for t in numbers)
    rows = feed.select("code", "trade_date", units.alias("units"), F.col("trade_date").cast("timestamp").alias("at"))
    sums = rows.withWatermark("at", f"{ttl_days} days").groupBy("code").applyInPandasWithState(
        last_closes(numbers, ttl_days), schema, "n_rows long, newest date, closes array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
    value = lambda c: (F.col(c).cast("decimal(28,4)") / F.lit(SCALE)).cast("decimal(28,4)")
    averages = [
        F.when(F.col("record_id") < term, F.lit(0)).otherwise(F.round(value(f"sum_{term}") / F.lit(term), 2)).cast("decimal(18,2)").alias(name)
        for name, term in terms.items()
    ]
    return sums.select("code", "trade_date", value("units").cast("decimal(18,4)").alias("close"), "record_id", *averages)


def store_averages(feed: DataFrame, root: str, terms: Mapping[str, int], every: int = folders.EVERY) -> StreamingQuery:
    """Keeps the averages of a feed; each micro-batch stores its rows, older folders are merged."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/averages/batch={batch_id}")
        folders.merge(batch.sparkSession, f"{root}/averages", batch_id - 1, every)

    return (
        row_averages(feed, terms).writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )


def read_averages(spark, root: str) -> DataFrame:
    return folders.read(spark, f"{root}/averages")
