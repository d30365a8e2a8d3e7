"""Trend rules as column functions over one series held in an array.

A series is ``array<struct<trade_date, close>>`` in date order, a point list ``array<struct<pivot_seq, record_id, trade_date, close,
ascending, extreme>>``.  Where a rule jumps from one row to another (the search for turning points, the marking of reversals) the jump
depends on the row alone, not on how it was reached: it is worked out for every row from the extremes of the rows ahead, and the path from the
first row is then followed by one fold.  So no state is carried through the rows and none is read twice.

Series are daily, at most one row per code and calendar day, which bounds the arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<pivot_seq:bigint,record_id:bigint,trade_date:date,close:decimal(18,4),ascending:boolean,extreme:boolean>"
SEGMENT = (
    "struct<start_date:date,calendar_days:bigint,close:decimal(18,4),end_close:decimal(18,4),train_flag:bigint,"
    "start_record_id:bigint,trading_days:bigint,change_rate:decimal(18,2),direction:string,end_record_id:bigint>"
)
#: A segment with the long average in force at its end, and whether it began recently.
RECENT = SEGMENT[:-1] + ",end_ma:decimal(18,2),recent:boolean>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often its name stands in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _ahead(items: Column, i: Column, by: int = 1) -> Column:
    return F.get(items, i + by)


def _lowest_first(items: Column) -> Column:
    """(close, at) per row: its minimum is the first of the lowest rows."""
    return F.transform(items, lambda x, i: F.struct(x["close"].alias("close"), i.alias("at")))


def _highest_first(items: Column) -> Column:
    """(close, back) per row: its maximum is the first of the highest rows."""
    return F.transform(items, lambda x, i: F.struct(x["close"].alias("close"), (-i).alias("back")))


def turns_ahead(series: Column, term: int) -> Column:
    """For every row, the row at which a search of ``term`` rows from there finds the next turn; itself where they are all equal.

    It is the earlier of the lowest and the highest row, or the other one if the earlier is the row itself.
    """

    def search(lows: Column, highs: Column) -> Column:
        def from_row(_: Column, i: Column) -> Column:
            low = F.array_min(F.slice(lows, i + 1, F.lit(term)))["at"]
            high = -F.array_max(F.slice(highs, i + 1, F.lit(term)))["back"]
            return let(F.struct(F.least(low, high).alias("first"), F.greatest(low, high).alias("second")),
                       lambda x: F.when(x["first"] == i, x["second"]).otherwise(x["first"]))

        return F.transform(lows, from_row)

    return let(_lowest_first(series), lambda lows: let(_highest_first(series), lambda highs: search(lows, highs)))


def steps_of(turns: Column, term: int, rows: Column, first: Column) -> Column:
    """(at, turn, next, whole) per row of a piece that begins at row ``first`` of a series of ``rows``.

    ``next`` is where the search goes on, behind the window where all its rows are equal; it is ``whole`` if the series goes on behind the window.
    """

    def step(turn: Column, i: Column) -> Column:
        flat = turn == i
        return F.struct(
            i.alias("at"), turn.alias("turn"), F.when(flat, i + term).otherwise(turn).alias("next"), flat.alias("flat"), (first + i + term < rows).alias("whole"),
        )

    return F.transform(turns, step)


def followed(steps: Column, entry: Column) -> Column:
    """Numbers of the points met from ``entry`` on; one in front of equal rows moves behind them and is not kept."""
    start = F.struct(entry.cast("int").alias("next"), _empty("int").alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        seen = F.when(x["whole"] & x["flat"], acc["seen"]).otherwise(F.concat(acc["seen"], F.array(x["at"])))
        return F.when(x["at"] != acc["next"], acc).otherwise(F.struct(F.when(x["whole"], x["next"]).otherwise(-1).alias("next"), seen.alias("seen")))

    return F.aggregate(steps, start, step, lambda acc: acc["seen"])


def closed(seen: Column, turns: Column, last: Column) -> Column:
    """Points of a series that ends with row ``last``: the search from the last point takes what rows there are, and the last row is a point."""
    end = lambda p: F.get(p, F.size(p) - 1)
    with_turn = let(F.get(turns, end(seen)), lambda t: F.when(t == end(seen), seen).otherwise(F.concat(seen, F.array(t))))
    return let(with_turn, lambda p: F.when(end(p) == last, p).otherwise(F.concat(p, F.array(last))))


def turning_points(series: Column, term: int) -> Column:
    """Point list of the turns from the first row on, closed by the last row.

    After ``term`` equal rows the point under way moves to the row behind them and the search begins anew there.  A point's ``ascending`` says where
    the series goes from it; the last one's is null.  Fewer than two rows have no points.
    """

    def path(turns: Column) -> Column:
        n = F.size(turns)
        return let(followed(steps_of(turns, term, n, F.lit(0)), F.lit(0)), lambda seen: closed(seen, turns, n - 1))

    def points(at: Column) -> Column:
        def point(i: Column, k: Column) -> Column:
            row = F.get(series, i)
            return F.struct(
                k.cast("bigint").alias("pivot_seq"), i.cast("bigint").alias("record_id"), row["trade_date"].alias("trade_date"),
                row["close"].cast("decimal(18,4)").alias("close"), (F.get(series, _ahead(at, k))["close"] >= row["close"]).alias("ascending"),
                F.lit(False).alias("extreme"),
            )

        return F.transform(at, point)

    found = let(turns_ahead(series, term), lambda turns: let(path(turns), points))
    return F.when(F.size(series) >= 2, found).otherwise(_empty(POINT))


def _where(points: Column, keep: Callable[[Column, Column, Column], Column]) -> Column:
    """First point, last point and those that ``keep(points, point, i)`` names; nothing of a list of fewer than two."""

    def inner(p: Column) -> Column:
        ends = lambda i: (i == 0) | (i == F.size(p) - 1)
        return F.when(F.size(p) >= 2, F.filter(p, lambda x, i: ends(i) | keep(p, x, i))).otherwise(_empty(POINT))

    return let(points, inner)


def merged(points: Column) -> Column:
    """Without points that go on in the direction of the one before."""
    return _where(points, lambda p, x, i: ~x["ascending"].eqNullSafe(_ahead(p, i, -1)["ascending"]))


def large_move(close: Column, ahead: Column, min_rate: Column) -> Column:
    """Whether the change to the next close, in percent to two decimals, exceeds the minimum; from 0 any rise does."""
    rate = F.abs(F.round(F.try_divide(ahead - close, close) * 100, 2))
    return F.coalesce(rate > min_rate.cast("decimal(18,4)"), ahead > 0)


def without_weak(points: Column, min_rate: Column) -> Column:
    """Without points followed by a small move, marked ones excepted."""
    return _where(points, lambda p, x, i: x["extreme"] | large_move(x["close"], _ahead(p, i)["close"], min_rate))


def with_extremes(points: Column, term: Column, min_rate: Column) -> Column:
    """Point list with the reversal points marked.

    From a point the list is read up to the last one within ``term`` records of its successor.  The lowest and the highest of that stretch, in
    their order, are a move.  A move against the one before marks where it begins; one that goes on after a gap above ``min_rate``
    percent marks both ends of the gap.  The next stretch begins where the move ends, or two points on where all are equal; the first
    stretch that the list does not outlast ends the search.  Both ends of the list are marked.
    """

    def moves(p: Column, lows: Column, highs: Column) -> Column:
        last = F.element_at(p, -1)["record_id"]

        def move(x: Column, i: Column) -> Column:
            limit = _ahead(p, i)["record_id"] + term
            inside = lambda y: F.get(p, F.abs(y))["record_id"] <= limit
            low = F.array_min(F.filter(F.slice(lows, i + 1, term + 2), lambda y: inside(y["at"])))["at"]
            high = -F.array_max(F.filter(F.slice(highs, i + 1, term + 2), lambda y: inside(y["back"])))["back"]
            ends = F.when(limit < last, F.struct(low.alias("low"), high.alias("high")))

            def told(e: Column) -> Column:
                begin, end = F.least(e["low"], e["high"]), F.greatest(e["low"], e["high"])
                gap = F.abs(F.get(p, begin)["close"] - x["close"]).cast("double") * 100
                return F.struct(
                    i.alias("at"), begin.alias("begin"), end.alias("end"), (e["high"] > e["low"]).alias("up"),
                    ((begin > i) & (gap > min_rate * x["close"].cast("double"))).alias("gap"),
                )

            return let(ends, told)

        return F.transform(p, move)

    def marks(p: Column, found: Column) -> Column:
        start = F.struct(F.lit(0).alias("next"), (_ahead(p, F.lit(0))["close"] >= F.get(p, F.lit(0))["close"]).alias("rising"), _empty("int").alias("marks"))

        def step(acc: Column, m: Column) -> Column:
            flat = F.struct((m["at"] + 2).alias("next"), acc["rising"].alias("rising"), acc["marks"].alias("marks"))
            more = F.when(m["up"] != acc["rising"], F.array(m["begin"])).when(m["gap"], F.array(m["at"], m["begin"])).otherwise(_empty("int"))
            moved = F.struct(m["end"].alias("next"), m["up"].alias("rising"), F.concat(acc["marks"], more).alias("marks"))
            here = (m["at"] == acc["next"]) & m["end"].isNotNull()
            return F.when(here, F.when(m["begin"] == m["end"], flat).otherwise(moved)).otherwise(acc)

        return F.aggregate(found, start, step, lambda acc: F.concat(acc["marks"], F.array(F.lit(0), F.size(p) - 1)))

    def marked(p: Column) -> Column:
        found = let(_lowest_first(p), lambda lows: let(_highest_first(p), lambda highs: moves(p, lows, highs)))
        flagged = let(let(found, lambda m: marks(p, m)), lambda at: F.transform(p, lambda x, i: x.withField("extreme", F.array_contains(at, i))))
        return F.when(F.size(p) >= 2, flagged).otherwise(F.transform(p, lambda x: x.withField("extreme", F.lit(False))))

    return let(points, marked)


def with_overrides(points: Column, fixes: Column) -> Column:
    """Marks replaced by ``fixes``, an array of (trade_date, extreme); null where there are none."""

    def fixed(x: Column) -> Column:
        own = F.get(F.filter(fixes, lambda f: f["trade_date"] == x["trade_date"]), F.lit(0))["extreme"]
        return x.withField("extreme", F.coalesce(own, x["extreme"]))

    return F.transform(points, fixed)


def segments(points: Column, up: str, down: str) -> Column:
    """Equal steps joined; see ``series.trend_segments``."""

    def step_up(p: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = _ahead(p, i, -1)["close"]
            change = F.round(F.try_divide(x["close"] - before, before), 2)
            return F.when(i > 0, F.coalesce(change >= 0, x["close"] > 0))

        return F.transform(p, one)

    def built(p: Column, ups: Column, starts: Column) -> Column:
        n = F.size(p)

        def one(s: Column, k: Column) -> Column:
            a = F.get(p, s - 1)
            last = _ahead(starts, k).isNull()
            b = F.get(p, F.coalesce(_ahead(starts, k) - 1, n - 1))
            rate = F.round(F.try_divide(b["close"] - a["close"], a["close"]), 2)
            return F.struct(
                a["trade_date"].alias("start_date"), F.date_diff(b["trade_date"], a["trade_date"]).cast("bigint").alias("calendar_days"),
                a["close"].alias("close"), b["close"].alias("end_close"), F.when(last, 0).otherwise(1).cast("bigint").alias("train_flag"),
                a["record_id"].alias("start_record_id"), (b["record_id"] - a["record_id"]).alias("trading_days"),
                rate.cast("decimal(18,2)").alias("change_rate"), F.when(F.get(ups, s), F.lit(up)).otherwise(F.lit(down)).alias("direction"),
                b["record_id"].alias("end_record_id"),
            )

        return F.transform(starts, one)

    def whole(p: Column, ups: Column) -> Column:
        first = lambda s: (s > 0) & ((s == 1) | ~F.get(ups, s).eqNullSafe(F.get(ups, s - 1)))
        starts = F.filter(F.transform(p, lambda _, i: i), first)
        return let(starts, lambda s: built(p, ups, s))

    return let(points, lambda p: F.when(F.size(p) >= 2, let(step_up(p), lambda ups: whole(p, ups))).otherwise(_empty(SEGMENT)))


def average_at(series: Column, record: Column, term: int) -> Column:
    """Mean of the last ``term`` closes at a row, to two decimals; 0 while the row's number is below the term."""
    rows = F.slice(series, F.greatest(record.cast("int") - term + 2, F.lit(1)), F.lit(term))
    total = F.aggregate(rows, F.lit(0).cast("decimal(28,4)"), lambda a, x: (a + x["close"]).cast("decimal(28,4)"))
    return F.when(record < term, F.lit(0)).otherwise(F.round(total / F.lit(term), 2)).cast("decimal(18,2)")


def with_recent_joined(recent: Column, up: str, down: str) -> Column:
    """Recent segments joined to the one before while they end on its side of the long average.

    ``recent`` is an array of ``RECENT``.  The first recent segment gives the direction that holds; one that ends on the other side of the average
    turns it and stands alone; earlier segments stay as they are.
    """
    start = F.struct(F.lit(None).cast("string").alias("held"), _empty(RECENT).alias("out"))

    def grown(base: Column, x: Column) -> Column:
        move = F.try_divide(x["end_close"] - base["close"], base["close"])
        return (
            base.withField("end_close", x["end_close"]).withField("calendar_days", base["calendar_days"] + x["calendar_days"])
            .withField("trading_days", base["trading_days"] + x["trading_days"]).withField("change_rate", F.round(move, 2).cast("decimal(18,2)"))
        )

    def step(acc: Column, x: Column) -> Column:
        added = F.concat(acc["out"], F.array(x))
        side = F.when(acc["held"] == up, x["end_close"] >= x["end_ma"]).otherwise(x["end_close"] <= x["end_ma"])
        joined = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(grown(F.element_at(acc["out"], -1), x)))
        other = F.when(acc["held"] == up, F.lit(down)).otherwise(F.lit(up))
        pick = lambda held, out: F.struct(held.alias("held"), out.alias("out"))
        return (
            F.when(~x["recent"], pick(acc["held"], added)).when(acc["held"].isNull(), pick(x["direction"], added))
            .when(F.coalesce(side, F.lit(False)), pick(acc["held"], joined)).otherwise(pick(other, added))
        )

    return F.aggregate(recent, start, step, lambda acc: acc["out"])
