"""Years, dates and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per unit of a date shift.
UNIT_SECONDS = {
    "weeks": 604800.0, "days": 86400.0, "hours": 3600.0, "minutes": 60.0, "seconds": 1.0, "milliseconds": 0.001,
}


def from_url(url: Column, pattern: str = "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}") -> Column:
    """Publishing date inside an address, '' if there is none."""
    return F.regexp_extract(url, pattern, 0)


def period_range(years: Column) -> Column:
    """Year labels in order to the range of days they cover."""
    first = F.substring_index(F.element_at(years, 1), "年", 1)
    last = F.substring_index(F.element_at(years, -1), "年", 1)
    return F.concat(first, F.lit("-01-01~"), last, F.lit("-12-30"))


def year_label(text: Column) -> Column:
    """``2014``, ``2015.12.31`` and ``2015-6-30`` to their year label."""
    return (
        F.when(text.rlike("[0-9]{4}$"), F.regexp_replace(text, "([0-9]{4})$", "$1年"))
        .when(
            text.rlike("[0-9]{4}[.][0-9]+[.][0-9]{2}"),
            F.regexp_replace(text, "([0-9]{4})[.][0-9]+[.][0-9]{2}", "$1年"),
        )
        .when(
            text.rlike("[0-9]{4}-[0-9]+-[0-9]{2}"), F.regexp_replace(text, "([0-9]{4})-[0-9]+-[0-9]{2}", "$1年")
        )
        .otherwise(text)
    )


def is_year(text: Column) -> Column:
    return F.coalesce(text.rlike("[0-9]+年"), F.lit(False))


def all_years(texts: Column) -> Column:
    return F.forall(texts, is_year)


def year_plus(label: Column, n: int | Column) -> Column:
    """``2019年`` + n."""
    return F.concat((F.substring_index(label, "年", 1).cast("int") + n).cast("string"), F.lit("年"))


def crawl_year(label: Column, report_type: Column) -> Column:
    """Year a report is looked for: annual reports appear one year later."""
    return F.when(report_type == "年度报告", year_plus(label, -1)).otherwise(label)


def year_range(first: Column, last: Column) -> Column:
    """Years from one before the first label to the last."""
    start = F.substring_index(first, "年", 1).cast("int") - 1
    end = F.substring_index(last, "年", 1).cast("int")
    return F.sequence(start, end)


def parse_date(text: Column) -> Column:
    """Date from ``2020-1-30`` or ``2020/1/30``."""
    return F.coalesce(F.try_to_date(text, "yyyy-M-d"), F.try_to_date(text, "yyyy/M/d"))


def difference(unit: str, start: Column, end: Column) -> Column:
    if unit == "days":
        return F.date_diff(parse_date(end), parse_date(start)).cast("bigint")
    if unit == "seconds":
        return (F.date_diff(parse_date(end), parse_date(start)) * 86400).cast("bigint")
    raise ValueError(f"unit {unit}: days or seconds")


def shift(unit: str, start: Column, n: Column) -> Column:
    """Date text plus n units, as a zone-less timestamp."""
    if unit not in UNIT_SECONDS:
        raise ValueError(f"unit {unit}: one of {', '.join(UNIT_SECONDS)}")
    seconds = (n * F.lit(UNIT_SECONDS[unit])).cast("decimal(18,6)")
    return parse_date(start).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def last_weekday(day: Column) -> Column:
    """The day itself, or the Friday before a weekend."""
    back = F.when(F.weekday(day) == 5, 1).when(F.weekday(day) == 6, 2).otherwise(0)
    return F.date_sub(day, back)
