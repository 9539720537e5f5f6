"""Service calendars to dates: series, weekday masks and exceptions as set algebra on arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.text import or_empty

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def day(c: str) -> Column:
    """A yyyyMMdd text as a date, NULL where it is none."""
    v = F.col(c)
    return F.when(v.rlike(r"^[0-9]{8}$"), F.concat_ws("-", F.substring(v, 1, 4), F.substring(v, 5, 2), F.substring(v, 7, 2)).try_cast("date"))


def with_order(df: DataFrame) -> DataFrame:
    """`df` with `_ord`, its rows' order; tables that don't bring one get that of their files."""
    return df if "_ord" in df.columns else df.withColumn("_ord", F.monotonically_increasing_id())


def last_wins(df: DataFrame, key: str) -> DataFrame:
    """One row per non-empty key, the last one. Aggregated map-side, so repeated rows don't shuffle."""
    df = with_order(df)
    packed = df.where(or_empty(key) != "").groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*df.columns), "_ord").alias("_row"))
    # The key, not the row's copy of it: what is joined by it then stays where it was aggregated.
    return packed.select(*[F.col("_key" if c == key else f"_row.`{c}`").alias(c) for c in df.columns])


def exceptions(calendar_dates: DataFrame) -> DataFrame:
    """(service_id, added, removed): sets of dates by exception type 1 and 2; other types don't count."""
    date = day("date")
    kind = F.trim(F.col("exception_type"))
    return (
        calendar_dates.where(or_empty("service_id") != "")
        .groupBy("service_id")
        .agg(F.array_sort(F.collect_set(F.when(kind == "1", date))).alias("added"), F.array_sort(F.collect_set(F.when(kind == "2", date))).alias("removed"))
    )


def running_days(start: Column, end: Column, mask: Column) -> Column:
    """The days of an inclusive range, reversed ranges too, whose weekday's flag is '1'."""
    return F.when(start.isNotNull() & end.isNotNull(), F.filter(F.sequence(start, end), lambda d: F.get(mask, F.weekday(d)) == "1"))


def service_dates(calendar: DataFrame, calendar_dates: DataFrame) -> DataFrame:
    """(service_id, service_dates array<date>): added dates, then running days that aren't removed.

    A date both added and removed stays. A service with exceptions only has its added
    dates. Of repeated calendar rows the last counts, without exceptions, which the
    first one takes up. Rows without usable bounds run on no day.
    """
    rows = with_order(calendar).where(or_empty("service_id") != "")
    mask = F.array(*[or_empty(w) for w in WEEKDAYS])
    shown = rows.select("service_id", "_ord", running_days(day("start_date"), day("end_date"), mask).alias("days"))
    base = shown.groupBy(F.col("service_id").alias("_base")).agg(F.max_by("days", "_ord").alias("days"), F.count(F.lit(1)).alias("n"), F.lit(True).alias("listed"))
    joined = base.join(exceptions(calendar_dates), F.col("_base") == F.col("service_id"), "full_outer")
    none = F.array().cast("array<date>")
    days, added, removed = F.coalesce("days", none), F.coalesce("added", none), F.coalesce("removed", none)
    dates = F.when(F.col("listed").isNull(), added).when(F.col("n") > 1, days).otherwise(F.array_union(added, F.array_except(days, removed)))
    return joined.select(F.coalesce("service_id", "_base").alias("service_id"), dates.alias("service_dates"))


def constrain_calendar(calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Calendar rows that overlap yyyyMMdd bounds, clamped to them."""
    s, e = F.col("start_date"), F.col("end_date")
    return calendar.where(~((e < start) | (s > end))).withColumns({"start_date": F.greatest(s, F.lit(start)), "end_date": F.least(e, F.lit(end))})


def constrain_dates(calendar_dates: DataFrame, start: str, end: str) -> DataFrame:
    return calendar_dates.where(F.col("date").between(start, end))
