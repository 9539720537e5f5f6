"""Rules and dates to dated connections, with elapsed time from local midnight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duration_seconds(c: Column | str) -> Column:
    """Seconds of an `H:MM[:SS]` duration; hours may exceed 24.

    Each part counts up to its first other sign; missing seconds are 0, missing hours or
    minutes make the duration NULL.
    """
    parts = F.split(F.col(c) if isinstance(c, str) else c, ":")
    number = lambda k: F.nullif(F.regexp_extract(F.get(parts, F.lit(k)), r"^\s*([+-]?[0-9]+)", 1), F.lit("")).try_cast("bigint")  # noqa: E731  (a cast that fails costs an exception)
    return number(0) * 3600 + number(1) * 60 + F.coalesce(number(2), F.lit(0))


def instant(date: Column, seconds: Column, timezone: str) -> Column:
    """Local midnight of a date in a zone plus elapsed seconds, as a timestamp, whatever the session's zone."""
    midnight = F.make_timestamp_ltz(F.year(date), F.month(date), F.day(date), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), F.lit(timezone))
    return F.timestamp_add("SECOND", seconds, midnight)


def iso(ts: Column) -> Column:
    """A timestamp as ISO 8601 in UTC with milliseconds and Z; by arithmetic, which takes a fraction of the time of a pattern."""
    ms = F.unix_millis(ts)
    rest = F.pmod(ms, F.lit(86400000))
    day = F.date_from_unix_date(((ms - rest) / 86400000).cast("int")).cast("string")
    whole = lambda unit: (rest / unit).cast("bigint")
    digits = (F.lit(1000000000) + whole(3600000) * 10000000 + whole(60000) % 60 * 100000 + rest % 60000).cast("string")
    part = lambda at, n: F.substring(digits, at, n)
    return F.concat(day, F.lit("T"), part(2, 2), F.lit(":"), part(4, 2), F.lit(":"), part(6, 2), F.lit("."), part(8, 3), F.lit("Z"))


def local_text(ts: Column, timezone: str, pattern: str) -> Column:
    """A timestamp in a zone's wall clock, by a Java pattern."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit(timezone), ts.cast("timestamp_ntz")), pattern)


def connections(rule_rows: DataFrame, timezone: str = "UTC", strict: bool = False) -> DataFrame:
    """One connection per rule and service date. Unparsable times give NULL, or with `strict` fail."""
    times = ("departure_dfm", "arrival_dfm", "trip_start_dfm")
    dated = rule_rows.withColumns({f"_s_{c}": duration_seconds(c) for c in times}).withColumn("service_date", F.explode("service_dates"))

    def at(dfm: str) -> Column:
        seconds = F.col(f"_s_{dfm}")
        if strict:
            seconds = F.when(seconds.isNull(), F.raise_error(F.concat(F.lit("Invalid time: "), F.coalesce(dfm, F.lit("NULL"))))).otherwise(seconds)
        return instant(F.col("service_date"), seconds, timezone)

    return dated.select(
        at("departure_dfm").alias("departureTime"), F.col("departure_stop").alias("departureStop"), at("arrival_dfm").alias("arrivalTime"),
        F.col("arrival_stop").alias("arrivalStop"), F.col("trip").withField("startTime", at("trip_start_dfm")).alias("trip"), "route", "headsign",
        "stop_sequence", "pickup_type", "drop_off_type", "service_date", "trip_id", "_seq", "_ord", *[c for c in ("_hop", "_slot", "_rule") if c in dated.columns],
    )
