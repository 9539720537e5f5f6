"""Dates and times of day written in mixed forms, as Column expressions.

`parse` brings a text to its parts; which of day and month comes first in an
all-numeric date stays open until an order is given to `local_date`. Instants are
seconds since 1970 as bigint, so that no result depends on the session's zone.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.text import strip

# Zone abbreviations that mean one offset wherever they occur, in minutes from UTC. Others are read by the source's own zone.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "JST": 540,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
# English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

CANONICAL_TIME = r"^[0-9]{2}:[0-5][0-9]:[0-5][0-9]$"
CANONICAL_DATE = r"^[0-9]{8}$"

_MIN = "([0-5][0-9])"
_SEC = "([0-5][0-9])(?:[.,][0-9]+)?"
_ZONE = r"\s*(Z|[+-][0-9]{2}(?::?[0-9]{2})?|\[?[A-Za-z]+(?:/[A-Za-z_]+)+\]?|[A-Za-z]{2,5})?"
_OF_DAY = rf"(?:T|,?\s+)([01]?[0-9]|2[0-3]):{_MIN}(?::{_SEC})?{_ZONE}"
_EPOCH = r"^([0-9]{9,10}|[0-9]{12,13}|[0-9]{15,16})$"
#: Elapsed times: pattern and what its groups become.
_CLOCKS = (
    (rf"(?i)^([0-9]{{1,3}})[:.h]{_MIN}(?:[:.m]([0-5][0-9])(?:[.,][0-9]+|s)?)?$", "clock|||$1|$2|$3||"),
    (rf"(?i)^(0?[1-9]|1[0-2])[:.h]{_MIN}(?:[:.m]([0-5][0-9])(?:[.,][0-9]+|s)?)?\s*([ap])(?:m|\.m\.)$", "clock|||$1|$2|$3||$4"),
    (rf"^([0-9]{{2}}){_MIN}([0-5][0-9])$", "clock|||$1|$2|$3||"),
)
#: Days: what stands before the time of day, and its kind, year, and the two others.
_DAYS = (
    (r"([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", "dated|$1|$2|$3", 3),
    (r"([0-9]{1,2})([./-])([0-9]{1,2})\2([0-9]{4}|[0-9]{2})", "numeric|$4|$1|$3", 4),
    (r"(?:[A-Za-z]+,?\s+)?([0-9]{1,2})[\s-]+([A-Za-z]{3,9})\.?,?[\s-]+([0-9]{4})", "dated|$3|$2|$1", 3),
    (r"(?:[A-Za-z]+,\s+)?([A-Za-z]{3,9})\.?\s+([0-9]{1,2}),?\s+([0-9]{4})", "dated|$3|$1|$2", 3),
)
_COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})T?([01][0-9]|2[0-3])([0-5][0-9])([0-5][0-9])" + _ZONE + "$"
_ORDINAL = r"^([0-9]{4})-([0-9]{3})$"


def _forms(times: bool) -> list[tuple[str, str]]:
    """(pattern, template) in order; a template is kind|y|a|b|h|mi|s|zone|half|form, forms numbered."""
    out = [*_CLOCKS] if times else [(r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "dated|$1|$2|$3|||||"), (_ORDINAL, "ordinal|$1||$2|||||")]
    out = [(p, t.replace("clock|||", "clock||||")) for p, t in out]
    out += [(_EPOCH, "epoch|$1|||||||"), (_COMPACT, "dated|$1|$2|$3|$4|$5|$6|$7|")]
    for day, template, n in _DAYS:
        out.append((f"^{day}{_OF_DAY}$", f"{template}|${n + 1}|${n + 2}|${n + 3}|${n + 4}|"))
        if not times:
            out.append((f"^{day}$", f"{template}|||||"))
    return [(p, f"{t}|{i}") for i, (p, t) in enumerate(out)]


def tokens(value: Column, times: bool) -> Column:
    """The parts of a written time (`times`) or date as one text, NULL where it states none.

    Minutes or seconds above 59 and hours of a day above 23 state none. Each form is
    one pattern, so whether a value states something is known from this alone.
    """
    v = strip(value)
    return reduce(lambda c, f: c.when(v.rlike(f[0]), F.regexp_replace(v, *f)), _forms(times), F.when(v.isNull(), F.lit(None).cast("string")))


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _month(text: Column) -> Column:
    short = F.lower(F.substring(text, 1, 3))
    named = F.try_element_at(F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)]), short)
    return F.coalesce(_int(text), named)


def with_parts(df: DataFrame, value: Column, times: bool) -> DataFrame:
    """`df` with the struct `parsed` of the value's parts, NULL where it states no time (`times`) or no date.

    kind is `clock` (elapsed time h, mi, s), `epoch` (seconds), `dated` (year y, month
    a, day b) or `numeric` (a and b in unknown order). Dated kinds without a time of
    day have a NULL h. `form` numbers the pattern that the value is written by.
    """
    df = df.withColumn("_tokens", tokens(value, times)).withColumn("_parts", F.split("_tokens", r"\|", -1))
    t = lambda i: F.nullif(F.get("_parts", F.lit(i)), F.lit(""))
    kind, year = t(0), _int(t(1))
    digits = t(1).try_cast("bigint")
    epoch = F.when(F.length(t(1)) >= 15, F.floor(digits / 1000000)).when(F.length(t(1)) >= 12, F.floor(digits / 1000)).otherwise(digits)
    half, hour = F.lower(t(8)), _int(t(4))
    hour = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
    day_of_year = F.date_add(F.concat(t(1), F.lit("-01-01")).try_cast("date"), _int(t(3)) - 1)
    ordinal = (kind == "ordinal") & (F.year(day_of_year) == year)
    parts = F.struct(
        F.when(kind == "ordinal", "dated").otherwise(kind).alias("kind"),
        F.when(kind == "epoch", None).when(year < 100, year + 2000).otherwise(year).alias("y"),
        F.when(ordinal, F.month(day_of_year)).when(kind == "numeric", _int(t(2))).otherwise(_month(t(2))).alias("a"),
        F.when(ordinal, F.day(day_of_year)).when(kind == "ordinal", None).otherwise(_int(t(3))).alias("b"),
        hour.alias("h"), _int(t(5)).alias("mi"), F.when(hour.isNotNull(), F.coalesce(_int(t(6)), F.lit(0))).alias("s"),
        t(7).alias("zone"), F.when(kind == "epoch", epoch).cast("bigint").alias("epoch"), _int(t(9)).alias("form"),
    )
    return df.withColumn("parsed", F.when(F.col("_tokens").isNotNull(), parts)).drop("_parts", "_tokens")


def local_date(p: Column, order: Column) -> Column:
    """The date of a parsed value as written, given `DMY` or `MDY` for all-numeric ones; NULL where no such day exists."""
    swap = (p["kind"] == "numeric") & (order == "DMY")
    month, day = F.when(swap, p["b"]).otherwise(p["a"]), F.when(swap, p["a"]).otherwise(p["b"])
    first = F.when(month.between(1, 12) & p["y"].between(1, 9999), F.make_date(p["y"], month, F.lit(1)))
    return F.when(day.between(1, F.day(F.last_day(first))), F.date_add(first, day - 1))


def epoch_of(wall: Column) -> Column:
    """Seconds since 1970 of a wall clock (timestamp without zone) read as UTC."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), wall)


def wall_of(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def to_utc(wall: Column, zone: Column) -> Column:
    return F.convert_timezone(zone, F.lit("UTC"), wall)


def to_local(wall_utc: Column, zone: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), zone, wall_utc)


def zone_state(wall: Column, utc: Column, zone: Column) -> Column:
    """`nonexistent` or `ambiguous` for wall clocks skipped or repeated in a zone, else NULL; utc is `to_utc` of the wall."""
    twice = F.lit(False)
    for minutes in (30, 60, 120):
        for sign in (1, -1):
            twice = twice | (to_local(F.timestamp_add("MINUTE", F.lit(sign * minutes), utc), zone) == wall)
    return F.when(to_local(utc, zone) != wall, "nonexistent").when(twice, "ambiguous")


def zone_abbreviations(zone: str | None) -> dict[str, int]:
    """The abbreviations that a zone itself has used since 2000, with their offsets in seconds."""
    try:
        own = ZoneInfo(zone) if zone else None
    except (ZoneInfoNotFoundError, ValueError):
        own = None
    found = {}
    for month in range(12 * 38) if own else ():
        at = datetime(2000 + month // 12, month % 12 + 1, 15, tzinfo=own)
        if at.tzname().isalpha():
            found[at.tzname().upper()] = int(at.utcoffset().total_seconds())
    return found


def offset_seconds(zone: Column, own: Column) -> Column:
    """Offset of a written zone, NULL for none and for named zones; abbreviations are those of the map `own`, or else unmistakable ones."""
    signed = r"^([+-])([0-9]{2}):?([0-9]{2})?$"
    value = F.coalesce(_int(F.regexp_extract(zone, signed, 2)), F.lit(0)) * 3600 + F.coalesce(_int(F.regexp_extract(zone, signed, 3)), F.lit(0)) * 60
    known = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v * 60)])
    named = F.coalesce(F.try_element_at(own, F.upper(zone)), F.try_element_at(known, F.upper(zone)))
    return F.when(zone.rlike(signed), F.when(zone.startswith("-"), -value).otherwise(value)).otherwise(named)


def named_zone(zone: str, known: list[str]) -> Column:
    """The IANA zone written in the column named `zone`, with or without brackets, if it is one of `known`."""
    name = f"regexp_replace({zone}, '[\\\\[\\\\]]', '')"
    return F.expr(f"CASE WHEN {name} IN ({', '.join(repr(k) for k in known)}) THEN {name} END")
