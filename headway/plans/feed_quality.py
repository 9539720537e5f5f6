"""Queries p1 to p5 over the feed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions import timeparse as tp
from headway.functions.text import strip, strip_to_null
from headway.operators import fill, orphans, reject, snapshot_diff, time_forms
from headway.sources.tables import table


def _seconds(c: str) -> Column:
    """A GTFS time as seconds; a text that is none stays as it is."""
    v = strip_to_null(c)
    pattern = r"^([0-9]+):([0-9]{1,2})(?::([0-9]{1,2}))?$"
    part = lambda k: F.coalesce(F.regexp_extract(v, pattern, k).try_cast("bigint"), F.lit(0))
    at = lambda k: F.substring(v, k, 2).try_cast("bigint")
    full = F.when(v.rlike("^[0-9]{2}:[0-9]{2}:[0-9]{2}$"), (at(1) * 3600 + at(4) * 60 + at(7)).cast("string"))
    return full.when(v.rlike(pattern), (part(1) * 3600 + part(2) * 60 + part(3)).cast("string")).otherwise(v)


def _days(c: str) -> Column:
    """A set of days: separators don't matter, nor do order, repetitions and blank entries; NULL is the empty set.

    The days are handled as one text, which stays in compiled code.
    """
    mark = "\u0001"
    whole = F.array_join(F.col(c), mark)  # NULL entries are left out
    bare = F.regexp_replace(whole, rf"(?<=^|{mark})[ \t]+|[ \t]+(?={mark}|\z)", "")
    bare = F.regexp_replace(bare, rf"(?<=^|{mark})([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})(?={mark}|\z)", "$1$2$3")
    days = F.split(F.when(whole.rlike(r"[- \t]"), bare).otherwise(whole), mark)
    return F.coalesce(F.array_join(F.sort_array(F.array_distinct(F.array_remove(days, ""))), ","), F.lit(""))


def p1_changes(spark: SparkSession, d: str, levels=None) -> DataFrame:
    df = table(spark, d, "rule_snapshots")
    df = snapshot_diff.last_delivery(df, "snapshot_no", "delivery_no")
    content = [F.coalesce(c, F.lit("\u0000")) for c in (
        strip_to_null("departure_stop"), strip_to_null("arrival_stop"), _seconds("departure_dfm"), _seconds("arrival_dfm"),
        strip_to_null("pickup_type"), strip_to_null("drop_off_type"), strip_to_null("headsign"), _days("service_dates"),
    )]
    return snapshot_diff.diff_snapshots(df, "snapshot_no", ["trip_id", "stop_sequence"], content, levels)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_changes(spark, d).select(
        F.col("prev_snapshot").alias("prev_snapshot_no"), F.col("snapshot").alias("snapshot_no"), "trip_id", "stop_sequence", "change_type"
    )


def p1_summary(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("prev_snapshot_no", "snapshot_no", "change_type").agg(F.count(F.lit(1)).alias("n_rules"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    stop_times = table(spark, d, "stop_times", "row_id", "feed_period", "loaded_at", "stop_id", "trip_id")
    trips = table(spark, d, "trips", "row_id", "feed_period", "loaded_at", "route_id", "service_id")
    versions = ("loaded_at", "deleted_at")
    calendar = table(spark, d, "calendar", "service_id", *versions)
    added = table(spark, d, "calendar_dates", "service_id", "loaded_at").withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    period = ["feed_period", "row_id"]
    of_stop_times = {"stop_id": (table(spark, d, "stops", "stop_id", *versions), "stop_id"), "trip_id": (table(spark, d, "trips", "trip_id", *versions), "trip_id")}
    of_trips = {"route_id": (table(spark, d, "routes", "route_id", *versions), "route_id"), "service_id": (calendar.unionByName(added), "service_id")}
    first = orphans.orphan_references(stop_times, list(of_stop_times), "loaded_at", period, of_stop_times).withColumn("child_table", F.lit("stop_times"))
    second = orphans.orphan_references(trips, list(of_trips), "loaded_at", period, of_trips).withColumn("child_table", F.lit("trips"))
    return first.unionByName(second).select("child_table", "field_name", "feed_period", "row_id", "reason")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("child_table", "field_name", "feed_period", "reason").agg(F.count(F.lit(1)).alias("n_references"))


def _iso_day(c: str) -> Column:
    """The day of a yyyyMMdd text, NULL where it names none."""
    v = strip(c)
    return F.when(v.rlike(tp.CANONICAL_DATE), F.concat_ws("-", F.substring(v, 1, 4), F.substring(v, 5, 2), F.substring(v, 7, 2)).try_cast("date"))


def _stop_time_values(spark: SparkSession, d: str, form: str | None = None) -> DataFrame:
    """(source, row_id, trip_id, stop_sequence, day, field_name, value), two rows per stop time; with `form`, of rows where a value has it."""
    rows = table(spark, d, "stop_times", "row_id", "agency_id", "trip_id", "service_date", "stop_sequence", "arrival_time", "departure_time")
    if form:
        rows = rows.where(F.col("arrival_time").rlike(form) | F.col("departure_time").rlike(form))
    fields = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("arrival_time", "departure_time")])
    return rows.select(F.col("agency_id").alias("source"), "row_id", "trip_id", "stop_sequence", _iso_day("service_date").alias("day"), F.inline(fields))


def _no_time(c: str) -> Column:
    return ~F.coalesce(F.col(c).rlike(tp.CANONICAL_TIME), F.lit(False)) & tp.tokens(F.col(c), True).isNull()


TIMES = ("arrival_time", "departure_time")
#: Beginning of an all-numeric date, the only form whose reading has to be learnt.
_OPEN_FORM = r"^[ \t]*[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]"


def _seconds_of_day(rows: DataFrame, c: str) -> DataFrame:
    """`rows` with `_s_{c}`: the time in column `c` in seconds from local midnight, NULL where it states none."""
    columns = rows.columns
    parsed = tp.with_parts(rows, F.when(~F.col(c).rlike(tp.CANONICAL_TIME), F.col(c)), True)
    p, v = F.col("parsed"), F.col(c)
    part = lambda at: F.substring(v, at, 2).try_cast("bigint")
    elapsed = F.when(p.isNotNull(), F.col("_seconds") - tp.epoch_of(tp.to_utc(F.col("day").cast("timestamp_ntz"), F.col("zone"))))
    wall = F.coalesce((p["h"] * 3600 + p["mi"] * 60 + p["s"]).cast("bigint"), F.lit(0).cast("bigint"))
    seconds = F.when(v.rlike(tp.CANONICAL_TIME), part(1) * 3600 + part(4) * 60 + part(7)).when(p.isNotNull(), F.coalesce(elapsed, wall))
    return time_forms.resolve(parsed, "day").select(*columns, seconds.alias(f"_s_{c}"))


def p3_filled(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, field_name, value, method, distance) of each filled time, value in seconds from local midnight.

    The place of a row in its trip is its stop_sequence, 0 where that is unusable. A
    value whose instant stays open counts with its wall clock.
    """
    sources = time_forms.agency_sources(table(spark, d, "agency"))
    values = _stop_time_values(spark, d, _OPEN_FORM).where(F.col("value").rlike(_OPEN_FORM))
    learnt = time_forms.learn_formats(tp.with_parts(values, F.col("value"), True), sources)
    rows = table(spark, d, "stop_times", "row_id", "agency_id", "trip_id", "service_date", "stop_sequence", *TIMES)
    simple = F.lit(True)
    for c in TIMES:
        simple = simple & F.coalesce(F.col(c).rlike(tp.CANONICAL_TIME) | strip_to_null(c).isNull(), F.lit(True))
    part = lambda c, at: F.substring(c, at, 2).try_cast("bigint")
    plain = rows.where(simple).withColumns({f"_s_{c}": F.when(F.col(c).rlike(tp.CANONICAL_TIME), part(c, 1) * 3600 + part(c, 4) * 60 + part(c, 7)) for c in TIMES})
    other = rows.where(~simple).withColumn("day", _iso_day("service_date")).join(learnt, F.col("agency_id").eqNullSafe(F.col("source")), "left")
    for c in TIMES:
        other = _seconds_of_day(other, c)
    parsed = plain.unionByName(other.select(*plain.columns))
    sequence = F.when(reject.good_sequence(F.col("stop_sequence")), strip("stop_sequence").try_cast("bigint"))
    seconds = {c: F.col(f"_s_{c}") for c in TIMES}
    filled = fill.fill_in_order(parsed, strip_to_null("trip_id"), sequence, seconds, {}, ["row_id"], gaps=(rows, {c: _no_time(c) for c in TIMES}))
    return filled.withColumn("value", F.col("value").cast("bigint"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_filled(spark, d).select("row_id", "field_name").distinct()


def p3_headsigns(spark: SparkSession, d: str) -> DataFrame:
    """Categories carried along a trip for at most three places."""
    rows = table(spark, d, "stop_times", "row_id", "trip_id", "stop_sequence", "stop_headsign")
    sequence = F.when(reject.good_sequence(F.col("stop_sequence")), strip("stop_sequence").try_cast("bigint"))
    return fill.fill_in_order(rows, strip_to_null("trip_id"), sequence, {}, {"stop_headsign": strip_to_null("stop_headsign")}, ["row_id"])


def p4_rejected(spark: SparkSession, d: str) -> DataFrame:
    raw = reject.rejected_records(table(spark, d, "raw_lines"), ["row_id"]).withColumn("table_name", F.lit("raw_lines"))
    stop_times = reject.rejected_values(table(spark, d, "stop_times", "row_id", "stop_sequence", "pickup_type"), ["row_id"], ["stop_sequence", "pickup_type"])
    calendar = reject.rejected_values(table(spark, d, "calendar", "row_id", "start_date"), ["row_id"], ["start_date"])
    loaded = stop_times.withColumn("table_name", F.lit("stop_times")).unionByName(calendar.withColumn("table_name", F.lit("calendar")))
    return raw.unionByName(loaded, allowMissingColumns=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_rejected(spark, d).select("table_name", "row_id", "reason")


def p4_loaded_stop_times(spark: SparkSession, d: str) -> DataFrame:
    return reject.loaded_records(table(spark, d, "raw_lines"), "stop_times.txt", ["row_id", "delivery_id"])


def p4_loaded_calendar(spark: SparkSession, d: str) -> DataFrame:
    return reject.loaded_records(table(spark, d, "raw_lines"), "calendar.txt", ["row_id", "delivery_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    sources = time_forms.agency_sources(table(spark, d, "agency"))
    values = _stop_time_values(spark, d).where(~F.col("value").rlike(tp.CANONICAL_TIME))
    times = time_forms.normalise_times(values, sources, ["row_id", "field_name"]).withColumn("table_name", F.lit("stop_times"))
    dates = table(spark, d, "calendar_dates", "row_id", "agency_id", "date").select(
        F.col("agency_id").alias("source"), "row_id", F.lit("date").alias("field_name"), F.col("date").alias("value")
    )
    dates = dates.where(~F.col("value").rlike(tp.CANONICAL_DATE) & strip_to_null("value").isNotNull())
    days = time_forms.normalise_dates(dates, sources, ["row_id", "field_name"]).withColumn("table_name", F.lit("calendar_dates"))
    columns = ["table_name", "row_id", "field_name", "norm_value"]
    return times.select(*columns).unionByName(days.select(*columns))


QUERIES = {f.__name__: f for f in (p1_found, p1_summary, p2_found, p2_report, p3_found, p3_filled, p3_headsigns, p4_found, p4_rejected, p4_loaded_stop_times, p4_loaded_calendar, p5_found)}

# SQL for DuckDB. Blank is NULL, empty or only spaces and tabs.


def _t(c: str) -> str:
    return f"nullif(trim({c}, ' ' || chr(9)), '')"


def _sec(c: str) -> str:
    part = lambda k: f"coalesce(try_cast(nullif(split_part({_t(c)}, ':', {k}), '') AS BIGINT), 0)"
    return f"CASE WHEN regexp_full_match({_t(c)}, '[0-9]+:[0-9]{{1,2}}(:[0-9]{{1,2}})?') THEN ({part(1)} * 3600 + {part(2)} * 60 + {part(3)})::varchar ELSE {_t(c)} END"


_P1 = f"""WITH last AS (SELECT snapshot_no, max(delivery_no) AS delivery_no FROM rule_snapshots GROUP BY 1),
content AS (
  SELECT DISTINCT snapshot_no, trip_id, stop_sequence, {_t('departure_stop')} AS a, {_t('arrival_stop')} AS b, {_sec('departure_dfm')} AS c, {_sec('arrival_dfm')} AS d, {_t('pickup_type')} AS e,
    {_t('drop_off_type')} AS f, {_t('headsign')} AS g, list_sort(list_distinct(list_transform(coalesce(service_dates, []), lambda x: replace(x, '-', '')))) AS h
  FROM rule_snapshots JOIN last USING (snapshot_no, delivery_no)),
keyed AS (SELECT snapshot_no, trip_id, stop_sequence, list_sort(list((a, b, c, d, e, f, g, h)::varchar)) AS content FROM content GROUP BY ALL),
consecutive AS (SELECT lag(snapshot_no) OVER (ORDER BY snapshot_no) AS p, snapshot_no AS n FROM last),
compared AS (
  SELECT coalesce(x.p, y.p2) AS p, coalesce(x.n, y.n2) AS n, coalesce(x.trip_id, y.trip_id) AS trip_id, coalesce(x.stop_sequence, y.stop_sequence) AS stop_sequence,
    CASE WHEN y.snapshot_no IS NULL THEN 'added' WHEN x.snapshot_no IS NULL THEN 'removed' WHEN x.content <> y.content THEN 'changed' END AS change_type
  FROM (SELECT p, n, k.* FROM consecutive JOIN keyed k ON k.snapshot_no = n WHERE p IS NOT NULL) x
  FULL JOIN (SELECT p AS p2, n AS n2, k.* FROM consecutive JOIN keyed k ON k.snapshot_no = p) y ON x.n = y.n2 AND x.trip_id = y.trip_id AND x.stop_sequence = y.stop_sequence)
SELECT p AS prev_snapshot_no, n AS snapshot_no, trip_id, stop_sequence, change_type FROM compared WHERE change_type IS NOT NULL"""


def _orphans(child: str, field: str, parents: str) -> str:
    return f"""SELECT '{child}' AS child_table, '{field}' AS field_name, c.feed_period, c.row_id,
  CASE WHEN count(p.k) = 0 THEN 'missing' WHEN min(p.l) > any_value(c.loaded_at) THEN 'late' ELSE 'deleted' END AS reason
FROM {child} c LEFT JOIN ({parents}) p ON p.k = {_t('c.' + field)} WHERE {_t('c.' + field)} IS NOT NULL
GROUP BY c.feed_period, c.row_id HAVING NOT coalesce(bool_or(p.l <= c.loaded_at AND (p.d IS NULL OR p.d > c.loaded_at)), false)"""


def _parents(table_name: str, key: str) -> str:
    return f"SELECT {_t(key)} AS k, loaded_at AS l, deleted_at AS d FROM {table_name}"


_P2 = " UNION ALL ".join((
    _orphans("stop_times", "stop_id", _parents("stops", "stop_id")), _orphans("stop_times", "trip_id", _parents("trips", "trip_id")),
    _orphans("trips", "route_id", _parents("routes", "route_id")),
    _orphans("trips", "service_id", _parents("calendar", "service_id") + f" UNION ALL SELECT {_t('service_id')}, loaded_at, NULL FROM calendar_dates"),
))

_BAD = {
    "stop_sequence": "NOT (regexp_full_match(coalesce({0}, ''), '[0-9]+') AND coalesce(try_cast({0} AS HUGEINT) <= 2147483647, false))",
    "pickup_type": "coalesce({0}, '') NOT IN ('', '0', '1', '2', '3')",
    "start_date": "NOT (regexp_full_match(coalesce({0}, ''), '[0-9]{{8}}') AND try_strptime(coalesce({0}, ''), '%Y%m%d') IS NOT NULL)",
}
_FIELD = '("([^"]|"")*"|[^",]*)'
_WELL = f"regexp_full_match(r, '(?s){_FIELD}(,{_FIELD})*')"
_RAW = f"""records AS (SELECT row_id, file_name, r, CASE file_name WHEN 'stop_times.txt' THEN 9 WHEN 'calendar.txt' THEN 10 END AS want, {_WELL} AS well,
    list_transform(regexp_extract_all(',' || r, '(?s),("(?:[^"]|"")*"|[^",]*)', 1), lambda f: CASE WHEN f[1] = '"' THEN replace(f[2:-2], '""', '"') ELSE f END) AS f
  FROM (SELECT row_id, file_name, regexp_replace(raw, chr(13) || '$', '') AS r FROM raw_lines WHERE line_no <> 1))"""
_P4 = f"""WITH {_RAW},
bad AS (
  SELECT 'raw_lines' AS table_name, row_id, CASE WHEN NOT well THEN 'quoting' ELSE 'column_count' END AS reason FROM records WHERE NOT well OR len(f) <> want
  UNION ALL SELECT 'raw_lines', row_id, 'stop_sequence' FROM records WHERE well AND len(f) = want AND want = 9 AND {_BAD['stop_sequence'].format(_t('f[5]'))}
  UNION ALL SELECT 'raw_lines', row_id, 'pickup_type' FROM records WHERE well AND len(f) = want AND want = 9 AND {_BAD['pickup_type'].format(_t('f[7]'))}
  UNION ALL SELECT 'raw_lines', row_id, 'start_date' FROM records WHERE well AND len(f) = want AND want = 10 AND {_BAD['start_date'].format(_t('f[9]'))}
  UNION ALL SELECT 'stop_times', row_id, 'stop_sequence' FROM stop_times WHERE {_BAD['stop_sequence'].format(_t('stop_sequence'))}
  UNION ALL SELECT 'stop_times', row_id, 'pickup_type' FROM stop_times WHERE {_BAD['pickup_type'].format(_t('pickup_type'))}
  UNION ALL SELECT 'calendar', row_id, 'start_date' FROM calendar WHERE {_BAD['start_date'].format(_t('start_date'))})
SELECT * FROM bad"""

_LOADED = """WITH {raw} SELECT row_id, delivery_id, {columns} FROM records JOIN raw_lines USING (row_id) WHERE well AND len(f) = want AND want = {want} AND {good}"""


def _loaded(file_name: str, typed: dict[str, str], bad: list[str]) -> str:
    names = reject.FILES[file_name]
    columns = ", ".join(f"{typed.get(c, '{0}').format('trim(f[' + str(i) + '], chr(32) || chr(9))')} AS {c}" for i, c in enumerate(names, 1))
    good = " AND ".join(f"NOT ({_BAD[c].format(_t(f'f[{names.index(c) + 1}]'))})" for c in bad)
    return _LOADED.format(raw=_RAW, columns=columns, want=len(names), good=good)


# Times and days by strptime over lists of formats; a wall clock's instants are all those, by any offset, that show it in its zone.
_ISO_FORMATS = "['%Y-%m-%d', '%Y/%m/%d', '%Y.%m.%d', '%d %b %Y', '%d-%b-%Y', '%d %B %Y', '%b %d, %Y', '%B %d, %Y', '%A %d %B %Y', '%A, %d %B %Y', '%a %d %b %Y', '%a, %d %b %Y']"
_BY_ORDER = "CASE WHEN regexp_matches(dpart, '[0-9]{{4}}$') THEN try_strptime(dpart, ['{0}/{1}/%Y', '{0}.{1}.%Y', '{0}-{1}-%Y']) ELSE try_strptime(dpart, ['{0}/{1}/%y', '{0}.{1}.%y', '{0}-{1}-%y']) END"
_DMY, _MDY = _BY_ORDER.format("%d", "%m"), _BY_ORDER.format("%m", "%d")
_ZONED = r"(Z|[+-][0-9]{2}(?::?[0-9]{2})?|\[?[A-Za-z]+(?:/[A-Za-z_]+)+\]?|[A-Za-z]{2,5})?"
_READ = f"""vals AS (
  SELECT 'stop_times' AS table_name, row_id, agency_id, field_name, raw, trim(raw, ' ' || chr(9)) AS v, try_strptime(service_date, '%Y%m%d') AS day, true AS timed
  FROM (UNPIVOT (SELECT row_id, agency_id, service_date, coalesce(arrival_time, '') AS arrival_time, coalesce(departure_time, '') AS departure_time FROM stop_times) ON arrival_time, departure_time INTO NAME field_name VALUE raw)
  UNION ALL SELECT 'calendar_dates', row_id, agency_id, 'date', date, trim(date, ' ' || chr(9)), NULL, false FROM calendar_dates WHERE date IS NOT NULL),
clocks AS (
  SELECT v.*, agency_timezone AS tz, date_order,
    CASE WHEN NOT timed THEN NULL WHEN regexp_full_match(v, '[0-9]{{1,3}}[:.hH][0-5][0-9]([:.mM][0-5][0-9]([.,][0-9]+|[sS])?)?') THEN regexp_extract(v, '^([0-9]+)[:.hH]([0-9]+)(?:[:.mM]([0-9]{{2}}))?', ['h', 'm', 's'])
      WHEN regexp_full_match(v, '(0?[1-9]|1[0-2])[:.hH][0-5][0-9]([:.mM][0-5][0-9]([.,][0-9]+|[sS])?)?\\s*[aApP](m|M|\\.[mM]\\.)') THEN regexp_extract(v, '^([0-9]+)[:.hH]([0-9]+)(?:[:.mM]([0-9]{{2}}))?', ['h', 'm', 's'])
      WHEN regexp_full_match(v, '[0-9]{{2}}[0-5][0-9][0-5][0-9]') THEN regexp_extract(v, '^(..)(..)(..)', ['h', 'm', 's']) END AS c,
    lower(regexp_extract(v, '([aApP])\\.?[mM]\\.?$', 1)) AS half,
    CASE WHEN regexp_full_match(v, '[0-9]{{9,10}}') THEN v::bigint WHEN regexp_full_match(v, '[0-9]{{12,13}}') THEN v::bigint // 1000 WHEN regexp_full_match(v, '[0-9]{{15,16}}') THEN v::bigint // 1000000 END AS epoch,
    regexp_extract(v, '^([0-9]{{8}})T?([01][0-9]|2[0-3])([0-5][0-9])([0-5][0-9])\\s*{_ZONED}$', ['d', 'h', 'm', 's', 'z']) AS k,
    regexp_extract(v, '^(.*?)(?:T|,?\\s+)([01]?[0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9])(?:[.,][0-9]+)?)?\\s*{_ZONED}$', ['d', 'h', 'm', 's', 'z']) AS t
  FROM vals v LEFT JOIN agency USING (agency_id)),
dated AS (
  SELECT *, CASE WHEN k.d <> '' THEN k.d WHEN t.d <> '' THEN t.d WHEN NOT timed THEN v END AS dpart, CASE WHEN k.d <> '' THEN k WHEN t.d <> '' THEN t END AS o,
    CASE WHEN c IS NOT NULL THEN (CASE half WHEN 'p' THEN c.h::int % 12 + 12 WHEN 'a' THEN c.h::int % 12 ELSE c.h::int END) * 3600 + c.m::int * 60 + coalesce(nullif(c.s, '')::int, 0) END AS elapsed FROM clocks),
walls AS (
  SELECT *, CASE WHEN regexp_full_match(dpart, '[0-9]{{8}}') THEN try_strptime(dpart, '%Y%m%d') WHEN regexp_full_match(dpart, '[0-9]{{4}}-[0-9]{{3}}') THEN try_strptime(dpart, '%Y-%j')
      WHEN regexp_full_match(dpart, '[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-]([0-9]{{4}}|[0-9]{{2}})') THEN CASE date_order WHEN 'MDY' THEN coalesce({_MDY}, {_DMY}) ELSE coalesce({_DMY}, {_MDY}) END
      ELSE try_strptime(dpart, {_ISO_FORMATS}) END AS d, coalesce(o.h::int * 3600 + o.m::int * 60 + coalesce(nullif(o.s, '')::int, 0), 0) AS of_day, nullif(o.z, '') AS z FROM dated),
zones AS (
  SELECT *, d + to_seconds(of_day) AS wall, CASE WHEN z LIKE '%/%' THEN replace(replace(z, '[', ''), ']', '') WHEN z IS NULL THEN tz END AS wall_zone,
    CASE WHEN regexp_matches(z, '^[+-]') THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (substr(regexp_replace(z, '[^0-9]', '', 'g'), 1, 2)::int * 3600 + coalesce(nullif(substr(regexp_replace(z, '[^0-9]', '', 'g'), 3, 2), '')::int, 0) * 60)
      ELSE CASE upper(z) {' '.join(f"WHEN '{n}' THEN {m * 60}" for n, m in {**tp.ABBREVIATIONS, 'IST': 330, 'BST': 60}.items())} END END AS shift FROM walls),
shown AS (
  SELECT *, CASE WHEN wall IS NOT NULL AND wall_zone IS NOT NULL AND epoch IS NULL AND elapsed IS NULL THEN list_distinct(list_filter(list_transform(range(-56, 57), lambda k: wall - to_minutes(k * 15)), lambda u: ((u AT TIME ZONE 'UTC') AT TIME ZONE wall_zone) = wall)) END AS instants FROM zones),
settled AS (
  SELECT *, CASE WHEN elapsed IS NOT NULL THEN ((day AT TIME ZONE tz) AT TIME ZONE 'UTC') + to_seconds(elapsed) WHEN epoch IS NOT NULL THEN TIMESTAMP '1970-01-01' + to_seconds(epoch) WHEN shift IS NOT NULL THEN wall - to_seconds(shift)
      WHEN len(instants) = 1 THEN instants[1] END AS utc, CASE WHEN len(instants) = 0 THEN 'nonexistent' WHEN len(instants) > 1 THEN 'ambiguous' END AS open_state FROM shown)"""
_P5 = f"""WITH {_READ}
SELECT table_name, row_id, field_name, CASE WHEN timed THEN coalesce(open_state, strftime(utc, '%Y-%m-%dT%H:%M:%SZ')) WHEN epoch IS NULL AND z IS NULL THEN strftime(d, '%Y-%m-%d') ELSE coalesce(open_state, strftime((utc AT TIME ZONE 'UTC') AT TIME ZONE tz, '%Y-%m-%d')) END AS norm_value
FROM settled WHERE (elapsed IS NOT NULL OR epoch IS NOT NULL OR d IS NOT NULL) AND NOT regexp_full_match(raw, CASE WHEN timed THEN '[0-9]{{2}}:[0-5][0-9]:[0-5][0-9]' ELSE '[0-9]{{8}}' END)"""
_SEQUENCE = f"CASE WHEN {_BAD['stop_sequence'].format(_t('stop_sequence'))} THEN 0 ELSE {_t('stop_sequence')}::bigint END"


def _filled(values: str) -> str:
    """Neighbours of each place of an entity, from `values` (row_id, e, x, field_name, v, lacks)."""
    side = lambda look, order: f"{look} OVER (PARTITION BY e, field_name ORDER BY x {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    seen = "last_value(CASE WHEN v IS NOT NULL THEN {} END IGNORE NULLS)"
    return f"""{values},
points AS (SELECT e, field_name, x, min(v) AS v FROM vals3 WHERE e IS NOT NULL GROUP BY ALL),
near AS (SELECT e, field_name, x, {side(seen.format('x'), '')} AS bx, {side(seen.format('v'), '')} AS bv, {side(seen.format('x'), 'DESC')} AS ax, {side(seen.format('v'), 'DESC')} AS av FROM points),
gaps AS (SELECT row_id, n.* FROM vals3 JOIN near n USING (e, field_name, x) WHERE lacks)"""


_P3_FILLED = f"""WITH {_READ}, {_filled(f"""vals3 AS (
  SELECT s.row_id, {_t('trip_id')} AS e, {_SEQUENCE} AS x, field_name, elapsed IS NULL AND epoch IS NULL AND d IS NULL AS lacks,
    CASE WHEN elapsed IS NOT NULL THEN elapsed WHEN utc IS NOT NULL THEN date_diff('second', (day AT TIME ZONE tz) AT TIME ZONE 'UTC', utc) WHEN d IS NOT NULL THEN of_day END AS v
  FROM settled s JOIN stop_times st ON st.row_id = s.row_id WHERE timed)""")}
SELECT row_id, field_name, CASE WHEN bx = x OR av IS NULL THEN bv WHEN bv IS NULL THEN av ELSE bv + round((av - bv)::double * (x - bx) / (ax - bx))::bigint END AS value,
  CASE WHEN bx = x THEN 'same_place' WHEN bv IS NULL THEN 'held_back' WHEN av IS NULL THEN 'held_forward' ELSE 'interpolated' END AS method, least(x - bx, ax - x) AS distance
FROM gaps WHERE bv IS NOT NULL OR av IS NOT NULL"""
_P3_HEADSIGNS = f"""WITH {_filled(f"vals3 AS (SELECT row_id, {_t('trip_id')} AS e, {_SEQUENCE} AS x, 'stop_headsign' AS field_name, {_t('stop_headsign')} AS v, v IS NULL AS lacks FROM stop_times)")}
SELECT row_id, field_name, CASE WHEN x - bx <= 3 THEN bv ELSE av END AS value, CASE WHEN bx = x THEN 'same_place' WHEN x - bx <= 3 THEN 'carried_forward' ELSE 'carried_back' END AS method, CASE WHEN x - bx <= 3 THEN x - bx ELSE ax - x END AS distance
FROM gaps WHERE coalesce(x - bx <= 3, false) OR coalesce(ax - x <= 3, false)"""
# The same reading decides which values are missing.
_P3 = f"""WITH {_READ}, stated AS (SELECT {_t('trip_id')} AS t, s.row_id, field_name, elapsed IS NULL AND epoch IS NULL AND d IS NULL AS lacks FROM settled s JOIN stop_times st ON st.row_id = s.row_id WHERE timed)
SELECT row_id, field_name FROM stated s WHERE lacks AND t IS NOT NULL AND EXISTS (SELECT 1 FROM stated o WHERE o.t = s.t AND o.field_name = s.field_name AND NOT o.lacks)"""

SQL: dict[str, str] = {
    "p1_found": _P1,
    "p1_summary": f"SELECT prev_snapshot_no, snapshot_no, change_type, count(*) AS n_rules FROM ({_P1}) GROUP BY ALL",
    "p2_found": _P2,
    "p2_report": f"SELECT child_table, field_name, feed_period, reason, count(*) AS n_references FROM ({_P2}) GROUP BY ALL",
    "p3_found": _P3,
    "p3_filled": _P3_FILLED,
    "p3_headsigns": _P3_HEADSIGNS,
    "p4_found": _P4,
    "p4_loaded_stop_times": _loaded("stop_times.txt", {"stop_sequence": "{0}::int"}, ["stop_sequence", "pickup_type"]),
    "p4_loaded_calendar": _loaded("calendar.txt", {"start_date": "strptime({0}, '%Y%m%d')::date"}, ["start_date"]),
    "p5_found": _P5,
}
