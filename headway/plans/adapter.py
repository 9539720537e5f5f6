"""Two transit feeds, in Spark and in SQL: the delivered feed tables, and one made of the warehouse tables.

Of the latter, line items are stop times, orders trips, nations routes and suppliers
stops; its calendar is a fixed one over the five order priorities with every special
case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.sources.feed import Feed
from headway.sources.tables import small, table

DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
CALENDAR = (
    ("1-URGENT", "1111111", "20240101", "20240110"),
    ("2-HIGH", "1111100", "20240105", "20240118"),
    ("3-MEDIUM", "1010100", "20240112", "20240103"),
    ("5-LOW", "0000011", "20240101", "20240114"),
)
CALENDAR_DATES = (
    ("1-URGENT", "20240103", "2"), ("1-URGENT", "20240115", "1"), ("1-URGENT", "20240105", "1"), ("1-URGENT", "20240105", "2"),
    ("2-HIGH", "20240106", "1"), ("2-HIGH", "20240108", "2"), ("2-HIGH", "20240109", "3"),
    ("4-NOT SPECIFIED", "20240102", "1"), ("4-NOT SPECIFIED", "20240104", "1"), ("4-NOT SPECIFIED", "20240103", "2"),
)


def warehouse(spark: SparkSession, d: str) -> Feed:
    """The feed of the warehouse tables."""
    calendar = spark.createDataFrame([(i, s, *mask, a, b) for i, (s, mask, a, b) in enumerate(CALENDAR)], "_ord bigint, service_id string, " + ", ".join(f"{d} string" for d in DAYS) + ", start_date string, end_date string")
    dates = spark.createDataFrame(list(CALENDAR_DATES), "service_id string, date string, exception_type string")
    items = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus")
    items = items.withColumn("trip_id", F.col("l_orderkey").cast("string")).drop("l_orderkey")  # what follows is by trip_id too: one shuffle
    n = F.row_number().over(Window.partitionBy("trip_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    minutes = 360 + n * 10
    two = lambda v: F.concat(F.when(v < 10, "0").otherwise(""), v.cast("string"))
    clock = lambda m: F.concat(two((m / 60).cast("int")), F.lit(":"), two(m % 60), F.lit(":00"))
    stop_times = items.select(
        "trip_id", F.when(n % 7 == 4, "").otherwise(clock(minutes - 1)).alias("arrival_time"), F.when(n % 7 == 4, "").otherwise(clock(minutes)).alias("departure_time"),
        F.col("l_suppkey").cast("string").alias("stop_id"), n.cast("string").alias("stop_sequence"),
        F.when(F.col("l_returnflag") == "A", "0").when(F.col("l_returnflag") == "N", "1").otherwise("").alias("pickup_type"),
        F.when(F.col("l_linestatus") == "F", "0").otherwise("1").alias("drop_off_type"), n.cast("bigint").alias("_ord"),
    )
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    customers = table(spark, d, "customer", "c_custkey", "c_nationkey")
    trips = orders.join(small(customers), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("trip_id"), F.col("c_nationkey").cast("string").alias("route_id"), F.col("o_orderpriority").alias("service_id"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("trip_headsign"), F.col("o_orderkey").alias("_ord"),
    )
    routes = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("route_id"), F.col("n_name").alias("route_long_name"), F.col("n_nationkey").cast("bigint").alias("_ord"))
    code = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name"))
    stops = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("stop_id"), code.alias("stop_code"), F.col("s_suppkey").cast("bigint").alias("_ord"))
    return Feed(stop_times, trips, routes, stops, calendar, dates)


#: Columns that tell of a delivery, not of the feed.
_OF_DELIVERY = ("row_id", "loaded_at", "deleted_at", "feed_period")


def delivered(spark: SparkSession, d: str) -> Feed:
    """The feed tables as they were delivered: every row of every table, as text, NULL as empty, in the order of row_id."""

    def one(name: str) -> DataFrame:
        df = table(spark, d, name)
        return df.withColumn("_ord", F.col("row_id")).drop(*_OF_DELIVERY).na.fill("")

    return Feed(one("stop_times"), one("trips"), one("routes"), one("stops"), one("calendar"), one("calendar_dates"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)


#: The tables of both feeds for DuckDB: calendar_in, exceptions_in, st, tr, ro and sp.
WAREHOUSE = f"""
calendar_in(row_id, service_id, {', '.join(DAYS)}, start_date, end_date) AS (VALUES {', '.join('(' + str(i) + ', ' + ', '.join(f"'{v}'" for v in (s, *m, a, b)) + ')' for i, (s, m, a, b) in enumerate(CALENDAR))}),
exceptions_in(service_id, date, exception_type) AS (VALUES {_values(CALENDAR_DATES)}),
st AS (
  SELECT l_orderkey::varchar AS trip_id, n AS seq, n AS ord, CASE WHEN n % 7 = 4 THEN '' ELSE printf('%02d:%02d:00', (359 + n * 10) // 60, (359 + n * 10) % 60) END AS arrival_time,
    CASE WHEN n % 7 = 4 THEN '' ELSE printf('%02d:%02d:00', (360 + n * 10) // 60, (360 + n * 10) % 60) END AS departure_time, l_suppkey::varchar AS stop_id,
    CASE l_returnflag WHEN 'A' THEN '0' WHEN 'N' THEN '1' ELSE '' END AS pickup_type, CASE l_linestatus WHEN 'F' THEN '0' ELSE '1' END AS drop_off_type
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS n FROM lineitem)
),
tr AS (
  SELECT o_orderkey::varchar AS trip_id, c_nationkey::varchar AS route_id, o_orderpriority AS service_id, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS trip_headsign, '' AS trip_short_name
  FROM orders JOIN customer ON o_custkey = c_custkey
),
ro AS (SELECT n_nationkey::varchar AS route_id, n_name AS route_long_name FROM nation),
sp AS (SELECT s_suppkey::varchar AS stop_id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS stop_code FROM supplier),"""
DELIVERED = f"""
calendar_in AS (SELECT row_id, {', '.join(f"coalesce({c}, '') AS {c}" for c in ('service_id', *DAYS, 'start_date', 'end_date'))} FROM calendar),
exceptions_in AS (SELECT coalesce(service_id, '') AS service_id, coalesce(date, '') AS date, coalesce(exception_type, '') AS exception_type FROM calendar_dates),
st AS (SELECT {', '.join(f"coalesce({c}, '') AS {c}" for c in ('trip_id', 'arrival_time', 'departure_time', 'stop_id', 'pickup_type', 'drop_off_type'))}, try_cast(stop_sequence AS DOUBLE) AS seq, row_id AS ord FROM stop_times WHERE coalesce(trip_id, '') <> ''),
tr AS (SELECT {', '.join(f"coalesce({c}, '') AS {c}" for c in ('trip_id', 'route_id', 'service_id', 'trip_headsign', 'trip_short_name'))} FROM trips WHERE coalesce(trip_id, '') <> '' QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY row_id DESC) = 1),
ro AS (SELECT route_id, coalesce(route_long_name, '') AS route_long_name FROM routes WHERE coalesce(route_id, '') <> '' QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY row_id DESC) = 1),
sp AS (SELECT stop_id, coalesce(stop_code, '') AS stop_code FROM stops WHERE coalesce(stop_id, '') <> '' QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY row_id DESC) = 1),"""
_DAY = "CASE WHEN regexp_full_match({0}, '[0-9]{{8}}') THEN try_strptime({0}, '%Y%m%d')::date END"
#: What follows from them: service dates, stop pairs, rules and the first rule of each content and date.
DERIVED = f"""
cal AS (
  SELECT service_id, [{', '.join(DAYS)}] AS mask, {_DAY.format('start_date')} AS s, {_DAY.format('end_date')} AS e, count(*) OVER (PARTITION BY service_id) AS n
  FROM calendar_in WHERE service_id <> '' QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY row_id DESC) = 1
),
exc AS (SELECT DISTINCT service_id, {_DAY.format('date')} AS d, trim(exception_type) AS t FROM exceptions_in WHERE service_id <> ''),
run_days AS (SELECT service_id, unnest(generate_series(least(s, e), greatest(s, e), INTERVAL 1 DAY))::date AS d, mask, n FROM cal WHERE s IS NOT NULL AND e IS NOT NULL),
service_days AS (
  SELECT service_id, d FROM exc WHERE t = '1' AND d IS NOT NULL AND service_id NOT IN (SELECT service_id FROM cal WHERE n > 1)
  UNION
  SELECT service_id, d FROM run_days r WHERE mask[isodow(d)] = '1' AND (n > 1 OR NOT EXISTS (SELECT 1 FROM exc x WHERE x.service_id = r.service_id AND x.d = r.d AND x.t = '2'))
),
paired AS (
  SELECT trip_id, seq, ord, lag(stop_id) OVER w AS departure_stop_id, stop_id AS arrival_stop_id, lag(departure_time) OVER w AS departure_dfm, arrival_time AS arrival_dfm,
    first_value(departure_time) OVER w AS trip_start_dfm, lag(pickup_type) OVER w AS pickup_type, drop_off_type, departure_time AS leaves
  FROM st WINDOW w AS (PARTITION BY trip_id ORDER BY seq NULLS FIRST, ord)
),
pairs AS (SELECT * EXCLUDE (leaves) FROM paired WHERE departure_stop_id IS NOT NULL AND NOT (arrival_dfm = '' AND leaves = '')),
rules AS (
  SELECT p.*, tr.route_id, tr.service_id, ro.route_long_name, coalesce(nullif(tr.trip_headsign, ''), nullif(ro.route_long_name, '')) AS headsign,
    regexp_replace(ro.route_long_name, '[\\s\\p{{Z}}\\x{{FEFF}}]', '', 'g') || '/' || trip_short_name || '/' || coalesce(nullif(d.stop_code, ''), d.stop_id) || '/' || coalesce(nullif(a.stop_code, ''), a.stop_id) || '/'
      || trip_start_dfm || '/' || departure_dfm || '/' || arrival_dfm || '/' || pickup_type || '/' || drop_off_type AS rule_key
  FROM pairs p JOIN tr USING (trip_id) JOIN ro USING (route_id) JOIN sp d ON d.stop_id = departure_stop_id JOIN sp a ON a.stop_id = arrival_stop_id
),
dated AS (
  SELECT r.*, s.d AS service_date, row_number() OVER (PARTITION BY rule_key, s.d ORDER BY trip_id, seq NULLS FIRST, ord) AS nth
  FROM rules r JOIN service_days s USING (service_id)
),
fresh AS (SELECT * EXCLUDE (nth) FROM dated WHERE nth = 1)
"""
FEEDS = {"warehouse": WAREHOUSE + DERIVED, "delivered": DELIVERED + DERIVED}
