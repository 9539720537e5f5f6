"""Stop times to date-less connection rules, and the rules not seen before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.text import or_empty, some
from headway.operators.connections import duration_seconds
from headway.operators.numbering import numbered
from headway.operators.service_calendar import last_wins, with_order
from headway.sources.tables import small, written

def sequence_number(c: str = "stop_sequence") -> Column:
    return F.col(c).try_cast("double")


def stop_pairs(stop_times: DataFrame) -> DataFrame:
    """Each stop time with its predecessor in the trip and the trip's first departure.

    Order within a trip is the sequence number, then the rows' order. A pair into a stop
    without any time is dropped, after it has served as a predecessor. Columns a feed
    may leave out (pickup and drop-off type) count as empty. Rows of one trip id are one
    window, which spills; a trip is a vehicle run.
    """
    text = lambda c: or_empty(c) if c in stop_times.columns else F.lit("")
    df = with_order(stop_times).withColumn("_seq", sequence_number())
    by_trip = Window.partitionBy("trip_id").orderBy(F.col("_seq").asc_nulls_first(), "_ord")
    upto = by_trip.rowsBetween(Window.unboundedPreceding, 0)
    pairs = df.select(
        "trip_id", "_seq", "_ord",
        F.col("stop_id").alias("arrival_stop_id"), or_empty("arrival_time").alias("arrival_dfm"), or_empty("departure_time").alias("_leaves"),
        text("drop_off_type").alias("drop_off_type"), F.col("stop_sequence"),
        F.lag(F.struct(F.col("stop_id"), or_empty("departure_time").alias("departure_time"), text("pickup_type").alias("pickup_type"))).over(by_trip).alias("_prev"),
        F.first(or_empty("departure_time")).over(upto).alias("trip_start_dfm"),
    )
    kept = pairs.where(F.col("_prev").isNotNull() & ~((F.col("arrival_dfm") == "") & (F.col("_leaves") == "")))
    return kept.select(
        "trip_id", "_seq", "_ord", "stop_sequence", F.col("_prev.stop_id").alias("departure_stop_id"), "arrival_stop_id",
        F.col("_prev.departure_time").alias("departure_dfm"), "arrival_dfm", "trip_start_dfm", F.col("_prev.pickup_type").alias("pickup_type"), "drop_off_type",
    )


def _field(struct: str, names: list[str], name: str) -> Column:
    """A field of a struct column, NULL where the table has no such column."""
    return F.col(f"{struct}.`{name}`") if name in names else F.lit(None).cast("string")


def _required(struct: str, what: str, key: str, strict: bool) -> Column:
    if not strict:
        return F.col(struct)
    return F.when(F.col(struct).isNull(), F.raise_error(F.concat(F.lit(f"Missing {what}: "), or_empty(key)))).otherwise(F.col(struct))


def code_or_id(code: Column, stop_id: Column) -> Column:
    """A stop's code, or its id where it has none."""
    return F.coalesce(some(code), stop_id)


def bare_name(long_name: Column) -> Column:
    """A route's name without blanks of any kind."""
    return F.regexp_replace(or_empty(long_name), r"(?U)[\s﻿]", "")


def rule_key(long_name: Column, short_name: Column, dep: Column, arr: Column, start: Column, leaves: Column, arrives: Column, pickup: Column, drop: Column) -> Column:
    """A rule's content as text, free of ids of trips and services, stable from feed to feed."""
    return F.concat_ws("/", bare_name(long_name), *[or_empty(c) for c in (short_name, dep, arr, start, leaves, arrives, pickup, drop)])


def _dimension(table: DataFrame, key: str, name: str) -> DataFrame:
    """(_name, name): one row per key, packed into a struct of the table's own columns."""
    columns = [c for c in table.columns if c != "_ord"]
    return last_wins(table, key).select(F.col(key).alias(f"_{name}"), F.struct(*columns).alias(name))


def _with_dimensions(pairs: DataFrame, stops: DataFrame, trips: DataFrame, routes: DataFrame, how: str) -> DataFrame:
    """Pairs with their trip, stops and route. Few stops and routes are broadcast; trips are shuffled as their stop times are."""
    return _with_places(pairs.join(_dimension(trips, "trip_id", "trip"), F.col("trip_id") == F.col("_trip"), how), stops, routes, how)


def _with_places(pairs: DataFrame, stops: DataFrame, routes: DataFrame, how: str) -> DataFrame:
    stop = small(_dimension(stops, "stop_id", "stop"), stops)
    return (
        pairs.join(stop.withColumnsRenamed({"_stop": "_dep", "stop": "departure_stop"}), F.col("departure_stop_id") == F.col("_dep"), how)
        .join(stop.withColumnsRenamed({"_stop": "_arr", "stop": "arrival_stop"}), F.col("arrival_stop_id") == F.col("_arr"), how)
        .join(small(_dimension(routes, "route_id", "route"), routes), F.col("trip.route_id") == F.col("_route"), how)
    )


def rules(stop_times: DataFrame, stops: DataFrame, trips: DataFrame, routes: DataFrame, service_dates: DataFrame, strict: bool = False) -> DataFrame:
    """One rule per stop pair, joined to its dimensions before any date is expanded.

    Dimensions are packed into structs of their actual columns. With `strict` a missing
    dimension row fails the job, and names it; else it drops the rule, and
    `dropped_pairs` tells which and why. Rows without a trip id have no trip: without
    `strict` they are left out before anything is sorted.
    """
    names = {"stop": stops.columns, "trip": trips.columns, "route": routes.columns}
    st = stop_times.where(or_empty("trip_id") != "") if not strict else stop_times.withColumn(
        "trip_id", F.when(or_empty("trip_id") == "", F.raise_error(F.lit("Missing trip: "))).otherwise(F.col("trip_id"))
    )
    joined = _with_dimensions(stop_pairs(st), stops, trips, routes, "left" if strict else "inner")
    return _rule_rows(joined, names, service_dates, strict)


def _codes(names: dict[str, list[str]]) -> list[Column]:
    return [code_or_id(_field(side, names["stop"], "stop_code"), F.col(f"{side}.stop_id")) for side in ("departure_stop", "arrival_stop")]


def _rule_rows(joined: DataFrame, names: dict[str, list[str]], service_dates: DataFrame, strict: bool = False, *more: str) -> DataFrame:
    """Rules of pairs that are joined to their dimensions, with the columns `more`."""
    joined = joined.join(service_dates.withColumnRenamed("service_id", "_service"), F.col("trip.service_id") == F.col("_service"), "left")
    if strict:
        joined = joined.withColumns({
            "trip": _required("trip", "trip", "trip_id", strict), "departure_stop": _required("departure_stop", "stop", "departure_stop_id", strict),
            "arrival_stop": _required("arrival_stop", "stop", "arrival_stop_id", strict), "route": _required("route", "route", "trip.route_id", strict),
        })
    signs = lambda side: F.coalesce(
        some(_field(side, names["stop"], "stop_headsign")), some(_field("trip", names["trip"], "trip_headsign")), some(_field("route", names["route"], "route_long_name"))
    )
    key = rule_key(
        _field("route", names["route"], "route_long_name"), _field("trip", names["trip"], "trip_short_name"), *_codes(names),
        F.col("trip_start_dfm"), F.col("departure_dfm"), F.col("arrival_dfm"), F.col("pickup_type"), F.col("drop_off_type"),
    )
    return joined.select(
        key.alias("rule_key"), "trip", "route", "departure_stop", "arrival_stop", "departure_dfm", "arrival_dfm", "trip_start_dfm", "pickup_type", "drop_off_type",
        signs("arrival_stop").alias("headsign"), some(_field("departure_stop", names["stop"], "stop_headsign")).alias("previous_headsign"), "stop_sequence",
        F.coalesce("service_dates", F.array().cast("array<date>")).alias("service_dates"), "trip_id", "_seq", "_ord", *more,
    )


def fresh_rules(stop_times: DataFrame, stops: DataFrame, trips: DataFrame, routes: DataFrame, service_dates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What `new_rules` gives of `rules` without a history and rules without dates, as rules alone on their hop and others, with `_hop`.

    Of equal content, and of one movement, are only rules of one hop: route and stops by
    the names they have in `rule_key`. `_hop` is a hash of it; that two hops may share one does
    no harm. Rules alone on theirs need not meet others. Those that have others are shuffled
    by hop, so windows by `_hop` and more columns need no shuffle again; they spill. A rule
    without any usable time counts as one with others, its dates being of one movement.
    Pairs are written once, as keys; the small dimensions are joined again after it.
    """
    names = {"stop": stops.columns, "trip": trips.columns, "route": routes.columns}
    joined = _with_dimensions(stop_pairs(stop_times.where(or_empty("trip_id") != "")), stops, trips, routes, "inner")
    timed = duration_seconds("departure_dfm").isNotNull() | duration_seconds("arrival_dfm").isNotNull()
    hop = F.xxhash64(bare_name(_field("route", names["route"], "route_long_name")), *_codes(names))
    pairs = written(joined.select(
        "trip_id", "_seq", "_ord", "trip", "departure_stop_id", "arrival_stop_id", "departure_dfm", "arrival_dfm", "trip_start_dfm", "pickup_type", "drop_off_type", "stop_sequence",
        hop.alias("_hop"), timed.alias("_timed"),
    ))
    met = small(written(pairs.groupBy("_hop").agg(F.count(F.lit(1)).alias("_n"), F.min("_timed").alias("_all")).where((F.col("_n") > 1) | ~F.col("_all")).select("_hop")))
    rows = lambda df: _rule_rows(_with_places(df.drop("_timed"), stops, routes, "inner"), names, service_dates, False, "_hop")
    alone = rows(pairs.join(met, "_hop", "left_anti")).withColumn("service_dates", F.array_distinct("service_dates"))
    spread = 4 * int(stop_times.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are yet to be expanded by dates
    others = rows(pairs.join(met, "_hop", "left_semi").repartition(spread, "_hop"))
    # A set of dates that an earlier rule of the same content had adds nothing: the sets before a rule are as many as services differ.
    before = Window.partitionBy("_hop", "rule_key").orderBy("trip_id", F.col("_seq").asc_nulls_first(), "_ord").rowsBetween(Window.unboundedPreceding, -1)
    others = others.withColumn("_given", F.collect_set("service_dates").over(before))
    dates = F.array_sort(F.array_except("service_dates", F.flatten("_given")))
    return alone, others.withColumn("service_dates", dates).drop("_given")


def dropped_pairs(stop_times: DataFrame, stops: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """(trip_id, stop_sequence, _ord, missing, key): the stop pairs that give no rule, with the first dimension row they lack.

    `missing` is trip, departure_stop, arrival_stop or route, in this order.
    """
    joined = _with_dimensions(stop_pairs(stop_times.where(or_empty("trip_id") != "")), stops, trips, routes, "left")
    lacks = [("trip", "_trip", "trip_id"), ("departure_stop", "_dep", "departure_stop_id"), ("arrival_stop", "_arr", "arrival_stop_id"), ("route", "_route", "trip.route_id")]
    first = F.coalesce(*[F.when(F.col(found).isNull(), F.struct(F.lit(name).alias("missing"), or_empty(key).alias("key"))) for name, found, key in lacks])
    return joined.select("trip_id", "stop_sequence", "_ord", first.alias("_lack")).where(F.col("_lack").isNotNull()).select("trip_id", "stop_sequence", "_ord", "_lack.*")


def fresh_pairs(rule_rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(trip_id, _seq, _ord, rule_key, service_date): the first rule of each (key, date), unless in the history.

    Only the narrow key columns are expanded by date. The first rule is a minimum, so
    pairs are combined before they are shuffled and no key is sorted.
    """
    place = F.struct("trip_id", "_seq", "_ord")
    dated = rule_rows.select("rule_key", place.alias("_place"), F.explode(F.array_distinct("service_dates")).alias("service_date"))
    firsts = dated.groupBy("rule_key", "service_date").agg(F.min("_place").alias("_place"))
    if history is not None:
        firsts = firsts.join(history.select("rule_key", "service_date").distinct(), ["rule_key", "service_date"], "left_anti")
    return firsts.select("_place.trip_id", "_place._seq", "_place._ord", "rule_key", "service_date")


def new_rules(rule_rows: DataFrame, history: DataFrame | None = None, keep_dateless: bool = True) -> DataFrame:
    """Rules with the dates not given before, by this or an earlier rule of equal content.

    A rule whose key was never seen stays even without dates, once, as long as
    `keep_dateless`. `rule_rows` is read twice, whole and for its narrow keys; callers
    that build it at some cost write it once first (`sources.tables.checkpointed`).
    """
    pairs = fresh_pairs(rule_rows, history).groupBy(F.col("trip_id").alias("_t"), F.col("_seq").alias("_s"), F.col("_ord").alias("_o")).agg(
        F.array_sort(F.collect_list("service_date")).alias("_dates")
    )
    same = F.col("trip_id").eqNullSafe(F.col("_t")) & F.col("_seq").eqNullSafe(F.col("_s")) & (F.col("_ord") == F.col("_o"))
    joined = rule_rows.drop("service_dates").join(pairs, same, "left" if keep_dateless else "inner")
    if keep_dateless:
        first = F.min(F.struct("trip_id", "_seq", "_ord")).alias("_first")
        seen = rule_rows.groupBy(F.col("rule_key").alias("_k")).agg(first)
        if history is not None:
            seen = seen.join(history.select(F.col("rule_key").alias("_k")).distinct(), "_k", "left_anti")
        mine = (F.col("rule_key") == F.col("_k")) & (F.col("_first") == F.struct("trip_id", "_seq", "_ord"))
        joined = joined.join(seen, mine, "left").where(F.col("_dates").isNotNull() | F.col("_k").isNotNull()).drop("_k", "_first")
    return joined.withColumn("service_dates", F.coalesce("_dates", F.array().cast("array<date>"))).drop("_t", "_s", "_o", "_dates")


def history_of(rule_rows: DataFrame) -> DataFrame:
    """(rule_key, service_date, type), to be appended to the history after the output is written."""
    return rule_rows.select("rule_key", F.explode("service_dates").alias("service_date"), F.lit("Connection").alias("type"))


def deal_trips(stop_times: DataFrame, shards: int) -> DataFrame:
    """`stop_times` with `shard`: trips dealt out in turn in the order of their ids, none split. NULL is a trip id like others."""
    dealt = numbered(stop_times.select("trip_id").distinct(), [F.col("trip_id")], "_number")
    dealt = dealt.select(F.col("trip_id").alias("_t"), (F.col("_number") % shards).cast("int").alias("shard"))
    return stop_times.join(dealt, F.col("trip_id").eqNullSafe(F.col("_t"))).drop("_t")
