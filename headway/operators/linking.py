"""The second pass over linked connections: merging equal movements and linking successors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.text import or_empty
from headway.sources.tables import written

ORDER = ("departureTime", "arrivalTime", "gtfs:route", "departureStop", "arrivalStop", "@id")
MOVEMENT = ORDER[:5]
NOT_AVAILABLE = "gtfs:NotAvailable"
_BEFORE = (Window.unboundedPreceding, -1)


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _rank() -> Column:
    """0 to 3: 2 for a row that can't be boarded, plus 1 for one that can't be left. The lower rank hosts the higher."""
    off = lambda c, n: F.when(_c(c) == NOT_AVAILABLE, n).otherwise(0)
    return off("gtfs:pickupType", 2) + off("gtfs:dropOffType", 1)


def merge_movements(df: DataFrame) -> DataFrame:
    """Folds rows of the same movement, in descending order of `@id`, with `joinedWithTrip`, `willSplitInto` and `_slot`.

    Of two neighbours exactly one of which can't be boarded, the other is kept and joined
    with its trip; failing that, of two exactly one of which can't be left, the other is
    kept and splits into its trip; others stand side by side, the later one goes on.
    So what a row meets is the lowest rank before it, and it takes the lead if its own
    is no higher: the fold is a running minimum, and windows over one shuffle by
    movement do it without gathering a movement's rows. A lead that meets a lower rank
    is taken up with what it had taken up itself forgotten. NULL is a value like others,
    and not the empty text; rows without times fold like others, as streams of sorted
    rows that spill. Rows shuffled by a column `_hop` that equal movements share stay where they are.
    """
    # A hash in front spares the sorts most comparisons of texts that begin alike.
    keys = [f"`{k}`" for k in MOVEMENT]
    groups = [*(c for c in ("_hop",) if c in df.columns), "_gh", *keys]
    rows = df.select("*", F.xxhash64(*keys).alias("_gh"), _rank().alias("_r"))
    down = (_c("@id").desc_nulls_last(), F.col("_ord"))
    w = Window.partitionBy(*groups).orderBy(*down)
    met = rows.withColumn("_met", F.min("_r").over(w.rowsBetween(*_BEFORE)))
    leads = F.col("_met").isNull() | (F.col("_r") <= F.col("_met"))
    numbered = met.withColumns({"_leads": leads, "_slot": F.sum(leads.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    lead_trip = F.last(F.when(F.col("_leads"), F.struct(_c("gtfs:trip").alias("trip"))), ignorenulls=True).over(w.rowsBetween(*_BEFORE))
    led = numbered.withColumn("_prev", F.when(F.col("_leads"), lead_trip))
    # A lead takes up the one before it if its rank is lower, and all that follow until the next lead.
    part = Window.partitionBy(*groups, "_slot").orderBy(*down).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = F.when(~F.col("_leads"), F.struct(_c("gtfs:trip").alias("trip"), (F.col("_r") - F.col("_met") >= F.when(F.col("_met") % 2 == 1, 1).otherwise(2)).alias("joined")))
    taken = led.withColumn("_taken", F.collect_list(over).over(part)).where("_leads")
    took = F.col("_r") < F.col("_met")
    by_pickup = F.floor(F.col("_met") / 2) > F.floor(F.col("_r") / 2)
    of = lambda joined: F.transform(F.filter("_taken", lambda t: t["joined"] == joined), lambda t: t["trip"])
    none = F.array().cast("array<string>")
    first = lambda when: F.when(took & when, F.array("_prev.trip")).otherwise(none)
    some = lambda a: F.when(F.size(a) > 0, a)
    kept = F.lead("_r").over(Window.partitionBy(*groups).orderBy("_slot"))
    out = taken.withColumn("_next_r", kept).where(F.col("_next_r").isNull() | (F.col("_next_r") == F.col("_r")))
    lists = {"joinedWithTrip": some(F.concat(first(by_pickup), of(True))), "willSplitInto": some(F.concat(first(~by_pickup), of(False)))}
    return out.withColumns(lists).drop("_gh", "_r", "_met", "_leads", "_prev", "_taken", "_next_r")


def unmerged(df: DataFrame) -> DataFrame:
    """Rows that are alone in their movement, as `merge_movements` gives them."""
    none = F.lit(None).cast("array<string>")
    return df.select("*", F.lit(1).cast("bigint").alias("_slot"), none.alias("joinedWithTrip"), none.alias("willSplitInto"))


def _processed() -> list[Column]:
    """The order of processing of folded rows: from the last movement back, in one movement by slots."""
    return [*[_c(k).desc_nulls_last() for k in MOVEMENT], F.col("_slot")]


def linked_in_trip(folded: DataFrame, by: str) -> DataFrame:
    """Adds `_next`, the `@id` of the next connection of the trip alone. Rows shuffled by `by`, which rows of a trip share, stay where they are."""
    return folded.withColumn("_next", F.lag(_c("@id")).over(Window.partitionBy(by, "`gtfs:trip`").orderBy(*_processed())))


def trip_events(folded: DataFrame) -> DataFrame:
    """A row per event of a trip (`_trip`): each row in its own (`_e` 2), and in the trips it takes up, `_e` 0 where it joins one, 1 where it splits.

    What an event finds, looking ahead in time within its trip, comes from one window:
    `_next` the nearest connection of the trip and `_host` the nearest trip that joined it.
    """
    own = _c("gtfs:trip")
    event = lambda kind, trip, k: F.struct(F.lit(kind).alias("_e"), trip.alias("_trip"), k.cast("int").alias("_k"))
    listed = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t, k: event(kind, t, k))
    events = F.concat(F.array(event(2, own, F.lit(0))), listed(0, F.col("joinedWithTrip")), listed(1, F.col("willSplitInto")))
    flat = folded.select("*", F.inline(events)).withColumn("_th", F.xxhash64("_trip"))
    ahead = Window.partitionBy("_th", "_trip").orderBy(*_processed(), "_e", "_k").rowsBetween(*_BEFORE)
    connection = F.when(F.col("_e") == 2, F.struct(_c("@id").alias("id"), F.col("willSplitInto").isNotNull().alias("splits")))
    host = F.when(F.col("_e") == 0, F.struct(own.alias("trip")))
    return flat.withColumns({"_next": F.last(connection, ignorenulls=True).over(ahead), "_host": F.last(host, ignorenulls=True).over(ahead)}).where("_e > 0")


def link_next(folded: DataFrame) -> DataFrame:
    """Adds `nextConnection` to folded rows: the next one of the trip, of the trips it splits into, or else of the trip that joined it.

    The rows with what they find in their trip are written once; the second look, into
    the joining trip, and the way back of what splits found are narrow and mostly few rows.
    """
    found = written(trip_events(folded))
    own = found.where("_e = 2")
    split = found.where(F.col("_e") == 1).where(F.col("_next").isNotNull()).select("_ord", "_k", F.col("_next.id").alias("_id"))
    at = [*(_c(k) for k in MOVEMENT), F.col("_slot")]
    lost = own.where(F.col("_next").isNull() & (F.col("_host.trip") != "")).select(F.col("_host.trip").alias("_trip"), *at, F.col("_ord").alias("_from"), F.lit(None).cast("string").alias("_id"))
    entries = own.select("_trip", *at, F.lit(None).cast("bigint").alias("_from"), _c("@id").alias("_id"))
    ahead = Window.partitionBy("_th", "_trip").orderBy(*_processed(), F.col("_from").asc_nulls_last()).rowsBetween(*_BEFORE)
    hosted = entries.unionByName(lost).withColumn("_th", F.xxhash64("_trip")).withColumn("_id", F.last("_id", ignorenulls=True).over(ahead)).where(F.col("_from").isNotNull() & F.col("_id").isNotNull())
    further = split.unionByName(hosted.select(F.col("_from").alias("_ord"), F.lit(-1).alias("_k"), "_id"))
    listed = F.array_sort(F.collect_list(F.when(F.col("_k") >= 0, F.struct("_k", "_id"))))
    ids = further.groupBy(F.col("_ord").alias("_o")).agg(F.transform(listed, lambda x: x["_id"]).alias("_ids"), F.max(F.when(F.col("_k") < 0, F.col("_id"))).alias("_at_host"))
    next_ = F.col("_next")
    splits = F.when(F.col("willSplitInto").isNotNull() & ~next_["splits"], F.col("_ids"))
    nexts = F.when(next_.isNotNull(), F.concat(F.array(next_["id"]), F.coalesce(splits, F.array().cast("array<string>")))).otherwise(F.when(F.col("_at_host").isNotNull(), F.array("_at_host")))
    linked = own.join(ids, F.col("_ord") == F.col("_o"), "left").withColumn("nextConnection", nexts)
    return linked.drop("_e", "_th", "_trip", "_k", "_next", "_host", "_o", "_ids", "_at_host", "joinedWithTrip", "willSplitInto")


def join_and_sort(df: DataFrame) -> DataFrame:
    """Merged, linked and sorted connections. `_ord` numbers the input's rows; without it, in the order of its files."""
    df = df if "_ord" in df.columns else df.withColumn("_ord", F.monotonically_increasing_id())
    return sort(link_next(merge_movements(df)))


def sort(linked: DataFrame) -> DataFrame:
    """Linked rows by movement and `@id`."""
    return linked.orderBy(*[or_empty(_c(k)) for k in ORDER], "_slot").drop("_ord", "_slot")
