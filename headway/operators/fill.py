"""Filling missing values from the same entity's neighbours, in order.

Repeated rows of an entity first fall together to one point per (entity, position),
with map-side combining; points then lie in chunks of `CHUNK` positions. Within a
chunk the neighbours come from windows of at most `CHUNK` rows, across chunks from a
table of one row per chunk, so an entity that holds a third of all rows is many small
groups and one short list.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1024


def neighbours(points: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(_entity, _x, and per column its value, place and value of the last observed point at or before and of the first at or after).

    Both looks are running windows, in either order, over one partitioning by chunk; the
    chunks' own first and last points come from the same partitioning.
    """
    points = points.withColumn("_chunk", F.floor(F.col("_x") / CHUNK).cast("bigint")).repartition("_entity", "_chunk")
    inside = Window.partitionBy("_entity", "_chunk").rowsBetween(Window.unboundedPreceding, 0)
    back, ahead = inside.orderBy("_x"), inside.orderBy(F.col("_x").desc())
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("_x"))
    looks = {}
    for side, w in (("b", back), ("a", ahead)):
        for c in columns:
            looks[f"_{side}x_{c}"] = F.last(at(c), ignorenulls=True).over(w)
            looks[f"_{side}v_{c}"] = F.last(c, ignorenulls=True).over(w)
    local = points.select("_entity", "_chunk", "_x", *columns, *[e.alias(n) for n, e in looks.items()])
    chunks = points.groupBy("_entity", "_chunk").agg(
        *[f.alias(n) for c in columns for n, f in ((f"_lx_{c}", F.max(at(c))), (f"_lv_{c}", F.max_by(c, at(c))), (f"_fx_{c}", F.min(at(c))), (f"_fv_{c}", F.min_by(c, at(c))))]
    )
    order = Window.partitionBy("_entity").orderBy("_chunk")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_entity").orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(
        F.col("_entity").alias("_e"), F.col("_chunk").alias("_c"),
        *[F.last(f"_l{k}_{c}", ignorenulls=True).over(earlier).alias(f"_pb{k}_{c}") for c in columns for k in "xv"],
        *[F.last(f"_f{k}_{c}", ignorenulls=True).over(later).alias(f"_pa{k}_{c}") for c in columns for k in "xv"],
    )
    # Most entities have one chunk: nothing is carried to them.
    carried = carried.where(reduce(lambda a, b: a | b, [F.col(f"_p{s}x_{c}").isNotNull() for c in columns for s in "ba"]))
    joined = local.join(carried, (F.col("_entity") == F.col("_e")) & (F.col("_chunk") == F.col("_c")), "left")
    both = lambda s, k, c: F.when(F.col(f"_{s}x_{c}").isNotNull(), F.col(f"_{s}{k}_{c}")).otherwise(F.col(f"_p{s}{k}_{c}"))
    return joined.select("_entity", "_x", *columns, *[both(s, k, c).alias(f"_{s}{k}_{c}") for c in columns for s in "ba" for k in "xv"])


def fill_in_order(
    df: DataFrame,
    entity: Column,
    position: Column,
    numeric: dict[str, Column],
    categories: dict[str, Column],
    keep: Sequence[str | Column],
    max_gap: int = 3,
    gaps: tuple[DataFrame, dict[str, Column]] | None = None,
) -> DataFrame:
    """(*keep, field_name, value, method, distance), a row per missing value that could be filled.

    Numbers are interpolated by position between the nearest observed neighbours, or
    held from the only side that has one; categories are carried from the nearest
    earlier value at most `max_gap` positions away, else the nearest later one.
    `method` is same_place, interpolated, held_forward, held_back, carried_forward or
    carried_back; `distance` is in positions to the nearest value used. Where several
    rows share entity and position with different values the least counts. Rows
    with a NULL entity, and entities without any value, stay unfilled. A NULL position
    counts as 0. `gaps` may give more cheaply than `df` the rows to fill, with which
    fields they lack; entity, position and `keep` are read from them then.
    """
    fields = list(numeric) + list(categories)
    place = [entity.alias("_entity"), F.coalesce(position.cast("bigint"), F.lit(0)).alias("_x")]
    rows = df.select(*place, *[c.alias(f"_v_{n}") for n, c in (numeric | categories).items()]).where(F.col("_entity").isNotNull())
    points = rows.groupBy("_entity", "_x").agg(*[F.min(f"_v_{n}").alias(f"_v_{n}") for n in fields])
    near = neighbours(points, [f"_v_{n}" for n in fields])
    made = []
    for n in fields:
        bx, before, ax, after = (F.col(f"_{k}__v_{n}") for k in ("bx", "bv", "ax", "av"))
        left, right = F.col("_x") - bx, ax - F.col("_x")
        if n in numeric:
            between = before + F.round((after - before) * left / (ax - bx)).cast("bigint")
            value = F.when(left == 0, before).when(before.isNull(), after).when(after.isNull(), before).otherwise(between)
            method = F.when(left == 0, "same_place").when(before.isNull(), "held_back").when(after.isNull(), "held_forward").otherwise("interpolated")
            distance = F.least(left, right)
        else:
            ahead = left.isNull() | (left > max_gap)
            value = F.when(~ahead, before).when(right <= max_gap, after)
            method = F.when(left == 0, "same_place").when(~ahead, "carried_forward").otherwise("carried_back")
            distance = F.when(~ahead, left).otherwise(right)
        made.append(F.struct(F.lit(n).alias("field_name"), value.cast("string").alias("value"), method.alias("method"), distance.alias("distance")))
    offers = near.select(F.col("_entity").alias("_e"), F.col("_x").alias("_p"), *[m.alias(f"_o_{n}") for m, n in zip(made, fields, strict=True)])
    where, lacks = gaps if gaps else (df, {n: c.isNull() for n, c in (numeric | categories).items()})
    kept = where.select(*keep).columns
    lacking = where.select(*keep, *place, *[lacks[n].alias(f"_m_{n}") for n in fields]).where(F.col("_entity").isNotNull() & reduce(lambda a, b: a | b, [F.col(f"_m_{n}") for n in fields]))
    filled = lacking.join(offers, (F.col("_entity") == F.col("_e")) & (F.col("_x") == F.col("_p")))
    options = F.array(*[F.when(F.col(f"_m_{n}") & F.col(f"_o_{n}.value").isNotNull(), F.col(f"_o_{n}")) for n in fields])
    return filled.select(*kept, F.inline(F.filter(options, lambda o: o.isNotNull())))
