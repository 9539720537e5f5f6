"""References to records that do not exist, through a broadcast Bloom filter.

The filter is a split-block Bloom filter held as a table of blocks: a key names one
block and one bit in each of its eight words. Blocks are sized by the number of keys,
`KEYS_PER_BLOCK` each, and are 72 bytes; up to `MOST_BLOCKS` of them are broadcast, 75
MB. More keys than those hold make a filter that is joined by block, both sides
partitioned. A reference that the filter rejects is a definite orphan; the rest is
verified by an exact join with the parents' validity in time. References of several
fields go through one filter and one join, and a child table is read once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.text import strip_to_null

KEYS_PER_BLOCK = 40
MOST_BLOCKS = 1 << 20
_WORDS = 8


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    """The key's bit in a word: six bits each out of two hashes."""
    h = F.xxhash64(F.lit(2 + word // 4), key)
    place = F.shiftrightunsigned(h, 6 * (word % 4)).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def blocks_for(keys: int) -> int:
    """Blocks of a filter for so many keys."""
    return max(1, -(-keys // KEYS_PER_BLOCK))


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(_block, _w0 … _w7), at most `blocks` rows. NULL keys are not entered."""
    k = F.col(key)
    return (
        keys.where(k.isNotNull())
        .groupBy(_block(k, blocks).alias("_block"))
        .agg(*[F.bit_or(_bit(k, i)).alias(f"_w{i}") for i in range(_WORDS)])
    )


def probe(df: DataFrame, key: Column, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """`df` with the boolean `_maybe`: false where no entered key equals `key`. The filter is broadcast if it is small enough."""
    side = F.broadcast(filter_blocks) if blocks <= MOST_BLOCKS else filter_blocks
    joined = df.withColumn("_probe", _block(key, blocks)).join(side, F.col("_probe") == F.col("_block"), "left")
    hit = F.col("_block").isNotNull()
    for i in range(_WORDS):
        bit = _bit(key, i)
        hit = hit & (F.col(f"_w{i}").bitwiseAND(bit) == bit)
    return joined.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_probe", "_block", *[f"_w{i}" for i in range(_WORDS)])


def timeline(parents: DataFrame, key: str, loaded: str, deleted: str) -> DataFrame:
    """(key, since, until, state) covering all time for each key that ever occurs.

    States are `late` (before its first row), `holds` and `deleted`. Repeated rows
    fall together first; the running maximum then merges overlapping validities, so a
    key gives at most two rows per gap. Rows with a NULL key or loaded_at are no
    parents; a row deleted before it was loaded holds never.
    """
    end = F.coalesce(F.col(deleted), F.lit("9999-01-01 00:00:00").cast("timestamp_ntz"))
    spans = parents.where(F.col(key).isNotNull() & F.col(loaded).isNotNull()).groupBy(key, loaded).agg(F.max(end).alias("_end"))
    before = Window.partitionBy(key).orderBy(loaded).rowsBetween(Window.unboundedPreceding, -1)
    by_key = Window.partitionBy(key).orderBy(loaded)
    marked = (
        spans.withColumn("_reach", F.max(F.greatest("_end", loaded)).over(before))
        .withColumn("_first", F.row_number().over(by_key) == 1)
        .withColumn("_next", F.lead(loaded).over(by_key))
        .withColumn("_upto", F.greatest("_end", loaded, F.coalesce("_reach", F.col(loaded))))
    )
    low, high = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"), F.lit("9999-01-01 00:00:00").cast("timestamp_ntz")
    holds_until = F.least(F.col("_upto"), F.coalesce("_next", high))
    part = lambda since, until, state: F.struct(since.alias("since"), until.alias("until"), F.lit(state).alias("state"))
    parts = F.array(
        F.when(F.col("_first"), part(low, F.col(loaded), "late")),
        F.when(holds_until > F.col(loaded), part(F.col(loaded), holds_until, "holds")),
        F.when(holds_until < F.coalesce("_next", high), part(holds_until, F.coalesce("_next", high), "deleted")),
    )
    return marked.select(key, F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("_p")).select(
        F.col(key).alias("_parent"), F.col("_p.since").alias("since"), F.col("_p.until").alias("until"), F.col("_p.state").alias("state")
    )


def orphan_references(
    children: DataFrame,
    references: Sequence[str],
    at: str,
    keep: list[str],
    parents: dict[str, tuple[DataFrame, str]],
    loaded: str = "loaded_at",
    deleted: str = "deleted_at",
    blocks: int | None = None,
) -> DataFrame:
    """(*keep, field_name, reason) for each child and field whose non-blank reference has no parent holding at `at`.

    `parents` has, for each field of `references`, its table and key column. Blank
    references are no cases; outer blanks of both keys don't matter, letter case does.
    `reason` is missing, late or deleted. A child with a NULL `at` can't be dated: it is a
    case only where the key never occurs (missing). Without parents every reference is
    missing. A hot key is hot only on the child side of an outer join whose other side
    has a few rows a key, which adaptive execution splits. The distinct parent keys are
    counted once here, to size the filter.
    """
    tagged = lambda field, key: F.concat(F.lit(f"{field}\u0000"), key)
    named = [parents[r][0].select(tagged(r, strip_to_null(parents[r][1])).alias("_key"), F.col(loaded).alias("_loaded"), F.col(deleted).alias("_deleted")) for r in references]
    known = reduce(DataFrame.unionByName, named).where(F.col("_key").isNotNull())
    spans = timeline(known, "_key", "_loaded", "_deleted").toDF("_parent", "_since", "_until", "_state")
    if blocks is None:
        blocks = blocks_for(known.agg(F.approx_count_distinct("_key")).first()[0])
    fields = F.array(*[F.struct(F.lit(r).alias("field_name"), tagged(r, strip_to_null(r)).alias("_ref")) for r in references])
    refs = children.select(*keep, F.coalesce(at, F.lit("9998-12-31 00:00:00").cast("timestamp_ntz")).alias("_at"), F.col(at).isNotNull().alias("_dated"), F.inline(fields)).where(F.col("_ref").isNotNull())
    probed = probe(refs, F.col("_ref"), bloom_blocks(known, "_key", blocks), blocks)
    # Proven orphans have no parent to meet; a sign that no key has keeps them apart and spread out.
    meets = F.when(F.col("_maybe"), F.col("_ref")).otherwise(F.concat(F.lit("\u0000"), F.col("_ref")))
    verified = probed.withColumn("_meets", meets).join(spans, (F.col("_meets") == F.col("_parent")) & (F.col("_at") >= F.col("_since")) & (F.col("_at") < F.col("_until")), "left")
    orphan = F.col("_state").isNull() | ((F.col("_state") != "holds") & F.col("_dated"))
    return verified.where(orphan).select(*keep, "field_name", F.coalesce("_state", F.lit("missing")).alias("reason"))
