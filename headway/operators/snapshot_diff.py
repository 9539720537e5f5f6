"""What changed between consecutive full snapshots, by Merkle trees over key ranges.

Keys are hashed, and the leading bits name the nodes of a tree of hash ranges. A leaf's
digest combines the digests of its distinct (key, content) pairs, a node's digest those
of its children, always with operations that do not depend on order, so that all of it
is partial aggregation. Two consecutive snapshots are compared from the root down; rows
are compared only in leaves whose digests differ.

Rows are brought to narrow digests once, lie by leaf in the checkpoint folder, and
everything that follows stays in that partitioning. Leaf digests can be kept (`keep`)
from run to run: they tell which leaves of which snapshots have to be read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.sources.tables import checkpointed

#: Rows of a leaf that are aimed at, the most bits of a leaf, and bits from one level of the tree to the next.
LEAF_ROWS, MOST_BITS, STEP = 64, 30, 6


def tree_levels(rows: int) -> tuple[int, ...]:
    """Bits of the tree's levels, root first, for so many rows."""
    bits = min(MOST_BITS, max(2, (max(1, rows) // LEAF_ROWS).bit_length()))
    return (0, *range(bits % STEP or STEP, bits + 1, STEP)) if bits > STEP else (0, bits)


def last_delivery(df: DataFrame, snapshot: str, delivery: str) -> DataFrame:
    """Rows of the highest delivery of each snapshot. The side that is broadcast is a row per snapshot: a calendar, not data."""
    best = df.groupBy(snapshot).agg(F.max(delivery).alias("_best"))
    return (
        df.join(F.broadcast(best.withColumnRenamed(snapshot, "_snap")), (F.col(snapshot) == F.col("_snap")) & (F.col(delivery) == F.col("_best")))
        .drop("_snap", "_best")
    )


def row_digests(df: DataFrame, snapshot: str, keys: Sequence[str], content: Sequence[Column], bits: int) -> DataFrame:
    """Distinct (snapshot, key, content digest) with the key's leaf.

    Repeated rows fall together here, in the map-side part of the aggregation, so a
    key that holds a third of all rows costs one row per task. A key with several
    contents in one snapshot keeps all of them; its digest is that of the set.
    """
    digest = [F.xxhash64(F.lit(seed), *content) for seed in (17, 91)]
    rows = df.select(snapshot, *keys, digest[0].alias("_h1"), digest[1].alias("_h2")).distinct()
    return rows.withColumn("_leaf", F.shiftrightunsigned(F.xxhash64(F.lit(5), *keys), 64 - bits).cast("int"))


def node_digests(rows: DataFrame, snapshot: str, keys: Sequence[str], bits: int, level: int) -> DataFrame:
    """Digests of the nodes at `level` bits, from the rows' digests."""
    mix = [F.xxhash64(F.lit(seed), *keys, "_h1", "_h2") for seed in (29, 43)]
    return (
        rows.select(snapshot, (F.shiftright("_leaf", bits - level) if level < bits else F.col("_leaf")).alias("_node"), mix[0].alias("_m1"), mix[1].alias("_m2"))
        .groupBy(snapshot, "_node")
        .agg(F.count(F.lit(1)).alias("_n"), F.bit_xor("_m1").alias("_x1"), F.bit_xor("_m2").alias("_x2"))
    )


def parent_digests(nodes: DataFrame, snapshot: str, level: int, parent: int) -> DataFrame:
    return (
        nodes.withColumn("_node", F.shiftright("_node", level - parent))
        .groupBy(snapshot, "_node")
        .agg(F.sum("_n").alias("_n"), F.bit_xor("_x1").alias("_x1"), F.bit_xor("_x2").alias("_x2"))
    )


def consecutive(df: DataFrame, snapshot: str) -> DataFrame:
    """Pairs (prev, cur) of snapshot numbers. One row per snapshot goes through one task: a calendar, not data."""
    seen = df.select(snapshot).distinct()
    return (
        seen.select(F.lag(snapshot).over(Window.orderBy(snapshot)).alias("_prev"), F.col(snapshot).alias("_cur"))
        .where(F.col("_prev").isNotNull())
    )


def _sides(df: DataFrame, pairs: DataFrame, snapshot: str) -> DataFrame:
    """Each row once as the newer and once as the older side of the pairs that its snapshot is in."""
    sides = pairs.select("_prev", "_cur", F.explode(F.array(F.struct(F.col("_cur").alias("snap"), F.lit(1).alias("new")), F.struct(F.col("_prev").alias("snap"), F.lit(0).alias("new")))).alias("_s"))
    sides = sides.select("_prev", "_cur", F.col("_s.snap").alias("_snap"), F.col("_s.new").alias("_new"))
    return df.join(sides, F.col(snapshot) == F.col("_snap")).drop("_snap", snapshot)


def differing(nodes: DataFrame, pairs: DataFrame, snapshot: str) -> DataFrame:
    """(prev, cur, node) of the nodes whose digests differ between the two snapshots."""
    new = F.col("_new") == 1
    side = lambda c, which: F.max(F.when(which, F.col(c)))
    same = F.lit(True)
    for c in ("_n", "_x1", "_x2"):
        same = same & side(c, new).eqNullSafe(side(c, ~new))
    return _sides(nodes, pairs, snapshot).groupBy("_prev", "_cur", "_node").agg(same.alias("_same")).where(~F.col("_same")).drop("_same")


def differing_leaves(leaves: DataFrame, pairs: DataFrame, snapshot: str, levels: Sequence[int]) -> DataFrame:
    """(_p, _c, _l) of the leaves that differ between the snapshots of each pair, found from the root down."""
    bits = levels[-1]
    nodes = {bits: leaves}
    for level, parent in zip(reversed(levels), reversed(levels[:-1]), strict=False):
        nodes[parent] = parent_digests(nodes[level], snapshot, level, parent)
    open_nodes = differing(nodes[levels[0]], pairs, snapshot)
    for upper, level in zip(levels, levels[1:], strict=False):
        up = open_nodes.select(F.col("_prev").alias("_p"), F.col("_cur").alias("_c"), F.col("_node").alias("_up"))
        below = differing(nodes[level], pairs, snapshot)
        open_nodes = below.join(
            up,
            (F.col("_prev") == F.col("_p")) & (F.col("_cur") == F.col("_c")) & (F.shiftright("_node", level - upper) == F.col("_up")),
            "left_semi",
        )
    return open_nodes.select(F.col("_prev").alias("_p"), F.col("_cur").alias("_c"), F.col("_node").alias("_l"))


def diff_snapshots(
    df: DataFrame,
    snapshot: str,
    keys: Sequence[str],
    content: Sequence[Column],
    levels: Sequence[int] | None = None,
    keep: str | None = None,
) -> DataFrame:
    """(prev_snapshot, snapshot, *keys, change_type) for each key that differs.

    `content` are columns already brought to their meaning. `levels` are the bits of
    the tree's levels, root first; unless given they follow from the number of rows. An
    empty table and a single snapshot give no rows; NULL keys are keys like others; rows
    with a NULL snapshot belong to none. With `keep` the leaves' digests are written to
    that path, a folder per snapshot and number of bits.
    """
    df = df.where(F.col(snapshot).isNotNull())
    levels = levels or tree_levels(df.count())
    bits = levels[-1]
    # Distinct first, where copies fall together before they are moved; then once by leaf.
    rows = checkpointed(row_digests(df, snapshot, keys, content, bits).repartition("_leaf"))
    pairs = consecutive(rows, snapshot)
    leaves = node_digests(rows, snapshot, keys, bits, bits)
    if keep:
        leaves.withColumn("bits", F.lit(bits)).write.mode("append").partitionBy(snapshot, "bits").parquet(keep)
    leaves = checkpointed(leaves)
    wanted = differing_leaves(leaves, pairs, snapshot, levels)
    suspects = _sides(rows, pairs, snapshot).join(wanted, (F.col("_prev") == F.col("_p")) & (F.col("_cur") == F.col("_c")) & (F.col("_leaf") == F.col("_l")), "left_semi")
    new = F.col("_new") == 1
    sums = [F.bit_xor(F.when(new, F.col(h))).alias(f"_new{h}") for h in ("_h1", "_h2")] + [F.bit_xor(F.when(~new, F.col(h))).alias(f"_old{h}") for h in ("_h1", "_h2")]
    keyed = suspects.groupBy("_leaf", "_prev", "_cur", *keys).agg(F.max("_new").alias("_in_new"), F.min("_new").alias("_in_both"), *sums)
    change = (
        F.when(F.col("_in_both") == 1, "added")
        .when(F.col("_in_new") == 0, "removed")
        .when(~(F.col("_new_h1").eqNullSafe(F.col("_old_h1")) & F.col("_new_h2").eqNullSafe(F.col("_old_h2"))), "changed")
    )
    return keyed.select(F.col("_prev").alias("prev_snapshot"), F.col("_cur").alias("snapshot"), *keys, change.alias("change_type")).where(
        F.col("change_type").isNotNull()
    )
