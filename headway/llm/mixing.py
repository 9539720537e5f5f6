"""Mixing sources to target shares of the tokens by systematic sampling."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern by which that vocabulary splits text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts of a copy, as which expected copies are summed up.
UNIT = 1_000_000_000
#: Buckets of the running sum: size classes, so many to a doubling of the tokens and none the last, each in so many parts by hash.
CLASSES, PARTS = 4, 256


def source_name(c: Column) -> Column:
    """Spellings of a source made one: lower case, separators as one underscore, outer blanks removed."""
    return F.regexp_replace(F.trim(F.lower(c), F.lit(" \t")), r"[\s_-]+", "_")


def count_tokens(documents: DataFrame, text: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """(*keep, n_tokens). NULL texts have none."""
    types = {f.name: f.dataType.simpleString() for f in documents.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(tokenizer).read_bytes().splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if isinstance(t, str) else 0 for t in batch[text]]
            yield batch[keep].assign(n_tokens=counts)

    return documents.select(*keep, text).mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keep) + ", n_tokens bigint")


def plan_mix(sizes: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, source_tokens, copies): expected copies of each document of a source.

    Without a budget the mix is the largest that reaches the shares, in proportion, of
    all sources that have tokens without repeating any more often than allowed; with
    one, sources that can't fill their share are repeated as often as allowed. Sources
    without documents, or that may not be used at all (`max_repeats` 0), get 0 copies and
    don't bound the mix. One row per source: bounded by the targets.
    """
    wanted = targets.where(F.col("source").isNotNull()).groupBy(source_name(F.col("source")).alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    joined = wanted.join(sizes, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    usable = (F.col("source_tokens") > 0) & (F.col("target_share") > 0) & F.coalesce(F.col("max_repeats") > 0, F.lit(True))
    reach = F.when(usable, F.col("max_repeats") * F.col("source_tokens") / F.col("target_share"))
    total = F.lit(float(budget)) if budget is not None else F.min(reach).over(Window.partitionBy())
    copies = F.when(usable, F.least(F.col("max_repeats").cast("double"), F.col("target_share") * total / F.col("source_tokens"))).otherwise(0.0)
    return joined.withColumn("copies", copies)


def systematic_copies(documents: DataFrame, plan: DataFrame, key: str, offset: float | None = None, seed: int = 0) -> DataFrame:
    """(key, source, n_tokens, copy_no), a row per emitted copy.

    Documents of a source stand in order of their size class and then of a hash, so that
    each size gets its part of the copies; their expected copies are summed up and one
    copy is emitted for each whole number crossed, after one offset in [0, 1), drawn for
    each source from `seed` unless given. Whole copies cross as many whole numbers
    wherever they stand, so only the rest is summed, and carried from bucket to bucket
    without its whole part: sums stay below `UNIT` times the documents of one bucket.
    The running sum has two levels: within buckets, and over the buckets' totals, so a
    source of any size is spread over at least `PARTS` groups. No document is emitted
    more often than the next whole number of its source's expected copies. Documents
    with NULL source are in no mix; a document without tokens counts like others.
    """
    copies = F.col("copies")
    part = plan.where(copies > 0).select(F.col("source").alias("_s"), F.floor(copies).cast("int").alias("_whole"), F.round((copies - F.floor(copies)) * UNIT).cast("bigint").alias("_w"))
    size = F.floor(F.log2(F.col("n_tokens") + F.lit(1)) * CLASSES).cast("bigint")
    rows = documents.join(part, F.col("source") == F.col("_s")).withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_b", size * PARTS + F.pmod("_h", F.lit(PARTS)))
    totals = rows.groupBy("source", "_b").agg(F.pmod(F.sum("_w"), F.lit(UNIT)).alias("_t"))
    earlier = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("source").alias("_s2"), F.col("_b").alias("_b2"), F.pmod(F.coalesce(F.sum("_t").over(earlier), F.lit(0)), F.lit(UNIT)).alias("_start"))
    inside = Window.partitionBy("source", "_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_sum", F.sum("_w").over(inside)).join(starts, (F.col("source") == F.col("_s2")) & (F.col("_b") == F.col("_b2")))
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "source"), F.lit(UNIT)) if offset is None else F.lit(int(offset * UNIT))
    upto = F.col("_start") + F.col("_sum") + drawn
    n = F.col("_whole") + (F.floor(upto / UNIT) - F.floor((upto - F.col("_w")) / UNIT)).cast("int")
    return summed.withColumn("_n", n).where(F.col("_n") > 0).select(key, "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy_no"))


def report(copies: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, source_tokens, mixed_tokens, documents, most_repeats) per target."""
    got = copies.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.sum((F.col("copy_no") == 1).cast("bigint")).alias("documents"), F.max("copy_no").cast("bigint").alias("most_repeats"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = plan.join(got, "source", "left").select("source", "target_share", "max_repeats", "source_tokens", zero("mixed_tokens"), zero("documents"), zero("most_repeats"))
    share = F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(Window.partitionBy()), F.lit(0))
    return joined.withColumn("actual_share", F.coalesce(share, F.lit(0.0)))
