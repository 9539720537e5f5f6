"""Queries p6 to p8 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import leak, mixing, residue
from headway.sources.tables import checkpointed, table


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(table(spark, d, "documents", "doc_id", "text", "lines"), table(spark, d, "eval_items", "item_id", "passage"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Per test item, in how many pages it leaked."""
    return p6_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """The pages without any test passage."""
    return table(spark, d, "documents", "doc_id", "source", "text").join(p6_found(spark, d).select("doc_id").distinct(), "doc_id", "left_anti")


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """All pages, with the lines of test passages removed."""
    return leak.remove_spans(table(spark, d, "documents", "doc_id", "text", "lines"), checkpointed(p6_leaks(spark, d)))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source", "text").withColumn("source", mixing.source_name(F.col("source")))
    return mixing.count_tokens(docs, "text", ["doc_id", "source"])


def _mix(spark: SparkSession, d: str, seed: int) -> tuple[DataFrame, DataFrame]:
    sized = checkpointed(_sized(spark, d))  # tokens are counted once; what is kept are ids, sources and numbers
    sizes = sized.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    plan = mixing.plan_mix(sizes, table(spark, d, "mix_targets"))
    return mixing.systematic_copies(sized, plan, "doc_id", seed=seed), plan


def p7_mix_report(spark: SparkSession, d: str, seed: int = 0) -> DataFrame:
    return mixing.report(*_mix(spark, d, seed))


def p7_mix(spark: SparkSession, d: str, seed: int = 0) -> DataFrame:
    return _mix(spark, d, seed)[0]


def p8_reasons(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source", "text", "lines")
    slots = residue.residue_pages(docs).select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("placeholder"), "placeholder"), F.when(F.col("filler"), "filler")))).alias("reason"))
    return slots.unionByName(residue.error_pages(docs).select("doc_id", F.lit("message").alias("reason")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_reasons(spark, d).select("doc_id").distinct()


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """The pages without residue."""
    return table(spark, d, "documents", "doc_id", "source", "text").join(p8_found(spark, d), "doc_id", "left_anti")


QUERIES = {f.__name__: f for f in (p6_found, p6_leaks, p6_items, p6_kept, p6_cleaned, p7_mix_report, p7_mix, p8_found, p8_reasons, p8_kept)}
SQL: dict[str, str] = {}
