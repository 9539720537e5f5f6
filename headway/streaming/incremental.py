"""New rules from arriving feed versions, as a stream of micro-batches with a persisted history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from headway.operators import rules


def stream_new_rules(rule_stream: DataFrame, history_path: str, checkpoint: str, emit: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls `emit` with the new rules of each micro-batch, then adds them to the history.

    The history is partitioned by batch and a batch's part is overwritten, so a batch
    repeated after a failure gives the same rules again and is counted once.
    """

    def process(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(history_path).where(F.col("batch") < number)
        except AnalysisException:
            known = None
        new = rules.new_rules(batch, known, keep_dateless=False).persist()
        emit(new, number)
        rules.history_of(new).write.mode("overwrite").parquet(f"{history_path}/batch={number}")
        new.unpersist()

    return rule_stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_fresh_pairs(pairs: DataFrame, arrived: str | None = None, within: str | None = None) -> DataFrame:
    """(rule_key, service_date) pairs of a stream, each once, by Spark's own state store.

    The state holds every pair ever seen. With a timestamp column `arrived` and a
    duration `within`, it forgets pairs that long after their arrival: a pair repeated
    later than that is given again, and the history has to leave it out.
    """
    if arrived is None:
        return pairs.dropDuplicates(["rule_key", "service_date"])
    return pairs.withWatermark(arrived, within or "31 days").dropDuplicatesWithinWatermark(["rule_key", "service_date"])
