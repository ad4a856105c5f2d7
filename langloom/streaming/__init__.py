"""Structured Streaming over the same operators: classification and incremental counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from langloom.operators.counts import Counts, train_counts
from langloom.operators.model import Model
from langloom.operators.scoring import classify_top


def classify_stream(stream: DataFrame, model: Model, sink_path: str, checkpoint: str) -> StreamingQuery:
    """Writes the best language of each text (doc_id, text) to a folder of the micro-batch; a replayed one overwrites its own."""

    def batch(df: DataFrame, number: int) -> None:
        classify_top(df, model).write.mode("overwrite").parquet(f"{sink_path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def count_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's counts to a folder of its own; a replayed batch overwrites its own. Counts merge by sums."""

    def batch(df: DataFrame, number: int) -> None:
        made = train_counts(df)
        made.counts.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        made.stats.write.mode("overwrite").parquet(f"{path}/stats/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def streamed_counts(spark, path: str) -> Counts:
    """What count_stream() has counted so far."""
    counts = spark.read.parquet(f"{path}/counts").groupBy("lang", "section", "key", "sub").sum("cnt").withColumnRenamed("sum(cnt)", "cnt")
    stats = spark.read.parquet(f"{path}/stats").groupBy("lang").sum("docs", "chars_total", "tokens_total")
    return Counts(counts, stats.toDF("lang", "docs", "chars_total", "tokens_total"))
