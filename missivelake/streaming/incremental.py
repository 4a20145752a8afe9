"""Incremental import and live sessions with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from missivelake.config import DEFAULT, Config
from missivelake.operators.messages import ME


def deduplicated(messages: DataFrame, delay: str) -> DataFrame:
    """The first message of each key of a stream; keys are forgotten once the watermark has passed them by the delay, so that
    the state is bounded. What must be new against all that ever came is merged into an archive (see merge.Archive)."""
    return messages.withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"])


def live_sessions(messages: DataFrame, delay: str = "1 hour", cfg: Config = DEFAULT) -> DataFrame:
    """Conversations of a stream of contact messages: one row once the watermark has passed a conversation's end.

    Windows that touch are merged, so a gap of exactly the timeout stays in the conversation as in the batch job. See
    sessions.live_conversations for who started and ended one.
    Messages later than the delay are dropped here and repaired by the batch job over stale contacts.
    """
    gap = f"{cfg.conversation_timeout_ms} milliseconds"
    rows = messages.withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", delay)
    counts = rows.groupBy("contact_id", F.session_window("ts", gap).alias("w")).agg(
        F.min("timestamp_ms").alias("start_ms"),
        F.max("timestamp_ms").alias("end_ms"),
        F.sum((F.col("sender") == ME).cast("long")).alias("my_count"),
        F.count("*").alias("total_count"),
    )
    return counts.select("contact_id", "start_ms", "end_ms", "my_count", (F.col("total_count") - F.col("my_count")).alias("their_count"), "total_count")


def import_stream(stream: DataFrame, target: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append a stream to a table folder, resuming where the last run stopped; after(batch, id) runs on every batch."""

    def batch(df: DataFrame, batch_id: int) -> None:
        # A batch is written to its own folder, so a batch that is run again replaces itself.
        df.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        if after:
            after(df, batch_id)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def read_folder_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
