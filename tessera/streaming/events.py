"""Event feeds as Structured Streaming queries.

The wire carries no time, so the reader adds ``ingest_ts``.  Operators with state of their own
are those of ``stateful``, named here as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stateful import changes, first_seen, frame_stream, presence, settled, transactions  # noqa: F401

EVENTS = "stream_id string, seq long, code int, tx_id long, params array<bigint>, ingest_ts timestamp"


def event_drop(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    """Events that a collector drops as files; an empty poll is no error, the stream ends when it is stopped."""
    return spark.readStream.schema(schema).parquet(folder)


def matching(events: DataFrame, codes: list[int]) -> DataFrame:
    return events.where(F.col("code").isin(*codes))


def counts(events: DataFrame) -> DataFrame:
    """Events of each stream and code so far (update mode)."""
    return events.groupBy("stream_id", "code").agg(F.count("*").alias("n"))


def latest(frames: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The newest row of each key so far (update mode)."""
    row = F.max_by(F.struct(*values), F.col(order)).alias("__row")
    return frames.groupBy(*keys).agg(row, F.max(order).alias(order)).select(*keys, order, *(F.col(f"__row.{v}").alias(v) for v in values))


def for_each_batch(df: DataFrame, handle, checkpoint: str):
    """Per-batch callback sink; ``handle(batch, batch_id)`` must be idempotent by batch id."""
    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def upserts(stream, path: str):
    """Sink of a stream in update mode that a replayed batch does not change.

    Each batch is a folder of its own, named by its id and overwritten when the batch is
    replayed after a failure; the newest row of a key is found on reading.
    """
    return stream.foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}"))


def read_upserts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key that an :func:`upserts` sink has got (a batch holds a key once)."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("last_row"))
    return last.select(*keys, *(F.col(f"last_row.{v}").alias(v) for v in values))


def compact_upserts(spark: SparkSession, path: str, target: str, keys: list[str]) -> None:
    """The table of an ended sink as one folder; a sink at ``target`` goes on behind it."""
    last = spark.read.parquet(path).agg(F.max("batch_id")).first()[0]
    read_upserts(spark, path, keys).write.mode("overwrite").parquet(f"{target}/batch_id={last}")
