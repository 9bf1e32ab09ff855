"""Packet- and signal-shaped views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.scan import numbered
from framelake.sources.shared import written

FRAME = 960  # samples of 20 ms at 48 kHz

#: The same view in DuckDB's SQL.
PACKETS_SQL = f"""SELECT event_id, user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_type, value,
    event_id % 256 AS toc, event_id * 7 % 64 AS second_byte, 1 + event_id * 37 % 120 AS len, event_id % 13 = 0 AS lost,
    (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * {FRAME} AS ts48 FROM events"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet for each event, in streams by user: event_id, stream_id, seq, event_type, value, toc, second_byte, len, lost, ts48. The events with their
    numbers are written, as what follows reads them several times."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
    e = F.col("event_id")
    placed = written(numbered(events, "user_id", ["_at", "event_id"], F.col("_at")).drop("_at"), "packets")
    return placed.select(
        e, F.col("user_id").alias("stream_id"), "seq", "event_type", "value", (e % 256).alias("toc"), (e * 7 % 64).alias("second_byte"),
        (1 + e * 37 % 120).alias("len"), (e % 13 == 0).alias("lost"),
    ).withColumn("ts48", F.col("seq") * FRAME)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packets() without the order in streams, which needs no shuffle."""
    e = F.col("event_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(e, F.col("user_id").alias("stream_id"), (e % 256).alias("toc"), (e * 7 % 64).alias("second_byte"), (1 + e * 37 % 120).alias("len"), (e % 13 == 0).alias("lost"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block of samples for each embedding: block_id, pcm, channels."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("block_id"), F.col("embedding").alias("pcm"), (F.col("label") % 8 + 1).alias("channels"))
