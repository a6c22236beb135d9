"""Segment tables over the driver's tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def wall_ms(ts: Column) -> Column:
    """Milliseconds of a time without zone since 1970, whatever the session's zone."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return F.unix_date(ts.cast("date")).cast("long") * 86_400_000 + seconds * 1000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as segments: a track per user, the event type as speaker, value as minutes."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    start = wall_ms(F.col("ts"))
    e = e.select(F.col("user_id").alias("track_id"), start.alias("start_ms"), (start + F.floor(F.col("value") * 60000).cast("long")).alias("end_ms"), F.col("event_type").alias("speaker"), "event_id")
    return e.withColumn("seg_idx", F.row_number().over(Window.partitionBy("track_id").orderBy("start_ms", "event_id")))


TIMELINE = """tl AS (SELECT user_id AS track_id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(floor(value * 60000) AS BIGINT) AS end_ms, event_type AS speaker, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS seg_idx FROM events)"""


def dub_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as rows to dub: a track per conversation, 60 ms a character, from 700 ms a turn on."""
    c = load(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    length = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return c.select(F.col("conv_id").alias("track_id"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") * 700).alias("start_ms"), (F.col("turn") * 700 + length * 60).alias("end_ms"), (length * 60).alias("audio_ms"))


DUB = """dub AS (SELECT conv_id AS track_id, turn AS seg_idx, role AS speaker, coalesce(text, '') AS text, turn * 700 AS start_ms, turn * 700 + length(coalesce(text, '')) * 60 AS end_ms,
  CAST(length(coalesce(text, '')) * 60 AS BIGINT) AS audio_ms FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"""


def checkpointed(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: the cluster's own, or a temporary one in a local session."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="cueframe-"))


def cut(df: DataFrame) -> DataFrame:
    """df written once to the checkpoint folder: what is used several times isn't computed again, and plans stay short."""
    checkpointed(df.sparkSession)
    return df.checkpoint()


def small(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, so that what a task holds follows from the length of a row and not from Spark's batches."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def tasks(spark: SparkSession) -> int:
    """Into how many partitions much work on few bytes is dealt: enough for all cores, and as many as a shuffle has."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
