"""Checks of what a stage returns, by track or batch, and which rows or batches to take again."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cueframe.functions import text as T


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching ratio of two texts in this order (it isn't symmetric)."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def key_check(sent: DataFrame, got: DataFrame, keys: tuple[str, ...] = ("track_id", "batch")) -> DataFrame:
    """missing and extra seg_idx by batch."""
    a = sent.groupBy(*keys).agg(F.collect_set("seg_idx").alias("a"))
    b = got.groupBy(*keys).agg(F.collect_set("seg_idx").alias("b"))
    empty = F.array().cast("array<bigint>")
    both = a.join(b, list(keys), "full").withColumns({"a": F.coalesce(F.col("a").cast("array<bigint>"), empty), "b": F.coalesce(F.col("b").cast("array<bigint>"), empty)})
    return both.select(*keys, F.array_sort(F.array_except("a", "b")).alias("missing"), F.array_sort(F.array_except("b", "a")).alias("extra"))


def split_ok(parts: DataFrame, limit: int, least: float = 0.96) -> DataFrame:
    """ok by group of parts (track_id, seg_idx, part, text, original): the parts add up to the original and none is too long."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    rows = parts.groupBy("track_id", "seg_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("joined"), F.first("original").alias("original"), F.max(T.count_words(F.col("text"))).alias("longest"))
    same = F.when(bare(F.col("joined")) == bare(F.col("original")), 1.0).otherwise(similarity(bare(F.col("original")), bare(F.col("joined"))))
    return rows.select("track_id", "seg_idx", ((same >= least) & (F.col("longest") <= limit)).alias("ok"))


def needs_retranslation(source: Column, translated: Column, target_is_english: bool = False, rewrite: bool = False) -> Column:
    bare = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    t = T.strip(F.coalesce(translated, F.lit("")))
    bad = (t == "") | t.startswith("[ERROR") | F.contains(t, F.lit("||ERROR"))
    if target_is_english or rewrite:
        return bad
    return bad | ((bare(t) == bare(source)) & source.rlike(r"(?U)\p{L}"))


def cacheable(rows: DataFrame, keys: tuple[str, ...] = ("track_id", "batch"), rewrite: bool = False) -> DataFrame:
    """ok by batch of rows (text, translated): no bad row; a rewrite must change half of the longer rows."""
    bad = needs_retranslation(F.col("text"), F.col("translated"), True)
    long = F.length("text") >= 8
    same = F.count_if(long & (F.col("text") == F.col("translated")))
    still = (F.count_if(long) >= 2) & (same * 2 > F.count_if(long)) if rewrite else F.lit(False)
    return rows.groupBy(*keys).agg((~F.bool_or(bad) & ~still).alias("ok"))


def overflow(placed: DataFrame, slack_ms: int = 80) -> DataFrame:
    """warning where a dub runs over its slot by more than slack_ms."""
    over = F.col("place_end") - F.col("end_ms")
    return placed.withColumn("warning", F.when(over > slack_ms, F.format_string("overflow %d ms", over)))


def fit_speed(rows: DataFrame, max_speed: float = 1.5, padding_ms: int = 0) -> DataFrame:
    """speed and fitted_ms of dubs (start_ms, end_ms, audio_ms): faster up to max_speed where they don't fit their slot."""
    target = F.greatest(F.lit(100), F.col("end_ms") - F.col("start_ms") - padding_ms)
    speed = F.when(F.col("audio_ms") > target, F.least(F.col("audio_ms") / target, F.lit(max_speed))).otherwise(1.0)
    return rows.withColumn("speed", speed).withColumn("fitted_ms", F.bround(F.col("audio_ms") / F.col("speed"), 0).cast("long"))
