"""Outside work as stages: a function over batches of rows, with a cache of earlier results and isolated failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueframe.operators import timeline

#: What recognition, translation, speech and the like plug in: the batch's rows in, one reply for each row out.
Stage = Callable[[pd.DataFrame], "pd.Series"]


def batch_keys(rows: DataFrame, salt: str = "", by: tuple[str, ...] = ()) -> DataFrame:
    """key: hash of the texts of the batch in order, of the stage's settings, and of the other columns that a reply depends on."""
    lines = F.array_sort(F.collect_list(F.struct("seg_idx", "text", *(F.col(c).alias(f"by_{i}") for i, c in enumerate(by)))))
    others = [lines.getField(f"by_{i}").alias(f"by_{i}") for i in range(len(by))]
    keys = rows.groupBy("track_id", "batch").agg(F.sha2(F.to_json(F.struct(F.lit(salt).alias("salt"), F.transform(lines, lambda x: x["text"]).alias("texts"), *others)), 256).alias("key"))
    return rows.join(keys, ["track_id", "batch"])


def run_stage(segments: DataFrame, stage: Stage, size: int = 20, cache: DataFrame | None = None, salt: str = "", by: tuple[str, ...] = ()) -> DataFrame:
    """segments with key, reply and error; batches whose key is in cache (key, seg_idx in batch as place, reply) are not run.

    A batch that fails, or returns another number of replies, has its error in each row and no replies; others go on.
    by: what the stage reads besides texts, such as the track; batches of equal texts share a reply only where it is equal, too.
    """
    rows = batch_keys(timeline.batches(segments, size), salt, by).withColumn("place", ((F.col("seg_idx") - 1) % size).cast("long"))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("seg_idx")
        try:
            reply, error = list(stage(batch)), None
            if len(reply) != len(batch):
                raise ValueError(f"{len(reply)} replies for {len(batch)} rows")
        except Exception as e:  # the stage's own failure, kept with its rows
            reply, error = [None] * len(batch), f"{type(e).__name__}: {e}"
        return batch.assign(reply=reply, error=error)

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", reply string, error string"
    if cache is None:
        return rows.groupBy("track_id", "batch").applyInPandas(run, schema)
    known = cache.select("key", "place", "reply").dropDuplicates(["key", "place"])
    whole = rows.groupBy("key").agg(F.count_distinct("place").alias("_n")).join(known.groupBy("key").agg(F.count("*").alias("_m")), "key").where("_n <= _m").select("key")
    known = known.join(whole, "key", "left_semi")  # a batch that the cache has in part is run
    misses = rows.join(whole, "key", "left_anti").select(*rows.columns)
    hits = rows.join(known, ["key", "place"]).select(*rows.columns, "reply", F.lit(None).cast("string").alias("error"))
    return misses.groupBy("track_id", "batch").applyInPandas(run, schema).unionByName(hits)


def cache_rows(done: DataFrame) -> DataFrame:
    """What of a stage's result belongs into its cache: batches without an error or an empty reply."""
    good = done.groupBy("track_id", "batch").agg(F.bool_and(F.col("error").isNull() & (F.coalesce("reply", F.lit("")) != "")).alias("_ok")).where("_ok")
    return done.join(good, ["track_id", "batch"], "left_semi").select("key", "place", "reply").dropDuplicates(["key", "place"])


def mapped(segments: DataFrame, stage: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A stage that turns a row into any number of rows, such as recognition of audio chunks."""
    return segments.mapInPandas(stage, schema)


def fresh(cache: DataFrame, now, days: float = 7.0, made: str = "made_at") -> DataFrame:
    """The rows of a cache that are at most so many days old at the time now: 7 for translations, 2 for recognition."""
    return cache.where(F.timestamp_seconds(F.unix_timestamp(made) + int(days * 86_400)) >= F.lit(now))


def checked(ask: Callable[[pd.DataFrame, list[str]], pd.Series], check: Callable[[pd.DataFrame, pd.Series], str | None], steps: int = 3) -> Stage:
    """A stage that asks again, with all complaints so far, until check has none; after `steps` the last reply stands.

    ask: from a batch and the complaints to its replies; check: a complaint, or None.
    """

    def run(batch: pd.DataFrame) -> pd.Series:
        complaints: list[str] = []
        for _ in range(steps):
            reply = ask(batch, complaints)
            complaint = check(batch, reply)
            if complaint is None:
                break
            complaints.append(complaint)
        return reply

    return run


def whole_or_batches(segments: DataFrame, size: int = 20, whole: int = 100) -> DataFrame:
    """batch of each row: short tracks are one batch, so that a stage sees all of their context, longer ones are cut."""
    from pyspark.sql import Window

    rows = timeline.batches(segments, size).withColumn("_n", F.count("*").over(Window.partitionBy("track_id")))
    return rows.withColumn("batch", F.when(F.col("_n") <= whole, 0).otherwise(F.col("batch")).cast("long")).drop("_n")


def repair(done: DataFrame, suspicious, stage: Stage) -> DataFrame:
    """done (with reply) after one more run of stage over each suspicious row by itself; a failed or empty one changes nothing."""
    rows = done.where(suspicious)
    again = run_stage(rows.select("track_id", "seg_idx", "text", "start_ms", "end_ms"), stage, 1).where("error is null and coalesce(reply, '') <> ''")
    out = done.join(again.select("track_id", "seg_idx", F.col("reply").alias("_again")), ["track_id", "seg_idx"], "left")
    return out.withColumn("reply", F.coalesce("_again", "reply")).drop("_again")
