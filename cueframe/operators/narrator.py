"""Who narrates a track, and which rows to keep for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueframe.functions import text as T

MIN_SHARE, CLOSE = 0.45, 0.05


def durations(segments: DataFrame) -> DataFrame:
    """duration_ms by (track_id, speaker), over rows with a speaker and a positive length."""
    rows = segments.select("track_id", T.normalize_speaker(F.col("speaker")).alias("speaker"), (F.col("end_ms") - F.col("start_ms")).alias("ms"))
    return rows.where("speaker is not null and ms > 0").groupBy("track_id", "speaker").agg(F.sum("ms").alias("duration_ms"))


def pick(sums: DataFrame, min_share: float = MIN_SHARE, preferred: str | None = None) -> DataFrame:
    """narrator, its duration and share, need_review and reason for each track of durations()."""
    by = Window.partitionBy("track_id").orderBy(F.desc("duration_ms"), F.desc("speaker"))
    ranked = sums.withColumn("_rank", F.row_number().over(by))
    top = lambda c, k: F.max(F.when(F.col("_rank") == k, F.col(c)))
    columns = [F.sum("duration_ms").alias("total_ms"), top("speaker", 1).alias("narrator"), top("duration_ms", 1).alias("narrator_ms"), top("duration_ms", 2).alias("_second")]
    columns += [F.max(F.when(F.col("speaker") == preferred, F.col("duration_ms"))).alias("_own")] if preferred else []
    out = ranked.groupBy("track_id").agg(*columns)
    close = F.coalesce((F.col("narrator_ms") - F.col("_second")) / F.col("total_ms") < CLOSE, F.lit(False))
    out = out.withColumn("_close", close)
    if preferred:
        there = F.col("_own").isNotNull()
        out = out.withColumn("reason", F.when(there, "preferred_speaker").otherwise("preferred_missing_fallback_longest"))
        out = out.withColumns({"narrator": F.when(there, F.lit(preferred)).otherwise(F.col("narrator")), "narrator_ms": F.when(there, F.col("_own")).otherwise(F.col("narrator_ms"))}).drop("_own")
    else:
        out = out.withColumn("reason", F.when(F.col("_close"), "longest_speaker_close_race").otherwise("longest_speaker"))
    out = out.withColumn("share", F.col("narrator_ms") / F.col("total_ms"))
    review = (F.col("share") < min_share) | F.col("_close") | (F.col("reason") == "preferred_missing_fallback_longest")
    return out.withColumn("need_review", review).drop("_second", "_close")


def majority_lang(segments: DataFrame) -> DataFrame:
    """lang by (track_id, speaker): by time, rows without length counting 1 ms; the later name wins a tie."""
    rows = segments.select("track_id", T.normalize_speaker(F.col("speaker")).alias("speaker"), T.detect_lang(F.col("text")).alias("lang"), (F.col("end_ms") - F.col("start_ms")).alias("ms"))
    rows = rows.where("speaker is not null and lang not in ('empty', 'other')")
    sums = rows.groupBy("track_id", "speaker", "lang").agg(F.sum(F.when(F.col("ms") == 0, 1).otherwise(F.col("ms"))).alias("score"))
    return sums.groupBy("track_id", "speaker").agg(F.max_by("lang", F.struct("score", "lang")).alias("lang"))


def filter_rows(segments: DataFrame, strict: bool = False, keep_unlabelled: bool = False) -> DataFrame:
    """keep and why for each row: no_narrator (of its track), unlabelled, narrator, same_language or other_speaker.

    Only the narrator's rows, those in the narrator's language unless strict, and if wanted unlabelled ones are kept.
    """
    choice = pick(durations(segments)).select("track_id", "narrator")
    langs = majority_lang(segments).select("track_id", F.col("speaker").alias("narrator"), F.col("lang").alias("narrator_lang"))
    rows = segments.join(choice, "track_id", "left").join(langs, ["track_id", "narrator"], "left")
    who, same = T.normalize_speaker(F.col("speaker")), T.lang_matches(T.detect_lang(F.col("text")), F.coalesce("narrator_lang", F.lit("empty")))
    why = F.when(F.col("narrator").isNull(), "no_narrator").when(who.isNull(), "unlabelled").when(who == F.col("narrator"), "narrator").when(F.lit(not strict) & same, "same_language").otherwise("other_speaker")
    return rows.withColumn("why", why).withColumn("keep", F.col("why").isin("narrator", "same_language", *(["unlabelled"] if keep_unlabelled else []))).drop("narrator", "narrator_lang")


def report(filtered: DataFrame) -> DataFrame:
    """Counters of filter_rows by track, and the dropped rows in order."""
    n = lambda w: F.count_if(F.col("why") == w)
    dropped = F.array_sort(F.collect_list(F.when(~F.col("keep"), F.col("seg_idx"))))
    return filtered.groupBy("track_id").agg(F.count("*").alias("rows"), n("narrator").alias("by_narrator"), n("same_language").alias("by_lang"), n("unlabelled").alias("unlabelled"), n("other_speaker").alias("dropped"), dropped.alias("dropped_rows")).withColumn("need_review", F.col("by_lang") >= 5)
