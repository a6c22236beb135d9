"""Joins of intervals. One primitive: both sides are dealt to time buckets and joined on (track, bucket), so that long
tracks spread over tasks; a pair that shares several buckets is kept in the first of them only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _dealt(rows: DataFrame, start: str, end: str, bucket_ms: int) -> DataFrame:
    low, high = F.floor(F.col(start) / bucket_ms), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / bucket_ms)
    return rows.withColumn("_bucket", F.explode(F.sequence(low, high)))


def overlap_join(segments: DataFrame, turns: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """Pairs of segments (track_id, start_ms, end_ms) and turns (track_id, d_start, d_end) with overlap_ms above 0."""
    left = _dealt(segments.where("end_ms > start_ms"), "start_ms", "end_ms", bucket_ms)
    right = _dealt(turns.where("d_end > d_start"), "d_start", "d_end", bucket_ms)
    meets = (F.col("start_ms") < F.col("d_end")) & (F.col("d_start") < F.col("end_ms"))
    joined = left.join(right, ["track_id", "_bucket"]).where(meets & (F.col("_bucket") == F.floor(F.greatest("start_ms", "d_start") / bucket_ms)))
    return joined.withColumn("overlap_ms", F.least("end_ms", "d_end") - F.greatest("start_ms", "d_start")).drop("_bucket")


def assign_speakers(segments: DataFrame, turns: DataFrame, bucket_ms: int = 3_600_000, least_share: float = 0.2) -> DataFrame:
    """speaker of each segment (track_id, seg_idx, start_ms, end_ms) from turns (track_id, d_idx, d_start, d_end, who).

    Of several overlapping speakers the one with most overlap, the earlier turn's at a tie; a single one only if it covers
    more than least_share of the segment; else ''.
    """
    pairs = overlap_join(segments.select("track_id", "seg_idx", "start_ms", "end_ms"), turns, bucket_ms)
    sums = pairs.groupBy("track_id", "seg_idx", "start_ms", "end_ms", "who").agg(F.sum("overlap_ms").alias("ms"), F.min(F.struct("d_start", "d_idx")).alias("first"))
    best = sums.groupBy("track_id", "seg_idx", "start_ms", "end_ms").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("ms")).alias("less"), "first", "who", "ms")).alias("best"))
    ok = (F.col("n") >= 2) | (F.col("best.ms") > least_share * (F.col("end_ms") - F.col("start_ms")))
    named = best.select("track_id", "seg_idx", F.when(ok, F.col("best.who")).alias("_who"))
    return segments.join(named, ["track_id", "seg_idx"], "left").withColumn("speaker", F.coalesce("_who", F.lit(""))).drop("_who")


def remap_speakers(labelled: DataFrame, segments: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """Speakers of labelled rows (track_id, seg_idx, start_ms, end_ms, speaker) on segments cut anew."""
    turns = labelled.where("speaker <> ''").select("track_id", F.col("seg_idx").alias("d_idx"), F.col("start_ms").alias("d_start"), F.col("end_ms").alias("d_end"), F.col("speaker").alias("who"))
    return assign_speakers(segments.drop("speaker"), turns, bucket_ms)


def overlaps_any(rows: DataFrame, locked: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """locked: whether each row (track_id, seg_idx) overlaps an interval (track_id, d_start, d_end)."""
    hit = overlap_join(rows.select("track_id", "seg_idx", "start_ms", "end_ms"), locked, bucket_ms).select("track_id", "seg_idx").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, ["track_id", "seg_idx"], "left").withColumn("locked", F.coalesce("_hit", F.lit(False))).drop("_hit")


def nearest(points: DataFrame, marks: DataFrame, back_ms: int, ahead_ms: int) -> DataFrame:
    """mark_ms for points (track_id, seg_idx, at_ms): the nearest of marks (track_id, mark_ms) in [at - back, at + ahead].

    The earlier mark wins a tie; null where there is none. One bucket is as wide as the window, so a point meets two at most.
    """
    width = max(1, back_ms + ahead_ms)
    low, high = F.floor((F.col("at_ms") - back_ms) / width), F.floor((F.col("at_ms") + ahead_ms) / width)
    dealt = points.select("track_id", "seg_idx", "at_ms", F.explode(F.array_distinct(F.array(low, high))).alias("_bucket"))
    joined = dealt.join(marks.select("track_id", "mark_ms", F.floor(F.col("mark_ms") / width).alias("_bucket")).distinct(), ["track_id", "_bucket"])
    joined = joined.where((F.col("mark_ms") >= F.col("at_ms") - back_ms) & (F.col("mark_ms") <= F.col("at_ms") + ahead_ms))
    best = joined.groupBy("track_id", "seg_idx").agg(F.min(F.struct(F.abs(F.col("mark_ms") - F.col("at_ms")).alias("far"), "mark_ms")).alias("b"))
    return points.join(best.select("track_id", "seg_idx", F.col("b.mark_ms").alias("mark_ms")), ["track_id", "seg_idx"], "left")


def as_of(points: DataFrame, marks: DataFrame, forward: bool = False, within_ms: int | None = None) -> DataFrame:
    """mark_ms for each point: the last mark at or before it (forward: the first at or after), within within_ms."""
    both = points.select("track_id", "seg_idx", F.col("at_ms").alias("t"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("m"))
    both = both.unionByName(marks.select("track_id", F.lit(None).cast("long").alias("seg_idx"), F.col("mark_ms").alias("t"), F.lit(0 if not forward else 2).alias("_kind"), F.col("mark_ms").alias("m")))
    order = Window.partitionBy("track_id").orderBy("t", "_kind")
    frame = order.rowsBetween(0, Window.unboundedFollowing) if forward else order.rowsBetween(Window.unboundedPreceding, 0)
    found = (F.first if forward else F.last)("m", ignorenulls=True).over(frame)
    got = both.withColumn("mark_ms", found).where("_kind = 1")
    if within_ms is not None:
        got = got.withColumn("mark_ms", F.when(F.abs(F.col("mark_ms") - F.col("t")) <= within_ms, F.col("mark_ms")))
    return got.select("track_id", "seg_idx", F.col("t").alias("at_ms"), "mark_ms")


def bridge(intervals: DataFrame, max_gap_ms: int) -> DataFrame:
    """Intervals (track_id, start_ms, end_ms) merged where they overlap or are max_gap_ms apart at most."""
    order = Window.partitionBy("track_id").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("_new", F.coalesce(F.col("start_ms") - reach > max_gap_ms, F.lit(True)).cast("long"))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("track_id", "_run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("pieces")).drop("_run")


def bridge_unblocked(spans: DataFrame, blockers: DataFrame) -> DataFrame:
    """Spans (track_id, start_ms, end_ms) merged over any gap in which no blocker (same columns) lies, even in part.

    Spans are merged where they overlap first. A gap is blocked if the last blocker that starts before the next span ends
    behind the span before; blockers merged where they overlap make that one as-of look-up.
    """
    rows = bridge(spans.where("end_ms > start_ms"), 0)
    walls = bridge(blockers.where("end_ms > start_ms"), 0).select("track_id", F.col("start_ms").alias("t"), F.col("end_ms").alias("wall"), F.lit(None).cast("long").alias("end_ms"))
    both = rows.select("track_id", F.col("start_ms").alias("t"), F.lit(None).cast("long").alias("wall"), "end_ms").unionByName(walls)
    order = Window.partitionBy("track_id").orderBy("t", F.col("wall").isNotNull())  # a blocker from the span's start on isn't in the gap
    both = both.withColumn("wall", F.max("wall").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("end_ms is not null")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("_new", (before.isNull() | F.coalesce(F.col("wall") > before, F.lit(False))).cast("long"))
    both = both.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return both.groupBy("track_id", "_run").agg(F.min("t").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_run")
