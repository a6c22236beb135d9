"""Boundaries of rows moved to where speech begins and ends, from frames of loudness and of the spectrum.

frames: (track_id, frame, rms, flatness, strength), where strength tells how much sounds set in at a frame (the rise of the
spectrum, or of its high part), and flatness of noise (near 1) from speech. islands: (track_id, start_ms, end_ms) of speech,
apart from each other. Candidates of a boundary are looked up by frame number or by one ordered pass over points and
islands, and the best is taken by the rule; only boundaries that rows share are settled row by row, over runs of such rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.functions import text as T
from cueframe.operators import intervals, signal, timeline
from cueframe.sources.tables import cut

#: Islands this long are stable, and this long beyond doubt; a start moves at least and at most so far; speech
#: that ended so shortly before lets a start move further, up to the last; onsets are sought so far back.
STABLE, SURE, LEAST, MOST, JUST, BRIDGE, BACK = 100, 200, 40, 300, 400, 1500, 200
TONAL = 0.5  # fixed value: flatness of speech stays below


def _tonal(flatness: Column) -> Column:
    return F.coalesce(flatness < TONAL, F.lit(True))


def around(points: DataFrame, islands: DataFrame, frames: DataFrame, frame_ms: int) -> DataFrame:
    """points (track_id, seg_idx, at_ms) with the island that began last (last_start, last_end), the end of the last stable
    one (stable_end), and the next one to trust (next_start, next_end, sure): stable, or like speech at its onset."""
    at = islands.withColumn("frame", F.floor(F.col("start_ms") / frame_ms)).join(frames.select("track_id", "frame", "flatness"), ["track_id", "frame"], "left")
    long = F.col("end_ms") - F.col("start_ms")
    marks = at.select("track_id", F.lit(None).cast("long").alias("seg_idx"), F.col("start_ms").alias("t"), F.struct("start_ms", "end_ms", (long >= STABLE).alias("stable"), ((long >= STABLE) | _tonal(F.col("flatness"))).alias("trusted"), ((long >= SURE) | _tonal(F.col("flatness"))).alias("sure")).alias("island"))
    both = marks.unionByName(points.select("track_id", "seg_idx", F.col("at_ms").alias("t")), True)
    by = Window.partitionBy("track_id").orderBy("t", F.col("island").isNull())  # islands before points at one time
    so_far, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumns({
        "last": F.last("island", True).over(so_far),
        "stable_end": F.last(F.when(F.col("island.stable"), F.col("island.end_ms")), True).over(so_far),
        "next": F.first(F.when(F.col("island.trusted"), F.col("island")), True).over(ahead),
    }).where("island is null")
    return found.select("track_id", "seg_idx", F.col("t").alias("at_ms"), F.col("last.start_ms").alias("last_start"), F.col("last.end_ms").alias("last_end"), "stable_end", F.col("next.start_ms").alias("next_start"), F.col("next.end_ms").alias("next_end"), F.col("next.sure").alias("sure"))


def strong_frames(islands: DataFrame, frames: DataFrame, frame_ms: int) -> DataFrame:
    """(track_id, start_ms, frame) of the frames of stable islands whose strength is one and a half times the island's upper
    median or more. Medians come from ranks, so no island is gathered in one row."""
    last = F.floor(F.col("end_ms") / frame_ms) - 1
    rows = islands.where(F.col("end_ms") - F.col("start_ms") >= STABLE).select("track_id", "start_ms", F.explode(F.sequence(F.floor(F.col("start_ms") / frame_ms), last)).alias("frame"))
    rows = rows.join(frames.select("track_id", "frame", "strength"), ["track_id", "frame"]).where("strength is not null")
    by = Window.partitionBy("track_id", "start_ms")
    rows = rows.withColumns({"n": F.count("*").over(by), "k": F.row_number().over(by.orderBy("strength", "frame"))})
    limit = rows.where("k = floor(n / 2) + 1 and n > 1 and strength > 0").select("track_id", "start_ms", (F.col("strength") * 1.5).alias("limit"))
    return rows.join(limit, ["track_id", "start_ms"]).where("strength >= limit").select("track_id", "start_ms", "frame")


def snap_starts(points: DataFrame, islands: DataFrame, frames: DataFrame, frame_ms: int = 20, window_ms: int = 350) -> DataFrame:
    """snapped_ms of points (track_id, seg_idx, at_ms): where the sound begins that a row's start means; never earlier than
    its frame.

    Inside a stable island it is the next strong frame of the island; inside a short one it stays. In a pause it is the next
    island to trust within the window, or further on where speech ended just before, and from its onset back to the last
    tonal frame whose strength stands out of the frames before. Other starts stay.
    """
    rows = cut(around(points, islands, frames, frame_ms))
    at = F.col("at_ms")
    inside = F.coalesce(F.col("last_end") >= at, F.lit(False))
    stable = inside & (F.col("last_end") - F.col("last_start") >= STABLE)
    far = F.col("next_start") - at
    reached = (far <= min(MOST, window_ms)) | ((F.col("stable_end") <= at) & (at - F.col("stable_end") <= JUST) & (far <= BRIDGE))
    moves = F.coalesce(~inside & reached & (far >= LEAST) & F.col("sure"), F.lit(False))
    rows = rows.withColumn("how", F.when(stable, "forward").when(moves, "back"))

    marks = strong_frames(islands, frames, frame_ms).select("track_id", "start_ms", "frame", F.lit(None).cast("long").alias("seg_idx"))
    asked = rows.where("how = 'forward'").select("track_id", F.col("last_start").alias("start_ms"), F.floor(at / frame_ms).alias("frame"), "seg_idx")
    ahead = Window.partitionBy("track_id", "start_ms").orderBy("frame", F.col("seg_idx").isNull()).rowsBetween(0, Window.unboundedFollowing)
    forward = marks.unionByName(asked).withColumn("found", F.first(F.when(F.col("seg_idx").isNull(), F.col("frame")), True).over(ahead))
    forward = forward.where("seg_idx is not null").select("track_id", "seg_idx", (F.col("found") * frame_ms).alias("_forward"))

    high = F.floor(F.col("next_start") / frame_ms)
    low = F.greatest(F.floor(at / frame_ms), F.floor((F.col("next_start") - BACK) / frame_ms))
    near = rows.where("how = 'back'").select("track_id", "seg_idx", "next_start", high.alias("high"), F.explode(F.sequence(low, high)).alias("frame"))
    near = near.join(frames.select("track_id", "frame", "strength", "flatness"), ["track_id", "frame"]).where("strength is not null")
    before = F.col("frame") < F.col("high")
    one = near.groupBy("track_id", "seg_idx").agg(F.sort_array(F.collect_list(F.when(before, F.col("strength")))).alias("s"), F.max(F.when(~before, F.col("strength"))).alias("own"), F.collect_list(F.when(before & _tonal(F.col("flatness")), F.struct("frame", "strength"))).alias("c"))  # some ten frames
    limit = F.greatest(F.get("s", F.floor(F.size("s") / 2).cast("int")) * 3, F.greatest(F.array_max("s"), "own") * 0.4)
    one = one.where("own is not null and size(s) > 0").withColumn("limit", limit)
    back = one.select("track_id", "seg_idx", F.array_max(F.transform(F.filter("c", lambda x: (x["strength"] >= F.col("limit")) & (F.col("limit") > 0)), lambda x: x["frame"] * frame_ms)).alias("_back"))

    rows = rows.join(forward, ["track_id", "seg_idx"], "left").join(back, ["track_id", "seg_idx"], "left")
    snapped = F.when(F.col("how") == "forward", F.coalesce("_forward", at)).when(F.col("how") == "back", F.coalesce("_back", "next_start")).otherwise(at)
    return rows.select("track_id", "seg_idx", "at_ms", snapped.alias("snapped_ms"))


def snap_ends(points: DataFrame, islands: DataFrame, frames: DataFrame, frame_ms: int = 20, window_ms: int = 350, padding_ms: int = 40) -> DataFrame:
    """snapped_ms of points (track_id, seg_idx, at_ms): the nearest end of speech, little ahead at most, and the padding."""
    total = frames.groupBy("track_id").agg(((F.max("frame") + 1) * frame_ms).alias("_total"))
    near = intervals.nearest(points, islands.select("track_id", F.col("end_ms").alias("mark_ms")), window_ms, min(120, window_ms)).join(total, "track_id", "left")
    return near.select("track_id", "seg_idx", "at_ms", F.coalesce(F.least(F.col("mark_ms") + padding_ms, "_total"), "at_ms").alias("snapped_ms"))


def settle_shared(segments: DataFrame, islands: DataFrame, frames: DataFrame, frame_ms: int, window_ms: int, padding_ms: int) -> DataFrame:
    """segments (with gap_ms, the pause that the next row had before) that meet or nearly do part in the valley between them.

    The row before ends in the valley, the next one starts at the onset behind it, and where they cross, both at the middle.
    A row's start counts for its own end, so runs of such rows are folded in order.
    """
    following = F.lead("start_ms").over(timeline.track())
    touching = segments.withColumn("right_ms", following).where(F.col("gap_ms") < 80)
    points = touching.select("track_id", "seg_idx", F.col("end_ms").alias("left_ms"), "right_ms")
    found = signal.valleys(points, frames, frame_ms, window_ms).where("valley_ms is not null").select("track_id", "seg_idx", "valley_ms")
    onset = intervals.as_of(found.withColumnRenamed("valley_ms", "at_ms"), islands.select("track_id", F.col("start_ms").alias("mark_ms")), True, window_ms)
    found = found.join(onset.select("track_id", "seg_idx", F.col("mark_ms").alias("onset_ms")), ["track_id", "seg_idx"])
    rows = segments.join(found, ["track_id", "seg_idx"], "left")
    new = F.lag("valley_ms").over(timeline.track()).isNull().cast("long")
    rows = rows.withColumn("_run", F.sum(new).over(timeline.so_far()))
    columns = [*segments.columns]

    def fold(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("seg_idx")
        starts, ends = run["start_ms"].tolist(), run["end_ms"].tolist()
        for k, (valley, onset) in enumerate(zip(run["valley_ms"], run["onset_ms"], strict=True)):
            if pd.isna(valley) or k + 1 == len(starts):
                continue
            ends[k] = max(starts[k] + 200, int(valley) - padding_ms)
            if not pd.isna(onset) and onset <= ends[k + 1]:
                starts[k + 1] = max(starts[k + 1], min(ends[k + 1] - 200, int(onset) - min(padding_ms, 20)))
            if ends[k] > starts[k + 1]:
                ends[k] = starts[k + 1] = (ends[k] + starts[k + 1]) // 2
        return run.assign(start_ms=starts, end_ms=ends)[columns]

    linked = rows.withColumn("_n", F.count("*").over(Window.partitionBy("track_id", "_run")))
    schema = ", ".join(f"`{n}` {t}" for n, t in segments.dtypes)
    return linked.where("_n = 1").select(*columns).unionByName(linked.where("_n > 1").groupBy("track_id", "_run").applyInPandas(fold, schema))


def snap_rows(segments: DataFrame, frames: DataFrame, frame_ms: int = 20, window_ms: int = 350, padding_ms: int = 40) -> DataFrame:
    """segments (track_id, seg_idx, start_ms, end_ms, text, ...) with starts and ends at those of speech, whole chain.

    Starts and ends are snapped apart (a row that would end before its start stays), shared boundaries settled, pauses filled
    up to a readable length, and no row reaches into the next. Tracks without frames, or without speech in them, stay as they
    are, and so does a row with a null time. No rows give no rows.
    """
    islands = cut(signal.speech(frames, frame_ms))
    heard = segments.where("start_ms is not null and end_ms is not null").join(islands.select("track_id").distinct(), "track_id", "left_semi")
    point = lambda c: heard.select("track_id", "seg_idx", F.col(c).alias("at_ms"))
    a = snap_starts(point("start_ms"), islands, frames, frame_ms, window_ms).select("track_id", "seg_idx", F.col("snapped_ms").alias("_a"))
    b = snap_ends(point("end_ms"), islands, frames, frame_ms, window_ms, padding_ms).select("track_id", "seg_idx", F.col("snapped_ms").alias("_b"))
    gap = F.lead("start_ms").over(timeline.track()) - F.col("end_ms")
    rows = heard.withColumn("gap_ms", gap).join(a, ["track_id", "seg_idx"]).join(b, ["track_id", "seg_idx"])
    ok = F.col("_b") > F.col("_a")
    rows = rows.withColumns({"start_ms": F.when(ok, F.col("_a")).otherwise(F.col("start_ms")), "end_ms": F.when(ok, F.col("_b")).otherwise(F.col("end_ms"))}).drop("_a", "_b")
    rows = cut(settle_shared(cut(rows), islands, frames, frame_ms, window_ms, padding_ms).drop("gap_ms"))
    following = F.lead("start_ms").over(timeline.track())
    readable = F.col("start_ms") + F.greatest(F.lit(3000), 1000 + F.greatest(F.lit(1), F.length(T.strip(F.coalesce("text", F.lit(""))))) * 250)
    end = F.when(following > F.col("end_ms"), F.greatest("end_ms", F.least(readable, following))).otherwise(F.least(F.col("end_ms"), F.coalesce(following, "end_ms")))
    rows = rows.withColumn("end_ms", end.cast("long")).select(*segments.columns)
    rest = segments.join(rows.select("track_id", "seg_idx"), ["track_id", "seg_idx"], "left_anti")
    return rows.unionByName(rest)
