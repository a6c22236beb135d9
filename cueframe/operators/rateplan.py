"""Video rate plans: stretches of source video and the factor each is slowed or sped by, so that dubs fit.

All of it is windows over the events of a track: the starts of dub slots and of locked slots. An event owns the time up
to the next event; locked intervals inside it are cut out and keep factor 1; the rest gets the factor that lets its dub
fit, within 1 / max_slowdown and max_slowdown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate_plan(slots: DataFrame, video: DataFrame, gap_ms: int = 0, max_slowdown: float = 2.0, locked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """slots: (track_id, slot, start_ms, end_ms, audio_ms); video: (track_id, video_ms); locked: (track_id, start_ms, end_ms).

    Returns items (track_id, item, start_ms, end_ms, factor, out_start, out_end) that cover the video without gaps, and
    placements (track_id, slot, place_start, place_end, extra_tempo). Tracks without slots have neither.
    """
    rate, gap = max(1.0, float(max_slowdown)), max(0, int(gap_ms))
    low = F.greatest(F.lit(0), F.col("start_ms")).cast("long")
    fixed = lambda df: df.withColumn("start_ms", low).withColumn("end_ms", F.greatest(F.col("start_ms") + 1, F.col("end_ms")).cast("long"))
    slots = fixed(slots.select("track_id", "slot", "start_ms", "end_ms", "audio_ms"))
    schema = slots.select("track_id", "start_ms", "end_ms")
    locked = fixed(locked.select("track_id", "start_ms", "end_ms")).join(slots.select("track_id").distinct(), "track_id", "left_semi") if locked is not None else schema.limit(0)
    ends = schema.unionByName(locked).groupBy("track_id").agg(F.max("end_ms").alias("_end"))
    video = ends.join(video, "track_id", "left").select("track_id", F.greatest("_end", F.coalesce("video_ms", F.lit(0))).cast("long").alias("video_end"))
    holds = locked.groupBy("track_id").agg(F.collect_set(F.struct("start_ms", "end_ms")).alias("holds"))  # of one track

    dub = slots.groupBy("track_id", "start_ms").agg(F.min(F.struct("slot", "audio_ms")).alias("d"))
    events = dub.select("track_id", "start_ms", F.col("d.slot").alias("slot"), F.col("d.audio_ms").alias("audio_ms"), F.lit(0).alias("lock"))
    events = events.unionByName(locked.select("track_id", "start_ms", F.lit(None).cast(slots.schema["slot"].dataType).alias("slot"), F.lit(None).cast("long").alias("audio_ms"), F.lit(1).alias("lock")))
    best = Window.partitionBy("track_id", "start_ms").orderBy(F.desc("lock"))
    events = events.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k").join(video, "track_id").where("start_ms < video_end")
    track = Window.partitionBy("track_id").orderBy("start_ms")
    events = events.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(track), "video_end"))
    first = events.groupBy("track_id").agg(F.min("start_ms").alias("end_ms"), F.first("video_end").alias("video_end")).where("end_ms > 0")
    head = first.select("track_id", F.lit(0).cast("long").alias("start_ms"), "end_ms", F.lit(None).cast(slots.schema["slot"].dataType).alias("slot"), F.lit(None).cast("long").alias("audio_ms"), F.lit(2).alias("lock"), "video_end")
    events = events.unionByName(head).join(holds, "track_id", "left").withColumn("holds", F.coalesce("holds", F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>")))

    inside = F.filter(F.flatten(F.transform("holds", lambda h: F.array(h["start_ms"], h["end_ms"]))), lambda t: (t > F.col("start_ms")) & (t < F.col("end_ms")))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array("start_ms", "end_ms"), inside)))
    pairs = F.transform(F.sequence(F.lit(1), F.size("_cuts") - 1), lambda i: F.struct(F.element_at("_cuts", i).alias("a"), F.element_at("_cuts", i + 1).alias("b")))
    events = events.withColumn("_cuts", cuts).withColumn("_pieces", pairs)
    kept = lambda p: (F.col("lock") == 1) | F.exists("holds", lambda h: (h["start_ms"] < p["b"]) & (h["end_ms"] > p["a"]))
    events = events.withColumn("_pieces", F.transform("_pieces", lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), kept(p).alias("fixed"))))
    still = F.aggregate("_pieces", F.lit(0).cast("long"), lambda s, p: s + F.when(p["fixed"], p["b"] - p["a"]).otherwise(0))
    events = events.withColumn("_fixed", still).withColumn("_free", F.col("end_ms") - F.col("start_ms") - F.col("_fixed"))
    least, most = F.col("_fixed") + F.col("_free") / rate, F.col("_fixed") + F.col("_free") * rate
    space = F.least(F.lit(gap), F.greatest(F.lit(0), most.cast("long") - 100))
    audio = F.greatest(F.lit(1), F.col("audio_ms"))
    room = F.greatest(F.lit(1.0), most - F.col("_space"))
    events = events.withColumn("_space", space).withColumn("extra_tempo", F.when(audio > room, audio / room).otherwise(1.0))
    target = F.least(F.greatest(audio / F.col("extra_tempo") + F.col("_space"), least), most)
    factor = F.when((F.col("lock") == 0) & (F.col("_free") > 0), (target - F.col("_fixed")) / F.col("_free")).otherwise(1.0)
    pieces = events.withColumn("_factor", factor).select("track_id", "slot", "lock", "extra_tempo", "_factor", F.col("start_ms").alias("_event"), F.explode("_pieces").alias("p"))
    pieces = pieces.select("track_id", "slot", "lock", "extra_tempo", "_event", F.col("p.a").alias("start_ms"), F.col("p.b").alias("end_ms"), F.when(F.col("p.fixed"), 1.0).otherwise(F.col("_factor")).alias("factor"))
    length = (F.col("end_ms") - F.col("start_ms")) * F.col("factor")
    pieces = pieces.withColumn("out_end", F.sum(length).over(track.rowsBetween(Window.unboundedPreceding, 0))).withColumn("out_start", F.col("out_end") - length).withColumn("item", F.row_number().over(track))
    items = pieces.select("track_id", "item", "start_ms", "end_ms", "factor", "out_start", "out_end")

    own = pieces.where((F.col("lock") == 0) & (F.col("start_ms") == F.col("_event"))).select("track_id", "slot", F.col("out_start").alias("_own"), "extra_tempo")
    placed = map_times(slots.withColumn("at_ms", F.col("start_ms")), items).join(own, ["track_id", "slot"], "left")
    placed = placed.withColumn("place_start", F.coalesce(F.bround("_own", 0), F.col("out_ms").cast("double")).cast("long")).withColumn("extra_tempo", F.coalesce("extra_tempo", F.lit(1.0)))
    return items, placed.select("track_id", "slot", "place_start", (F.col("place_start") + F.bround(F.col("audio_ms") / F.col("extra_tempo"), 0).cast("long")).alias("place_end"), "extra_tempo")


def map_times(points: DataFrame, items: DataFrame) -> DataFrame:
    """Adds out_ms, the output time of at_ms: the piece that begins at or before it tells, beyond the last time goes on.

    An as-of join by a window over both sides, one shuffle by track.
    """
    both = points.withColumn("_t", F.greatest(F.lit(0), F.col("at_ms"))).withColumn("_kind", F.lit(1)).withColumn("_i", F.lit(None).cast("struct<start_ms:bigint,end_ms:bigint,factor:double,out_start:double,out_end:double>"))
    plan = items.select("track_id", F.col("start_ms").alias("_t"), F.lit(0).alias("_kind"), F.struct("start_ms", "end_ms", "factor", "out_start", "out_end").alias("_i"))
    both = both.unionByName(plan, allowMissingColumns=True)
    last = F.last("_i", ignorenulls=True).over(Window.partitionBy("track_id").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_i", last).where("_kind = 1")
    inside = F.col("_i.out_start") + (F.least("_t", "_i.end_ms") - F.col("_i.start_ms")) * F.col("_i.factor") + F.greatest(F.lit(0), F.col("_t") - F.col("_i.end_ms"))
    return both.withColumn("out_ms", F.coalesce(F.bround(inside, 0), F.col("_t").cast("double")).cast("long")).drop("_t", "_kind", "_i")
