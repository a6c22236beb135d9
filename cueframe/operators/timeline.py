"""Ordered operators over the segments of a track, as windows: each is one shuffle by track and one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cueframe.functions import text as T


def track() -> WindowSpec:
    return Window.partitionBy("track_id").orderBy("seg_idx")


def so_far() -> WindowSpec:
    return track().rowsBetween(Window.unboundedPreceding, 0)


def before() -> WindowSpec:
    return track().rowsBetween(Window.unboundedPreceding, -1)


def clean(segments: DataFrame) -> DataFrame:
    """Drops blank rows and numbers the rest by start, in the given order where starts are equal."""
    rows = segments.where(~T.is_blank(F.col("text")))
    return rows.withColumn("seg_idx", F.row_number().over(Window.partitionBy("track_id").orderBy("start_ms", "seg_idx")))


def smooth(segments: DataFrame, threshold_ms: int = 1000) -> DataFrame:
    """Neighbours less than threshold_ms apart (overlaps too) meet at three quarters of their gap."""
    end, following = F.col("end_ms"), F.lead("start_ms").over(track())
    previous, start = F.lag("end_ms").over(track()), F.col("start_ms")

    def meet(a: Column, b: Column) -> Column:
        return (F.floor((a + b) / 2) + F.floor((b - a) / 4)).cast("long")

    return segments.withColumns({
        "end_ms": F.when(following - end < threshold_ms, meet(end, following)).otherwise(end),
        "start_ms": F.when(start - previous < threshold_ms, meet(previous, start)).otherwise(start),
    })


def islands(segments: DataFrame, max_gap_ms: int = 1500) -> DataFrame:
    """island: number of the run whose gaps are max_gap_ms at most, from 0."""
    far = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(track()) > max_gap_ms, F.lit(False))
    return segments.withColumn("_far", far.cast("long")).withColumn("island", F.sum("_far").over(so_far())).drop("_far")


def place_with_gap(rows: DataFrame, gap_ms: int) -> DataFrame:
    """place_start, place_end: each row at its start, or gap_ms behind the row before where that is later.

    The sequential rule is a max-plus scan: with base = sum of earlier (audio_ms + gap), a row starts at base plus the
    largest start - base so far.
    """
    if gap_ms <= 0:
        return rows.withColumns({"place_start": F.col("start_ms"), "place_end": F.col("start_ms") + F.col("audio_ms")})
    based = rows.withColumn("_base", F.coalesce(F.sum(F.col("audio_ms") + gap_ms).over(before()), F.lit(0)))
    start = F.col("_base") + F.greatest(F.lit(0), F.max(F.col("start_ms") - F.col("_base")).over(so_far()))
    return based.withColumn("place_start", start).withColumn("place_end", F.col("place_start") + F.col("audio_ms")).drop("_base")


def place_with_pause(rows: DataFrame, pause_ms: int) -> DataFrame:
    """place_start, place_end: rows one behind the other with a fixed pause, from 0."""
    start = F.coalesce(F.sum(F.col("audio_ms") + pause_ms).over(before()), F.lit(0))
    return rows.withColumn("place_start", start).withColumn("place_end", F.col("place_start") + F.col("audio_ms"))


def fill_gaps(segments: DataFrame) -> DataFrame:
    """Ends reach the next start, within a readable length by characters; ends never shrink, but the last is capped."""
    chars = F.length(T.remove_punctuation(F.col("text")))
    least, most = F.greatest(F.lit(800), 300 + chars * 60), F.greatest(F.lit(3000), 1000 + chars * 250)
    start, end, following = F.col("start_ms"), F.col("end_ms"), F.lead("start_ms").over(track())
    inner = F.greatest(F.least(start + most, following), F.least(start + least, following), end)
    last = F.least(F.greatest(start + least, end), start + most)
    return segments.withColumn("end_ms", F.when(following.isNull(), last).otherwise(inner).cast("long"))


def chunk_offsets(chunks: DataFrame, overlap_ms: int = 10_000) -> DataFrame:
    """offset_ms of chunks (track_id, seg_idx, end_ms): each begins overlap_ms before the end of the one before."""
    step = F.greatest(F.lit(0), F.col("end_ms") - overlap_ms)
    return chunks.withColumn("offset_ms", F.coalesce(F.sum(step).over(before()), F.lit(0)))


def hop_chunks(tracks: DataFrame, length_ms: int = 600_000, overlap_ms: int = 10_000) -> DataFrame:
    """chunk_idx, start_ms and end_ms of the windows that cover tracks (track_id, total_ms)."""
    hop, total = length_ms - overlap_ms, F.col("total_ms")
    last = F.greatest(F.lit(0), F.ceil((total - length_ms) / hop)).cast("long")
    rows = tracks.where("total_ms > 0").select("track_id", "total_ms", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_idx"))
    return rows.select("track_id", "chunk_idx", (F.col("chunk_idx") * hop).alias("start_ms"), F.least(F.col("chunk_idx") * hop + length_ms, total).alias("end_ms"))


def word_rows(segments: DataFrame) -> DataFrame:
    """A row for each token; a token's time grows with its quarter length, rounded up, and the last ends with its row."""
    parts = F.posexplode(F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0))).alias("word_idx", "word")
    rows = segments.select("track_id", "seg_idx", "start_ms", "end_ms", parts).withColumn("_u", F.ceil(F.length("word") / 4))
    row = Window.partitionBy("track_id", "seg_idx")
    upto = F.sum("_u").over(row.orderBy("word_idx").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_upto": upto, "_per": (F.col("end_ms") - F.col("start_ms")) / F.sum("_u").over(row)})
    start = (F.col("start_ms") + (F.col("_upto") - F.col("_u")) * F.col("_per")).cast("long")
    return rows.select("track_id", "seg_idx", "word_idx", "word", start.alias("word_start"), F.least((F.col("start_ms") + F.col("_upto") * F.col("_per")).cast("long"), "end_ms").alias("word_end"))


def batches(segments: DataFrame, size: int = 20) -> DataFrame:
    return segments.withColumn("batch", F.floor((F.col("seg_idx") - 1) / size))


def split_long(segments: DataFrame, limit: int) -> DataFrame:
    """Rows of more than limit words in parts of nearly equal word counts and proportional times."""
    own = T.tokens_by_space(F.col("text"))
    rows = segments.withColumn("_w", own).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.size("_w") / limit)).cast("long"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    size, span = F.ceil(F.size("_w") / F.col("_n")), F.col("end_ms") - F.col("start_ms")
    at = lambda k: (F.col("start_ms") + F.bround(span * k / F.col("_n"), 0)).cast("long")
    piece = F.when(F.col("_n") == 1, F.col("text")).otherwise(F.array_join(F.slice("_w", (F.col("part") * size + 1).cast("int"), size.cast("int")), " "))
    ends = F.when(F.col("part") == F.col("_n") - 1, F.col("end_ms")).otherwise(at(F.col("part") + 1))
    return rows.select("track_id", "seg_idx", "part", at(F.col("part")).alias("start_ms"), ends.alias("end_ms"), piece.alias("text"))


def merge_groups(segments: DataFrame, group: str, joint: str = " ") -> DataFrame:
    """One row per (track_id, group): span and texts in order."""
    lines = F.array_sort(F.collect_list(F.struct("seg_idx", "text")))
    merged = segments.groupBy("track_id", group).agg(F.min("seg_idx").alias("seg_idx"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), lines.alias("_l"))
    return merged.withColumn("text", F.array_join(F.transform("_l", lambda x: x["text"]), joint)).drop("_l")


def run_ids(segments: DataFrame, column: str) -> DataFrame:
    """run: number of the run of equal values of column, from 0."""
    new = ~F.col(column).eqNullSafe(F.lag(column).over(track())) & F.lag("seg_idx").over(track()).isNotNull()
    return segments.withColumn("_new", new.cast("long")).withColumn("run", F.sum("_new").over(so_far())).drop("_new")


def recent_load(segments: DataFrame, hours: int = 12) -> DataFrame:
    """calls and busy_ms of the trailing hours at each start, the row's own included."""
    window = Window.partitionBy("track_id").orderBy("start_ms").rangeBetween(-hours * 3_600_000, 0)
    return segments.withColumns({"calls": F.count("*").over(window), "busy_ms": F.sum(F.col("end_ms") - F.col("start_ms")).over(window)})


def delete_rows(segments: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the rows (track_id, seg_idx) of gone; the rest is numbered anew."""
    return segments.join(gone, ["track_id", "seg_idx"], "left_anti").withColumn("seg_idx", F.row_number().over(track()))
