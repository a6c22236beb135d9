"""Rows to dub: from caption rows and JSON, their adjusted and dropped captions, and what to do where speech fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueframe.functions import text as T
from cueframe.functions import timecode
from cueframe.sources.sinks import joined_lines

#: The fields of a JSON row to dub; either of two names holds a text.
ITEM = "struct<index:bigint,start_time:double,end_time:double,text:string,original_subtitle:string,translated_text:string,translated_subtitle:string,speaker:string>"


def select_text(original: Column, translated: Column, track: str = "auto") -> Column:
    """The original, or the translation where there is one."""
    if track in ("source", "original", "first"):
        return original
    return F.coalesce(F.nullif(translated, F.lit("")), original)


def from_captions(rows: DataFrame, track: str = "auto") -> DataFrame:
    """(track_id, seg_idx, start_ms, end_ms, speaker, text) of caption rows with translated_text; blank rows go, and the
    others keep their numbers. The speaker is the label before the text, or 'default'."""
    speaker, text = T.speaker_prefix(select_text(F.coalesce("text", F.lit("")), F.col("translated_text"), track))
    out = rows.select("track_id", "seg_idx", "start_ms", "end_ms", speaker.alias("speaker"), T.strip(text).alias("text"))
    return out.where("text <> ''")


def from_json(files: DataFrame, track: str = "auto") -> DataFrame:
    """Rows to dub of files (track_id, content): a JSON array, or an object whose keys number its rows.

    Keys of digits come first, by number. A row's own index wins over its place, its own speaker over a label.
    """
    number = lambda k: F.when(k.rlike("^[0-9]+$"), k.cast("long"))
    keyed = F.map_entries(F.from_json("content", f"map<string,{ITEM}>"))
    keyed = F.transform(F.array_sort(F.transform(keyed, lambda e: F.struct(number(e["key"]).isNull().alias("no"), number(e["key"]).alias("n"), e["key"].alias("k"), e["value"].alias("v")))), lambda e: e["v"])
    items = F.when(F.ltrim("content").startswith("["), F.from_json("content", f"array<{ITEM}>")).otherwise(keyed)
    rows = files.select("track_id", F.posexplode(items).alias("_i", "_v")).where("_v is not null")
    either = lambda a, b: F.coalesce(F.nullif(F.col(f"_v.{a}"), F.lit("")), F.col(f"_v.{b}"), F.lit(""))
    raw = select_text(either("text", "original_subtitle"), either("translated_text", "translated_subtitle"), track)
    own = T.strip(F.coalesce("_v.speaker", F.lit("")))
    label, rest = T.speaker_prefix(raw)
    idx = F.when(F.coalesce("_v.index", F.lit(0)) != 0, F.col("_v.index")).otherwise(F.col("_i") + 1).cast("long")
    out = rows.select(
        "track_id", idx.alias("seg_idx"), F.col("_v.start_time").cast("long").alias("start_ms"), F.col("_v.end_time").cast("long").alias("end_ms"),
        F.when(own != "", own).otherwise(label).alias("speaker"), F.when(own != "", T.strip(raw)).otherwise(rest).alias("text"),
    )
    return out.where("text <> ''")


def adjusted_srt(placed: DataFrame) -> DataFrame:
    """(track_id, content): cues shown from place_start to place_end, under their own numbers."""
    return _numbered(placed, "place_start", "place_end")


def dropped_srt(filtered: DataFrame) -> DataFrame:
    """(track_id, content): the cues that a filter drops (not keep), under their own numbers."""
    return _numbered(filtered.where(~F.col("keep")), "start_ms", "end_ms")


def _numbered(rows: DataFrame, start: str, end: str) -> DataFrame:
    times = F.concat(timecode.srt(F.col(start)), F.lit(" --> "), timecode.srt(F.col(end)))
    return joined_lines(rows, F.concat(F.col("seg_idx").cast("string"), F.lit("\n"), times, F.lit("\n"), "text", F.lit("\n")), "\n")


def review_json(filtered: DataFrame) -> DataFrame:
    """(track_id, content): how many rows a filter keeps and drops, and the dropped rows, for somebody to look at."""
    gone = F.array_sort(F.collect_list(F.when(~F.col("keep"), F.struct(F.col("seg_idx").alias("index"), "start_ms", "end_ms", "speaker", "text", "why"))))
    out = filtered.groupBy("track_id").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"), gone.alias("rows"))
    return out.select("track_id", F.to_json(F.struct("kept", "dropped", "rows")).alias("content"))


def needs_duration_retry(duration_ms: Column, target_ms: Column, text: Column, max_speed: float = 1.5, padding_ms: int = 0) -> Column:
    """A short text whose speech is longer than its slot allows at top speed: synthesis may have gone wrong."""
    slot = F.greatest(F.lit(100), target_ms - padding_ms)
    return (F.coalesce(target_ms, F.lit(0)) != 0) & (duration_ms > slot * max_speed) & (F.length(T.strip(text)) <= 40)


def silence_where_failed(rows: DataFrame) -> DataFrame:
    """fitted_ms and warning: rows without fitted_ms (their stage failed) become silence as long as their slot."""
    failed = F.col("fitted_ms").isNull()
    target = F.coalesce(F.nullif(F.col("end_ms") - F.col("start_ms"), F.lit(0)), F.lit(1000))
    return rows.withColumns({"warning": F.when(failed, "silence in place of failed speech"), "fitted_ms": F.coalesce("fitted_ms", F.greatest(F.lit(100), target))})


def track_summary(rows: DataFrame) -> DataFrame:
    """By track: total_ms (the last end, of a slot or of its fitted speech), speakers, and the language to tell them apart in."""
    n = lambda p: F.coalesce(F.sum(F.regexp_count("text", F.lit(p))), F.lit(0))
    cjk, latin, letters = n("[一-鿿]"), n("[A-Za-z]"), n(r"\p{L}")
    language = F.when(letters > cjk + latin, "multi").when(latin > cjk, "en").otherwise("zh")
    return rows.groupBy("track_id").agg(F.max(F.greatest("end_ms", F.col("start_ms") + F.col("fitted_ms"))).alias("total_ms"), F.count_distinct(T.normalize_speaker(F.col("speaker"))).alias("speakers"), language.alias("language"))
