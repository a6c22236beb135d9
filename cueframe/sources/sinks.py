"""Segment tables as caption files: one text per track, built by ordered aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueframe.functions import timecode

LAYOUTS = ("original_top", "translation_top", "only_original", "only_translation")


def layout(text: Column, translation: Column, kind: str = "original_top") -> Column:
    """A cue's lines; where there is no translation, the original alone."""
    has = F.coalesce(translation, F.lit("")) != ""
    forms = {"original_top": F.concat(text, F.lit("\n"), translation), "translation_top": F.concat(translation, F.lit("\n"), text), "only_original": text, "only_translation": translation}
    return F.when(has, forms[kind]).otherwise(text)


def joined_lines(segments: DataFrame, line: Column, between: str) -> DataFrame:
    """(track_id, content): the lines of a track in order."""
    rows = segments.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", line.alias("line")))).alias("l"))
    return rows.select("track_id", F.array_join(F.transform("l", lambda x: x["line"]), between).alias("content"))


def to_srt(segments: DataFrame, kind: str = "original_top") -> DataFrame:
    """(track_id, content); seg_idx counts the cues of a track from 1."""
    times = F.concat(timecode.srt(F.col("start_ms")), F.lit(" --> "), timecode.srt(F.col("end_ms")))
    body = layout(F.col("text"), F.col("translated_text"), kind)
    return joined_lines(segments, F.concat(F.col("seg_idx").cast("string"), F.lit("\n"), times, F.lit("\n"), body, F.lit("\n")), "\n")


def to_txt(segments: DataFrame, kind: str = "original_top") -> DataFrame:
    return joined_lines(segments, layout(F.col("text"), F.col("translated_text"), kind), "\n")


def to_json(segments: DataFrame) -> DataFrame:
    value = F.struct(F.col("start_ms").alias("start_time"), F.col("end_ms").alias("end_time"), F.col("text").alias("original_subtitle"), F.col("translated_text").alias("translated_subtitle"))
    rows = segments.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", value.alias("v")))).alias("l"))
    return rows.select("track_id", F.to_json(F.map_from_entries(F.transform("l", lambda x: F.struct(x["seg_idx"].cast("string"), x["v"])))).alias("content"))


def to_ass(segments: DataFrame, header: str = "") -> DataFrame:
    """One row, or with a translation two, per cue, the translation as Secondary first."""
    row = lambda style, c: F.concat(F.lit("Dialogue: 0,"), timecode.ass(F.col("start_ms")), F.lit(","), timecode.ass(F.col("end_ms")), F.lit(f",{style},,0,0,0,,"), F.regexp_replace(c, "\n", r"\\N"))
    first = row("Default", "text")
    both = F.concat(row("Secondary", "translated_text"), F.lit("\n"), first)
    out = joined_lines(segments, F.when(F.coalesce("translated_text", F.lit("")) != "", both).otherwise(first), "\n")
    return out.withColumn("content", F.concat(F.lit(header), "content"))


def speaker_list(segments: DataFrame) -> DataFrame:
    """The speakers of a track as a JSON list, row by row."""
    rows = segments.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", F.coalesce("speaker", F.lit("")).alias("s")))).alias("l"))
    return rows.select("track_id", F.to_json(F.transform("l", lambda x: x["s"])).alias("content"))


def write(segments: DataFrame, path: str, kind: str) -> None:
    """One text row per track under path, partitioned by track; kind is srt, txt, json or ass."""
    form = {"srt": to_srt, "txt": to_txt, "json": to_json, "ass": to_ass}.get(kind)
    if form is None:
        raise ValueError(f"no such caption format: {kind}")
    form(segments).withColumnRenamed("content", "value").write.partitionBy("track_id").text(path)


def composite(dubbed: DataFrame, shown: DataFrame) -> DataFrame:
    """Placed dubs (place_start, place_end) and display rows of a track in one, by start, end and side, numbered anew."""
    from pyspark.sql import Window

    one = dubbed.select("track_id", F.col("place_start").alias("start_ms"), F.greatest(F.col("place_start") + 1, "place_end").alias("end_ms"), "text", F.lit(0).alias("side"), F.col("seg_idx").alias("_p"))
    two = shown.select("track_id", "start_ms", "end_ms", "text", F.lit(1).alias("side"), F.col("seg_idx").alias("_p"))
    by = Window.partitionBy("track_id").orderBy("start_ms", "end_ms", "side", "_p")
    return one.unionByName(two).withColumn("seg_idx", F.row_number().over(by)).drop("_p")
