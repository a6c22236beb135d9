"""Caption files as segment tables, parsed by built-in expressions: one row per cue, file by file, in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cueframe.functions import text as T
from cueframe.functions import timecode

#: (track_id string, seg_idx int, start_ms bigint, end_ms bigint, text string, translated_text string)
TIME = r"(?:[0-9]+:)?[0-9]{1,2}:[0-9]{1,2}[,.][0-9]{1,3}"


def files(spark: SparkSession, path: str, glob: str = "*.{srt,vtt,ass,json,SRT,VTT,ASS,JSON}") -> DataFrame:
    """(track_id, suffix, content) of the files under path; UTF-8, or GB18030 where the bytes aren't."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.decode("content", "UTF-8")).otherwise(_gb("content"))
    return raw.select(F.col("path").alias("track_id"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("suffix"), F.regexp_replace(text, "^﻿", "").alias("content"))


@F.pandas_udf(StringType())
def _gb(content):  # Spark's decode knows no GB18030
    return content.map(lambda b: None if b is None else bytes(b).decode("gb18030", "replace"))


def _lines(content: Column) -> Column:
    return F.regexp_replace(content, "\r\n?", "\n")


def _numbered(rows: DataFrame) -> DataFrame:
    """Drops blank cues and numbers the others by start; pos tells the order in the file."""
    rows = rows.where(~T.is_blank(F.col("text")) & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    order = Window.partitionBy("track_id").orderBy("start_ms", "pos")
    return rows.select("track_id", F.row_number().over(order).alias("seg_idx"), "start_ms", "end_ms", "text", F.coalesce("translated_text", F.lit("")).alias("translated_text"))


def _blocks(content: DataFrame) -> DataFrame:
    return content.select("track_id", F.posexplode(F.split(_lines(F.col("content")), r"\n\s*\n")).alias("pos", "block"))


def _timed(rows: DataFrame, arrow: str = r"\s-->\s") -> DataFrame:
    pattern = rf"(?m)^.*?({TIME}){arrow}({TIME}).*$"
    rows = rows.where(F.col("block").rlike(pattern))
    return rows.withColumns({"start_ms": timecode.parse(F.regexp_extract("block", pattern, 1)), "end_ms": timecode.parse(F.regexp_extract("block", pattern, 2)), "body": T.strip(F.regexp_extract("block", rf"(?s)^.*?{TIME}{arrow}{TIME}[^\n]*\n(.*)$", 1))})


def parse_srt(content: DataFrame, differing: Column | None = None) -> DataFrame:
    """Segments of SRT texts (track_id, content); a cue needs three lines.

    differing: whether lines 3 and 4 of a block, columns line3 and line4, are of two languages. Where all blocks of a
    track have four lines, and in 70 % of its first 50 they differ, line 4 is the translation.
    """
    rows = _timed(_blocks(content)).withColumn("_l", F.filter(F.split(T.strip(F.col("block")), "\n"), lambda x: T.strip(x) != "")).where(F.size("_l") >= 3)
    rows = rows.withColumns({"line3": F.try_element_at("_l", F.lit(3)), "line4": F.try_element_at("_l", F.lit(4))})
    if differing is None:
        rows = rows.withColumn("two", F.lit(False))
    else:
        whole = Window.partitionBy("track_id")
        rank = F.row_number().over(Window.partitionBy("track_id").orderBy("pos"))
        rows = rows.withColumn("_k", rank).withColumn("_d", F.when(F.col("_k") <= 50, F.coalesce(differing, F.lit(False)).cast("int")))
        rows = rows.withColumn("two", F.min((F.size("_l") == 4).cast("int")).over(whole).cast("boolean") & (F.avg("_d").over(whole) >= 0.7))
    return _numbered(rows.withColumns({"text": F.when(F.col("two"), F.col("line3")).otherwise(F.col("body")), "translated_text": F.when(F.col("two"), F.col("line4"))}))


def parse_vtt(content: DataFrame) -> DataFrame:
    """Segments of WebVTT texts; tags are left out, hours may be missing, cue names are skipped."""
    rows = _timed(_blocks(content), r"\s+-->\s+").where(~F.col("block").rlike(r"^(WEBVTT|NOTE|STYLE)\b"))
    return _numbered(rows.withColumns({"text": T.strip(F.regexp_replace("body", "<[^>]*>", "")), "translated_text": F.lit("")}))


def parse_word_vtt(content: DataFrame) -> DataFrame:
    """Word segments of VTT texts with <time><c>word</c> cues; a word lasts to the next word's time, the last to its cue's end."""
    rows = _timed(_blocks(content), r"\s+-->\s+").where(F.contains("block", F.lit("<c>")))
    first = F.regexp_extract("body", r"(?m)^([^<\n]+)<", 1)
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(rf"<({TIME})><c>([^<]*)</c>"), F.lit(1)).alias("at"), F.regexp_extract_all("body", F.lit(rf"<({TIME})><c>([^<]*)</c>"), F.lit(2)).alias("word"))
    rows = rows.withColumn("_w", pairs).withColumn("_w", F.transform("_w", lambda w: F.struct(timecode.parse(w["at"]).alias("at"), T.strip(w["word"]).alias("word"))))
    head = F.when(T.strip(first) != "", F.array(F.struct(F.col("start_ms").alias("at"), T.strip(first).alias("word")))).otherwise(F.array().cast("array<struct<at:bigint,word:string>>"))
    rows = rows.withColumn("_w", F.concat(head, "_w")).select("track_id", "pos", "end_ms", F.posexplode("_w").alias("k", "w"))
    cue = Window.partitionBy("track_id", "pos").orderBy("k")
    rows = rows.select("track_id", (F.col("pos") * F.lit(1 << 31) + F.col("k")).alias("pos"), F.col("w.at").alias("start_ms"), F.coalesce(F.lead("w.at").over(cue), "end_ms").alias("end_ms"), F.col("w.word").alias("text"), F.lit("").alias("translated_text"))
    return _numbered(rows)


def parse_ass(content: DataFrame) -> DataFrame:
    """Segments of ASS texts; where a file has Default and Secondary rows, those of equal times are text and translation."""
    lines = content.select("track_id", F.posexplode(F.split(_lines(F.col("content")), "\n")).alias("pos", "line")).where(F.col("line").startswith("Dialogue:"))
    pattern = r"^Dialogue:\s*[^,]*,\s*([0-9:.]+)\s*,\s*([0-9:.]+)\s*,([^,]*),[^,]*,[^,]*,[^,]*,[^,]*,[^,]*,(.*)$"
    part = lambda k: F.regexp_extract("line", pattern, k)
    text = T.strip(F.regexp_replace(F.regexp_replace(part(4), r"\{[^}]*\}", ""), r"\\[Nn]", "\n"))
    rows = lines.where(F.col("line").rlike(pattern)).select("track_id", "pos", timecode.parse(part(1)).alias("start_ms"), timecode.parse(part(2)).alias("end_ms"), T.strip(part(3)).alias("style"), text.alias("text"))
    rows = rows.withColumn("two", F.count_if(F.col("style") == "Default").over(Window.partitionBy("track_id")) * F.count_if(F.col("style") == "Secondary").over(Window.partitionBy("track_id")) > 0)
    by = Window.partitionBy("track_id", "start_ms", "end_ms", "style").orderBy("pos")
    rows = rows.withColumn("_k", F.when(F.col("two"), F.row_number().over(by)).otherwise(F.col("pos") + 1_000_000))
    pairs = rows.groupBy("track_id", "start_ms", "end_ms", "_k").agg(F.min("pos").alias("pos"), F.max(F.when(~F.col("two") | (F.col("style") == "Default"), F.col("text"))).alias("text"), F.max(F.when(F.col("two") & (F.col("style") != "Default"), F.col("text"))).alias("translated_text"))
    return _numbered(pairs)


def parse_json(content: DataFrame) -> DataFrame:
    """Segments of JSON texts {"1": {start_time, end_time, original_subtitle, translated_subtitle}, ...}, keys in numeric order."""
    shape = "map<string, struct<start_time: bigint, end_time: bigint, original_subtitle: string, translated_subtitle: string>>"
    rows = content.select("track_id", F.explode(F.from_json("content", shape)).alias("k", "v"))
    return _numbered(rows.select("track_id", F.col("k").try_cast("int").alias("pos"), F.col("v.start_time").alias("start_ms"), F.col("v.end_time").alias("end_ms"), F.col("v.original_subtitle").alias("text"), F.col("v.translated_subtitle").alias("translated_text")))


SUFFIXES = ("srt", "vtt", "ass", "json")


def read_subtitles(spark: SparkSession, path: str, others: str = "refuse") -> DataFrame:
    """Segments of all caption files under path, whatever their formats.

    others: "refuse" raises where there is a file of another suffix, "skip" leaves such files out.
    """
    f = files(spark, path)
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")  # contents aren't read
    if others == "refuse" and (odd := names.where(~F.lower("path").rlike(rf"\.({'|'.join(SUFFIXES)})$")).first()):
        raise ValueError(f"not a caption file: {odd[0]}")
    worded = F.contains("content", F.lit("<c>"))
    parts = [parse_srt(f.where("suffix = 'srt'")), parse_vtt(f.where((F.col("suffix") == "vtt") & ~worded)), parse_word_vtt(f.where((F.col("suffix") == "vtt") & worded)), parse_ass(f.where("suffix = 'ass'")), parse_json(f.where("suffix = 'json'"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parse_replies(replies: DataFrame) -> DataFrame:
    """Segments of recogniser replies (track_id, content): utterances with words, or segments in seconds, as JSON."""
    shape = "struct<utterances: array<struct<start_time: bigint, end_time: bigint, text: string, transcript: string, words: array<struct<start_time: bigint, end_time: bigint, text: string, label: string>>>>, segments: array<struct<start: double, end: double, text: string>>, words: array<struct<start: double, end: double, word: string>>>"
    r = replies.select("track_id", F.from_json("content", shape).alias("j"))
    u = r.select("track_id", F.posexplode("j.utterances").alias("i", "u")).select("track_id", "i", F.posexplode("u.words").alias("k", "w"))
    one = u.select("track_id", (F.col("i") * F.lit(1 << 31) + F.col("k")).alias("pos"), F.col("w.start_time").alias("start_ms"), F.col("w.end_time").alias("end_ms"), F.coalesce("w.text", "w.label").alias("text"))
    ms = lambda c: (F.col(c) * 1000).cast("long")
    two = r.where("j.words is null").select("track_id", F.posexplode("j.segments").alias("pos", "s")).select("track_id", "pos", ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms"), F.col("s.text").alias("text"))
    three = r.select("track_id", F.posexplode("j.words").alias("pos", "s")).select("track_id", "pos", ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms"), F.col("s.word").alias("text"))
    rows = one.unionByName(two).unionByName(three).where(~T.is_non_speech(F.col("text")))
    return _numbered(rows.withColumns({"text": T.strip(F.col("text")), "translated_text": F.lit("")}))


def attach_speakers(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """speaker by position from JSON lists (track_id, content); lists of another length than their track are ignored."""
    own = labels.select("track_id", F.from_json("content", "array<string>").alias("l")).where("l is not null")
    counted = segments.withColumn("_n", F.count("*").over(Window.partitionBy("track_id")))
    joined = counted.join(own, "track_id", "left")
    name = F.when(F.size("l") == F.col("_n"), T.normalize_speaker(F.try_element_at("l", F.col("seg_idx").cast("int"))))
    return joined.withColumn("speaker", F.coalesce(name, F.lit("default"))).drop("_n", "l")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; lines that aren't JSON are left out."""
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def scene_cuts(texts: DataFrame) -> DataFrame:
    """cuts: the sorted distinct pts_time values of each text (track_id, content)."""
    found = F.transform(F.regexp_extract_all("content", F.lit(r"pts_time:\s*([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double"))
    return texts.select("track_id", F.array_sort(F.array_distinct(found)).alias("cuts"))


def decode_reply(reply: Column) -> Column:
    """The JSON array in a model's reply: without thinking blocks and code fences, from the first [ to the last ]."""
    bare = F.regexp_replace(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""), r"```[a-zA-Z]*", "")
    return F.regexp_extract(bare, r"(?s)(\[.*\])", 1)


def reply_object(reply: Column, schema: str) -> Column:
    """A model's reply as an object: what stands between its first { and last }, without thinking blocks and code fences."""
    bare = F.regexp_replace(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""), r"```[a-zA-Z]*", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), schema)


def joined_events(streams: DataFrame) -> DataFrame:
    """(track_id, text) of server-sent events (track_id, content): the text pieces of all data lines in order."""
    lines = F.regexp_extract_all("content", F.lit(r"(?m)^data:[ ]?(\{.*\})[ ]*$"), F.lit(1))
    piece = lambda x: F.coalesce(F.get_json_object(x, "$.choices[0].delta.content"), F.get_json_object(x, "$.text"), F.lit(""))
    return streams.select("track_id", F.array_join(F.transform(lines, piece), "").alias("text"))


#: Phrases that recognisers make up where nobody speaks.
MADE_UP = ("请不吝点赞 订阅 转发", "打赏支持明镜")


def parse_srt_replies(replies: DataFrame, phrases: tuple[str, ...] = MADE_UP) -> DataFrame:
    """Segments of recogniser replies (track_id, content) in SRT form, without sounds in brackets and made-up phrases."""
    rows = parse_srt(replies)
    rows = rows.where(~T.is_non_speech(F.col("text")) & ~T.contains_any(F.col("text"), phrases))
    return rows.withColumn("seg_idx", F.row_number().over(Window.partitionBy("track_id").orderBy("seg_idx")))


def append_log(entries: DataFrame, path: str) -> None:
    """Appends rows to a folder of JSON lines; Spark writes new files, so none has to be locked or rotated."""
    entries.write.mode("append").json(path)


def recent_log(log: DataFrame, text: str = "", columns: tuple[str, ...] = ("task_id", "file_name", "stage", "prompt", "response", "error"), time: str = "time") -> DataFrame:
    """Entries of a log that hold text in one of columns, in any case of letters, newest first."""
    wanted = [F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())) for c in columns if c in log.columns]
    hit = F.lit(not text)
    for w in wanted:
        hit = hit | F.coalesce(w, F.lit(False))
    return log.where(hit).orderBy(F.desc(time))
