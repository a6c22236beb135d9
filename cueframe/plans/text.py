"""Text queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueframe.functions import text as T
from cueframe.functions import timecode
from cueframe.sources.tables import DUB, dub_rows, load

NO_SPACE = T.NO_SPACE
WS = r"[ \t\n\r\x0B\f]"


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.count_words(F.coalesce("text", F.lit(""))).alias("words"))


def cjk_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(T.is_mainly_cjk(F.col("text"))).alias("cjk"), F.count_if(T.is_space_separated(F.col("text"))).alias("spaced"), F.count_if(T.is_pure_punctuation(F.col("text"))).alias("punctuation"))
    return d


def text_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.detect_lang(F.col("text")).alias("detected"), T.align_language(F.col("text")).alias("align_language"))


def strip_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = T.remove_punctuation(F.coalesce("text", F.lit("")))
    return load(spark, sf_dir, "documents").select("doc_id", F.length(bare).cast("long").alias("n"), F.md5(bare).alias("md5"))


def trailing_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dub_rows(spark, sf_dir).select("track_id", "seg_idx", T.strip_trailing_stops(F.concat("text", F.lit("，。"))).alias("text"))


def speaker_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dub_rows(spark, sf_dir).select("track_id", "seg_idx", F.when(F.col("seg_idx") % 2 == 0, F.concat(F.lit("["), "speaker", F.lit("] "), "text")).otherwise(F.col("text")).alias("line"))
    who, text = T.speaker_prefix(F.col("line"))
    return rows.select("track_id", "seg_idx", who.alias("speaker"), F.md5(text).alias("md5"))


def srt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dub_rows(spark, sf_dir)
    return rows.select("track_id", "seg_idx", timecode.srt(F.col("start_ms")).alias("srt"), timecode.ass(F.col("end_ms")).alias("ass"), timecode.lrc(F.col("end_ms")).alias("lrc"))


def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dub_rows(spark, sf_dir)
    return rows.select("track_id", "seg_idx", timecode.parse(timecode.srt(F.col("start_ms"))).alias("a"), timecode.parse(timecode.srt(F.col("end_ms"), ".")).alias("b"), timecode.parse(F.lit("x")).alias("c"))


def rewrite_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dub_rows(spark, sf_dir)
    return rows.select("track_id", "seg_idx", T.needs_rewrite(F.col("text"), F.col("start_ms"), F.col("end_ms")).alias("rewrite"), T.is_non_speech(F.col("text")).alias("non_speech"), T.contains_any(F.col("text"), ("the", "zzz")).alias("listed"))


def speakers_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "conversations").select(F.when(F.col("role") == "system", " Unknown ").otherwise(F.concat(F.lit(" "), "role")).alias("raw"))
    return d.select(T.normalize_speaker(F.col("raw")).alias("speaker")).groupBy("speaker").agg(F.count("*").alias("n"))


def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose serialised fields hold a text, newest first."""
    e = load(spark, sf_dir, "events")
    hay = F.lower(F.concat_ws(" ", "event_type", F.col("props")))
    return e.where(F.contains(hay, F.lit("click"))).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content keys of batches of 20 rows, and how many batches share one."""
    rows = dub_rows(spark, sf_dir).withColumn("batch", F.floor(F.col("seg_idx") / 20))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"]), "\n")
    keyed = rows.groupBy("track_id", "batch").agg(lines.alias("t")).select(F.sha2("t", 256).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("batches"))


QUERIES = {f.__name__: f for f in (word_count, cjk_ratio, text_lang, strip_punct, trailing_stops, speaker_prefix, srt_format, time_parse, rewrite_needed, speakers_named, log_search, cache_keys)}

_T = lambda ms: f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"
_HAN = f"len(regexp_extract_all(text, '{T.HAN}'))"
_LATIN = "len(regexp_extract_all(text, '[a-zA-Z]'))"
_U = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SQL = {
    "word_count": f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{NO_SPACE}')) + len(list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '{NO_SPACE}', ' ', 'g'), '{_U}+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents",
    "cjk_ratio": f"""SELECT lang, count(*) FILTER (WHERE length(regexp_replace(text, '{_U}+', '', 'g')) > 0 AND len(regexp_extract_all(text, '{NO_SPACE}')) > 0.5 * length(regexp_replace(text, '{_U}+', '', 'g'))) AS cjk,
        count(*) FILTER (WHERE regexp_matches(regexp_replace(text, '^{_U}+|{_U}+$', '', 'g'), '{T.SPACED.replace("'", "''")}')) AS spaced,
        count(*) FILTER (WHERE NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_]')) AS punctuation FROM documents GROUP BY lang""",
    "text_lang": f"""SELECT doc_id, CASE WHEN trim(coalesce(text, ''), E' \\t\\n\\r') = '' THEN 'empty' WHEN {_HAN} = 0 AND {_LATIN} = 0 THEN 'other' WHEN {_LATIN} = 0 THEN 'zh' WHEN {_HAN} = 0 THEN 'en'
        WHEN {_HAN} >= {_LATIN} THEN 'zh' WHEN {_LATIN} >= {_HAN} * 2 THEN 'en' ELSE 'mixed' END AS detected, CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' ELSE 'en' END AS align_language FROM documents""",
    "strip_punct": r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '([0-9])\.([0-9])', '\1@@DOT@@\2', 'g'), '([0-9])\.([0-9])', '\1@@DOT@@\2', 'g') AS t FROM documents),
        b AS (SELECT doc_id, replace(regexp_replace(t, '[。，！？；：、,.!?;: 　「」『』“”‘’（）()【】\[\]"…—–·《》〈〉-]', '', 'g'), '@@DOT@@', '.') AS t FROM a)
        SELECT doc_id, length(t) AS n, md5(t) AS md5 FROM b""",
    "trailing_stops": f"WITH {DUB} SELECT track_id, seg_idx, regexp_replace(text || '，。', '[，。]+$', '') AS text FROM dub",
    "speaker_prefix": f"""WITH {DUB} SELECT track_id, seg_idx, CASE WHEN seg_idx % 2 = 0 AND trim(text, E' \\t\\n\\r') <> '' THEN speaker WHEN seg_idx % 2 = 0 THEN 'default' ELSE 'default' END AS speaker,
        md5(CASE WHEN seg_idx % 2 = 0 AND trim(text, E' \\t\\n\\r') = '' THEN '[' || speaker || ']' ELSE trim(text, E' \\t\\n\\r') END) AS md5 FROM dub""",
    "srt_format": f"WITH {DUB} SELECT track_id, seg_idx, {_T('start_ms')} AS srt, printf('%d:%02d:%02d.%02d', end_ms // 3600000, (end_ms // 60000) % 60, (end_ms // 1000) % 60, (end_ms // 10) % 100) AS ass, printf('%02d:%02d.%02d', end_ms // 60000, (end_ms // 1000) % 60, (end_ms // 10) % 100) AS lrc FROM dub",
    "time_parse": f"WITH {DUB} SELECT track_id, seg_idx, start_ms AS a, end_ms AS b, CAST(NULL AS BIGINT) AS c FROM dub",
    "rewrite_needed": f"""WITH {DUB} SELECT track_id, seg_idx, len(list_filter(string_split_regex(text, '{_U}+'), lambda x: x <> '')) / greatest((end_ms - start_ms) / 1000.0, 0.1) > 2.7 * 1.15 AS rewrite,
        regexp_matches(ltrim(text, E' \\t\\n\\r'), '^[【\\[(（]') AS non_speech, contains(text, 'the') OR contains(text, 'zzz') AS listed FROM dub""",
    "speakers_named": "SELECT CASE WHEN role <> 'system' THEN role END AS speaker, count(*) AS n FROM conversations GROUP BY 1",
    "log_search": "SELECT event_type, count(*) AS n, max(event_id) AS newest FROM events WHERE contains(lower(concat_ws(' ', event_type, props)), 'click') GROUP BY event_type",
    "cache_keys": f"WITH {DUB}, b AS (SELECT sha256(string_agg(text, E'\\n' ORDER BY seg_idx, text)) AS key FROM dub GROUP BY track_id, seg_idx // 20) SELECT key, count(*) AS batches FROM b GROUP BY key",
}
