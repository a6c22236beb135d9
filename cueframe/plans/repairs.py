"""Queries over rows to dub, edits by key, and repairs of aligned rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueframe.functions import text as T
from cueframe.operators import catalog, dubbing, edits, intervals, polish, stages, timeline
from cueframe.sources import subtitles
from cueframe.sources.tables import DUB, TIMELINE, dub_rows, load
from cueframe.sources.tables import timeline as tl


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dub_rows(spark, sf_dir)
    return rows.where("seg_idx % 3 > 0").select("track_id", "seg_idx", F.when(F.col("seg_idx") % 3 == 1, F.concat(F.lit("> "), "text")).otherwise("  ").alias("reply"))


def dub_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to dub of captions with translations and labels; numbers stay where blank rows go."""
    text = F.when(F.col("seg_idx") % 2 == 0, F.concat(F.lit("["), "speaker", F.lit("] "), "text")).when(F.col("seg_idx") % 5 == 1, " ").otherwise(F.col("text"))
    rows = dub_rows(spark, sf_dir).withColumns({"text": text, "translated_text": F.when(F.col("seg_idx") % 3 == 0, "said").otherwise("")})
    return dubbing.from_captions(rows).select("track_id", "seg_idx", "start_ms", "speaker", F.md5("text").alias("md5"))


def dub_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from JSON, half of the tracks as objects keyed by number."""
    row = F.struct(F.col("start_ms").alias("start_time"), F.col("end_ms").alias("end_time"), F.col("text").alias("original_subtitle"), "speaker")
    rows = dub_rows(spark, sf_dir).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", row.alias("v")))).alias("l"))
    keyed = F.to_json(F.map_from_entries(F.transform("l", lambda x: F.struct(x["seg_idx"].cast("string"), x["v"]))))
    files = rows.select("track_id", F.when(F.col("track_id") % 2 == 0, keyed).otherwise(F.to_json(F.transform("l", lambda x: x["v"]))).alias("content"))
    return dubbing.from_json(files).select("track_id", "seg_idx", "start_ms", "end_ms", "speaker", F.md5("text").alias("md5"))


def adjusted_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dubbing.adjusted_srt(timeline.place_with_gap(dub_rows(spark, sf_dir), 0)).select("track_id", F.md5("content").alias("md5"))


def dropped_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dub_rows(spark, sf_dir).withColumns({"keep": F.col("speaker") != "assistant", "why": F.lit("other_speaker")})
    review = dubbing.review_json(rows).select("track_id", F.get_json_object("content", "$.kept").cast("long").alias("kept"), F.get_json_object("content", "$.dropped").cast("long").alias("dropped"))
    return dubbing.dropped_srt(rows).join(review, "track_id", "right").select("track_id", F.md5("content").alias("md5"), "kept", "dropped")


def failed_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without speech as silence, and rows whose speech should be made again."""
    rows = dub_rows(spark, sf_dir).withColumn("fitted_ms", F.when(F.col("seg_idx") % 3 > 0, F.col("audio_ms") * (F.col("seg_idx") % 3)))
    again = dubbing.needs_duration_retry(F.col("fitted_ms"), F.col("end_ms") - F.col("start_ms"), F.substring("text", 1, 30))
    return dubbing.silence_where_failed(rows.withColumn("again", F.coalesce(again, F.lit(False)))).select("track_id", "seg_idx", "fitted_ms", F.col("warning").isNotNull().alias("silent"), "again")


def dub_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dubbing.track_summary(dub_rows(spark, sf_dir).withColumn("fitted_ms", F.col("audio_ms") + 500))


def optimised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dub_rows(spark, sf_dir)
    one = edits.optimised(rows, _replies(spark, sf_dir)).select("track_id", "seg_idx", F.md5("text").alias("optimised"))
    two = edits.rewritten(rows, _replies(spark, sf_dir)).select("track_id", "seg_idx", F.md5("text").alias("rewritten"))
    return one.join(two, ["track_id", "seg_idx"])


def updated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected rows through a stage, then rows put in place or added by key."""
    rows = dub_rows(spark, sf_dir).select("track_id", "seg_idx", "start_ms", "text")
    out = edits.update_selected(rows, rows.where("seg_idx % 4 = 1"), lambda x: x.select("track_id", "seg_idx", F.reverse("text").alias("reply")))
    new = rows.where("seg_idx % 5 = 0").select("track_id", (F.col("seg_idx") * 2).alias("seg_idx"), "start_ms", F.lit("new").alias("text")).dropDuplicates(["track_id", "seg_idx"])
    return edits.upsert(out.select(*rows.columns), new).select("track_id", "seg_idx", F.md5("text").alias("md5"))


def merged_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tl(spark, sf_dir).withColumn("text", F.col("speaker"))
    return edits.merge_selected(rows, rows.where("seg_idx % 4 in (1, 2)")).select("track_id", "seg_idx", "start_ms", "end_ms", "text")


def zipped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dub_rows(spark, sf_dir)
    labels = rows.where("seg_idx % 5 <> 4").select("track_id", (F.col("seg_idx") + 1).alias("place"), F.col("speaker").alias("label"))
    return edits.zip_labels(rows.select("track_id", "seg_idx"), labels).select("track_id", "seg_idx", "label", "mismatch")


def containing_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tl(spark, sf_dir)
    spans = rows.where("speaker = 'purchase'").select("track_id", "start_ms", F.least("end_ms", F.col("start_ms") + 7_200_000).alias("end_ms"))
    points = rows.select("track_id", "seg_idx", F.col("start_ms").alias("at_ms"))
    return edits.containing(points, spans, 3_600_000).select("track_id", "seg_idx", "span_start", "span_end")


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three longest rows of each speaker in a track."""
    rows = dub_rows(spark, sf_dir).withColumn("g", F.concat_ws("/", F.col("track_id").cast("string"), "speaker"))
    return edits.first_rows(rows, 3, F.struct(-F.length("text"), F.col("seg_idx")), "g").select("track_id", "seg_idx", "speaker")


def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "events").select("event_id", "event_type", "ts", "props")
    return edits.page(subtitles.recent_log(log, "PURCHASE", ("event_type", "props"), "ts"), 1, F.desc("ts"), "event_id").select("event_id")


def word_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dub_rows(spark, sf_dir)
    words = timeline.word_rows(rows).select((-F.col("track_id") - 1).alias("track_id"), F.col("word").alias("text"))
    return polish.word_level_tracks(rows.select("track_id", "text").unionByName(words))


def shown_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.strip_subtitle_punctuation(F.concat("text", F.lit(" 2.5 1.0.0. don’t (x)")))
    return dub_rows(spark, sf_dir).select("track_id", "seg_idx", F.md5(text).alias("md5"))


def said_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.utterances(F.translate(F.col("text"), ".?", "。？"))
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(parts).cast("long").alias("parts"), F.md5(F.array_join(parts, "|")).alias("md5"))


def small_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes, colours and language codes."""
    names = ["english", "thai", "portuguese_pt", "tagalog", "spanish_latam", "hebrew", "english_uk", "klingon"]
    language = F.element_at(F.array(*map(F.lit, names)), (F.col("n_nationkey") % 8 + 1).cast("int"))
    service = F.element_at(F.array(*map(F.lit, catalog.SERVICES)), (F.col("n_nationkey") % 3 + 1).cast("int"))
    web = F.concat(F.lit("#"), F.lpad(F.hex(F.col("n_nationkey").cast("long") * 600_000), 6, "0"))
    return load(spark, sf_dir, "nation").select("n_nationkey", T.short_hash(F.col("n_name")).alias("h"), T.ass_colour(web).alias("ass"), T.web_colour(T.ass_colour(web)).alias("web"), catalog.language_code(language, service).alias("code"))


def filled_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tl(spark, sf_dir).select("track_id", "seg_idx", F.when(F.col("event_id") % 4 == 0, F.col("start_ms")).alias("at_ms"))
    return polish.fill_times(points, F.lit(1_800_000_000_000)).withColumn("at_ms", F.round("at_ms").cast("long"))


def pause_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' words, every seventh of which comes late."""
    words = timeline.word_rows(dub_rows(spark, sf_dir))
    late = F.col("word_start") + F.floor(F.col("word_idx") / 7) * 5000
    parts = polish.pause_parts(words.select("track_id", "seg_idx", F.col("word_idx").alias("pos"), late.alias("at_ms")))
    return parts.groupBy("track_id", "seg_idx").agg(F.count("*").alias("words"), F.max("part").alias("cuts"))


def tiny_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tl(spark, sf_dir).withColumn("text", F.substring("speaker", 1, (F.col("event_id") % 4).cast("int")))
    return polish.merge_tiny(rows).select("track_id", "seg_idx", "start_ms", "end_ms", "text")


def fixed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, in tenths of their time, so that they collide."""
    rows = tl(spark, sf_dir).select("track_id", "seg_idx", F.floor(F.col("start_ms") / 100_000).alias("start_ms"), (F.floor(F.col("start_ms") / 100_000) + F.col("event_id") % 7 * 900 - 900).alias("end_ms"), F.col("speaker").alias("text"))
    return polish.fix_overlaps(rows).select("track_id", "seg_idx", "start_ms", "end_ms")


def short_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dub_rows(spark, sf_dir).withColumns({"start_ms": F.col("seg_idx") * 1000, "end_ms": F.col("seg_idx") * 1000 + 600 + F.col("seg_idx") % 3 * 150, "text": F.array_join(F.slice(F.split("text", " "), 1, (F.col("seg_idx") % 6 + 1).cast("int")), " ")})
    return polish.merge_short(rows)


def unblocked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tl(spark, sf_dir).select("track_id", "speaker", "start_ms", F.least("end_ms", F.col("start_ms") + 600_000).alias("end_ms"))
    return intervals.bridge_unblocked(rows.where("speaker in ('view', 'click')"), rows.where("speaker not in ('view', 'click')"))


def strategy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.whole_or_batches(tl(spark, sf_dir), 20, 60).select("track_id", "seg_idx", "batch")


def paired_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations beside a version in which some are left out and some changed."""
    rows = dub_rows(spark, sf_dir).withColumn("l", F.col("text"))
    lines = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", c.alias("l")))), lambda x: x["l"])
    own = rows.groupBy("track_id").agg(lines(F.col("l")).alias("source"), F.filter(lines(F.when(F.col("seg_idx") % 4 != 2, F.when(F.col("seg_idx") % 3 == 1, F.upper("l")).otherwise(F.col("l")))), lambda x: x.isNotNull()).alias("target"))
    return edits.pair_lines(own.withColumn("batch", F.lit(0).cast("long"))).select("track_id", "line", F.md5("source").alias("source"), F.md5("target").alias("target"))


def matched_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lines of at most 60 characters, found again among their words, four rows at a time."""
    rows = dub_rows(spark, sf_dir).where("trim(text) <> ''").withColumn("batch", F.floor(F.col("seg_idx") / 4))
    sentences = rows.select("track_id", "batch", "seg_idx", F.posexplode(T.pack_sentences(F.col("text"), F.lit(60))).alias("line", "text"))
    sentences = sentences.select("track_id", "batch", (F.col("seg_idx") * 100_000 + F.col("line")).alias("seg_idx"), "text")
    words = timeline.word_rows(rows.drop("batch")).select("track_id", F.floor(F.col("seg_idx") / 4).alias("batch"), (F.col("seg_idx") * 100_000 + F.col("word_idx")).alias("seg_idx"), F.concat("word", F.lit(" ")).alias("text"))
    return edits.match_sentences(words, sentences)


QUERIES = {
    f.__name__: f
    for f in (
        dub_captions, dub_json, adjusted_captions, dropped_captions, failed_speech, dub_summary, optimised_rows, updated_rows, merged_selection, zipped_labels, containing_span, hints, log_page, word_level,
        shown_text, said_parts, small_values, filled_times, pause_cuts, tiny_merges, fixed_overlaps, short_merges, unblocked_spans, strategy_batches, paired_lines, matched_sentences,
    )
}

_TIME = lambda c: f"printf('%02d:%02d:%02d,%03d', {c} // 3600000, ({c} // 60000) % 60, ({c} // 1000) % 60, {c} % 1000)"
_STRIP = lambda c: f"regexp_replace({c}, '^[\\s\\x{{85}}\\x{{A0}}]+|[\\s\\x{{85}}\\x{{A0}}]+$', '', 'g')"
_CUES = lambda a, b: f"md5(string_agg(seg_idx || chr(10) || {_TIME(a)} || ' --> ' || {_TIME(b)} || chr(10) || text || chr(10), chr(10) ORDER BY seg_idx))"
_SHOWN = "regexp_replace(regexp_replace({0}, '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g')"
SQL = {
    "dub_captions": f"""WITH {DUB}, t AS (SELECT *, CASE WHEN seg_idx % 3 = 0 THEN 'said' WHEN seg_idx % 2 = 0 THEN text WHEN seg_idx % 5 = 1 THEN '' ELSE text END AS own FROM dub)
        SELECT track_id, seg_idx, start_ms, CASE WHEN seg_idx % 3 > 0 AND seg_idx % 2 = 0 AND {_STRIP("text")} <> '' THEN speaker ELSE 'default' END AS speaker,
        md5(CASE WHEN seg_idx % 3 > 0 AND seg_idx % 2 = 0 AND {_STRIP("text")} = '' THEN '[' || speaker || ']' ELSE {_STRIP("own")} END) AS md5 FROM t WHERE {_STRIP("own")} <> '' OR seg_idx % 3 > 0 AND seg_idx % 2 = 0""",
    "dub_json": f"""WITH {DUB} SELECT track_id, CASE WHEN track_id % 2 = 0 THEN r ELSE r END AS seg_idx, start_ms, end_ms, speaker, md5({_STRIP("text")}) AS md5
        FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seg_idx) AS r FROM dub) WHERE {_STRIP("text")} <> ''""",
    "adjusted_captions": f"WITH {DUB}, p AS (SELECT *, start_ms + audio_ms AS z FROM dub) SELECT track_id, {_CUES('start_ms', 'z')} AS md5 FROM p GROUP BY 1",
    "dropped_captions": f"""WITH {DUB}, g AS (SELECT track_id, {_CUES("start_ms", "end_ms")} AS md5 FROM dub WHERE speaker = 'assistant' GROUP BY 1)
        SELECT track_id, md5, kept, dropped FROM (SELECT track_id, count(*) FILTER (speaker <> 'assistant') AS kept, count(*) FILTER (speaker = 'assistant') AS dropped FROM dub GROUP BY 1) LEFT JOIN g USING (track_id)""",
    "failed_speech": f"""WITH {DUB}, f AS (SELECT *, CASE WHEN seg_idx % 3 > 0 THEN audio_ms * (seg_idx % 3) END AS f, end_ms - start_ms AS t FROM dub)
        SELECT track_id, seg_idx, CAST(coalesce(f, greatest(100, CASE WHEN t = 0 THEN 1000 ELSE t END)) AS BIGINT) AS fitted_ms, f IS NULL AS silent,
        coalesce(t <> 0 AND f > greatest(100, t) * 1.5 AND length({_STRIP("substr(text, 1, 30)")}) <= 40, false) AS again FROM f""",
    "dub_summary": f"""WITH {DUB}, n AS (SELECT track_id, max(greatest(end_ms, start_ms + audio_ms + 500)) AS total_ms, count(DISTINCT speaker) AS speakers, string_agg(text, '') AS t FROM dub GROUP BY 1),
        c AS (SELECT *, length(regexp_replace(t, '[^一-鿿]', '', 'g')) AS cjk, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(t, '\\P{{L}}', '', 'g')) AS letters FROM n)
        SELECT track_id, total_ms, speakers, CASE WHEN letters > cjk + latin THEN 'multi' WHEN latin > cjk THEN 'en' ELSE 'zh' END AS language FROM c""",
    "optimised_rows": f"WITH {DUB} SELECT track_id, seg_idx, md5(CASE seg_idx % 3 WHEN 0 THEN text WHEN 1 THEN '> ' || text ELSE '  ' END) AS optimised, md5(CASE WHEN seg_idx % 3 = 1 THEN {_STRIP(chr(39) + '> ' + chr(39) + ' || text')} ELSE text END) AS rewritten FROM dub",
    "updated_rows": f"""WITH {DUB}, u AS (SELECT track_id, seg_idx, CASE WHEN seg_idx % 4 = 1 AND {_STRIP("text")} <> '' THEN {_STRIP("reverse(text)")} ELSE text END AS text FROM dub),
        n AS (SELECT DISTINCT track_id, seg_idx * 2 AS seg_idx FROM dub WHERE seg_idx % 5 = 0)
        SELECT track_id, seg_idx, md5(text) AS md5 FROM u WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.track_id = u.track_id AND n.seg_idx = u.seg_idx) UNION ALL SELECT track_id, seg_idx, md5('new') FROM n""",
    "merged_selection": f"""WITH {TIMELINE} SELECT track_id, min(seg_idx) AS seg_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(speaker, ' ' ORDER BY seg_idx) AS text FROM tl
        GROUP BY track_id, CASE WHEN seg_idx % 4 IN (1, 2) THEN (seg_idx // 4) * 4 + 1 ELSE seg_idx + 1000000 END""",
    "zipped_labels": f"""WITH {DUB}, r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seg_idx) AS place, count(*) OVER (PARTITION BY track_id) AS n FROM dub),
        l AS (SELECT track_id, seg_idx + 1 AS place, speaker AS label FROM dub WHERE seg_idx % 5 <> 4)
        SELECT r.track_id, r.seg_idx, l.label, coalesce(n <> (SELECT max(place) FROM l AS m WHERE m.track_id = r.track_id), true) AS mismatch FROM r LEFT JOIN l ON l.track_id = r.track_id AND l.place = r.place""",
    "containing_span": f"""WITH {TIMELINE}, s AS (SELECT track_id, start_ms, least(end_ms, start_ms + 7200000) AS end_ms FROM tl WHERE speaker = 'purchase')
        SELECT t.track_id, t.seg_idx, min(struct_pack(a := s.start_ms, b := s.end_ms)).a AS span_start, min(struct_pack(a := s.start_ms, b := s.end_ms)).b AS span_end
        FROM tl t LEFT JOIN s ON s.track_id = t.track_id AND t.start_ms BETWEEN s.start_ms AND s.end_ms GROUP BY 1, 2""",
    "hints": f"WITH {DUB} SELECT track_id, seg_idx, speaker FROM dub QUALIFY row_number() OVER (PARTITION BY track_id, speaker ORDER BY -length(text), seg_idx) <= 3",
    "log_page": "SELECT event_id FROM events WHERE contains(lower(event_type), 'purchase') OR contains(lower(props), 'purchase') ORDER BY ts DESC, event_id LIMIT 50 OFFSET 50",
    "shown_text": f"WITH {DUB}, t AS (SELECT track_id, seg_idx, replace(replace(text || ' 2.5 1.0.0. don’t (x)', '‘', chr(39)), '’', chr(39)) AS t FROM dub) SELECT track_id, seg_idx, md5(replace(regexp_replace({_SHOWN.format('t')}, '[。，！？；：、,!?;:　「」『』“”（）()【】\\[\\]\"…—–·《》〈〉.-]', '', 'g'), chr(1), '.')) AS md5 FROM t",
    "said_parts": f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(replace(replace(text, '.', '。'), '?', '？'), '[^。？！\\n]*[。？！\\n]|[^。？！\\n]+$'), lambda x: {_STRIP("x")}), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, CAST(len(l) AS BIGINT) AS parts, md5(array_to_string(l, '|')) AS md5 FROM p""",
    "small_values": """WITH c AS (SELECT *, upper(lpad(hex(CAST(n_nationkey AS BIGINT) * 600000), 6, '0')) AS x FROM nation), k AS (SELECT *, lpad(ltrim(x, ' '), 6, '0') AS y FROM c)
        SELECT n_nationkey, substr(md5(n_name), 1, 10) AS h, '&H00' || substr(y, 5, 2) || substr(y, 3, 2) || substr(y, 1, 2) AS ass, '#' || y AS web,
        CASE n_nationkey % 24 WHEN 0 THEN 'en' WHEN 1 THEN 'th' WHEN 2 THEN 'pt-PT' WHEN 3 THEN 'tl' WHEN 4 THEN 'es' WHEN 5 THEN 'zh-Hans' WHEN 6 THEN 'en' WHEN 7 THEN 'zh-Hans' WHEN 8 THEN 'en' WHEN 9 THEN 'th' WHEN 10 THEN 'pt-PT'
        WHEN 11 THEN 'zh-Hans' WHEN 12 THEN 'es' WHEN 13 THEN 'he' WHEN 14 THEN 'en-GB' WHEN 15 THEN 'zh-CN' WHEN 16 THEN 'en' WHEN 17 THEN 'zh-Hans' WHEN 18 THEN 'pt' WHEN 19 THEN 'fil' WHEN 20 THEN 'zh-Hans' WHEN 21 THEN 'he' WHEN 22 THEN 'en' ELSE 'zh-Hans' END AS code FROM k""",
    "filled_times": f"""WITH RECURSIVE {TIMELINE}, p AS (SELECT track_id, seg_idx, CASE WHEN event_id % 4 = 0 THEN start_ms END AS v FROM tl),
        q AS (SELECT *, coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY seg_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1800000000000) AS nx FROM p),
        f AS (SELECT track_id, seg_idx, coalesce(CAST(v AS DOUBLE), (0 + nx) / 2.0::DOUBLE) AS at_ms FROM q WHERE seg_idx = 1
        UNION ALL SELECT q.track_id, q.seg_idx, coalesce(CAST(q.v AS DOUBLE), (f.at_ms + q.nx) / 2.0::DOUBLE) FROM f JOIN q ON q.track_id = f.track_id AND q.seg_idx = f.seg_idx + 1) SELECT track_id, seg_idx, CAST(round(at_ms) AS BIGINT) AS at_ms FROM f""",
    "tiny_merges": f"""WITH {TIMELINE}, t AS (SELECT *, substr(speaker, 1, CAST(event_id % 4 AS INT)) AS t FROM tl), g AS (SELECT *, sum(CASE WHEN length(t) >= 2 OR seg_idx = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY seg_idx) AS g FROM t)
        SELECT track_id, min(seg_idx) AS seg_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(t, '' ORDER BY seg_idx) AS text FROM g GROUP BY track_id, g""",
    "fixed_overlaps": f"""WITH RECURSIVE {TIMELINE}, p AS (SELECT track_id, seg_idx, start_ms // 100000 AS s, start_ms // 100000 + event_id % 7 * 900 - 900 AS e, length(replace(speaker, '-', '')) AS n FROM tl),
        q AS (SELECT *, row_number() OVER w AS r, lead(s) OVER w AS nx FROM p WINDOW w AS (PARTITION BY track_id ORDER BY s, seg_idx)),
        f AS (SELECT track_id, seg_idx, r, s AS start_ms, CASE WHEN least(e, s + greatest(3000, 1000 + n * 250), coalesce(nx, 9e18::BIGINT)) > s THEN least(e, s + greatest(3000, 1000 + n * 250), coalesce(nx, 9e18::BIGINT)) ELSE s + greatest(1000, n * 150) END AS end_ms FROM q WHERE r = 1
        UNION ALL SELECT q.track_id, q.seg_idx, q.r, greatest(q.s, f.end_ms), CASE WHEN least(q.e, greatest(q.s, f.end_ms) + greatest(3000, 1000 + n * 250), coalesce(nx, 9e18::BIGINT)) > greatest(q.s, f.end_ms)
        THEN least(q.e, greatest(q.s, f.end_ms) + greatest(3000, 1000 + n * 250), coalesce(nx, 9e18::BIGINT)) ELSE greatest(q.s, f.end_ms) + greatest(1000, n * 150) END FROM f JOIN q ON q.track_id = f.track_id AND q.r = f.r + 1)
        SELECT track_id, seg_idx, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms FROM f""",
    "strategy_batches": f"WITH {TIMELINE} SELECT track_id, seg_idx, CAST(CASE WHEN count(*) OVER (PARTITION BY track_id) <= 60 THEN 0 ELSE (seg_idx - 1) // 20 END AS BIGINT) AS batch FROM tl",
    "unblocked_spans": f"""WITH {TIMELINE}, r AS (SELECT track_id, speaker IN ('view', 'click') AS own, start_ms AS s, least(end_ms, start_ms + 600000) AS e, seg_idx FROM tl WHERE end_ms > start_ms),
        a AS (SELECT *, max(e) OVER (PARTITION BY track_id ORDER BY s, e, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE own),
        n AS (SELECT *, CASE WHEN reach IS NULL OR s > reach AND EXISTS (SELECT 1 FROM r b WHERE NOT b.own AND b.track_id = a.track_id AND b.s < a.s AND b.e > a.reach) THEN 1 ELSE 0 END AS new FROM a),
        g AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY s, e, seg_idx) AS g FROM n) SELECT track_id, min(s) AS start_ms, max(e) AS end_ms FROM g GROUP BY track_id, g""",
}
