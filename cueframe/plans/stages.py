"""Queries over rate plans, chunk merging, sources and sinks, quality checks, stages and kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueframe.operators import aligner, chunkmerge, quality, rateplan, segmenter, signal, stages, timeline
from cueframe.sources import sinks, subtitles
from cueframe.sources.tables import DUB, TIMELINE, checkpointed, cut, dub_rows, load
from cueframe.sources.tables import timeline as tl


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = timeline.place_with_pause(dub_rows(spark, sf_dir), 400)
    slots = rows.select("track_id", F.col("seg_idx").alias("slot"), F.col("place_start").alias("start_ms"), F.col("place_end").alias("end_ms"), (F.col("audio_ms") * (1 + F.col("seg_idx") % 3)).alias("audio_ms"))
    locked = rows.where("seg_idx % 4 = 1").select("track_id", (F.col("place_start") + 100).alias("start_ms"), (F.col("place_start") + 600).alias("end_ms"))
    return rateplan.rate_plan(slots, slots.groupBy("track_id").agg((F.max("end_ms") + 5000).alias("video_ms")), 200, 2.0, locked)


def rate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plan's pieces: their number, the time they cover, and what is within the allowed factors."""
    items, _ = _plan(spark, sf_dir)
    return items.groupBy("track_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"), F.count_if((F.col("factor") < 0.5) | (F.col("factor") > 2)).alias("outside"), F.count_if(F.col("start_ms") >= F.col("end_ms")).alias("empty"))


def rate_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)[1]


def time_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = _plan(spark, sf_dir)
    points = dub_rows(spark, sf_dir).select("track_id", "seg_idx", F.col("start_ms").alias("at_ms"))
    return rateplan.map_times(points, items).select("track_id", "seg_idx", "at_ms", "out_ms")


def fitted_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dub_rows(spark, sf_dir).withColumn("audio_ms", F.col("audio_ms") * (1 + F.col("seg_idx") % 2))
    return quality.fit_speed(rows).select("track_id", "seg_idx", "fitted_ms")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chunks of each long conversation's words, 50 words overlapping."""
    rows = dub_rows(spark, sf_dir)
    words = timeline.word_rows(rows).select("track_id", F.struct("seg_idx", "word_idx").alias("o"), "word")
    n = F.row_number().over(Window.partitionBy("track_id").orderBy("o")) - 1
    words = words.withColumn("k", n).withColumn("start_ms", F.col("k") * 100).withColumn("end_ms", F.col("k") * 100 + 90)
    both = words.withColumn("chunk", F.explode(F.array_compact(F.array(F.when(F.col("k") < 300, 0), F.when(F.col("k") >= 250, 1)))))
    return both.select("track_id", "chunk", F.lit(0).cast("long").alias("offset_ms"), F.col("k").alias("seg_idx"), "start_ms", "end_ms", F.col("word").alias("text"))


def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpointed(spark)
    out = chunkmerge.merge_chunks(_chunks(spark, sf_dir), 5000)
    return out.groupBy("track_id").agg(F.count("*").alias("words"), F.max("end_ms").alias("end_ms"))


def srt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as SRT and parsed again."""
    rows = dub_rows(spark, sf_dir).where("trim(text) <> ''").withColumn("translated_text", F.lit(""))
    rows = timeline.clean(rows.withColumns({"track_id": F.col("track_id").cast("string"), "text": F.trim(F.regexp_replace("text", r"\s+", " "))}))
    back = subtitles.parse_srt(sinks.to_srt(rows))
    return back.select(F.col("track_id").cast("long").alias("track_id"), F.col("seg_idx").cast("long").alias("seg_idx"), "start_ms", "end_ms", F.md5("text").alias("md5"))


def ass_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dub_rows(spark, sf_dir).where("trim(text) <> ''")
    rows = rows.withColumns({"track_id": F.col("track_id").cast("string"), "text": F.trim(F.regexp_replace("text", r"[\s{}]+", " ")), "translated_text": F.col("speaker"), "end_ms": F.col("end_ms") + F.col("seg_idx") * 10})
    back = subtitles.parse_ass(sinks.to_ass(timeline.clean(rows)))
    return back.groupBy(F.col("track_id").cast("long").alias("track_id")).agg(F.count("*").alias("n"), F.sum("start_ms").alias("starts"), F.sum("end_ms").alias("ends"), F.count_if(F.col("translated_text").isin("user", "assistant", "system")).alias("translated"))


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dub_rows(spark, sf_dir).where("trim(text) <> ''").withColumns({"track_id": F.col("track_id").cast("string"), "translated_text": F.col("speaker")})
    back = subtitles.parse_json(sinks.to_json(timeline.clean(rows)))
    return back.select(F.col("track_id").cast("long").alias("track_id"), F.col("seg_idx").cast("long").alias("seg_idx"), "start_ms", "end_ms", F.md5("text").alias("md5"), "translated_text")


def speaker_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers written as a JSON list by track, and attached again by position."""
    rows = timeline.clean(dub_rows(spark, sf_dir).where("trim(text) <> ''"))
    back = subtitles.attach_speakers(rows.drop("speaker"), sinks.speaker_list(rows))
    return back.select("track_id", F.col("seg_idx").cast("long").alias("seg_idx"), "speaker")


def composite_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dub_rows(spark, sf_dir)
    out = sinks.composite(timeline.place_with_gap(rows.where("speaker = 'assistant'"), 100), rows.where("speaker = 'user'"))
    return out.select("track_id", F.col("seg_idx").cast("long").alias("seg_idx"), "start_ms", "end_ms", "side")


def batch_keys_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline.batches(tl(spark, sf_dir), 20)
    got = rows.where("event_id % 11 <> 0").select("track_id", "batch", "seg_idx").unionByName(rows.where("seg_idx = 1").select("track_id", "batch", F.lit(999_999).alias("seg_idx")))
    out = quality.key_check(rows, got)
    return out.select("track_id", "batch", F.size("missing").cast("long").alias("missing"), F.size("extra").cast("long").alias("extra"))


def cached_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage over batches, one of which fails; its good batches, cached, are not run again."""
    rows = dub_rows(spark, sf_dir).select("track_id", "seg_idx", "text")

    def shout(batch):
        if int(batch["track_id"].iloc[0]) % 10 == 3:
            raise RuntimeError("no answer")
        return batch["text"].str.len().astype(str)

    own = ("track_id",)  # whether it fails depends on the track, not on texts alone
    cache = cut(stages.cache_rows(cut(stages.run_stage(rows, shout, 20, by=own))))
    again = stages.run_stage(rows, lambda b: ["new"] * len(b), 20, cache, by=own)
    return again.groupBy("track_id").agg(F.count("*").alias("n"), F.count_if(F.col("reply") == "new").alias("fresh"))


def bad_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dub_rows(spark, sf_dir).withColumn("reply", F.when(F.col("seg_idx") % 5 == 0, F.concat(F.lit(" "), "text")).when(F.col("seg_idx") % 5 == 1, "[ERROR] x").otherwise(F.lit("übersetzt")))
    return rows.select("track_id", "seg_idx", quality.needs_retranslation(F.col("text"), F.col("reply")).alias("again"))


def rule_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations cut into words and put together again by pauses and connectives."""
    words = timeline.word_rows(dub_rows(spark, sf_dir)).select("track_id", (F.col("seg_idx") * 100_000 + F.col("word_idx")).alias("seg_idx"), F.col("word_start").alias("start_ms"), F.col("word_end").alias("end_ms"), F.col("word").alias("text"))
    return segmenter.segment_words(words)


def batch_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmenter.cut_points(tl(spark, sf_dir), 25, 5)


def aligned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of conversations aligned to the conversations' own rows."""
    rows = dub_rows(spark, sf_dir).where("trim(text) <> ''")
    texts = rows.groupBy("track_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return aligner.align_text(rows, aligner.sentences(texts))


def speech_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of loudness, and the islands above each track's threshold."""
    frames = tl(spark, sf_dir).select("track_id", F.col("seg_idx").alias("frame"), ((F.col("end_ms") - F.col("start_ms")) % 1000).cast("double").alias("rms"))
    return signal.speech(frames)


def pages_as_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text between the tags of pages as plain rows."""
    p = load(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<p>([^<]+)"), F.lit(1))).alias("text"))
    return p.groupBy("page_id").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))


QUERIES = {f.__name__: f for f in (rate_plan, rate_placements, time_map, fitted_speed, merged_chunks, srt_round_trip, ass_round_trip, json_round_trip, speaker_lists, composite_track, batch_keys_missing, cached_stage, bad_replies, rule_segments, batch_cuts, aligned_text, speech_islands, pages_as_captions)}

_BLANK = "trim(text, ' ') = ''"
SQL = {
    "rate_plan": f"""WITH {DUB}, p AS (SELECT track_id, sum(audio_ms + 400) - 400 + 5000 AS v, max(CASE WHEN seg_idx % 4 = 1 THEN 1 ELSE 0 END) FROM dub GROUP BY 1)
        SELECT track_id, CAST(greatest(v, e) AS BIGINT) AS covered_ms, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS empty FROM p JOIN (SELECT track_id, max(CASE WHEN seg_idx % 4 = 1 THEN s + 600 ELSE 0 END) AS e FROM
        (SELECT *, coalesce(sum(audio_ms + 400) OVER (PARTITION BY track_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM dub) GROUP BY 1) USING (track_id)""",
    "fitted_speed": f"""WITH {DUB}, r AS (SELECT track_id, seg_idx, audio_ms * (1 + seg_idx % 2) AS a, greatest(100, end_ms - start_ms) AS t FROM dub)
        SELECT track_id, seg_idx, CAST(round_even(a / CASE WHEN a > t THEN least(a / t, 1.5) ELSE 1.0::DOUBLE END, 0) AS BIGINT) AS fitted_ms FROM r""",
    "srt_round_trip": f"""WITH {DUB} SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, seg_idx) AS seg_idx, start_ms, end_ms, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')) AS md5 FROM dub WHERE NOT {_BLANK}""",
    "ass_round_trip": f"WITH {DUB} SELECT track_id, count(*) AS n, CAST(sum(start_ms // 10 * 10) AS BIGINT) AS starts, CAST(sum((end_ms + seg_idx * 10) // 10 * 10) AS BIGINT) AS ends, count(*) AS translated FROM dub WHERE NOT {_BLANK} GROUP BY 1",
    "json_round_trip": f"WITH {DUB} SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, seg_idx) AS seg_idx, start_ms, end_ms, md5(text) AS md5, speaker AS translated_text FROM dub WHERE NOT {_BLANK}",
    "speaker_lists": f"WITH {DUB} SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, seg_idx) AS seg_idx, speaker FROM dub WHERE NOT {_BLANK}",
    "composite_track": f"""WITH RECURSIVE {DUB}, o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seg_idx) AS rn FROM dub WHERE speaker = 'assistant'),
        p AS (SELECT track_id, seg_idx, rn, start_ms AS a, start_ms + audio_ms AS b FROM o WHERE rn = 1 UNION ALL
        SELECT o.track_id, o.seg_idx, o.rn, greatest(o.start_ms, p.b + 100), greatest(o.start_ms, p.b + 100) + o.audio_ms FROM p JOIN o ON o.track_id = p.track_id AND o.rn = p.rn + 1),
        u AS (SELECT track_id, a AS start_ms, greatest(a + 1, b) AS end_ms, 0 AS side, seg_idx AS q FROM p UNION ALL SELECT track_id, start_ms, end_ms, 1, seg_idx FROM dub WHERE speaker = 'user')
        SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, end_ms, side, q) AS seg_idx, start_ms, end_ms, side FROM u""",
    "batch_keys_missing": f"WITH {TIMELINE} SELECT track_id, CAST((seg_idx - 1) // 20 AS BIGINT) AS batch, count(*) FILTER (WHERE event_id % 11 = 0) AS missing, count(*) FILTER (WHERE seg_idx = 1) AS extra FROM tl GROUP BY 1, 2",
    "cached_stage": f"WITH {DUB} SELECT track_id, count(*) AS n, count(*) FILTER (WHERE track_id % 10 = 3) AS fresh FROM dub GROUP BY 1",
    "bad_replies": f"WITH {DUB} SELECT track_id, seg_idx, CASE WHEN seg_idx % 5 = 0 THEN {_BLANK} OR regexp_matches(text, '\\p{{L}}') WHEN seg_idx % 5 = 1 THEN true ELSE false END AS again FROM dub",
    "pages_as_captions": "WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '<p>([^<]+)', 1)) AS t FROM pages) SELECT page_id, count(*) AS rows, CAST(sum(length(t)) AS BIGINT) AS chars FROM p GROUP BY 1",
    "batch_cuts": f"""WITH {TIMELINE}, n AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n, lead(start_ms) OVER (PARTITION BY track_id ORDER BY seg_idx) - end_ms AS gap FROM tl),
        p AS (SELECT *, CAST(ceil(n / 25) AS BIGINT) AS parts FROM n), m AS (SELECT *, unnest(range(1, parts + 1)) AS i FROM p WHERE parts > 1), k AS (SELECT *, CAST(floor(i * n / parts) AS BIGINT) AS mark FROM m)
        SELECT track_id, mark, -(max(struct_pack(g := gap, l := -seg_idx)).l) AS cut_after, max(gap) AS gap_ms FROM k WHERE mark < n AND abs(mark - seg_idx) <= 5 GROUP BY 1, 2""",
    "speech_islands": f"""WITH {TIMELINE}, f AS (SELECT track_id, seg_idx AS frame, (end_ms - start_ms) % 1000 AS rms FROM tl),
        r AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n, row_number() OVER (PARTITION BY track_id ORDER BY rms, frame) AS k FROM f),
        t AS (SELECT track_id, greatest(3.0 * max(rms) FILTER (WHERE k = greatest(1, floor(n * 0.2))), 0.08 * max(rms)) AS th FROM r GROUP BY 1),
        s AS (SELECT f.track_id, frame * 20 AS a, (frame + 1) * 20 AS b FROM f JOIN t USING (track_id) WHERE rms >= th AND th > 0),
        g AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY track_id ORDER BY a) <= 80 THEN 0 ELSE 1 END AS c FROM s), i AS (SELECT *, sum(c) OVER (PARTITION BY track_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM g)
        SELECT track_id, min(a) AS start_ms, max(b) AS end_ms FROM i GROUP BY track_id, run HAVING max(b) - min(a) >= 80""",
    "merged_chunks": f"""WITH {DUB}, w AS (SELECT track_id, len(regexp_extract_all(text, '{segmenter.T.TOKEN.replace("'", "''")}')) AS c FROM dub)
        SELECT track_id, CAST(sum(c) AS BIGINT) AS words, CAST((sum(c) - 1) * 100 + 90 AS BIGINT) AS end_ms FROM w GROUP BY 1 HAVING sum(c) > 0""",
}
