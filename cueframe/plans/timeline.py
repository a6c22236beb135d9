"""Timeline, interval and narrator queries over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueframe.functions.text import TOKEN
from cueframe.operators import edits, gates, intervals, narrator, timeline
from cueframe.sources.tables import DUB, TIMELINE, dub_rows, load
from cueframe.sources.tables import timeline as tl


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dub_rows(spark, sf_dir)


def blank_filter(spark, sf_dir):
    rows = _texts(spark, sf_dir).withColumn("text", F.when(F.col("seg_idx") % 3 == 1, " \n").otherwise(F.col("text")))
    return timeline.clean(rows).select("track_id", "seg_idx", "start_ms", "speaker")


def smooth_boundaries(spark, sf_dir):
    return timeline.smooth(tl(spark, sf_dir)).select("track_id", "seg_idx", "start_ms", "end_ms")


def gap_islands(spark, sf_dir):
    rows = timeline.islands(tl(spark, sf_dir), 600_000)
    return rows.groupBy("track_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))


def gap_placement(spark, sf_dir):
    return timeline.place_with_gap(_texts(spark, sf_dir), 120).select("track_id", "seg_idx", "place_start", "place_end")


def fixed_pause(spark, sf_dir):
    return timeline.place_with_pause(_texts(spark, sf_dir), 300).select("track_id", "seg_idx", "place_start", "place_end")


def gap_fill(spark, sf_dir):
    return timeline.fill_gaps(_texts(spark, sf_dir)).select("track_id", "seg_idx", "end_ms")


def chunk_offsets(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("track_id", "seg_idx", F.col("audio_ms").alias("end_ms"))
    return timeline.chunk_offsets(rows, 2000).select("track_id", "seg_idx", "offset_ms")


def hop_chunks(spark, sf_dir):
    total = _texts(spark, sf_dir).groupBy("track_id").agg(F.sum("audio_ms").alias("total_ms"))
    return timeline.hop_chunks(total, 20_000, 1_000)


def long_row_split(spark, sf_dir):
    return timeline.split_long(_texts(spark, sf_dir).where("text <> ''"), 8).select("track_id", "seg_idx", "part", "start_ms", "end_ms")


def word_rows(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("track_id"), F.lit(1).cast("long").alias("seg_idx"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).cast("long").alias("start_ms"), F.lit(3_600_000).cast("long").alias("end_ms"))
    return timeline.word_rows(rows).groupBy("track_id").agg(F.count("*").alias("words"), F.sum("word_start").alias("starts"), F.sum("word_end").alias("ends"))


def batch_ids(spark, sf_dir):
    return timeline.batches(tl(spark, sf_dir), 20).groupBy("track_id", "batch").agg(F.count("*").alias("n"), F.min("seg_idx").alias("first"))


def speaker_runs(spark, sf_dir):
    rows = timeline.run_ids(tl(spark, sf_dir), "speaker")
    return rows.groupBy("track_id", "run", "speaker").agg(F.count("*").alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def merged_turns(spark, sf_dir):
    rows = _texts(spark, sf_dir).withColumn("pair", F.floor(F.col("seg_idx") / 2))
    return timeline.merge_groups(rows, "pair").select("track_id", "pair", "start_ms", "end_ms", F.md5("text").alias("md5"))


def rate_limit(spark, sf_dir):
    rows = timeline.recent_load(tl(spark, sf_dir))
    return rows.groupBy("track_id").agg(F.max("calls").alias("calls"), F.max("busy_ms").alias("busy_ms"), F.count_if((F.col("calls") > 3) | (F.col("busy_ms") > 360 * 60_000)).alias("refused"))


def deleted_rows(spark, sf_dir):
    rows = tl(spark, sf_dir)
    return timeline.delete_rows(rows, rows.where(F.col("event_id") % 5 == 0).select("track_id", "seg_idx")).select("track_id", "seg_idx", "event_id")


def _segments_and_turns(spark, sf_dir):
    rows = tl(spark, sf_dir)
    turns = rows.where("speaker <> 'view'").select("track_id", F.col("seg_idx").alias("d_idx"), F.col("start_ms").alias("d_start"), F.col("end_ms").alias("d_end"), F.col("speaker").alias("who"))
    return rows.where("speaker = 'view'").drop("speaker"), turns


def overlap_speaker(spark, sf_dir):
    segments, turns = _segments_and_turns(spark, sf_dir)
    return intervals.assign_speakers(segments, turns).select("track_id", "seg_idx", "speaker")


def speaker_remap(spark, sf_dir):
    rows = tl(spark, sf_dir)
    shifted = rows.select("track_id", "seg_idx", (F.col("start_ms") + 90_000).alias("start_ms"), (F.col("end_ms") + 400_000).alias("end_ms"))
    return intervals.remap_speakers(rows, shifted).select("track_id", "seg_idx", "speaker")


def locked_rows(spark, sf_dir):
    segments, turns = _segments_and_turns(spark, sf_dir)
    return intervals.overlaps_any(segments, turns.where("who = 'click'").drop("who")).select("track_id", "seg_idx", "locked")


def nearest_boundary(spark, sf_dir):
    segments, turns = _segments_and_turns(spark, sf_dir)
    points = segments.select("track_id", "seg_idx", F.col("end_ms").alias("at_ms"))
    return intervals.nearest(points, turns.select("track_id", F.col("d_start").alias("mark_ms")), 3_600_000, 7_200_000)


def as_of_start(spark, sf_dir):
    segments, turns = _segments_and_turns(spark, sf_dir)
    points, marks = segments.select("track_id", "seg_idx", F.col("start_ms").alias("at_ms")), turns.select("track_id", F.col("d_start").alias("mark_ms"))
    back = intervals.as_of(points, marks).withColumnRenamed("mark_ms", "before_ms")
    ahead = intervals.as_of(points, marks, forward=True, within_ms=86_400_000).select("track_id", "seg_idx", F.col("mark_ms").alias("after_ms"))
    return back.join(ahead, ["track_id", "seg_idx"])


def bridged(spark, sf_dir):
    return intervals.bridge(tl(spark, sf_dir).select("track_id", "start_ms", "end_ms"), 3_600_000)


def narrator_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tl(spark, sf_dir).withColumn("end_ms", F.when(F.col("speaker") == "view", F.col("end_ms") + (F.col("end_ms") - F.col("start_ms")) * (F.col("track_id") % 7)).otherwise(F.col("end_ms")))
    return narrator.pick(narrator.durations(rows))


def narrator_filter(spark, sf_dir):
    rows = _texts(spark, sf_dir)
    return narrator.filter_rows(rows).select("track_id", "seg_idx", "keep", "why")


def narrator_report(spark, sf_dir):
    return narrator.report(narrator.filter_rows(_texts(spark, sf_dir), strict=True)).select("track_id", "rows", "by_narrator", "by_lang", "unlabelled", "dropped", "need_review")


def profile_defaults(spark, sf_dir):
    """Profiles by speaker, with the default profile and then a fixed voice where one is missing."""
    profiles = load(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") == 0, "default").when(F.col("n_nationkey") == 1, "user").otherwise(F.col("n_name")).alias("speaker"), F.when(F.col("n_nationkey") != 1, F.col("n_name")).alias("voice"), F.col("n_regionkey").alias("style"))
    rows = edits.with_defaults(_texts(spark, sf_dir).select("track_id", "seg_idx", "speaker"), profiles, "speaker", {"voice": "alloy", "style": None})
    return rows.select("track_id", "seg_idx", "speaker", "voice", "style")


def restored_rows(spark, sf_dir):
    """Kept rows, and dropped rows that a review restores: anti and semi joins."""
    rows = tl(spark, sf_dir).select("track_id", "seg_idx", "speaker", "event_id")
    kept, dropped = rows.where("speaker in ('view', 'click')"), rows.where("speaker not in ('view', 'click')")
    restore = rows.where("event_id % 4 = 0").select("track_id", "seg_idx")
    return edits.restore(kept, dropped, restore).groupBy("speaker", "state").agg(F.count("*").alias("n"))


def failure_gates(spark, sf_dir):
    """Empty replies, and replies that say the text again in small letters, by track, and whether a gate of a half stops it."""
    reply = F.when(F.col("seg_idx") % 3 == 0, "").when(F.col("seg_idx") % 5 == 1, F.lower("text")).otherwise(F.concat(F.lit("> "), "text"))
    rows = _texts(spark, sf_dir).withColumn("reply", reply)
    return gates.gate(rows, gates.failed_reply(F.col("text"), F.col("reply")))


def reply_complaints(spark, sf_dir):
    """Replies to batches of ten rows, of which some lack keys, hold others, or hold objects without the field."""
    rows = timeline.batches(_texts(spark, sf_dir), 10).where("trim(text) <> ''")
    sent = F.map_from_entries(F.collect_list(F.struct(F.col("seg_idx").cast("string"), "text")))
    told = F.when(F.col("track_id") % 5 == 3, F.struct(F.lit(None).cast("string").alias("text"))).otherwise(F.struct("text"))
    key = F.when(F.col("track_id") % 5 == 2, F.concat(F.lit("x"), F.col("seg_idx").cast("string"))).otherwise(F.col("seg_idx").cast("string"))
    kept = (F.col("track_id") % 5 != 1) | (F.col("seg_idx") % 3 > 0)
    got = F.to_json(F.map_from_entries(F.array_compact(F.collect_list(F.when(kept, F.struct(key.alias("k"), told.alias("v")))))))
    out = rows.groupBy("track_id", "batch").agg(sent.alias("sent"), got.alias("reply")).withColumn("reply", F.when(F.col("track_id") % 5 == 4, "[]").otherwise(F.col("reply")))
    return gates.reply_errors(out, "text").select("track_id", "batch", "error")


def joined_replies(spark, sf_dir):
    """Replies by row number onto their rows; rows without one keep their text."""
    rows = _texts(spark, sf_dir).select("track_id", "seg_idx", "text")
    replies = rows.where("seg_idx % 2 = 0").select("track_id", "seg_idx", F.concat(F.lit("> "), "text").alias("reply"))
    return edits.with_replies(rows, replies).select("track_id", "seg_idx", F.md5("text").alias("md5"))


QUERIES = {f.__name__: f for f in (blank_filter, smooth_boundaries, gap_islands, gap_placement, fixed_pause, gap_fill, chunk_offsets, hop_chunks, long_row_split, word_rows, batch_ids, speaker_runs, merged_turns, rate_limit, deleted_rows, overlap_speaker, speaker_remap, locked_rows, nearest_boundary, as_of_start, bridged, narrator_pick, narrator_filter, narrator_report, profile_defaults, restored_rows, failure_gates, reply_complaints, joined_replies)}

_BEST = """best AS (SELECT track_id, seg_idx, max(end_ms - start_ms) AS len, count(*) AS n, min(struct_pack(less := -ms, first := first, who := who, ms := ms)) AS b FROM
  (SELECT s.track_id, s.seg_idx, s.start_ms, s.end_ms, t.speaker AS who, sum(least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms)) AS ms, min(struct_pack(a := t.start_ms, b := t.seg_idx)) AS first
   FROM seg s JOIN turn t ON s.track_id = t.track_id AND s.start_ms < t.end_ms AND t.start_ms < s.end_ms AND s.start_ms < s.end_ms AND t.start_ms < t.end_ms GROUP BY ALL) GROUP BY track_id, seg_idx)
SELECT s.track_id, s.seg_idx, CASE WHEN n >= 2 OR b.ms > 0.2 * len THEN b.who ELSE '' END AS speaker FROM seg s LEFT JOIN best USING (track_id, seg_idx)"""
_LANG = "CASE WHEN trim(text, E' \\t\\n\\r') = '' THEN 'empty' WHEN regexp_matches(text, '[a-zA-Z]') THEN 'en' ELSE 'other' END"
_FILTER = f"""{DUB}, g AS (SELECT *, {_LANG} AS lang, end_ms - start_ms AS ms FROM dub), d AS (SELECT track_id, speaker, sum(ms) AS ms FROM g WHERE ms > 0 GROUP BY ALL),
  nar AS (SELECT track_id, arg_max(speaker, struct_pack(a := ms, b := speaker)) AS narrator FROM d GROUP BY track_id),
  ml AS (SELECT track_id, speaker, 'en' AS lang FROM g WHERE lang = 'en' GROUP BY ALL)"""
SQL = {
    "word_rows": f"""WITH d AS (SELECT doc_id AS track_id, unnest(regexp_extract_all(coalesce(text, ''), '{TOKEN.replace("'", "''")}')) AS w, generate_subscripts(regexp_extract_all(coalesce(text, ''), '{TOKEN.replace("'", "''")}'), 1) AS i FROM documents WHERE doc_id IS NOT NULL),
        u AS (SELECT *, CAST(ceil(length(w) / 4) AS BIGINT) AS u FROM d), a AS (SELECT *, sum(u) OVER (PARTITION BY track_id ORDER BY i) - u AS ahead, 3600000 / sum(u) OVER (PARTITION BY track_id) AS per FROM u)
        SELECT track_id, count(*) AS words, CAST(sum(trunc(0 + ahead * per)) AS BIGINT) AS starts, CAST(sum(least(trunc(0 + (ahead + u) * per), 3600000)) AS BIGINT) AS ends FROM a GROUP BY 1""",
    "blank_filter": f"WITH {DUB} SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, seg_idx) AS seg_idx, start_ms, speaker FROM dub WHERE seg_idx % 3 <> 1 AND trim(text, E' \\t\\n\\r') <> ''",
    "smooth_boundaries": f"""WITH {TIMELINE}, n AS (SELECT *, lead(start_ms) OVER w AS ns, lag(end_ms) OVER w AS pe FROM tl WINDOW w AS (PARTITION BY track_id ORDER BY seg_idx))
        SELECT track_id, seg_idx, CASE WHEN start_ms - pe < 1000 THEN CAST(floor((pe + start_ms) / 2) + floor((start_ms - pe) / 4) AS BIGINT) ELSE start_ms END AS start_ms,
        CASE WHEN ns - end_ms < 1000 THEN CAST(floor((end_ms + ns) / 2) + floor((ns - end_ms) / 4) AS BIGINT) ELSE end_ms END AS end_ms FROM n""",
    "gap_islands": f"""WITH {TIMELINE}, f AS (SELECT *, coalesce(start_ms - lag(end_ms) OVER (PARTITION BY track_id ORDER BY seg_idx) > 600000, false) AS far FROM tl),
        i AS (SELECT *, CAST(sum(CAST(far AS INT)) OVER (PARTITION BY track_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM f)
        SELECT track_id, island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM i GROUP BY ALL""",
    "gap_placement": f"""WITH RECURSIVE {DUB}, o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seg_idx) AS rn FROM dub),
        p AS (SELECT track_id, seg_idx, rn, start_ms AS place_start, start_ms + audio_ms AS place_end FROM o WHERE rn = 1 UNION ALL
        SELECT o.track_id, o.seg_idx, o.rn, greatest(o.start_ms, p.place_end + 120), greatest(o.start_ms, p.place_end + 120) + o.audio_ms FROM p JOIN o ON o.track_id = p.track_id AND o.rn = p.rn + 1)
        SELECT track_id, seg_idx, place_start, place_end FROM p""",
    "fixed_pause": f"""WITH {DUB}, p AS (SELECT *, CAST(coalesce(sum(audio_ms + 300) OVER (PARTITION BY track_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place_start FROM dub)
        SELECT track_id, seg_idx, place_start, place_start + audio_ms AS place_end FROM p""",
    "gap_fill": rf"""WITH {DUB}, a AS (SELECT *, regexp_replace(regexp_replace(text, '([0-9])\.([0-9])', '\1@\2', 'g'), '([0-9])\.([0-9])', '\1@\2', 'g') AS t FROM dub),
        b AS (SELECT *, length(regexp_replace(t, '[。，！？；：、,.!?;: 　「」『』“”‘’（）()【】\[\]"…—–·《》〈〉-]', '', 'g')) AS c, lead(start_ms) OVER (PARTITION BY track_id ORDER BY seg_idx) AS ns FROM a),
        e AS (SELECT *, greatest(800, 300 + c * 60) AS lo, greatest(3000, 1000 + c * 250) AS hi FROM b)
        SELECT track_id, seg_idx, CASE WHEN ns IS NULL THEN least(greatest(start_ms + lo, end_ms), start_ms + hi) ELSE greatest(least(start_ms + hi, ns), least(start_ms + lo, ns), end_ms) END AS end_ms FROM e""",
    "chunk_offsets": f"WITH {DUB} SELECT track_id, seg_idx, CAST(coalesce(sum(greatest(0, audio_ms - 2000)) OVER (PARTITION BY track_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms FROM dub",
    "hop_chunks": f"""WITH {DUB}, t AS (SELECT track_id, CAST(sum(audio_ms) AS BIGINT) AS total FROM dub GROUP BY 1 HAVING sum(audio_ms) > 0),
        c AS (SELECT track_id, total, unnest(range(0, CAST(greatest(0, ceil((total - 20000) / 19000)) AS BIGINT) + 1)) AS chunk_idx FROM t)
        SELECT track_id, chunk_idx, chunk_idx * 19000 AS start_ms, least(chunk_idx * 19000 + 20000, total) AS end_ms FROM c""",
    "long_row_split": f"""WITH {DUB}, w AS (SELECT *, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS c FROM dub WHERE text <> ''),
        n AS (SELECT *, CAST(greatest(1, ceil(c / 8)) AS BIGINT) AS n FROM w), p AS (SELECT *, unnest(range(0, n)) AS part FROM n)
        SELECT track_id, seg_idx, part, start_ms + CAST(round_even((end_ms - start_ms) * part / n, 0) AS BIGINT) AS start_ms,
        CASE WHEN part = n - 1 THEN end_ms ELSE start_ms + CAST(round_even((end_ms - start_ms) * (part + 1) / n, 0) AS BIGINT) END AS end_ms FROM p""",
    "batch_ids": f"WITH {TIMELINE} SELECT track_id, CAST((seg_idx - 1) // 20 AS BIGINT) AS batch, count(*) AS n, min(seg_idx) AS first FROM tl GROUP BY ALL",
    "speaker_runs": f"""WITH {TIMELINE}, f AS (SELECT *, CASE WHEN speaker <> lag(speaker) OVER (PARTITION BY track_id ORDER BY seg_idx) THEN 1 ELSE 0 END AS c FROM tl),
        r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY track_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM f)
        SELECT track_id, run, speaker, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM r GROUP BY ALL""",
    "merged_turns": f"WITH {DUB} SELECT track_id, CAST(seg_idx // 2 AS BIGINT) AS pair, min(start_ms) AS start_ms, max(end_ms) AS end_ms, md5(string_agg(text, ' ' ORDER BY seg_idx, text)) AS md5 FROM dub GROUP BY 1, 2",
    "rate_limit": f"""WITH {TIMELINE}, r AS (SELECT track_id, count(*) OVER w AS calls, CAST(sum(end_ms - start_ms) OVER w AS BIGINT) AS busy_ms FROM tl WINDOW w AS (PARTITION BY track_id ORDER BY start_ms RANGE BETWEEN 43200000 PRECEDING AND CURRENT ROW))
        SELECT track_id, max(calls) AS calls, max(busy_ms) AS busy_ms, count(*) FILTER (WHERE calls > 3 OR busy_ms > 21600000) AS refused FROM r GROUP BY 1""",
    "deleted_rows": f"WITH {TIMELINE} SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY seg_idx) AS seg_idx, event_id FROM tl WHERE event_id % 5 <> 0",
    "overlap_speaker": f"WITH {TIMELINE}, seg AS (SELECT * FROM tl WHERE speaker = 'view'), turn AS (SELECT * FROM tl WHERE speaker <> 'view'), {_BEST}",
    "speaker_remap": f"WITH {TIMELINE}, seg AS (SELECT track_id, seg_idx, start_ms + 90000 AS start_ms, end_ms + 400000 AS end_ms FROM tl), turn AS (SELECT * FROM tl), {_BEST}",
    "locked_rows": f"WITH {TIMELINE} SELECT track_id, seg_idx, EXISTS (SELECT 1 FROM tl t WHERE t.speaker = 'click' AND t.track_id = s.track_id AND t.start_ms < s.end_ms AND s.start_ms < t.end_ms AND t.start_ms < t.end_ms AND s.start_ms < s.end_ms) AS locked FROM tl s WHERE speaker = 'view'",
    "nearest_boundary": f"""WITH {TIMELINE} SELECT s.track_id, s.seg_idx, s.end_ms AS at_ms, (SELECT min(struct_pack(far := abs(t.start_ms - s.end_ms), m := t.start_ms)) FROM tl t WHERE t.speaker <> 'view' AND t.track_id = s.track_id
        AND t.start_ms BETWEEN s.end_ms - 3600000 AND s.end_ms + 7200000).m AS mark_ms FROM tl s WHERE speaker = 'view'""",
    "as_of_start": f"""WITH {TIMELINE} SELECT s.track_id, s.seg_idx, s.start_ms AS at_ms, (SELECT max(t.start_ms) FROM tl t WHERE t.speaker <> 'view' AND t.track_id = s.track_id AND t.start_ms <= s.start_ms) AS before_ms,
        (SELECT min(t.start_ms) FROM tl t WHERE t.speaker <> 'view' AND t.track_id = s.track_id AND t.start_ms >= s.start_ms AND t.start_ms <= s.start_ms + 86400000) AS after_ms FROM tl s WHERE speaker = 'view'""",
    "bridged": f"""WITH {TIMELINE}, f AS (SELECT *, coalesce(start_ms - max(end_ms) OVER (PARTITION BY track_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 3600000, true) AS c FROM tl),
        r AS (SELECT *, sum(CAST(c AS INT)) OVER (PARTITION BY track_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS run FROM f)
        SELECT track_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS pieces FROM r GROUP BY track_id, run""",
    "narrator_pick": f"""WITH {TIMELINE}, d AS (SELECT track_id, speaker, sum(CASE WHEN speaker = 'view' THEN (end_ms - start_ms) * (1 + track_id % 7) ELSE end_ms - start_ms END) AS ms FROM tl WHERE end_ms > start_ms GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ms DESC, speaker DESC) AS k FROM d),
        a AS (SELECT track_id, CAST(sum(ms) AS BIGINT) AS total_ms, max(speaker) FILTER (WHERE k = 1) AS narrator, CAST(max(ms) FILTER (WHERE k = 1) AS BIGINT) AS narrator_ms, CAST(max(ms) FILTER (WHERE k = 2) AS BIGINT) AS second FROM r GROUP BY 1),
        c AS (SELECT *, coalesce((narrator_ms - second) / total_ms < 0.05, false) AS close FROM a)
        SELECT track_id, total_ms, narrator, narrator_ms, CASE WHEN close THEN 'longest_speaker_close_race' ELSE 'longest_speaker' END AS reason, narrator_ms / total_ms AS share, narrator_ms / total_ms < 0.45 OR close AS need_review FROM c""",
    "narrator_filter": f"""WITH {_FILTER}, x AS (SELECT g.*, CASE WHEN g.speaker = narrator THEN 'narrator' WHEN g.lang = 'en' AND ml.lang IS NOT NULL THEN 'same_language' ELSE 'other_speaker' END AS why
        FROM g LEFT JOIN nar USING (track_id) LEFT JOIN ml ON ml.track_id = g.track_id AND ml.speaker = narrator) SELECT track_id, seg_idx, why <> 'other_speaker' AS keep, why FROM x""",
    "narrator_report": f"""WITH {_FILTER} SELECT track_id, count(*) AS rows, count(*) FILTER (WHERE speaker = narrator) AS by_narrator, CAST(0 AS BIGINT) AS by_lang, CAST(0 AS BIGINT) AS unlabelled,
        count(*) FILTER (WHERE speaker IS DISTINCT FROM narrator) AS dropped, false AS need_review FROM g LEFT JOIN nar USING (track_id) GROUP BY 1""",
    "profile_defaults": f"""WITH {DUB}, p AS (SELECT CASE n_nationkey WHEN 0 THEN 'default' WHEN 1 THEN 'user' ELSE n_name END AS speaker, CASE WHEN n_nationkey <> 1 THEN n_name END AS voice, n_regionkey AS style FROM nation)
        SELECT track_id, seg_idx, dub.speaker, coalesce(p.voice, q.voice, 'alloy') AS voice, coalesce(p.style, q.style) AS style FROM dub LEFT JOIN p ON p.speaker = dub.speaker LEFT JOIN p q ON q.speaker = 'default'""",
    "restored_rows": f"WITH {TIMELINE} SELECT speaker, CASE WHEN speaker IN ('view', 'click') THEN 'kept' WHEN event_id % 4 = 0 THEN 'restored' ELSE 'dropped' END AS state, count(*) AS n FROM tl GROUP BY ALL",
    "reply_complaints": f"""WITH {DUB}, b AS (SELECT *, CAST(floor((seg_idx - 1) / 10) AS BIGINT) AS batch FROM dub),
        k AS (SELECT track_id, batch, list_sort(list(CAST(seg_idx AS VARCHAR))) AS own, list_sort(list(CAST(seg_idx AS VARCHAR)) FILTER (seg_idx % 3 = 0)) AS third FROM b WHERE trim(text, ' ') <> '' GROUP BY 1, 2)
        SELECT track_id, batch, CASE track_id % 5 WHEN 4 THEN 'the reply is not a JSON object' WHEN 1 THEN 'keys missing: ' || array_to_string(third, ', ') WHEN 2 THEN 'keys missing: ' || array_to_string(own, ', ')
        WHEN 3 THEN 'no text in ''text'' of: ' || array_to_string(own, ', ') END AS error FROM k""",
    "failure_gates": f"WITH {DUB}, r AS (SELECT track_id, count(*) FILTER (WHERE seg_idx % 3 = 0 OR seg_idx % 5 = 1) AS failed, count(*) AS n FROM dub GROUP BY 1) SELECT *, failed * 2 > n AS stop FROM r",
    "joined_replies": f"WITH {DUB} SELECT track_id, seg_idx, md5(CASE WHEN seg_idx % 2 = 0 THEN '> ' || text ELSE text END) AS md5 FROM dub",
}
