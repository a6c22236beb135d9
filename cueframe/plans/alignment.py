"""Queries over alignment, snapping and the cutting of texts, with SQL that states each result from its rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueframe.functions import text as T
from cueframe.operators import aligner, signal, snapping
from cueframe.sources.tables import DUB, TIMELINE, cut, dub_rows
from cueframe.sources.tables import timeline as tl


def aligned_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations aligned to themselves, whole chain up to times: of each row the time of its first and of its middle
    character, and the end of its last one."""
    rows = dub_rows(spark, sf_dir)
    heard = aligner.placed(rows.select("track_id", "seg_idx", "start_ms", "end_ms", "text"))
    own = aligner.placed(rows.select("track_id", "seg_idx", "text"))
    chars = aligner.char_times(heard, own, aligner.warped(heard, own))
    middle = F.max(F.when(F.col("pos") == F.floor(F.col("n") / 2), F.col("at_ms")))
    return chars.groupBy("track_id", "seg_idx").agg(F.count("*").alias("chars"), F.round(F.min_by("at_ms", "pos")).cast("long").alias("first_ms"), F.round(middle, 3).alias("middle_ms"), F.max_by("word_end", "pos").alias("last_end_ms"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: how long one lasted as loudness, its number as flatness and strength."""
    length = (F.col("end_ms") - F.col("start_ms")) % 1000
    return tl(spark, sf_dir).select("track_id", F.col("seg_idx").alias("frame"), length.cast("double").alias("rms"), (F.col("event_id") % 10 / 10).alias("flatness"), (F.col("event_id") % 97).cast("double").alias("strength"))


def snapped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a row that starts, or ends, at each event would be snapped to."""
    frames = _frames(spark, sf_dir)
    islands = cut(signal.speech(frames))
    points = tl(spark, sf_dir).select("track_id", "seg_idx", (F.col("seg_idx") * 20 + F.col("event_id") % 13).alias("at_ms"))
    starts = snapping.snap_starts(points, islands, frames).select("track_id", "seg_idx", F.col("snapped_ms").alias("start_ms"))
    ends = snapping.snap_ends(points, islands, frames).select("track_id", "seg_idx", F.col("snapped_ms").alias("end_ms"))
    return starts.join(ends, ["track_id", "seg_idx"])


def snapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of 200 to 499 ms, whole chain."""
    start = F.col("seg_idx") * 20 + F.col("event_id") % 13
    rows = tl(spark, sf_dir).where("seg_idx % 4 = 0").select("track_id", "seg_idx", start.alias("start_ms"), (start + 40 + F.col("event_id") % 60).alias("end_ms"), F.col("speaker").alias("text"))
    return snapping.snap_rows(rows, _frames(spark, sf_dir))


def packed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.pack_words(F.col("text"), 50)
    return dub_rows(spark, sf_dir).select("track_id", "seg_idx", F.size(lines).cast("long").alias("lines"), F.md5(F.array_join(lines, "\n")).alias("md5"))


def subtitle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lines of at most 42 characters."""
    lines = dub_rows(spark, sf_dir).select("track_id", "seg_idx", F.posexplode(T.pack_sentences(F.col("text"), F.lit(42))).alias("line", "text"))
    return lines.select("track_id", "seg_idx", F.col("line").cast("long").alias("line"), "text")


QUERIES = {f.__name__: f for f in (aligned_chars, snapped_points, snapped_rows, packed_words, subtitle_lines)}

_DOTS = "regexp_replace(regexp_replace({0}, '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g')"
_BARE = f"""regexp_replace({_DOTS.format("text")}, '[。，！？；：、,!?;:\\s　「」『』“”‘’（）()【】\\[\\]"…—–·《》〈〉.-]', '', 'g')"""
SQL = {
    "aligned_chars": f"""WITH {DUB}, c AS (SELECT *, length({_BARE}) AS n FROM dub)
        SELECT track_id, seg_idx, n AS chars, CASE WHEN n = 1 THEN end_ms ELSE start_ms END AS first_ms, CASE WHEN n // 2 >= n - 1 THEN CAST(end_ms AS DOUBLE) ELSE round(start_ms + (n // 2) / n * (end_ms - start_ms), 3) END AS middle_ms,
        end_ms AS last_end_ms FROM c WHERE n > 0""",
    "snapped_points": f"""WITH {TIMELINE}, f AS (SELECT track_id, seg_idx AS frame, (end_ms - start_ms) % 1000 AS rms, CAST(event_id % 10 AS DOUBLE) / 10 AS flat, CAST(event_id % 97 AS DOUBLE) AS st FROM tl),
        r AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n, row_number() OVER (PARTITION BY track_id ORDER BY rms, frame) AS k FROM f),
        t AS (SELECT track_id, greatest(3.0 * max(rms) FILTER (WHERE k = greatest(1, floor(n * 0.2))), 0.08 * max(rms)) AS th FROM r GROUP BY 1),
        s AS (SELECT f.track_id, frame * 20 AS a, (frame + 1) * 20 AS b FROM f JOIN t USING (track_id) WHERE rms >= th AND th > 0),
        g AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY track_id ORDER BY a) <= 80 THEN 0 ELSE 1 END AS c FROM s), i AS (SELECT *, sum(c) OVER (PARTITION BY track_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM g),
        isl AS (SELECT track_id, min(a) AS a, max(b) AS b FROM i GROUP BY track_id, run HAVING max(b) - min(a) >= 80),
        x AS MATERIALIZED (SELECT isl.*, b - a AS len, coalesce(flat < 0.5, true) AS tonal FROM isl LEFT JOIN f ON f.track_id = isl.track_id AND frame = a // 20),
        p AS (SELECT track_id, seg_idx, seg_idx * 20 + event_id % 13 AS ms FROM tl),
        h AS MATERIALIZED (SELECT p.*, x.a, x.b, x.len FROM p LEFT JOIN x ON x.track_id = p.track_id AND x.a <= ms AND x.b >= ms),
        m AS (SELECT x.track_id, x.a, list_sort(list(st)) AS s FROM x JOIN f ON f.track_id = x.track_id AND frame BETWEEN x.a // 20 AND x.b // 20 - 1 WHERE len >= 100 GROUP BY 1, 2),
        fwd AS (SELECT h.track_id, h.seg_idx, min(frame) * 20 AS v FROM h JOIN m ON m.track_id = h.track_id AND m.a = h.a JOIN f ON f.track_id = h.track_id AND frame BETWEEN ms // 20 AND h.b // 20 - 1
          WHERE len(s) > 1 AND s[len(s) // 2 + 1] > 0 AND st >= 1.5 * s[len(s) // 2 + 1] GROUP BY 1, 2),
        nx AS (SELECT h.track_id, h.seg_idx, h.ms, min(x.a) AS na FROM h JOIN x ON x.track_id = h.track_id AND x.a >= h.ms AND (x.len >= 100 OR x.tonal) WHERE h.a IS NULL GROUP BY ALL),
        pv AS (SELECT h.track_id, h.seg_idx, max(x.b) AS pb FROM h JOIN x ON x.track_id = h.track_id AND x.a <= h.ms AND x.len >= 100 WHERE h.a IS NULL GROUP BY ALL),
        mv AS (SELECT nx.* FROM nx JOIN x ON x.track_id = nx.track_id AND x.a = na LEFT JOIN pv ON pv.track_id = nx.track_id AND pv.seg_idx = nx.seg_idx
          WHERE (na - ms <= 300 OR pb <= ms AND ms - pb <= 400 AND na - ms <= 1500) AND na - ms >= 40 AND (x.len >= 200 OR x.tonal)),
        pre AS (SELECT mv.track_id, mv.seg_idx, ms, na, list_sort(list(st) FILTER (frame < na // 20)) AS s, max(st) FILTER (frame = na // 20) AS own FROM mv JOIN f ON f.track_id = mv.track_id AND frame BETWEEN greatest(ms // 20, (na - 200) // 20) AND na // 20 GROUP BY ALL),
        lim AS (SELECT *, greatest(3 * s[len(s) // 2 + 1], 0.4 * greatest(list_max(s), own)) AS lim FROM pre WHERE own IS NOT NULL AND len(s) > 0),
        bk AS (SELECT lim.track_id, lim.seg_idx, max(frame) * 20 AS v FROM lim JOIN f ON f.track_id = lim.track_id AND frame >= greatest(ms // 20, (na - 200) // 20) AND frame < na // 20 WHERE st >= lim AND lim > 0 AND flat < 0.5 GROUP BY 1, 2),
        tot AS (SELECT track_id, (max(frame) + 1) * 20 AS total FROM f GROUP BY 1),
        e AS (SELECT p.track_id, p.seg_idx, min(struct_pack(d := abs(b - ms), b := b)).b AS b FROM p JOIN isl ON isl.track_id = p.track_id AND b BETWEEN ms - 350 AND ms + 120 GROUP BY 1, 2)
        SELECT h.track_id, h.seg_idx, CASE WHEN h.len >= 100 THEN coalesce(fwd.v, h.ms) WHEN mv.na IS NOT NULL THEN coalesce(bk.v, mv.na) ELSE h.ms END AS start_ms, coalesce(least(e.b + 40, total), h.ms) AS end_ms
        FROM h LEFT JOIN fwd USING (track_id, seg_idx) LEFT JOIN mv USING (track_id, seg_idx) LEFT JOIN bk USING (track_id, seg_idx) LEFT JOIN e USING (track_id, seg_idx) JOIN tot USING (track_id)""",
    "packed_words": f"""WITH {DUB}, w AS (SELECT track_id, seg_idx, list_filter(string_split_regex(text, '[\\s\\x{{85}}\\x{{A0}}]+'), lambda x: x <> '') AS w FROM dub),
        l AS (SELECT track_id, seg_idx, CASE WHEN len(w) = 0 THEN '' ELSE list_reduce(w, lambda acc, x: acc || CASE WHEN length(split_part(acc, chr(10), -1)) + 1 + length(x) <= 50 THEN ' ' ELSE chr(10) END || x) END AS t FROM w)
        SELECT track_id, seg_idx, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS lines, md5(t) AS md5 FROM l""",
}
