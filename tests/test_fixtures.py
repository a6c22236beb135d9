"""Expected values of small cases, stated as tables."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cueframe.functions import text as T
from cueframe.functions import timecode
from cueframe.operators import aligner, chunkmerge, intervals, narrator, quality, rateplan, segmenter, signal, stages, timeline
from cueframe.sources import sinks, subtitles
from cueframe.sources.tables import checkpointed


def segments(spark, rows, track=1):
    return spark.createDataFrame([(track, i + 1, *r) for i, r in enumerate(rows)], "track_id long, seg_idx long, start_ms long, end_ms long, text string")


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


@pytest.mark.parametrize(("text", "lang"), [("这是中文解说", "zh"), ("hello world", "en"), ("中文 with English", "en"), ("这是中文一些内容English中文", "zh"), ("", "empty"), (None, "empty"), ("12345", "other")])
def test_language(spark, text, lang):
    assert one(spark, T.detect_lang, text) == lang


@pytest.mark.parametrize(("line", "who", "text"), [("[Alice] Hello there", "Alice", "Hello there"), ("【小明】你好", "小明", "你好"), ("Bob: hi", "default", "Bob: hi"), ("12:30 now", "default", "12:30 now")])
def test_speaker_prefix(spark, line, who, text):
    df = spark.createDataFrame([(line,)], "l string")
    assert tuple(df.select(*T.speaker_prefix(F.col("l"))).first()) == (who, text)


@pytest.mark.parametrize(("text", "words"), [("你好世界", 4), ("hello big world", 3), ("hello 世界", 3), ("", 0), ("สวัสดี", 6)])
def test_word_count(spark, text, words):
    assert one(spark, T.count_words, text) == words


def test_text_predicates(spark):
    assert one(spark, T.is_pure_punctuation, "，。!?") and not one(spark, T.is_pure_punctuation, "你，")
    assert one(spark, T.is_mainly_cjk, "你好 ok") is False and one(spark, T.is_mainly_cjk, "你好吗 k") is True
    assert one(spark, T.is_space_separated, "don't") and not one(spark, T.is_space_separated, "né") and one(spark, T.is_space_separated, "привет")
    assert one(spark, T.remove_punctuation, "Pi is 3.14, ok. 1.0.0!") == "Piis3.14ok1.0.0"
    assert one(spark, T.normalize_speaker, " N/A ") is None and one(spark, T.normalize_speaker, " a ") == "a"
    assert one(spark, T.strip_trailing_stops, "好的，。") == "好的"


def test_times(spark):
    df = spark.createDataFrame([(3_723_045,)], "ms long")
    assert tuple(df.select(timecode.srt(F.col("ms")), timecode.ass(F.col("ms")), timecode.lrc(F.col("ms"))).first()) == ("01:02:03,045", "1:02:03.04", "62:03.04")
    for t, ms in (("01:02:03,045", 3_723_045), ("2:03.5", 123_500), ("x", None), ("", None)):
        assert one(spark, timecode.parse, t) == ms


@pytest.mark.parametrize(
    ("rows", "turns", "want"),
    [
        ([(0, 1000), (2000, 3000)], [(0, 1000, "a")], ["a", ""]),
        ([(100, 600)], [(0, 400, "a")], ["a"]),
        ([(0, 500)], [(1000, 2000, "a")], [""]),
        ([(0, 1000)], [(100, 250, "a")], [""]),
        ([(0, 1000)], [(0, 400, "a"), (300, 1000, "b")], ["b"]),
        ([(0, 1000)], [(0, 500, "a"), (500, 1000, "b")], ["a"]),
        ([(500, 500)], [(0, 1000, "a")], [""]),
    ],
)
@pytest.mark.parametrize("bucket", [100, 3_600_000])
def test_overlap_speaker(spark, rows, turns, want, bucket):
    t = spark.createDataFrame([(1, i, *x) for i, x in enumerate(turns)], "track_id long, d_idx long, d_start long, d_end long, who string")
    got = intervals.assign_speakers(segments(spark, [(*r, "x") for r in rows]), t, bucket).orderBy("seg_idx").collect()
    assert [x.speaker for x in got] == want


def test_remap_speakers(spark):
    src = segments(spark, [(0, 1000, "x"), (1000, 2000, "x"), (2000, 3000, "x")]).withColumn("speaker", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.col("seg_idx").cast("int")))
    got = intervals.remap_speakers(src, segments(spark, [(0, 400, "x"), (400, 1000, "x"), (2000, 3000, "x")])).orderBy("seg_idx")
    assert [x.speaker for x in got.collect()] == ["a", "a", "a"]


@pytest.mark.parametrize(("starts", "lengths", "gap", "want"), [([0, 1000], [2000, 2000], 0, [(0, 2000), (1000, 3000)]), ([0, 4000], [1000, 1000], 500, [(0, 1000), (4000, 5000)]), ([0, 1000], [2000, 2000], 500, [(0, 2000), (2500, 4500)]), ([0, 500, 900], [1000] * 3, 100, [(0, 1000), (1100, 2100), (2200, 3200)])])
def test_gap_placement(spark, starts, lengths, gap, want):
    rows = spark.createDataFrame([(1, i, s, n) for i, (s, n) in enumerate(zip(starts, lengths))], "track_id long, seg_idx long, start_ms long, audio_ms long")
    assert [(x.place_start, x.place_end) for x in timeline.place_with_gap(rows, gap).orderBy("seg_idx").collect()] == want


def test_gap_placement_is_the_sequential_rule(spark):
    r = random.Random(1)
    rows = [(t, i, r.randint(0, 9000), r.randint(0, 900)) for t in range(40) for i in range(r.randint(1, 12))]
    got = {(x.track_id, x.seg_idx): x.place_start for x in timeline.place_with_gap(spark.createDataFrame(rows, "track_id long, seg_idx long, start_ms long, audio_ms long"), 70).collect()}
    for t in range(40):
        end = None
        for _, i, s, n in sorted(x for x in rows if x[0] == t):
            s = s if end is None else max(s, end + 70)
            assert got[t, i] == s
            end = s + n


PLANS = [
    ([(1000, 2000), (4000, 5000)], [1000, 1000], 0, 6000, [], [(0, 1000, 1), (1000, 4000, 0.5), (4000, 6000, 0.5)], [(1000, 2000), (2500, 3500)], [1, 1], 3500),
    ([(0, 1000), (1000, 2000)], [2000, 1000], 0, 2000, [], [(0, 1000, 2), (1000, 2000, 1)], [(0, 2000), (2000, 3000)], [1, 1], 3000),
    ([(0, 1000)], [6000], 0, 1000, [], [(0, 1000, 2)], [(0, 2000)], [3], 2000),
    ([(0, 1000), (2000, 3000)], [1000, 1000], 500, 4000, [], [(0, 2000, 0.75), (2000, 4000, 0.75)], [(0, 1000), (1500, 2500)], [1, 1], 3000),
    ([(0, 1000), (3000, 4000)], [2000, 500], 0, 4000, [(1000, 3000)], [(0, 1000, 2), (1000, 3000, 1), (3000, 4000, 0.5)], [(0, 2000), (4000, 4500)], [1, 1], 4500),
]


@pytest.mark.parametrize(("slots", "audio", "gap", "video", "locked", "items", "places", "extra", "total"), PLANS)
def test_rate_plan(spark, slots, audio, gap, video, locked, items, places, extra, total):
    s = spark.createDataFrame([(1, i, a, b, n) for i, ((a, b), n) in enumerate(zip(slots, audio))], "track_id long, slot int, start_ms long, end_ms long, audio_ms long")
    keep = spark.createDataFrame([(1, *x) for x in locked], "track_id long, start_ms long, end_ms long")
    got, placed = rateplan.rate_plan(s, spark.createDataFrame([(1, video)], "track_id long, video_ms long"), gap, 2.0, keep)
    rows = got.orderBy("item").collect()
    assert [(x.start_ms, x.end_ms, x.factor) for x in rows] == items and rows[-1].out_end == total
    placed = placed.orderBy("slot").collect()
    assert [(x.place_start, x.place_end) for x in placed] == places and [x.extra_tempo for x in placed] == extra


def test_time_map_of_locked_interval(spark):
    slots, audio, gap, video, locked = PLANS[4][:5]
    s = spark.createDataFrame([(1, i, a, b, n) for i, ((a, b), n) in enumerate(zip(slots, audio))], "track_id long, slot int, start_ms long, end_ms long, audio_ms long")
    items, _ = rateplan.rate_plan(s, spark.createDataFrame([(1, video)], "track_id long, video_ms long"), gap, 2.0, spark.createDataFrame([(1, *x) for x in locked], "track_id long, start_ms long, end_ms long"))
    got = rateplan.map_times(spark.createDataFrame([(1, t) for t in (1000, 3000, 4000, 5000)], "track_id long, at_ms long"), items)
    assert {x.at_ms: x.out_ms for x in got.collect()} == {1000: 2000, 3000: 4000, 4000: 4500, 5000: 5500}


@pytest.mark.parametrize(
    ("sums", "who", "review", "reason"),
    [
        ({"a": 3000}, "a", False, "longest_speaker"),
        ({"a": 3000, "b": 1000}, "a", False, "longest_speaker"),
        ({"a": 300, "b": 240, "c": 180}, "a", True, "longest_speaker"),
        ({"a": 1000, "b": 980}, "a", True, "longest_speaker_close_race"),
        ({"a": 500, "b": 500}, "b", True, "longest_speaker_close_race"),
    ],
)
def test_narrator(spark, sums, who, review, reason):
    x = narrator.pick(spark.createDataFrame([(1, k, v) for k, v in sums.items()], "track_id long, speaker string, duration_ms long")).first()
    assert (x.narrator, x.need_review, x.reason) == (who, review, reason)


def test_preferred_narrator(spark):
    sums = spark.createDataFrame([(1, "a", 900), (1, "b", 100)], "track_id long, speaker string, duration_ms long")
    assert tuple(narrator.pick(sums, preferred="b").select("narrator", "reason").first()) == ("b", "preferred_speaker")
    assert tuple(narrator.pick(sums, preferred="z").select("narrator", "reason", "need_review").first()) == ("a", "preferred_missing_fallback_longest", True)


def test_narrator_filter(spark):
    rows = segments(spark, [(0, 2000, "hello there"), (2000, 3000, "more words"), (3000, 3500, "x")]).withColumn("speaker", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("none")), F.col("seg_idx").cast("int")))
    assert [x.why for x in narrator.filter_rows(rows).orderBy("seg_idx").collect()] == ["narrator", "same_language", "unlabelled"]
    assert [x.keep for x in narrator.filter_rows(rows).orderBy("seg_idx").collect()] == [True, True, False]  # unlabelled rows only on demand
    strict = narrator.filter_rows(rows, strict=True, keep_unlabelled=True)
    assert [x.keep for x in strict.orderBy("seg_idx").collect()] == [True, False, True]
    assert narrator.report(strict).first().dropped_rows == [2]


def test_islands_and_smoothing(spark):
    rows = segments(spark, [(0, 100, "a"), (1600, 1700, "b"), (3800, 3900, "c")])
    assert [x.island for x in timeline.islands(rows).orderBy("seg_idx").collect()] == [0, 0, 1]
    got = timeline.smooth(segments(spark, [(0, 1000, "a"), (1400, 2000, "b"), (5000, 6000, "c")])).orderBy("seg_idx").collect()
    assert [(x.start_ms, x.end_ms) for x in got] == [(0, 1300), (1300, 2000), (5000, 6000)]


def test_long_row_split(spark):
    got = timeline.split_long(segments(spark, [(1000, 5000, " ".join(f"w{i}" for i in range(16)))]), 8).orderBy("part").collect()
    assert [(x.start_ms, x.end_ms) for x in got] == [(1000, 3000), (3000, 5000)] and got[1].text.split()[0] == "w8"


def test_word_rows(spark):
    got = timeline.word_rows(segments(spark, [(0, 1000, "hello 世界 wonderful")])).orderBy("word_idx").collect()
    assert [x.word for x in got] == ["hello", "世", "界", "wonderful"]
    assert [(x.word_start, x.word_end) for x in got] == [(0, 285), (285, 428), (428, 571), (571, 1000)]


def test_nearest_and_as_of(spark):
    points = spark.createDataFrame([(1, 1, 100), (1, 2, 500)], "track_id long, seg_idx long, at_ms long")
    marks = spark.createDataFrame([(1, 80), (1, 120), (1, 460)], "track_id long, mark_ms long")
    assert [x.mark_ms for x in intervals.nearest(points, marks, 30, 20).orderBy("seg_idx").collect()] == [80, None]
    assert [x.mark_ms for x in intervals.as_of(points, marks).orderBy("seg_idx").collect()] == [80, 460]
    assert [x.mark_ms for x in intervals.as_of(points, marks, forward=True).orderBy("seg_idx").collect()] == [120, None]


def test_chunk_merge(spark):
    checkpointed(spark)
    words = "a b c d e f g h i j".split()
    rows = [(1, 0, 0, k, k * 1000, k * 1000 + 900, w) for k, w in enumerate(words[:7])] + [(1, 1, 4000, k, k * 1000, k * 1000 + 900, w) for k, w in enumerate(words[4:])]
    df = spark.createDataFrame(rows, "track_id long, chunk int, offset_ms long, seg_idx long, start_ms long, end_ms long, text string")
    got = chunkmerge.merge_chunks(df, 3000).orderBy("seg_idx").collect()
    assert [x.text for x in got] == words and [x.start_ms for x in got] == [k * 1000 for k in range(10)]
    other = df.withColumn("text", F.when(F.col("chunk") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    assert len({x.start_ms for x in chunkmerge.merge_chunks(other, 3000).collect()}) == 10  # no text in common: cut by time


def test_segment_rules():
    assert segmenter.by_gaps([0, 200, 5000], [100, 300, 5100], 1500) == [0, 2] and segmenter.by_gaps([], [], 1500) == []
    assert segmenter.by_connectives("we went home because it was late and dark".split(), 5) == [0, 3, 7]
    cuts = segmenter.by_longest_pause([0, 100, 200, 900, 1000, 1100], [90, 190, 290, 990, 1090, 1190], 4)
    assert cuts == [0, 3]


def test_segment_words(spark):
    words = segments(spark, [(i * 300 + (5000 if i >= 6 else 0), i * 300 + 250 + (5000 if i >= 6 else 0), w) for i, w in enumerate("one two three four five six seven eight , nine".split())])
    got = segmenter.segment_words(words).orderBy("seg_idx").collect()
    assert [x.text for x in got] == ["one two three four five six", "seven eight nine"]


def test_warping_path():
    codes = lambda s: np.array([ord(c) for c in s])
    first, cost = aligner.path(codes("abcd"), codes("abcd"))
    assert first.tolist() == [0, 1, 2, 3] and cost == 0
    first, cost = aligner.path(codes("acd"), codes("abcd"))
    assert first[0] == 0 and first[-1] == 3 and cost < 0.5
    r = random.Random(4)
    for _ in range(30):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in range(2))
        d = [[1e9] * (len(b) + 1) for _ in range(len(a) + 1)]
        d[0][0] = 0.0
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                c = float(x != y)
                d[i + 1][j + 1] = min(d[i][j] + (2 * c if i or j else 2 * c), d[i][j + 1] + c, d[i + 1][j] + c)
        assert aligner.path(codes(a), codes(b))[0].tolist() == sorted(aligner.path(codes(a), codes(b))[0].tolist())


def test_align_text(spark):
    rec = segments(spark, [(0, 1000, "hello world"), (1000, 2000, "good bye now")])
    own = spark.createDataFrame([(1, 1, "Hello, world!"), (1, 2, "Good bye."), (1, 3, "Now")], "track_id long, seg_idx long, text string")
    got = aligner.align_text(rec, own).orderBy("seg_idx").collect()
    assert [x.text for x in got] == ["Hello, world!", "Good bye.", "Now"] and got[0].match_rate == 1
    assert got[0].start_ms == 0 and got[0].end_ms == 1000 and got[1].start_ms == 1000 and got[2].end_ms == 2000
    assert all(a.end_ms <= b.start_ms for a, b in zip(got, got[1:]))


def test_speech_and_snapping(spark):
    loud = lambda ms: 200 <= ms < 700 or 1000 <= ms < 1400
    frames = spark.createDataFrame([(1, i, 12000.0 if loud(i * 20) else 10.0) for i in range(100)], "track_id long, frame long, rms double")
    islands = signal.speech(frames)
    assert [(x.start_ms, x.end_ms) for x in islands.orderBy("start_ms").collect()] == [(200, 700), (1000, 1400)]
    got = signal.snap(segments(spark, [(120, 780, "a"), (930, 1480, "b")]), islands).orderBy("seg_idx").collect()
    assert [(x.start_ms, x.end_ms) for x in got] == [(200, 1000), (1000, 1400)]


def test_pcm_frames(spark):
    data = np.array([1000] * 20 + [0] * 20, "<i2").tobytes()
    df = spark.createDataFrame([(data, 1000, 20)], "content binary, rate int, frame_ms int")
    assert df.select(signal.pcm_frames("content", "rate", "frame_ms")).first()[0] == [1000.0, 0.0]


def test_subtitle_formats(spark):
    content = lambda t: spark.createDataFrame([("f", t)], "track_id string, content string")
    srt = "1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nworld\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n\r\n\r\n3\r\n00:01:00,020 --> 00:01:01,000\r\nBye\r\n"
    rows = subtitles.parse_srt(content(srt))
    assert [tuple(x)[1:5] for x in rows.orderBy("seg_idx").collect()] == [(1, 1000, 2500, "Hello\nworld"), (2, 60020, 61000, "Bye")]
    for form, parse in ((sinks.to_srt, subtitles.parse_srt), (sinks.to_json, subtitles.parse_json)):
        assert sorted(parse(form(rows)).collect()) == sorted(rows.collect())
    two = rows.withColumn("translated_text", F.lit("x"))
    assert [(x.text, x.translated_text) for x in subtitles.parse_ass(sinks.to_ass(two)).orderBy("seg_idx").collect()] == [("Hello\nworld", "x"), ("Bye", "x")]
    both = "\n\n".join(f"{i}\n00:00:0{i},000 --> 00:00:0{i},500\nline {i}\nZeile {i}" for i in range(1, 4))
    assert [x.translated_text for x in subtitles.parse_srt(content(both), F.lit(True)).collect()] == ["Zeile 1", "Zeile 2", "Zeile 3"]
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.000 align:start\n<b>Hi</b> you\n\nNOTE x\n\nname\n00:00:03.000 --> 00:00:04.000\nthere"
    assert [x.text for x in subtitles.parse_vtt(content(vtt)).orderBy("seg_idx").collect()] == ["Hi you", "there"]
    words = "WEBVTT\n\n00:00:01.000 --> 00:00:03.000\nhello<00:00:01.500><c> big</c><00:00:02.000><c> world</c>"
    assert [(x.start_ms, x.end_ms, x.text) for x in subtitles.parse_word_vtt(content(words)).orderBy("seg_idx").collect()] == [(1000, 1500, "hello"), (1500, 2000, "big"), (2000, 3000, "world")]
    assert subtitles.scene_cuts(content("n:0 pts_time:1.5 x\npts_time:0.25\npts_time:1.5")).first().cuts == [0.25, 1.5]
    reply = '<think>no [1]</think>```json\n[{"a": 1}]\n```'
    assert one(spark, subtitles.decode_reply, reply) == '[{"a": 1}]'


def test_read_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nEins\n")
    (tmp_path / "b.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\n你好\n".encode("gb18030"))
    (tmp_path / "c.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nDrei")
    (tmp_path / "d.json").write_text('{"2": {"start_time": 5, "end_time": 6, "original_subtitle": "b", "translated_subtitle": ""}, "10": {"start_time": 5, "end_time": 7, "original_subtitle": "c"}}')
    got = subtitles.read_subtitles(spark, str(tmp_path)).orderBy("track_id", "seg_idx").collect()
    assert [x.text for x in got] == ["Eins", "你好", "Drei", "b", "c"]


def test_quality(spark):
    rows = spark.createDataFrame([("hello", ""), ("hello", "HELLO"), ("hello", "hallo"), ("123", "123"), ("a", "[ERROR] x")], "s string, t string")
    assert [x[0] for x in rows.select(quality.needs_retranslation(F.col("s"), F.col("t"))).collect()] == [True, True, False, False, True]
    pair = spark.createDataFrame([("abcd", "bcde"), ("tide", "diet"), ("diet", "tide")], "a string, b string")
    assert [x[0] for x in pair.select(quality.similarity("a", "b")).collect()] == [0.75, 0.25, 0.5]


def test_stage_cache_and_failures(spark):
    rows = segments(spark, [(i, i + 1, f"t{i}") for i in range(45)])

    def stage(batch: pd.DataFrame):
        if batch["batch"].iloc[0] == 1:
            raise ValueError("down")
        return batch["text"].str.upper()

    done = stages.run_stage(rows, stage, 20)
    assert done.where("error is not null").count() == 20 and done.where("reply = 'T3'").count() == 1
    again = stages.run_stage(rows, lambda b: ["new"] * len(b), 20, stages.cache_rows(done))
    assert again.where("reply = 'new'").count() == 20 and again.count() == 45


def test_streams(spark, tmp_path):
    from cueframe import streaming

    rows = spark.sql("select 1L track_id, timestamp'2024-01-01 00:00:00' ts, 1000L dur_ms union all select 1L, timestamp'2024-01-01 00:05:00', 1000L union all select 1L, timestamp'2024-01-01 02:00:00', 1000L")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.live_islands(stream).writeStream.outputMode("append").format("memory").queryName("islands").start()
    q.processAllAvailable()
    q.stop()
    assert [x.n for x in spark.sql("select n from islands").collect()] == [2]
    assert streaming.live_load(rows).count() > 0


def test_sql_functions(spark):
    T.register(spark)
    assert tuple(spark.sql("select srt_time(3723045), cue_words('hello 世界')").first()) == ("01:02:03,045", 3)
