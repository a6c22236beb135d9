"""Rows to dub, edits, repairs, stages and streams on small tables, by hand."""

import difflib
import random
import wave

import pandas as pd
from pyspark.sql import functions as F

from cueframe import streaming
from cueframe.functions import text as T
from cueframe.operators import catalog, dubbing, edits, polish, segmenter, signal, stages
from cueframe.sources import subtitles


def values(spark, rows, fields):
    return spark.createDataFrame(rows, fields)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text_functions(spark):
    df = values(spark, [("don’t, stop!",), ("‘hola’ 2.5",), ("中文",), ("中文字",), ("two words",), ("word",), ("",)], "t string")
    assert [x[0] for x in df.select(T.strip_subtitle_punctuation(F.col("t"))).collect()][:2] == ["don't stop", "hola 2.5"]
    assert [x[0] for x in df.select(T.is_word_level(F.col("t"))).collect()] == [False, False, True, False, False, True, False]
    assert one(spark, T.pack_words(F.lit("aa bb cccccc d e"), 5))[0] == ["aa bb", "cccccc", "d e"]
    assert one(spark, T.utterances(F.lit("一。二？\n三")))[0] == ["一。", "二？", "三"]
    assert one(spark, T.distinct_in_order(F.lit("b, a,,b ,c")))[0] == ["b", "a", "c"]
    assert one(spark, T.ass_colour(F.lit("#1122aa")), T.ass_colour(F.lit("#1122AA80")), T.web_colour(F.lit("&H00AA2211")), T.ass_colour(F.lit("red")))[:] == ("&H00AA2211", "&H7FAA2211", "#1122AA", None)
    assert one(spark, T.unescape(F.lit("a &amp; &#39;b&#39;")), T.translation_input(F.lit("x" * 9), 4))[:] == ("a & 'b'", "xxxx")
    costs = [("a", "A"), ("v", "f"), ("a", "b"), ("师", "世"), ("师", "是"), ("师", "书")]
    sounds = {"师": "shi1", "世": "shi4", "是": "shi4", "书": "shu1"}
    assert [one(spark, T.char_cost(F.lit(a), F.lit(b), sounds))[0] for a, b in costs] == [0.0, 0.6, 1.0, 0.4, 0.4, 0.7]
    assert one(spark, catalog.language_code(F.lit("hebrew"), F.lit("deeplx")), catalog.language_code(F.lit("thai"), F.lit("google")))[:] == ("zh-Hans", "th")


def test_sentence_packing():
    assert T.sentence_lines("First one. Second one! It costs 2.5 dollars now.", 20) == ["First one.", "Second one!", "It costs 2.5", "dollars now."]
    assert T.sentence_lines("a, b, c. d\n\n e", 6) == ["a, b,", "c. d", "e"]
    assert T.sentence_lines("", 10) == [] and T.sentence_lines("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    long = "甲乙丙丁，戊己庚辛壬癸。子丑"
    assert "".join(T.sentence_lines(long, 6)) == long and max(map(len, T.sentence_lines(long, 6))) <= 6


def test_dub_json_names_and_keys(spark):
    files = values(spark, [(1, '{"10": {"start_time": 5, "end_time": 6, "original_subtitle": "b"}, "2": {"start_time": 1, "end_time": 2, "text": "[Ann] a", "translated_text": ""}}'), (2, '[{"index": 7, "start_time": 1.0, "end_time": 2.0, "text": "x", "translated_subtitle": "y", "speaker": " Bo "}, {"text": " ", "start_time": 1, "end_time": 2}]')], "track_id int, content string")
    got = [tuple(x) for x in dubbing.from_json(files).orderBy("track_id", "seg_idx").collect()]
    assert got == [(1, 1, 1, 2, "Ann", "a"), (1, 2, 5, 6, "default", "b"), (2, 7, 1, 2, "Bo", "y")]
    assert dubbing.from_json(files, "original").where("track_id = 2").first().text == "x"


def test_match_sentences():
    words = "so we went home . because it was late we slept".split()
    assert edits.best_run("we went home", [w + " " for w in words], 0) == (1, 3)
    assert edits.best_run("zzzz qqqq", [w + " " for w in words], 0) is None
    r = random.Random(1)
    for _ in range(60):  # the quick ratios cut the search short, not the result
        own = [r.choice("ab cd ef gh ij".split()) + " " for _ in range(r.randint(1, 14))]
        text = " ".join(r.choice("ab cd ef gh xy".split()) for _ in range(r.randint(1, 5)))
        n, best, found = len(text.split()), 0.0, None
        for size in sorted(range(max(1, n // 2), min(2 * n, len(own)) + 1), key=lambda x: abs(x - n)):
            for first in range(min(31, len(own) - size + 1)):
                ratio = difflib.SequenceMatcher(None, text, " ".join("".join(own[first : first + size]).split())).ratio()
                if ratio > best:
                    best, found = ratio, (first, size)
                if ratio == 1:
                    break
            if best == 1:
                break
        assert edits.best_run(text, own, 0) == (found if best >= 0.5 else None)


def test_pair_lines(spark):
    rows = values(spark, [(1, 0, ["a", "b", "c", "d"], ["a", "c", "D", "e"])], "track_id int, batch int, source array<string>, target array<string>")
    assert [(x.source, x.target) for x in edits.pair_lines(rows).orderBy("line").collect()] == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "D")]


def test_merge_short(spark):
    rows = [(1, 1, 0, 500, "one two"), (1, 2, 600, 900, "three four five six"), (1, 3, 1300, 1500, "seven"), (1, 4, 5000, 6000, "eight")]
    got = polish.merge_short(values(spark, rows, "track_id int, seg_idx long, start_ms long, end_ms long, text string")).orderBy("seg_idx").collect()
    assert [(x.seg_idx, x.end_ms, x.text) for x in got] == [(1, 1500, "one two three four five six seven"), (4, 6000, "eight")]


def test_segments_by_start(spark):
    rows = [(1, 5, 3000, 3400, "four"), (1, 1, 0, 900, "one"), (1, 9, 500, 700, "two"), (1, 2, 1000, 1300, "three")]
    got = segmenter.segment_words(values(spark, rows, "track_id int, seg_idx long, start_ms long, end_ms long, text string")).collect()
    assert [(x.start_ms, x.end_ms, x.text) for x in got] == [(0, 1300, "one two three"), (3000, 3400, "four")]
    assert segmenter.by_connectives(["x"] * 10 + ["and"] + ["y"] * 3, 18) == [0, 10]  # 60 % of 18 is cut to 10
    assert segmenter.by_connectives(["its" if i == 6 else "x" for i in range(9)], 18) == [0, 7]


def test_valleys(spark):
    frames = [(1, k, 100.0 if k in (0, 1, 2, 3, 10, 11, 12, 13) else 5000.0) for k in range(30)]
    points = values(spark, [(1, 1, 260, 280), (1, 2, 560, 580)], "track_id int, seg_idx long, left_ms long, right_ms long")
    got = {x.seg_idx: x.valley_ms for x in signal.valleys(points, values(spark, frames, "track_id int, frame long, rms double")).collect()}
    assert got[1] == 240
    rows = values(spark, [(1, 1, 0, 260, "a"), (1, 2, 280, 500, "b")], "track_id int, seg_idx long, start_ms long, end_ms long, text string")
    out = signal.share_boundaries(rows, values(spark, frames, "track_id int, frame long, rms double")).orderBy("seg_idx").collect()
    assert [(x.start_ms, x.end_ms) for x in out] == [(0, 240), (240, 500)]


def test_wav_frames(spark, tmp_path):
    for width, value in ((1, b"\xff"), (2, b"\x00\x40"), (4, b"\x00\x00\x00\x40")):
        with wave.open(str(tmp_path / f"{width}.wav"), "wb") as f:
            f.setnchannels(2), f.setsampwidth(width), f.setframerate(1000)
            f.writeframes((value + (b"\x80" if width == 1 else b"\x00" * width)) * 40)
    content = [(w, (tmp_path / f"{w}.wav").read_bytes()) for w in (1, 2, 4)] + [(9, b"none")]
    got = {x[0]: x[1] for x in values(spark, content, "w int, c binary").select("w", signal.wav_frames(F.col("c"), F.lit(20))).collect()}
    assert got == {1: [127.0] * 2, 2: [16384.0] * 2, 4: [2.0**30] * 2, 9: None}
    r = random.Random(1)
    noise = [r.gauss(0, 1) for _ in range(256)]
    tone = [float((i % 8) < 4) - 0.5 for i in range(256)]
    flat = [x[0][0].flatness for x in values(spark, [(noise,), (tone,)], "x array<double>").select(signal.spectra(F.col("x"), F.lit(128))).collect()]
    assert flat[0] > 0.5 > flat[1]


def test_stages(spark):
    rows = values(spark, [(1, i, i * 100, i * 100 + 50, f"t{i}") for i in range(1, 5)], "track_id int, seg_idx long, start_ms long, end_ms long, text string")
    asked = []

    def ask(batch, complaints):
        return batch["text"].str.upper() if complaints else batch["text"]

    stage = stages.checked(ask, lambda b, r: "not upper" if (r == b["text"]).any() else None)
    assert stage(pd.DataFrame({"text": ["a"]})).tolist() == ["A"] and not asked
    done = stages.run_stage(rows, lambda b: b["text"] + "!", 2)
    part = stages.cache_rows(done).where("place = 0")  # a cache that holds only one row of each batch
    again = stages.run_stage(rows, lambda b: b["text"] + "?", 2, part)
    assert sorted(x.reply for x in again.collect()) == ["t1?", "t2?", "t3?", "t4?"]
    fixed = stages.repair(done, F.col("seg_idx") == 2, lambda b: b["text"].str.upper())
    assert sorted(x.reply for x in fixed.collect()) == ["T2", "t1!", "t3!", "t4!"]
    old = values(spark, [("a", "2026-01-01 00:00:00"), ("b", "2026-01-09 00:00:00")], "k string, m string").select("k", F.to_timestamp("m").alias("made_at"))
    assert [x.k for x in stages.fresh(old, pd.Timestamp("2026-01-10").to_pydatetime()).collect()] == ["b"]


def test_cache_keys_of_stages_that_read_the_track(spark):
    rows = values(spark, [(3, 1, "hi"), (4, 1, "hi")], "track_id int, seg_idx long, text string")

    def stage(batch):
        if batch["track_id"].iloc[0] == 3:
            raise RuntimeError("no answer")
        return batch["text"]

    done = stages.run_stage(rows, stage, by=("track_id",))
    again = stages.run_stage(rows, lambda b: ["new"] * len(b), 20, stages.cache_rows(done), by=("track_id",))
    assert sorted((x.track_id, x.reply) for x in again.collect()) == [(3, "new"), (4, "hi")]
    assert stages.batch_keys(stages.timeline.batches(rows)).select("key").distinct().count() == 1


def test_filled_times_round_in_each_step(spark):
    cases = [(1706449822077, 40), (0, 1200), (3, 70), (-5, 60), (1_800_000_000_000, 3)]
    firsts = [1706000000001, 7, -9, 1e300, 1_800_000_000_000]
    rows, want = [], {}
    for track, ((following, n), first) in enumerate(zip(cases, firsts, strict=True)):
        at = float(first)
        rows += [(track, 0, at), (track, n + 1, float(following))]
        for k in range(1, n + 1):
            at = (at + following) / 2
            rows.append((track, k, None))
            want[track, k] = at
    got = polish.fill_times(values(spark, rows, "track_id int, seg_idx long, at_ms double"), F.lit(0)).collect()
    assert {(x.track_id, x.seg_idx): x.at_ms for x in got if (x.track_id, x.seg_idx) in want} == want


def test_replies(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,000\nhello\n\n2\n00:00:02,000 --> 00:00:03,000\n(music)\n"
    got = subtitles.parse_srt_replies(values(spark, [(1, srt)], "track_id int, content string")).collect()
    assert [x.text for x in got] == ["hello"]
    events = 'data: {"choices":[{"delta":{"content":"He"}}]}\n\ndata: {"choices":[{"delta":{"content":"y"}}]}\ndata: [DONE]\n'
    assert subtitles.joined_events(values(spark, [(1, events)], "track_id int, content string")).first().text == "Hey"
    assert one(spark, subtitles.reply_object(F.lit('<think>{}</think>```json\n{"1": "a"}\n```'), "map<string,string>"))[0] == {"1": "a"}


def test_streams(spark, tmp_path):
    schema = "track_id long, seg_idx long, start_ms long, audio_ms long"
    subtitles.append_log(values(spark, [(1, 1, 0, 500), (1, 2, 300, 400), (2, 1, 50, 10)], schema), str(tmp_path / "in"))
    placed = streaming.live_placement(streaming.follow_log(spark, str(tmp_path / "in"), schema), 100)
    query = placed.writeStream.format("memory").queryName("placed").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    query.processAllAvailable()
    subtitles.append_log(values(spark, [(1, 3, 900, 100)], schema), str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    got = sorted(tuple(x) for x in spark.table("placed").collect())
    assert got == [(1, 1, 0, 500), (1, 2, 600, 1000), (1, 3, 1100, 1200), (2, 1, 50, 60)]
