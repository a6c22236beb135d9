"""Lookups and parsed texts."""

from pyspark.sql import functions as F

from cueframe.operators import catalog


def content(spark, text):
    return spark.createDataFrame([("t", text)], "track_id string, content string")


def test_voices(spark):
    rows = catalog.voices(content(spark, '{"en": {"Ann": "en-a"}, "fr": {"Anne": "fr-a", "Luc": "fr-l"}, "zh": {"Lian": "zh-an"}}'))
    assert [x.voice for x in catalog.search_voices(rows, "AN").collect()] == ["zh-an", "en-a", "fr-a"]
    assert [x.voice for x in catalog.search_voices(rows, "l", "fr").collect()] == ["fr-l"]
    asked = spark.createDataFrame([("p", " ANN "), ("p", "own"), ("q", "ann")], "provider string, voice string")
    alias = spark.createDataFrame([("p", "Ann", "en-a")], "provider string, alias string, target string")
    assert sorted(x.voice for x in catalog.normalize_voices(asked, alias).collect()) == ["ann", "en-a", "own"]
    got = catalog.speaker_map(content(spark, '{"Edge ": {" a ": "v1", "b": " "}, "": {"c": "x"}}')).collect()
    assert [tuple(x) for x in got] == [("edge", "a", "v1")]


def test_probe_and_styles(spark):
    probe = "  Duration: 00:01:02.50, start: 0.0, bitrate: 812 kb/s\n  Stream #0:0(und): Video: h264 (High), yuv420p, 1280x720, 25 fps\n  Stream #0:1(eng): Audio: aac, 48000 Hz\n  Stream #0:2(fra): Audio: aac"
    x = catalog.media_probe(content(spark, probe)).first()
    assert (x.duration_s, x.bitrate_kbps, x.video_codec, x.width, x.height, x.fps, x.audio_codec, x.audio_languages) == (62.5, 812, "h264", 1280, 720, 25.0, "aac", ["eng", "fra"])
    assert catalog.media_probe(content(spark, "nothing")).first().duration_s is None
    x = catalog.ass_styles(content(spark, "PlayResX: 1920\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize\nStyle: Default, Arial, 40\nStyle: broken, x")).collect()
    assert len(x) == 1 and x[0].play_res_x == 1920 and x[0].play_res_y == 288 and x[0].style == {"Name": "Default", "Fontname": "Arial", "Fontsize": "40"}


def test_scene_shots(spark):
    cuts = spark.createDataFrame([(1, [0.01, 3.0, 3.5, 6.0, 9.5], 10.0), (2, [], 4.0)], "track_id long, cuts array<double>, duration_s double")
    got = catalog.scene_shots(cuts, 1.0).orderBy("track_id", "shot").collect()
    assert [(x.track_id, x.start_s, x.end_s) for x in got] == [(1, 0.0, 3.0), (1, 3.0, 6.0), (1, 6.0, 10.0), (2, 0.0, 4.0)]
    runs = catalog.mirror_runs(catalog.scene_shots(cuts), 3)
    assert all(x.start_s < x.end_s for x in runs.collect())
    assert runs.collect() == catalog.mirror_runs(catalog.scene_shots(cuts), 3).collect()


def test_files_and_presets(spark):
    files = spark.createDataFrame([("/x/B.srt", 1), ("/x/a.SRT", 3), ("/x/c.mp4", 9)], "path string, modificationTime long")
    assert [x.path for x in catalog.by_suffix(files, (".srt",)).collect()] == ["/x/a.SRT", "/x/B.srt"]
    assert catalog.newest(files).first().path == "/x/c.mp4"
    df = spark.range(1)
    assert tuple(df.select(*catalog.timing_preset(F.lit(1.5), F.lit(0.3), "natural")).first()) == (1.25, 0.3)
    assert tuple(df.select(*catalog.timing_preset(F.lit(1.5), F.lit(0.3), "strict")).first()) == (2.0, 0.12)


def test_lines(spark):
    rows = spark.createDataFrame([(1, 1, "one two three four five six"), (1, 2, "你好世界你好世界"), (1, 3, "short")], "track_id long, seg_idx long, text string")
    got = {x.seg_idx: x.text for x in catalog.lines_of(rows, 14).collect()}
    assert got == {1: "one two three\nfour five six", 2: "你好世界\n你好世界", 3: "short"}
