"""Gates, counted stages and checks of replies, by hand."""

import pytest
from pyspark.sql import functions as F

from cueframe.operators import edits, gates


def test_counted_stage_stops_a_run(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (1, "a", " A "), (1, "a", None), (2, "x", "y")], "track_id int, text string, reply string")
    bad = gates.failed_reply(F.col("text"), F.col("reply"))
    out, seen = gates.counted(rows, bad)
    assert out.count() == 4 and gates.check(seen) == {"n": 4, "failed": 2}
    out, seen = gates.counted(rows.where("track_id = 1"), bad, "again")
    out.collect()
    with pytest.raises(RuntimeError, match="2 of 3 rows failed"):
        gates.check(seen)
    assert sorted(tuple(x) for x in gates.gate(rows, bad).collect()) == [(1, 2, 3, True), (2, 0, 1, False)]
    assert gates.gate(rows.limit(0), bad).count() == 0


def test_reply_errors(spark):
    sent = {"1": "hello world", "2": "good bye"}
    replies = ['{"1": "hello worlds", "2": "good bye!"}', "none", '{"1": "a"}', '{"1": "a", "2": "b", "3": "c"}', '{"1": " ", "2": "b"}', '{"1": {"t": "a"}, "2": "b"}', '{"1": "zzz", "2": "good bye"}', None]
    rows = spark.createDataFrame([(1, i, sent, r) for i, r in enumerate(replies)] + [(2, 0, None, "{}")], "track_id int, batch int, sent map<string,string>, reply string")
    got = {(x.track_id, x.batch): x.error for x in gates.reply_errors(rows, least=0.5).collect()}
    object_, keys = "the reply is not a JSON object", "keys that were not asked for: 3"
    want = [None, object_, "keys missing: 2", keys, "no text in: 1", "no text in: 1", "changed too much: 1", object_]
    assert [got[1, i] for i in range(len(replies))] == want and got[2, 0] is None
    nested = spark.createDataFrame([(1, 0, sent, '{"1": {"t": "a", "why": "x"}, "2": {"t": "b"}}'), (1, 1, sent, '{"1": {"t": ""}, "2": {"u": "b"}}')], rows.schema)
    assert [x.error for x in gates.reply_errors(nested, "t").orderBy("batch").collect()] == [None, "no text in 't' of: 1, 2"]


def test_tables_by_key(spark):
    rows = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "y"), (1, 3, None, "z")], "track_id int, seg_idx int, speaker string, text string")
    profiles = spark.createDataFrame([("a", "va", None), ("a", "vz", 1), ("default", "vd", 7)], "speaker string, voice string, style int")
    got = edits.with_defaults(rows, profiles, "speaker", {"voice": "alloy", "style": None}).orderBy("seg_idx").collect()
    assert [(x.voice, x.style) for x in got] == [("va", 7), ("vd", 7), ("vd", 7)]
    assert {x.voice for x in edits.with_defaults(rows, profiles.limit(0), "speaker", {"voice": "alloy"}).collect()} == {"alloy"}
    replies = spark.createDataFrame([(1, 1, "X"), (1, 2, ""), (9, 9, "no")], "track_id int, seg_idx int, reply string")
    assert [x.text for x in edits.with_replies(rows, replies).orderBy("seg_idx").collect()] == ["X", "y", "z"]
    state = edits.restore(rows.where("seg_idx = 1"), rows.where("seg_idx > 1"), replies)
    assert {x.seg_idx: x.state for x in state.collect()} == {1: "kept", 2: "restored", 3: "dropped"}
