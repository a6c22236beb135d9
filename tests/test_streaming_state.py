"""Streams with state: rows out of order, over micro-batches and Arrow batches, give what the batch operator gives."""

import random
from datetime import UTC, datetime, timedelta

from cueframe import streaming
from cueframe.operators import timeline
from cueframe.sources import subtitles

SCHEMA = "track_id long, ts timestamp, seg_idx long, start_ms long, audio_ms long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(spark, stream, name, state, feeds):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(state)).outputMode("append").start()
    try:
        for feed in feeds:
            feed()
            query.processAllAvailable()
    finally:
        query.stop()
    return sorted(tuple(x) for x in spark.table(name).collect())


def test_rows_of_many_arrow_batches_keep_their_order(spark, tmp_path):
    schema = "track_id long, seg_idx long, start_ms long, audio_ms long"
    rows = spark.createDataFrame([(1, i, i * 100, 400) for i in reversed(range(9))], schema)
    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        placed = streaming.live_placement(streaming.follow_log(spark, str(tmp_path / "in"), schema), 50)
        got = run(spark, placed, "many", tmp_path / "state", [lambda: subtitles.append_log(rows.coalesce(1), str(tmp_path / "in"))])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((x.track_id, x.seg_idx, x.place_start, x.place_end) for x in timeline.place_with_gap(rows, 50).collect())


def test_late_rows_are_placed_as_in_batch(spark, tmp_path):
    r = random.Random(9)
    begin = datetime(2026, 1, 1, tzinfo=UTC)
    rows = [(t, begin + timedelta(milliseconds=i * 1000), i, i * 1000, r.choice([200, 900, 2500])) for t in (1, 2) for i in range(30)]
    parts = [[], [], []]
    for row in rows:
        parts[min(2, max(0, row[2] // 10 + r.choice([-1, 0, 0])))].append(row)
    for p in parts:
        r.shuffle(p)
    parts.append([(9, begin + timedelta(hours=1), 0, 0, 1)])  # moves the watermark past all
    parts.append([(9, begin + timedelta(hours=1, seconds=1), 1, 1000, 1)])
    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = streaming.placed_in_time(streaming.follow_log(spark, str(tmp_path / "in"), SCHEMA), 100, "30 seconds", 600_000)
        feeds = [lambda p=p: subtitles.append_log(spark.createDataFrame(p, SCHEMA).coalesce(1), str(tmp_path / "in")) for p in parts]
        got = run(spark, stream, "late", tmp_path / "state", feeds)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = timeline.place_with_gap(spark.createDataFrame(rows, SCHEMA), 100).collect()
    assert [x for x in got if x[0] != 9] == sorted((x.track_id, x.seg_idx, x.place_start, x.place_end) for x in batch)
