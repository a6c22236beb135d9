"""Streaming forms (an extension; the batch operators have none of these)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def live_islands(events: DataFrame, gap_seconds: int = 600, late: str = "30 minutes") -> DataFrame:
    """Runs of segments (track_id, ts, dur_ms) by session windows: a run ends when nothing follows within gap_seconds."""
    ends = F.make_interval(secs=(gap_seconds + F.col("dur_ms") / 1000).cast("decimal(18,6)"))
    session = F.session_window(F.col("ts"), ends)
    return events.withWatermark("ts", late).groupBy("track_id", session.alias("w")).agg(F.count("*").alias("n"), F.sum("dur_ms").alias("busy_ms"))


def live_load(events: DataFrame, length: str = "12 hours", hop: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Calls and time by hopping window, for rate limits."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, hop).alias("w"), "track_id").agg(F.count("*").alias("calls"), F.sum("dur_ms").alias("busy_ms"))


def live_frames(samples: DataFrame, frame: str = "20 milliseconds", late: str = "5 seconds") -> DataFrame:
    """RMS by tumbling frame of samples (track_id, ts, value)."""
    frames = samples.withWatermark("ts", late).groupBy("track_id", F.window("ts", frame).alias("w"))
    return frames.agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.count("*").alias("n"))


def follow_log(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """New JSON lines of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def _behind(rows: list[tuple[int, int, int]], last: int | None, gap_ms: int) -> tuple[list[tuple[int, int, int]], int | None]:
    """(seg_idx, place_start, place_end) of rows (start_ms, seg_idx, audio_ms) in order, and the end of the last one."""
    out = []
    for start, seg, audio in sorted(rows):
        start = start if last is None else max(start, last + gap_ms)
        last = start + audio
        out.append((seg, start, last))
    return out, last


PLACED = ["seg_idx", "place_start", "place_end"]


def live_placement(rows: DataFrame, gap_ms: int) -> DataFrame:
    """place_start and place_end of rows (track_id, seg_idx, start_ms, audio_ms) that come in order: each at its start,
    or gap_ms behind the row before where that is later. The state of a track is the end of its last row.

    Rows of a track in one micro-batch may come in any order; between micro-batches the order is that of arrival. See
    placed_in_time for rows that come late, and for state that ends.
    """

    def place(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = pd.concat([p[["start_ms", "seg_idx", "audio_ms"]] for p in parts])  # all of a micro-batch, however it is cut
        own = own.sort_values("seg_idx")
        last, out = (state.get[0] if state.exists else None), []
        for row in own.itertuples(index=False, name=None):
            placed, last = _behind([row], last, gap_ms)
            out += placed
        yield pd.DataFrame(out, columns=PLACED).assign(track_id=key[0])[["track_id", *PLACED]]
        if last is not None:
            state.update((int(last),))

    kind = rows.schema["track_id"].dataType.simpleString()
    out = f"track_id {kind}, seg_idx long, place_start long, place_end long"
    return rows.groupBy("track_id").applyInPandasWithState(place, out, "last long", "append", "NoTimeout")


class Placing(StatefulProcessor):
    """Rows wait until the watermark has passed their time, and are then placed in the order of their starts.

    waiting: the rows by time and number; last: the end of the row placed last. A timer stands at each row's time, and one
    idle_ms behind the last row, which ends the track's state.
    """

    def __init__(self, gap_ms: int, idle_ms: int):
        self.gap_ms, self.idle_ms = gap_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, seg_idx long", "start_ms long, audio_ms long")
        self.last = handle.getValueState("last", "end_ms long, idle_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end, idle_at = self.last.get() or (None, None) if self.last.exists() else (None, None)
        for part in rows:
            for at, seg, start, audio in zip((part["ts"].astype("int64") // 1_000_000).tolist(), part["seg_idx"].tolist(), part["start_ms"].tolist(), part["audio_ms"].tolist(), strict=True):
                self.waiting.updateValue((at, seg), (start, audio))
                self.handle.registerTimer(at)
                if idle_at is None or at + self.idle_ms > idle_at:
                    if idle_at is not None:
                        self.handle.deleteTimer(idle_at)
                    idle_at = at + self.idle_ms
        self.handle.registerTimer(idle_at)
        self.last.update((end, idle_at))
        yield pd.DataFrame(columns=["track_id", *PLACED])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        end, idle_at = self.last.get() if self.last.exists() else (None, None)
        due = [(at_seg, row) for at_seg, row in self.waiting.iterator() if at_seg[0] <= now]
        placed, end = _behind([(start, seg, audio) for (_, seg), (start, audio) in due], end, self.gap_ms)
        for at_seg, _ in due:
            self.waiting.removeKey(tuple(at_seg))
        if idle_at is not None and now >= idle_at:
            self.last.clear()
        else:
            self.last.update((end, idle_at))
        yield pd.DataFrame(placed, columns=PLACED).assign(track_id=key[0])[["track_id", *PLACED]]

    def close(self) -> None:
        pass


def placed_in_time(rows: DataFrame, gap_ms: int, late: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """place_start and place_end of rows (track_id, ts, seg_idx, start_ms, audio_ms) as the batch operator places them,
    in whatever order they come, if they are at most `late` behind.

    ts is when a row starts, and start_ms the same on the track's own clock. A row is placed once the watermark has passed
    it; later ones are dropped, as a watermark says. A track without rows for idle_ms is forgotten. Needs the RocksDB state
    store (spark.sql.streaming.stateStore.providerClass).
    """
    kind = rows.schema["track_id"].dataType.simpleString()
    out = f"track_id {kind}, seg_idx long, place_start long, place_end long"
    keyed = rows.withWatermark("ts", late).groupBy("track_id")
    return keyed.transformWithStateInPandas(Placing(gap_ms, idle_ms), out, "Append", "EventTime")
