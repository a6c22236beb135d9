"""Frame features of audio, and speech as islands of loud frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from cueframe.operators import intervals


@F.pandas_udf(ArrayType(DoubleType()))
def pcm_frames(content: pd.Series, rate: pd.Series, frame_ms: pd.Series) -> pd.Series:
    """RMS of each frame of 16-bit mono samples."""

    def one(b: bytes, r: int, ms: int) -> list[float]:
        x = np.frombuffer(b[: len(b) // 2 * 2], "<i2").astype(float)
        n = max(1, int(r * ms / 1000))
        x = x[: len(x) // n * n].reshape(-1, n)
        return np.sqrt((x * x).mean(axis=1)).tolist() if len(x) else []

    return pd.Series([one(*t) for t in zip(content, rate, frame_ms, strict=True)])


def thresholds(frames: DataFrame) -> DataFrame:
    """noise (20th percentile by place), peak and threshold by track, from frames (track_id, frame, rms).

    The place of the percentile comes from a count and a rank, so no track is gathered in one row.
    """
    n = F.count("*").over(Window.partitionBy("track_id"))
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy("rms", "frame"))
    ranked = frames.withColumns({"_n": n, "_k": rank})
    at = F.greatest(F.lit(1), F.floor(F.col("_n") * 0.2))
    out = ranked.groupBy("track_id").agg(F.max(F.when(F.col("_k") == at, F.col("rms"))).alias("noise"), F.max("rms").alias("peak"))
    return out.withColumn("threshold", F.greatest(F.col("noise") * 3.0, F.col("peak") * 0.08))


def speech(frames: DataFrame, frame_ms: int = 20, merge_ms: int = 80, least_ms: int = 80) -> DataFrame:
    """(track_id, start_ms, end_ms) of frames above the threshold, merged over short gaps, without short islands; none in silence."""
    loud = frames.join(thresholds(frames), "track_id").where((F.col("rms") >= F.col("threshold")) & (F.col("threshold") > 0))
    spans = loud.select("track_id", (F.col("frame") * frame_ms).alias("start_ms"), ((F.col("frame") + 1) * frame_ms).alias("end_ms"))
    return intervals.bridge(spans, merge_ms).where(F.col("end_ms") - F.col("start_ms") >= least_ms).drop("pieces")


def snap(segments: DataFrame, islands: DataFrame, window_ms: int = 200) -> DataFrame:
    """Segment starts and ends moved to the nearest start and end of speech within window_ms, gaps closed to the next start."""
    points = lambda c: segments.select("track_id", "seg_idx", F.col(c).alias("at_ms"))
    a = intervals.nearest(points("start_ms"), islands.select("track_id", F.col("start_ms").alias("mark_ms")), window_ms, min(120, window_ms)).select("track_id", "seg_idx", F.col("mark_ms").alias("_s"))
    b = intervals.nearest(points("end_ms"), islands.select("track_id", F.col("end_ms").alias("mark_ms")), window_ms, window_ms).select("track_id", "seg_idx", F.col("mark_ms").alias("_e"))
    rows = segments.join(a, ["track_id", "seg_idx"]).join(b, ["track_id", "seg_idx"])
    rows = rows.withColumns({"start_ms": F.coalesce("_s", "start_ms"), "end_ms": F.coalesce("_e", "end_ms")}).drop("_s", "_e")
    following = F.lead("start_ms").over(Window.partitionBy("track_id").orderBy("seg_idx"))
    return rows.withColumn("end_ms", F.when(following.isNotNull(), F.greatest(F.col("start_ms"), following)).otherwise(F.col("end_ms")))


@F.pandas_udf(ArrayType(DoubleType()))
def wav_frames(content: pd.Series, frame_ms: pd.Series) -> pd.Series:
    """RMS of each frame of WAV files of 8, 16 or 32 bit, by their first channel; null for other files."""

    def one(b: bytes, ms: int) -> list[float] | None:
        if b[:4] != b"RIFF" or b[8:12] != b"WAVE":
            return None
        at, head = 12, None
        while at + 8 <= len(b):
            kind, size = b[at : at + 4], int.from_bytes(b[at + 4 : at + 8], "little")
            if kind == b"fmt ":
                head = b[at + 8 : at + 8 + size]
            elif kind == b"data" and head:
                channels, rate, bits = int.from_bytes(head[2:4], "little"), int.from_bytes(head[4:8], "little"), int.from_bytes(head[14:16], "little")
                form = {8: "u1", 16: "<i2", 32: "<i4"}.get(bits)
                if not form or not channels:
                    return None
                raw = b[at + 8 : at + 8 + size]
                x = np.frombuffer(raw[: len(raw) // (channels * bits // 8) * (channels * bits // 8)], form).astype(float)[::channels] - (128 if bits == 8 else 0)
                n = max(1, int(rate * ms / 1000))
                x = x[: len(x) // n * n].reshape(-1, n)
                return np.sqrt((x * x).mean(axis=1)).tolist() if len(x) else []
            at += 8 + size + size % 2
        return None

    return pd.Series([one(*t) for t in zip(content, frame_ms, strict=True)])


@F.pandas_udf(ArrayType(StructType([StructField(x, DoubleType()) for x in ("flatness", "flux", "high")])))
def spectra(samples: pd.Series, size: pd.Series) -> pd.Series:
    """Of each frame of `size` samples: geometric over arithmetic mean of its spectrum (1: noise), the rise of the spectrum
    since the frame before, and the rise of its content weighted by frequency."""

    def one(x: np.ndarray, n: int) -> list[tuple]:
        x = np.asarray(x, float)
        frames = x[: len(x) // n * n].reshape(-1, n) * np.hanning(n)
        power = np.abs(np.fft.rfft(frames, axis=1)) + 1e-12
        flat = np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1)
        before = np.vstack([power[:1], power[:-1]]) if len(power) else power
        flux = np.maximum(power - before, 0).sum(axis=1)
        high = (power * np.arange(power.shape[1])).sum(axis=1)
        return list(zip(flat.tolist(), flux.tolist(), np.maximum(np.diff(high, prepend=high[:1]), 0).tolist(), strict=True))

    return pd.Series([[dict(zip(("flatness", "flux", "high"), t, strict=True)) for t in one(x, int(n))] for x, n in zip(samples, size, strict=True)])


def valleys(points: DataFrame, frames: DataFrame, frame_ms: int = 20, window_ms: int = 200, least_ms: int = 60) -> DataFrame:
    """points (track_id, seg_idx, left_ms, right_ms) with valley_ms: the middle of the longest quiet run around the
    boundary between two rows, else its quietest frame if that is near; null without frames there.

    Quiet: at most twice the noise of thresholds(), or a twenty-fifth of the peak. Frames are looked up by point, in the
    window only.
    """
    marks = thresholds(frames).select("track_id", F.greatest(F.col("noise") * 2.0, F.col("peak") * 0.04).alias("quiet"))
    low = F.greatest(F.lit(0), F.floor((F.least("left_ms", "right_ms") - window_ms // 2) / frame_ms))
    high = F.floor((F.greatest("left_ms", "right_ms") + window_ms // 2) / frame_ms)
    asked = points.select("track_id", "seg_idx", "left_ms", "right_ms", F.explode(F.sequence(low, F.greatest(low, high - 1))).alias("frame"))
    near = asked.join(frames, ["track_id", "frame"]).join(marks, "track_id")
    by = Window.partitionBy("track_id", "seg_idx").orderBy("frame")
    near = near.withColumn("still", F.col("rms") <= F.col("quiet"))
    near = near.withColumn("run", F.sum((~F.col("still")).cast("long")).over(by))
    runs = near.where("still").groupBy("track_id", "seg_idx", "run").agg(F.min("frame").alias("first"), F.count("*").alias("n"))
    best = runs.groupBy("track_id", "seg_idx").agg(F.max_by(F.struct("first", "n"), F.struct("n", -F.col("first"))).alias("r"))
    least = near.groupBy("track_id", "seg_idx").agg(F.min(F.struct("rms", "frame")).alias("l"))
    out = points.join(best, ["track_id", "seg_idx"], "left").join(least, ["track_id", "seg_idx"], "left")
    lowest, middle = F.col("l.frame") * frame_ms, F.floor((F.col("left_ms") + F.col("right_ms")) / 2)
    valley = F.when(F.col("r.n") * frame_ms >= least_ms, (F.col("r.first") + F.floor(F.col("r.n") / 2)) * frame_ms).when(F.abs(lowest - middle) <= window_ms, lowest)
    return out.withColumn("valley_ms", valley).select(*points.columns, "valley_ms")


def share_boundaries(segments: DataFrame, frames: DataFrame, touch_ms: int = 80, frame_ms: int = 20) -> DataFrame:
    """Rows that all but touch the next one meet it in the valley between them; no row ends before its start."""
    following = F.lead("start_ms").over(Window.partitionBy("track_id").orderBy("seg_idx"))
    points = segments.withColumn("right_ms", following).where(F.abs(F.col("right_ms") - F.col("end_ms")) <= touch_ms).select("track_id", "seg_idx", F.col("end_ms").alias("left_ms"), "right_ms")
    found = valleys(points, frames, frame_ms).where("valley_ms is not null").select("track_id", "seg_idx", "valley_ms")
    rows = segments.join(found, ["track_id", "seg_idx"], "left")
    rows = rows.withColumn("_b", F.lag("valley_ms").over(Window.partitionBy("track_id").orderBy("seg_idx")))
    rows = rows.withColumns({"start_ms": F.coalesce("_b", "start_ms"), "end_ms": F.coalesce("valley_ms", "end_ms")}).drop("_b", "valley_ms")
    return rows.withColumn("end_ms", F.greatest("end_ms", "start_ms"))
