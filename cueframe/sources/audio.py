"""Recordings as frames: WAV files read by byte ranges, so that a long one is many rows, and features of each frame.

A first pass reads headers. Ranges of whole frames are then dealt to tasks, and each task opens the file at its place and
reads its range with the samples before and behind it that windows of the spectrum need. The frames of a recording are
the same however it is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE = 1500  # frames of a range
FORMS = {8: "u1", 16: "<i2", 32: "<i4"}
FRAMES = "track_id string, frame long, rms double, flatness double, flux double, high double"


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def wav_head(data: bytes) -> tuple[int, int, int, int, int] | None:
    """Channels, samples a second, bits, and place and size of the samples, of the first bytes of a WAV file; None for others."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, b""
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            form = data[at + 8 : at + 8 + size]
        elif kind == b"data":
            channels, rate, bits = (int.from_bytes(form[a:b], "little") for a, b in ((2, 4), (4, 8), (14, 16)))
            return (channels, rate, bits, at + 8, size) if bits in FORMS and channels and rate else None
        at += 8 + size + size % 2
    return None


def samples(raw: bytes, bits: int, channels: int) -> np.ndarray:
    """The first channel of whole samples, as doubles around 0."""
    step = channels * bits // 8
    return np.frombuffer(raw[: len(raw) // step * step], FORMS[bits])[::channels].astype(float) - (128 if bits == 8 else 0)


def window_size(rate: int) -> int:
    """Samples of a window of the spectrum: 25 ms, 256 at least."""
    return max(256, rate // 40)


def features(x: np.ndarray, before: int, count: int, rate: int, frame_ms: int = 20) -> pd.DataFrame:
    """rms, flatness, flux and high of `count` frames that begin at x[before]; x holds what is known around them.

    rms is of a frame's own samples, the last ones if fewer; the others are of windows that begin with the frame, null where
    no whole window is left, and 0 for rises of a recording's first frame.
    """
    hop, size = max(1, rate * frame_ms // 1000), window_size(rate)
    own = x[before : before + count * hop]
    squares = np.concatenate([own, np.zeros(count * hop - len(own))]) ** 2
    held = np.minimum(hop, np.maximum(1, len(own) - np.arange(count) * hop))
    out = pd.DataFrame({"rms": np.sqrt(squares.reshape(count, hop).sum(axis=1) / held)})
    first = before - hop if before >= hop else before  # with the frame before, if there is one
    n = max(0, min(count + (before - first) // hop, (len(x) - first - size) // hop + 1))
    for c in ("flatness", "flux", "high"):
        out[c] = np.nan
    if n:
        frames = np.lib.stride_tricks.sliding_window_view(x[first:], size)[::hop][:n] * np.hanning(size + 1)[:-1]
        power = np.maximum(np.abs(np.fft.rfft(frames, axis=1)), 1e-10)
        high = (power * np.arange(power.shape[1])).sum(axis=1)
        rise = np.maximum(np.diff(power, axis=0, prepend=power[:1]), 0).sum(axis=1)
        values = np.stack([np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1), rise, np.maximum(np.diff(high, prepend=high[:1]), 0)], axis=1)
        values = values[(before - first) // hop :]
        out.loc[: len(values) - 1, ["flatness", "flux", "high"]] = values
    return out


def wav_frames(files: DataFrame, frame_ms: int = 20, frames_a_range: int = RANGE) -> DataFrame:
    """(track_id, frame, rms, flatness, flux, high) of files (track_id, uri) of 8, 16 or 32 bit, by their first channel.

    URIs are opened by tasks through Arrow's file systems. Files that aren't WAV, or can't be read, have no frames, and
    neither have empty ones. Null URIs go. The last frame may be shorter.
    """

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for track, uri in pdf[["track_id", "uri"]].itertuples(index=False):
                try:
                    with _open(uri) as f:
                        total, head = f.size(), wav_head(f.read_at(min(f.size(), 1 << 16), 0))
                except OSError:
                    continue
                if head:
                    channels, rate, bits, at, size = head
                    end = min(total, at + size)
                    rows.append((track, uri, channels, rate, bits, at, -(-((end - at) // (channels * bits // 8)) // max(1, rate * frame_ms // 1000)), end))
            yield pd.DataFrame(rows, columns=["track_id", "uri", "channels", "rate", "bits", "at", "frames", "end"])

    known = files.where("uri is not null").select(F.col("track_id").cast("string"), "uri").mapInPandas(heads, "track_id string, uri string, channels int, rate int, bits int, at long, frames long, end long")
    ranges = known.where("frames > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(frames_a_range).cast("long"))))
    ranges = ranges.repartition("track_id", "first")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples():
                step, hop = x.channels * x.bits // 8, max(1, x.rate * frame_ms // 1000)
                count = min(frames_a_range, x.frames - x.first)
                before = hop if x.first else 0
                start = x.at + (x.first * hop - before) * step
                end = min(x.end, x.at + ((x.first + count) * hop + window_size(x.rate)) * step)
                with _open(x.uri) as f:
                    wave = samples(f.read_at(end - start, start), x.bits, x.channels)
                out = features(wave, before, count, x.rate, frame_ms)
                out.insert(0, "frame", np.arange(x.first, x.first + count))
                out.insert(0, "track_id", x.track_id)
                yield out

    return ranges.mapInPandas(read, FRAMES)


def onset_frames(frames: DataFrame) -> DataFrame:
    """frames for snapping: strength is the larger of the two rises, null where no window was left."""
    return frames.select("track_id", "frame", "rms", "flatness", F.greatest("flux", "high").alias("strength"))
