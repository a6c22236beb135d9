"""Frames of recordings read by ranges, and boundaries snapped to them, against plain statements and cases by hand."""

import math
import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueframe.operators import signal, snapping
from cueframe.sources import audio

SEGMENTS = "track_id string, seg_idx long, start_ms long, end_ms long, text string"


def write(path, spans, total_ms, rate=1000, width=2, channels=1, tone=None):
    value = {1: lambda v: struct.pack("B", 128 + v // 200), 2: lambda v: struct.pack("<h", v), 4: lambda v: struct.pack("<i", v * 60_000)}[width]
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels), f.setsampwidth(width), f.setframerate(rate)
        out = bytearray()
        for i in range(total_ms * rate // 1000):
            loud = any(a <= i * 1000 / rate < b for a, b in spans)
            v = (int(12000 * math.sin(2 * math.pi * tone * i / rate)) if tone else 12000) if loud else 0
            out += value(v) + value(0) * (channels - 1)
        f.writeframes(bytes(out))
    return path.as_uri()


def frames_of(spark, uris, **more):
    return audio.wav_frames(spark.createDataFrame(list(uris.items()), "track_id string, uri string"), **more)


def test_ranges_give_the_frames_of_the_whole(spark, tmp_path):
    uris = {}
    for k, (rate, width, channels) in enumerate(((1000, 2, 1), (16_000, 2, 2), (8000, 1, 1), (8000, 4, 2))):
        uris[str(k)] = write(tmp_path / f"{k}.wav", [(100, 480), (660, 1093)], 1299, rate, width, channels, 220)
    (tmp_path / "x.wav").write_bytes(b"none")
    uris |= {"bad": (tmp_path / "x.wav").as_uri(), "gone": (tmp_path / "gone.wav").as_uri(), "null": None}
    whole = {(x.track_id, x.frame): x for x in frames_of(spark, uris).collect()}
    parts = {(x.track_id, x.frame): x for x in frames_of(spark, uris, frames_a_range=7).collect()}
    assert whole.keys() == parts.keys() == {(str(k), i) for k in range(4) for i in range(65)}
    for key, x in whole.items():
        for c in ("rms", "flatness", "flux", "high"):
            assert parts[key][c] == (None if x[c] is None else pytest.approx(x[c], rel=1e-9, abs=1e-6)), (key, c)


def test_features_by_the_definition():
    r = np.random.default_rng(2)
    x = r.normal(0, 1000, 3333)
    got = audio.features(x, 0, -(-3333 // 160), 8000)
    window, power = np.hanning(257)[:-1], []
    for i in range(len(got)):
        own = x[i * 160 : i * 160 + 160]
        assert got["rms"][i] == pytest.approx(math.sqrt(sum(v * v for v in own) / len(own)))
        part = x[i * 160 : i * 160 + 256]
        if len(part) == 256:
            power.append(np.maximum(np.abs(np.fft.rfft(part * window)), 1e-10))
            assert got["flatness"][i] == pytest.approx(np.exp(np.log(power[i]).mean()) / power[i].mean())
            assert got["flux"][i] == pytest.approx(np.maximum(power[i] - power[i - 1], 0).sum() if i else 0)
            rise = lambda k: (power[k] * np.arange(129)).sum()
            assert got["high"][i] == pytest.approx(max(0, rise(i) - rise(i - 1)) if i else 0)
        else:
            assert math.isnan(got["flatness"][i])


CASES = [
    ([(200, 700), (1000, 1400)], 1600, [(120, 780), (930, 1480)], [(200, 1000), (1000, 1400)]),
    ([(480, 560), (700, 1100)], 1300, [(650, 1120)], [(700, 1100)]),
    ([(100, 480), (660, 1100)], 1300, [(100, 620), (620, 1100)], [(100, 660), (660, 1100)]),
    ([(100, 480), (760, 1100)], 1300, [(100, 620), (620, 1100)], [(100, 760), (760, 1100)]),
    ([(100, 500), (1000, 1400)], 1500, [(100, 520), (1020, 1420)], [(100, 1020), (1020, 1400)]),
]


def test_rows_by_hand(spark, tmp_path):
    """Each case is a track; beside them tracks without speech or frames, a null time, and twins."""
    uris = {str(k): write(tmp_path / f"{k}.wav", c[0], c[1]) for k, c in enumerate(CASES)}
    uris |= {"a": write(tmp_path / "a.wav", [(200, 700)], 900), "quiet": write(tmp_path / "q.wav", [], 500)}
    rows = [(str(k), i, a, b, "line") for k, c in enumerate(CASES) for i, (a, b) in enumerate(c[2])]
    rows += [("a", 1, 120, 780, None), ("a", 2, None, 5, "x"), ("a", 3, 120, 780, "twin"), ("quiet", 1, 10, 20, "q"), ("none", 1, 10, 20, "n")]
    frames = audio.onset_frames(frames_of(spark, uris)).cache()
    got = {(x.track_id, x.seg_idx): (x.start_ms, x.end_ms) for x in snapping.snap_rows(spark.createDataFrame(rows, SEGMENTS), frames, 20, 300, 0).collect()}
    for k, c in enumerate(CASES):
        assert [got[str(k), i] for i in range(len(c[2]))] == c[3], k
    assert len(got) == len(rows) and got["quiet", 1] == got["none", 1] == (10, 20) and got["a", 2] == (None, 5)
    assert got["a", 1][0] <= got["a", 1][1] <= got["a", 3][0] or got["a", 1] == got["a", 3]
    assert frames.where(F.col("track_id") == "quiet").count() == 25


def plain_start(ms, islands, frames, window):
    """The rule as its docstring states it, one point at a time."""
    tonal = lambda i: frames[i][1] is None or frames[i][1] < 0.5 if i in frames else True
    strength = {i: f[2] for i, f in frames.items() if f[2] is not None}
    for a, b in islands:
        if a <= ms <= b:
            if b - a < 100:
                return ms
            own = sorted(strength[i] for i in range(a // 20, b // 20) if i in strength)
            limit = own[len(own) // 2] * 1.5 if len(own) > 1 else 0
            return next((i * 20 for i in range(ms // 20, b // 20) if limit > 0 and strength.get(i, -1) >= limit), ms)
    coming = [(a, b) for a, b in islands if a >= ms and (b - a >= 100 or tonal(a // 20))]
    if not coming:
        return ms
    a, b = coming[0]
    just = any(d <= ms and ms - d <= 400 for c, d in [x for x in islands if x[1] - x[0] >= 100 and x[0] <= ms][-1:])
    if not (a - ms <= min(300, window) or just and a - ms <= 1500) or a - ms < 40 or b - a < 200 and not tonal(a // 20):
        return ms
    low, high = max(ms // 20, (a - 200) // 20), a // 20
    pre = sorted(strength[i] for i in range(low, high) if i in strength)
    if not pre or high not in strength:
        return a
    limit = max(pre[len(pre) // 2] * 3, max(pre[-1], strength[high]) * 0.4)
    return max((i * 20 for i in range(low, high) if limit > 0 and strength.get(i, -1) >= limit and tonal(i)), default=a)


def test_starts_equal_brute_force(spark):
    r = random.Random(6)
    frames, points, want = [], [], {}
    for t in range(12):
        own, at, islands = {}, 0, []
        while at < 240:
            quiet, loud = r.choice([5, 6, 9, 20, 40]), r.choice([4, 5, 7, 12, 30])
            islands.append(((at + quiet) * 20, (at + quiet + loud) * 20))
            for i in range(at, at + quiet + loud):
                high = i >= at + quiet
                own[i] = (9000.0 if high else 10.0, r.choice([None, 0.1, 0.4, 0.6, 0.9]), r.choice([None, 0.0, 1.0, 2.0, 3.0, 8.0]))
            at += quiet + loud
        frames += [(str(t), i, *x) for i, x in own.items()]
        for k in range(60):
            ms = r.randrange(0, at * 20)
            points.append((str(t), k, ms))
            want[str(t), k] = plain_start(ms, islands, own, 350)
    frames = spark.createDataFrame(frames, "track_id string, frame long, rms double, flatness double, strength double")
    points = spark.createDataFrame(points, "track_id string, seg_idx long, at_ms long")
    got = {(x.track_id, x.seg_idx): x.snapped_ms for x in snapping.snap_starts(points, signal.speech(frames), frames).collect()}
    assert got == want and len({k for k, v in want.items()}) == 720
