"""Merged chunks against a plain statement of the rule, chunk by chunk from left to right."""

import difflib
import random

import pytest

from cueframe.operators import chunkmerge

FIELDS = "track_id long, chunk int, offset_ms long, seg_idx long, start_ms long, end_ms long, text string"


def plain(chunks, overlap, words):
    """chunks: lists of (start, end, text) in order of time."""
    same = (lambda x, y: x == y) if words else (lambda x, y: difflib.SequenceMatcher(None, x, y).ratio() > 0.7)
    out = []
    for right in chunks:
        if not out or not right:
            out = out or right
            continue
        tail, head = 0, 0
        while tail < len(out) and out[-1 - tail][0] >= out[-1][1] - overlap:
            tail += 1
        while head < len(right) and right[head][1] <= right[0][0] + overlap:
            head += 1
        if not tail or not head:
            out = out + right
            continue
        best = (0.0, None)
        for i in range(1, tail + head + 1):
            pairs = [(a, a + i - tail) for a in range(tail) if 0 <= a + i - tail < head]
            n = sum(same(out[len(out) - tail + a][2], right[b][2]) for a, b in pairs)
            if n >= 2 and n / i + i / 10000 > best[0]:
                best = (n / i + i / 10000, (pairs[0][0] + pairs[-1][0] + 1) // 2, (pairs[0][1] + pairs[-1][1] + 1) // 2)
        if best[1] is None:
            cut = [i + 1 for i, x in enumerate(out) if x[1] <= right[0][0]]
            out = (out[: cut[-1]] if cut else out) + right
        else:
            out = out[: len(out) - tail + best[1]] + right[best[2] :]
    return sorted(out, key=lambda x: x[0])


def changed(rng, text):
    at = rng.randrange(len(text) + 1)
    return text[:at] + rng.choice("xyz") + text[at + rng.randrange(2) :]


@pytest.mark.parametrize("words", [True, False])
def test_merged_chunks_are_those_of_the_rule(spark, words):
    rng, rows, want = random.Random(7), [], {}
    for track in range(40):
        vocabulary = "ab cd ef gh".split() if words else ["now we go home", "what is that over there", "the end of it", "nothing, said the other one"]
        length, step = 60, 1000
        said = [(i * step, i * step + rng.choice((700, 900)), rng.choice(vocabulary)) for i in range(length)]
        chunks = []
        for c, at in enumerate(range(0, length - 10, 20)):
            own = [x for x in said[at : at + 26] if rng.random() < 0.9]
            if track % 5 == 0:
                own = [(s, e, f"own{c}{s}" if words else f"{'qrstuv'[c] * 9} {s}") for s, e, _ in own]  # nothing in common
            elif not words:
                own = [(s, e, changed(rng, t) if rng.random() < 0.5 else t) for s, e, t in own]
            if track % 7 == 3 and c == 1:
                own = []
            chunks.append(own)
            rows += [(track, c, at * step, i, s - at * step, e - at * step, t) for i, (s, e, t) in enumerate(own)]
        want[track] = plain(chunks, 6000, words)
    rng.shuffle(rows)
    got = {}
    for r in chunkmerge.merge_chunks(spark.createDataFrame(rows, FIELDS), 6000).orderBy("track_id", "seg_idx").collect():
        got.setdefault(r.track_id, []).append((r.start_ms, r.end_ms, r.text))
    assert got == want


def test_windows_without_rows_and_no_rows(spark):
    rows = [(1, 0, 0, 0, 0, 9000, "a long one"), (1, 1, 5000, 0, 0, 9000, "another long one"), (None, 0, 0, 0, 0, 10, None)]
    got = chunkmerge.merge_chunks(spark.createDataFrame(rows, FIELDS), 1000).where("track_id = 1").collect()
    assert sorted(x.start_ms for x in got) == [0, 5000]  # longer than the overlap: nothing is cut
    assert chunkmerge.merge_chunks(spark.createDataFrame([], FIELDS), 1000).collect() == []


def test_windows_of_chunks_are_made_once(spark):
    """Each task sorts the words for the windows once, not again for each of the four tables that read them."""
    rows = [(1, c, c * 2000, i, i * 100, i * 100 + 90, f"w{c * 20 + i}") for c in range(3) for i in range(25)]
    df = spark.createDataFrame(rows, FIELDS)
    plan = chunkmerge.merge_chunks(df, 600)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1 and plan.count("min(start_ms") <= 3  # the new numbers only; the windows are read
    assert [x.text for x in chunkmerge.merge_chunks(df, 600).orderBy("seg_idx").collect()] == [f"w{i}" for i in range(65)]
