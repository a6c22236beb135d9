"""Coarse-then-fine alignment against a plain warping path over whole texts, and cases with a known answer."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueframe.functions import text as T
from cueframe.operators import aligner, polish

REC = "track_id long, seg_idx long, start_ms long, end_ms long, text string"
OWN = "track_id long, seg_idx long, text string"
SOUNDS = {"部": "bu4", "署": "shu3", "属": "shu3", "师": "shi1", "姐": "jie3", "世": "shi4", "界": "jie4", "苹": "ping2", "他": "ta1", "她": "ta1"}


def plain_path(cost):
    """Cheapest warping path by the textbook: a diagonal step weighs two."""
    n, m = cost.shape
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(n):
        for j in range(m):
            d[i + 1, j + 1] = cost[i, j] if i == j == 0 else min(d[i, j] + 2 * cost[i, j], d[i, j + 1] + cost[i, j], d[i + 1, j] + cost[i, j])
    return d[n, m]


def weight_of(cost, last, first):
    """What a path costs that goes through first[i] to last[i] in row i."""
    total, at = 0.0, None
    for i in range(len(first)):
        for j in range(first[i], last[i] + 1):
            if at:
                assert (i - at[0], j - at[1]) in {(0, 1), (1, 0), (1, 1)}
            total += cost[i, j] * (2 if at and (i - at[0], j - at[1]) == (1, 1) else 1)
            at = i, j
    return total


def test_warp_is_cheapest():
    r = np.random.default_rng(3)
    for _ in range(60):
        cost = r.choice([0.0, 0.25, 0.6, 1.0], (int(r.integers(1, 14)), int(r.integers(1, 14))))
        first, last, total, length = aligner.warp(cost)
        assert first[0] == 0 and last[-1] == cost.shape[1] - 1
        assert weight_of(cost, last, first) == pytest.approx(plain_path(cost))
        assert length == (last - first + 1).sum() and total == pytest.approx(sum(cost[i, j] for i in range(len(first)) for j in range(first[i], last[i] + 1)))
        best = min(plain_path(cost[:, a : b + 1]) for a in range(cost.shape[1]) for b in range(a, cost.shape[1]))
        first, last, _, _ = aligner.warp(cost, True, True)
        assert weight_of(cost, last, first) == pytest.approx(best)


def test_costs_by_sound():
    a, b = list("部署师姐aF苹x"), list("属世界Avx她部")
    table = aligner.cost_table(a, b, SOUNDS)
    cost = lambda x, y: table[a.index(x), b.index(y)]
    assert cost("署", "属") == 0.25 and cost("师", "世") == 0.4 and cost("姐", "界") == 0.4 and cost("师", "属") == 0.7
    assert cost("a", "A") == 0 and cost("F", "v") == 0.6 and cost("a", "x") == 1 and cost("苹", "她") == 1 and cost("部", "部") == 0
    assert aligner.cost_table(["署"], ["属"])[0, 0] == 1
    spoken = lambda heard: aligner.align_chars("他部署了", heard, SOUNDS)[1]
    assert spoken("他部署了") == 0 < spoken("她部属了") < spoken("猫狗鸟了")


def test_cost_table_is_the_column_rule(spark):
    a = b = list("abvfVFbp部属署世师界姐他1é")
    table = aligner.cost_table(a, b, SOUNDS)
    rows = spark.createDataFrame([(i, j, x, y) for i, x in enumerate(a) for j, y in enumerate(b)], "i int, j int, x string, y string")
    for r in rows.select("i", "j", T.char_cost(F.col("x"), F.col("y"), SOUNDS).alias("c")).collect():
        assert table[r.i, r.j] == r.c, (a[r.i], b[r.j])


def test_chain():
    r = random.Random(5)
    for _ in range(200):
        n = r.randint(0, 9)
        pairs = list(zip(range(n), r.sample(range(20), n), strict=True))
        got = aligner.chain(pairs)
        assert all(x[1] < y[1] for x, y in zip(got, got[1:], strict=False)) and set(got) <= set(pairs)
        best = max((bin(s).count("1") for s in range(1 << n) if all(pairs[i][1] < pairs[j][1] for i in range(n) for j in range(i + 1, n) if s >> i & 1 and s >> j & 1)), default=0)
        assert len(got) == best


def test_stretches_cover_and_stay_short():
    for pairs, n, m in (([], 90_000, 70_000), ([(k, k + 5) for k in range(0, 50_000, 64)], 50_000, 50_500), ([], 3, 9_000_000), ([(10, 4)], 20, 20), ([], 1, 1)):
        cuts = aligner.cut_stretches(pairs, n, m)
        assert cuts[0][0] == cuts[0][2] == 0 and cuts[-1][1] == n and cuts[-1][3] == m
        assert all((a[1], a[3]) == (b[0], b[2]) for a, b in zip(cuts, cuts[1:], strict=False))
        assert all(i1 > i0 and ((i1 - i0) * (j1 - j0) <= 1.1 * aligner.CELLS or i1 - i0 == 1) for i0, i1, j0, j1 in cuts)
    assert max(c[1] - c[0] for c in aligner.cut_stretches([(k, k) for k in range(0, 50_000, 64)], 50_000, 50_000)) <= aligner.STRETCH + 64


def words(r, n):
    return [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(7)) + "." for _ in range(n)]


def test_texts_that_drift_apart(spark):
    """An intro nobody wrote down, a passage left out on each side, and an end that wasn't spoken: far more than a band."""
    r = random.Random(7)
    lines = words(r, 300)
    heard, written = [*words(r, 90), *lines[:100], *words(r, 60), *lines[100:150], *lines[210:]], [*lines[:290], *words(r, 20)]
    rec = spark.createDataFrame([(1, i, i * 2000, i * 2000 + 1800, x) for i, x in enumerate(heard)], REC)
    own = spark.createDataFrame([(1, i, x) for i, x in enumerate(written)], OWN)
    heard_rows, own_rows = aligner.placed(rec), aligner.placed(own)
    paths = aligner.warped(heard_rows, own_rows).cache()
    assert paths.count() >= 6 and paths.agg(F.max("length")).first()[0] < 40_000
    chars = aligner.char_times(heard_rows, own_rows, paths)
    got = {x.seg_idx: x for x in chars.groupBy("seg_idx").agg(F.min_by("at_ms", "pos").alias("a"), F.max_by("word_end", "pos").alias("b"), F.count("*").alias("n")).collect()}
    assert len(got) == len(written) and all(got[i].n == len(x.replace(" ", "").rstrip(".")) for i, x in enumerate(written))
    at = {x: i for i, x in enumerate(heard)}
    common = [(got[i], at[x]) for i, x in enumerate(written) if x in at]
    near = [abs(x.a - 2000 * k) <= 300 and abs(x.b - 2000 * k - 1800) <= 300 for x, k in common]
    assert len(common) == 230 and sum(near) >= 222  # beside a passage that only one side has, a row's edge can be taken along
    rows = aligner.align_text(rec, own, at_pauses=False).orderBy("seg_idx").collect()
    assert [x.text for x in rows] == written and all(a.end_ms <= b.start_ms for a, b in zip(rows, rows[1:], strict=False))


def test_identical_texts_keep_their_times(spark):
    rows = [(t, i, i * 1000, i * 1000 + 900, x) for t in (1, 2) for i, x in enumerate(words(random.Random(t), 40 * t))]
    rec = spark.createDataFrame(rows, REC)
    got = aligner.align_text(rec, rec.select("track_id", "seg_idx", "text"), at_pauses=False).orderBy("track_id", "seg_idx").collect()
    assert [(x.track_id, x.start_ms, x.end_ms, x.text, x.match_rate) for x in got] == [(t, a, b, x, 1.0) for t, _, a, b, x in rows]


def test_pauses_cut_a_sentence_and_tiny_parts_join(spark):
    said = ["one", "two", "three", "four", "five", "six"]
    starts = [0, 400, 800, 5000, 5400, 5800]
    rec = spark.createDataFrame([(1, i, s, s + 400, x) for i, (s, x) in enumerate(zip(starts, said, strict=True))], REC)
    own = spark.createDataFrame([(1, 1, "One two, three — four five six!")], OWN)
    got = aligner.align_text(rec, own).orderBy("seg_idx").collect()
    assert [x.text for x in got] == ["One two, three —", "four five six!"]
    assert got[0].start_ms == 0 and got[0].end_ms == 1200 and 5000 <= got[1].start_ms < 5400 and got[1].end_ms == 6200
    assert [x.text for x in aligner.align_text(rec, own, at_pauses=False).collect()] == ["One two, three — four five six!"]


def test_homophones_match_better(spark):
    own = spark.createDataFrame([(1, 1, "他部署了"), (2, 1, "他部署了")], OWN)
    rec = spark.createDataFrame([(1, 1, 0, 2000, "她部属了"), (2, 1, 0, 2000, "猫狗鸟了")], REC)
    rate = {x.track_id: x.match_rate for x in aligner.align_text(rec, own, SOUNDS).collect()}
    assert rate[1] > 0.8 > rate[2]


def test_odd_rows(spark):
    rec = spark.createDataFrame([(1, 1, 0, 1000, "你好世界"), (2, 1, 0, 1000, None), (3, 1, 0, 1000, "only heard"), (5, 1, 0, 900, "a 2.5 b"), (5, 1, 0, 900, "a 2.5 b")], REC)
    own = spark.createDataFrame([(1, 1, "你好世界啊"), (1, 2, "。"), (1, 3, None), (2, 1, "text"), (4, 1, "only written"), (5, 1, "a 2.5 b a 2.5 b")], OWN).withColumn("part", F.lit("x"))
    got = aligner.align_text(rec, own, at_pauses=False).orderBy("track_id").collect()
    assert [(x.track_id, x.text) for x in got] == [(1, "你好世界啊"), (5, "a 2.5 b a 2.5 b")]
    assert 0 <= got[0].start_ms < got[0].end_ms <= 1500
    assert aligner.align_text(rec.limit(0), own).count() == 0 and aligner.align_text(rec, own.limit(0)).count() == 0


def test_plans_hold_each_step_once(spark):
    rec = spark.createDataFrame([(1, 1, 0, 1000, "so we went home"), (1, 2, 1000, 1900, "and slept")], "track_id int, seg_idx long, start_ms long, end_ms long, text string")
    got = aligner.align_text(rec, rec.select("track_id", "seg_idx", "text"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") < 40 and plan.count("InPandas") < 3
    assert [(x.text, x.start_ms, x.end_ms) for x in got.orderBy("seg_idx").collect()] == [("so we went home", 0, 1000), ("and slept", 1000, 1900)]


def test_characters_meet_their_times_as_arrays_without_a_broadcast(spark):
    """Long sentences over several pieces and short ones; nothing large goes through the driver, whatever Spark expects."""
    r = random.Random(11)
    lines = ["".join(r.choice("abcdefghijklmnop") for _ in range(n)) for n in (2 * aligner.PIECE + 5, 1, 700, 3)]
    rec = spark.createDataFrame([(1, i, i * 100_000, i * 100_000 + 9000, x) for i, x in enumerate(lines)], REC)
    own = spark.createDataFrame([(1, 0, lines[0][:10]), (1, 1, lines[0][10:] + lines[1] + lines[2]), (1, 2, lines[3])], OWN)
    heard_rows, own_rows = aligner.placed(rec), aligner.placed(own)
    chars = aligner.char_times(heard_rows, own_rows, aligner.warped(heard_rows, own_rows))
    got = sorted((x.i, x.at_ms, x.word_end) for x in chars.collect())
    assert "Broadcast" not in chars._jdf.queryExecution().executedPlan().toString()  # as it was run at last
    want = [(i * 100_000 + 9000.0 if k == len(x) - 1 else i * 100_000 + k / len(x) * 9000, i * 100_000 + 9000) for i, x in enumerate(lines) for k in range(len(x))]
    assert got == [(i, *x) for i, x in enumerate(want)]


def test_equal_texts_take_the_diagonal():
    r = random.Random(2)
    for ends in ((False, False), (True, False), (False, True), (True, True)):
        text = "".join(r.choice("abA") for _ in range(60))
        table = aligner.cost_table(list(text), list(text))
        _, last, total, length = aligner.warp(table, *ends)
        at, cost, n = aligner.align_chars(text, text, None, *ends)
        assert list(at) == list(last) and (cost, n) == (total, length)


def test_aligned_rows_are_made_without_a_broadcast_and_without_a_call_of_pandas_each(spark):
    r = random.Random(13)
    rec = spark.createDataFrame([(t, i, i * 1000, i * 1000 + 900, x) for t in range(3) for i, x in enumerate(words(r, 30))], REC)
    got = aligner.align_text(rec, rec.select("track_id", "seg_idx", "text"))
    rows = got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(rows) >= 90 and "Broadcast" not in plan and "InPandas" not in plan


def test_overlaps_are_those_of_a_plain_fold(spark):
    r = random.Random(17)
    rows = [(t, i, r.randint(0, 90_000), None, "x" * r.randint(0, 30)) for t in range(40) for i in range(r.randint(1, 60))]
    rows = [(t, i, s, s + r.randint(-500, 9000), x) for t, i, s, _, x in rows]
    want = []
    for t in range(40):
        own, before = sorted((s, i, e, x) for k, i, s, e, x in rows if k == t), None
        for k, (s, i, e, x) in enumerate(own):
            s = s if before is None else max(s, before)
            e = min([e, s + max(3000, 1000 + 250 * len(x)), *([own[k + 1][0]] if k + 1 < len(own) else [])])
            before = e if e > s else s + max(1000, 150 * len(x))
            want.append((t, i, s, before))
    segments = spark.createDataFrame(rows, REC).repartition(3)
    got = polish.fix_overlaps(segments)
    assert sorted(tuple(x) for x in got.select("track_id", "seg_idx", "start_ms", "end_ms").collect()) == sorted(want)
    empty = polish.fix_overlaps(spark.createDataFrame([(1, 1, None, 5, "a"), (1, 2, 3, None, "b"), (1, 3, 9, 20, None)], REC)).orderBy("seg_idx").collect()
    assert [x.seg_idx for x in empty] == [1, 2, 3]
