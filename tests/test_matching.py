"""Lines cut, paired and matched, words counted and rows merged, against the rules stated plainly."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from cueframe.functions import text as T
from cueframe.operators import edits, polish, segmenter
from cueframe.sources import subtitles

ROWS = "track_id long, seg_idx long, start_ms long, end_ms long, text string"


def test_lines_by_sentences_and_clauses():
    assert T.sentence_lines("你好。\n世界！\n测试", 30) == ["你好。", "世界！", "测试"]
    assert T.sentence_lines("你好。世界！", 30) == ["你好。世界！"]
    assert T.sentence_lines("Version 1.0 was released in 2020. Next came 2.0.", 45) == ["Version 1.0 was released in 2020.", "Next came 2.0."]
    assert T.sentence_lines("The cave is 2.5 kilometers long and 13.5 meters deep.", 80) == ["The cave is 2.5 kilometers long and 13.5 meters deep."]
    assert "2.5" in " ".join(T.sentence_lines("About 2.5 kilometers from Tulum", 30))
    lines = T.sentence_lines("这是一段比较长的测试文本需要被切分" * 3, 10)
    assert len(lines) > 1 and max(map(len, lines)) <= 10
    r = random.Random(3)
    for _ in range(400):
        text = "".join(r.choice(["ab", "c", " ", "，", ", ", ".", "。", "! ", "\n", "1.5", "word", "、", "中文"]) for _ in range(r.randint(0, 40)))
        for limit in (1, 2, 9, 10, 11, 30):
            lines = T.sentence_lines(text, limit)
            assert all(0 < len(x) <= limit and x == x.strip() for x in lines), (text, limit, lines)
            assert "".join("".join(lines).split()) == "".join(text.split())


def test_stretches_break_at_spaces():
    assert T.sentence_lines("aaaa bbbb cccc dddd eeee", 12) == ["aaaa bbbb", "cccc dddd", "eeee"]
    assert T.sentence_lines("aaaaaaaaaaaaaaaa bb", 12) == ["a" * 12, "aaaa bb"]
    assert T.sentence_lines("short one, then a clause that is far too long for it, end", 20) == ["short one,", "then a clause that", "is far too long for", "it, end"]


def test_alike_lines_part_a_block():
    assert edits.beside(list("abcd"), list("abcd")) == [0, 1, 2, 3]
    assert edits.beside(["ab", "b", "c", "d", "e", "f"], ["a", "b", "c", "d", "f"]) == [0, 1, 2, 3, None, 4]
    source, target = ["the first line", "something else", "the very last line"], ["a new one", "The first line!", "the very last lines"]
    assert edits.beside(source, target) == [1, None, 2]
    assert edits.beside(["apple", "banana", "cherry"], ["dog", "elephant", "fox"]) == [0, 1, 2]
    assert edits.beside([], ["x"]) == [] and edits.beside(["x"], []) == [None]
    assert edits.beside(["你好", "世界", "今天", "天气"], ["你好", "世界", "天气"]) == [0, 1, None, 3 - 1]


def test_pairs_ascend_and_hold_the_best():
    r = random.Random(4)
    for _ in range(150):
        a, b = ([" ".join(r.choices(["alpha", "beta", "gamma", "delta", "eps"], k=4)) for _ in range(r.randint(1, 6))] for _ in range(2))
        got = edits.beside(a, b)
        places = [x for x in got if x is not None]
        assert places == sorted(set(places))
        if not set(a) & set(b):
            best = max(difflib.SequenceMatcher(None, x, y).ratio() for x in a for y in b)
            found = max((difflib.SequenceMatcher(None, a[i], b[j]).ratio() for i, j in enumerate(got) if j is not None), default=0)
            assert found == best or best < edits.ALIKE


def test_pairs_of_null_batches(spark):
    rows = spark.createDataFrame([(1, 0, None, ["a"]), (1, 1, ["a"], None), (1, 2, [], [])], "track_id int, batch int, source array<string>, target array<string>")
    assert [tuple(x) for x in edits.pair_lines(rows).collect()] == [(1, 1, 0, "a", None)]


def test_counts_of_plain_strings(spark):
    r = random.Random(5)
    texts = ["", " ", "world,next,more,", "a你好", "你好 ab", "한 글", *("".join(r.choice("ab 你好,ก \t1") for _ in range(r.randint(0, 12))) for _ in range(200))]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.count_words(F.col("t")).alias("n"), T.is_mainly_cjk(F.col("t")).alias("c")).collect()
    assert all((T.word_count(x.t), T.mainly_cjk(x.t)) == (x.n, x.c) for x in got)


def test_sql_functions_are_the_columns(spark):
    T.register(spark)
    texts = ["", " ", "world,next,more,", "a你好", "你好 ab", "word", "中", "don't stop", "2.5 and 1.0.0.", "«q»", "...", "привет", "a b", "你好吗"]
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").createOrReplaceTempView("said")
    columns = {"cue_words": T.count_words, "is_mainly_cjk": T.is_mainly_cjk, "is_space_separated": T.is_space_separated, "is_word_level": T.is_word_level, "is_pure_punctuation": T.is_pure_punctuation, "aligned_text": T.remove_punctuation}
    calls = ", ".join(f"{f}(t) AS {f}" for f in columns)
    sql = spark.sql(f"SELECT i, {calls} FROM said ORDER BY i").collect()
    own = spark.table("said").select("i", *(f(F.col("t")).alias(n) for n, f in columns.items())).orderBy("i").collect()
    assert sql == own
    words = spark.sql("SELECT i, pos, word FROM said, LATERAL cue_tokens(t)").collect()
    want = spark.table("said").select("i", F.posexplode(F.regexp_extract_all("t", F.lit(T.TOKEN), F.lit(0))).alias("pos", "word")).collect()
    assert sorted(words) == sorted(want) and len(words) > 12


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "a.SRT").write_text("1\n00:00:01,000 --> 00:00:02,000\nhello\n\n")
    assert [x.text for x in subtitles.read_subtitles(spark, str(tmp_path)).collect()] == ["hello"]
    (tmp_path / "b.txt").write_text("x")
    with pytest.raises(ValueError, match="b.txt"):
        subtitles.read_subtitles(spark, str(tmp_path))
    assert subtitles.read_subtitles(spark, str(tmp_path), "skip").count() == 1


def test_words_that_stick_together_count_once(spark):
    words = ["one,"] * 20
    rows = spark.createDataFrame([(1, i, i * 100, i * 100 + 90, w) for i, w in enumerate(words)], ROWS)
    assert [x.text for x in segmenter.segment_words(rows).collect()] == ["one," * 20]


def test_script_is_asked_again(spark):
    rows = [(1, 1, 0, 100, "a"), (1, 2, 150, 250, "你好吗"), (1, 3, 300, 400, "好")]
    assert [x.text for x in polish.merge_short(spark.createDataFrame(rows, ROWS)).collect()] == ["a 你好吗好"]


@pytest.mark.parametrize("seed", range(3))
def test_merges_equal_the_plain_rule(spark, seed):
    r = random.Random(seed)
    rows, at = [], 0
    for i in range(120):
        at += r.choice([0, 50, 250, 450, 600])
        rows.append((1, i, at, at + 300, " ".join(r.choices(["word", "你好", "x", "中"], k=r.randint(1, 6)))))
        at += 300
    want = [list(x) for x in rows]
    i = 0
    while i + 1 < len(want):
        a, b = want[i], want[i + 1]
        n, m, cjk = T.word_count(a[4]), T.word_count(b[4]), T.mainly_cjk(a[4])
        gap = abs(b[2] - a[3])
        if n + m <= (25 if cjk else 18) and (gap < 200 and min(n, m) < 5 or gap < 500 and min(n, m) < 3):
            a[4] += ("" if cjk else " ") + b[4]
            a[3] = b[3]
            del want[i + 1]
        else:
            i += 1
    got = polish.merge_short(spark.createDataFrame(rows, ROWS)).orderBy("seg_idx").collect()
    assert [[*x] for x in got] == want


def test_equal_runs_are_found_without_bounds(monkeypatch):
    words = [w + " " for w in "so we went home . because it was late we went home".split()]
    want = {(s, at): edits.best_run(s, words, at) for s in ("we went home", "zz late", "it was") for at in (0, 2)}
    assert want["we went home", 0] == (1, 3) and want["we went home", 2] == (9, 3)
    monkeypatch.setattr(edits, "_bounds", None)  # not asked for
    assert edits.best_run("We  went home", words, 0) == (1, 3) and edits.best_run("we went home", words, 2) == (9, 3)


def test_runs_are_folded_whole_however_batches_are_cut(spark):
    """Runs that several batches hold, tracks of one word, and a track without a number; a task folds what it reads in order."""
    rows = [(t, i, i * 400 + (9000 if i > 30 else 0), i * 400 + 300 + (9000 if i > 30 else 0), f"w{i}" + ("," if i % 7 == 6 else "")) for t in (1, 2, None) for i in range(60)] + [(3, 0, 5, 9, "alone")]
    df = spark.createDataFrame(rows, "track_id int, seg_idx long, start_ms long, end_ms long, text string")
    plan = segmenter.segment_words(df)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("Exchange") <= 3  # not a call of Python for each run
    want = sorted(map(str, segmenter.segment_words(df).collect()))
    assert {x.track_id for x in segmenter.segment_words(df).collect()} == {1, 2, 3, None} and "alone" in "".join(want)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sorted(map(str, segmenter.segment_words(df).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_likeness_is_that_of_difflib():
    r = random.Random(23)
    for k in range(3000):
        a, b = ("".join(r.choice("ab c" if k % 2 else "abcdefg hij") for _ in range(r.randint(0, 70))) for _ in range(2))
        b = b if k % 3 else a[: len(a) // 2] + b[:4] + a[len(a) // 2 + 3 :]
        assert edits.likeness(a, b) == difflib.SequenceMatcher(None, a, b).ratio(), (a, b)
    long = "abc " * 80
    assert edits.likeness("abc abd " * 30, long) == difflib.SequenceMatcher(None, "abc abd " * 30, long).ratio()


def test_few_runs_are_compared(monkeypatch):
    """One with all letters but a full stop is compared first, and what its likeness leaves out isn't."""
    r = random.Random(29)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) + " " for _ in range(300)]
    compared, own, real = [], edits.Words(words), edits.likeness
    monkeypatch.setattr(edits, "likeness", lambda a, b: compared.append(b) or real(a, b))
    for at in range(0, 280, 7):
        assert edits.best_run("".join(words[at : at + 9]).strip() + ".", own, at) == (at, min(9, 300 - at))
    assert len(compared) == 40


def test_sentences_are_matched_as_by_trying_all_runs(spark):
    """Batches with changed and foreign sentences, without words, and without sentences, however they are dealt out."""
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcde中ß") for _ in range(r.randint(1, 5)))
    words, lines, want = [], [], {}
    for b in range(12):
        own = [word() + r.choice((" ", " ", "")) for _ in range(0 if b == 5 else r.randint(1, 40))]
        said, at = [], 0
        while at < len(own) and b != 6:
            n = r.randint(1, 6)
            said.append(r.choice(("".join(own[at : at + n]) + r.choice((".", "", " x")), "".join(own[at : at + n]).upper(), "zzz qqq")))
            at += n
        said += ["abc"] if b == 5 else []
        words += [(1, b, k * 3, w) for k, w in enumerate(own)]
        lines += [(1, b, k * 2, s) for k, s in enumerate(said)]
        at, shift, missed = 0, 30, 0
        for k, s in enumerate(said):
            plain = " ".join(s.lower().split())
            n, best, found = T.word_count(plain), 0.0, None
            for size in sorted(range(max(1, n // 2), min(2 * n, len(own) - at) + 1), key=lambda x: abs(x - n)):
                for first in range(at, min(at + shift + 1, len(own) - size + 1)):
                    ratio = difflib.SequenceMatcher(None, plain, " ".join("".join(own[first : first + size]).lower().split())).ratio()
                    best, found = (ratio, (first, size)) if ratio > best else (best, found)
            found = found if best >= 0.5 and missed <= 5 else None
            want[b, k * 2] = (found[0] * 3, found[1]) if found else (None, None)
            missed, at, shift = (missed, sum(found), 30) if found else (missed + 1, min(at + 1, max(0, len(own) - 1)), 100)
    kinds = "track_id int, batch long, seg_idx int, text string"
    got = edits.match_sentences(spark.createDataFrame(words, kinds).repartition(3), spark.createDataFrame(lines, kinds).repartition(2))
    assert {(x.batch, x.seg_idx): (x.first_word, x.words) for x in got.collect()} == want
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()  # not a call of pandas each
