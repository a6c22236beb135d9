"""Merging recognised chunks that overlap in time: all neighbours of all tracks in one plan.

The end of a chunk and the start of the next one, overlap_ms long, are laid over each other in every step, and the step
with most equal rows per place wins. Tracks of single words take equal texts: an equi-join and a histogram of diagonals.
Other tracks take similar texts: a row holds both windows of two neighbours, so its size is bounded by overlap_ms of speech.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.functions import text as T
from cueframe.sources.tables import cut

HITS = "array<struct<shift:bigint,matches:bigint>>"


def similar_steps(ratio: float):
    """A function of two lists of texts: how many pairs in step have a matching ratio above `ratio`, by step."""

    @F.pandas_udf(HITS)
    def steps(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(a: list[str], b: list[str]) -> list[dict]:
            found: dict[int, int] = {}
            for r, y in enumerate(b):
                matcher = difflib.SequenceMatcher(None, "", y)
                for l, x in enumerate(a):  # noqa: E741
                    matcher.set_seq1(x)
                    if matcher.real_quick_ratio() > ratio and matcher.quick_ratio() > ratio and matcher.ratio() > ratio:
                        found[len(a) - l + r] = found.get(len(a) - l + r, 0) + 1
            return [{"shift": s, "matches": m} for s, m in sorted(found.items())]

        return pd.Series([one(list(a), list(b)) for a, b in zip(left, right, strict=True)])

    return steps


def windows(rows: DataFrame, overlap_ms: int) -> DataFrame:
    """rows (track_id, chunk, seg_idx, start_ms, end_ms, text) with k, their place in the chunk, n rows in all, and how many
    of its last (tail) and first (head) rows lie in its last and first overlap_ms."""
    by = Window.partitionBy("track_id", "chunk")
    at = rows.withColumn("k", F.row_number().over(by.orderBy("start_ms", "seg_idx")) - 1)
    at = at.withColumns({"n": F.count("*").over(by), "first": F.min("start_ms").over(by), "last": F.max_by("end_ms", "k").over(by)})
    before = F.max(F.when(F.col("start_ms") < F.col("last") - overlap_ms, F.col("k"))).over(by)
    beyond = F.min(F.when(F.col("end_ms") > F.col("first") + overlap_ms, F.col("k"))).over(by)
    return at.withColumns({"tail": F.col("n") - 1 - F.coalesce(before, F.lit(-1)), "head": F.coalesce(beyond, F.col("n"))})


def align(left: DataFrame, right: DataFrame, ratio: float = 0.7, least: int = 2) -> DataFrame:
    """(track_id, chunk, shift, matches, score, tail, head): of each pair of windows the step with the best score.

    left: (track_id, chunk, words, l, tail, text), right: (track_id, chunk, r, head, text), where chunk is the left one's and
    words says whether texts must be equal. Step i places the first i rows of right's against the end of left's;
    score = matches / i + i / 10000 with at least `least` matches, and the smaller i wins a tie.
    """
    key = ["track_id", "chunk"]
    equal = left.where("words").join(right, [*key, "text"]).groupBy(*key, (F.col("tail") - F.col("l") + F.col("r")).alias("shift"))
    equal = equal.agg(F.count("*").alias("matches"), F.first("tail").alias("tail"), F.first("head").alias("head"))

    def listed(df: DataFrame, place: str, size: str, name: str) -> DataFrame:
        texts = F.transform(F.array_sort(F.collect_list(F.struct(place, F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
        return df.groupBy(*key).agg(texts.alias(name), F.first(size).alias(size))

    both = listed(left.where("not words"), "l", "tail", "a").join(listed(right, "r", "head", "b"), key)
    like = both.select(*key, "tail", "head", F.explode(similar_steps(ratio)("a", "b")).alias("x")).select(*key, "x.shift", "x.matches", "tail", "head")
    hits = equal.select(*key, "shift", "matches", "tail", "head").unionByName(like).where(F.col("matches") >= least)
    hits = hits.withColumn("score", F.col("matches") / F.col("shift") + F.col("shift") / 10000.0)
    best = hits.groupBy(*key).agg(F.max(F.struct("score", (-F.col("shift")).alias("less"), "matches", "tail", "head")).alias("b"))
    return best.select(*key, (-F.col("b.less")).alias("shift"), "b.matches", "b.score", "b.tail", "b.head")


def _middle(shift: Column, tail: Column, head: Column) -> Column:
    """The middle of the aligned stretch, as a place in the left window."""
    low, high = F.greatest(F.lit(0), tail - shift), F.least(tail, tail + head - shift)
    return F.floor((low + high) / 2)


def merge_chunks(rows: DataFrame, overlap_ms: int = 10_000, ratio: float = 0.7, share: float = 0.8) -> DataFrame:
    """(track_id, seg_idx, start_ms, end_ms, text) from rows (track_id, chunk, offset_ms, seg_idx, start_ms, end_ms, text).

    Of two neighbours that align, the left one stays up to the middle of the aligned stretch and the right one from there
    on. Where they don't, the left one stays up to its last row that ends before the right one starts, if there is one.
    A window without rows cuts nothing. A track with a chunk of which `share` of the rows are single words takes equal
    texts only. Every pair is taken by itself, which is merging from left to right as long as the two windows of a chunk
    don't meet. Chunks without rows aren't there; no rows give no rows.
    """
    key = ["track_id", "chunk"]
    moved = {c: F.col(c) + F.col("offset_ms") for c in ("start_ms", "end_ms")}
    at = cut(windows(rows.select(*key, "seg_idx", *(x.alias(c) for c, x in moved.items()), "text"), overlap_ms))  # read four times below
    chunks = at.groupBy(*key).agg(F.min("start_ms").alias("first"), F.max(F.least("tail", F.lit(1))).alias("some_tail"), F.max(F.least("head", F.lit(1))).alias("some_head"), F.avg(F.coalesce(T.is_word_level(F.col("text")), F.lit(False)).cast("int")).alias("single"))
    after = Window.partitionBy("track_id").orderBy("chunk")
    chunks = chunks.withColumns({"following": F.lead("chunk").over(after), "follows": F.lead("first").over(after), "some_head": F.lead("some_head").over(after), "words": F.max(F.col("single") >= share).over(Window.partitionBy("track_id"))})
    pairs = chunks.where("following is not null").select(*key, "following", "follows", "words", (F.col("some_tail") * F.col("some_head") > 0).alias("met"))
    left = at.where(F.col("k") >= F.col("n") - F.col("tail")).join(pairs, key).select(*key, "words", (F.col("k") - F.col("n") + F.col("tail")).alias("l"), "tail", "text")
    right = at.where(F.col("k") < F.col("head")).withColumnRenamed("chunk", "following").join(pairs, ["track_id", "following"]).select(*key, F.col("k").alias("r"), "head", "text")
    best = align(left, right, ratio).withColumn("at", _middle(F.col("shift"), F.col("tail"), F.col("head")))
    cuts = pairs.join(best.select(*key, "tail", "at", (F.col("at") + F.col("shift") - F.col("tail")).alias("from")), key, "left")
    ends = cuts.select(*key, "at", F.col("tail").alias("_tail"), F.when(F.col("at").isNull() & F.col("met"), F.col("follows")).alias("until"))
    starts = cuts.select("track_id", F.col("following").alias("chunk"), "from")
    marks = ends.unionByName(starts, allowMissingColumns=True).groupBy(*key).agg(*(F.max(c).alias(c) for c in ("at", "_tail", "until", "from")))
    out = at.join(marks, key, "left")
    by_time = F.max(F.when(F.col("end_ms") <= F.col("until"), F.col("k") + 1)).over(Window.partitionBy(*key))
    stop = F.coalesce(F.col("n") - F.col("_tail") + F.col("at"), by_time, F.col("n"))
    out = out.withColumn("stop", stop).where((F.col("k") < F.col("stop")) & (F.col("k") >= F.coalesce("from", F.lit(0))))
    number = F.row_number().over(Window.partitionBy("track_id").orderBy("start_ms", "chunk", "k"))
    return out.select("track_id", number.alias("seg_idx"), "start_ms", "end_ms", "text")
