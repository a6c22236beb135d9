"""Last repairs of aligned rows: times that are missing, rows too short to stand alone, overlaps, cuts at pauses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.functions import text as T
from cueframe.operators import timeline

#: Gaps in ms, and words, below which two short rows are one.
SHORT = ((200, 5), (500, 3))


def upper_median(values: Column) -> Column:
    """Of an array: the middle value, of an even number the upper one; null without values."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def fill_times(points: DataFrame, last_ms: Column) -> DataFrame:
    """points (track_id, seg_idx, at_ms): a missing time is half-way between the one before, as filled, and the next known.

    So the k-th of a run is the next known time less their distance over 2 ** k; it is halved k times, as doubles round in
    each step, until no step moves it. Before the first known time stands 0, behind the last one last_ms.
    """
    ahead, behind = timeline.track().rowsBetween(Window.unboundedPreceding, 0), timeline.track().rowsBetween(0, Window.unboundedFollowing)
    rows = points.withColumns({"_p": F.coalesce(F.last("at_ms", True).over(ahead), F.lit(0)), "_n": F.coalesce(F.first("at_ms", True).over(behind), last_ms)})
    rows = rows.withColumn("_known", F.count("at_ms").over(timeline.so_far()))
    missing = F.count(F.when(F.col("at_ms").isNull(), 1)).over(Window.partitionBy("track_id", "_known").orderBy("seg_idx"))
    rows = rows.withColumn("_k", missing)
    rows = rows.withColumns({"_p": F.col("_p").cast("double"), "_n": F.col("_n").cast("double")})
    # a step halves the distance, so from here on none moves a time: the distance is below a unit in the last place, or 0
    still = F.when(F.col("_p") == F.col("_n"), 1.0).otherwise(F.greatest(F.coalesce(F.log2(F.abs(F.col("_n") - F.col("_p"))) - F.log2(F.abs("_n")), F.lit(2200.0)), F.lit(0.0)) + 58)
    steps = F.sequence(F.lit(1), F.least(F.col("_k").cast("double"), still, F.lit(2200.0)).cast("int"))
    filled = F.aggregate(F.when(F.col("at_ms").isNull(), steps), F.col("_p"), lambda at, _: (at + F.col("_n")) / 2)
    return rows.withColumn("at_ms", F.when(F.col("at_ms").isNull(), filled).otherwise(F.col("at_ms").cast("double"))).drop("_p", "_n", "_known", "_k")


def pause_parts(chars: DataFrame, ratio: float = 3.0, least_ms: int = 250) -> DataFrame:
    """part of chars (track_id, seg_idx, pos, at_ms): a sentence is cut where a gap reaches `ratio` times its median gap."""
    rest = [c for c in chars.columns if c not in ("track_id", "seg_idx", "pos")]
    rows = chars.groupBy("track_id", "seg_idx").agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("_x"))
    rows = rows.withColumn("_gaps", F.transform("_x", lambda x, k: x["at_ms"] - F.get("_x", k - 1)["at_ms"]))
    rows = rows.withColumn("_m", upper_median(F.filter("_gaps", lambda g: g > 0)))
    rows = rows.select("track_id", "seg_idx", "_m", F.explode(F.arrays_zip("_x", "_gaps")).alias("_c")).select("track_id", "seg_idx", "_m", "_c._x.*", F.col("_c._gaps").alias("_gap"))
    cut = F.coalesce(F.col("_gap") >= F.greatest(F.col("_m") * ratio, F.lit(least_ms)), F.lit(False)) & F.col("_m").isNotNull()
    by = Window.partitionBy("track_id", "seg_idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("part", F.sum(cut.cast("long")).over(by)).select(*chars.columns, "part")


def merge_tiny(segments: DataFrame, least: int = 2) -> DataFrame:
    """Rows with fewer than `least` characters join the row before; a first one stays."""
    whole = F.length(T.remove_punctuation(F.col("text"))) >= least
    alone = whole | F.lag("seg_idx").over(timeline.track()).isNull()
    rows = segments.withColumn("_a", alone.cast("long")).withColumn("_group", F.sum("_a").over(timeline.so_far()))
    return timeline.merge_groups(rows, "_group", "").drop("_group")


def fix_overlaps(segments: DataFrame) -> DataFrame:
    """Rows by start, none before the end of the one before, none longer than its text allows or into the next start; a
    row without room has a length by its text.

    The rule is sequential, so it is folded in Python, over the ordered rows of a partition: what is carried from row to
    row is one end, and a track's first row carries none.
    """
    order = Window.partitionBy("track_id").orderBy("start_ms", "seg_idx")
    n = F.length(T.remove_punctuation(F.col("text")))
    rows = segments.withColumns({"_next": F.lead("start_ms").over(order), "_new": F.row_number().over(order) == 1, "_cap": F.greatest(F.lit(3000), 1000 + n * 250), "_spare": F.greatest(F.lit(1000), n * 150)})
    columns = segments.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = nan = float("nan")
        for batch in batches:
            starts, ends = [], []
            for new, s, e, following, most, extra in zip(*(batch[c].to_pylist() for c in ("_new", "start_ms", "end_ms", "_next", "_cap", "_spare")), strict=True):
                s, e = nan if s is None else s, nan if e is None else e
                s = s if new else max(s, before)
                e = min(e, s + most) if following is None else min(e, s + most, following)
                before = e if e > s else s + extra
                starts.append(s), ends.append(before)
            fresh = {"start_ms": starts, "end_ms": ends}
            yield pa.RecordBatch.from_arrays([pa.array([None if x != x else x for x in fresh[c]], batch[c].type) if c in fresh else batch[c] for c in columns], columns)

    schema = ", ".join(f"`{n}` {t}" for n, t in segments.dtypes)
    return rows.sortWithinPartitions("track_id", "start_ms", "seg_idx").mapInArrow(fold, schema)


def merge_short(segments: DataFrame, limit: int = 18, limit_cjk: int = 25) -> DataFrame:
    """Rows close to the next one join it where either is short and both fit the limit; from the front, again and again.

    What a row has grown to is asked again for its words, and for its script, which sets limit and joint. Gaps wider than
    any rule allows part a track into runs, which are folded one by one.
    """
    widest = max(g for g, _ in SHORT)
    gap = F.abs(F.col("start_ms") - F.lag("end_ms").over(timeline.track()))
    rows = segments.withColumn("_far", F.coalesce(gap >= widest, F.lit(False)).cast("long")).withColumn("_run", F.sum("_far").over(timeline.so_far()))

    def fold(run: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for track, i, s, e, text in run.sort_values("seg_idx")[["track_id", "seg_idx", "start_ms", "end_ms", "text"]].itertuples(index=False):
            if out:
                own = out[-1]
                cjk, had, n = T.mainly_cjk(own[4]), T.word_count(own[4]), T.word_count(text)
                if had + n <= (limit_cjk if cjk else limit) and any(abs(s - own[3]) < g and min(had, n) < k for g, k in SHORT):
                    own[3], own[4] = e, own[4] + ("" if cjk else " ") + text
                    continue
            out.append([track, i, s, e, text])
        return pd.DataFrame(out, columns=["track_id", "seg_idx", "start_ms", "end_ms", "text"])

    kind = segments.schema["track_id"].dataType.simpleString()
    return rows.groupBy("track_id", "_run").applyInPandas(fold, f"track_id {kind}, seg_idx long, start_ms long, end_ms long, text string")


def word_level_tracks(segments: DataFrame, share: float = 0.8) -> DataFrame:
    """word_level by track: whether at least that share of its rows is a word each."""
    return segments.groupBy("track_id").agg((F.avg(F.coalesce(T.is_word_level(F.col("text")), F.lit(False)).cast("int")) >= share).alias("word_level"))
