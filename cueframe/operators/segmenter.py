"""Cutting word rows into readable segments by rules: gaps, connectives, and the longest pauses of what is too long.

Each rule depends on the cuts before it, so a run of words is folded in Python; Spark orders the words of each track, and a
task folds run after run of what it reads. A run ends at a gap wider than any rule allows, found by a window, and at a
change of speaker; a track without such a gap is one run.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueframe.functions import text as T
from cueframe.operators import timeline

#: Words before which, and after which, a long run may be cut.
BEFORE_WORDS = (
    "and", "or", "but", "if", "then", "because", "as", "until", "while", "what", "when", "where", "nor", "yet", "so", "for", "however", "moreover",
    "和", "及", "与", "但", "而", "或", "因", "我", "你", "他", "她", "它", "咱", "您", "这", "那", "哪",
)
AFTER_WORDS = (
    ".", ",", "!", "?", "。", "，", "！", "？", "的", "了", "着", "过", "吗", "呢", "吧", "啊", "呀", "嘛", "啦",
    "mine", "yours", "hers", "its", "ours", "theirs", "either", "neither",
)


def by_gaps(start: list[int], end: list[int], max_gap: int, adaptive: bool = True) -> list[int]:
    """First places of groups: gaps above max_gap, or above three times the mean of the last five, itself among them, in a group of over five."""
    cuts, recent = [0], []
    for i in range(1, len(start)):
        gap = start[i] - end[i - 1]
        recent = [*recent[-4:], gap]
        wide = adaptive and len(recent) == 5 and i - cuts[-1] > 5 and gap > 3 * sum(recent) / 5
        if gap > max_gap or wide:
            cuts.append(i)
            recent = []
    return cuts if start else []


def by_connectives(words: list[str], limits: list[int] | int) -> list[int]:
    """Cuts before a connective once 60 % of the word's limit is reached, behind a final word once 40 % is."""
    cuts, at = [0], 0
    for i, limit in enumerate([limits] * len(words) if isinstance(limits, int) else limits):
        if i - at >= int(limit * 0.6) and words[i].lower().startswith(BEFORE_WORDS) or i and i - at >= int(limit * 0.4) and words[i - 1].lower().endswith(AFTER_WORDS):
            cuts.append(i)
            at = i
    return sorted({*cuts}) if words else []


def by_longest_pause(start: list[int], end: list[int], fits, low: int = 0) -> list[int]:
    """Cuts of a run at its longest inner pause, again and again, until it fits (a number of words, or a function of first and
    end) or has under four words; of equal pauses behind the middle word."""
    todo, cuts = [(0, len(start))], {0} if start else set()
    while todo:
        a, b = todo.pop()
        n = b - a
        if n < 4 or (n <= fits if isinstance(fits, int) else fits(a, b)):
            continue
        gaps = [start[i + 1] - end[i] for i in range(a, b - 1)]
        inner = range(max(n // 6, 1), min(5 * n // 6, n - 2))
        k = n // 2 if len(set(gaps)) == 1 else max(inner, key=gaps.__getitem__, default=n // 2)
        at = a + k + 1
        cuts.add(at)
        todo += [(a, at), (at, b)]
    return sorted(c + low for c in cuts)


def _folded(start: list[int], end: list[int], words: list[str], own_cjk: list[int], own_solid: list[int], limit: int, limit_cjk: int, max_gap: int) -> list[int]:
    """The first places of the segments of one run; own_cjk and own_solid count the words' own characters.

    Words are counted in the joined text of a stretch: where no space is put between two, they are one.
    """
    cjk, solid = (list(accumulate(x, initial=0)) for x in (own_cjk, own_solid))

    def most(a: int, b: int) -> int:
        return limit_cjk if 2 * (cjk[b] - cjk[a]) > solid[b] - solid[a] else limit

    def fits(a: int, b: int) -> bool:
        return T.word_count("".join(words[a:b])) <= most(a, b)

    cuts: set[int] = set()
    edges = [*by_gaps(start, end, max_gap), len(words)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        inner = [a, b] if fits(a, b) else [*(a + c for c in by_connectives(words[a:b], [most(i, i + 1) for i in range(a, b)])), b]
        for c, d in zip(inner[:-1], inner[1:], strict=True):
            cuts.update(by_longest_pause(start[c:d], end[c:d], lambda x, y, c=c: fits(c + x, c + y), c))
    return sorted(cuts)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A stream of ordered rows, cut so that runs, which begin at rows marked new, stay whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = [i for i, x in enumerate(batch.column("new").to_pylist()) if x]
        if at and (held or at[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, at[-1])])
            held = []
        held.append(batch.slice(at[-1]) if at else batch)
    if held:
        yield pa.Table.from_batches(held)


def segment_words(words: DataFrame, limit: int = 18, max_gap_ms: int = 500, bound_gap_ms: int = 1500, limit_cjk: int = 25, lower: bool = False) -> DataFrame:
    """Segments (track_id, seg_idx, start_ms, end_ms, text) from word rows; with a speaker column none crosses speakers.

    Words are taken by start; a segment spans its words from the earliest start to the latest end. lower: words of
    scripts with spaces are lower-cased.
    """
    rows = words.where(~T.is_pure_punctuation(F.col("text"))).repartition("track_id")
    rows = rows.withColumn("seg_idx", F.row_number().over(Window.partitionBy("track_id").orderBy("start_ms", "seg_idx")).cast("long"))
    rows = timeline.islands(rows, bound_gap_ms)
    rows = timeline.run_ids(rows, "speaker") if "speaker" in words.columns else rows.withColumn("run", F.lit(0).cast("long"))
    bare = F.lower(T.strip(F.col("text"))) if lower else T.strip(F.col("text"))
    rows = rows.withColumn("text", F.when(T.is_space_separated(F.col("text")), F.concat(bare, F.lit(" "))).otherwise(F.col("text")))
    own = {"cjk": F.regexp_count("text", F.lit(T.NO_SPACE)), "solid": F.length(F.regexp_replace("text", r"(?U)\s+", ""))}
    here = F.struct("island", "run")
    rows = rows.withColumn("new", ~here.eqNullSafe(F.lag(here).over(timeline.track()))).withColumns(own)
    rows = rows.select("track_id", "new", "seg_idx", "start_ms", "end_ms", "text", *own).sortWithinPartitions("track_id", "seg_idx")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lambda xs: [x for x in xs if x == x]
        for t in _runs(batches):
            start, end = ([float("nan") if x is None else x for x in t[c].to_pylist()] for c in ("start_ms", "end_ms"))
            text, cjk, solid = (t[c].to_pylist() for c in ("text", "cjk", "solid"))
            edges = [*(i for i, x in enumerate(t["new"].to_pylist()) if x), len(t)]
            first: list[int] = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                first += [a + i for i in _folded(start[a:b], end[a:b], text[a:b], cjk[a:b], solid[a:b], limit, limit_cjk, max_gap_ms)]
            parts = list(zip(first, [*first[1:], len(t)], strict=True))
            own = t.select(["track_id", "seg_idx"]).take(pa.array(first, pa.int64())).combine_chunks()
            yield from pa.table({
                "track_id": own["track_id"], "first": own["seg_idx"],
                "start_ms": pa.array([min(known(start[a:b]), default=None) for a, b in parts], pa.int64()),
                "end_ms": pa.array([max(known(end[a:b]), default=None) for a, b in parts], pa.int64()),
                "text": pa.array(["".join(text[a:b]).strip() for a, b in parts], pa.string()),
            }).to_batches()

    kind = words.schema["track_id"].dataType.simpleString()
    cut = rows.mapInArrow(fold, f"track_id {kind}, first long, start_ms long, end_ms long, text string")
    return cut.withColumnRenamed("first", "seg_idx").transform(timeline.clean)


def cut_points(words: DataFrame, batch_words: int = 500, reach: int = 30) -> DataFrame:
    """Where to cut tracks of many words into batches: near every n-th row, at the widest pause within reach rows."""
    n = F.count("*").over(Window.partitionBy("track_id"))
    rows = words.withColumn("_n", n).withColumn("_parts", F.ceil(F.col("_n") / batch_words).cast("int")).withColumn("_gap", F.lead("start_ms").over(timeline.track()) - F.col("end_ms"))
    marks = F.filter(F.transform(F.sequence(F.lit(1), F.greatest("_parts", F.lit(1))), lambda i: F.floor(i * F.col("_n") / F.col("_parts"))), lambda m: (m < F.col("_n")) & (F.abs(m - F.col("seg_idx")) <= reach))
    near = rows.where("_parts > 1").select("track_id", "seg_idx", "_gap", F.explode(marks).alias("mark"))
    return near.groupBy("track_id", "mark").agg(F.max(F.struct("_gap", (-F.col("seg_idx")).alias("less"))).alias("b")).select("track_id", "mark", (-F.col("b.less")).alias("cut_after"), F.col("b._gap").alias("gap_ms"))
