"""Aligning a known text to recognised segments: coarse by rare runs of characters, fine by warping, then rows with times.

Coarse: both texts of a track are laid out in pieces of equal length; runs of characters that occur once in each text are
joined, and the longest chain of them that ascends in both cuts the track into stretches. So texts may drift apart by any
amount, and no later group is longer than a stretch. Fine: each stretch is one row with two short texts, whose characters
are aligned by dynamic time warping; its costs come from a table over distinct characters, where like sounds cost less.

The chain adds the whole rest: times of characters, missing ones filled, rows cut at pauses, tiny rows joined, overlaps
repaired.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.functions import text as T
from cueframe.operators import polish, timeline
from cueframe.sources.tables import cut, small, tasks

PIECE = 4096  # characters of a piece of a text
GRAM, SAMPLE = 12, 4  # characters of a run, and the share of runs (by hash) that are looked at: one in SAMPLE
SPACING = 64  # one anchor at most in so many characters
STRETCH = 1000  # characters of a stretch, where there are anchors to cut at
CELLS = 4_000_000  # cells of a stretch's matrix; a longer one, without anchors inside, is cut evenly in both texts


# --- costs and paths -------------------------------------------------------------------------------------------------


def _sound(syllable: str | None) -> tuple[str, str, str, str]:
    """Whole, without tone, initial and final of a syllable with tone, as ni3; all empty for none."""
    plain = re.sub("[0-9]$", "", syllable or "")
    initial = re.match("(?:zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?", plain)[0]
    return syllable or "", plain, initial, plain[len(initial) :]


def cost_table(a: list[str], b: list[str], sounds: dict[str, str] | None = None) -> np.ndarray:
    """The cost of each of a's distinct characters for each of b's: the rule of text.char_cost, as arrays."""
    low_a, low_b = (np.array([c.lower() for c in x], dtype=object) for x in (a, b))
    out = np.ones((len(a), len(b)))
    alike = set(T.CONFUSABLE) | {x[::-1] for x in T.CONFUSABLE}
    for x in {x[0] for x in alike}:
        rows = low_a == x
        for y in (p[1] for p in alike if p[0] == x) if rows.any() else ():
            out[np.ix_(rows, low_b == y)] = 0.6
    if sounds:
        one, two = (np.array([_sound(sounds.get(c)) for c in x], dtype=object).reshape(-1, 4) for x in (a, b))
        both = (one[:, None, 0] != "") & (two[None, :, 0] != "")
        same = lambda k: both & (one[:, None, k] == two[None, :, k]) & (one[:, None, k] != "")
        for k, cost in ((3, 0.7), (2, 0.7), (1, 0.4), (0, 0.25)):
            out[same(k)] = cost
    out[low_a[:, None] == low_b[None, :]] = 0.0
    return out


def warp(cost: np.ndarray, open_start: bool = False, open_end: bool = False) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The cheapest warping path through a matrix of costs: for each row the first and the last column on it, the sum of the
    path's costs, and its length.

    A diagonal step weighs two; of equally cheap ones it is taken first, then one down; of equally cheap ends the last one. An open end leaves out the columns
    before the path's first row, or behind its last one, at no cost.
    """
    n, m = cost.shape
    steps = np.zeros((n, m), np.int8)
    row = np.zeros(m) if open_start else None
    for i in range(n):
        c = cost[i]
        up = np.full(m, np.inf) if row is None or i == 0 else row + c
        diagonal = np.full(m, np.inf)
        if i:
            diagonal[1:] = row[:-1] + 2 * c[1:]
        elif open_start:
            diagonal = c.copy()
        else:
            diagonal[0] = c[0]
        best = np.minimum(up, diagonal)
        ahead = np.cumsum(c)
        row = np.minimum.accumulate(best - ahead) + ahead  # steps along the columns
        steps[i] = np.where(diagonal <= row + 1e-9, 0, np.where(up <= row + 1e-9, 1, 2))
    i, j = n - 1, m - 1 - int(row[::-1].argmin()) if open_end else m - 1
    first, last, total, length = np.zeros(n, np.int64), np.full(n, -1), 0.0, 0
    while True:
        first[i] = j
        last[i] = max(last[i], j)
        total, length, step = total + float(cost[i, j]), length + 1, steps[i, j]
        if not i and step == 0:
            return first, last, total, length
        i, j = (i - 1, j - 1) if step == 0 else (i - 1, j) if step == 1 else (i, j - 1)


def path(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """For each place of a the first place of b on the cheapest path, and the mean cost along it. Unequal codes cost 1."""
    if not len(a) or not len(b):
        return np.zeros(len(a), int), 1.0
    first, _, total, length = warp((a[:, None] != b[None, :]).astype(float))
    return first, total / length


def align_chars(own: str, heard: str, sounds: dict[str, str] | None = None, open_start: bool = False, open_end: bool = False) -> tuple[np.ndarray, float, int]:
    """For each character of own the last one of heard on the cheapest path, the sum of its costs, and its length."""
    if own == heard:  # no path is cheaper than the diagonal, and of equally cheap steps that one is taken
        return np.arange(len(own)), 0.0, len(own)
    places = []
    for text in (own, heard):
        distinct = list(dict.fromkeys(text))
        number = {c: k for k, c in enumerate(distinct)}
        places.append((distinct, np.fromiter((number[c] for c in text), np.int64, len(text))))
    (a, i), (b, j) = places
    return warp(cost_table(a, b, sounds)[i[:, None], j[None, :]], open_start, open_end)[1:]


# --- coarse ----------------------------------------------------------------------------------------------------------


def bare(text: Column) -> Column:
    """What of a text is aligned: no white space, no punctuation."""
    return F.regexp_replace(T.remove_punctuation(text), r"(?U)\s+", "")


def placed(rows: DataFrame) -> DataFrame:
    """rows with bare, its length n, and at, the number of the track's bare characters before."""
    rows = rows.withColumn("bare", bare(F.coalesce("text", F.lit("")))).withColumn("n", F.length("bare").cast("long"))
    return rows.withColumn("at", F.coalesce(F.sum("n").over(timeline.before()), F.lit(0)))


def pieces(rows: DataFrame) -> DataFrame:
    """(track_id, piece, part): the bare text of a track in parts of PIECE characters, and a run more."""
    long = PIECE + GRAM - 1
    touched = F.sequence(F.greatest(F.floor((F.col("at") - GRAM + 1) / PIECE), F.lit(0)), F.floor((F.col("at") + F.col("n") - 1) / PIECE))
    rows = rows.where("n > 0").withColumn("piece", F.explode(touched))
    lo, hi = F.greatest("at", F.col("piece") * PIECE), F.least(F.col("at") + F.col("n"), F.col("piece") * PIECE + long)
    cut = F.struct(lo.alias("lo"), F.substring("bare", (lo - F.col("at") + 1).cast("int"), (hi - lo).cast("int")).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(cut)), lambda x: x["t"]), "")
    return rows.where(lo < hi).groupBy("track_id", "piece").agg(joined.alias("part"))


def _runs(parts: DataFrame) -> DataFrame:
    """(track_id, run, at) of the runs of a text that occur once in it, of those in the sample."""
    found = F.regexp_extract_all("part", F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1))  # one at each place, in a single pass
    rows = parts.select("track_id", "piece", F.posexplode(F.transform(found, F.lower)).alias("i", "run"))
    rows = rows.where(F.pmod(F.xxhash64("run"), F.lit(SAMPLE)) == 0)
    once = rows.groupBy("track_id", "run").agg(F.count("*").alias("n"), F.min(F.col("piece") * PIECE + F.col("i")).alias("at"))
    return once.where("n = 1").drop("n")


def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first place, whose second places ascend too."""
    ends: list[int] = []  # smallest second place that ends a chain of each length
    at, before = [], []
    for k, (_, j) in enumerate(pairs):
        size = bisect_left(ends, j)
        ends[size : size + 1] = [j]
        at[size : size + 1] = [k]
        before.append(at[size - 1] if size else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def cut_stretches(pairs: list[tuple[int, int]], n: int, m: int) -> list[tuple[int, int, int, int]]:
    """(i0, i1, j0, j1) of stretches that cover texts of n and m characters: cut at anchors, else evenly down to CELLS."""
    marks = [(0, 0)]
    for i, j in chain(pairs):
        if i - marks[-1][0] >= STRETCH and j > marks[-1][1]:
            marks.append((i, j))
    out = []
    for (i0, j0), (i1, j1) in zip(marks, [*marks[1:], (n, m)], strict=True):
        parts = min(max(1, i1 - i0), max(1, int(np.ceil(np.sqrt((i1 - i0) * (j1 - j0) / CELLS)))))
        while (i1 - i0) * (j1 - j0) > parts * parts * CELLS and parts < i1 - i0:
            parts += 1
        at = [(i0 + (i1 - i0) * k // parts, j0 + (j1 - j0) * k // parts) for k in range(parts + 1)]
        out += [(a, c, b, d) for (a, b), (c, d) in zip(at[:-1], at[1:], strict=True)]
    return out


def stretches(own: DataFrame, recognised: DataFrame, own_parts: DataFrame, recognised_parts: DataFrame) -> DataFrame:
    """(track_id, stretch, i0, i1, j0, j1, first, last); own and recognised: placed rows. A track without a character on
    either side has none. Of the anchors one in SPACING characters is kept, so a track's group is short."""
    one, two = _runs(own_parts), _runs(recognised_parts).withColumnRenamed("at", "j")
    anchors = one.join(two.hint("merge"), ["track_id", "run"]).groupBy("track_id", F.floor(F.col("at") / SPACING)).agg(F.min(F.struct("at", "j")).alias("a"))
    anchors = anchors.groupBy("track_id").agg(F.array_sort(F.collect_list("a")).alias("a")).select("track_id", F.col("a.at").alias("at"), F.col("a.j").alias("j"))
    size = lambda df, name: df.groupBy("track_id").agg(F.sum("n").alias(name)).where(F.col(name) > 0)
    rows = size(own, "n").join(size(recognised, "m").hint("merge"), "track_id").join(anchors.hint("merge"), "track_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            cuts = [cut_stretches(list(zip(at or (), j or (), strict=True)), n, m) for n, m, at, j in zip(*(batch[c].to_pylist() for c in ("n", "m", "at", "j")), strict=True)]
            sizes = np.array([len(x) for x in cuts])
            number = np.arange(sizes.sum()) - np.repeat(sizes.cumsum() - sizes, sizes)
            i0, i1, j0, j1 = (pa.array(x, pa.int64()) for x in zip(*(c for x in cuts for c in x), strict=True))
            track = batch["track_id"].take(pa.array(np.repeat(np.arange(len(cuts)), sizes)))
            columns = [track, pa.array(number), i0, i1, j0, j1, pa.array(number == 0), pa.array(number == np.repeat(sizes, sizes) - 1)]
            yield pa.RecordBatch.from_arrays(columns, ["track_id", "stretch", "i0", "i1", "j0", "j1", "first", "last"])

    kind = own.schema["track_id"].dataType.simpleString()
    return rows.select("track_id", "n", "m", "at", "j").mapInArrow(run, f"track_id {kind}, stretch long, i0 long, i1 long, j0 long, j1 long, first boolean, last boolean")


def _texts(cuts: DataFrame, parts: DataFrame, lo: str, hi: str, name: str) -> DataFrame:
    """(track_id, stretch, name): the characters [lo, hi) of each stretch, from the pieces that hold them."""
    asked = cuts.where(F.col(lo) < F.col(hi)).select("track_id", "stretch", F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.explode(F.sequence(F.floor(F.col(lo) / PIECE), F.floor((F.col(hi) - 1) / PIECE))).alias("piece"))
    a, b = F.greatest(F.col("lo") - F.col("piece") * PIECE, F.lit(0)), F.least(F.col("hi") - F.col("piece") * PIECE, F.lit(PIECE))
    found = asked.join(parts.hint("merge"), ["track_id", "piece"]).select("track_id", "stretch", F.struct("piece", F.substring("part", (a + 1).cast("int"), (b - a).cast("int")).alias("t")).alias("x"))
    return found.groupBy("track_id", "stretch").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "").alias(name))


# --- fine ------------------------------------------------------------------------------------------------------------


def warped(recognised: DataFrame, sentences: DataFrame, sounds: dict[str, str] | None = None) -> DataFrame:
    """(track_id, stretch, i0, j0, places, cost, length): for each character of a stretch's own text the one recognised, as
    places from j0 on; null where the stretch has none. recognised and sentences: placed rows.

    Texts in pieces, cuts and paths are written once each: all of them are read several times, and a plan that has them
    again in each place is too large for the driver. Joins are sort-merge joins by hint, here and in char_times: of rows
    with long texts and arrays Spark expects a few bytes each, and would send large sides through the driver.
    """
    own_parts, parts = cut(pieces(sentences)), cut(pieces(recognised))
    cuts = cut(stretches(sentences, recognised, own_parts, parts))
    rows = cuts.where("i1 > i0").join(_texts(cuts, own_parts, "i0", "i1", "own").hint("merge"), ["track_id", "stretch"]).join(_texts(cuts, parts, "j0", "j1", "heard").hint("merge"), ["track_id", "stretch"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            places, costs, lengths = [], [], []
            for own, heard, first, last in zip(*(batch[c].to_pylist() for c in ("own", "heard", "first", "last")), strict=True):
                at, cost, length = align_chars(own, heard, sounds, first, last) if heard else ([None] * len(own), float(len(own)), len(own))
                places.append(pa.array(at, pa.int32())), costs.append(cost), lengths.append(length)
            offsets = np.cumsum([0, *map(len, places)], dtype=np.int32)
            columns = [batch[c] for c in ("track_id", "stretch", "i0", "j0")]
            columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(places)), pa.array(costs, pa.float64()), pa.array(lengths, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["track_id", "stretch", "i0", "j0", "places", "cost", "length"])

    kind = sentences.schema["track_id"].dataType.simpleString()
    # a stretch is few bytes and much work, so stretches are dealt out by number; Spark would put those of megabytes into one task
    rows = rows.select("track_id", "stretch", "i0", "j0", "own", "heard", "first", "last").repartition(tasks(sentences.sparkSession), F.xxhash64("track_id", "stretch"))  # by the columns alone it would be the join's own
    return cut(rows.mapInArrow(run, f"track_id {kind}, stretch long, i0 long, j0 long, places array<int>, cost double, length long"))


def _filed(lo: Column, values: Column) -> Column:
    """Of values at places from lo on an array of (piece, lo, v): a part for each piece of the text that they touch."""

    def parts(v: Column) -> Column:
        def part(p: Column) -> Column:
            a, b = F.greatest(lo, p * PIECE), F.least(lo + F.size(v), (p + 1) * PIECE)
            return F.struct(p.alias("piece"), a.alias("lo"), F.slice(v, (a - lo + 1).cast("int"), (b - a).cast("int")).alias("v"))

        return F.transform(F.sequence(F.floor(lo / PIECE), F.floor((lo + F.size(v) - 1) / PIECE)), part)

    return _once(values, parts)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), an array, with value computed once, also where use has it inside a function of elements."""
    return F.flatten(F.transform(F.array(value), use))


def char_times(recognised: DataFrame, sentences: DataFrame, paths: DataFrame) -> DataFrame:
    """(track_id, seg_idx, pos, orig, i, n, at_ms, word_end): each character of the sentences with its place in the sentence,
    bare and as written, in the track, and the number of the sentence's characters; the time of the one recognised: its share
    of the segment's span, the last one the segment's end.

    word_end: the end of the segment recognised. Missing times are filled from both sides. Characters meet their times in
    parts of stretches, as arrays, not one by one.
    """
    kept = F.regexp_replace(F.regexp_replace("text", T.PUNCTUATION, "\0"), r"(?U)\s", "\0")
    written = F.transform(F.regexp_extract_all(kept, F.lit("(?s)."), F.lit(0)), lambda c, k: F.when(c != "\0", k))
    own = sentences.where("n > 0").select("track_id", "seg_idx", "at", "n", F.explode(_filed(F.col("at"), F.filter(written, F.isnotnull))).alias("x"))
    own = own.select("track_id", "seg_idx", "at", "n", F.col("x.piece").alias("piece"), F.col("x.lo").alias("lo"), F.col("x.v").alias("origs"))

    # the segments recognised that each stretch meets, in parts by piece
    low, high = (F.col("j0") + f("places") for f in (F.array_min, F.array_max))
    met = paths.select("track_id", "stretch", low.alias("_a"), high.alias("_b"), F.explode(F.sequence(F.floor(low / PIECE), F.floor(high / PIECE))).alias("piece"))
    rec = recognised.where("n > 0").withColumn("piece", F.explode(F.sequence(F.floor(F.col("at") / PIECE), F.floor((F.col("at") + F.col("n") - 1) / PIECE))))
    first, last = F.greatest("at", F.col("piece") * PIECE), F.least(F.col("at") + F.col("n"), (F.col("piece") + 1) * PIECE) - 1
    rec = rec.select("track_id", "piece", F.struct(first.alias("a"), last.alias("b"), "at", "n", F.col("start_ms").cast("long").alias("start"), F.col("end_ms").alias("end")).alias("s"))
    met = rec.join(met.hint("merge"), ["track_id", "piece"]).where("s.a <= _b and s.b >= _a")
    spans = met.groupBy("track_id", "stretch").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    heard = paths.select("track_id", "stretch", "i0", "j0", "places").join(spans.hint("merge"), ["track_id", "stretch"], "left")
    heard = heard.select("track_id", "j0", "spans", F.explode(_filed(F.col("i0"), F.col("places"))).alias("x")).select("track_id", "j0", "spans", F.col("x.piece").alias("piece"), F.col("x.lo").alias("_lo"), F.col("x.v").alias("places"))

    rows = own.join(heard.hint("merge"), ["track_id", "piece"])
    rows = rows.withColumns({"_a": F.greatest("lo", "_lo"), "_b": F.least(F.col("lo") + F.size("origs"), F.col("_lo") + F.size("places"))}).where("_a < _b")
    part = lambda name, lo: F.slice(name, (F.col("_a") - F.col(lo) + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int")).alias(name)
    rows = rows.select("track_id", "seg_idx", "at", "n", F.col("_a").alias("i"), "j0", "spans", part("origs", "lo"), part("places", "_lo"))
    rows = rows.withColumns({"_a": F.col("j0") + F.array_min("places"), "_b": F.col("j0") + F.array_max("places")})

    def times(s: Column) -> Column:
        def time(j: Column) -> Column:
            k = j - s["at"]
            at = F.when(k >= s["n"] - 1, s["end"].cast("double")).otherwise(s["start"] + k / s["n"] * (s["end"] - s["start"]))
            return F.struct(at.alias("at_ms"), s["end"].alias("word_end"))

        return F.transform(F.sequence(F.greatest(s["a"], "_a"), F.least(s["b"], "_b")), time)

    near = F.filter("spans", lambda s: (s["a"] <= F.col("_b")) & (s["b"] >= F.col("_a")))
    char = lambda t: F.transform("places", lambda j, k: F.struct((F.col("i") - F.col("at") + k).alias("pos"), F.get("origs", k).alias("orig"), (F.col("i") + k).alias("i"), F.get(t, (F.col("j0") + j - F.col("_a")).cast("int")).alias("t")))
    rows = rows.select("track_id", "seg_idx", "n", F.explode(_once(F.flatten(F.transform(near, times)), char)).alias("c"))
    rows = rows.select("track_id", "seg_idx", "c.pos", "c.orig", "c.i", "n", "c.t.at_ms", "c.t.word_end")
    missing = paths.where(F.exists("places", lambda x: x.isNull())).select("track_id").distinct()
    if missing.isEmpty():
        return rows
    last = recognised.groupBy("track_id").agg(F.max_by("end_ms", "seg_idx").alias("_last"))
    gaps = rows.join(missing, "track_id", "left_semi").join(last, "track_id").withColumnRenamed("seg_idx", "_seg").withColumn("seg_idx", F.col("i"))
    gaps = polish.fill_times(gaps, F.col("_last")).drop("seg_idx", "_last").withColumnRenamed("_seg", "seg_idx")
    return rows.join(missing, "track_id", "left_anti").unionByName(gaps)


def align_text(recognised: DataFrame, sentences: DataFrame, sounds: dict[str, str] | None = None, at_pauses: bool = True) -> DataFrame:
    """(track_id, seg_idx, start_ms, end_ms, text, match_rate): sentences (track_id, seg_idx, text) with the times that
    recognised (track_id, seg_idx, start_ms, end_ms, text) gives their characters; never overlapping.

    at_pauses: a sentence is cut where the speaker pauses, and parts of fewer than two characters join a neighbour. A row
    lasts half a second at least, as far as the next one and the track's end allow. match_rate: one less the mean cost along the path.
    sounds: see text.char_cost. Sentences without a character to align, null ones, and tracks without any on either side
    have no rows. A null time counts as missing. Other columns are not read.
    """
    rec = placed(recognised.select("track_id", "seg_idx", "start_ms", "end_ms", "text"))
    own = placed(sentences.select("track_id", "seg_idx", F.coalesce("text", F.lit("")).alias("text")))
    paths = warped(rec, own, sounds)
    chars = char_times(rec, own, paths).select("track_id", "seg_idx", "pos", "orig", "at_ms", "word_end")
    chars = polish.pause_parts(chars) if at_pauses else chars.withColumn("part", F.lit(0).cast("long"))
    ends = F.coalesce(F.max_by("word_end", "pos"), F.max("at_ms"))
    parts = chars.groupBy("track_id", "seg_idx", "part").agg(F.min_by("at_ms", "pos").alias("a"), ends.alias("b"), F.min("orig").alias("orig"))
    parts = parts.select("track_id", "seg_idx", F.struct("orig", "a", "b").alias("p")).groupBy("track_id", "seg_idx").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    # a part's text goes on to the first character of the next part
    spans = F.transform("ps", lambda p, k: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.when(k == 0, 0).otherwise(p["orig"]).alias("lo"), F.get(F.col("ps"), k + 1)["orig"].alias("hi")))
    rows = parts.withColumn("spans", spans).join(own.select("track_id", "seg_idx", "text").hint("merge"), ["track_id", "seg_idx"])
    rows = rows.join(rec.groupBy("track_id").agg(F.max("end_ms").alias("_last")).hint("merge"), "track_id")
    rows = rows.select("track_id", "seg_idx", "text", "_last", F.posexplode("spans").alias("part", "s"))
    text = T.strip(F.substring("text", (F.col("s.lo") + 1), F.coalesce(F.col("s.hi"), F.length("text")) - F.col("s.lo")))
    start = F.round("s.a").cast("long")
    rows = rows.select("track_id", (F.col("seg_idx") * 1_000_000 + F.col("part")).alias("seg_idx"), start.alias("start_ms"), F.greatest(F.round("s.b").cast("long"), F.least(start + 500, "_last")).alias("end_ms"), text.alias("text"))
    rows = polish.fix_overlaps(polish.merge_tiny(rows) if at_pauses else rows)
    rate = paths.groupBy("track_id").agg((1 - F.sum("cost") / F.sum("length")).alias("match_rate"))
    rows = rows.withColumn("seg_idx", F.row_number().over(Window.partitionBy("track_id").orderBy("start_ms", "seg_idx")).cast("long"))
    return rows.join(rate.hint("merge"), "track_id").select("track_id", "seg_idx", "start_ms", "end_ms", "text", "match_rate")


def sentences(texts: DataFrame, soft: bool = False) -> DataFrame:
    """(track_id, seg_idx, text): texts (track_id, text) cut behind sentence ends and at line ends; soft: commas too."""
    stops = "。！？!?；;…" + ("，,、：:" if soft else "")
    parts = F.regexp_extract_all("text", F.lit(rf"[^{stops}\n]+[{stops}]*"), F.lit(0))
    rows = texts.select("track_id", F.posexplode(parts).alias("_i", "_t")).select("track_id", (F.col("_i") + 1).cast("long").alias("seg_idx"), T.strip(F.col("_t")).alias("text"))
    return rows.where("text <> ''")
