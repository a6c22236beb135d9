"""Changes to the rows of a track by key: replies put back, selections updated or merged, labels by place, texts paired."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.functions import text as T
from cueframe.operators import timeline
from cueframe.sources.tables import small, tasks

KEY = ["track_id", "seg_idx"]


def optimised(segments: DataFrame, replies: DataFrame) -> DataFrame:
    """segments with the text of replies (track_id, seg_idx, reply), or their own; an earlier translation goes."""
    out = segments.drop("translated_text").join(replies.select(*KEY, "reply"), KEY, "left")
    return out.withColumn("text", F.coalesce("reply", "text")).drop("reply")


def with_replies(segments: DataFrame, replies: DataFrame) -> DataFrame:
    """segments with the reply of replies (track_id, seg_idx, reply) as text; without one, or with an empty one, their own."""
    out = segments.join(replies.select(*KEY, "reply"), KEY, "left")
    return out.withColumn("text", F.coalesce(F.nullif("reply", F.lit("")), "text")).drop("reply")


def with_defaults(rows: DataFrame, profiles: DataFrame, key: str, columns: dict[str, object], default: str = "default") -> DataFrame:
    """rows with columns of the profile that their key names, else of the default profile, else the value given here.

    Of profiles with one key the least one counts. Spark sends profiles to every task only as far as its own limit goes.
    """
    one = profiles.groupBy(key).agg(F.min(F.struct(*columns)).alias("_own"))
    other = one.where(F.col(key) == default).select(F.col("_own").alias("_default"))
    out = rows.join(one, key, "left").join(other, F.lit(True), "left")  # one row at most
    return out.withColumns({c: F.coalesce(f"_own.{c}", f"_default.{c}", F.lit(v)) for c, v in columns.items()}).drop("_own", "_default")


def restore(kept: DataFrame, dropped: DataFrame, wanted: DataFrame) -> DataFrame:
    """All rows of kept and dropped with state: kept, restored (dropped rows whose key wanted names) or dropped."""
    back, gone = dropped.join(wanted.select(*KEY), KEY, "left_semi"), dropped.join(wanted.select(*KEY), KEY, "left_anti")
    state = lambda df, x: df.withColumn("state", F.lit(x))
    return state(kept, "kept").unionByName(state(back, "restored")).unionByName(state(gone, "dropped"))


def rewritten(segments: DataFrame, replies: DataFrame) -> DataFrame:
    """segments with the text of replies where it isn't blank."""
    out = segments.join(replies.select(*KEY, "reply"), KEY, "left")
    return out.withColumn("text", F.when(~T.is_blank(F.col("reply")), T.strip(F.col("reply"))).otherwise(F.col("text"))).drop("reply")


def update_selected(segments: DataFrame, selected: DataFrame, stage) -> DataFrame:
    """The selected rows (track_id, seg_idx) go through stage, a function from segments to (track_id, seg_idx, reply);
    all others stay. Replies are put back by key, so a row the stage leaves out keeps its text."""
    return rewritten(segments, stage(segments.join(selected.select(*KEY).distinct(), KEY, "left_semi")))


def upsert(segments: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of changes (same columns) take the place of rows with their key, or are added."""
    return segments.join(changes.select(*KEY), KEY, "left_anti").unionByName(changes)


def merge_selected(segments: DataFrame, selected: DataFrame, joint: str = " ") -> DataFrame:
    """Each run of selected rows that stand side by side becomes one row; nothing between is lost."""
    marked = segments.join(selected.select(*KEY).distinct().withColumn("_sel", F.lit(True)), KEY, "left").withColumn("_sel", F.coalesce("_sel", F.lit(False)))
    new = ~(F.col("_sel") & F.coalesce(F.lag("_sel").over(timeline.track()), F.lit(False)))
    rows = marked.withColumn("_new", new.cast("long")).withColumn("_group", F.sum("_new").over(timeline.so_far()))
    return timeline.merge_groups(rows, "_group", joint).drop("_group")


def zip_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with label by place; labels: (track_id, place from 1, label). mismatch: the track has more of one than the other."""
    numbered = rows.withColumn("place", F.row_number().over(timeline.track()))
    sizes = numbered.groupBy("track_id").agg(F.count("*").alias("_n")).join(labels.groupBy("track_id").agg(F.max("place").alias("_m")), "track_id", "left")
    out = numbered.join(labels, ["track_id", "place"], "left").join(sizes, "track_id")
    return out.withColumn("mismatch", ~F.col("_n").eqNullSafe(F.col("_m").cast("long"))).drop("place", "_n", "_m")


def first_rows(rows: DataFrame, n: int, order: Column, by: str = "track_id") -> DataFrame:
    """The first n rows of each group, as hints, samples or examples."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_k") <= n).drop("_k")


def page(rows: DataFrame, number: int, *order: Column | str, size: int = 50) -> DataFrame:
    """Page `number`, from 0, of rows in order."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def containing(points: DataFrame, spans: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """points (track_id, seg_idx, at_ms) with span_start and span_end of the first span (track_id, start_ms, end_ms) that
    holds them, ends included; null where none does. Spans are filed under each bucket of time that they touch."""
    buckets = F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.col("end_ms") / bucket_ms))
    filed = spans.where("end_ms >= start_ms").select("track_id", F.explode(buckets).alias("_b"), F.col("start_ms").alias("span_start"), F.col("end_ms").alias("span_end"))
    asked = points.withColumn("_b", F.floor(F.col("at_ms") / bucket_ms))
    hit = asked.join(filed, ["track_id", "_b"]).where("at_ms between span_start and span_end")
    best = hit.groupBy(*KEY).agg(F.min(F.struct("span_start", "span_end")).alias("_s"))
    return points.join(best, KEY, "left").select(*points.columns, F.col("_s.span_start").alias("span_start"), F.col("_s.span_end").alias("span_end"))


ALIKE = 0.75  # fixed value: likeness from which two changed lines are versions of each other


def likeness(a: str, b: str) -> float:
    """difflib's ratio: both sides of the longest common run, the earliest one, are compared again. The run is looked for by
    substrings, which takes a tenth of the time; from 200 characters on difflib leaves out frequent ones."""
    if len(b) >= 200:
        return difflib.SequenceMatcher(None, a, b).ratio()
    common, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        at, size, k = 0, 0, 0
        while k + size < len(x):
            while k + size < len(x) and x[k : k + size + 1] in y:
                at, size = k, size + 1
            k += 1
        if size:
            i = y.find(x[at : at + size])
            common += size
            todo += [(x[:at], y[:i]), (x[at + size :], y[i + size :])]
    return 2.0 * common / (len(a) + len(b)) if a or b else 1.0


def beside(a: list[str], b: list[str]) -> list[int | None]:
    """For each line of a the place of the line of b beside it.

    Equal lines are paired as a difference of the lists does. In a block that has changed, the two most alike lines, if they
    are ALIKE, are a pair and part the block, and so on in both halves; the earlier one wins a tie. Where no two are alike,
    lines are paired by place.
    """
    out: list[int | None] = [None] * len(a)
    blocks = []
    for tag, i, j, k, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            out[i:j] = range(k, n)
        elif tag == "replace":
            blocks.append((i, j, k, n))
    while blocks:
        i, j, k, n = blocks.pop()
        pairs = [(likeness(a[x], b[y]), -x, -y) for x in range(i, j) for y in range(k, n) if 2 * min(len(a[x]), len(b[y])) >= ALIKE * (len(a[x]) + len(b[y]))]
        best = max(pairs, default=(0.0, 0, 0))
        if best[0] < ALIKE:
            for x, y in zip(range(i, j), range(k, n)):
                out[x] = y
            continue
        x, y = -best[1], -best[2]
        out[x] = y
        blocks += [block for block in ((i, x, k, y), (x + 1, j, y + 1, n)) if block[0] < block[1] and block[2] < block[3]]
    return out


def pair_lines(batches: DataFrame) -> DataFrame:
    """Lines of two versions of a batch side by side; batches: (track_id, batch, source, target), arrays of texts.

    Rows (track_id, batch, line, source, target). Lines are paired by likeness, see beside; a line with nothing beside it in
    the target has the target before it, a line of the target with nothing beside it in the source is left out. A null
    array is an empty one. Batches bound the work.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples():
            a, b = ([str(x) for x in lines] if lines is not None else [] for lines in (row.source, row.target))
            last = None
            for line, (text, at) in enumerate(zip(a, beside(a, b), strict=True)):
                last = last if at is None else b[at]
                out.append((row.track_id, row.batch, line, text, last))
        return pd.DataFrame(out, columns=["track_id", "batch", "line", "source", "target"])

    kinds = dict(batches.dtypes)
    return batches.mapInPandas(lambda parts: map(run, parts), f"track_id {kinds['track_id']}, batch {kinds['batch']}, line long, source string, target string")


def _plain(text: str) -> str:
    return " ".join(text.lower().split())


def _letters(text: str) -> str:
    return "".join(text.lower().replace("ς", "σ").split())


def candidate_runs(n: int, left: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of words of the runs that a sentence of n words can have been made from, likeliest first:
    half to twice as many of the words that are left, nearer sizes first, from 0 to shift words further on."""
    sizes = np.arange(max(1, n // 2), min(2 * n, left) + 1)
    sizes = sizes[np.argsort(np.abs(sizes - n), kind="stable")]
    firsts = np.minimum(shift, left - sizes) + 1
    return np.arange(firsts.sum()) - np.repeat(firsts.cumsum() - firsts, firsts), np.repeat(sizes, firsts)


_usual_runs = lru_cache(256)(candidate_runs)


class Words:
    """The words of a batch with what each search asks of them: their letters as one text and as numbers, each letter's word,
    where each word's letters begin, and how many blanks stand before it."""

    def __init__(self, words: list[str]):
        self.words = words
        letters = [_letters(w) for w in words]
        self.text = "".join(letters)
        self.ends = np.cumsum([0, *map(len, letters)])
        self.blanks = np.cumsum([0, *(len(w) - len("".join(w.split())) for w in words)])
        self.number = {c: k for k, c in enumerate(dict.fromkeys(self.text))}

    @cached_property
    def codes(self) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, self.text), np.int64, len(self.text))

    @cached_property
    def word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.words)), np.diff(self.ends))

    def runs(self, n: int, at: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
        left = min(len(self.words) - at, shift + 2 * n)  # more don't change the runs
        first, size = (_usual_runs if n <= 100 else candidate_runs)(n, left, shift)
        return first + at, size

    def plain(self, first: int, size: int) -> str:
        return _plain("".join(self.words[first : first + size]))

    def shared(self, wanted: str, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many letters of each run the letters wanted have too."""
        counts = {self.number[c]: k for c, k in Counter(wanted).items() if c in self.number}
        low, high = int(first.min()), int(end.max())
        column = np.full(len(self.number), -1)
        column[list(counts)] = np.arange(len(counts))
        of = column[self.codes[self.ends[low] : self.ends[high]]]
        known = np.flatnonzero(of >= 0)
        rows, width = high - low + 1, len(counts)
        table = np.bincount((self.word[self.ends[low] : self.ends[high]][known] - low + 1) * width + of[known], minlength=rows * width).reshape(rows, width).cumsum(axis=0)
        return np.minimum(table[end - low] - table[first - low], list(counts.values())).sum(axis=1)


def _bounds(wanted: str, shared: np.ndarray | int, held: np.ndarray, blanks: np.ndarray) -> np.ndarray:
    """Upper bounds on the likeness of runs to a plain text, from the letters that both have at most, the letters of each run,
    and its blanks, of which as many count as fit best."""
    blanks = np.minimum(wanted.count(" "), blanks)
    return 2 * (np.minimum(shared, held) + blanks) / np.maximum(1, len(wanted) + held + blanks)


def best_run(sentence: str, words: list[str] | Words, at: int, shift: int = 30, least: float = 0.5) -> tuple[int, int] | None:
    """First place and number of the words from `at` on that are most like a sentence, or None below `least`; of equally
    like runs the likelier one.

    An equal run is looked for among those of as many letters. Else the likeliest run is compared first, and what cannot
    exceed it by length alone is left out. Other candidates are compared from the highest bound on their likeness down,
    until no bound reaches the best one found.
    """
    own = words if isinstance(words, Words) else Words(words)
    wanted = _plain(sentence)
    first, size = own.runs(T.word_count(wanted), at, shift)
    if not len(first):
        return None
    end, letters = first + size, _letters(wanted)
    begin = own.ends[first]
    held = own.ends[end] - begin
    for k in np.flatnonzero(held == len(letters)).tolist() if least <= 1 else ():
        if own.text.startswith(letters, int(begin[k])) and own.plain(int(first[k]), int(size[k])) == wanted:
            return int(first[k]), int(size[k])  # no run is liker than an equal one
    like = lambda k: (likeness(wanted, own.plain(int(first[k]), int(size[k]))), -k)
    best, blanks = like(0), own.blanks[end] - own.blanks[first]
    most = sum(map(own.number.__contains__, letters))  # letters that any word has, so not a full stop
    todo = np.flatnonzero(_bounds(wanted, most, held, blanks) > best[0])  # of equally like ones the first is likelier
    bound = _bounds(wanted, own.shared(letters, first[todo], end[todo]), held[todo], blanks[todo]) if len(todo) else todo
    for k in np.argsort(-bound, kind="stable").tolist():
        if bound[k] + 1e-9 < best[0]:
            break
        best = max(best, like(int(todo[k])))
    return (int(first[-best[1]]), int(size[-best[1]])) if best[0] >= least else None


def matched(own: Words, lines: list[str], most_unmatched: int) -> list[tuple[int, int] | None]:
    """For each line, in order, the first place and number of the words that it was made from; see match_sentences."""
    at, shift, missed, out = 0, 30, 0, []
    for line in lines:
        found = best_run(line, own, at, shift) if missed <= most_unmatched and own.words else None
        if found:
            at, shift = found[0] + found[1], 30
        else:
            missed, at, shift = missed + 1, min(at + 1, max(0, len(own.words) - 1)), 100
        out.append(found)
    return out


def match_sentences(words: DataFrame, sentences: DataFrame, most_unmatched: int = 5) -> DataFrame:
    """(track_id, batch, seg_idx, first_word, words): for each sentence the run of words that it was made from.

    words and sentences: (track_id, batch, seg_idx, text). Each search begins behind the run before; after a sentence
    without a run it goes one word further and looks 100 ahead instead of 30. A batch with more than most_unmatched such
    sentences has null runs from there on. Batches bound the size of a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [matched(Words([w or "" for w in own]), [x or "" for x in lines], most_unmatched) for own, lines in zip(*(batch[c].to_pylist() for c in ("words", "sentences")), strict=True)]
            at, index = np.repeat(np.arange(len(found)), list(map(len, found))), batch["word_numbers"].to_pylist()
            first = [x and index[k][x[0]] for k, x in zip(at.tolist(), (x for f in found for x in f), strict=True)]
            columns = [batch[c].take(pa.array(at)) for c in ("track_id", "batch")]
            columns += [batch["numbers"].flatten(), pa.array(first, pa.int64()), pa.array([x and x[1] for f in found for x in f], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["track_id", "batch", "seg_idx", "first_word", "words"])

    kinds = dict(words.dtypes)
    row = lambda df, kind: df.select("track_id", "batch", F.struct(F.lit(kind).alias("kind"), F.col("seg_idx").cast("long").alias("i"), F.col("text").alias("t")).alias("x"))
    # a batch is few bytes and much work, so batches are dealt out by number; Spark would put those of megabytes into one task
    both = row(words, 0).unionByName(row(sentences, 1)).repartition(tasks(words.sparkSession), "track_id", "batch").groupBy("track_id", "batch").agg(F.array_sort(F.collect_list("x")).alias("x"))
    side = lambda kind, field: F.transform(F.filter("x", lambda x: x["kind"] == kind), lambda x: x[field])
    both = both.select("track_id", "batch", side(0, "i").alias("word_numbers"), side(0, "t").alias("words"), side(1, "i").alias("numbers"), side(1, "t").alias("sentences"))
    return both.mapInArrow(run, f"track_id {kinds['track_id']}, batch {kinds['batch']}, seg_idx long, first_word long, words long")
