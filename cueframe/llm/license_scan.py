"""Licence scans: texts against licence templates by Dice coefficient over word bigrams.

Texts are lower-cased (A-Z) and cut into words at white space and ASCII punctuation. A template with b distinct bigrams
can only reach a Dice coefficient of t with a stretch of t/(2-t) b to (2-t)/t b bigrams, at least t/(2-t) b of them its
own. The lower bound prunes templates for whole documents: one pass looks up each bigram in the templates' index and
counts the distinct ones that each (document, template) shares. For the few pairs left, all stretches within the upper
bound that begin and end at shared bigrams are compared, wherever they stand in the document; the whole text is compared
too where its size lies within the bounds. The scan needs no shuffle: only the templates, of bounded size, go to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueframe.llm.common import buffers, read, slices, words
from cueframe.llm.license_texts import templates as known_templates

SIMILARITY = 0.85
MAX_TEMPLATE_WORDS = 2_000_000  # what goes to every task: templates with more words together are refused
MATCH = "struct<license:string,dice:double,shared:long,start:long,n_words:long,matched:string>"
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58], _PLAIN[97:123], _PLAIN[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_PLAIN[65:91] = np.arange(97, 123)
_QUOTES = tuple(x.encode() for x in "“”„‘’«»–—…©")


def _bare(word: bytes) -> bytes:
    """A word without typographic marks at its ends, which the cut at ASCII punctuation leaves."""
    while word.startswith(_QUOTES):
        word = word[len(next(q for q in _QUOTES if word.startswith(q))) :]
    while word.endswith(_QUOTES):
        word = word[: -len(next(q for q in _QUOTES if word.endswith(q)))]
    return word


def tokens(text: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Normalised words as common.words gives them: places in the distinct words, these, words per row."""
    raw, offsets = buffers(text)
    plain = pa.Array.from_buffers(pa.large_string(), len(text), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_PLAIN[raw])])
    return words(plain, lower=False)


@dataclass
class Templates:
    """Templates as bigram sets with an index from bigrams to the templates that hold them."""

    names: list[str]
    vocabulary: dict[bytes, int]
    size: np.ndarray  # distinct bigrams of each
    need: np.ndarray  # shared bigrams that a match has at least
    length: np.ndarray  # bigrams of each, repeats counted
    most: np.ndarray  # bigrams that a match has at most, repeats counted
    bigrams: np.ndarray  # sorted, first word * len(vocabulary) + second
    first: np.ndarray  # places in owner by bigram, one more at the end
    owner: np.ndarray
    similarity: float

    @staticmethod
    def of(pairs: Sequence[tuple[str, str]], similarity: float = SIMILARITY) -> Templates:
        """pairs: (name, text); several texts may share a name. Those of fewer than two words can't match."""
        if not 0 < similarity <= 1:
            raise ValueError("similarity must be above 0, at most 1")
        pairs = sorted({(name, text or "") for name, text in pairs})
        index, distinct, per_row = tokens(pa.array([text for _, text in pairs], pa.large_string()))
        if len(index) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"the templates have {len(index)} words; {MAX_TEMPLATE_WORDS} at most may be sent to every task")
        bare: dict[bytes, int] = {}
        place = np.array([bare.setdefault(_bare(w), len(bare)) for w in distinct], np.int64)
        ends, sets = np.cumsum(per_row), []
        for to, n in zip(ends, per_row, strict=True):
            w = place[index[to - n : to]]
            sets.append(np.unique(w[:-1] * len(bare) + w[1:]))
        keep = [i for i, s in enumerate(sets) if len(s)]
        size = np.array([len(sets[i]) for i in keep], np.int64)
        every = np.concatenate([sets[i] for i in keep]) if keep else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        bigrams, first = np.unique(every[order], return_index=True)
        # the bounds are rounded so that a stretch exactly at the similarity stays within them
        need = np.maximum(1, np.ceil(similarity * size / (2 - similarity) - 1e-9)).astype(np.int64)
        length = np.array([per_row[i] - 1 for i in keep], np.int64)
        most = np.floor((2 - similarity) / similarity * length + 1e-9).astype(np.int64)
        return Templates([pairs[i][0] for i in keep], bare, size, need, length, most, bigrams, np.append(first, len(every)), np.repeat(np.arange(len(keep)), size)[order], similarity)


def _same_before(codes: np.ndarray) -> np.ndarray:
    """For each place the one before it with the same code, or -1."""
    order = np.argsort(codes, kind="stable")
    before = np.full(len(codes), -1)
    same = codes[order[1:]] == codes[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    return before


def _stretches(before: np.ndarray, hit: np.ndarray, size: int, need: int, length: int, most: int, similarity: float) -> list[tuple[float, int, int, int]]:
    """(dice, shared, start, bigrams) of the best stretch from each start that reaches the similarity; of equal ones the nearest to the template's length."""
    at = np.flatnonzero(hit)
    last = np.searchsorted(at, at + most) - 1  # the last hit that a stretch from each start can end at
    out = []
    for i in np.flatnonzero(last - np.arange(len(at)) + 1 >= need):
        start = at[i]
        new = before[start : at[last[i]] + 1] < start
        ends = at[i : last[i] + 1] - start
        shared = np.cumsum(new[ends])
        dice = 2 * shared / (np.cumsum(new)[ends] + size)
        equal = np.flatnonzero(dice == dice.max())
        best = int(equal[np.argmin(np.abs(ends[equal] + 1 - length))])
        if dice[best] >= similarity:
            out.append((float(dice[best]), int(shared[best]), int(start), int(ends[best]) + 1))
    return out


def scan(text: pa.Array, known: Templates) -> tuple[list[list[dict]], list[float | None]]:
    """For each text its matches, best first, no two overlapping, and the Dice coefficient of the whole text."""
    index, distinct, per_row = tokens(text)
    matches: list[list[dict]] = [[] for _ in per_row]
    whole: list[float | None] = [None] * len(per_row)
    if not len(index) or not known.names:
        return matches, whole
    wide = len(known.vocabulary)
    place = np.fromiter((known.vocabulary.get(_bare(w) if w[0] > 127 or w[-1] > 127 else w, -1) for w in distinct), np.int64, len(distinct))
    place = np.where(place < 0, wide + np.arange(len(place)), place)
    word, row = place[index], np.repeat(np.arange(len(per_row)), per_row)
    own = np.flatnonzero((word[:-1] < wide) & (word[1:] < wide) & (row[:-1] == row[1:]))
    key = word[own] * wide + word[own + 1]
    found = np.minimum(np.searchsorted(known.bigrams, key), len(known.bigrams) - 1)
    right = known.bigrams[found] == key
    own, found = own[right], found[right]
    # distinct shared bigrams of each row and template
    pair = np.unique(row[own] * len(known.bigrams) + found)
    r, b = pair // len(known.bigrams), pair % len(known.bigrams)
    n = known.first[b + 1] - known.first[b]
    flat = np.repeat(known.first[b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    both, shared = np.unique(np.repeat(r, n) * len(known.names) + known.owner[flat], return_counts=True)
    left = shared >= known.need[both % len(known.names)]
    candidates: dict[int, list[tuple[int, int]]] = {}
    for rt, s in zip(both[left].tolist(), shared[left].tolist(), strict=True):
        candidates.setdefault(rt // len(known.names), []).append((rt % len(known.names), s))
    ends = np.cumsum(per_row)
    hits = np.searchsorted(own, np.column_stack([ends - per_row, ends]))
    for i, wanted in candidates.items():
        begin = int(ends[i] - per_row[i])
        mine = word[begin : ends[i]]
        before = _same_before(mine[:-1] * (wide + len(distinct)) + mine[1:])
        total = int((before < 0).sum())
        at, bigram = own[slice(*hits[i])] - begin, found[slice(*hits[i])]
        options = []
        for t, s in wanted:
            if total * known.similarity <= (2 - known.similarity) * known.size[t]:
                whole[i] = max(whole[i] or 0.0, 2 * s / (total + int(known.size[t])))
            hit = np.zeros(len(mine) - 1, bool)
            holders = np.zeros(len(known.bigrams), bool)
            holders[np.searchsorted(known.first, np.flatnonzero(known.owner == t), "right") - 1] = True
            hit[at[holders[bigram]]] = True
            for dice, common, start, length in _stretches(before, hit, int(known.size[t]), int(known.need[t]), int(known.length[t]), int(known.most[t]), known.similarity):
                options.append((-dice * common, -dice, start, known.names[t], length, common))
        taken = np.zeros(len(mine), bool)
        for _, dice, start, name, length, common in sorted(options):
            if not taken[start : start + length + 1].any():
                taken[start : start + length + 1] = True
                said = b" ".join(distinct[k] for k in index[begin + start : begin + start + length + 1]).decode()
                matches[i].append({"license": name, "dice": -dice, "shared": common, "start": start, "n_words": length + 1, "matched": said})
    return matches, whole


_MATCHES = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("shared", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("matched", pa.string())]))


def with_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, matches, whole_dice) of each row of docs.

    matches: the licence passages of the text, best first (Dice times shared bigrams; ties: higher Dice, earlier, name), no
    two overlapping: licence, dice, shared bigrams, place of the first word, number of words, normalised text. A passage has at most
    (2-t)/t times as many bigrams as its template, repeats counted; its Dice counts distinct ones. whole_dice: the
    highest Dice of the whole text with a template that its size allows, which may lie below the similarity; else null.
    A null or empty text and one without two words have no matches; repeated rows each get their own; no rows, no result.
    """
    known = Templates.of(known_templates() if templates is None else templates, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            matches, whole = scan(batch.column("text"), known)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(matches, _MATCHES), pa.array(whole, pa.float64())], ["doc_id", "matches", "whole_dice"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, matches array<{MATCH}>, whole_dice double")


def license_passages(docs: DataFrame, templates: Sequence[tuple[str, str]] | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """One row per licence passage: doc_id, license, dice, shared, start, n_words, matched. Documents without one give no row."""
    return with_licenses(docs, templates, similarity).select("doc_id", F.inline("matches"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its best licence and Dice (null and 0 if none), all its licences, its passages, whole_dice."""
    found, best = with_licenses(read(spark, sf_dir, "documents")), F.get("matches", F.lit(0))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    return found.select(
        "doc_id", best["license"].alias("license"), F.coalesce(best["dice"], F.lit(0.0)).alias("dice"), best["matched"].alias("matched"), names.alias("licenses"),
        F.size("matches").cast("long").alias("n_matches"), "whole_dice",
    )
