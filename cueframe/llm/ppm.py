"""Language-model scores by prediction by partial matching over bytes, and a word unigram score beside it.

The trie of byte contexts is a table of grams (context and next symbol) of orders 0 to `order`, counted over all training
texts: tasks count the longest grams of their texts, one shuffle adds them up, and shorter orders are sums of longer
ones. Escapes follow method C. With symbol exclusion, an escape to a shorter context leaves out what the longer one has
seen; as a shorter context has seen all that its extensions have, the excluded counts depend on the context escaped from
only, and are kept with it. So the log probability of a symbol is one look-up if its longest gram is known, and a walk
down the trie otherwise, for all positions of a batch of texts at once.

Neither the trie nor the unigram counts have a bound, so only the most frequent of the longest grams (MAX_NODES at most,
with their log probabilities) and words (HEAD at most) go to the workers. The other grams of a document, seldom or never
seen, get theirs by joins with the tables of all grams and contexts, the other words' counts by a join on word hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueframe.llm.common import _LOWER, buffers, id_crc, read, slices, staged, words

ORDER = 4
MAX_NODES = 4_000_000  # grams whose log probabilities every worker holds
HEAD = 400_000  # words whose counts every worker holds
END, BEGIN, BITS = 256, 257, 9  # symbols besides the bytes, and bits of a symbol
SLICE = 2 << 20


# --- grams -----------------------------------------------------------------------------------------------------------


def grams(text: pa.Array, order: int, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each symbol of each text (its bytes, A-Z lowered, and END), and the n + 1 offsets of the texts."""
    raw, offsets = buffers(text)
    n = np.diff(offsets)
    at = np.concatenate([[0], np.cumsum(n + order + 1)])
    symbols = np.full(at[-1], BEGIN, np.uint64)
    inside = np.ones(at[-1], bool)
    for k in range(order):
        inside[at[:-1] + k] = False
    symbols[at[1:] - 1] = END
    body = inside.copy()
    body[at[1:] - 1] = False
    symbols[body] = _LOWER[raw]
    key = symbols.copy()
    for k in range(1, order + 1):
        key[k:] |= symbols[:-k] << np.uint64(BITS * k)
    if which is not None:
        inside &= np.repeat(which, n + order + 1)
        n = np.where(which, n, -1)
    return key[inside], np.concatenate([[0], np.cumsum(n + 1)])


def count_levels(texts: DataFrame, order: int) -> list[DataFrame]:
    """By order, (gram, c): all grams of all rows of texts (text), written as tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            gram, n = np.unique(grams(batch.column("text"), order)[0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(gram.view(np.int64)), "c": n})

    level = texts.select("text").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    levels = [staged(level, "grams")]
    for k in range(order, 0, -1):
        levels.append(staged(levels[-1].groupBy(_suffix("gram", k).alias("gram")).agg(F.sum("c").alias("c")), "grams"))
    return levels[::-1]


def count_grams(texts: DataFrame, order: int, max_nodes: int) -> DataFrame:
    """(ord, gram, c): a trie of at most max_nodes grams an order, small enough for a `Trie`. Scores use count_levels."""
    least, out = 1, None
    for k, level in enumerate(count_levels(texts, order)):  # shorter orders never keep less than longer ones
        while level.where(F.col("c") >= least).count() > max_nodes:
            least *= 2
        level = level.where(F.col("c") >= least).select(F.lit(k).alias("ord"), "gram", "c")
        out = level if out is None else out.union(level)
    return staged(out, "trie")


def _suffix(gram: str, symbols: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << BITS * symbols) - 1))


def _context(gram: Column) -> Column:
    return F.shiftright(gram, BITS)


def count_contexts(levels: list[DataFrame]) -> list[DataFrame]:
    """By order, of each context: log10 of its escape and denominator, plain, and after an escape from it (x_).

    A group here is the symbols of a context or the extensions of a gram by one symbol, so 258 rows at most.
    """
    out, below = [], None
    for k, level in enumerate(levels):
        rows = level
        if k:  # what the shorter context has counted of the same symbol is the sum over its extensions
            rows = rows.withColumn("seen", F.sum("c").over(Window.partitionBy(_suffix("gram", k))))
        sums = rows.groupBy(_context(F.col("gram")).alias("context")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"), *([F.sum("seen").alias("seen")] if k else []))
        if k:
            low = below.select(F.col("context").alias("low"), F.col("total").alias("low_total"), F.col("kinds").alias("low_kinds"))
            sums = sums.withColumn("low", _suffix("context", k - 1)).join(F.broadcast(low) if k <= 3 else low, "low")
            rest, kinds = F.col("low_total") - F.col("seen"), F.col("low_kinds") - F.col("kinds")
        else:
            rest = kinds = F.lit(0)
        below = staged(sums.select("context", "total", "kinds", rest.alias("rest"), kinds.alias("rest_kinds")), "contexts")
        whole, rest = F.col("total") + F.col("kinds"), F.col("rest") + F.col("rest_kinds")
        out.append(below.select(
            "context", F.log10(F.col("kinds") / whole).alias("escape"), F.log10(whole.cast("double")).alias("under"),
            F.when(F.col("rest_kinds") > 0, F.log10(F.col("rest_kinds") / rest)).otherwise(F.lit(0.0)).alias("x_escape"), F.log10(F.greatest(rest, F.lit(1)).cast("double")).alias("x_under"),
        ))
    return out


def log_chances(keys: DataFrame, levels: list[DataFrame], contexts: list[DataFrame]) -> DataFrame:
    """(gram, lp) for the distinct longest grams of keys (gram) that levels don't have: a walk down the trie by joins."""
    order = len(levels) - 1
    rows = keys.select("gram", F.lit(0.0).alias("lp"), F.lit(False).alias("done"), F.lit(None).cast("double").alias("escape"), F.lit(None).cast("double").alias("under"))
    for k in range(order, -1, -1):
        context = contexts[k].toDF("_context", "_escape", "_under", "_x_escape", "_x_under")
        rows = rows.withColumn("_context", _context(_suffix("gram", k + 1))).join(F.broadcast(context) if k <= 2 else context, "_context", "left")
        if k < order:
            level = levels[k].select(F.col("gram").alias("_gram"), F.col("c").alias("_c"))
            rows = rows.withColumn("_gram", _suffix("gram", k + 1)).join(F.broadcast(level) if k <= 1 else level, "_gram", "left")
        else:
            rows = rows.withColumn("_c", F.lit(None).cast("long"))
        escape, under = F.coalesce("escape", "_escape", F.lit(0.0)), F.coalesce("under", "_under")
        gain = F.when(F.col("done"), 0.0).when(F.col("_c").isNotNull(), F.log10(F.col("_c").cast("double")) - under).otherwise(escape)
        rows = rows.select("gram", (F.col("lp") + gain).alias("lp"), (F.col("done") | F.col("_c").isNotNull()).alias("done"), F.col("_x_escape").alias("escape"), F.col("_x_under").alias("under"))
    left = math.log10(max(1, END + 1 - levels[0].count()))
    return rows.select("gram", F.when(F.col("done"), F.col("lp")).otherwise(F.col("lp") - left).alias("lp"))


class Table:
    """A hash table from uint64 keys to their places, looked up for arrays of keys."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.places = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.places[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.places[slot[put]], self.keys[slot[put]] = left[put], keys[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.places[slot], -1)
        left = np.flatnonzero((out < 0) & (self.places[slot] >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slot[left]] == keys[left]
            out[left[hit]] = self.places[slot[left[hit]]]
            left = left[~hit & (self.places[slot[left]] >= 0)]
        return out


class Trie:
    """Log probabilities of all grams, escapes of all contexts with and without exclusion by a longer context."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels: by order, the sorted grams and their counts."""
        self.order = len(levels) - 1
        self.gram, self.log_c, self.node, self.parent = [], [], [], []
        self.plain, self.excluded = [], []  # (log10 of the escape, log10 of the denominator) of each context
        self.empty = not len(levels[0][0])
        shorter = None
        for k, (gram, c) in enumerate(levels):
            context = gram >> np.uint64(BITS)
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(gram) else np.zeros(0, int)
            node = context[first]
            total = np.add.reduceat(c, first) if len(gram) else np.zeros(0, int)
            kinds = np.diff(np.append(first, len(gram)))
            self.plain.append((np.log10(kinds / (total + kinds)), np.log10(total + kinds)))
            if k and len(gram):
                low_gram, low_c, low_node, low_total, low_kinds = shorter
                above = np.searchsorted(low_node, node & np.uint64((1 << BITS * (k - 1)) - 1))
                seen = low_c[np.searchsorted(low_gram, gram & np.uint64((1 << BITS * k) - 1))]
                rest, rest_kinds = low_total[above] - np.add.reduceat(seen, first), low_kinds[above] - kinds
                some = rest_kinds > 0
                self.excluded.append((np.where(some, np.log10(np.maximum(rest_kinds, 1) / np.maximum(rest + rest_kinds, 1)), 0.0), np.log10(np.maximum(rest + rest_kinds, 1))))
                self.parent.append(above)
            else:
                self.excluded.append((np.zeros(len(node)), np.zeros(len(node))))
                self.parent.append(np.zeros(len(node), int))
            self.gram.append(Table(gram))
            self.node.append(Table(node))
            self.log_c.append(np.log10(c))
            shorter = gram, c, node, total, kinds
        gram = levels[-1][0]
        self.direct = self.log_c[-1] - self.plain[-1][1][self.node[-1].find(gram >> np.uint64(BITS))] if len(gram) else np.zeros(0)
        self.left = END + 1 - len(levels[0][0])

    def log10(self, key: np.ndarray) -> np.ndarray:
        """The log10 probability of the last symbol of each longest gram."""
        at = self.gram[-1].find(key)
        out = np.where(at >= 0, self.direct[at] if len(self.direct) else 0.0, 0.0)
        todo = np.flatnonzero(at < 0)
        came = np.full(len(todo), -1)  # the node one order longer from which the escape came
        for k in range(self.order, -1, -1):
            if not len(todo):
                return out
            gram = key[todo] & np.uint64((1 << BITS * (k + 1)) - 1)
            inner = came >= 0
            node = np.where(inner, self.parent[k + 1][came], -1) if k < self.order and len(self.parent[k + 1]) else np.full(len(todo), -1)
            node[~inner] = self.node[k].find(gram[~inner] >> np.uint64(BITS))
            at = self.gram[k].find(gram)
            escape, below = np.zeros(len(todo)), np.zeros(len(todo))
            known = ~inner & (node >= 0)
            escape[known], below[known] = self.plain[k][0][node[known]], self.plain[k][1][node[known]]
            if inner.any():
                escape[inner], below[inner] = self.excluded[k + 1][0][came[inner]], self.excluded[k + 1][1][came[inner]]
            hit = at >= 0
            out[todo[hit]] += self.log_c[k][at[hit]] - below[hit]
            out[todo[~hit]] += escape[~hit]
            todo, came = todo[~hit], node[~hit]
        out[todo] -= math.log10(max(1, self.left))
        return out

    def scores(self, text: pa.Array) -> np.ndarray:
        key, at = grams(text, self.order)
        return np.add.reduceat(self.log10(key), at[:-1]) if len(text) else np.zeros(0)


def _rows(path: str) -> pa.Table:
    system, at = fs.FileSystem.from_uri(path)
    return pq.read_table(at, filesystem=system)


@lru_cache(1)
def load_grams(path: str) -> tuple[Table, np.ndarray]:
    """One per Python worker: grams and their log10 probabilities."""
    rows = _rows(path)
    return Table(rows["gram"].to_numpy().view(np.uint64)), rows["lp"].to_numpy()


@lru_cache(1)
def load_head(path: str) -> tuple[Table, np.ndarray]:
    rows = _rows(path)
    return Table(rows["w"].to_numpy().view(np.uint64)), rows["c"].to_numpy()


# --- words -----------------------------------------------------------------------------------------------------------


def _word_hashes(distinct: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, distinct), np.uint64, len(distinct))


def count_words(texts: DataFrame) -> DataFrame:
    """(w, c): 64-bit hashes of the words of all rows of texts (text), and how often each occurs, written as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            index, distinct, _ = words(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"w": pa.array(_word_hashes(distinct).view(np.int64)), "c": np.bincount(index, minlength=len(distinct))})

    return staged(texts.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "word-counts")


# --- scores ----------------------------------------------------------------------------------------------------------


def score_texts(docs: DataFrame, order: int = ORDER, max_nodes: int = MAX_NODES, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs.

    Both models learn from the rows outside the held-out fold, and score all rows; all scores are log10 probabilities.
    A null text is an empty one, whose only token or symbol is the end; repeated rows count each. With no row to learn
    from, train_tokens is 0, a symbol has one of 257 chances and a token 1. Other columns of docs are not read. No rows
    give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", id_crc(F.col("doc_id")) % 7 == 2)
    training = rows.where("not held_out")
    levels, counts = count_levels(training, order), count_words(training)
    contexts = count_contexts(levels)
    direct = levels[-1].withColumn("context", _context(F.col("gram"))).join(contexts[-1], "context")
    direct = staged(direct.select("gram", "c", (F.log10(F.col("c").cast("double")) - F.col("under")).alias("lp")), "chances")
    often = 1
    while direct.where(F.col("c") >= often).count() > max_nodes:
        often *= 2
    held = staged(direct.where(F.col("c") >= often).select("gram", "lp"), "head-grams")
    least = 1
    while counts.where(F.col("c") >= least).count() > head:
        least *= 2
    top = staged(counts.where(F.col("c") >= least), "head-words")
    ends = training.count()
    vocabulary, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    vocabulary, total = vocabulary + (ends > 0), total + ends
    gram_path, head_path = (t.inputFiles()[0].rsplit("/", 1)[0] for t in (held, top))
    floor, end = math.log10(total + vocabulary + 1), math.log10(ends + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model, lp), (table, counted) = load_grams(gram_path), load_head(head_path)
        for batch in slices(batches, size=SLICE):
            text = batch.column("text")
            index, distinct, per_row = words(text)
            hashed = _word_hashes(distinct)
            at = table.find(hashed)
            known = at >= 0
            gain = np.where(known, np.log10(counted[at] + 1) if len(counted) else 0.0, 0.0)
            row = np.repeat(np.arange(len(per_row)), per_row)
            rare = ~known[index] if len(index) else np.zeros(0, bool)
            pairs = (row[rare] << 32) | index[rare]
            pairs, times = np.unique(pairs, return_counts=True)
            cuts = np.searchsorted(pairs >> 32, np.arange(len(per_row) + 1)).astype(np.int32)
            key, ends = grams(text, order)
            at = model.find(key)
            score = np.add.reduceat(np.where(at >= 0, lp[at] if len(lp) else 0.0, 0.0), ends[:-1]) if len(text) else np.zeros(0)
            other, place = np.unique(key[at < 0], return_inverse=True)
            others, other_times = np.unique((np.repeat(np.arange(len(text)), np.diff(ends))[at < 0] << 32) | place, return_counts=True)
            other_cuts = np.searchsorted(others >> 32, np.arange(len(text) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n": per_row + 1,
                "known": np.bincount(row[~rare], minlength=len(per_row)), "base": np.bincount(row, gain[index] if len(index) else None, len(per_row)) if len(index) else np.zeros(len(per_row)),
                "score": score,
                "rare": pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashed[pairs & 0xFFFFFFFF].view(np.int64) if len(pairs) else np.zeros(0, np.int64))),
                "times": pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int64))),
                "other": pa.ListArray.from_arrays(pa.array(other_cuts), pa.array(other[others & 0xFFFFFFFF].view(np.int64) if len(others) else np.zeros(0, np.int64))),
                "other_times": pa.ListArray.from_arrays(pa.array(other_cuts), pa.array(other_times.astype(np.int64))),
            })

    fields = "doc_id long, held_out boolean, n long, known long, base double, score double, rare array<long>, times array<long>, other array<long>, other_times array<long>"
    scored = rows.mapInArrow(run, fields)
    scored = staged(scored.withColumn("rid", F.monotonically_increasing_id()), "scores")
    pairs = scored.where(F.size("rare") > 0).select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("w"), F.col("x.times").alias("times"))
    found = pairs.join(counts.where(F.col("c") < least), "w")
    more = found.groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_base"), F.sum("times").alias("more_known"))
    others = scored.where(F.size("other") > 0).select("rid", F.explode(F.arrays_zip("other", "other_times")).alias("x")).select("rid", F.col("x.other").alias("gram"), F.col("x.other_times").alias("times"))
    seldom = direct.where(F.col("c") < often).select("gram", "lp")
    never = staged(others.select("gram").distinct().join(seldom, "gram", "left_anti"), "unseen-grams")
    chances = seldom.union(staged(log_chances(never, levels, contexts), "unseen-chances"))
    more_score = others.join(chances, "gram").groupBy("rid").agg(F.sum(F.col("times") * F.col("lp")).alias("more_score"))
    out = scored.drop("rare", "times", "other", "other_times").join(more, "rid", "left").join(more_score, "rid", "left")
    return out.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + end - F.col("n") * floor).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def adaptive_log10(text: str, order: int = ORDER) -> float:
    """log10 probability of a text under a trie that starts empty and learns each symbol after coding it."""
    trie: dict[tuple, dict[int, int]] = {}
    symbols, out = [*text.encode().lower(), END], 0.0
    for i, s in enumerate(symbols):
        gone: set[int] = set()
        for k in range(min(order, i), -1, -1):
            seen = trie.get(tuple(symbols[i - k : i]), {})
            left = {x: c for x, c in seen.items() if x not in gone}
            if left:
                whole = sum(left.values()) + len(left)
                if s in left:
                    out += math.log10(left[s] / whole)
                    break
                out += math.log10(len(left) / whole)
                gone |= left.keys()
        else:
            out -= math.log10(END + 1 - len(gone))
        for k in range(min(order, i) + 1):
            node = trie.setdefault(tuple(symbols[i - k : i]), {})
            node[s] = node.get(s, 0) + 1
    return out


def adaptive_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id and score of each row by adaptive_log10: short and repetitive texts stand out without any training text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": [adaptive_log10(t, order) for t in batch.column("text").to_pylist()]})

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")


def op3_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))
