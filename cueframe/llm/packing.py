"""Best-fit packing of token sequences by hierarchical residual packing.

Texts become pieces of at most `capacity` ids, which are dealt to leaves, the pieces of each length evenly. A leaf packs
its pieces by best fit, longest first, and emits the sequences that are nearly full. Underfull ones are items of the node
above, which packs those of FAN_IN children by best fit again, and so on to the root, which emits what is left; nothing
is closed early. Best fit depends on how many items have each length only, so a node works on counts: sequences with the
same contents by length are a run, and a run takes items of one length in one step. What a node reads and hands on is
bounded by the number of lengths, not of pieces, also where nothing fits together.

Each piece then looks up its place: by leaf, length and rank among the leaf's pieces of that length, and from there, with
its sequence in place of the piece, level by level.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cueframe.llm.common import id_text, read, slices, staged
from cueframe.llm.encoding import encoder, vocabulary

CAPACITY = 2048
LEAF = 50_000  # pieces of a leaf
FAN_IN = 16
NEARLY = 128  # a sequence with less than capacity / NEARLY ids of room is nearly full
END = 0
PIECES = "doc_id bigint, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary_path)
        for batch in slices(batches, size=2 << 20):
            ids, at = encode.encode(batch.column("text"))
            row, piece, start, length, crc = [], [], [], [], []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                for k, s in enumerate(range(0, len(own), capacity)):
                    part = own[s : s + capacity]
                    row.append(i), piece.append(k), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            values = {"piece": pa.array(piece, pa.int32())} | {k: pa.array(v, pa.int64()) for k, v in (("start", start), ("length", length), ("ids_crc32", crc))}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), **values})

    return id_text(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """For items in falling length: the bin of each, its offset in it, and the fill of each bin.

    An item goes to the fullest bin that can hold it. A bit mask over the free lengths finds that bin in one step. This
    is the plain form of what plan() does with counts.
    """
    bins, offsets, fill = [], [], []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for n in lengths:
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins.append(b)
        offsets.append(capacity - room)
        fill[b] = capacity - room + n
        if room > n:
            free[room - n].append(b)
            mask |= 1 << (room - n)
    return bins, offsets, fill


STEP = "node long, length long, rank long, each long, bins long, fill long, first long, at long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Best fit of counts[n] items of each length n, in falling length: steps (length, rank, each, bins, fill, first, at).

    The items of a length from `rank` on go to so many bins, `each` of them to a bin, the first at place `at` of it.
    These are bins that in the end hold `fill`, the first of them being number `first` of those.
    """
    # by room, runs of bins: their number, and of each step so far its length, first rank, items a bin, and place
    free: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for n in sorted(counts, reverse=True):
        rank, left = 0, counts[n]
        while left:
            fits = mask >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                bins, steps = free[room].pop()
                if not free[room]:
                    mask ^= 1 << room
            else:
                room, bins, steps = capacity, -(-left // (capacity // n)), ()
            each = min(left, room // n)
            use = min(bins, left // each)
            rest = tuple((m, r + e * use, e, at) for m, r, e, at in steps)
            for r, k, own in ((room - each * n, use, (*steps, (n, rank, each, capacity - room))), (room, bins - use, rest)):
                if k:
                    free[r].append((k, own))
                    mask |= (r > 0) << r
            rank, left = rank + each * use, left - each * use
    out = []
    for room, runs in enumerate(free):
        first = 0
        for bins, steps in runs:
            out += [(n, rank, each, bins, capacity - room, first, at) for n, rank, each, at in steps]
            first += bins
    return out


def _planned(items: DataFrame, capacity: int) -> DataFrame:
    """The steps of each node; items: (node, length, n)."""

    def fit(pdf):
        import pandas as pd

        steps = plan(dict(zip(pdf["length"].tolist(), pdf["n"].tolist(), strict=True)), capacity)
        return pd.DataFrame([(int(pdf["node"].iloc[0]), *x) for x in steps], columns=[x.split()[0] for x in STEP.split(", ")])

    return staged(items.groupBy("node").applyInPandas(fit, STEP), "pack-steps")


def _shift(leaves: int) -> Column:
    """The leaf of the first piece of a length."""
    return F.pmod(F.xxhash64("length"), F.lit(leaves))


def _tree(totals: DataFrame, leaves: int, capacity: int, fan_in: int) -> list[DataFrame]:
    """By level, (node, length, steps): where the items of a node go; totals: (length, n) of all pieces.

    A step holds rank, each, fill, at, closed, and first: the number of its first sequence if closed, else its rank
    among the items of the node above.
    """
    slot = F.pmod(F.col("node") - _shift(leaves), F.lit(leaves))  # a leaf has each leaves-th piece of a length
    items = totals.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(leaves - 1)).cast("array<long>")))
    items = items.withColumn("n", F.floor((F.col("n") - slot + (leaves - 1)) / leaves)).where("n > 0")
    found, nodes = [], leaves
    while True:
        steps = _planned(items, capacity).withColumn("closed", F.lit(nodes == 1) | (F.col("fill") > capacity - capacity // NEARLY))
        found.append(steps)
        if nodes == 1:
            break
        nodes = -(-nodes // fan_in)
        bins = steps.where("at = 0 and not closed").groupBy("node", "fill").agg(F.sum("bins").alias("n"))
        items = bins.groupBy(F.floor(F.col("node") / fan_in).alias("node"), F.col("fill").alias("length")).agg(F.sum("n").alias("n"))
    emitted = None
    for level, steps in enumerate(found):
        own = steps.where("at = 0 and closed").groupBy("node", "fill").agg(F.sum("bins").alias("n")).withColumn("level", F.lit(level))
        emitted = own if emitted is None else emitted.union(own)
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("level", "node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nodes_ahead = emitted.groupBy("level", "node").agg(F.sum("n").alias("n")).withColumn("base", ahead).drop("n")  # a row for each node
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("level", "node").orderBy("fill").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = staged(emitted.withColumn("inside", inside).join(nodes_ahead, ["level", "node"]).select("level", "node", "fill", (F.col("inside") + F.col("base")).alias("base")), "pack-numbers")
    out = []
    for level, steps in enumerate(found):
        bins = steps.where("at = 0 and not closed").groupBy("node", "fill").agg(F.sum("bins").alias("n"))
        siblings = Window.partitionBy(F.floor(F.col("node") / fan_in), "fill").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        handed = bins.select("node", "fill", F.coalesce(F.sum("n").over(siblings), F.lit(0)).alias("base"), F.lit(False).alias("closed"))
        base = handed.unionByName(numbers.where(F.col("level") == level).select("node", "fill", "base", F.lit(True).alias("closed")))
        step = F.struct("rank", "each", "fill", "at", "closed", (F.col("first") + F.col("base")).alias("first"))
        out.append(staged(steps.join(base, ["node", "fill", "closed"]).groupBy("node", "length").agg(F.array_sort(F.collect_list(step)).alias("steps")), "pack-level"))
    return out


def sequences(items: DataFrame, capacity: int = CAPACITY, leaf: int = LEAF, fan_in: int = FAN_IN) -> DataFrame:
    """items (length and any other columns but part and nth; no length above capacity), with bin and shift, its place in the bin."""
    schema = StructType([*items.schema.fields, StructField("part", IntegerType()), StructField("nth", LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            length = batch.column("length").to_numpy()
            order = np.argsort(length, kind="stable")
            kinds, first, times = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(first, times) + np.repeat(seen[kinds], times)
            seen[kinds] += times
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(nth)], [*batch.schema.names, "part", "nth"])

    numbered = staged(items.mapInArrow(number, schema), "pieces")
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = staged(numbered.groupBy("length", "part").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))), "piece-counts")
    totals = sizes.groupBy("length").agg(F.sum("n").alias("n"))
    leaves = max(1, (totals.agg(F.sum("n")).first()[0] or 0) // leaf)
    rank = F.col("nth") + F.col("ahead")
    rows = numbered.join(sizes.select("length", "part", "ahead"), ["length", "part"])
    rows = rows.select(
        F.struct(*items.columns).alias("item"), F.pmod(rank + _shift(leaves), F.lit(leaves)).alias("node"), "length", F.floor(rank / leaves).alias("rank"),
        F.lit(0).cast("long").alias("shift"), F.lit(None).cast("long").alias("bin"),
    )
    for level in _tree(totals, leaves, capacity, fan_in):
        # an item that has its sequence already joins like the others, and stays as it is
        step = F.element_at(F.filter("steps", lambda x: x["rank"] <= F.col("rank")), -1)
        rows = rows.join(level, ["node", "length"], "left").withColumn("step", F.when(F.col("bin").isNull(), step))
        nth = F.col("rank") - F.col("step.rank")
        to = F.col("step.first") + F.floor(nth / F.col("step.each"))
        place = F.col("step.at") + nth % F.col("step.each") * F.col("length")
        rows = rows.select(
            "item", F.when(F.col("bin").isNull(), F.floor(F.col("node") / fan_in)).otherwise(F.col("node")).alias("node"), F.coalesce("step.fill", "length").alias("length"), F.coalesce(to, "rank").alias("rank"),
            (F.col("shift") + F.coalesce(place, F.lit(0))).alias("shift"), F.coalesce("bin", F.when(F.col("step.closed"), to)).alias("bin"),
        )
    return rows.select("item.*", "bin", "shift")


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one, whose only id is the end id. Rows of one doc_id, or with none, are packed each on its
    own. Other columns of docs are not read. No rows give no pieces.
    """
    placed = sequences(pieces(docs, vocabulary_path, capacity), capacity)
    return placed.withColumnsRenamed({"bin": "sequence_id", "shift": "offset"})


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
