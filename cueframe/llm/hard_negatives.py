"""Hard negatives by an exact k-nearest-neighbour join over a Voronoi partition.

The highest inner product becomes the nearest neighbour by one more component: a row x gets sqrt(M - |x|²), where M is the
largest squared norm, and an anchor gets 0. Rows go to the nearest of a sample of pivots and keep their distance r to it.
For an anchor q and a row x of pivot p, q·x <= q·p + |q| r. Anchors form groups around a few head pivots. A group is served
a pivot's rows only from that distance on at which the bound reaches the score that one of its anchors still has to beat.
That score comes from a first round, in which each group meets its anchors' own cells; a second round serves the rest.
In a cell (a block of a group, a chunk of rows) anchors are held and rows stream by, so memory doesn't grow with either.

Two such joins make the result: the best rows of the same label, and, for each of their scores, the best rows of another
label inside a window below it. Of equal vectors of a label only as many of the smallest ids take part as any anchor could
get; equal anchors are asked once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueframe.llm.common import read, staged

PIVOTS = 512  # rows in the sample that become pivots
GROUP, CHUNK = 65_536, 65_536  # anchors and rows of a cell, about
GROUPS, CHUNKS = 4, 8  # of which there are at least so many
LEAST, MOST = -(1 << 62), 1 << 62


# --- rows ------------------------------------------------------------------------------------------------------------


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Writes (vec_id, label, vec): components floor(256 x) as little-endian int64, shorter vectors filled up with zeros."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(fine)
    most, dim = rows.agg(F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))), F.max(F.size("v"))).first()
    dim = dim or 0
    if (256 * (most or 0) + 1) ** 2 * dim >= 2**53:
        raise ValueError("scores of these vectors can go beyond 2 ** 53")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            size = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.zeros((len(batch), dim), "<i8")
            out[np.arange(dim) < size[:, None]] = np.floor(256 * v.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([x.tobytes() for x in out], pa.binary())], ["vec_id", "label", "vec"])

    return staged(rows.mapInArrow(pack, "vec_id long, label string, vec binary").distinct(), "vectors")


def _matrix(col: pa.Array) -> np.ndarray:
    """Packed vectors as rows of doubles, which hold their products exactly."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    data = [x.as_buffer() for x in col]
    return np.frombuffer(b"".join(data), "<i8").reshape(len(data), -1).astype(np.float64) if data else np.zeros((0, 0))


class Pivots:
    """The sample and what the bounds need of it. M: the largest squared norm of all rows."""

    def __init__(self, sample: np.ndarray, most: float):
        self.at, self.most = sample, most
        self.lift = np.sqrt(np.maximum(0, most - (sample**2).sum(axis=1)))
        self.slack = 1e-9 * most + 1e-6  # for rounding; it only ever lets more rows through

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of rows, and the distance to it."""
        norm = (x**2).sum(axis=1)
        inner = x @ self.at.T + np.sqrt(np.maximum(0, self.most - norm))[:, None] * self.lift
        near = inner.argmax(axis=1)
        return near, np.sqrt(np.maximum(0, 2 * self.most - 2 * inner[np.arange(len(x)), near]))


# --- one cell --------------------------------------------------------------------------------------------------------


class Cell:
    """Anchors of a cell with what each still wants: slots of (least, most) scores, and for each the best k rows so far."""

    def __init__(self, rows: list[pa.RecordBatch], k: int, same: bool):
        t = pa.Table.from_batches(rows)
        self.k, self.same = k, same
        self.ids, self.vec, self.label = t["id"].to_numpy(), _matrix(t["vec"]), np.array(t["label"].to_pylist(), object)
        low, high = t["lows"].to_pylist(), t["highs"].to_pylist()
        slots = max(map(len, low), default=0)
        self.low, self.high = np.full((len(low), slots), MOST), np.full((len(low), slots), LEAST)
        for i, (a, b) in enumerate(zip(low, high, strict=True)):
            self.low[i, : len(a)], self.high[i, : len(b)] = a, b
        self.score = np.full((len(low), slots, k), LEAST)
        self.row = np.zeros((len(low), slots, k), np.int64)

    def meet(self, batch: pa.RecordBatch) -> None:
        ids, vec, label = batch.column("id").to_numpy(), _matrix(batch.column("vec")), np.array(batch.column("label").to_pylist(), object)
        names = {x: i for i, x in enumerate(dict.fromkeys(label))}
        theirs = np.array([names[x] for x in label], np.int64)
        mine = np.array([names.get(x, -1) for x in self.label], np.int64)
        for a in range(0, len(self.ids), 256):
            part = slice(a, a + 256)
            score = (self.vec[part] @ vec.T).astype(np.int64)
            allowed = (mine[part, None] == theirs) == self.same
            for slot in range(self.low.shape[1]):
                least = np.maximum(self.low[part, slot], self.score[part, slot, -1])  # equal scores may have smaller ids
                i, j = np.nonzero(allowed & (score >= least[:, None]) & (score <= self.high[part, slot, None]))
                if not len(i):
                    continue
                held, place = np.nonzero(self.score[part, slot] > LEAST)
                who = np.concatenate([i, held])
                what = np.concatenate([score[i, j], self.score[part, slot][held, place]])
                which = np.concatenate([ids[j], self.row[part, slot][held, place]])
                order = np.lexsort((which, -what, who))
                who, what, which = who[order], what[order], which[order]
                rank = np.arange(len(who)) - np.flatnonzero(np.append(True, who[1:] != who[:-1]))[np.cumsum(np.append(True, who[1:] != who[:-1])) - 1]
                keep = rank < self.k
                self.score[a + who[keep], slot, rank[keep]] = what[keep]
                self.row[a + who[keep], slot, rank[keep]] = which[keep]

    def result(self) -> pa.RecordBatch:
        i, slot, k = np.nonzero(self.score > LEAST)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[i], slot, self.score[i, slot, k], self.row[i, slot, k])], ["qid", "slot", "score", "vec_id"])


FOUND = "qid long, slot long, score long, vec_id long"


def _meet_in_cells(cells: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best rows of each anchor and slot in each cell; anchors (kind 0) sort before rows (kind 1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, cell = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("grp", "block", "chunk", "kind")], axis=1)
            cuts = np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(axis=1))).tolist() if len(batch) else []
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                own, kind = tuple(marks[a, :3]), marks[a, 3]
                if own != key:
                    if cell:
                        yield cell.result()
                    key, anchors, cell = own, [], None
                if kind == 0:
                    anchors.append(batch.slice(a, b - a))
                elif anchors:
                    cell = cell or Cell(anchors, k, same)
                    for at in range(a, b, 2000):
                        cell.meet(batch.slice(at, min(2000, b - at)))
        if cell:
            yield cell.result()

    cells = cells.repartition("grp", "block", "chunk").sortWithinPartitions("grp", "block", "chunk", "kind")
    return cells.mapInArrow(work, FOUND)


# --- the join --------------------------------------------------------------------------------------------------------


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and slot; partitions keep their k best before they are shuffled."""
    own = Window.partitionBy("qid", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k).drop("place")


def _needs(asked: DataFrame, pivots: Pivots, reach: np.ndarray, home: bool) -> DataFrame:
    """(grp, pivot, least): from which distance on a group has to see a pivot's rows; one row a pair, reduced in tasks first.

    reach: the largest distance of a pivot's rows, negative where it has none. home: each anchor's own pivot only.
    """

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _matrix(batch.column("vec"))
            if not len(x):
                continue
            groups, goal = batch.column("grp").to_numpy(), batch.column("goal").to_numpy()
            inner = x @ pivots.at.T
            norm = np.sqrt((x**2).sum(axis=1))[:, None]
            short = goal[:, None] - inner - pivots.slack
            with np.errstate(divide="ignore", invalid="ignore"):
                from_ = np.where(short <= 0, 0.0, np.where(norm > 0, short / norm, np.inf))
            if home:
                from_ = np.where(np.arange(len(reach)) == inner.argmax(axis=1)[:, None], 0.0, np.inf)
            from_[:, reach < 0] = np.inf
            from_[from_ > reach + pivots.slack] = np.inf
            for g in np.unique(groups).tolist():
                mine = from_[groups == g].min(axis=0)
                least[g] = np.minimum(least.get(g, np.inf), mine)
        for g, x in least.items():
            some = np.flatnonzero(np.isfinite(x))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), g), pa.int64()), pa.array(some, pa.int64()), pa.array(x[some])], ["grp", "pivot", "least"])

    return asked.select("grp", "vec", "goal").mapInArrow(bound, "grp long, pivot long, least double").groupBy("grp", "pivot").agg(F.min("least").alias("least"))


def _serve(asked: DataFrame, rows: DataFrame, needs: DataFrame, sizes: DataFrame, chunks: int, k: int, same: bool) -> DataFrame:
    """Sends rows to the groups that need them and returns what their cells find."""
    reached = rows.join(needs, "pivot").where("dist >= least").join(sizes, "grp")
    none = F.array().cast("array<long>")
    right = reached.select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "label", "vec", none.alias("lows"), none.alias("highs"))
    left = asked.select("grp", "block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(0).alias("kind"), F.col("qid").alias("id"), "label", "vec", "lows", "highs")
    return _meet_in_cells(left.unionByName(right), k, same)


def voronoi_join(asked: DataFrame, rows: DataFrame, pivots: Pivots, reach: np.ndarray, chunks: int, k: int, same: bool) -> DataFrame:
    """(qid, slot, score, vec_id): of each anchor and slot the k best rows, highest scores first, then smaller vec_id.

    asked: (qid, label, vec, grp, block, lows, highs), where lows and highs hold a window of scores for each slot; rows:
    (vec_id, label, vec, pivot, dist). same: rows of the anchor's label only, else of other labels only. Exact: a row is
    left out only where the bound shows that it is below the window or below k rows already found.
    """
    asked = asked.withColumn("goal", F.array_min("lows").cast("double"))
    sizes = asked.groupBy("grp").agg(F.max("block").alias("blocks")).withColumn("blocks", F.col("blocks") + 1)
    first = staged(_needs(asked, pivots, reach, True), "needs")
    found = staged(_best(_serve(asked, rows, first, sizes, chunks, k, same), k), "found")
    # what a slot still has to beat: its k-th score, or its window's end
    slots = asked.select("qid", F.posexplode("lows").alias("slot", "low"))
    kth = found.groupBy("qid", F.col("slot").cast("int").alias("slot")).agg(F.count("*").alias("n"), F.min("score").alias("score"))
    goals = slots.join(kth, ["qid", "slot"], "left").groupBy("qid").agg(F.min(F.when(F.col("n") >= k, F.greatest("low", "score")).otherwise(F.col("low"))).cast("double").alias("goal"))
    rest = _needs(asked.drop("goal").join(goals, "qid"), pivots, reach, False).join(first, ["grp", "pivot"], "left_anti")
    more = _serve(asked, rows, staged(rest, "needs"), sizes, chunks, k, same)
    return _best(found.unionByName(more), k)


def hard_negatives(vectors: DataFrame, anchors_mod: int = 50, positives: int = 5, negatives: int = 3, window: tuple[int, int, int] = (50, 95, 100), pivots: int = PIVOTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for rows (vec_id, embedding, label).

    Anchors are rows whose vec_id is divisible by anchors_mod; positives are the best other rows of the label; negatives
    are the best rows of other labels whose score times window[2] lies between window[0] and window[1] times the
    positive's score. Rows with a null vec_id or label, a null vector, or a null or non-finite component take no part.
    Ties go to the smaller vec_id. Rows repeated in all three columns count once; rows of one vec_id that differ are rows
    of their own, but none is a positive of another. A shorter vector counts as filled up with zeros, so an empty one
    scores 0 with all. A positive with a negative score has no window. Other columns are not read. No rows give no rows.
    Vectors so long that a score could pass 2 ** 53 are refused.
    """
    spark = vectors.sparkSession
    low_share, high_share, whole = window
    packed = quantised(vectors)
    most_copies = max(positives + 1, negatives)
    copies = Window.partitionBy("label", "vec").orderBy("vec_id")
    rows = packed.withColumn("place", F.row_number().over(copies)).where(F.col("place") <= most_copies).drop("place")
    anchors = packed.where(F.col("vec_id") % anchors_mod == 0)
    asked = staged(anchors.groupBy("label", "vec").agg(F.count("*").alias("n")).withColumn("qid", F.monotonically_increasing_id()), "anchors")

    sample = _matrix(pa.array([bytes(x.vec) for x in packed.orderBy(F.xxhash64("vec_id", "label", "vec"), "vec_id").limit(pivots).select("vec").collect()], pa.binary()))
    if not len(sample):
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array((_matrix(batch.column("vec")) ** 2).sum(axis=1))], ["norm"])

    most = packed.select("vec").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]
    points = Pivots(sample, most)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, dist = points.nearest(_matrix(batch.column("vec"))) if len(batch) else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64()), pa.array(dist)], ["vec_id", "label", "vec", "pivot", "dist"])

    rows = staged(rows.select("vec_id", "label", "vec").mapInArrow(assign, "vec_id long, label string, vec binary, pivot long, dist double"), "cells")
    reach, count = np.full(len(sample), -1.0), 0
    for x in rows.groupBy("pivot").agg(F.max("dist").alias("dist"), F.count("*").alias("n")).collect():  # a row for each pivot
        reach[x.pivot], count = x.dist, count + x.n
    total = asked.count()
    heads = sample[: min(len(sample), max(GROUPS, -(-total // GROUP)))]

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_matrix(batch.column("vec")) @ heads.T).argmax(axis=1) if len(batch) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64())], ["qid", "label", "vec", "grp"])

    asked = asked.select("qid", "label", "vec").mapInArrow(group, "qid long, label string, vec binary, grp long")
    sizes = asked.groupBy("grp").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"))
    asked = asked.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("qid"), "blocks").cast("int")).drop("blocks")
    asked = staged(asked, "asked")
    chunks = max(CHUNKS, -(-count // CHUNK))

    every = F.array(F.lit(LEAST).cast("long")), F.array(F.lit(MOST).cast("long"))
    best = voronoi_join(asked.withColumns({"lows": every[0], "highs": every[1]}), rows, points, reach, chunks, positives + 1, True)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "score")))
    best = staged(best.groupBy("qid").agg(ranked.alias("best")), "positives")

    scores = F.array_distinct(F.filter(F.transform("best", lambda x: x["score"]), lambda s: s >= 0))
    wanted = best.select("qid", scores.alias("scores")).where(F.size("scores") > 0)
    wanted = wanted.withColumn("lows", F.transform("scores", lambda s: F.ceil(s * low_share / whole)))
    wanted = wanted.withColumn("highs", F.transform("scores", lambda s: F.floor(s * high_share / whole)))
    wanted = staged(asked.join(wanted, "qid"), "wanted")
    below = voronoi_join(wanted, rows, points, reach, chunks, negatives, False)
    below = below.groupBy("qid", "slot").agg(ranked.alias("below")).join(wanted.select("qid", "scores"), "qid")
    below = below.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct(F.get("scores", F.col("slot").cast("int")), "below"))).alias("below"))

    result = anchors.join(asked.select("qid", "label", "vec"), ["label", "vec"]).select(F.col("vec_id").alias("anchor_id"), "qid").join(best, "qid").join(below, "qid")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("anchor_id")), 1, positives)
    result = result.select("anchor_id", F.explode(others).alias("p"), "below")
    result = result.select("anchor_id", "p", F.posexplode(F.try_element_at("below", F.col("p.score"))).alias("at", "n"))
    return result.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", moved.alias("label")))


OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""
