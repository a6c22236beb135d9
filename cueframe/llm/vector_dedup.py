"""Near copies among embeddings by randomised-rotation binary codes with stored correction factors.

Equal vectors of a label are one class with a weight. A class is coded as the signs of its rotated unit vector and one
factor, the inner product of vector and code. For a query quantised to four bits with randomised rounding, popcounts give
an unbiased estimate of the cosine with a confidence bound that follows from the factor; pairs whose estimate plus bound
stays below the threshold are done, all others are recomputed in double precision.

Which classes are estimated against each other is decided by tables of rotated sign bits: as many bits as leave about
BUCKET classes in a bucket, and as many tables as let a pair at the threshold meet with probability `recall`, the same at
every size. Estimates are cheap beside a copy of a vector, so buckets are wide and tables few. A pair is counted in the
first table where it meets. Buckets are cut into blocks, blocks meet in cells of bounded size, and a cell
returns sums of weights and a spanning forest of its links, never all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueframe.llm.common import components, read, staged
from cueframe.llm.jaccard_join import runs_of

BUCKET, BLOCK = 1024, 1024
EPSILON = 3.0  # width of the confidence bound in standard units
RECALL = 0.995  # of pairs exactly at the threshold; nearer pairs meet more often


@lru_cache(16)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation of dim dimensions, padded to whole words."""
    full = 64 * -(-dim // 64)
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((full, full)))
    return (q * np.sign(np.diag(r)))[:dim]


@lru_cache(16)
def planes(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, 1]).standard_normal((dim, count))


def encode(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows of uint64) and correction factors of unit vectors."""
    turned = unit @ rotation(unit.shape[1], seed)
    code = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    return code, np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])


def estimates(code: np.ndarray, factor: np.ndarray, unit: np.ndarray, seed: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the cosines of unit (rows) with the coded vectors (columns), and the half-width of the bound."""
    q = unit @ rotation(unit.shape[1], seed)
    full = q.shape[1]
    low, step = q.min(axis=1, keepdims=True), np.maximum(np.ptp(q, axis=1, keepdims=True) / 15, 1e-12)
    level = np.clip(np.floor((q - low) / step + rng.random(q.shape)), 0, 15).astype(np.uint8)
    dots = np.zeros((len(q), len(code)))
    for bit in range(4):
        plane = np.packbits((level >> bit) & 1, axis=1, bitorder="little").view(np.uint64)
        for word in range(code.shape[1]):
            dots += float(1 << bit) * np.bitwise_count(plane[:, word, None] & code[None, :, word])
    ones = np.bitwise_count(code).sum(axis=1)
    inner = (2 * step * dots + 2 * low * ones - step * level.sum(axis=1, keepdims=True) - full * low) / math.sqrt(full)
    # variance of the code's error, and of the query's rounding: step ** 2 / 4 a dimension at most
    return inner / factor, EPSILON * np.sqrt(np.maximum(0, 1 - factor**2) / max(1, full - 1) + step**2 / 4) / factor


def tables(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table and number of tables for labels of up to n classes."""
    bits = min(40, max(0, int(math.log2(max(1, n / BUCKET)))))
    meet = (1 - math.acos(min(1, threshold)) / math.pi) ** bits
    return bits, 1 if meet >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _links(g: pa.Table, seed: int, threshold: float) -> tuple[list[int], list[int], list[int]]:
    """Of one cell: a, b and w, where w adds to a's links, and b, if there is one, is joined to a."""
    node, weight, block, table = (g[c].to_numpy() for c in ("node", "w", "block", "table"))
    vectors = g["vector"].combine_chunks()
    rows = np.stack([np.frombuffer(x.as_buffer(), np.float64 if len(x.as_buffer()) == 8 * g["dim"][0].as_py() else np.float32) for x in vectors]).astype(np.float64)
    keys = np.stack([np.frombuffer(x.as_buffer(), np.int64) for x in g["keys"].combine_chunks()])[:, : table[0]]
    norm = np.sqrt((rows * rows).sum(axis=1))
    unit = rows / norm[:, None]
    code, factor = encode(unit, seed)
    rng = np.random.default_rng(seed)
    mixed, sums, root = block.min() != block.max(), np.zeros(len(node), np.int64), np.arange(len(node))
    edges = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(0, len(node), 128):
        est, width = estimates(code, factor, unit[a : a + 128], seed, rng)
        x, y = np.nonzero(est + width >= threshold)
        x += a
        ok = (block[x] != block[y]) & (x < y) if mixed else x < y
        x, y = x[ok], y[ok]
        ok = np.einsum("ij,ij->i", rows[x], rows[y]) / (norm[x] * norm[y]) >= threshold
        x, y = x[ok], y[ok]
        ok = ~(keys[x] == keys[y]).any(axis=1)  # met in an earlier table
        x, y = x[ok], y[ok]
        np.add.at(sums, x, weight[y])
        np.add.at(sums, y, weight[x])
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            p, r = find(i), find(j)
            if p != r:
                root[p] = r
                edges.append((i, j))
    some = np.flatnonzero(sums)
    return [*node[some].tolist(), *(int(node[i]) for i, _ in edges)], [*[None] * len(some), *(int(node[j]) for _, j in edges)], [*sums[some].tolist(), *[0] * len(edges)]


def near_vectors(vectors: DataFrame, threshold: float = 0.93, seed: int = 11, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row (vec_id, embedding, label) of vectors.

    Only vectors of one label and one length are compared. A vector that is null, zero, or holds a null or a value that
    isn't finite, or whose label is null, links with nothing and is its own component. Equal vectors link. Repeated
    rows are vectors of their own; a null vec_id stands for a component only where there is no other. Other columns are
    not read. No rows give no rows. Links of a pair at the threshold are found with probability `recall`, of nearer pairs
    with a higher one; none is false. Components of equal least vec_id are one.
    """
    exact = vectors.schema["embedding"].dataType.simpleString() != "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>" if exact else "array<float>"), F.col("label").cast("string"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(F.col("label").isNotNull() & fine & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", good)
    classes = rows.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("w"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, count = tables(most, threshold, recall)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(bits, dtype=np.int64)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                out = {k: [] for k in ("label", "dim", "table", "bucket", "node", "w", "vector", "keys")}
                own = [np.array(x, np.float64 if exact else np.float32) for x in batch.column("embedding").to_pylist()]
                for label, node, w, v in zip(*(batch.column(c).to_pylist() for c in ("label", "node", "w")), own, strict=True):
                    signs = (v.astype(np.float64) @ planes(len(v), bits * count, seed) > 0).reshape(count, bits)
                    keys = (signs * power).sum(axis=1)
                    for t in range(count):
                        for k, x in zip(out, (label, len(v), t, int(keys[t]), node, w, v.tobytes(), keys.tobytes()), strict=True):
                            out[k].append(x)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("label", pa.string()), ("dim", pa.int32()), ("table", pa.int32()), ("bucket", pa.int64()), ("node", pa.int64()), ("w", pa.int64()), ("vector", pa.binary()), ("keys", pa.binary())]))

    dealt = classes.select("label", "embedding", "node", "w").mapInArrow(deal, "label string, dim int, table int, bucket long, node long, w long, vector binary, keys binary")
    key = ["label", "dim", "table", "bucket"]
    dealt = dealt.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).where("_n > 1")
    dealt = dealt.withColumn("blocks", F.ceil(F.col("_n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.least(i, "block") * F.col("blocks") + F.greatest(i, "block"))
    # a cell of two blocks holds pairs across them only; pairs inside a block belong to its cell with itself
    dealt = dealt.withColumn("cell", F.explode(cells)).withColumn("group", F.xxhash64(*key, "cell"))
    dealt = dealt.withColumn("block", F.when(F.col("cell") % F.col("blocks") == F.floor(F.col("cell") / F.col("blocks")), 0).otherwise(F.col("block")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs_of(batches, ("group", "table", "bucket", "cell", "dim")):
            for label in g["label"].unique().to_pylist():
                own = g.filter(pa.compute.equal(g["label"], label))
                block = own["block"].to_numpy()
                if len(own) > 1 and (own["alone"][0].as_py() or block.min() != block.max()):
                    found = _links(own, seed, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b", "w"])

    alone = (F.col("cell") % F.col("blocks")) == F.floor(F.col("cell") / F.col("blocks"))
    dealt = dealt.withColumn("alone", alone).drop("_n", "blocks").repartition("group").sortWithinPartitions("group", *key, "cell", "node")
    found = staged(dealt.mapInArrow(compare, "a long, b long, w long"), "vector-links")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("links"))
    comp = components(found.where("b is not null").select("a", "b"))
    known = classes.join(links, "node", "left").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = known.groupBy("comp").agg(F.min("first").alias("least"))
    known = staged(known.join(least, "comp").select("label", "embedding", "w", F.coalesce("links", F.lit(0)).alias("links"), "least"), "vector-classes")
    joined = rows.where("good").join(known, ["label", "embedding"]).select("vec_id", (F.col("links") + F.col("w") - 1).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    rest = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


#: All pairs of a label, and what links reach step by step.
OP2_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(vec_id, c) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(c) AS c FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
