"""Importance resampling towards a target distribution, over a persisted sparse matrix of documents by hashed features.

Each document is a row of counts of its word runs, hashed into buckets. Rows are written as blocks in compressed sparse
row form: row ends, bucket numbers that ascend within a row, and counts, in the narrowest integers that hold them. Everything after that reads blocks, not texts:
column sums are the corpus' distribution over buckets, their ratio to the target's gives each bucket a gain, and the
product of matrix and gains gives each document's weight. A draw without replacement takes the highest weights after
Gumbel noise from a hash of the document's key.

A bucket is the crc32 of a run's bytes. It is linear over bits: the crc of two runs side by side is that of the first,
moved on by the second's length, xor the second's. So only distinct words are hashed, and runs follow by table look-up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueframe.llm.common import read, slices, staged, words

BUCKETS, RUNS = 10_000, 3
TEXT, FILE = 1 << 16, 256  # bytes of text in a block, or one longer row, and blocks in a file: readers hold many blocks at once
#: Bytes between words: ASCII other than digits and letters.
GAPS = np.ones(256, bool)
GAPS[128:] = GAPS[48:58] = GAPS[65:91] = GAPS[97:123] = False
BLOCK = "doc_ids array<bigint>, words array<bigint>, ends binary, buckets binary, counts binary"


# --- crc32 of word runs ----------------------------------------------------------------------------------------------


@cache
def _moves(power: int) -> np.ndarray:
    """The crc after 2 ** power zero bytes, for each of its four bytes: 4 x 256 values that are xored."""
    if not power:
        low = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
        low ^= low[0]  # crc32's linear part of a byte
        values = np.arange(256, dtype=np.uint32)
        return np.stack([low[values], *(values << np.uint32(8 * k - 8) for k in (1, 2, 3))])
    half = _moves(power - 1)
    return np.stack([_moved(row, half) for row in half])


def _moved(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    byte = np.uint32(255)
    return table[0][crc & byte] ^ table[1][(crc >> np.uint32(8)) & byte] ^ table[2][(crc >> np.uint32(16)) & byte] ^ table[3][crc >> np.uint32(24)]


def moved(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each crc after as many more bytes as lengths says, before these bytes' own crc is xored to it."""
    out, power = crc.copy(), 0
    while len(lengths) and (lengths >> power).any():
        on = np.flatnonzero((lengths >> power) & 1)
        out[on] = _moved(out[on], _moves(power))
        power += 1
    return out


def run_crcs(text: pa.Array, runs: int = RUNS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of 1 to `runs` words of each row: its crc32 and its row; and the words of each row."""
    places, distinct, per_row = words(text, gaps=GAPS)
    first = np.fromiter((zlib.crc32(w) for w in distinct), np.uint32, len(distinct))[places]
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in distinct), np.uint32, len(distinct))[places]
    length = np.fromiter((len(w) + 1 for w in distinct), np.int64, len(distinct))[places]
    row = np.repeat(np.arange(len(per_row)), per_row)
    crcs, rows, last = [first], [row], first
    for n in range(1, runs):
        if len(row) <= n:
            break
        last = moved(last[:-1], length[n:]) ^ spaced[n:]
        inside = row[n:] == row[:-n]
        crcs.append(last[inside])
        rows.append(row[n:][inside])
    return np.concatenate(crcs), np.concatenate(rows), per_row


# --- the matrix ------------------------------------------------------------------------------------------------------


def count_blocks(docs: DataFrame, buckets: int = BUCKETS, runs: int = RUNS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the matrix of docs and returns its blocks: of each, ids and words of its rows and the CSR arrays.

    ends: int64, one for each row; buckets: uint16, or uint32 where there are more of them; counts of a row's buckets in
    ascending order: uint8, or uint32 where one is larger. A block holds the rows of about TEXT bytes, or one longer row,
    which has `buckets` entries at most. A null text has none; null ids stay null. Other columns are not read. No rows
    give no blocks.
    """
    narrow = "<u2" if buckets <= 1 << 16 else "<u4"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=TEXT):
            crcs, rows, per_row = run_crcs(batch.column("text"), runs)
            keys, counts = np.unique(rows * buckets + crcs % np.uint32(buckets), return_counts=True)
            ends = np.cumsum(np.bincount(keys // buckets, minlength=len(batch)), dtype=np.int64)
            arrays = ends, (keys % buckets).astype(narrow), counts.astype("u1" if counts.max(initial=0) < 256 else "<u4")
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (batch.column("id").to_pylist(), per_row.tolist())] + [pa.array([x.tobytes()], pa.binary()) for x in arrays], ["doc_ids", "words", "ends", "buckets", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return staged(rows.mapInArrow(build, BLOCK), "count-blocks", FILE)


def csr(blocks: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block: ids and words of its rows, and ends, buckets and counts."""
    for k in range(len(blocks)):
        ends, *rest = (blocks.column(c)[k].as_buffer() for c in ("ends", "buckets", "counts"))
        ends = np.frombuffer(ends, np.int64)
        n = int(ends[-1]) if len(ends) else 0
        yield blocks.column("doc_ids")[k].values, blocks.column("words")[k].values, ends, *(np.frombuffer(x, f"<u{len(x) // n if n else 1}") for x in rest)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the buckets that occur; each task sums its blocks before anything is shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, at, counts in csr(batch):
                total += np.bincount(at, counts, buckets).astype(np.int64)  # exact: sums of a block stay below 2 ** 53
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    return blocks.select("doc_ids", "words", "ends", "buckets", "counts").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket the whole part of 1000 times the log ratio of its smoothed shares in target and source.

    The driver takes two tables of at most `buckets` rows; an empty table counts as all zeros.
    """
    s, t = np.zeros(buckets), np.zeros(buckets)
    for into, table in ((s, source), (t, target)):
        for x in table.collect():
            into[x.bucket] = x.n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row: the product of the matrix and gain."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n_words, ends, at, counts in csr(batch):
                first = np.concatenate([[0], ends])
                out = [n_words]
                for values in (counts.astype(np.int64), gain[at] * counts):
                    ahead = np.concatenate([[0], np.cumsum(values)])
                    out.append(pa.array(ahead[first[1:]] - ahead[first[:-1]]))
                yield pa.RecordBatch.from_arrays([ids, *out], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(multiply, "doc_id long, n_words long, n_features long, weight long")


def draw(rows: DataFrame, percent: int, seed: str, least_words: int) -> DataFrame:
    """rows (doc_id, n_words, n_features, weight) with score and rank; rank is null for rows that are not drawn.

    Of rows with least_words words, percent per cent are drawn (rounded down), highest scores first, then the smaller
    doc_id, a null one last, then fewer features; rows alike in all of these are drawn in any order. A null doc_id is
    hashed as an empty text. Rows are sorted by range; ranks come from each range's size, so no task sees them all.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = staged(rows.withColumns({"score": F.col("weight") + noise, "row": F.monotonically_increasing_id()}), "weights")
    fit = rows.where(F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("row")]
    fit = fit.repartitionByRange(*order).sortWithinPartitions(*order).select("row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    fit = staged(fit, "ranges")
    parts = fit.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first"))  # a row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("all"))
    ranked = fit.join(parts, "part").withColumn("rank", (F.col("base") + F.col("place") - F.col("first") + 1).cast("long"))
    drawn = ranked.where(F.col("rank") <= F.floor(F.col("all") * percent / 100)).select("row", "rank")
    return rows.join(drawn, "row", "left").drop("row")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: str = "42", least_words: int = 20, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of docs, drawn towards the texts of target.

    Words are runs of digits, letters and bytes beyond ASCII, A-Z in lower case. An empty or null text has no words, no
    features and the weight 0. Repeated rows are rows of their own. An empty target gives all buckets its smoothing
    only; no docs give no rows. Other columns are not read.
    """
    blocks = count_blocks(docs, buckets)
    gain = gains(column_sums(blocks, buckets), column_sums(count_blocks(target.withColumn("doc_id", F.lit(None).cast("long")), buckets), buckets), buckets)
    return draw(weights(blocks, gain), percent, seed, least_words)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: The crc32 of each distinct run byte by byte, from a table that the rule of the polynomial gives.
OP13_SQL = r"""
WITH RECURSIVE t(k, i, c) AS (
  SELECT 0, i, i::UINTEGER FROM range(256) r(i)
  UNION ALL SELECT k + 1, i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END FROM t WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
texts AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
split AS (SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT side, doc_id, unnest(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS run FROM split),
counted AS MATERIALIZED (SELECT side, doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT run, hex(encode(run)) AS x FROM (SELECT DISTINCT run FROM counted)),
hashed AS MATERIALIZED (
  SELECT run, xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(range(0, len(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 17)::UINTEGER)),
    lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295::UINTEGER) % 10000 AS bucket FROM hexed, tab),
cells AS MATERIALIZED (SELECT side, doc_id, bucket, sum(n) AS n FROM counted JOIN hashed USING (run) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM cells GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS gain FROM sums),
weighed AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM cells JOIN gain USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weighed USING (doc_id) WHERE side = 0),
ranked AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (words >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= floor(5 * fit / 100) THEN place END AS rank FROM ranked
"""
