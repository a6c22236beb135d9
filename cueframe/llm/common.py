"""What the corpus operators share: word patterns, shared working tables, graph components and text buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as every contract of this package defines them.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch while queries of this package run: texts are long, and JVM and worker both hold whole batches.
BATCH_ROWS, BATCH_BYTES = "2000", "8m"
MOST_BITS = 30  # of a marker filter, in powers of two: 128 MB at most go to every task


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the driver's; the queries' entry, so it also keeps Arrow batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > int(BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session without one gets a temporary folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cueframe-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of staged tables that no later step reads, also not to recompute what a lost executor held."""
    for table in tables:
        if path := getattr(table, "staged_at", None):
            sc = table.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names, so that others can't clash with its own."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def id_crc(col: Column) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "utf-8"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, comp): the smallest node that each node of edges (a, b) reaches, by large-star and small-star steps.

    Each step is two shuffles on the edges' nodes; the number of edges never grows, and a node with very many
    neighbours only ever meets aggregates and an equi-join that adaptive execution can split.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    pairs = staged(pairs, "edges")
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: each edge from its larger end; the smallest of its smaller neighbours takes them all
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).union(joined.select(F.col("m").alias("a"), "b"))
        new = staged(small.where("a <> b").distinct(), "edges")
        was = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(pairs)
        pairs = new
        if was == now:
            break
    else:
        raise RuntimeError("components did not converge")
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(pairs.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())


def may_meet(rows: DataFrame, keys: list[Column], others: DataFrame, other_keys: list[Column], flag: str) -> DataFrame:
    """rows with a boolean flag: whether the keys can be those of a row of others; false only where they surely aren't.

    A bit for each row of others, by hash, in a bitmap of at most 2 ** MOST_BITS bits that is broadcast in pieces of 4 kB:
    about one row in 16 is flagged without cause, more where others has over 2 ** (MOST_BITS - 4) rows. others is read
    twice and should be a written table. So only flagged rows, not all texts, need to be shuffled to meet others.
    """
    bits = min(MOST_BITS, max(15, (16 * others.count()).bit_length()))
    place = lambda k: F.pmod(F.xxhash64(F.lit("meet"), *k), F.lit(1 << bits)) + 1
    maps = others.select(place(other_keys).alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    own = place(keys)
    at = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (at % 8 + 1).cast("int"))) != 0
    return rows.join(F.broadcast(maps), F.bitmap_bucket_number(own) == F.col("_piece"), "left").withColumn(flag, F.coalesce(set_, F.lit(False))).drop("_piece", "_bits")


def without(docs: DataFrame, marks: DataFrame, key: Column) -> DataFrame:
    """docs, with all their columns, less the rows that marks (doc_id, key, stays) name.

    key: the column of docs that marks hold as key. A row whose mark stays is kept once, however often it is repeated;
    rows without a mark all stay. Only rows that may have a mark are shuffled to the marks, the others pass by.
    """
    names = docs.columns
    row, mark = (_free(x, names) for x in ("row", "mark"))
    whole = F.struct(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names))).alias(row)
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("_id"), key.alias("_key"))
    marks = staged(marks.select(F.col("doc_id").alias("_mid"), F.col("key").alias("_mkey"), F.col("stays").alias(mark)).distinct(), "marks")
    rows = may_meet(rows, [F.col("_id"), F.col("_key")], marks, [F.col("_mid"), F.col("_mkey")], "_may")
    joined = rows.where("_may").join(marks, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_key") == F.col("_mkey")), "left")
    kept = rows.where("not _may").select(row).union(joined.where(F.col(mark).isNull()).select(row))
    if not marks.where(mark).isEmpty():
        kept = kept.union(joined.where(mark).dropDuplicates(["_id", "_key"]).select(row))
    return kept.select(*(F.col(f"{row}.c{i}").alias(n) for i, n in enumerate(names)))


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


# --- text buffers in Arrow tasks -------------------------------------------------------------------------------------

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column without nulls and the n + 1 offsets of its rows in them."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about size bytes of text, or one longer row."""
    for batch in batches:
        col = batch.column(text).cast(pa.large_string())
        ends = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        del batch, col, ends
        pa.default_memory_pool().release_unused()  # workers live on: what this task took is there for the next
    if _TRIM:
        _TRIM(0)  # freed pieces between live ones go back, too


def words(text: pa.Array, lower: bool = True, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Of all rows in order: each word's place in the list of distinct words, that list, and the words per row.

    gaps: for each byte, whether it stands between words.
    """
    raw, offsets = buffers(text)
    space = gaps[raw]
    keep = ~space
    start = keep.copy()
    start[1:] &= space[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[firsts] = keep[firsts]
    ahead = np.concatenate([[0], np.cumsum(start)])
    per_row = ahead[offsets[1:]] - ahead[offsets[:-1]]
    solid = raw[keep]
    if lower:
        solid = _LOWER[solid]
    at = np.flatnonzero(start[keep]).astype(np.int64)
    ends = np.append(at, len(solid)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(solid))])
    if not len(at):
        return np.zeros(0, np.int64), [], per_row
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), per_row


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, for arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
