"""Token ids in binary files, with a minimal perfect hash index from document keys to places in them.

Documents are range-partitioned and sorted by key; each task encodes its rows and writes one file, so keys, files and
places all ascend together. The index is dealt by key hash into parts of bounded size; each part is a minimal perfect
hash function (levels of collision-free bits, ranked by population counts), whose slots hold a fingerprint and the runs
of records (file, first record, number) of the key: one, or several where a repeated key goes over more than one file. A
look-up touches one slot and compares the fingerprint. Files get names of their own for each attempt,
and only names that a finished task has reported are read, so lost executors and repeated tasks do no harm.

Payload file: ids of all records (uint16 or uint32, little-endian), the n + 1 record offsets in ids (uint64), then n, the
size of an id in bytes, and MAGIC (uint64 each). Files are opened through Arrow's file systems by their URI.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueframe.llm.common import id_text, mix, read, shared_dir, slices, staged
from cueframe.llm.encoding import encoder, vocabulary

MAGIC = 0x43554546524D4531
END = 0
PART_KEYS = 1_000_000  # keys in a part of the index
PIECE = 1000  # records of a run that are read back as one row
RECORDS = "shard int, path string, doc_id bigint, record long, n long"


# --- payload files ---------------------------------------------------------------------------------------------------


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_files(docs: DataFrame, folder: str, vocabulary_path: str, id_size: int = 2) -> DataFrame:
    """Writes the files and returns their records (shard, path, doc_id, record, n), written as a table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, encode = TaskContext.get().partitionId(), f"{folder}/ids-{uuid.uuid4().hex}.bin", encoder(vocabulary_path)
        system, path = _at(own)
        system.create_dir(path.rsplit("/", 1)[0])
        sizes, record = [], 0
        with system.open_output_stream(path) as out:
            for batch in slices(batches, size=2 << 20):
                ids, at = encode.encode(batch.column("text"))
                if len(ids) and int(ids.max()) >> (8 * id_size):
                    raise ValueError(f"an id does not fit {id_size} bytes")
                n = np.diff(at) + 1
                full = np.full(len(ids) + len(n), END, f"<u{id_size}")
                keep = np.ones(len(full), bool)
                keep[np.cumsum(n) - 1] = False
                full[keep] = ids
                out.write(full.tobytes())
                sizes.append(n)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * len(n), pa.int32()), "path": [own] * len(n), "doc_id": batch.column("doc_id"), "record": np.arange(record, record + len(n)), "n": n})
                record += len(n)
            offsets = np.concatenate([[0], *map(np.asarray, sizes)]).cumsum().astype("<u8")
            out.write(offsets.tobytes() + np.array([record, id_size, MAGIC], "<u8").tobytes())

    rows = id_text(docs).select(F.col("doc_id").cast("long"), "text").withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")  # a repeated key is split
    return staged(rows.mapInArrow(write, RECORDS), "records")


class Payload:
    """A payload file, open for reading."""

    def __init__(self, uri: str):
        system, path = _at(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        records, self.id_size, magic = np.frombuffer(self.file.read_at(24, size - 24), "<u8").astype(int)
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.offsets = np.frombuffer(self.file.read_at(8 * (records + 1), size - 24 - 8 * (records + 1)), "<u8").astype(np.int64)

    def ids(self, record: int, records: int = 1) -> np.ndarray:
        a, b = self.offsets[record], self.offsets[record + records]
        return np.frombuffer(self.file.read_at(int(b - a) * self.id_size, int(a) * self.id_size), f"<u{self.id_size}").astype("<u4")


# --- the index -------------------------------------------------------------------------------------------------------


class PerfectHash:
    """A minimal perfect hash function over distinct 64-bit keys; its slots are 0 to n - 1.

    At each level a key that meets no other at its bit is placed there; the others go on. Keys that no level can part
    (equal hashes) end in a sorted list.
    """

    GAMMA, LEVELS = 2, 40

    def __init__(self, keys: np.ndarray):
        self.words: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        base, rest = 0, keys.astype(np.uint64)
        for level in range(self.LEVELS):
            if not len(rest):
                break
            size = 64 * (self.GAMMA * len(rest) // 64 + 1)
            at = self._bit(rest, level, size)
            alone = np.bincount(at, minlength=size) == 1
            word = np.packbits(alone, bitorder="little").view("<u8")
            ones = np.bitwise_count(word).astype(np.int64)
            self.words.append(word)
            self.ranks.append(base + np.cumsum(ones) - ones)
            base += int(ones.sum())
            rest = rest[~alone[at]]
        self.base, self.rest = base, np.sort(rest)

    @staticmethod
    def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot, or -1, for keys it was not built from."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for level, (word, rank) in enumerate(zip(self.words, self.ranks, strict=True)):
            at = self._bit(keys[open_], level, 64 * len(word))
            bit = (at & 63).astype(np.uint64)
            held = word[at >> 6]
            here = (held >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[here]] = rank[at[here] >> 6] + below[here]
            open_ = open_[~here]
            if not len(open_):
                break
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[at] == keys[open_]
            out[open_[found]] = self.base + at[found]
        return out


def _hashed(df: DataFrame, parts: int | Column) -> DataFrame:
    key = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0))]
    parts = F.lit(parts) if isinstance(parts, int) else parts
    return df.withColumns({"h": F.xxhash64(*key), "print": F.hash(*key), "part": F.pmod(F.xxhash64(F.lit("part"), *key), parts).cast("int")})


def _saved(index: PerfectHash, held: dict[str, np.ndarray]) -> bytes:
    """An index part as named arrays; loading them runs no code."""
    out = io.BytesIO()
    levels = {f"{kind}-{i}": x for kind, arrays in (("word", index.words), ("rank", index.ranks)) for i, x in enumerate(arrays)}
    np.savez(out, levels=np.array(len(index.words)), base=np.array(index.base), rest=index.rest, **levels, **held)
    return out.getvalue()


def _loaded(data: bytes) -> tuple[PerfectHash, dict[str, np.ndarray]]:
    index = PerfectHash.__new__(PerfectHash)
    with np.load(io.BytesIO(data), allow_pickle=False) as x:
        index.words, index.ranks = ([x[f"{kind}-{i}"] for i in range(int(x["levels"]))] for kind in ("word", "rank"))
        index.base, index.rest = int(x["base"]), x["rest"]
        return index, {k: x[k] for k in ("fingerprint", "first", *RUN)}


RUN = ("shard", "record", "records")


def build_index(records: DataFrame, folder: str) -> DataFrame:
    """Writes the parts of the index; returns (part, parts, index_path), a row for each part that holds a key."""
    runs = records.groupBy("doc_id", "shard").agg(F.min("record").alias("record"), F.count("*").alias("records"))  # of a key in one file
    keys = staged(runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*RUN))).alias("runs")), "index-keys")
    parts = max(1, -(-keys.count() // PART_KEYS))
    keys = _hashed(keys, parts).select("part", "h", "print", *(F.col(f"runs.{c}").alias(c) for c in RUN))

    def write(pdf):
        import pandas as pd

        index = PerfectHash(pdf["h"].to_numpy().view(np.uint64))
        slots = index.slots(pdf["h"].to_numpy().view(np.uint64))
        if len(np.unique(slots)) != len(pdf):  # xxhash64 maps longs one to one; only the null key could meet another
            raise ValueError("two keys share a 64-bit hash")
        pdf = pdf.iloc[np.argsort(slots)]
        held = {c: np.concatenate(pdf[c].tolist()).astype(np.int64) for c in RUN}
        held |= {"fingerprint": pdf["print"].to_numpy(np.int32), "first": np.concatenate([[0], np.cumsum(pdf["shard"].map(len))])}
        uri = f"{folder}/index-{uuid.uuid4().hex}.bin"
        system, path = _at(uri)
        with system.open_output_stream(path) as out:
            out.write(_saved(index, held))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "parts": [parts], "index_path": [uri]})

    return staged(keys.groupBy("part").applyInPandas(write, "part int, parts int, index_path string"), "index")


def look_up(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, shard, record, records) of the runs of the keys (doc_id) that the index holds; other keys go.

    A key leads to a row for each of its runs. How keys are dealt to parts is read from the index, whose parts may be
    fewer than dealt where some have no key.
    """
    found = index.select("parts").first()
    parts = found[0] if found else 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, loaded = None, None
        for batch in batches:
            names = batch.column("index_path").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, names[1:] != names[:-1])).tolist() + [len(names)] if len(names) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if names[a] != path:
                    path = names[a]
                    system, at = _at(path)
                    with system.open_input_file(at) as f:
                        loaded = _loaded(f.read())
                hashed, held = loaded
                part = batch.slice(a, b - a)
                slot = hashed.slots(part.column("h").to_numpy().view(np.uint64))
                ok = (slot >= 0) & (held["fingerprint"][slot] == part.column("print").to_numpy())
                slot = slot[ok]
                first, times = held["first"][slot], np.diff(held["first"])[slot]
                run = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
                key = part.column("doc_id").filter(pa.array(ok)).take(pa.array(np.repeat(np.arange(len(slot)), times)))
                yield pa.RecordBatch.from_pydict({"doc_id": key, **{k: held[k][run] for k in RUN}})

    asked = _hashed(keys.select(F.col("doc_id").cast("long")), parts).join(index.select("part", "index_path"), "part")
    asked = asked.repartition("part").sortWithinPartitions("part").select("doc_id", "h", "print", "index_path")
    return asked.mapInArrow(find, "doc_id bigint, shard long, record long, records long")


def digests(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Reads the payloads of hits back: doc_id, start, n_tokens and ids_crc32 for each record."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, payload = None, None
        out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))
            for v in out.values():
                v.clear()
            return made

        for batch in batches:
            for doc_id, uri, base, record, records in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "path", "base", "record", "records")), strict=True):
                if uri != path:
                    path, payload = uri, Payload(uri)
                for r in range(record, record + records):
                    ids = payload.ids(r)
                    for k, v in zip(out, (doc_id, base + int(payload.offsets[r]), len(ids), zlib.crc32(ids.tobytes())), strict=True):
                        out[k].append(v)
                if len(out["doc_id"]) >= 5000:
                    yield flush()
        yield flush()

    rows = hits.withColumn("end", F.col("record") + F.col("records"))
    rows = rows.withColumn("record", F.explode(F.sequence("record", F.col("end") - 1, F.lit(PIECE).cast("long"))))
    rows = rows.withColumn("records", F.least(F.lit(PIECE), F.col("end") - F.col("record")))
    rows = staged(rows.join(files, "shard"), "hits").repartitionByRange("shard", "record").sortWithinPartitions("shard", "record")
    return rows.select("doc_id", "path", "base", "record", "records").mapInArrow(load, "doc_id bigint, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary_path: str, id_size: int = 2, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writes payload and index; returns the tables records, files (shard, path, base) and index.

    base: ids in all files before. A null text is an empty one, and each document ends with the id 0. Rows with a null
    doc_id come first; rows of one doc_id stand side by side, over several files if
    they are many, and its key leads to all of them. Other
    columns of docs are not read. No rows give no files.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    records = write_files(docs, folder, vocabulary_path, id_size)
    totals = records.groupBy("shard", "path").agg(F.sum("n").alias("ids"))  # a row for each file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = staged(totals.select("shard", "path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")), "files")
    return records, files, build_index(records, folder)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    _, files, index = token_files(docs, vocabulary("byte_bpe_50k.json"))
    return digests(look_up(docs.select("doc_id").distinct(), index), files)
