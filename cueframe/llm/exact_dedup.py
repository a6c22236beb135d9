"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its own content says so: after a sentence end that a letter of a fixed class follows, or
after MAX_CHUNK characters where there is none. Chunks meet once in a shuffle, grouped by hash and bytes; a hash that
stands for one byte string is a verified identifier, and the byte strings that share a hash get numbered tags. A text
is then the ordered list of its chunks' identifiers, and only these short lists are grouped and joined. Long texts
don't move again, however many copies there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueframe.llm.common import WS, id_text, read, staged, without

MIN_CHUNK, MAX_CHUNK = 64, 4096
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?[.!?;。！？](?=\s?[A-Ha-hÀ-È一-忿])|.{{1,{MAX_CHUNK}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WS, " ")


def chunks(text: Column) -> Column:
    """The chunks of a normalised text, in order; they add up to it."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, hashed=F.xxhash64) -> DataFrame:
    """(rid, doc_id, text_sha256, recipe) for each row; equal recipes mean equal normalised texts.

    hashed: the hash of a chunk; tests pass a weak one, whose collisions the tags then resolve.
    """
    text = id_text(docs).select("doc_id", normalised(F.col("text")).alias("text"))
    parts = text.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(hashed("chunk").alias("h"), "chunk")
    many = parts.distinct().groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    many = staged(many, "chunk-collisions")
    rows = text.withColumn("rid", F.monotonically_increasing_id()).withColumn("text_sha256", F.sha2("text", 256))
    if many.isEmpty():
        out = rows.select("rid", "doc_id", "text_sha256", F.transform(chunks(F.col("text")), lambda c: F.struct(hashed(c).alias("h"), F.lit(0).alias("tag"))).alias("recipe"))
        return staged(out, "recipes")
    tags = parts.join(many, "h", "left_semi").distinct().withColumn("tag", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
    rows = staged(rows, "rows")  # rid must not change between the two uses
    placed = rows.select("rid", F.posexplode(chunks(F.col("text"))).alias("pos", "chunk")).withColumn("h", hashed("chunk"))
    placed = placed.join(tags, ["h", "chunk"], "left")
    lists = placed.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "h", F.coalesce("tag", F.lit(0)).alias("tag")))).alias("l"))
    lists = lists.select("rid", F.transform("l", lambda x: F.struct(x["h"].alias("h"), x["tag"].alias("tag"))).alias("recipe"))
    empty = F.array().cast("array<struct<h:bigint,tag:int>>")
    return staged(rows.drop("text").join(lists, "rid", "left").select("rid", "doc_id", "text_sha256", F.coalesce("recipe", empty).alias("recipe")), "recipes")


def exact_dedup(docs: DataFrame, hashed=F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the smallest doc_id stays (a null doc_id only if there is no other); of
    repeated rows with that id, one. A null text is an empty text, and all empty texts are equal. Other columns of docs
    are not read. No rows give no rows.
    """
    rows = recipes(docs, hashed)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best")
    groups = rows.groupBy("recipe").agg(best, F.count("*").alias("n")).where("n > 1")
    joined = rows.join(groups, "recipe", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("best.rid") == F.col("rid"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that exact_dedup keeps: of equal texts one row. No rows give no rows."""
    rows = exact_dedup(docs).where("group_size > 1").groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("text_sha256").alias("key"))
    rows = rows.agg(F.max("kept").alias("stays"), F.count("*").alias("times")).where("not stays or times > 1")
    return without(docs, rows, F.sha2(normalised(F.coalesce("text", F.lit(""))), 256))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d
"""
