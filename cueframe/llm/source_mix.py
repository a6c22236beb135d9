"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Targets share a budget of words by weight, no source above max_epochs times its size; what a capped source can't take
goes to the others by weight. The water level comes in closed form from one ordered pass over the sources. A source is
then taken floor(target / size) whole times, and once more for the documents that come first in a seeded hash order
until the rest of the target is met. That order is cut in two steps, so no source is ever sorted in one task: sums per
(source, hash bucket) find the bucket where the target is met, and only this bucket's documents are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueframe.llm.common import WORD, read, staged

BUCKET_DIGITS = 3  # hex digits of the hash: 4096 buckets a source
WEIGHTS = (5, 2, 1)


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill(sources: DataFrame, share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """Adds target to sources (source, source_size, weight): one row per source, few rows however many documents."""
    by = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    cap = F.col("source_size") * max_epochs
    ranked = sources.withColumns({"total": total, "capped": F.coalesce(F.sum(cap).over(before), F.lit(0)), "rest": F.sum("weight").over(after)})
    level = (F.col("total") - F.col("capped")) / F.col("rest")
    ranked = ranked.withColumn("level", F.when(level * F.col("weight") <= cap, level))
    ranked = ranked.withColumn("level", F.max("level").over(Window.partitionBy()))  # the first that fits; later ones are lower
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), cap.cast("double")), cap.cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """One row per source: s, source_size, target, whole, and the last row in hash order that is taken once more.

    Written as a table: Spark then knows its size, broadcasts it where it is small and joins it by shuffle where not.
    """
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), _key(seed).alias("key")).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = staged(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "bucket-sums")
    per_source = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.array(*map(F.lit, weights))
    per_source = per_source.withColumn("rank", F.row_number().over(order)).withColumn("weight", F.element_at(turn, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    plan = fill(per_source, share, max_epochs).withColumnRenamed("source", "s")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = staged(plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    ahead = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    reach = sums.withColumn("ahead", ahead).join(plan.select("s", "need"), F.col("source").eqNullSafe(F.col("s"))).where("ahead < need")
    cut = reach.groupBy("s", "need").agg(F.max(F.struct("bucket", "ahead")).alias("cut"))
    cut = staged(cut.select("s", "need", F.col("cut.bucket").alias("bucket_cut"), F.col("cut.ahead").alias("ahead_cut")), "cuts")
    inside = rows.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("bucket_cut")))
    run = Window.partitionBy("s").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("ahead", F.col("ahead_cut") + F.sum("size").over(run) - F.col("size"))
    # the document at the boundary is in if that brings the sum nearer to the target
    last = inside.where(F.col("ahead") + F.col("size") / 2 <= F.col("need")).groupBy("s").agg(F.max(F.struct("key", "doc_id", "size")).alias("last"))
    cut = cut.drop("need").join(last.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left").drop("t")
    plan = plan.join(cut.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left").drop("t", "need", "ahead_cut")
    return staged(plan, "mix-plan")


def _key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def marked(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """(row, source, size, source_size, target, epochs): row is each row of docs, as a struct; only sums and the few
    boundary rows are shuffled."""
    plan = mix_plan(docs.select("doc_id", "source", "text"), seed=seed, **options)
    own = F.struct(_key(seed).alias("key"), "doc_id", size_of(F.col("text")).alias("size"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "source", own.alias("own")).join(plan, F.col("source").eqNullSafe(F.col("s")))
    first = F.substring("own.key", 1, BUCKET_DIGITS) < F.col("bucket_cut")
    more = F.coalesce(first | (F.col("own") <= F.col("last")), first, F.lit(False))
    return rows.select("row", "source", F.col("own.size").alias("size"), "source_size", "target", (F.col("whole") + more.cast("int")).cast("int").alias("epochs"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken for each row of docs.

    Sources in code point order, null last, get the weights in turn. epochs: how often the mix takes the document, at
    most max_epochs; taken: its words times epochs. A null text has size 0, and rows of size 0 add no words; a source
    of size 0 has target 0. Rows of one id share a hash and are ordered by size; repeated rows are taken alike. No rows
    give no rows; other columns of docs are not read. The result depends on the rows and the seed only.
    """
    rows = marked(docs.select("doc_id", "source", "text"), weights=weights, share=share, max_epochs=max_epochs, seed=seed)
    return rows.select("row.doc_id", "source", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns under any names."""
    rows = marked(docs, **options).where("epochs > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("epochs")))).select("row.*")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((rank - 1) % 3 AS INT) + 1] AS weight FROM s),
r AS (SELECT *, sum(source_size) OVER () * 1.0::DOUBLE AS total,
             coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT *, (total - capped) / rest AS lv FROM r),
m AS (SELECT *, max(CASE WHEN lv * weight <= 3 * source_size THEN lv END) OVER () AS level FROM l),
t AS (SELECT source AS src, source_size, least(coalesce(level * weight, CAST(3 * source_size AS DOUBLE)), CAST(3 * source_size AS DOUBLE)) AS target FROM m),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
q AS (SELECT *, target - whole * source_size AS need FROM p),
o AS (SELECT d.*, q.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS ahead
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.src)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN need > 0 AND ahead + size / 2 <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""
