"""Gates over what a stage returns: counted while the stage runs, judged by track, and said in words to the stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cueframe.functions import text as T
from cueframe.operators import quality


def failed_reply(text: Column, reply: Column) -> Column:
    """A reply that is blank, or that says the source again (letters' case and blanks aside)."""
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))
    return T.is_blank(reply) | (plain(reply) == plain(text))


def gate(rows: DataFrame, failed: Column, most: float = 0.5) -> DataFrame:
    """failed, n and stop by track: whether more than a share of `most` of its rows failed. A null counts as not failed."""
    out = rows.groupBy("track_id").agg(F.count_if(failed).alias("failed"), F.count("*").alias("n"))
    return out.withColumn("stop", F.col("failed") > F.col("n") * most)


def counted(rows: DataFrame, failed: Column, name: str = "stage") -> tuple[DataFrame, Observation]:
    """rows as they are, and their numbers, which are there once an action has run over them: no second pass."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failed")), seen


def check(seen: Observation, most: float = 0.5) -> dict[str, int]:
    """The numbers of counted(); raises where more than a share of `most` failed. No rows pass."""
    found = seen.get
    if found["failed"] > found["n"] * most:
        raise RuntimeError(f"{found['failed']} of {found['n']} rows failed")
    return found


def reply_errors(batches: DataFrame, field: str | None = None, least: float | None = None) -> DataFrame:
    """error of batches (track_id, batch, sent map<string,string>, reply string): what is wrong with a reply, for the next ask.

    A reply is a JSON object with the keys that were sent, and as values texts, or objects whose `field` is one. Named are,
    in this order, the first that apply: no object, keys missing, keys too many, values that are blank or not of the kind,
    and with `least` values less like their source than that. Null: nothing wrong. A null map counts as an empty one.
    """
    kind = f"map<string, struct<`{field}`: string>>" if field else "map<string, string>"
    rows = batches.withColumn("_id", F.struct("track_id", "batch")).withColumn("_sent", F.coalesce("sent", F.create_map().cast("map<string,string>")))
    rows = rows.withColumn("_object", F.from_json("reply", "map<string, string>")).withColumn("_got", F.from_json("reply", kind))
    own, there = F.map_keys("_sent"), F.map_keys("_object")
    value = lambda k: F.try_element_at("_got", k)[field] if field else F.try_element_at("_got", k)
    missing, extra = F.array_sort(F.array_except(own, there)), F.array_sort(F.array_except(there, own))
    blank = F.array_sort(F.filter(own, lambda k: T.is_blank(value(k)) | (F.lit(not field) & value(k).rlike(r"^\s*[{\[]"))))
    said = lambda text, keys: F.concat(F.lit(text), F.array_join(keys, ", "))
    error = F.when(F.col("_object").isNull(), "the reply is not a JSON object")
    error = error.when(F.size(missing) > 0, said("keys missing: ", missing)).when(F.size(extra) > 0, said("keys that were not asked for: ", extra))
    error = error.when(F.size(blank) > 0, said(f"no text in '{field}' of: " if field else "no text in: ", blank))
    rows = rows.withColumn("error", error)
    if least is not None:
        pairs = rows.where("error is null").select("_id", F.explode(F.transform(own, lambda k: F.struct(k.alias("k"), F.element_at("_sent", k).alias("a"), value(k).alias("b")))).alias("p"))
        far = pairs.where(quality.similarity(F.col("p.a"), F.col("p.b")) < least).groupBy("_id").agg(F.array_sort(F.collect_list("p.k")).alias("_far"))
        rows = rows.join(far, "_id", "left").withColumn("error", F.coalesce("error", F.when(F.col("_far").isNotNull(), said("changed too much: ", F.col("_far"))))).drop("_far")
    return rows.drop("_id", "_sent", "_object", "_got")
