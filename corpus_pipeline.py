"""A corpus pipeline from raw documents to packed sequences; each stage is one operator of cueframe.llm.

In all stages a null text counts as an empty one, null ids and further columns stay with their rows, and no rows give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cueframe.llm.common import read, staged
from cueframe.llm.encoding import vocabulary
from cueframe.llm.exact_dedup import drop_copies
from cueframe.llm.jaccard_join import one_of_each
from cueframe.llm.packing import pack
from cueframe.llm.source_mix import mixed
from cueframe.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Empty texts stay, and so do all where no label of each class is known or only the clean one."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays, that with the smallest id; of the empty ones too."""
    return drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) one stays, that with the smallest id. Texts without words are in no group."""
    return one_of_each(docs, k=5, num=8, den=10)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or several rows each. A null source is one of its own; texts without words add nothing."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; a document taken twice has its pieces twice.
    An empty text is a piece of one token."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("jaccard_join", jaccard_join), ("source_mix", source_mix), ("packing", packing)]
ORACLE_SQL = None  # neither the classifier nor the tokenizer can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
