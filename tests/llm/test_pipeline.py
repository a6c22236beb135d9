"""The pipeline stage by stage, each against a plain statement of what it has to do."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cueframe.llm import exact_dedup, jaccard_join, source_mix, toxicity
from cueframe.llm.common import read, staged

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_nulls_and_no_rows(spark):
    """Odd rows go through all stages: null ids, texts and sources, empty texts, repeated rows; and so does an empty table."""
    docs = read(spark, DATA, "documents")
    odd = [(None, "no id at all", "en", "web", 12), (None, None, None, None, None), (-1, "", "en", None, 0), (-2, None, "en", "web", 0), (-3, "one text twice", "en", "web", 14), (-3, "one text twice", "en", "web", 14)]
    rows = docs.limit(40).union(spark.createDataFrame(odd, docs.schema))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        rows = staged(stage(spark, rows, DATA), f"odd-{name}")
        seen.append(rows.collect())
    clean, single, apart, mix, packed = seen
    assert {x.doc_id for x in clean} >= {None, -1, -2, -3} and sum(x.doc_id == -3 for x in single) == 1
    assert sum(not (x.text or "").strip() for x in single) == 1  # equal texts: null, null and empty
    assert {x.doc_id for x in apart} <= {x.doc_id for x in single} and {x.doc_id for x in mix} <= {x.doc_id for x in apart}
    assert {x.doc_id for x in packed} == {x.doc_id for x in mix}
    rows = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        rows = staged(stage(spark, rows, DATA), f"none-{name}")
        assert rows.count() == 0


def test_stages(spark):
    docs = read(spark, DATA, "documents")
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        outs.append(staged(stage(spark, docs if not outs else outs[-1], DATA), name))
    clean, single, apart, mix, packed = outs
    assert all(x.columns == docs.columns for x in outs[:4])

    bad = {x.doc_id for x in toxicity.score_toxicity(docs, read(spark, DATA, "labels")).where("predicted = 1").collect()}
    assert {x.doc_id for x in clean.collect()} == {x.doc_id for x in docs.collect()} - bad

    texts = Counter(x[0] for x in single.select(exact_dedup.normalised(F.coalesce("text", F.lit("")))).collect())
    assert max(texts.values()) == 1 and set(texts) == {x[0] for x in clean.select(exact_dedup.normalised(F.coalesce("text", F.lit("")))).collect()}

    groups = jaccard_join.jaccard_groups(single, 5, 8, 10)
    assert {x.doc_id for x in apart.collect()} == {x.component_id for x in groups.collect()}

    plan = {x.doc_id: x.epochs for x in source_mix.mix_sources(apart).collect()}
    assert Counter(x.doc_id for x in mix.collect()) == {k: v for k, v in plan.items() if v}

    pieces = Counter(x.doc_id for x in packed.where("piece = 0").collect())
    assert pieces == Counter(x.doc_id for x in mix.collect())
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
