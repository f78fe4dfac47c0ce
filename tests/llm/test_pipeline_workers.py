"""How many workers a step of the pipeline needs, and how large their batches are."""

from pyspark.sql import functions as F

import corpus_pipeline
from upkeep.llm import substring_dedup
from upkeep.llm.storage import BATCH_BYTES


def test_words_are_removed_by_one_python_step(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "x a b c d e f g h i y"), (3, "a b c d e f g h")], "doc_id long, text string")
    found = substring_dedup.without_repeats(docs, length=8)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a b c d e f g h i"), (2, "x y")]


def test_pipeline_bounds_the_batches_of_results_run_later(spark):
    before = spark.conf.get(BATCH_BYTES)
    docs = spark.createDataFrame([(i, "word " * 2000) for i in range(2000)], "doc_id long, text string").coalesce(1)
    try:
        corpus_pipeline.tokenized(spark, docs, "")
        size = docs.mapInArrow(lambda batches: (type(b).from_pydict({"n": [b.nbytes]}) for b in batches), "n long").agg(F.max("n")).first()[0]
        assert size < 5 << 20
    finally:
        spark.conf.set(BATCH_BYTES, before)
