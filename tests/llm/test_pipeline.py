"""Each stage of the pipeline against a plain version, on the smallest tables."""

import re

import corpus_pipeline
from test_operators import LOWER, brute_components, brute_substrings

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    benchmark = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, SF).cache()
    assert good.columns == columns and not toxic & {r["doc_id"] for r in good.collect()} and good.count() > 0.6 * docs.count()
    one = stage["near_duplicates"](spark, docs, SF)
    labels = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == {i for i, (_, c) in labels.items() if c == i}
    two = stage["substrings"](spark, docs, SF)
    want = brute_substrings([(r["doc_id"], r["text"]) for r in docs.collect()], corpus_pipeline.PASSAGE_WORDS)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    expected = {i: kept if gone else text[i] for i, (n, gone, kept) in want.items() if gone < n or not n}
    assert two.columns == columns and {r["doc_id"]: r["text"] for r in two.collect()} == expected
    three = stage["decontamination"](spark, docs, SF)
    letters = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {tuple(w[k:k + 10]) for t in benchmark for w in [letters.findall(t.translate(LOWER))] for k in range(max(1, len(w) - 9))}
    clean = {i for i, t in text.items() for w in [letters.findall((t or "").translate(LOWER))] if not any(tuple(w[k:k + 10]) in windows for k in range(len(w) - 9))}
    assert three.columns == columns and {r["doc_id"] for r in three.collect()} == clean
    four = corpus_pipeline.run(spark, SF)
    assert 0 < four.count() <= good.count()
