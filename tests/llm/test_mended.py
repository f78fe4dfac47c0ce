"""Cases that once went wrong: windows of unlisted words, long words, an id of many rows."""

import numpy as np
import pyarrow as pa
import pytest

from upkeep.llm import lm_score, quality


@pytest.mark.parametrize("learn", [False, True])
def test_window_of_unlisted_words_only(learn):
    words = [f"w{i}" for i in range(3000)]
    v = lm_score.Vocabulary([lm_score.END, *words], list(range(3001, 0, -1)), sum(range(1, 3002)) + 50, 3001 + 40)
    model = lm_score.Model(v)
    states = np.random.default_rng(0).normal(0, 0.5, (5, lm_score.HIDDEN)).astype(np.float32)
    grads = {k: np.zeros_like(p) for k, p in model.p.items()} if learn else None
    found, back = model.outputs(states, np.full(5, v.rest), v, grads)
    assert found.shape == (5,) and np.isfinite(found).all() and (found < 0).all() and (back is not None) == learn


def test_text_of_unlisted_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = next(i for i in range(10 ** 6, 10 ** 6 + 50) if __import__("zlib").crc32(str(i).encode()) % 5 == 1)
    junk = spark.createDataFrame([(odd, " ".join(f"zq{i}zq" for i in range(5933))), (None, "a b"), (odd, "repeated id")], "doc_id long, text string")
    got = lm_score.score_documents(docs.unionByName(junk).coalesce(1)).where(f"doc_id = {odd} OR doc_id IS NULL").collect()
    assert sorted(r["n_tokens"] for r in got) == [3, 3, 5934] and all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_every_piece_of_a_long_word_counts():
    table = quality.FeatureTable()
    plain = quality.word_features(b"Ordinary,")
    assert len(plain) == 3
    joined = set(quality.word_features("some joined words,of　many".encode()))
    for w in (b"joined", b"words", b"many"):
        assert set(quality.word_features(w)[1:]) <= joined
    long = b"ab" * 50_000 + b"toxic" + b"cd" * 50_000
    assert set(quality.word_features(b"toxic")[2:]) <= set(quality.word_features(long))
    both = table.text([long, b"Ordinary,"])
    assert set(both) == set(quality.word_features(long)) | set(plain) and long not in table.row
    six = "one-two-three-four".encode()
    assert set(table.text([six, b"x"])) == set(quality.word_features(six)) | set(quality.word_features(b"x")) == set(table.text([b"x", six]))


def test_id_of_many_rows_and_clashing_columns(spark):
    bad = "awful hateful words " * 5
    rows = [(i, f"fine prose number {i % 7} here" if i % 2 else bad, "r", "j", "g") for i in range(60)] + [(3, f"fine prose number {i}", "r", "j", "g") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, judged string, grade string")
    grades = spark.createDataFrame([(i, 2 if i % 2 else 0) for i in range(60)] + [(3, 2)], "doc_id long, grade int")
    features, found = quality.sample_of(docs, grades, 40, "doc_id", "text")
    assert len(features) == len(found) == 40
    model = quality.train(docs, grades)
    kept = quality.kept_documents(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] % 2 for r in kept.collect()} == {1} and kept.count() == 330
    judged = quality.judge(docs, model).collect()
    assert len(judged) == 360 and all(r["kept"] == (r["p_tail"] >= quality.KEEP) for r in judged)
    at = quality.Model(np.array([-2.0, -np.log(quality.KEEP / (1 - quality.KEEP))]), np.zeros(0, np.int64), np.zeros(0))
    assert all(r["kept"] == (r["p_tail"] >= quality.KEEP) for r in quality.judge(docs, at).collect())


def test_quality_sample_reaches_the_driver_as_numbers(spark):
    """No Python object a feature on the driver: the sample comes as slices of one array."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 300}" for k in range(40))) for i in range(60)] + [(60, None)], "doc_id long, text string").repartition(5)
    grades = spark.createDataFrame([(i, i % 3) for i in range(61)], "doc_id long, grade int")
    features, found = quality.sample_of(docs, grades, 100, "doc_id", "text")
    assert found.tolist() == [i % 3 for i in range(61)]
    assert all(f.dtype == np.int32 and f.base is not None for f in features) and len(features[60]) == 0
    assert all(f.tolist() == own.tolist() for f, own in zip(features, quality.text_features(pa.array([r["text"] for r in docs.orderBy("doc_id").collect()]), quality.FeatureTable()), strict=True))
    assert quality.sample_of(docs, grades.limit(0), 100, "doc_id", "text")[0] == []
