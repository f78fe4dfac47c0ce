"""Distributed positions / prefix sums against single-task windows, and tree
attributions against brute force."""

import time
from math import factorial

import forest_brute as BRUTE
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from upkeep.operators import attribution as ATT
from upkeep.operators import positions as P
from upkeep.operators import splits as D


def test_global_position_matches_single_task_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") % 37).alias("g"), F.col("id"))
    a = P.global_position(df, ["g", "id"], num_partitions=7)
    ref = df.withColumn("ref", F.row_number().over(Window.orderBy("g", "id")))
    bad = a.join(ref, ["g", "id"]).where(F.col("pos") != F.col("ref")).count()
    assert bad == 0 and a.count() == 5000


def test_prefix_sums_by_group(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"), F.col("id"), (F.col("id") % 5).alias("v"))
    out = P.prefix_sums(df, ["id"], {"v": "v"}, group_cols=["g"], num_partitions=5)
    w = Window.partitionBy("g").orderBy("id")
    ref = df.withColumn("ref", F.sum("v").over(w)).withColumn("rpos", F.row_number().over(w))
    j = out.join(ref, ["g", "id"])
    assert j.where((F.col("cum_v") != F.col("ref")) | (F.col("pos") != F.col("rpos"))).count() == 0


def test_hot_group_positions_are_exact(spark):
    # one group holds most of the rows: positions still exact and contiguous
    df = spark.range(0, 4000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 4).alias("g"), "id")
    out = P.group_positions(df, ["g"], ["id"], num_partitions=6)
    agg = out.groupBy("g").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n")).collect()
    assert all(r["lo"] == 1 and r["hi"] == r["n"] for r in agg)


def test_splits_disjoint_complete(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("machine_id"), (F.col("id") % 4 == 0).cast("int").alias("s"))
    out = D.split_stratified(df, "s", "machine_id")
    assert out.count() == 1000 and out.select("machine_id").distinct().count() == 1000
    counts = {(r["s"], r["split"]): r["count"] for r in out.groupBy("s", "split").count().collect()}
    assert counts[(0, "train")] == 525 and counts[(1, "train")] == 175


def test_exact_quantiles_match_percentile(spark):
    df = spark.range(0, 1001).select((F.col("id") * 7 % 1001 / 3.0).alias("x"))
    a = P.exact_quantiles(df, "x", [0.7, 0.9], ["a", "b"]).first()
    b = df.agg(F.percentile("x", F.array(F.lit(0.7), F.lit(0.9)))).first()[0]
    assert abs(a["a"] - b[0]) < 1e-9 and abs(a["b"] - b[1]) < 1e-9


def _rand_tree(rng, k, depth):
    feat, thr, le, ri, val = [], [], [], [], []

    def mk(d):
        i = len(feat)
        feat.append(-1), thr.append(0.0), le.append(-1), ri.append(-1), val.append(0.0)
        if d == 0 or rng.random() < 0.15:
            val[i] = rng.random()
            return i
        feat[i] = int(rng.integers(k))
        thr[i] = float(rng.random())
        le[i] = mk(d - 1)
        ri[i] = mk(d - 1)
        return i

    mk(depth)
    return {"feature": np.array(feat), "threshold": np.array(thr), "left": np.array(le), "right": np.array(ri),
            "value": np.array(val), "weight": 0.5}


def test_tree_shap_matches_bruteforce_and_sums_to_gap():
    rng = np.random.default_rng(0)
    trees = [_rand_tree(rng, 5, 6) for _ in range(3)]
    x, bg = rng.random((6, 5)), rng.random((7, 5))
    a = BRUTE.tree_shap(x, bg, trees)
    assert np.abs(a - BRUTE.tree_shap_bruteforce(x, bg, trees)).max() < 1e-12
    gap = BRUTE.tree_predict(x, trees) - BRUTE.tree_predict(bg, trees).mean()
    assert np.abs(a.sum(axis=1) - gap).max() < 1e-12


def test_linear_attributions_rank_and_sum(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 3.0, 0.0)], "k int, a double, b double")
    att = ATT.linear_attributions(df, "k", {"a": 2.0, "b": 0.5}, df, top_k=None)
    rows = {(r["k"], r["feature_name"]): (r["shap_value"], r["importance_rank"]) for r in att.collect()}
    # background means a=2, b=5 → k=1: φa=-2, φb=2.5 ; ranks by |φ|
    assert rows[(1, "b")] == (2.5, 1) and rows[(1, "a")] == (-2.0, 2)


def test_tree_shap_of_more_than_64_features():
    rng = np.random.default_rng(3)
    trees = [_rand_tree(rng, 200, 8) for _ in range(3)]
    assert max(len(set(t["feature"].tolist())) for t in trees) > 65  # the sets of one tree need several words
    x, bg = rng.random((4, 200)), rng.random((5, 200))
    a = BRUTE.tree_shap(x, bg, trees)
    assert np.abs(a - BRUTE.tree_shap_bruteforce(x, bg, trees)).max() < 1e-12
    gap = BRUTE.tree_predict(x, trees) - BRUTE.tree_predict(bg, trees).mean()
    assert np.abs(a.sum(axis=1) - gap).max() < 1e-12


def _fit(spark, kind):
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.integers(0, 6, 4)), None if i % 9 == 0 else float(rng.random())) for i in range(240)]
    df = spark.createDataFrame(rows, "k int, a double, b double, `c.d` double, e double, f double")
    df = df.withColumn("label", (F.col("a") + F.col("b") * F.coalesce("f", F.lit(0.0)) > 4).cast("int"))
    names = ["a", "b", "c.d", "e", "f"]
    plain = df.fillna(0.0).withColumnRenamed("c.d", "cd")
    data = VectorAssembler(inputCols=["a", "b", "cd", "e", "f"], outputCol="features").transform(plain)
    est = {"tree": DecisionTreeClassifier(maxDepth=6), "forest": RandomForestClassifier(numTrees=7, maxDepth=8, seed=1),
           "boosted": GBTClassifier(maxIter=4, maxDepth=3, seed=1)}[kind]
    return df, names, data, est.fit(data)


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted"])
def test_attributions_of_fitted_models_sum_to_the_gap(spark, monkeypatch, kind):
    from pyspark.ml.functions import vector_to_array

    monkeypatch.setattr(ATT, "LEAVES_PER_GROUP", 11)  # several groups and blocks
    monkeypatch.setattr(ATT, "ROWS_PER_BLOCK", 20)
    df, names, data, model = _fit(spark, kind)
    background = df.where("k < 30")
    att = ATT.tree_attributions(df.where("k >= 200"), "k", names, model, background, top_k=None)
    # the margin of boosting: half the raw score that the model reports
    score = vector_to_array("rawPrediction")[1] if kind == "boosted" else vector_to_array("probability")[1]
    scored = model.transform(data).select("k", score.alias("p"))
    base = scored.where("k < 30").agg(F.avg("p").alias("base"))
    rows = ATT.with_additivity(att, scored, base, "k").collect()
    assert len(rows) == 40 * 5 and max(abs(r["gap"]) for r in rows) < 1e-9
    assert sorted(r["importance_rank"] for r in rows) == sorted([1, 2, 3, 4, 5] * 40)
    assert {r["feature_name"] for r in rows} == set(names) and all(r["feature_value"] is not None for r in rows)


def test_background_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(ATT, "MAX_BACKGROUND", 10)
    df, names, _, model = _fit(spark, "tree")
    for rows in (df, df.limit(0)):
        with pytest.raises(ValueError, match="background"):
            ATT.tree_attributions(df, "k", names, model, rows)


@pytest.mark.parametrize("held", [0, 100_000])
def test_exact_percentiles_of_hard_columns(spark, monkeypatch, held):
    """Ties, a hot value, NULLs, NaN, few rows: equal to ``percentile`` whether the
    bracket is picked from directly or sorted by range."""
    monkeypatch.setattr(P, "HELD", held)
    rng = np.random.default_rng(2)
    rows = [(float(rng.normal()), 5.0 if i % 3 else float(i), None if i % 2 else float(i % 7), float(i) if i < 3 else None, None, -0.0 if i % 2 else 0.0)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    names = [[f"{c}{j}" for j in range(len(probs))] for c in df.columns]
    got = P.exact_percentiles(df, df.columns, probs, names).first()
    want = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in df.columns]).first()
    for c, own in zip(df.columns, names, strict=True):
        for j, n in enumerate(own):
            assert got[n] is None if want[c] is None else got[n] == pytest.approx(want[c][j], abs=1e-12), (c, j)
    assert all(v is None for v in P.exact_percentiles(df.limit(0), ["a"], [0.5], [["m"]]).first())


def test_missed_bracket_is_widened(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    seen = []
    real = P._bracketed

    def first_misses(frame, brackets, ranks):
        seen.append({t: (lo, hi) for t, (_, lo, hi) in brackets.items()})
        return {} if len(seen) < 3 else real(frame, brackets, ranks)

    monkeypatch.setattr(P, "_bracketed", first_misses)
    assert P.exact_quantiles(df, "x", [0.7], ["q"]).first()["q"] == pytest.approx(699.3)
    assert len(seen) == 3 and seen[0][0][0] > seen[1][0][0] > seen[2][0][0]


def _pairwise_leaf_shap(xs, background, value, feature, low, high):
    out = np.zeros(xs.shape)
    for v, f, a, b in zip(value, feature, low, high, strict=True):
        used = np.isfinite(a) | np.isfinite(b)
        for i, x in enumerate(xs):
            for z in background:
                x_off, z_off = ({int(j) for j in f[used & ~((a < r[f]) & (r[f] <= b))]} for r in (x, z))
                if not x_off & z_off:
                    p, q = len(z_off), len(x_off)
                    for j in z_off:
                        out[i, j] += v * factorial(p - 1) * factorial(q) / factorial(p + q)
                    for j in x_off:
                        out[i, j] -= v * factorial(p) * factorial(q - 1) / factorial(p + q)
    return out / len(background)


@pytest.mark.parametrize("width, direct, cells", [(5, 20, 1 << 21), (5, 2, 7), (24, 20, 1 << 21), (40, 20, 5)])
def test_leaf_shap_matches_every_pair(monkeypatch, width, direct, cells):
    """Ties with the ends, paths of one to ``width`` places, wide patterns, small steps."""
    monkeypatch.setattr(ATT, "DIRECT", direct)
    monkeypatch.setattr(ATT, "CELLS", cells)
    rng = np.random.default_rng(8)
    k = max(8, width)
    xs, z = rng.integers(0, 8, (30, k)) / 8, rng.integers(0, 8, (9, k)) / 8
    feature = np.array([rng.permutation(k)[:width] for _ in range(20)])
    low, high = np.full(feature.shape, -np.inf), np.full(feature.shape, np.inf)
    below, above = rng.random(low.shape) < 0.3, rng.random(low.shape) < 0.3
    low[below], high[above] = rng.integers(0, 4, below.sum()) / 8, rng.integers(4, 8, above.sum()) / 8
    value = rng.random(20)
    got = ATT.leaf_shap(xs, z, value, feature, low, high)
    assert np.abs(got - _pairwise_leaf_shap(xs, z, value, feature, low, high)).max() < 1e-12
    assert np.abs(got).max() > 0


def test_leaf_shap_work_follows_the_distinct_patterns():
    """Many rows and background rows of two patterns: time must not follow their pairs."""
    rng = np.random.default_rng(9)
    xs, z = rng.random((1 << 14, 2)), rng.random((ATT.MAX_BACKGROUND, 2))
    place = np.zeros(1 << 1, np.int32)
    patterns, number = ATT._distinct(ATT._bits((xs > 0.5).astype(np.uint16).T, *np.array([[0], [0], [0]])), 1, place)
    assert sorted(patterns.tolist()) == [0, 1] and (patterns[number] == (xs[:, 0] > 0.5)).all()
    feature, low, high = np.zeros((50, 1), int), np.full((50, 1), -np.inf), np.full((50, 1), 0.5)
    start = time.process_time()
    got = ATT.leaf_shap(xs, z, np.ones(50), feature, low, high)
    took = time.process_time() - start
    assert np.abs(got[:, 0] - 50 * ((xs[:, 0] <= 0.5) - (z[:, 0] <= 0.5).mean())).max() < 1e-9
    assert took < 3  # by pairs of rows: 63 s
