"""Splits by selected cut rows and curves from one histogram, against single-task versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from upkeep.operators import metrics as E
from upkeep.operators import positions as P
from upkeep.operators import splits as D


def counts(df, *by):
    return {tuple(r[b] for b in by) + (r["split"],): r["count"] for r in df.groupBy(*by, "split").count().collect()}


@pytest.mark.parametrize("held", [P.HELD, 5])
def test_chronological_cuts(spark, monkeypatch, held):
    """Rows on one hot time, nulls, and both ways of picking from a bracket."""
    monkeypatch.setattr(P, "HELD", held)
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 500).when(F.col("id") % 101 == 0, None).otherwise(F.hash("id") % 1000).cast("timestamp").alias("t"))
    out = D.split_chronological(rows, "t", ["id"]).toPandas()
    want = out.assign(n=out["t"].notna()).sort_values(["n", "t", "id"], kind="stable")["id"].to_numpy()
    n, cut = len(want), math.floor(30_000 * 0.7)
    split = dict(zip(out["id"], out["split"], strict=True))
    assert [split[i] for i in want] == ["train"] * cut + ["val"] * math.floor(n * 0.15) + ["test"] * (n - cut - math.floor(n * 0.15))


def test_chronological_ties_and_small_tables(spark):
    tied = spark.range(1000).select("id", F.lit(1).alias("t"))
    assert counts(D.split_chronological(tied, "t")) == {("train",): 700, ("val",): 150, ("test",): 150}
    for n in (0, 1, 2, 3, 7):
        out = counts(D.split_chronological(spark.range(n).withColumnRenamed("id", "t"), "t"))
        a, b = math.floor(n * 0.7), math.floor(n * 0.15)
        assert out == {k: v for k, v in {("train",): a, ("val",): b, ("test",): n - a - b}.items() if v}


def test_no_exchange_of_rows(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 2).alias("s"), F.lit("wide").alias("payload"))
    for out in (D.split_chronological(rows, "id"), D.split_stratified(rows, "s", "id"), D.split_holdout(rows, "id")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "SortMergeJoin" not in plan


def test_stratified_repeated_and_null_keys_many_strata(spark, monkeypatch):
    rows = spark.range(12_000).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("s"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("k"))
    one = counts(D.split_stratified(rows, "s", "k"), "s")
    want = {(s, x): c for s in (None, 1, 2, 3) for x, c in (("train", 2100), ("val", 450), ("test", 450))}
    assert one == want
    monkeypatch.setattr(D, "STRATA", 2)  # more strata than cuts are sent for
    assert counts(D.split_stratified(rows, "s", "id"), "s") == want
    by_cuts = D.split_stratified(rows.where("s < 3"), "s", "id").select("id", "split").exceptAll(D.split_stratified(rows, "s", "id").where("s < 3").select("id", "split"))
    assert by_cuts.isEmpty()


def test_holdout_keeps_machines_whole(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 100).alias("machine_id"))
    out = D.split_holdout(rows)
    assert out.where("machine_id IS NULL AND split <> 'train'").isEmpty()
    per = out.where("machine_id IS NOT NULL").groupBy("machine_id").agg(F.collect_set("split").alias("s")).collect()
    sizes = [tuple(r["s"]) for r in per]
    train = math.floor(90 * 0.7)
    assert [sizes.count((x,)) for x in ("train", "val", "test")] == [train, (90 - train) // 2, 90 - train - (90 - train) // 2] and len(sizes) == 90


def curve(y, p):
    """Cumulative counts by descending distinct score."""
    scores = np.unique(p)[::-1]
    return scores, np.array([(y[p >= s] == 1).sum() for s in scores]), np.array([(y[p >= s] == 0).sum() for s in scores])


def equal(found, want):
    """The same points in any order; no threshold counts as 9."""
    a, b = (np.array(sorted((9 if t is None else t, x, y) for x, y, t in points)) for points in (found, want))
    return a.shape == b.shape and np.allclose(a, b)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_curves(spark, partitions):
    """A hot model over many ranges, a small one, a single class, a null model."""
    rng = np.random.default_rng(3)
    data = {"hot": 3000, "small": 9, None: 40, "one": 30}
    rows = []
    for m, n in data.items():
        p = np.round(rng.random(n), 2)
        rows += [(m, int(m == "one" or rng.random() < x), float(x)) for x in p]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "model string, y int, p double")
        roc, pr = E.roc_curve(df, ["model"]).collect(), E.pr_curve(df, ["model"]).collect()
        met = {r["model"]: r for r in E.evaluate(df, ["model"]).collect()}
        plan = E.evaluate(df, ["model"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "Join" not in plan and set(met) == set(data)
    assert met["one"]["roc_auc"] is None and not [r for r in roc + pr if r["model"] == "one"]
    for m in data:
        y, p = (np.array([r[i] for r in rows if r[0] == m]) for i in (1, 2))
        assert [met[m][c] for c in ("tn", "fp", "fn", "tp")] == [int(((p >= 0.5) == h)[y == c].sum()) for c, h in ((0, False), (0, True), (1, False), (1, True))]
        if m == "one":
            continue
        s, tp, fp = curve(y, p)
        gain = np.diff(tp, prepend=0)
        keep = [i for i in range(len(s)) if i in (0, len(s) - 1) or gain[i] != gain[i + 1] or fp[i] - (fp[i - 1] if i else 0) != fp[i + 1] - fp[i]]
        want = [(0.0, 0.0, None)] + [(fp[i] / fp[-1], tp[i] / tp[-1], s[i]) for i in keep]
        assert equal([(r["fpr"], r["tpr"], r["threshold"]) for r in roc if r["model"] == m], want)
        want = [(1.0, 0.0, None)] + [(tp[i] / (tp[i] + fp[i]), tp[i] / tp[-1], s[i]) for i in range(len(s))]
        assert equal([(r["precision"], r["recall"], r["threshold"]) for r in pr if r["model"] == m], want)
        pairs = (np.subtract.outer(p[y == 1], p[y == 0]))
        assert met[m]["roc_auc"] == pytest.approx(((pairs > 0) + (pairs == 0) / 2).mean())
        assert met[m]["pr_auc"] == pytest.approx((gain / tp[-1] * tp / (tp + fp)).sum())
