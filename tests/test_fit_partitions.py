"""Fits and scoring use few partitions, whatever the session's shuffle partitions."""

from pyspark.sql import functions as F

from upkeep.operators import train as T


def _rows(spark, n=400):
    return spark.range(n).select(
        F.col("id").alias("key"), F.lit("train").alias("split"), F.lit(1.0).alias("weight"),
        (F.col("id") * 37 % 101).cast("double").alias("f0"), (F.col("id") * 53 % 97).cast("double").alias("f1"),
        ((F.col("id") * 37 % 101 + F.col("id") * 53 % 97) % 3 == 0).cast("int").alias("label"))


def test_fit_does_not_depend_on_partitions(spark):
    rows = _rows(spark)
    trees = []
    for data in (rows.repartition(3), rows.orderBy(F.desc("key")).repartition(40, "key")):
        prep = T.Prepared(data, ["f0", "f1"], {}, {}, {})
        trees.append(T.fit(prep, "random_forest", overrides={"numTrees": 4, "maxDepth": 6}).stages[-1].toDebugString.split("\n", 1)[1])
    assert trees[0] == trees[1]


def test_scoring_in_few_tasks_keeps_all_rows(spark):
    rows = _rows(spark)
    model = T.fit(T.Prepared(rows, ["f0", "f1"], {}, {}, {}), "decision_tree", overrides={"maxDepth": 4})
    scored = T.probabilities(model, rows.repartition(40, "key"), ["key"])
    assert scored.rdd.getNumPartitions() == 1
    assert sorted(r["key"] for r in scored.collect()) == list(range(400))


def test_partitions_grow_with_rows():
    assert [T.fit_partitions(n) for n in (0, 1, 63_000, 420_000, 4_000_000)] == [1, 1, 4, 16, 31]
