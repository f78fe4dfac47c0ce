"""The test of a pair of sketches, made for every pair of an inverted list."""

import numpy as np
from pyspark.sql import functions as F

from upkeep.llm import near_duplicates as N


def _pairs(spark, n=300):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        base = rng.choice(np.arange(-500, 500), 110, replace=False)
        share, sizes = int(rng.integers(0, 64)), rng.integers(40, 100, 2).tolist()
        a, b = np.sort(base[:64]), np.sort(np.concatenate([base[:share], base[64:]])[:int(rng.integers(20, 65))])
        rows.append((i, a.tolist(), b.tolist(), *sizes))
    return rows, spark.createDataFrame(rows, "i int, a array<long>, b array<long>, na long, nb long")


def test_pairs_are_judged_by_sizes_and_the_union_of_sketches(spark):
    rows, df = _pairs(spark)
    got = {r["i"]: r["ok"] for r in df.select("i", N._may_link("a", "b", "na", "nb", 80).alias("ok")).collect()}
    want = {}
    for i, a, b, na, nb in rows:
        union = sorted(set(a) | set(b))[:N.SKETCH]
        share = len(set(union) & set(a) & set(b)) / len(union)
        want[i] = min(na, nb) * 100 >= max(na, nb) * 80 and share >= 0.8 - N.SLACK
    assert got == want and 0 < sum(want.values()) < len(want)


def test_no_comparator_is_called_for_a_pair(spark):
    """``array_sort`` calls a lambda for every two values: most of the time of a pair."""
    _, df = _pairs(spark, 2)
    lists = spark.createDataFrame([(1, 0), (1, 1)], "value long, doc long")
    classes = df.select(F.col("i").cast("long").alias("doc"), F.col("na").alias("n"), F.col("a").alias("sketch"),
                        F.lit(None).cast("int").alias("turn"), F.lit(None).cast("long").alias("hub"))
    for plan in (df.where(N._may_link("a", "b", "na", "nb", 80)), N._compared(lists, classes, 80)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "sort_array(" in text and "array_sort(" not in text and "lambda" not in text
