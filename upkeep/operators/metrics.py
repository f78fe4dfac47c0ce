"""Evaluation over a scored table.

Input: a long table ``(model, y, p)`` (one row per scored row and model).
Threshold metrics are single aggregations; ranking metrics and curves go
through one histogram of (model, score) and its running counts (no single-task
window, no sort of the raw rows, no join on the model):

* ROC-AUC = Σ neg·(tp_before + pos/2) / (P·N)   (ties count half)
* AP      = Σ (pos/P) · precision_at_threshold  (step rule, ties grouped)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upkeep.session import cut_lineage


def _zdiv(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, group: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Tn fp fn tp per group (labels 0/1)."""
    yy, pp = F.col(y) == 1, F.col(pred) == 1
    return df.groupBy(*group).agg(
        F.count_if(~yy & ~pp).alias("tn"), F.count_if(~yy & pp).alias("fp"),
        F.count_if(yy & ~pp).alias("fn"), F.count_if(yy & pp).alias("tp"),
    )


def threshold_metrics(cm: DataFrame) -> DataFrame:
    """E2 from E1: accuracy, precision, recall, F1; zero division → 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    prec, rec = _zdiv(tp, tp + fp), _zdiv(tp, tp + fn)
    return cm.select(
        "*",
        _zdiv(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        prec.alias("precision"),
        rec.alias("recall"),
        _zdiv(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def score_histogram(df: DataFrame, group: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """``pos`` and ``neg`` rows per group and distinct score, combined map-side: all
    that E1-E6 need of the rows."""
    return df.groupBy(*group, p).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def score_table(df: DataFrame, group: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """The histogram by descending score with inclusive cumulative counts ``cum_pos`` and
    ``cum_neg``, the position ``rank``, the next score's counts ``next_pos`` and
    ``next_neg`` (NULL after the last) and the group's ``n_pos``, ``n_neg``, ``n_scores``.

    Scores lie in ranges of (group, score), so one group's scores are many tasks. Each
    group's part of a range sends one edge row (totals, first counts); windows over these
    few rows give what lies before the part, the counts that follow it and the group's
    totals, which come back as one more row at its head. Nothing is joined on the group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*(F.col(g) for g in group), F.col(p).desc()]
    hist = score_histogram(df, group, y, p).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    hist = hist.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    hist = cut_lineage(hist)  # read twice, with the same ranges
    edges = hist.groupBy("__part", *group).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count(F.lit(1)).alias("rank"),
        F.min_by(F.struct("pos", "neg"), "__at").alias("first"))
    every = Window.partitionBy(*group)  # a row for each range that holds the group
    ahead = every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    head = edges.select(
        "__part", *group, F.lit(None).cast(df.schema[p].dataType).alias(p), F.lit(-1).cast("long").alias("__at"),
        *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("pos", "neg", "rank")],
        F.lead("first").over(every.orderBy("__part")).alias("after"),
        F.struct(*[F.sum(c).over(every).alias(n) for c, n in (("pos", "n_pos"), ("neg", "n_neg"), ("rank", "n_scores"))]).alias("total"))
    rows = hist.withColumn("rank", F.lit(1).cast("long")).unionByName(head, allowMissingColumns=True)
    part = Window.partitionBy("__part", *group)
    run = part.orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    after = F.coalesce(F.lead(F.struct("pos", "neg")).over(part.orderBy("__at")), F.first("after", ignorenulls=True).over(run))
    total = F.first("total", ignorenulls=True).over(run)
    out = rows.select("__at", *group, p, "pos", "neg", F.sum("pos").over(run).alias("cum_pos"), F.sum("neg").over(run).alias("cum_neg"),
                      F.sum("rank").over(run).alias("rank"), after.alias("__after"), total.alias("__total"))
    return out.where("__at >= 0").select(*group, p, "pos", "neg", "cum_pos", "cum_neg", "rank", F.col("__after.pos").alias("next_pos"),
                                         F.col("__after.neg").alias("next_neg"), "__total.*")


def _ranking_aggs() -> dict[str, F.Column]:
    """E3 and E4 as aggregates of ``score_table`` (NULL for a single class)."""
    n_pos, n_neg = F.max("n_pos"), F.max("n_neg")
    ok = (n_pos > 0) & (n_neg > 0)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0))
    steps = F.sum(F.col("pos") * _zdiv(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")))
    return {"roc_auc": F.when(ok, area / (n_pos * n_neg)), "pr_auc": F.when(ok, steps / n_pos)}


def ranking_metrics(df: DataFrame, group: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """E3/E4 per group: ``roc_auc`` and ``pr_auc`` (NULL for a single class)."""
    return score_table(df, group, y, p).groupBy(*group).agg(*[c.alias(n) for n, c in _ranking_aggs().items()])


def _two_classes(table: DataFrame) -> DataFrame:
    return table.where("n_pos > 0 AND n_neg > 0")


def _with_end(points: DataFrame, first: F.Column, **end: float | None) -> DataFrame:
    """``points``, and before the row that ``first`` marks the constant point ``end``."""
    own = [F.col(c).alias(c) for c in end]
    extra = [F.lit(v).cast("double").alias(c) for c, v in end.items()]
    both = F.when(first, F.array(F.struct(*extra), F.struct(*own))).otherwise(F.array(F.struct(*own)))
    return points.withColumn("__points", both).drop(*end).select("*", F.inline("__points")).drop("__points")


def roc_curve(df: DataFrame, group: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """E5: points ``(fpr, tpr, threshold)`` starting at (0, 0) (threshold NULL), with
    collinear intermediate points dropped: those whose counts equal the next score's.
    A group of a single class has no points."""
    cum = _two_classes(score_table(df, group, y, p))
    bent = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    points = cum.where((F.col("rank") == 1) | (F.col("rank") == F.col("n_scores")) | bent).select(
        *group, "rank", (F.col("cum_neg") / F.col("n_neg")).alias("fpr"), (F.col("cum_pos") / F.col("n_pos")).alias("tpr"),
        F.col(p).cast("double").alias("threshold"))
    return _with_end(points, F.col("rank") == 1, fpr=0.0, tpr=0.0, threshold=None).drop("rank")


def pr_curve(df: DataFrame, group: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """``(precision, recall, threshold)`` for every distinct threshold plus the end
    point (precision 1, recall 0, threshold NULL). A group of a single class has no points."""
    cum = _two_classes(score_table(df, group, y, p))
    points = cum.select(*group, "rank", _zdiv(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                        (F.col("cum_pos") / F.col("n_pos")).alias("recall"), F.col(p).cast("double").alias("threshold"))
    return _with_end(points, F.col("rank") == 1, precision=1.0, recall=0.0, threshold=None).drop("rank")


def evaluate(df: DataFrame, group: list[str], y: str = "y", p: str = "p", cut: float = 0.5) -> DataFrame:
    """E1-E4 in one table per group (predictions at ``p >= cut``), from one scan of the rows."""
    hit = F.col(p) >= cut
    cells = {"tn": F.when(~hit, F.col("neg")), "fp": F.when(hit, F.col("neg")), "fn": F.when(~hit, F.col("pos")), "tp": F.when(hit, F.col("pos"))}
    cm = score_table(df, group, y, p).groupBy(*group).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in cells.items()], *[c.alias(n) for n, c in _ranking_aggs().items()])
    thresholds = threshold_metrics(cm.drop("roc_auc", "pr_auc")).columns
    return threshold_metrics(cm).select(*thresholds, "roc_auc", "pr_auc")


def select_model(metrics: DataFrame, order_col: str = "candidate_order") -> DataFrame:
    """Best by (pr_auc or 0, recall); the earlier candidate wins a full tie."""
    key = F.struct(F.coalesce(F.col("pr_auc"), F.lit(0.0)), F.col("recall"), -F.col(order_col))
    return metrics.agg(F.max_by("model", key).alias("selected_model"))


def comparison(metrics: DataFrame) -> DataFrame:
    """One row per candidate, 3 decimals, ``selected`` flag."""
    best = select_model(metrics)
    cols = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]
    return metrics.crossJoin(F.broadcast(best)).select(
        "model", *[F.round(F.col(c), 3).alias(c) for c in cols],
        (F.col("model") == F.col("selected_model")).alias("selected"),
    )
