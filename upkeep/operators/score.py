"""Batch scoring (I1-I3, I6) and the fixed-coefficient linear scorer.

Scoring is a projection: features aligned to the trained list, model
``transform`` (or a closed-form linear score), thresholds to a priority
level. No per-row Python, no driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.functions.columns import md5_order
from upkeep.operators.labels import priority_level
from upkeep.schema import HIGH


def align_features(df: DataFrame, feature_columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Trained feature order; missing column → 0.0, unknown dropped, NULL → 0."""
    keep = keep or []
    present = set(df.columns)
    cols = [F.col(k) for k in keep]
    for c in feature_columns:
        v = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in present else F.lit(0.0)
        cols.append(v.alias(c))
    return df.select(*cols)


def check_input(df: DataFrame) -> list[str]:
    """I2."""
    return [] if "machine_id" in df.columns else ["Missing required field: machine_id"]


def linear_margin(coefficients: dict[str, float], intercept: float) -> Column:
    z = F.lit(float(intercept))
    for c, w in coefficients.items():
        z = z + F.lit(float(w)) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return z


def score_linear(df: DataFrame, coefficients: dict[str, float], intercept: float, out: str = "probability",
                 digits: int | None = 6) -> DataFrame:
    """Logistic probability of a fixed linear model (NULL inputs count as 0)."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-linear_margin(coefficients, intercept)))
    return df.withColumn(out, F.round(p, digits) if digits is not None else p)


def classify(df: DataFrame, prob_col: str = "probability", watch: float = 0.5, high: float = 0.8,
             cut: float = 0.5) -> DataFrame:
    """I3 tail: class = p >= cut; priority by thresholds (defaults 0.5 / 0.8)."""
    return df.withColumn("predicted_class", (F.col(prob_col) >= cut).cast("int")).withColumn(
        "intervention_priority", priority_level(F.col(prob_col), watch, high, HIGH))


def batch_score(df: DataFrame, model, feature_columns: list[str], keep: list[str], watch: float = 0.5,
                high: float = 0.8) -> DataFrame:
    """I3 with a fitted Spark ML pipeline whose first stage assembles ``features``."""
    from pyspark.ml.functions import vector_to_array

    aligned = align_features(df, feature_columns, keep)
    out = model.transform(aligned)
    out = out.withColumn("probability", vector_to_array("probability")[1])
    return classify(out.select(*keep, "probability"), "probability", watch, high)


def background_sample(df: DataFrame, key: str, n: int = 100, seed: int = 42) -> DataFrame:
    """min(n, rows) pseudo-random rows — deterministic top-k by md5 (the
    limit is the feature: a bounded background set)."""
    return df.orderBy(md5_order(seed, key), F.col(key)).limit(n)
