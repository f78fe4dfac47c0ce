"""Priority score and labels (L1-L8) and the failure-within-horizon label.

Fit steps are single aggregation passes producing a one-row parameter frame
that is broadcast back by cross join: no re-planning and no driver round
trip, and the broadcast side has exactly one row whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upkeep.functions.columns import col_, micros
from upkeep.schema import DEFAULT_WEIGHTS, HIGH, HIGH_RISK, NORMAL, WATCH

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def extra_numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df) if c.startswith("extra__")]


# ---------------------------------------------------------------- L1 / L2
def signal_aggs(columns: list[str]) -> list[Column]:
    """Per column: any non-null and more than one distinct value after null→0."""
    out = []
    for c in columns:
        z = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        out.append(((F.count(c) > 0) & (F.min(z) != F.max(z))).alias(c))
    return out


def signal_test(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Long table ``(column_name, has_signal)`` from one aggregation pass."""
    columns = columns or numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, has_signal boolean")
    wide = df.agg(*signal_aggs(columns))
    return wide.unpivot([], columns, "column_name", "has_signal")


def resolve_weights(df: DataFrame) -> dict[str, float]:
    """Known compliance columns with signal; else every numeric ``extra__``
    column with signal at weight 1.0; else empty. One job, one-row result."""
    known = [c for c in DEFAULT_WEIGHTS if c in df.columns]
    extras = extra_numeric_columns(df)
    cols = known + extras
    if not cols:
        return {}
    row = df.agg(*signal_aggs(cols)).first().asDict()
    chosen = {c: DEFAULT_WEIGHTS[c] for c in known if row[c]}
    if chosen:
        return chosen
    return {c: 1.0 for c in extras if row[c]}


def weights_frame(df: DataFrame) -> DataFrame:
    w = resolve_weights(df)
    return df.sparkSession.createDataFrame(list(w.items()), "column_name string, weight double")


# ---------------------------------------------------------------- L3
def score_params(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One-row frame of min/max per weighted column (null → 0)."""
    cols = [c for c in weights if c in df.columns]
    aggs = []
    for c in cols:
        z = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        aggs += [F.min(z).alias(f"__min_{c}"), F.max(z).alias(f"__max_{c}")]
    if not aggs:
        return df.sparkSession.range(1).select(F.lit(0).alias("__none"))
    return df.agg(*aggs)


def score_expression(weights: dict[str, float], columns: list[str]) -> Column:
    cols = [c for c in weights if c in columns]
    if not cols:
        return F.lit(0.0)
    terms = []
    for c in cols:
        z = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        lo, hi = F.col(f"__min_{c}"), F.col(f"__max_{c}")
        norm = F.when(hi - lo > 0, (z - lo) / (hi - lo)).otherwise(z * 0.0)
        terms.append(F.lit(float(weights[c])) * norm)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total / F.lit(float(sum(weights[c] for c in cols)))


def priority_score(df: DataFrame, weights: dict[str, float] | None = None, params: DataFrame | None = None,
                   out: str = "priority_score") -> DataFrame:
    """Min-max each weighted column over ``params`` (default: this frame), weighted mean."""
    weights = resolve_weights(df) if weights is None else weights
    params = score_params(df, weights) if params is None else params
    joined = df.crossJoin(F.broadcast(params))
    return joined.withColumn(out, score_expression(weights, df.columns)).drop(*params.columns)


# ---------------------------------------------------------------- L4 / L5 / L6
def fit_thresholds(scores: DataFrame, score_col: str = "priority_score", watch_pct: float = 70.0,
                   high_pct: float = 90.0, method: str = "exact") -> DataFrame:
    """One-row ``(watch_threshold, high_threshold)``: linear-interpolated percentiles.

    ``exact`` (default) and ``positional`` = order statistics bracketed by a sketch
    and counted out (``positions.exact_percentiles``): safe for any number of
    distinct scores or a hot score;
    ``aggregate`` = Spark's ``percentile`` (its value→count map is merged in one
    task, so only for low-cardinality scores);
    ``approx`` = ``percentile_approx`` with a 1e-4 relative rank error.
    """
    if watch_pct >= high_pct:
        raise ValueError("watch_percentile must be less than high_percentile")
    probs = [watch_pct / 100.0, high_pct / 100.0]
    if method in ("exact", "positional"):
        from upkeep.operators.positions import exact_quantiles

        return exact_quantiles(scores, score_col, probs, ["watch_threshold", "high_threshold"])
    if method == "approx":
        q = F.percentile_approx(score_col, probs, 10000)
    elif method == "aggregate":
        q = F.percentile(F.col(score_col), F.array(*[F.lit(p) for p in probs]))
    else:
        raise ValueError(f"unknown method {method}")
    return scores.agg(q.alias("q")).select(
        F.col("q")[0].alias("watch_threshold"), F.col("q")[1].alias("high_threshold")
    )


def priority_level(score: Column, watch: Column | float, high: Column | float, top_label: str = HIGH) -> Column:
    watch = F.lit(watch) if isinstance(watch, (int, float)) else watch
    high = F.lit(high) if isinstance(high, (int, float)) else high
    return F.when(score >= high, F.lit(top_label)).when(score >= watch, F.lit(WATCH)).otherwise(F.lit(NORMAL))


def apply_thresholds(df: DataFrame, thresholds: DataFrame, score_col: str = "priority_score",
                     out: str = "intervention_priority", top_label: str = HIGH) -> DataFrame:
    j = df.crossJoin(F.broadcast(thresholds.select("watch_threshold", "high_threshold")))
    return j.withColumn(
        out, priority_level(F.col(score_col), F.col("watch_threshold"), F.col("high_threshold"), top_label)
    ).drop("watch_threshold", "high_threshold")


def classify_risk(df: DataFrame, thresholds: DataFrame, score_col: str = "priority_score") -> DataFrame:
    return apply_thresholds(df, thresholds, score_col, out="risk_level", top_label=HIGH_RISK)


def label_snapshot(df: DataFrame, weights: dict[str, float] | None = None, method: str = "exact") -> DataFrame:
    """Score → thresholds fitted on the same frame → level → 0/1 ``label``."""
    from upkeep.operators.positions import fitted_row

    scored = priority_score(df, weights)
    th = fitted_row(fit_thresholds(scored, method=method))
    lab = apply_thresholds(scored, th)
    return lab.withColumn("label", (F.col("intervention_priority") == HIGH).cast("int"))


# ---------------------------------------------------------------- L8
def leakage_free(feature_columns: list[str], weights: dict[str, float], drop_ratios: bool = True) -> list[str]:
    """Columns that fed the score never become features (nor ratios built on them)."""
    from upkeep.operators.features import RATIO_COLUMNS

    banned = set(weights)
    if drop_ratios:
        banned |= set(RATIO_COLUMNS)
    return [c for c in feature_columns if c not in banned]


# ---------------------------------------------------------------- W8
def horizon_label(df: DataFrame, hours: int, group_col: str = "machine_id", time_col: str = "timestamp",
                  event_col: str = "failure_label", out: str = "failure_within_horizon") -> DataFrame:
    """1 iff the same machine has a failure event in (t, t+H]: the next failure
    after t is a running minimum over the rows in descending time (one sort, one
    value of state a machine), and it decides with one comparison."""
    from pyspark.sql import Window

    us = "__t_us"
    w = Window.partitionBy(group_col).orderBy(F.col(us).desc()).rangeBetween(Window.unboundedPreceding, -1)
    after = F.min(F.when(F.col(event_col) == 1, F.col(us))).over(w)
    fired = (after - F.col(us) <= int(hours) * 3600 * 1_000_000).cast("int")
    return (
        df.withColumn(us, micros(col_(time_col)))
        .withColumn(out, F.coalesce(fired, F.lit(0)).cast("int"))
        .drop(us)
    )
