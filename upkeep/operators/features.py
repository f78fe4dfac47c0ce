"""Row-level feature groups (X1-X7): projections over the standard schema."""

from __future__ import annotations

import functools
import warnings
from collections.abc import Callable
from typing import NamedTuple

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.functions.columns import micros
from upkeep.operators.labels import extra_numeric_columns
from upkeep.operators.positions import global_position
from upkeep.operators.timeseries import lag_rolling_columns
from upkeep.schema import CATEGORICAL_FIELDS, COMPLIANCE_FIELDS, DEFAULT_FEATURE_GROUPS, RECENCY_COLUMNS



class Ratio(NamedTuple):
    """``top`` over the sum of ``bottom`` and ``plus``; where that sum is zero, or with
    ``otherwise`` set not positive or NULL, the result is ``otherwise``."""

    name: str
    top: str
    bottom: tuple[str, ...]
    plus: int = 0
    otherwise: float | None = None

    def column(self) -> Column:
        top, *bottom = (F.col(c).cast("double") for c in (self.top, *self.bottom))
        below = functools.reduce(Column.__add__, bottom) + self.plus
        if self.otherwise is None:
            return F.try_divide(top, below).alias(self.name)
        return F.when(below > 0, top / below).otherwise(F.lit(self.otherwise)).alias(self.name)


# FIXED VALUES — ratio features
RATIOS = [
    Ratio("pm_overdue_ratio", "overdue_pms", ("total_completed_pms",), plus=1),
    Ratio("wo_overdue_ratio", "overdue_wos", ("total_completed_wos",), plus=1),
    Ratio("downtime_per_completed_wo", "downtime_minutes", ("total_completed_wos",), plus=1),
    Ratio("pm_compliance_rate", "total_completed_pms", ("total_completed_pms", "overdue_pms"), otherwise=1.0),
]
RATIO_COLUMNS = [r.name for r in RATIOS]
DAY_US = 86_400_000_000


def raw_features(df: DataFrame, **_: object) -> list[Column]:
    """X1."""
    return [F.col(c) for c in COMPLIANCE_FIELDS if c in df.columns]


def extra_features(df: DataFrame, **_: object) -> list[Column]:
    """Numeric pass-through columns only (text extras stay out)."""
    return [F.col(c) for c in extra_numeric_columns(df)]


def ratio_features(df: DataFrame, **_: object) -> list[Column]:
    """The ratios whose columns are all there."""
    return [r.column() for r in RATIOS if {r.top, *r.bottom} <= set(df.columns)]


def reference_date(df: DataFrame) -> DataFrame:
    """One-row frame: the latest value over the date columns present."""
    dates = [c for c in RECENCY_COLUMNS if c in df.columns]
    if not dates:
        return df.sparkSession.range(1).select(F.lit(None).cast("timestamp_ntz").alias("__ref"))
    latest = F.max(dates[0]) if len(dates) == 1 else F.greatest(*[F.max(c) for c in dates])
    return df.agg(latest.alias("__ref"))


def recency_features(df: DataFrame, ref_col: str = "__ref", **_: object) -> list[Column]:
    """Whole days (floored) from each date to the reference; expects the
    reference joined in as ``ref_col`` (see ``with_reference``)."""
    return [
        F.floor((micros(F.col(ref_col)) - micros(F.col(src))) / F.lit(DAY_US)).cast("bigint").alias(name)
        for src, name in RECENCY_COLUMNS.items() if src in df.columns
    ]


def with_reference(df: DataFrame, ref: DataFrame | None = None) -> DataFrame:
    ref = reference_date(df) if ref is None else ref
    return df.crossJoin(F.broadcast(ref.select(F.col(ref.columns[0]).alias("__ref"))))


def lag_features(df: DataFrame, **_: object) -> list[Column]:
    """Per-machine lags and rolling statistics of the sensors; none without a
    machine, a timestamp or a sensor."""
    return lag_rolling_columns(df)


GROUPS: dict[str, Callable[..., list[Column]]] = {
    "raw": raw_features,
    "temporal": recency_features,
    "statistical": ratio_features,
    "extra": extra_features,
    "lags": lag_features,
}
# names of the registry that stand for data which the standard schema does not hold
PLANNED_GROUPS = {"events": "a log of maintenance events", "frequency": "vibration waveforms"}


def feature_columns(df: DataFrame, groups: list[str] | None = None) -> list[Column]:
    """The columns of the groups, in their order. A planned group has none and is
    named in a warning; any other name is refused."""
    names = groups or DEFAULT_FEATURE_GROUPS
    for name in names:
        if name in PLANNED_GROUPS:
            warnings.warn(f"feature group {name} adds nothing: it needs {PLANNED_GROUPS[name]}", stacklevel=2)
        elif name not in GROUPS:
            raise ValueError(f"{name} is no feature group; there are {', '.join([*GROUPS, *PLANNED_GROUPS])}")
    return [column for name in names if name in GROUPS for column in GROUPS[name](df)]


def build_numeric(df: DataFrame, groups: list[str] | None = None, keep: list[str] | None = None,
                  ref: DataFrame | None = None) -> DataFrame:
    """Key columns plus the numeric feature groups (reference date broadcast once)."""
    keep = keep or []
    groups = groups or DEFAULT_FEATURE_GROUPS
    base = with_reference(df, ref) if "temporal" in groups else df
    has_dates = any(c in df.columns for c in RECENCY_COLUMNS)
    cols = [F.col(k) for k in keep] + feature_columns(base if has_dates else df, groups)
    return base.select(*cols)


# ------------------------------------------------------------------ X6
def _category(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def fit_categories(train: DataFrame, columns: list[str] | None = None) -> dict[str, list[str]]:
    """Sorted category list per column from the training rows only. NULL is
    the literal category 'None'. One aggregation; results are category-sized and become
    a column each: for columns of many categories see ``category_table``."""
    columns = columns or [c for c in CATEGORICAL_FIELDS if c in train.columns]
    if not columns:
        return {}
    long = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("k"), _category(c).alias("v")) for c in columns
    ])).alias("r")).select("r.*").distinct()
    cats: dict[str, list[str]] = {c: [] for c in columns}
    for r in long.collect():  # categories, not rows
        cats[r["k"]].append(r["v"])
    return {c: sorted(v) for c, v in cats.items()}


def onehot_columns(categories: dict[str, list[str]]) -> list[Column]:
    """``<col>_<category>`` 0/1 doubles; unseen categories → all zeros."""
    out = []
    for c, values in categories.items():
        out += [F.when(_category(c) == F.lit(x), 1.0).otherwise(0.0).alias(f"{c}_{x}") for x in values]
    return out


def category_table(train: DataFrame, columns: list[str], path: str) -> DataFrame:
    """X6 for any number of categories: (column, category, position), written to ``path``.
    Positions count from 0 over all columns, by column and category; NULL is the category
    'None'. Values are made distinct map-side, so a hot one is one row a task; no
    category passes through the driver."""
    values = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _category(c).alias("category")) for c in columns])).alias("r")).select("r.*").distinct()
    placed = global_position(values, ["column", "category"], out="position")
    placed.select("column", "category", (F.col("position") - 1).alias("position")).write.mode("overwrite").parquet(path)
    return train.sparkSession.read.schema("column string, category string, position long").parquet(path)


def with_categories(df: DataFrame, table: DataFrame, columns: list[str], out: str = "active") -> DataFrame:
    """``df`` with ``out``: array of (position, name ``<col>_<category>``) of the row's
    categories; unseen ones are left out. One left join a column: Spark broadcasts the
    table if its files are small, else both sides are dealt by category, where AQE splits a hot one."""
    for i, c in enumerate(columns):
        own = table.where(F.col("column") == c).select(
            F.col("category").alias("__v"), F.struct("position", F.concat_ws("_", "column", "category").alias("name")).alias(f"__c{i}"))
        df = df.withColumn("__k", _category(c)).join(own, F.col("__k") == F.col("__v"), "left").drop("__k", "__v")
    found = [f"__c{i}" for i in range(len(columns))]
    return df.withColumn(out, F.array_compact(F.array(*found))).drop(*found)


def category_vectors(df: DataFrame, table: DataFrame, columns: list[str], out: str = "onehot") -> DataFrame:
    """``df`` with ``out``: a sparse vector over all categories, 1 at the positions of the
    row's; ``table`` names the entries. A row's vector has at most one entry a column."""
    places = {r["column"]: (r["first"], r["n"]) for r in  # one row a column
              table.groupBy("column").agg(F.min("position").alias("first"), F.count("*").alias("n")).collect()}
    used = sorted(c for c in columns if c in places)
    if not used:
        raise ValueError(f"the table has no category of {', '.join(columns)}")
    df = with_categories(df, table, used, "__active")
    for i, c in enumerate(used):
        first, n = places[c]
        own = F.expr(f"get(filter(__active, a -> a.position BETWEEN {first} AND {first + n - 1}), 0).position")
        df = df.withColumn(f"__i{i}", F.coalesce(own - first, F.lit(n)).cast("double"))
    ins, vectors = [f"__i{i}" for i in range(len(used))], [f"__v{i}" for i in range(len(used))]
    sizes = df.sparkSession.createDataFrame([tuple(float(places[c][1] - 1) for c in used)], ", ".join(f"{i} double" for i in ins))
    encoder = OneHotEncoder(inputCols=ins, outputCols=vectors, handleInvalid="keep", dropLast=True).fit(sizes)
    return VectorAssembler(inputCols=vectors, outputCol=out).transform(encoder.transform(df)).drop("__active", *ins, *vectors)


def feature_matrix(df: DataFrame, categories: dict[str, list[str]], groups: list[str], drop: list[str],
                   keep: list[str], ref: DataFrame | None = None) -> DataFrame:
    """Numeric groups minus ``drop`` (leakage columns), nulls → 0, plus one-hot."""
    base = with_reference(df, ref) if "temporal" in groups else df
    num = feature_columns(base, groups)
    names = base.select(*num).columns  # analysis only, no job
    sel = [F.col(k) for k in keep]
    for c, n in zip(num, names):
        if n in drop:
            continue
        sel.append(F.coalesce(c.cast("double"), F.lit(0.0)).alias(n))
    sel += onehot_columns(categories)
    return base.select(*sel)
