"""Train / validation / test splits (D1-D4) and the provisional stratum.

All cuts are exact counts: the rows at the cuts are selected on the order alone
(``positions.cut_values``); randomness is ``md5('<seed>:<key>')`` so the split is
reproducible across runs, engines and executor failures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upkeep.functions.columns import md5_order
from upkeep.operators.positions import cut_values, exact_quantiles, fitted_row, group_positions, sort_long

STRATA = 64


def _check(train: float, val: float, test: float) -> None:
    if abs((train + val + test) - 1.0) > 1e-6:
        raise ValueError("train_ratio + val_ratio + test_ratio must sum to 1.0")


def provisional_label(scored: DataFrame, score_col: str = "priority_score", out: str = "provisional") -> DataFrame:
    """1 when the score is above the median (stratification only)."""
    med = fitted_row(exact_quantiles(scored, score_col, [0.5], ["__median"]))
    return (
        scored.crossJoin(F.broadcast(med))
        .withColumn(out, (F.col(score_col) > F.col("__median")).cast("int"))
        .drop("__median")
    )


def _cuts(n: int, train: float, val: float) -> list[int]:
    """Last positions of ``train`` (floor(n·train)) and ``val`` (floor(n·val) more)."""
    n_train = math.floor(n * train)
    return [n_train, n_train + math.floor(n * val)]


def _two_stage_cuts(n: int, train: float, val: float, test: float) -> list[int]:
    """The same where ``val`` is floor of its share of what ``train`` leaves."""
    n_train = math.floor(n * train)
    return [n_train, n_train + math.floor((n - n_train) * (val / (val + test)))]


def _order(df: DataFrame, names: list[str], first: Column | None = None) -> Column:
    """The order of rows as one struct (NULLs first), timestamps and dates as longs."""
    fields = [] if first is None else [first.alias("__f")]
    for i, name in enumerate(names):
        long = sort_long(df, name)
        fields.append((F.col(f"`{name}`") if long is None else long).alias(f"__k{i}"))
    return F.struct(*fields)


def _md5_lead(hashed: Column) -> Column:
    """60 bits, in the order of the text."""
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")


def _ties(df: DataFrame) -> Column:
    return F.xxhash64(*(F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and t != "variant"))


def _labelled_by_cuts(df: DataFrame, out: str, group: Column, cuts: tuple[list[tuple], Column]) -> DataFrame:
    """``out`` from comparing each row's order with its group's two cuts: a map over
    the rows, with the cuts (a row of at most ``STRATA`` entries) sent to every task."""
    found, order = cuts
    kind = df.select(order).schema[0].dataType
    entry = T.StructType([T.StructField("g", df.select(group).schema[0].dataType), T.StructField("train", kind), T.StructField("val", kind)])
    table = df.sparkSession.createDataFrame([([(g, *keys) for g, keys in found],)], T.StructType([T.StructField("__cuts", T.ArrayType(entry))]))
    own = F.get(F.filter("__cuts", lambda c: c["g"].eqNullSafe(group)), F.lit(0))

    def until(name: str) -> Column:
        return own[name].isNotNull() & (order <= own[name])

    label = F.when(until("train"), F.lit("train")).when(until("val"), F.lit("val")).otherwise(F.lit("test"))
    return df.crossJoin(F.broadcast(table)).withColumn(out, label).drop("__cuts")


def split_chronological(df: DataFrame, time_col: str = "timestamp", key_cols: list[str] | None = None,
                        train: float = 0.70, val: float = 0.15, test: float = 0.15, out: str = "split") -> DataFrame:
    """Global time order (ties broken by ``key_cols``, then by a hash of the row), exact
    cut points; only rows equal in every column go together. The cut rows are selected
    on time and keys alone, the rows are then labelled where they are."""
    _check(train, val, test)
    order = _order(df, [time_col] + (key_cols or []))
    cuts = cut_values(df, F.lit(0), sort_long(df, time_col), order, lambda n: _cuts(n, train, val), [train, train + val], 1, _ties(df))
    return _labelled_by_cuts(df, out, F.lit(0), cuts)


def _two_stage(pos, n, train: float, val: float, test: float) -> F.Column:
    n_train = F.floor(n * F.lit(train))
    rel_val = val / (val + test)
    n_val = F.floor((n - n_train) * F.lit(rel_val))
    return (
        F.when(pos <= n_train, F.lit("train"))
        .when(pos <= n_train + n_val, F.lit("val"))
        .otherwise(F.lit("test"))
    )


def split_stratified(df: DataFrame, stratum_col: str, key_col: str, train: float = 0.70, val: float = 0.15,
                     test: float = 0.15, seed: int = 42, out: str = "split") -> DataFrame:
    """Per stratum: pseudo-random order by md5, train = floor(n·train), then
    val = floor(rest·val/(val+test)), rest test. Class ratio kept per split; rows
    without a stratum are a stratum of their own; a key's rows lie together, but for
    those at a cut, which a hash of the row orders.

    Up to ``STRATA`` strata: the cut rows are selected on hash and key alone, the rows
    are labelled where they are. Beyond, positions come from a range sort of the rows.
    """
    _check(train, val, test)
    stratum, hashed = F.col(f"`{stratum_col}`"), md5_order(seed, F.col(f"`{key_col}`"))
    order = _order(df, [key_col], hashed)
    cuts = cut_values(df, stratum, _md5_lead(hashed), order, lambda n: _two_stage_cuts(n, train, val, test), [train, train + val], STRATA, _ties(df))
    if cuts is not None:
        return _labelled_by_cuts(df, out, stratum, cuts)
    keyed = df.withColumn("__h", hashed)
    positioned = group_positions(keyed, [stratum_col], [F.col("__h"), F.col(f"`{key_col}`")], out="__pos")
    sizes = df.groupBy(stratum.alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    return (
        positioned.join(sizes, F.col(f"`{stratum_col}`").eqNullSafe(F.col("__s"))).drop("__s")
        .withColumn(out, _two_stage(F.col("__pos"), F.col("__n"), train, val, test))
        .drop("__pos", "__n", "__h")
    )


def split_holdout(df: DataFrame, machine_col: str = "machine_id", train: float = 0.70, val: float = 0.15,
                  test: float = 0.15, seed: int = 42, out: str = "split") -> DataFrame:
    """Every row of a machine lands in one split; ratios apply to machines. Rows
    without a machine can leak into no other machine's split: they train.

    The cuts are selected among the distinct machines; each row is then labelled from
    its own machine's hash, so rows are neither joined nor moved."""
    _check(train, val, test)
    machine = F.col(f"`{machine_col}`")
    hashed = md5_order(seed, machine)
    machines = df.select(machine).where(machine.isNotNull()).distinct()
    cuts = cut_values(machines, F.lit(0), _md5_lead(hashed), _order(df, [machine_col], hashed),
                      lambda n: _two_stage_cuts(n, train, val, test), [train, train + val], 1)
    found = _labelled_by_cuts(df, out, F.lit(0), cuts)
    return found.withColumn(out, F.when(machine.isNull(), F.lit("train")).otherwise(F.col(out)))


def split_balance(df: DataFrame, split_col: str = "split", label_col: str = "label") -> DataFrame:
    return df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(F.col(label_col).cast("double")), 6).alias("positive_rate"),
    )
