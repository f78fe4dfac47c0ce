"""Distributed global positions, prefix sums and exact order statistics.

``row_number().over(Window.orderBy(...))`` without ``partitionBy`` moves every
row into one task. Instead:

1. range-partition by a *total* order and sort inside each partition;
2. tag each row with its partition id and in-partition index;
3. count rows per partition (a table with one row per partition);
4. turn the counts into start offsets (window over that tiny table) and
   broadcast-join them back: ``pos = offset[pid] + index + 1``.

The sorted frame is persisted so the counting pass and the numbering pass see
the same partitions; recomputation after a lost executor is deterministic
because the order is total (ties broken by key columns).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upkeep.functions.columns import col_

_PID, _MID, _OFF, _IDX = "__pid", "__mid", "__off", "__idx"


def _nparts(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _sorted_tagged(df: DataFrame, order: list[Column], num_partitions: int | None) -> DataFrame:
    n = _nparts(df, num_partitions)
    s = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    s = s.withColumn(_PID, F.spark_partition_id()).withColumn(_MID, F.monotonically_increasing_id())
    # monotonically_increasing_id = (partition index << 33) + index in partition
    s = s.withColumn(_IDX, F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)).drop(_MID)
    return s.persist(StorageLevel.MEMORY_AND_DISK)


def _offsets(tagged: DataFrame, value_cols: dict[str, Column]) -> DataFrame:
    """One row per partition: exclusive prefix totals of counts / values."""
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.sum(v).alias(f"__t_{k}") for k, v in value_cols.items()]
    per = tagged.groupBy(_PID).agg(*aggs)
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)  # ≤ #partitions rows
    out = per.select(
        _PID,
        F.coalesce(F.sum("__n").over(w), F.lit(0)).alias(_OFF),
        *[F.coalesce(F.sum(f"__t_{k}").over(w), F.lit(0)).alias(f"__o_{k}") for k in value_cols],
    )
    return out


def global_position(df: DataFrame, order: list[str | Column], out: str = "pos",
                    num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based position under a total ``order`` without a single-task window."""
    order_c = [col_(c) for c in order]
    tagged = _sorted_tagged(df, order_c, num_partitions)
    offs = _offsets(tagged, {})
    res = tagged.join(F.broadcast(offs), _PID).withColumn(out, F.col(_OFF) + F.col(_IDX) + F.lit(1))
    return res.drop(_PID, _IDX, _OFF)


def prefix_sums(df: DataFrame, order: list[str | Column], sums: dict[str, str | Column],
                group_cols: list[str] | None = None, pos: str = "pos",
                num_partitions: int | None = None) -> DataFrame:
    """Running (inclusive) sums ``cum_<k>`` of ``sums`` in ``order``; with
    ``group_cols`` the order is (group, order) and sums restart per group.

    Within a range partition the running sum is a window over the partition
    id (rows of one partition stay one window partition); across partitions
    the broadcast offsets add the totals of all earlier partitions.
    """
    group_cols = group_cols or []
    order_c = [F.col(g) for g in group_cols] + [col_(c) for c in order]
    vals = {k: col_(v) for k, v in sums.items()}
    base = df
    for k, v in vals.items():
        base = base.withColumn(f"__v_{k}", v)
    vcols = {k: F.col(f"__v_{k}") for k in vals}
    tagged = _sorted_tagged(base, order_c, num_partitions)
    offs = _offsets(tagged, vcols)
    run_w = Window.partitionBy(_PID).orderBy(_IDX).rowsBetween(Window.unboundedPreceding, 0)
    res = tagged.join(F.broadcast(offs), _PID).withColumn(pos, F.col(_OFF) + F.col(_IDX) + F.lit(1))
    for k in vals:
        res = res.withColumn(f"cum_{k}", F.col(f"__o_{k}") + F.sum(f"__v_{k}").over(run_w))
    if group_cols:
        # subtract the running totals in front of each group's first row
        firsts = res.groupBy(*group_cols).agg(
            *[F.min_by(F.col(f"cum_{k}") - F.col(f"__v_{k}"), F.col(pos)).alias(f"__b_{k}") for k in vals],
            F.min(pos).alias("__p0"),
        )
        # null-safe: rows of the NULL group are a group like any other
        firsts = firsts.select(*[F.col(c).alias(f"__g_{c}") for c in group_cols], *[f"__b_{k}" for k in vals], "__p0")
        same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in group_cols])
        res = res.join(firsts, same).drop(*[f"__g_{c}" for c in group_cols])
        for k in vals:
            res = res.withColumn(f"cum_{k}", F.col(f"cum_{k}") - F.col(f"__b_{k}"))
        res = res.withColumn(pos, F.col(pos) - F.col("__p0") + 1)
        res = res.drop(*[f"__b_{k}" for k in vals], "__p0")
    drop = [_PID, _IDX, _OFF] + [f"__o_{k}" for k in vals] + [f"__v_{k}" for k in vals]
    return res.drop(*drop)


def group_positions(df: DataFrame, group_cols: list[str], order: list[str | Column], out: str = "pos",
                    num_partitions: int | None = None) -> DataFrame:
    """1-based position within each group (skew-safe: a hot group spans many
    range partitions instead of one task)."""
    res = prefix_sums(df, order, {"__one": F.lit(1)}, group_cols, pos=out, num_partitions=num_partitions)
    return res.drop("cum___one")


ACCURACY = 10_000
MARGINS = (4.0 / ACCURACY, 0.02, 0.2)
HELD = 100_000


def exact_percentiles(df: DataFrame, columns: list[str], probs: list[float],
                      names: list[list[str]]) -> DataFrame:
    """One-row local frame of exact, linearly interpolated percentiles (the rule
    of ``percentile``: h = (n-1)·p, value = a + (h - floor h)·(b - a)) for several
    columns at once; ``names[i][j]`` = column ``i`` at ``probs[j]``. NULLs are
    ignored; an all-NULL column gives NULL. Runs when called:

    1. one aggregation: counts, extremes and a mergeable quantile sketch of every
       column, which brackets each wanted order statistic between two values;
    2. one counting pass: the values inside a bracket by value (map-side
       combined, so a hot value is one row), and how many lie below it.

    A few thousandths of the values lie in a bracket. Up to ``HELD`` distinct ones
    are picked from directly; more are range-sorted (they alone), and the order
    statistic is found from running counts. A bracket that misses its order
    statistic is widened, in the end to the extremes.
    """
    cols = [F.col(c).cast("double") for c in columns]
    asked = sorted({min(1.0, max(0.0, p + s * m)) for p in probs for m in MARGINS for s in (-1, 1)})
    aggs = [a for i, c in enumerate(cols) for a in (
        F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.percentile_approx(c, asked, ACCURACY).alias(f"q{i}"))]
    fit = df.agg(*aggs).first()
    wanted: dict[int, tuple[int, float]] = {}
    for i in range(len(cols)):
        for j, p in enumerate(probs):
            if fit[f"n{i}"]:
                wanted[i * len(probs) + j] = i, (fit[f"n{i}"] - 1) * float(p)
    found: dict[int, tuple[float, float]] = {}
    for level in range(len(MARGINS) + 1):
        brackets = {}
        for t, (i, _h) in wanted.items():
            if t in found:
                continue
            p, n = float(probs[t % len(probs)]), fit[f"n{i}"]
            least = sum(m < 2.0 / n for m in MARGINS)  # few rows: no narrower than two of them
            wide = MARGINS[least + level] if least + level < len(MARGINS) else None
            at = dict(zip(asked, fit[f"q{i}"], strict=True))
            ends = (fit[f"lo{i}"], fit[f"hi{i}"]) if wide is None else (at[max(0.0, p - wide)], at[min(1.0, p + wide)])
            brackets[t] = cols[i], *ends
        if not brackets:
            break
        ranks = {t: (math.floor(wanted[t][1]), math.ceil(wanted[t][1])) for t in brackets}
        found |= _bracketed(df, brackets, ranks)
    row = []
    for i in range(len(cols)):
        for j in range(len(probs)):
            t = i * len(probs) + j
            if t not in wanted:
                row.append(None)
                continue
            h, (a, b) = wanted[t][1], found[t]
            row.append(a if math.floor(h) == math.ceil(h) else (math.ceil(h) - h) * a + (h - math.floor(h)) * b)
    schema = T.StructType([T.StructField(names[i][j], T.DoubleType()) for i in range(len(cols)) for j in range(len(probs))])
    return df.sparkSession.createDataFrame([tuple(row)], schema)


def _bracketed(df: DataFrame, brackets: dict[int, tuple[Column, float, float]],
               ranks: dict[int, tuple[int, int]]) -> dict[int, tuple[float, float]]:
    """The values at two ranks (from 0) of each target whose bracket (column, low,
    high) holds both; a target that its bracket misses is left out."""
    cells = [F.when(c <= F.lit(hi), F.struct(F.lit(t).alias("__c"), F.when(c >= F.lit(lo), c).alias("__v"))) for t, (c, lo, hi) in brackets.items()]
    long = df.select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("__r")).select("__r.*")
    per = long.groupBy("__c", "__v").agg(F.count(F.lit(1)).alias("__k"))  # a NULL value: what lies below the bracket
    return _picked(per, ranks)


def _in_order(value) -> tuple:
    """A sort key of collected values as Spark orders them: NULL first, NaN last, structs field by field."""
    if isinstance(value, tuple):
        return True, False, tuple(_in_order(v) for v in value)
    nan = isinstance(value, float) and math.isnan(value)
    return value is not None, nan, None if nan else value


def _picked(per: DataFrame, ranks: dict[int, tuple[int, int]], times: dict[int, int] | None = None) -> dict[int, tuple]:
    """From (target, value, count): the values at two ranks (from 0) of each target; a
    target one of whose ranks falls on NULL or beyond the last value is left out.
    ``times`` receives the count of the value at the second rank."""
    times = {} if times is None else times
    rows = per.limit(HELD + 1).collect()
    if len(rows) > HELD:
        picked = _selected(per, ranks, times)
    else:
        picked = {}
        for r in sorted(rows, key=lambda r: (r["__c"], _in_order(r["__v"]))):
            t, before = r["__c"], picked.get(r["__c"], (0, [None, None]))
            for x, rank in enumerate(ranks[t]):
                if before[0] <= rank < before[0] + r["__k"]:
                    before[1][x], times[t] = r["__v"], r["__k"]
            picked[t] = before[0] + r["__k"], before[1]
        picked = {t: tuple(v) for t, (_n, v) in picked.items()}
    return {t: v for t, v in picked.items() if None not in v}


def _selected(per: DataFrame, ranks: dict[int, tuple[int, int]], times: dict[int, int]) -> dict[int, tuple]:
    """The same from a table (target, value, count) of any size: sorted by range,
    running counts only in the partitions that hold a wanted rank."""
    tagged = _sorted_tagged(per, [F.col("__c"), F.col("__v")], None)
    # totals per (partition, target): position p of target c is start_c + p of the whole table
    cells_t = tagged.groupBy(_PID, "__c").agg(F.sum("__k").alias("__pk"))
    starts, total = {}, 0
    for r in sorted(cells_t.groupBy("__c").agg(F.sum("__pk").alias("__n")).collect(), key=lambda r: r["__c"]):  # a row per target
        starts[r["__c"]], total = total, total + r["__n"]
    goals = sorted({(t, x, starts[t] + rank + 1) for t, pair in ranks.items() if t in starts for x, rank in enumerate(pair)})
    goal = per.sparkSession.createDataFrame(goals, "__t int, __x int, __g long")
    parts = cells_t.groupBy(_PID).agg(F.sum("__pk").alias("__pk"))
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = parts.select(_PID, F.coalesce(F.sum("__pk").over(before), F.lit(0)).alias("__ps"), "__pk")
    holds = parts.join(F.broadcast(goal), (F.col("__g") > F.col("__ps")) & (F.col("__g") <= F.col("__ps") + F.col("__pk")))
    holds = holds.select(_PID, "__ps").distinct()
    run_w = Window.partitionBy(_PID).orderBy(_IDX).rowsBetween(Window.unboundedPreceding, 0)
    rows = tagged.join(F.broadcast(holds), _PID).select("__c", "__v", "__k", (F.col("__ps") + F.sum("__k").over(run_w)).alias("__e"))
    hit = rows.join(F.broadcast(goal), (F.col("__c") == F.col("__t")) & (F.col("__g") > F.col("__e") - F.col("__k")) & (F.col("__g") <= F.col("__e")))
    out: dict[int, list] = {t: [None, None] for t in ranks}
    for r in hit.select("__t", "__x", "__v", "__k").orderBy("__t", "__x").collect():  # two rows a target
        out[r["__t"]][r["__x"]], times[r["__t"]] = r["__v"], r["__k"]
    tagged.unpersist()
    return {t: tuple(v) for t, v in out.items()}


CUT_MARGIN = 6.0 / ACCURACY


def sort_long(df: DataFrame, name: str) -> Column | None:
    """A long that orders rows as the column does (ties aside), or None if its type gives none."""
    kind, c = df.select(F.col(f"`{name}`")).dtypes[0][1], F.col(f"`{name}`")
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "date":
        return F.unix_date(c).cast("long")
    return c.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else None


def cut_values(df: DataFrame, group: Column, lead: Column | None, order: Column,
               cuts: Callable[[int], list[int]], shares: list[float], most: int,
               ties: Column | None = None) -> tuple[list[tuple], Column] | None:
    """[(group value, [the ``order`` value of the row at each cut, None for cut 0])] for
    the positions (from 1) that ``cuts`` names for a group of n rows, and the order that
    these values belong to: ``order``, or ``order`` and ``ties`` where other rows equal
    the one at a cut. None if there are more than ``most`` groups.

    Distributed selection on the order alone. ``lead``, a long that never falls along
    ``order``, is sketched per group (one aggregation); a cut lies near ``shares`` of
    the group, so the sketch brackets it. One counting pass then gives the order values
    inside the brackets, a thousandth of the rows, and how many lie below. A bracket
    that misses its cut is widened to the whole group; without a lead all are.
    """
    low = F.lit(-(1 << 63)).cast("long")
    keyed = df.select(group.alias("__g"), (low if lead is None else F.coalesce(lead, low)).alias("__l"), order.alias("__o"))
    asked = sorted({min(1.0, max(0.0, s + m)) for s in shares for m in (-CUT_MARGIN, CUT_MARGIN)})
    fit = keyed.groupBy("__g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("__l", asked, ACCURACY).alias("q")).limit(most + 1).collect()
    if len(fit) > most:
        return None
    wanted = {}  # target: (group's row, bracket or None, rank from 0)
    for g in fit:
        at = dict(zip(asked, g["q"], strict=True))
        for j, (pos, s) in enumerate(zip(cuts(g["n"]), shares, strict=True)):
            if pos > 0:
                ends = at[max(0.0, s - CUT_MARGIN)], at[min(1.0, s + CUT_MARGIN)]
                wanted[fit.index(g) * len(shares) + j] = g, ends if lead is not None and g["n"] > ACCURACY else None, pos - 1
    found: dict[int, tuple] = {}
    times: dict[int, int] = {}
    for whole in (False, True):
        cells = []
        for t, (g, ends, _rank) in wanted.items():
            if t in found:
                continue
            own, value = F.col("__g").eqNullSafe(F.lit(g["__g"])), F.col("__o")
            if ends and not whole:
                own, value = own & (F.col("__l") <= ends[1]), F.when(F.col("__l") >= ends[0], value)
            cells.append(F.when(own, F.struct(F.lit(t).alias("__c"), value.alias("__v"))))
        if not cells:
            break
        long = keyed.select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("__r")).select("__r.*")
        per = long.groupBy("__c", "__v").agg(F.count(F.lit(1)).alias("__k"))
        found |= _picked(per, {t: (rank, rank) for t, (_g, _ends, rank) in wanted.items() if t not in found}, times)
    if ties is not None and any(times[t] > 1 for t in found):
        return cut_values(df, group, lead, F.struct(order.alias("__o"), ties.alias("__h")), cuts, shares, most)
    keys = [[found.get(i * len(shares) + j, (None,))[0] for j in range(len(shares))] for i in range(len(fit))]
    return [(g["__g"], k) for g, k in zip(fit, keys, strict=True)], order


def fitted_row(df: DataFrame) -> DataFrame:
    """Run a one-row fit (thresholds, median, fences) now and return it as a
    local one-row frame. Plans that apply it stay small instead of carrying
    the fit's subplan into every branch that uses it; the fit itself stays
    distributed."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one fitted row, got {len(rows)}")
    return df.sparkSession.createDataFrame(rows, df.schema)


def exact_quantiles(df: DataFrame, col: str, probs: list[float], names: list[str]) -> DataFrame:
    """One column: ``exact_percentiles`` with output names ``names``."""
    return exact_percentiles(df, [col], probs, [names])
