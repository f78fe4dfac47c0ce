"""Per-machine, past-only window features.

All operators share one window spec ``partitionBy(machine).orderBy(time, key)``
so Spark sorts each machine's rows once for the whole feature set, and all
frames are row-bounded, so a very long machine history never becomes one
unbounded buffer. The EWMA works on blocks of time, so one machine's history may
be spread over many tasks. No-ops when the key, time or sensor columns are absent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upkeep.schema import DEFAULT_EWMA_SPAN, DEFAULT_LAGS, DEFAULT_ROLLING, SENSOR_FIELDS
from upkeep.session import cut_lineage


def machine_window(group_col: str = "machine_id", time_col: str = "timestamp", key_cols: list[str] | None = None):
    """The shared spec; ``key_cols`` break timestamp ties so order is total."""
    order = [F.col(time_col)] + [F.col(k) for k in (key_cols or [])]
    return Window.partitionBy(group_col).orderBy(*order)


def _sensors(df: DataFrame, sensors: list[str] | None) -> list[str]:
    return sensors or [c for c in SENSOR_FIELDS if c in df.columns]


def _applicable(df: DataFrame, group_col: str, time_col: str) -> bool:
    return group_col in df.columns and time_col in df.columns


def lag_rolling_columns(df: DataFrame, sensors: list[str] | None = None, lags: list[int] | None = None, windows: list[int] | None = None,
                        group_col: str = "machine_id", time_col: str = "timestamp", key_cols: list[str] | None = None) -> list[Column]:
    """W1-W3 as columns: ``<s>_lag_<k>``, ``<s>_rolling_mean_<w>``, ``<s>_rolling_std_<w>``
    (mean of non-null values in the last w rows; sample std, one value → NULL)."""
    sensors = _sensors(df, sensors)
    if not _applicable(df, group_col, time_col) or not sensors:
        return []
    lags = DEFAULT_LAGS if lags is None else lags
    windows = DEFAULT_ROLLING if windows is None else windows
    w = machine_window(group_col, time_col, key_cols)
    cols: list[Column] = []
    for s in sensors:
        x = F.col(s).cast("double")
        cols += [F.lag(x, k).over(w).alias(f"{s}_lag_{k}") for k in lags]
        for n in windows:
            frame = w.rowsBetween(-(n - 1), 0)
            cols.append(F.avg(x).over(frame).alias(f"{s}_rolling_mean_{n}"))
            cols.append(F.stddev_samp(x).over(frame).alias(f"{s}_rolling_std_{n}"))
    return cols


def lag_rolling(df: DataFrame, sensors: list[str] | None = None, lags: list[int] | None = None,
                windows: list[int] | None = None, group_col: str = "machine_id", time_col: str = "timestamp",
                key_cols: list[str] | None = None) -> DataFrame:
    """``df`` with ``lag_rolling_columns``."""
    return df.select("*", *lag_rolling_columns(df, sensors, lags, windows, group_col, time_col, key_cols))


def _scan(gain: np.ndarray, add: np.ndarray) -> np.ndarray:
    """y[k] = gain[k] * y[k - 1] + add[k] with y[-1] = 0, as a prefix scan of affine
    maps: each doubling composes a map with the one ``step`` places before it."""
    gain, add = gain.copy(), add.copy()
    step = 1
    while step < len(add):
        add[step:] += gain[step:] * add[:-step]
        gain[step:] = gain[step:] * gain[:-step]
        step *= 2
    return add


def _smoothed(values: np.ndarray, first: np.ndarray, alpha: float, entry: tuple[float | None, int]) -> tuple[np.ndarray, tuple[float | None, int]]:
    """EWMA of consecutive rows (NaN: missing; ``first`` marks a machine's first row)
    and the state after the last one. A state is the last value y, None before any,
    and the rows since the last one that had a value."""
    n = len(values)
    y_in, gap_in = entry
    out = np.full(n, np.nan)
    rows = np.arange(n)
    at = np.flatnonzero(~np.isnan(values))
    start = np.maximum.accumulate(np.where(first, rows, -1))  # the machine's first row here, -1: it came before
    if len(at):
        before = np.concatenate([[-1], at[:-1]])
        opens = (before < 0) | (before < start[at])  # no earlier value of this machine in these rows
        carried = opens & (start[at] < 0) & (y_in is not None)
        gap = np.where(carried, at + 1 + gap_in, at - before)
        old = (1.0 - alpha) ** gap
        gain = np.where(opens & ~carried, 0.0, old / (old + alpha))
        add = (1.0 - gain) * values[at]
        if carried[0]:
            add[0] += gain[0] * y_in
            gain[0] = 0.0
        smooth = _scan(gain, add)
        last = np.searchsorted(at, rows, "right") - 1  # the last value up to each row
        has = (last >= 0) & (np.where(last >= 0, at[np.maximum(last, 0)], -1) >= start)
        out[has] = smooth[last[has]]
    if y_in is not None:
        waits = (start < 0) & np.isnan(out)
        out[waits] = y_in
    if not n:
        return out, entry
    end = start[-1]
    own = at[at >= end] if end >= 0 else at
    if len(own):
        return out, (float(out[-1]), int(n - 1 - own[-1]))
    return out, (None, 0) if end >= 0 else (y_in, gap_in + n)


def ewma(df: DataFrame, sensors: list[str], span: int, group_col: str, time_col: str, key_cols: list[str] | None = None) -> DataFrame:
    """``<s>_ewma_<span>`` by the exact recursion (adjust=False; a missing value
    lets the old weight decay): the first value starts y with weight 1; each later
    row multiplies the weight by 1 - alpha; a value v sets y = (ow*y + alpha*v) /
    (ow + alpha) and the weight to 1; before the first value it is NULL.

    From one value to the next y goes through an affine map, so maps can be put
    together in any grouping. Rows are sorted by ranges of (machine, time), which cut
    a long history into blocks on many tasks. A first pass gives, for the machine
    that a block ends with, what the block does to a state that comes in: at most one
    row a block, put together in order here. A second pass starts every block with
    the state it gets. Runs its first pass when called."""
    alpha = 2.0 / (span + 1.0)
    order = [group_col, time_col, *(key_cols or [])]
    wide = df.select("*", *[F.col(s).cast("double").alias(f"__x{k}") for k, s in enumerate(sensors)])
    ordered = cut_lineage(wide.repartitionByRange(*order).sortWithinPartitions(*order))  # both passes see the same blocks
    n, place = len(df.columns), df.columns.index(group_col)
    xs = [f"__x{k}" for k in range(len(sensors))]

    def machines(column: pa.Array, previous: tuple | None) -> tuple[np.ndarray, tuple | None]:
        """Marks of rows whose machine differs from the row before."""
        coded = column.dictionary_encode()
        code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        first = np.concatenate([[True], code[1:] != code[:-1]])
        if previous is not None and len(code):
            first[0] = column[0].as_py() != previous[0]
        return first, (column[-1].as_py(),) if len(code) else previous

    def values(batch: pa.RecordBatch, k: int) -> np.ndarray:
        return batch.column(n + k).fill_null(np.nan).to_numpy(zero_copy_only=False)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per sensor of the machine at the block's end: rows, rows before its first
        value, that value, and y at the end for 0 and for 1 as y at the first value."""
        previous, whole, seen = None, True, 0
        state: list[dict] = [{} for _ in xs]
        head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            first, previous_next = machines(batch.column(place), previous)
            if previous is None:
                first[0] = False
                head = batch.column(place)[0].as_py()
            cut = np.flatnonzero(first)
            lo = int(cut[-1]) if len(cut) else 0
            if len(cut):
                whole, seen, state = False, 0, [{} for _ in xs]
            for k in range(len(xs)):
                own = values(batch, k)[lo:]
                at = np.flatnonzero(~np.isnan(own))
                s = state[k]
                marks = np.zeros(len(own), bool)
                if "v" not in s and len(at):
                    s.update(lead=seen + int(at[0]), v=float(own[at[0]]))
                    own, s["zero"], s["one"] = own[at[0] + 1:], (0.0, 0), (1.0, 0)
                    marks = marks[at[0] + 1:]
                if "v" in s:
                    s["zero"], s["one"] = (_smoothed(own, marks, alpha, s[x])[1] for x in ("zero", "one"))
            seen += batch.num_rows - lo
            previous = previous_next
        if previous is not None:
            for k, s in enumerate(state):
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "sensor": pa.array([k], pa.int32()),
                    "same": [_key(head) == _key(previous[0]) and whole], "head": [_key(head)], "machine": [_key(previous[0])], "rows": pa.array([seen], pa.int64()),
                    "lead": pa.array([s.get("lead")], pa.int64()), "v": pa.array([s.get("v")], pa.float64()),
                    "zero": pa.array([s["zero"][0] if s else None], pa.float64()), "one": pa.array([s["one"][0] if s else None], pa.float64()),
                    "trail": pa.array([s["zero"][1] if s else None], pa.int64())})

    found = ordered.mapInArrow(summaries, "part int, sensor int, same boolean, head string, machine string, rows long, lead long, v double, "
                                          "zero double, one double, trail long").collect()  # a row per block and sensor
    entries: dict[tuple[int, int], tuple[float | None, int]] = {}
    for k in range(len(xs)):
        carried, machine = (None, 0), None
        for r in sorted((r for r in found if r["sensor"] == k), key=lambda r: r["part"]):
            if machine is not None and r["head"] == machine[0]:
                entries[r["part"], k] = carried
            y, gap = carried if machine is not None and r["same"] and r["head"] == machine[0] else (None, 0)
            if r["v"] is None:
                carried = (y, gap + r["rows"]) if y is not None else (None, 0)
            else:
                start = r["v"]
                if y is not None:
                    old = (1.0 - alpha) ** (gap + r["lead"] + 1)
                    start = (old * y + alpha * start) / (old + alpha)
                carried = r["zero"] + (r["one"] - r["zero"]) * start, r["trail"]
            machine = (r["machine"],)

    names = [f"{s}_ewma_{span}" for s in sensors]
    all_names = [*df.columns, *names]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        state = [entries.get((part, k), (None, 0)) for k in range(len(xs))]
        previous = None
        for batch in batches:
            if not batch.num_rows:
                continue
            first, previous_next = machines(batch.column(place), previous)
            if previous is None and any((part, k) in entries for k in range(len(xs))):
                first[0] = False
            previous = previous_next
            out = []
            for k in range(len(xs)):
                y, state[k] = _smoothed(values(batch, k), first, alpha, state[k])
                out.append(pa.array(y, pa.float64(), mask=np.isnan(y)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *out], all_names)

    schema = T.StructType(df.schema.fields + [T.StructField(x, T.DoubleType()) for x in names])
    return ordered.mapInArrow(apply, schema)


def _key(machine: object) -> str:
    """A machine as text for comparison between blocks; NULL is one of its own."""
    return "n" if machine is None else f"v{machine!r}"


def trend(df: DataFrame, sensors: list[str] | None = None, span: int = DEFAULT_EWMA_SPAN,
          group_col: str = "machine_id", time_col: str = "timestamp", key_cols: list[str] | None = None,
          parts: tuple[str, ...] = ("diff", "pct_change", "ewma")) -> DataFrame:
    """``<s>_diff_1``, ``<s>_pct_change_1`` (forward-filled first; a zero
    base gives NULL instead of ±inf), ``<s>_ewma_<span>``; only the asked ``parts``."""
    sensors = _sensors(df, sensors)
    if unknown := set(parts) - {"diff", "pct_change", "ewma"}:
        raise ValueError(f"Unknown trend part(s): {unknown}")
    if not _applicable(df, group_col, time_col) or not sensors:
        return df
    w = machine_window(group_col, time_col, key_cols)
    running = w.rowsBetween(Window.unboundedPreceding, 0)  # streamed running frame, O(1) state
    res = df
    if "pct_change" in parts:
        for s in sensors:
            res = res.withColumn(f"__ff_{s}", F.last(F.col(s).cast("double"), ignorenulls=True).over(running))
    out = []
    for s in sensors:
        x, ff = F.col(s).cast("double"), F.col(f"__ff_{s}")
        if "diff" in parts:
            out.append((x - F.lag(x, 1).over(w)).alias(f"{s}_diff_1"))
        if "pct_change" in parts:
            out.append((F.try_divide(ff, F.lag(ff, 1).over(w)) - 1).alias(f"{s}_pct_change_1"))
    res = res.select("*", *out).drop(*[f"__ff_{s}" for s in sensors])
    return ewma(res, sensors, span, group_col, time_col, key_cols) if "ewma" in parts else res


def sequence_windows(df: DataFrame, sensors: list[str], length: int, label_col: str,
                     group_col: str = "machine_id", time_col: str = "timestamp",
                     key_cols: list[str] | None = None) -> DataFrame:
    """One window of exactly ``length`` rows ending at each row (the first
    length-1 rows of a machine have none); label = label of the end row.
    ``seq`` is ``array<struct<sensors>>`` in time order."""
    w = machine_window(group_col, time_col, key_cols)
    frame = w.rowsBetween(-(length - 1), 0)
    seq = F.collect_list(F.struct(*[F.col(s).cast("double").alias(s) for s in sensors])).over(frame)
    return (
        df.select("*", seq.alias("seq"), F.row_number().over(w).alias("__rn"))
        .where(F.col("__rn") >= length)
        .select(group_col, time_col, *(key_cols or []), "seq", F.col(label_col).alias("label"))
    )
