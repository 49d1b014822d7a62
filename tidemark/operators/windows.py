"""Windows over the rows of a series.

A series has key columns and a dense integer order (frame). Windows of bounded reach are computed in chunks
of CHUNK frames, each with the rows of its neighbours that it reaches (its halo), so a series of any length
is spread over tasks; cumulative windows hold a whole series in one task's sort.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1 << 16


def with_halo(df: DataFrame, order: str, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """df with the columns _chunk and _own; rows within reach of a neighbouring chunk are there for it too."""
    if max(before, after) > chunk:
        raise ValueError("a window may not reach further than a chunk")
    k = F.floor(F.col(order) / chunk).cast("long")
    place = F.pmod(F.col(order), F.lit(chunk))
    chunks = F.array_compact(F.array(k, F.when(place >= chunk - before, k + 1), F.when(place < after, k - 1)))
    return df.withColumn("_home", k).withColumn("_chunk", F.explode(chunks)).withColumn("_own", F.col("_chunk") == F.col("_home")).drop("_home")


def framed(df: DataFrame, keys: list[str], order: str, before: int, after: int, columns: dict, chunk: int = CHUNK) -> DataFrame:
    """df with columns: name -> function of a window over the rows from `before` to `after` around each."""
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    rows = w.rowsBetween(-before, after)
    out = with_halo(df, order, before, after, chunk)
    out = out.select("*", *(f(rows, w).alias(name) for name, f in columns.items()))
    return out.where("_own").drop("_own", "_chunk")


def edge_padded(df: DataFrame, keys: list[str], order: str, reach: int, values: list[str]) -> DataFrame:
    """keys, order and values of df, with each series' end rows repeated `reach` times beyond its ends."""
    slim = df.select(*keys, order, *values)
    row = F.struct(order, *values)
    ends = slim.groupBy(*keys).agg(F.min(row).alias("_low"), F.max(row).alias("_high"))
    steps = F.sequence(F.lit(1), F.lit(reach))
    pad = lambda end, sign: ends.select(*keys, end, F.explode(steps).alias("_step")).select(*keys, (F.col(f"{end}.{order}") + sign * F.col("_step")).cast(dict(slim.dtypes)[order]).alias(order), *(f"{end}.{v}" for v in values))
    return slim.withColumn("_real", F.lit(True)).unionByName(pad("_low", -1).union(pad("_high", 1)).withColumn("_real", F.lit(False)))


#: Values of windows that are looked at together.
SORTED = 1 << 21


def _medians(x: np.ndarray, size: int) -> np.ndarray:
    """The median of each `size` values of x, without those that are not numbers; nan where there is none."""
    rows = np.lib.stride_tricks.sliding_window_view(x, size)
    out, step = np.empty(len(rows)), max(1, SORTED // size)
    for i in range(0, len(rows), step):
        part = rows[i : i + step]
        gaps = np.isnan(part)
        if not gaps.any():
            out[i : i + step] = np.partition(part, size // 2, axis=1)[:, size // 2]
            continue
        ordered, n = np.sort(part, axis=1), size - gaps.sum(1)  # nan sorts last
        at, low, high = np.arange(len(part)), np.maximum(n - 1, 0) // 2, n // 2
        out[i : i + step] = np.where(n > 0, (ordered[at, low] + ordered[at, np.minimum(high, size - 1)]) / 2, np.nan)
    return out


def _beyond(df: DataFrame, keys: list[str], order: str, values: list[str], reach: int, chunk: int) -> DataFrame:
    """keys, order, values and _chunk: for each chunk and value the last known row before the chunk's halo and the first one after it, however far off."""
    place = F.pmod(F.col(order), F.lit(chunk))
    each = {}
    for i, v in enumerate(values):
        at = F.when(F.col(v).isNotNull(), F.col(order))
        # the last and the first of a chunk, and those that a neighbour does not have in its halo
        for n, f, by, where in (("l", F.max, F.max_by, None), ("f", F.min, F.min_by, None), ("la", F.max, F.max_by, place < chunk - reach), ("fa", F.min, F.min_by, place >= reach)):
            here = at if where is None else F.when(where, at)
            each[f"{n}{i}"] = (f(here), by(v, here))
    ends = df.withColumn("_chunk", F.floor(F.col(order) / chunk).cast("long")).groupBy(*keys, "_chunk").agg(*(c.alias(f"_{x}{n}") for n, both in each.items() for x, c in zip("av", both)))
    known = lambda n: F.when(F.col(f"_a{n}").isNotNull(), F.struct(F.col(f"_a{n}").alias("a"), F.col(f"_v{n}").alias("v")))
    up, down = Window.partitionBy(*keys).orderBy("_chunk"), Window.partitionBy(*keys).orderBy(F.col("_chunk").desc())
    found = []
    for i in range(len(values)):
        for w, n, step in ((up, "l", -1), (down, "f", 1)):
            far = lambda k: F.last(known(f"{n}{i}"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, k))  # noqa: B023, E731
            beside = F.lag("_chunk").over(w) == F.col("_chunk") + step
            found.append(F.when(beside, F.coalesce(F.lag(known(f"{n}a{i}")).over(w), far(-2))).otherwise(far(-1)).alias(f"_e{len(found)}"))
    types = dict(df.dtypes)
    rows = [F.struct(F.col(f"_e{k}.a").alias(order), *((F.col(f"_e{k}.v") if i == k // 2 else F.lit(None)).cast(types[v]).alias(v) for i, v in enumerate(values))) for k in range(len(found))]
    return ends.select(*keys, "_chunk", *found).select(*keys, "_chunk", F.explode(F.array(*rows)).alias("_e")).where(f"_e.`{order}` is not null").select(*keys, "_chunk", "_e.*")


def _on_lines(x: np.ndarray, known: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x at `at` (rising) with its gaps filled as filled() tells; nan where nothing is known."""
    have = np.flatnonzero(known)
    if len(have) == len(x) or not len(have):
        return x if len(have) else np.full(len(x), np.nan)
    b = np.searchsorted(have, np.arange(len(x)))
    a, b = have[np.maximum(b - 1, 0)], have[np.minimum(b, len(have) - 1)]
    with np.errstate(invalid="ignore", divide="ignore"):
        line = x[a] + (x[b] - x[a]) * (at - at[a]) / (at[b] - at[a])
    return np.where(known, x, np.where(at < at[have[0]], x[have[0]], np.where(at > at[have[-1]], x[have[-1]], line)))


def medians(df: DataFrame, keys: list[str], order: str, size: int, columns: dict[str, str], chunk: int = CHUNK, fill: bool = False) -> DataFrame:
    """df with columns: name -> value whose exact median of `size` (odd) rows around each it is; ends are repeated, nulls left out.

    fill: gaps are filled first, as filled() tells, from the known rows beside each chunk; of one row the median is the filled value.
    """
    half = size // 2
    slim = with_halo(df, order, half, half, chunk)
    if fill:  # rows that are neither a chunk's own nor of its halo
        slim = slim.unionByName(_beyond(df, keys, order, sorted(set(columns.values())), half, chunk), allowMissingColumns=True)
    schema = T.StructType([f for f in slim.schema if f.name not in ("_own", "_chunk")] + [T.StructField(n, T.DoubleType()) for n in columns])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        at = table[order].to_numpy()
        here = table["_own"].is_valid().to_numpy()
        every, table = table, table if here.all() else table.filter(pa.array(here))
        own = np.flatnonzero(table["_own"].to_numpy())
        if not len(own):
            table = table.slice(0, 0)
        else:
            first, last = own[0], own[-1]
            before, after = min(first, half), min(table.num_rows - 1 - last, half)  # fewer than half: the series ends there
        found = {}
        for name, value in columns.items():
            x = every[value].cast(pa.float64()).to_numpy()
            if fill:
                x = _on_lines(x, every[value].is_valid().to_numpy(), at)
            x = x[here] if len(own) else x[:0]
            if len(own):
                x = np.pad(x[first - before : last + 1 + after], (half - before, half - after), mode="edge")
            found[name] = pa.array(_medians(x, size) if len(own) else x, pa.float64(), from_pandas=True)
        table = table.filter(table["_own"]).drop_columns(["_own", "_chunk"])
        for name, x in found.items():
            table = table.append_column(name, x)
        return table

    return slim.groupBy(*keys, "_chunk").applyInArrow(run, schema)


def running_median(df: DataFrame, keys: list[str], order: str, value: str, size: int, name: str, chunk: int = CHUNK) -> DataFrame:
    """keys, order and value with the exact median of `size` (odd) rows around each; ends are repeated."""
    return medians(df.select(*keys, order, value), keys, order, size, {name: value}, chunk)


def cumulative_before(value: Column, keys: list[str], order: str) -> Column:
    """The sum of the rows before each."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))


def filled(value: str, keys: list[str], order: str) -> Column:
    """value with its gaps on straight lines between their ends, and the nearest value before the first and after the last."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("f"), F.col(value).alias("v")))
    # two running frames, one for each direction: a frame that runs to the end would be evaluated anew for every row
    ahead, back = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col(order), F.col(order).desc()))
    a, b = (F.last(known, ignorenulls=True).over(w) for w in (ahead, back))
    line = a["v"] + (b["v"] - a["v"]) * (F.col(order) - a["f"]) / (b["f"] - a["f"])
    return F.when(F.col(value).isNotNull(), F.col(value)).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(line)


def hits(flag: Column, window) -> Column:
    return F.sum(F.when(flag, 1).otherwise(0)).over(window)


def ieee_divided(a: Column, b: Column) -> Column:
    """a / b as floating point has it: by nothing it is infinite, or not a number where a is 0 or none; b is not negative."""
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, at_zero).otherwise(a / b)


def gradient(value: str, at: str, keys: list[str], order: str) -> Column:
    """The slope at each row by the three-point formula for uneven steps; one-sided at the ends. Rows at one instant have no finite slope."""
    w = Window.partitionBy(*keys).orderBy(order)
    y, t = F.col(value), F.col(at)
    y0, y1, a, b = F.lag(y).over(w), F.lead(y).over(w), t - F.lag(t).over(w), F.lead(t).over(w) - t
    middle = ieee_divided(a * a * y1 + (b * b - a * a) * y - b * b * y0, a * b * (a + b))
    return F.when(y0.isNull(), ieee_divided(y1 - y, b)).when(y1.isNull(), ieee_divided(y - y0, a)).otherwise(middle)


def leaky_release(df: DataFrame, keys: list[str], order: str, step: str, held: str, keep: float, name: str) -> DataFrame:
    """df with y_f = y_{f-1} * (1 if held else keep) + step_f, from 0.

    A step fades by keep for each free row since. Free rows are counted in stretches over which a step fades
    to nothing (1e-150), so each row needs the sums of its own stretch and the one before, and no power
    overflows however long the series is.
    """
    stretch = max(1, math.floor(-150 / math.log10(keep)))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_free", F.sum(F.when(F.col(held), 0).otherwise(1)).over(w)).withColumn("_k", F.floor(F.col("_free") / stretch))
    within = F.col("_free") - F.col("_k") * stretch
    own = Window.partitionBy(*keys, "_k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_sum", F.sum(F.col(step) * F.pow(F.lit(keep), -within)).over(own))
    # each stretch's whole sum, faded to its end, for the rows of the next one
    ends = d.groupBy(*keys, "_k").agg(F.max_by("_sum", order).alias("_before")).withColumn("_k", F.col("_k") + 1)
    d = d.join(ends, [*keys, "_k"], "left")
    y = (F.col("_sum") + F.coalesce(F.col("_before"), F.lit(0.0)) * keep**stretch) * F.pow(F.lit(keep), within)
    return d.withColumn(name, y).drop("_free", "_k", "_sum", "_before")


def unwrapped(value: str, keys: list[str], order: str, turn: float = 360.0) -> Column:
    """An angle without jumps of whole turns."""
    w = Window.partitionBy(*keys).orderBy(order)
    turns = F.round((F.col(value) - F.lag(value).over(w)) / turn)
    return F.col(value) - turn * F.sum(F.coalesce(turns, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
