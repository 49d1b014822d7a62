"""Rules that depend on what was kept before, over the ordered rows of a series; no task holds a whole series.

A rule that carries only its last row streams through a sorted partition, and products are put together from
those of chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import CHUNK


def _schema(df: DataFrame, keys: list[str], *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, t) for n, t in fields)])


def _in_order(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """df with each series in one partition, its rows in order; the sort spills."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *(F.col(c).asc_nulls_last() for c in order))


def _doubles(batch: pa.RecordBatch, name: str) -> list[float]:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(float).tolist()


def _series_of(batch: pa.RecordBatch, keys: list[str]) -> list[tuple]:
    return list(zip(*(batch.column(k).to_pylist() for k in keys)))


def packed_segments(events: DataFrame, keys: list[str], start: str, end: str, pad: float, longest: float) -> DataFrame:
    """keys, start, end and n of segments: padded events joined to the one before if they touch and stay within `longest`."""
    double, long = T.DoubleType(), T.LongType()
    slim = events.select(*keys, start, end)
    schema = _schema(events, keys, ("start", double), ("end", double), ("n", long))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, kinds = None, None, None

        def out(rows: list) -> pa.RecordBatch:
            columns = list(zip(*((*k, *r) for k, r in rows)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.float64(), pa.float64(), pa.int64()])], names=schema.names)

        for batch in batches:
            done, kinds = [], [batch.schema.field(k).type for k in keys]
            for series, a, b in zip(_series_of(batch, keys), _doubles(batch, start), _doubles(batch, end)):
                a, b = a - pad, b + pad
                if last and series == own and a <= last[1] and max(b, last[1]) - last[0] <= longest:
                    last[1:] = [max(b, last[1]), last[2] + 1]
                else:
                    if last:
                        done.append((own, last))
                    own, last = series, [a, b, 1]
            if done:
                yield out(done)
        if last:
            yield out([(own, last)])

    return _in_order(slim, keys, start, end).mapInArrow(run, schema)


def spaced_top(df: DataFrame, keys: list[str], order: str, value: str, k: int, apart: float) -> DataFrame:
    """keys, order, value and place of the k largest values at least `apart` from each other; ties: the first.

    order is of whole numbers, so a taken row rules out fewer than 2 * apart places, and the k rows are among
    the largest of so many for each row before the last.
    """
    if apart <= 0 or not isinstance(df.schema[order].dataType, T.IntegralType):
        raise ValueError("rows are apart on an order of whole numbers")
    most = (k - 1) * (2 * math.ceil(apart) - 1) + 1
    best = df.groupBy(*keys, order).agg(F.max(value).alias(value))
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), order)
    best = best.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most).drop("_place")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        taken = []
        for row in group.sort_values([value, order], ascending=[False, True]).itertuples(index=False):
            at = getattr(row, order)
            if all(abs(at - x) >= apart for x, _ in taken):
                taken.append((at, getattr(row, value)))
                if len(taken) == k:
                    break
        out = pd.DataFrame(taken, columns=[order, value]).assign(place=np.arange(1, len(taken) + 1))
        return pd.concat([group[keys].iloc[[0] * len(out)].reset_index(drop=True), out], axis=1)

    kind = {n: df.schema[n].dataType for n in (order, value)}
    return best.select(*keys, order, value).groupBy(*keys).applyInPandas(run, _schema(df, keys, (order, kind[order]), (value, kind[value]), ("place", T.LongType())))


def thinned(df: DataFrame, keys: list[str], order: str, least: float) -> DataFrame:
    """The rows of df at least `least` after the last one that was kept; the first row stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, -np.inf
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (series, t) in enumerate(zip(_series_of(batch, keys), _doubles(batch, order))):
                if series != own:
                    own, last = series, -np.inf
                if t - last >= least:
                    keep[i], last = True, t
            if keep.any():
                yield batch.filter(pa.array(keep))

    return _in_order(df, keys, order).mapInArrow(run, df.schema)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row the product of unit quaternions, of length one."""
    (w, x, y, z), (p, q, r, s) = a.T, b.T
    out = np.column_stack([w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p])
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _running(part: np.ndarray) -> np.ndarray:
    """The product of each row with all before it, the later one on the right."""
    out, k = part, 1
    while k < len(part):
        out = np.concatenate([out[:k], _product(out[:-k], out[k:])])
        k *= 2
    return out


def reintegrated(df: DataFrame, keys: list[str], order: str, rates: tuple[str, str, str], dt: str, chunk: int = CHUNK) -> DataFrame:
    """keys, order and w, x, y, z: the product of the rotations by `rates` (degrees a second) over dt, in order.

    Chunks are multiplied on their own; then a row for each chunk gives what came before it.
    """
    double, parts = T.DoubleType(), list("wxyz")
    slim = df.select(*keys, order, *rates, dt).withColumn("_chunk", F.floor(F.col(order) / chunk).cast("long"))

    def within(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        step = np.radians(group[list(rates)].to_numpy(float)) * group[dt].to_numpy(float)[:, None] / 2
        angle = np.linalg.norm(step, axis=1)
        part = np.column_stack([np.cos(angle), step * np.sinc(angle / np.pi)[:, None]])
        return group[[*keys, order, "_chunk"]].assign(**dict(zip(parts, _running(part).T)))

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        return within(group).iloc[-1:][[*keys, "_chunk", *parts]]

    def before(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_chunk")
        group[parts] = np.concatenate([[[1.0, 0.0, 0.0, 0.0]], _running(group[parts].to_numpy(float))[:-1]])
        return group[[*keys, "_chunk", *parts]]

    def placed(group: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        out = within(group)
        out[parts] = _product(np.repeat(first[parts].to_numpy(float), len(out), 0), out[parts].to_numpy(float))
        return out[[*keys, order, *parts]]

    ends = _schema(slim, [*keys, "_chunk"], *((k, double) for k in parts))
    firsts = slim.groupBy(*keys, "_chunk").applyInPandas(whole, ends).groupBy(*keys).applyInPandas(before, ends)
    both = slim.groupBy(*keys, "_chunk").cogroup(firsts.groupBy(*keys, "_chunk"))
    return both.applyInPandas(placed, _schema(df, keys, (order, df.schema[order].dataType), *((k, double) for k in parts)))
