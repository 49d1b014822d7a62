"""Functions over many whole groups at once: one call sees hundreds of groups as arrays, in place of a call for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of whole groups that are handed on together, for groups that are smaller.
ROWS = 1 << 16


def whole_groups(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, rows: int = ROWS) -> DataFrame:
    """f(table, starts) of the rows of df, groups one after another in their order; starts: where each begins. A group must fit into a task."""
    named = df.withColumn("_g", F.xxhash64(*keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            g = table["_g"].to_numpy()
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            yield from f(table.drop_columns(["_g"]).combine_chunks(), starts).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < rows:
                continue
            table = pa.Table.from_batches(held)
            g = table["_g"].to_numpy()
            cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
            if cut:
                yield from out(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield from out(pa.Table.from_batches(held))

    return named.repartition(*keys).sortWithinPartitions("_g", *keys, *order).mapInArrow(run, schema)


def medians_of(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The median of each group's values."""
    bounds = np.append(starts, len(x))
    of = np.repeat(np.arange(len(starts)), np.diff(bounds))
    ordered, n = x[np.lexsort((x, of))], np.diff(bounds)
    return (ordered[starts + (n - 1) // 2] + ordered[starts + n // 2]) / 2
