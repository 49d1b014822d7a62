"""Causal operators over streams of samples: what needs no later row can run as samples arrive.

The streams have a watermark (withWatermark on their time column), which bounds the state that is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rates(stream: DataFrame, time: str, keys: list[str], width: str, **aggregates: Column) -> DataFrame:
    """keys, start and the named aggregates over tumbling windows of the time column."""
    by = stream.groupBy(F.window(time, width).alias("_w"), *keys)
    return by.agg(*(c.alias(n) for n, c in aggregates.items())).select(*keys, F.col("_w.start").alias("start"), *aggregates)


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark: a sample that is sent twice counts once."""
    return stream.dropDuplicatesWithinWatermark(keys)
