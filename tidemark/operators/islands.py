"""Runs of neighbouring flagged rows. One definition of a gap: rows between two flagged rows of a run, at most max_gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: str, max_gap: int, name: str = "run") -> DataFrame:
    """The rows of df (flagged ones only) with the number of their run, from 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.col(order) - F.lag(order).over(w) > max_gap + 1, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def islands(df: DataFrame, keys: list[str], order: str, max_gap: int, *aggregates: Column) -> DataFrame:
    """keys, run, first, last (inclusive) and n of each run, with more aggregates over its rows."""
    return numbered(df, keys, order, max_gap).groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"), *aggregates)


def merged(runs: DataFrame, keys: list[str], max_gap: int) -> DataFrame:
    """keys, first, last and parts of runs joined where at most max_gap rows lie between them."""
    w = Window.partitionBy(*keys).orderBy("first")
    end = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("first") - end - 1 > max_gap, 1).otherwise(0)
    joined = runs.withColumn("_new", new).withColumn("_of", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(*keys, "_of").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("parts")).drop("_of")


def longer(runs: DataFrame, least: int, also: Column | None = None) -> DataFrame:
    enough = F.col("last") - F.col("first") + 1 >= least
    return runs.where(enough if also is None else enough | also)
