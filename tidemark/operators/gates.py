"""Windows in time over series: gates, tapers and corrections within intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(rows: DataFrame, spans: DataFrame, keys: list[str], at: str, first: str, last: str, width: int, how: str = "inner") -> DataFrame:
    """rows joined with the spans of their series that hold `at` (both ends inclusive).

    An equi-join on (keys, at div width): a span is there once for each stretch of `width` it touches, so no
    row meets spans that are far from it.
    """
    cut = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))
    cut = cut.select(*(F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in cut.columns))
    here = rows.withColumn("_r", F.floor(F.col(at) / width))
    on = [here[k] == cut[f"_k_{k}"] for k in keys] + [here["_r"] == cut["_b"], here[at] >= cut[first], here[at] <= cut[last]]
    met = here.join(cut, on, how)
    return met.drop("_r", "_b", *(f"_k_{k}" for k in keys))


def cosine_gate(at: Column, first: Column, last: Column, fade: float) -> Column:
    """0 at the ends of a span, 1 from `fade` inside them, on half a cosine between."""
    phase = F.least(F.lit(1.0), F.least(at - first, last - at) / fade)
    return F.when(phase > 0, 0.5 - 0.5 * F.cos(F.pi() * phase)).otherwise(0.0)


def taper(place: Column, size: Column, edge: int | Column) -> Column:
    """Of a row's place from 0 in a span of size rows: a cosine over `edge` rows at both ends."""
    step = F.least(place + 1, size - place)
    return F.when(step > edge, 1.0).otherwise(0.5 - 0.5 * F.cos(F.pi() * step / (edge + 1)))


def zero_net(value: str, keys: list[str]) -> Column:
    """value less its mean over the span."""
    return F.col(value) - F.avg(value).over(Window.partitionBy(*keys))


def strongest(df: DataFrame, keys: list[str], priority: str, order: str, values: list[str]) -> DataFrame:
    """Of rows with equal keys the values of that with the largest priority; ties: the least order."""
    pick = F.max_by(F.struct(*values), F.struct(F.col(priority), -F.col(order)))
    return df.groupBy(*keys).agg(pick.alias("_p")).select(*keys, *(F.col(f"_p.{v}").alias(v) for v in values))


def deramped(df: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    """df with value under a Hann window over its span, summed up, less the line from nothing to the last sum."""
    own = Window.partitionBy(*keys)
    i, n = F.row_number().over(own.orderBy(order)) - 1, F.count(F.lit(1)).over(own) - 1
    d = df.withColumn("_i", i).withColumn("_n", n)
    hann = F.when(F.col("_n") > 0, 0.5 - 0.5 * F.cos(2 * F.pi() * F.col("_i") / F.col("_n"))).otherwise(1.0)
    d = d.withColumn("_v", F.col(value) * hann)
    d = d.withColumn("_s", F.sum("_v").over(own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_end", F.sum("_v").over(own))
    line = F.when(F.col("_n") > 0, F.col("_end") * F.col("_i") / F.col("_n")).otherwise(0.0)
    return d.withColumn(value, F.col("_s") - line).drop("_i", "_n", "_v", "_s", "_end")
