"""Samples, dumps, rate logs and reports as files, by Spark's own writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digits(c: Column) -> Column:
    """Nine digits, which keep every single-precision number apart; null stays null."""
    return F.when(c.isNotNull(), F.format_string("%.8e", c.cast("double")))


def sample_rows(samples: DataFrame) -> DataFrame:
    """The fourteen text columns of a sample table: where and when, and the rotation in both frames."""
    part = lambda name, short: [digits(F.col(f"{name}.{k}")).alias(f"{short}q{k}") for k in "wxyz"]
    where = [F.col("file"), F.col("frame").cast("string").alias("frame"), F.col("index").cast("string").alias("idx"), F.format_string("%.3f", F.col("t_us")).alias("t_us")]
    rest = [F.when(F.col("inverted"), "1").otherwise("0").alias("inverted"), F.col("at").cast("string").alias("place")]
    return samples.select(*where, *part("sensor", ""), *part("camera", "cam_"), *rest)


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples as CSV with a header, a folder for each file."""
    sample_rows(samples).write.mode("error").partitionBy("file").option("header", True).csv(path)


def write_dump(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """All columns as Parquet, a folder for each key."""
    df.write.mode("error").partitionBy(*keys).parquet(path)


def write_log(rates: DataFrame, path: str, key: str, order: str, columns: Sequence[str], header: Sequence[str]) -> None:
    """A text log for each key, in a folder of its own: the header's lines, then the columns of each row in order.

    A key's rows are sorted in one task, which spills, and written as one file.
    """
    heads = rates.select(key).distinct().select(key, F.lit(0).alias("_kind"), F.posexplode(F.array(*map(F.lit, header))).alias("_place", "line"))
    rows = rates.select(key, F.lit(1).alias("_kind"), F.col(order).alias("_place"), F.concat_ws(",", *(F.coalesce(digits(F.col(c)), F.lit("")) for c in columns)).alias("line"))
    placed = heads.withColumn("_place", F.col("_place").cast("double")).unionByName(rows.withColumn("_place", F.col("_place").cast("double")))
    sorted_ = placed.repartition(key).sortWithinPartitions(key, "_kind", "_place")
    sorted_.select(key, F.col("line").alias("value")).write.mode("error").partitionBy(key).text(path)


def write_reports(df: DataFrame, path: str) -> None:
    """Each row as a JSON object, with its nulls."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("error").text(path)


def report_index(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The named columns as CSV with a header."""
    df.select(*columns).write.mode("error").option("header", True).csv(path)


def write_exports(df: DataFrame, path: str) -> None:
    """Each row as an export, one a line; so files grow in number with the tasks, not with the exports."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("error").text(path)


def read_exports(spark: SparkSession, path: str, label: str = "") -> DataFrame:
    """file, place (from 0) and the frames of render exports: one JSON object a file with a list `frames` of time, the rotations
    before (org) and after (stab), angles and field of view.

    label: the field, with its type, that tells exports apart which lie one a line, as write_exports() has them; it comes first.
    """
    quat = "struct<w: double, x: double, y: double, z: double>"
    shape = f"frames array<struct<time: double, org: {quat}, stab: {quat}, euler: array<double>, fov: double>>"
    read = spark.read.schema(f"{label}, {shape}" if label else shape).option("multiLine", not label).json(path)
    told = read.columns[:-1]
    return read.select(*told, F.input_file_name().alias("file"), F.posexplode("frames").alias("place", "f")).select(*told, "file", "place", "f.*")
