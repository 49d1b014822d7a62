"""Session series as CSV with a fixed header, and lens profiles as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = "time_s double, frame_a int, frame_b int, x_deg_s double, y_deg_s double, z_deg_s double, confidence double, support int"
LENS = "name string, calib_dimension struct<w: double, h: double>, fisheye_params struct<camera_matrix: array<array<double>>, distortion_coeffs: array<double>>"


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the CSV files under path, with their file; another header is an error; NaN is null."""
    read = spark.read.schema(SERIES).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in read.dtypes]
    return read.select(F.input_file_name().alias("file"), *clean)


def read_lens(spark: SparkSession, path: str, width: float, height: float) -> DataFrame:
    """name, fx, fy, cx, cy and distortion of each profile, scaled to a picture of this size; a file has one profile or a list of them."""
    p = spark.read.schema(LENS).option("multiLine", True).json(path)
    m, d = F.col("fisheye_params.camera_matrix"), F.col("calib_dimension")
    kx, ky = width / d["w"], height / d["h"]
    return p.select("name", (m[0][0] * kx).alias("fx"), (m[1][1] * ky).alias("fy"), (m[0][2] * kx).alias("cx"), (m[1][2] * ky).alias("cy"), F.col("fisheye_params.distortion_coeffs").alias("distortion"))


#: Keys whose profiles lie in one file.
IN_FILE = 1024


def write_lens(df: DataFrame, path: str, key: str, profile: str, in_file: int = IN_FILE) -> None:
    """A list of profiles for each `in_file` values of a whole key, each in a file of its own; so files grow in number with the keys over in_file, and never in size."""
    lists = df.groupBy(F.floor(F.col(key) / in_file).alias("part")).agg(F.array_sort(F.collect_list(profile)).alias("_l"))
    lists.select("part", F.to_json("_l").alias("value")).write.mode("error").partitionBy("part").text(path)


def write_series(df: DataFrame, path: str) -> None:
    df.select(*(c.split()[0] for c in SERIES.split(", "))).write.mode("error").option("header", True).csv(path)
