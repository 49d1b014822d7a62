"""Series derived from the driver's tables, and the same in SQL.

sig: a value for each frame of a series; duo: two sensors of one motion - tel, with a jump at every 97th
event, and img, which sees 0.8 of the motion without the jumps and misses every 29th frame; quat:
unit quaternions in time. All series are ordered by (ts, event_id) or vec_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quaternion as Q


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    """Rounded, so that sums in another order agree; -0.0 becomes 0.0."""
    return F.round(c + F.lit(0.0), 6) + F.lit(0.0)


def flat(c: Column, prefix: str, parts: str = "wxyz") -> list[Column]:
    return [r6(c[p]).alias(f"{prefix}{p}") for p in parts]


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames are numbered hour by hour, from how many rows the hours before have, so that a series is spread over tasks."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("clip_id"), "ts", "event_id", (F.col("value") / 100).alias("x"), F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).alias("_h"))
    so_far = Window.partitionBy("clip_id").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    hours = e.groupBy("clip_id", "_h").agg(F.count(F.lit(1)).alias("_n")).select(F.col("clip_id").alias("_c"), F.col("_h").alias("_hour"), F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    w = Window.partitionBy("clip_id", "_h").orderBy("ts", "event_id")
    # names of their own in place of aliases: these would stay with the columns, and "e.*" of a later struct e would mean them
    met = e.join(hours, F.expr("clip_id <=> _c and _h <=> _hour"))
    return met.select("clip_id", (F.row_number().over(w) - 1 + F.col("_before")).cast("int").alias("frame"), "event_id", "x", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


SIG = "sig AS (SELECT event_type AS clip_id, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1)::INTEGER AS frame, event_id, value / 100 AS x, epoch_us(ts) AS us FROM events)"


def duo(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    base = {"x": F.col("x"), "y": (e * 7919 % 1009) / F.lit(500.0) - 1, "z": (e * 104729 % 1013) / F.lit(500.0) - 1}
    s = sig(spark, sf_dir).select("clip_id", "frame", "event_id", *(c.alias(f"b{k}") for k, c in base.items()))
    jump = F.when(e % 97 == 0, F.lit(5.0)).otherwise(0.0)
    seen = e % 29 != 0
    return s.select("clip_id", "frame", "event_id", (F.col("bx") + jump).alias("x"), F.col("by").alias("y"), F.col("bz").alias("z"), *(F.when(seen, F.col(f"b{k}") * 0.8).alias(f"i{k}") for k in "xyz"), (e * 31 % 400).cast("double").alias("rate"))


DUO = f"""{SIG}, duo AS (SELECT clip_id, frame, event_id, bx + CASE WHEN event_id % 97 = 0 THEN 5.0::DOUBLE ELSE 0 END AS x, b_y AS y, bz AS z,
    CASE WHEN event_id % 29 <> 0 THEN bx * 0.8::DOUBLE END AS ix, CASE WHEN event_id % 29 <> 0 THEN b_y * 0.8::DOUBLE END AS iy, CASE WHEN event_id % 29 <> 0 THEN bz * 0.8::DOUBLE END AS iz, (event_id * 31 % 400)::DOUBLE AS rate
    FROM (SELECT clip_id, frame, event_id, x AS bx, (event_id * 7919 % 1009) / 500.0::DOUBLE - 1 AS b_y, (event_id * 104729 % 1013) / 500.0::DOUBLE - 1 AS bz FROM sig))"""


def quat(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    raw = Q.quat(*(F.col("embedding")[k].cast("double") for k in range(4)))
    return v.select(F.col("label").alias("clip_id"), "vec_id", (F.col("vec_id") * 1000).cast("double").alias("t"), Q.normalized(raw).alias("q"))


QUAT = """raw4 AS (SELECT label AS clip_id, vec_id, (vec_id * 1000)::DOUBLE AS t, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings),
    quat AS (SELECT clip_id, vec_id, t, a / n AS w, b / n AS x, c / n AS y, d / n AS z FROM (SELECT *, CASE WHEN a*a+b*b+c*c+d*d > 0 THEN sqrt(a*a+b*b+c*c+d*d) ELSE 1 END AS n FROM raw4))"""

#: Quaternion macros for the checking SQL: structs with w, x, y, z.
def q_mul(a: str, b: str) -> str:
    return f"""struct_pack(w := {a}.w*{b}.w-{a}.x*{b}.x-{a}.y*{b}.y-{a}.z*{b}.z, x := {a}.w*{b}.x+{a}.x*{b}.w+{a}.y*{b}.z-{a}.z*{b}.y,
        y := {a}.w*{b}.y-{a}.x*{b}.z+{a}.y*{b}.w+{a}.z*{b}.x, z := {a}.w*{b}.z+{a}.x*{b}.y-{a}.y*{b}.x+{a}.z*{b}.w)"""


def s6(e: str) -> str:
    return f"round({e} + 0.0::DOUBLE, 6) + 0.0::DOUBLE"


def sflat(e: str, prefix: str, parts: str = "wxyz") -> str:
    return ", ".join(f"{s6(f'({e}).{p}')} AS {prefix}{p}" for p in parts)
