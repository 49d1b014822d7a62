"""Jumps of one sensor that a second one does not confirm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W

# Least jump and fastest motion of the spike rule, frames that a spike contaminates, fastest motion without the jump.
SPIKE, RATE_MAX, AGAINST, REACH, CAMERA_MAX = 0.35, 150.0, -0.5, 5, 60.0


def unconfirmed(df: DataFrame, keys: list[str], order: str, axes: list[str], witness: list[str], rate: str, spike: float = SPIKE, rate_max: float = RATE_MAX, reach: int = REACH, second: list[str] | None = None, camera: str | None = None, camera_max: float = CAMERA_MAX, valid: str | None = None) -> DataFrame:
    """df with the distance of each axis from its median of five rows (r_<axis>), their length (jump), spike, the correction
    that puts a spike back on that median (c_<axis>, 0 elsewhere), and contaminated: not a spike, but within reach of one.

    A spike is a jump of at least `spike` below rate_max that the witness axes (null: zero), or those of a second witness,
    go against. camera: the rate without jumps, which stays under camera_max; valid: rows that are not count as 0.
    """
    own = {a: F.when(F.col(valid), F.col(a)).otherwise(0.0) if valid else F.col(a) for a in axes}
    out = W.medians(df.select("*", *(c.alias(f"_v_{a}") for a, c in own.items())), keys, order, 5, {f"r_{a}": f"_v_{a}" for a in axes})
    out = out.select(*df.columns, *((F.col(a) - F.col(f"r_{a}")).alias(f"r_{a}") for a in axes))
    length = F.sqrt(sum((F.col(f"r_{a}") * F.col(f"r_{a}") for a in axes), F.lit(0.0)))
    out = out.withColumn("jump", length)
    along = lambda w: sum((F.coalesce(F.col(v), F.lit(0.0)) * F.col(f"r_{a}") for a, v in zip(axes, w)), F.lit(0.0))
    against = along(witness) < AGAINST * F.col("jump") * F.col("jump")
    if second:
        against = against | (along(second) < AGAINST * F.col("jump") * F.col("jump"))
    found = (F.col("jump") >= spike) & against & (F.col(rate) < rate_max)
    if camera:
        found = found & (F.col(camera) < camera_max)
    if valid:
        found = found & F.col(valid)
    out = out.withColumn("spike", found)
    out = out.select("*", *(F.when(F.col("spike"), -F.col(f"r_{a}")).otherwise(0.0).alias(f"c_{a}") for a in axes))
    near = W.framed(out, keys, order, reach, reach, {"_near": lambda rows, _: W.hits(F.col("spike"), rows)})
    return near.withColumn("contaminated", (F.col("_near") > 0) & ~F.col("spike")).drop("_near")
