"""A fisheye lens as Column functions: pixels to the plane at distance one, and to rays of length one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quaternion import let, vec

STEPS = 12


def lifted(u: Column, v: Column, focal: float, centre: tuple[float, float], k: Sequence[float], steps: int = STEPS) -> Column:
    """x and y of a pixel on the plane at distance one: the angle whose polynomial angle * (1 + k0 a^2 + k1 a^4 + k2 a^6 + k3 a^8)
    is the pixel's distance from the centre, found by `steps` of Newton's method from that distance.

    Null where there is none in front of the lens: the steps do not settle, or the angle is a right one or more. Of a lens
    whose distances fall again towards its edge, pixels near there may get the angle beyond the farthest one.
    """

    def at(a: Column) -> tuple[Column, Column]:
        q = a * a
        value = a * (1 + q * (k[0] + q * (k[1] + q * (k[2] + q * k[3]))))
        slope = 1 + q * (3 * k[0] + q * (5 * k[1] + q * (7 * k[2] + q * 9 * k[3])))
        return value, slope

    def solved(p: Column) -> Column:
        far = F.least(p["d"], F.lit(1.5707963267948966))

        def step(a: Column, _: Column) -> Column:
            value, slope = at(a)
            return a - F.try_divide(value - p["d"], slope)

        return let(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), far, step), lambda a: placed(p, a))

    def placed(p: Column, a: Column) -> Column:
        fits = (F.abs(at(a)[0] - p["d"]) < 1e-9) & (a >= 0) & (a < 1.5707963267948966)
        scale = F.when(p["d"] > 1e-12, F.tan(a) / p["d"]).otherwise(1.0)
        return F.when(fits, F.struct((p["x"] * scale).alias("x"), (p["y"] * scale).alias("y")))

    x, y = (u - centre[0]) / focal, (v - centre[1]) / focal
    return let(F.struct(x.alias("x"), y.alias("y"), F.sqrt(x * x + y * y).alias("d")), solved)


def projected(x: Column, y: Column, focal: float, centre: tuple[float, float], k: Sequence[float]) -> Column:
    """u and v of a point on the plane at distance one: what lifted() undoes."""
    r = F.sqrt(x * x + y * y)
    a = F.atan(r)
    q = a * a
    d = a * (1 + q * (k[0] + q * (k[1] + q * (k[2] + q * k[3]))))
    scale = F.when(r > 1e-12, d / r).otherwise(1.0)
    return F.struct((x * scale * focal + centre[0]).alias("u"), (y * scale * focal + centre[1]).alias("v"))


def ray(p: Column) -> Column:
    """The ray of length one through a point of the plane."""
    return let(F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + 1), lambda n: F.when(p.isNotNull(), vec(p["x"] / n, p["y"] / n, 1 / n)))
