"""Quaternion Column functions over struct<w,x,y,z: double>, all inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two rotations between the sensor's and the camera's frame (w, x, y, z).
SENSOR_TO_CAMERA = (0.5, -0.5, -0.5, 0.5)
FLIP_Y = (0.0, 0.0, 1.0, 0.0)

PARTS = ("w", "x", "y", "z")


def quat(w, x, y, z) -> Column:
    return F.struct(*(F.lit(v).cast("double").alias(k) if not isinstance(v, Column) else v.alias(k) for k, v in zip(PARTS, (w, x, y, z))))


def vec(x, y, z) -> Column:
    return F.struct(*((v if isinstance(v, Column) else F.lit(float(v))).alias(k) for k, v in zip("xyz", (x, y, z))))


def _of(q: Column | Sequence[float]) -> tuple:
    return tuple(q[k] for k in PARTS) if isinstance(q, Column) else tuple(F.lit(float(v)) for v in q)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body uses it; keeps nested formulas small."""
    return F.transform(F.array(value), body)[0]


def product(a, b) -> Column:
    aw, ax, ay, az = _of(a)
    bw, bx, by, bz = _of(b)
    return quat(aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw)


def conjugate(q) -> Column:
    w, x, y, z = _of(q)
    return quat(w, -x, -y, -z)


def negate(q) -> Column:
    return quat(*(-v for v in _of(q)))


def dot(a, b) -> Column:
    return sum((p * q for p, q in zip(_of(a)[1:], _of(b)[1:])), _of(a)[0] * _of(b)[0])


def normalized(q) -> Column:
    """q over its length; a zero quaternion stays as it is."""
    n = F.sqrt(dot(q, q))
    return quat(*(F.when(n > 0, v / n).otherwise(v) for v in _of(q)))


def to_camera(q) -> Column:
    return let(product(q, SENSOR_TO_CAMERA), lambda m: product(FLIP_Y, m))


def to_sensor(q) -> Column:
    back = lambda c: (c[0], *(-v for v in c[1:]))
    return let(product(back(FLIP_Y), q), lambda m: product(m, back(SENSOR_TO_CAMERA)))


def euler(q) -> Column:
    """yaw, pitch, roll in degrees, intrinsic ZYX."""
    w, x, y, z = _of(q)
    clip = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))
    return F.struct(
        F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))).alias("yaw"),
        F.degrees(F.asin(clip)).alias("pitch"),
        F.degrees(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))).alias("roll"),
    )


def from_euler(yaw: Column, pitch: Column, roll: Column) -> Column:
    """The rotation about z, then y, then x, as a product of three half-angle quaternions."""
    zero = F.lit(0.0)

    def turned(h: Column) -> Column:
        inner = product(quat(h["cp"], zero, h["sp"], zero), quat(h["cr"], h["sr"], zero, zero))
        return let(inner, lambda m: product(quat(h["cy"], zero, zero, h["sy"]), m))

    half = F.struct(*((F.radians(a) / 2).alias(n) for a, n in ((yaw, "y"), (pitch, "p"), (roll, "r"))))
    return let(half, lambda a: let(F.struct(*(f(a[n]).alias(k + n) for n in "ypr" for k, f in (("c", F.cos), ("s", F.sin)))), turned))


def axis_angle(axis: Sequence[float], degrees: Column) -> Column:
    length = sum(v * v for v in axis) ** 0.5
    half = F.radians(degrees) / 2
    return quat(F.cos(half), *(F.sin(half) * (v / length) for v in axis))


def rotation_vector(q) -> Column:
    """The rotation as a vector in degrees, no longer than half a turn."""
    w, x, y, z = _of(q)
    n = F.sqrt(x * x + y * y + z * z)
    turn = 2 * F.atan2(n, w)
    turn = F.when(turn > F.pi(), turn - 2 * F.pi()).otherwise(turn)
    k = F.degrees(F.when(n > 1e-12, turn / n).otherwise(F.lit(2.0)))
    return vec(x * k, y * k, z * k)


def from_rotation_vector(v: Column) -> Column:
    n = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])
    half = F.radians(n) / 2
    k = F.when(n > 1e-12, F.sin(half) / n).otherwise(F.lit(3.141592653589793 / 360))
    return quat(F.cos(half), v["x"] * k, v["y"] * k, v["z"] * k)


def soft_limited(v: Column, most: float) -> Column:
    """v with its length bounded smoothly: tanh of the length over the bound."""
    r = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]) / most
    k = F.when(r > 0, F.tanh(r) / r).otherwise(F.lit(1.0))
    return vec(v["x"] * k, v["y"] * k, v["z"] * k)


def slerp(a: Column, b: Column, w: Column) -> Column:
    """Between a and b on the shorter arc; linear where they nearly agree."""

    def mixed(d: Column) -> Column:
        angle = F.acos(F.least(F.lit(1.0), F.abs(d)))
        near = angle < 1e-7
        ka = F.when(near, 1 - w).otherwise(F.sin((1 - w) * angle) / F.sin(angle))
        kb = F.when(near, w).otherwise(F.sin(w * angle) / F.sin(angle)) * F.when(d < 0, -1.0).otherwise(1.0)
        return let(F.struct(ka.alias("a"), kb.alias("b")), lambda k: let(quat(*(p * k["a"] + q * k["b"] for p, q in zip(_of(a), _of(b)))), normalized))

    return let(dot(a, b), mixed)


def increment(a: Column, b: Column) -> Column:
    """The rotation vector in degrees from a to b on the shorter arc, in a's frame."""

    def log(m: Column) -> Column:
        n = F.sqrt(m["x"] * m["x"] + m["y"] * m["y"] + m["z"] * m["z"])
        k = F.degrees(F.when(n > 1e-12, 2 * F.atan2(n, F.abs(m["w"])) / n).otherwise(F.lit(2.0))) * F.when(m["w"] < 0, -1.0).otherwise(1.0)
        return let(k, lambda j: vec(m["x"] * j, m["y"] * j, m["z"] * j))

    return let(product(conjugate(a), b), log)
