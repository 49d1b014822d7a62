"""Robust fits over many small groups: rotations between rays, affine flow of points, attitude curves beside a gap, bounded splines.

The fits of all groups of a batch advance together as stacked 3x3 or 4x4 systems; a group - the points of one pair of
frames, the samples beside one gap, the pairs of one span - is small by its nature and must fit into a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..shared import kept, stored
from . import asof, corrections
from . import gates as G
from . import filters
from .groups import medians_of, whole_groups
from .stats import MAD_TO_SIGMA

ROUNDS = 6


def _columns(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.column_stack([table[n].cast(pa.float64()).to_numpy() for n in names])


def _weights(residual: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt(1 + (residual / (2 * scale)) ** 2)


def _vectors_of(r: np.ndarray) -> np.ndarray:
    """Rotation matrices (stacked) as vectors in degrees."""
    q = np.empty((len(r), 4))
    q[:, 0] = 1 + r[:, 0, 0] + r[:, 1, 1] + r[:, 2, 2]
    q[:, 1:] = np.column_stack([r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]])
    flat = q[:, 0] < 0.5  # near half a turn: from the largest diagonal element
    for i in np.flatnonzero(flat):
        m = r[i]
        k = int(np.argmax(np.diag(m)))
        a, b = (k + 1) % 3, (k + 2) % 3
        q[i, 1 + k] = 1 + m[k, k] - m[a, a] - m[b, b]
        q[i, 1 + a], q[i, 1 + b], q[i, 0] = m[a, k] + m[k, a], m[b, k] + m[k, b], m[b, a] - m[a, b]
    q *= np.where(q[:, :1] < 0, -1, 1)
    n = np.linalg.norm(q[:, 1:], axis=1)
    turn = 2 * np.arctan2(n, q[:, 0])
    return np.degrees(q[:, 1:] * np.where(n > 1e-15, turn / np.maximum(n, 1e-15), 0)[:, None])


def rotation_fit(df: DataFrame, keys: list[str], a: list[str], b: list[str], rounds: int = ROUNDS) -> DataFrame:
    """keys, x, y, z (the rotation that turns rays a to rays b, as a vector in degrees), residual (its median) and n, of each group.

    Each round turns by the singular vectors of the weighted cross-covariance, and weighs rays anew by their distance over its median. Rows
    with a null are left out; the rotation is null for fewer than two rays, or rays that all lie on one line.
    """
    known = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in (*a, *b))).dropna(subset=[*a, *b])

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        p, q = _columns(table, a), _columns(table, b)
        n = np.diff(np.append(starts, len(p)))
        of, w = np.repeat(np.arange(len(starts)), n), np.ones(len(p))
        for _ in range(rounds):
            h = np.add.reduceat((q * w[:, None])[:, :, None] * p[:, None, :], starts)
            u, s, vt = np.linalg.svd(h)
            vt = vt * np.sign(np.linalg.det(u @ vt))[:, None, None] ** (np.arange(3) == 2)[None, :, None]
            r = u @ vt
            residual = np.linalg.norm(np.einsum("nij,nj->ni", r[of], p) - q, axis=1)
            middle = medians_of(residual, starts)
            w = _weights(residual, np.maximum(MAD_TO_SIGMA * middle, 1e-9)[of])
        v = _vectors_of(r)
        v[(n < 2) | (s[:, 1] <= 1e-12 * s[:, 0])] = np.nan
        heads = table.select(keys).take(pa.array(starts))
        for name, x in (*zip("xyz", v.T), ("residual", np.where(np.isnan(v[:, 0]), np.nan, middle))):
            heads = heads.append_column(name, pa.array(x, from_pandas=True))
        return heads.append_column("n", pa.array(n))

    types = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)
    return whole_groups(known, keys, [*a, *b], run, f"{types}, x double, y double, z double, residual double, n long")


def _solved3(x: np.ndarray, y: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Weighted least squares on three unknowns of each group, by its normal equations."""
    xw = x * (w * w)[:, None]
    m = np.add.reduceat(xw[:, :, None] * x[:, None, :], starts)
    m[:, range(3), range(3)] += 1e-12 * np.trace(m, axis1=1, axis2=2)[:, None] + 1e-300
    return np.linalg.solve(m, np.add.reduceat(xw * y[:, None], starts)[:, :, None])[:, :, 0]


def affine_flow(df: DataFrame, keys: list[str], before: tuple[str, str], after: tuple[str, str], centre: tuple[float, float], focal: float, rounds: int = ROUNDS) -> DataFrame:
    """keys, roll (degrees), growth, shear, shift_x, shift_y (degrees) and n: the affine motion of each group's points about the centre.

    Rows of x and of y share no unknown, so each round solves two systems of three, then weighs both by their distance over the median of all. Rows
    with a null are left out; fewer than three points give nulls.
    """
    known = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in (*before, *after))).dropna(subset=[*before, *after])

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        a, b = _columns(table, list(before)), _columns(table, list(after))
        p, v = a - np.array(centre), b - a
        n = np.diff(np.append(starts, len(p)))
        of = np.repeat(np.arange(len(starts)), n)
        size = np.maximum(np.maximum.reduceat(np.abs(p).max(1), starts), 1e-9)
        x = np.column_stack([p / size[of][:, None], np.ones(len(p))])
        w = np.ones((2, len(p)))
        for _ in range(rounds):
            c = [_solved3(x, v[:, k], w[k], starts) for k in range(2)]
            r = np.abs(np.stack([(x * c[k][of]).sum(1) - v[:, k] for k in range(2)], 1))
            scale = np.maximum(MAD_TO_SIGMA * medians_of(r.reshape(-1), starts * 2), 1e-9)[of]
            w = np.stack([_weights(r[:, k], scale) for k in range(2)])
        (a11, a12, bx), (a21, a22, by) = ((c[k][:, 0] / size, c[k][:, 1] / size, c[k][:, 2]) for k in range(2))
        heads = table.select(keys).take(pa.array(starts))
        told = {"roll": np.degrees((a21 - a12) / 2), "growth": (a11 + a22) / 2, "shear": (a11 - a22) / 2, "shift_x": np.degrees(bx / focal), "shift_y": np.degrees(by / focal)}
        for name, y in told.items():
            heads = heads.append_column(name, pa.array(np.where(n < 3, np.nan, y), from_pandas=True))
        return heads.append_column("n", pa.array(n))

    types = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)
    return whole_groups(known, keys, [*before, *after], run, f"{types}, roll double, growth double, shear double, shift_x double, shift_y double, n long")


# Seconds beside a gap that its curve is fitted to, samples of a side, degree, and the root mean square (degrees) beyond which it isn't used.
CONTEXT_S, SIDE_POINTS, DEGREE, WORST_RMS = 0.10, 8, 3, 1.0


def _side_fits(x: np.ndarray, y: np.ndarray, starts: np.ndarray, degree: int) -> np.ndarray:
    """Coefficients (constant first) of the robust polynomial through each group's points, for each column of y: groups by columns by degree + 1.

    Three rounds, in which points farther than 1.5 times the scale of what is left weigh less; a fit that leaves nothing stands. Groups with few points have a lower degree.
    """
    n = np.diff(np.append(starts, len(x)))
    of = np.repeat(np.arange(len(starts)), n)
    low = np.minimum(degree, n - 1)
    size = np.maximum(np.maximum.reduceat(np.abs(x), starts), 1e-12)
    powers = (x / size[of])[:, None] ** np.arange(degree + 1)
    powers[np.arange(degree + 1)[None, :] > low[of][:, None]] = 0
    unused = np.arange(degree + 1)[None, :] > low[:, None]
    out = np.zeros((len(starts), y.shape[1], degree + 1))
    for k in range(y.shape[1]):
        w, open_ = np.ones(len(x)), np.ones(len(starts), bool)
        for _ in range(3):
            m = np.add.reduceat(powers[:, :, None] * powers[:, None, :] * w[:, None, None], starts)
            m[:, np.arange(degree + 1), np.arange(degree + 1)] += unused
            c = np.linalg.solve(m, np.add.reduceat(powers * (w * y[:, k])[:, None], starts)[:, :, None])[:, :, 0]
            out[open_, k] = c[open_]
            left = y[:, k] - (powers * out[of, k]).sum(1)
            scale = MAD_TO_SIGMA * medians_of(np.abs(left - medians_of(left, starts)[of]), starts)
            open_ &= scale >= 1e-8
            w = np.minimum(1.0, 1.5 * scale[of] / np.maximum(np.abs(left), 1e-12))
            w[~open_[of]] = 1.0
    return out / size[:, None, None] ** np.arange(degree + 1)


def at_both_ends(at: DataFrame, by: list[str], names) -> DataFrame:
    """by and, under names, the attitudes q of at whose _end is 0 and 1, aggregated number by number, so by hash."""
    part = lambda k, p: F.max(F.when(F.col("_end") == k, F.col(f"q.{p}"))).alias(f"_{k}{p}")
    both = at.groupBy(*by).agg(*(part(k, p) for k in (0, 1) for p in Q.PARTS))
    return both.select(*by, *(F.when(F.col(f"_{k}w").isNotNull(), Q.quat(*(F.col(f"_{k}{p}") for p in Q.PARTS))).alias(n) for k, n in enumerate(names)))


def span_ends(samples: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, run, lo, hi, q0 and q1: the attitudes at both ends of each span."""
    asked = spans.select(*keys, "run", "lo", "hi", F.explode(F.array(F.lit(0), F.lit(1))).alias("_end")).withColumn("t", F.when(F.col("_end") == 0, F.col("lo")).otherwise(F.col("hi")))
    asked = asof.slerped(samples.select(*keys, "t", "q"), asked, keys, "t", "q", asof.STRETCH_S)
    return at_both_ends(asked, [*keys, "run", "lo", "hi"], ("q0", "q1"))


def context_curves(samples: DataFrame, gaps: DataFrame, excluded: DataFrame, keys: list[str], reach: float = CONTEXT_S, points: int = SIDE_POINTS, degree: int = DEGREE, worst: float = WORST_RMS, ends: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(targets, curves): an attitude for each sample in a gap, from the clean samples beside it.

    samples: keys, t (seconds) and q; gaps: keys, run, lo and hi; excluded: keys, lo and hi, whose samples are not clean. On each side at
    most `points` samples, spread evenly over those within `reach` of the gap, are turned into vectors from the attitude at lo; a robust
    cubic through each side gives value and slope at the gap's end, which a Hermite curve joins. With fewer than two samples on a side, or
    a fit that leaves more than `worst` degrees, the target is the shortest arc between the attitudes at both ends.

    ends: span_ends() of these and maybe other gaps, if they are known already. targets: keys, run, t and q. curves: keys, run, lo, hi, method
    (curve or bridge), left, right (samples used) and rms; a row for each gap is kept, as both rest on it.
    """
    width = 1.0  # seconds that a membership join looks at together
    near = gaps.select(*keys, "run", "lo", "hi", (F.col("lo") - reach).alias("_from"), (F.col("hi") + reach).alias("_to"))
    here = G.within(samples.select(*keys, "t", "q"), near, keys, "t", "_from", "_to", width)
    beside = here.where((F.col("t") < F.col("lo")) | (F.col("t") > F.col("hi")))
    dirty = G.within(beside.select(*keys, "t").distinct(), excluded.select(*keys, F.col("lo").alias("_x"), F.col("hi").alias("_y")), keys, "t", "_x", "_y", width).select(*keys, "t").distinct()
    clean = beside.join(dirty, [*keys, "t"], "left_anti").withColumn("side", F.when(F.col("t") < F.col("lo"), 0).otherwise(1))
    side = Window.partitionBy(*keys, "run", "side")
    clean = clean.select("*", (F.row_number().over(side.orderBy("t")) - 1).alias("_k"), F.count(F.lit(1)).over(side).alias("_n"))
    place = lambda i: F.bround(i * (F.col("_n") - 1) / (points - 1))
    picked = clean.where((F.col("_n") <= points) | F.exists(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: place(i) == F.col("_k")))
    ends = span_ends(samples, gaps, keys) if ends is None else gaps.select(*keys, "run").join(ends, [*keys, "run"])
    rel = picked.select(*keys, "run", "side", "t", "q").join(ends, [*keys, "run"]).withColumn("v", Q.increment(F.col("q0"), F.col("q")))
    rel = rel.select(*keys, "run", "side", (F.col("t") - F.when(F.col("side") == 0, F.col("lo")).otherwise(F.col("hi"))).alias("at"), *(F.col(f"v.{a}").alias(f"v{a}") for a in "xyz"))

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        x, y = table["at"].to_numpy(), _columns(table, ["vx", "vy", "vz"])
        c = _side_fits(x, y, starts, degree)
        n = np.diff(np.append(starts, len(x)))
        of = np.repeat(np.arange(len(starts)), n)
        fitted = np.einsum("nd,nkd->nk", x[:, None] ** np.arange(degree + 1), c[of])
        heads = table.select([*keys, "run", "side"]).take(pa.array(starts))
        for j, a in enumerate("xyz"):
            heads = heads.append_column(f"y{a}", pa.array(c[:, j, 0])).append_column(f"m{a}", pa.array(c[:, j, 1]))
        return heads.append_column("n", pa.array(n)).append_column("square", pa.array(np.add.reduceat(((y - fitted) ** 2).sum(1), starts)))

    types = ", ".join(f"`{k}` {dict(gaps.dtypes)[k]}" for k in (*keys, "run"))
    fits = whole_groups(rel, [*keys, "run", "side"], ["at"], run, f"{types}, side int, " + ", ".join(f"y{a} double, m{a} double" for a in "xyz") + ", n long, square double")
    value = lambda name, k: F.max(F.when(F.col("side") == k, F.col(name)))
    both = fits.groupBy(*keys, "run").agg(value("n", 0).alias("left"), value("n", 1).alias("right"), F.sqrt(F.sum("square") / F.sum("n")).alias("rms"), *(value(f"{m}{a}", k).alias(f"{m}{a}{k}") for m in "ym" for a in "xyz" for k in (0, 1)))
    curves = ends.join(both, [*keys, "run"], "left")
    enough = (F.coalesce("left", F.lit(0)) >= 2) & (F.coalesce("right", F.lit(0)) >= 2)
    curves = curves.withColumn("method", F.when(enough & (F.col("rms") <= worst), "curve").otherwise("bridge")).withColumn("rms", F.when(enough, F.col("rms")))
    curves = kept(curves)
    inner = G.within(samples.select(*keys, "t"), gaps.select(*keys, "run", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), keys, "t", "_lo", "_hi", width)
    met = inner.join(curves, [*keys, "run"])
    met = met.withColumn("_d", F.col("hi") - F.col("lo")).withColumn("_u", F.when(F.col("_d") > 0, (F.col("t") - F.col("lo")) / F.col("_d")).otherwise(0.0))
    u = F.col("_u")
    h = (2 * u * u * u - 3 * u * u + 1, u * u * u - 2 * u * u + u, -2 * u * u * u + 3 * u * u, u * u * u - u * u)
    v = Q.vec(*(h[0] * F.col(f"y{a}0") + h[1] * F.col("_d") * F.col(f"m{a}0") + h[2] * F.col(f"y{a}1") + h[3] * F.col("_d") * F.col(f"m{a}1") for a in "xyz"))
    target = F.when(F.col("method") == "curve", Q.let(Q.let(v, Q.from_rotation_vector), lambda m: Q.product(F.col("q0"), m))).otherwise(Q.slerp(F.col("q0"), F.col("q1"), u))
    told = curves.select(*keys, "run", "lo", "hi", "method", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right"), "rms")
    return met.select(*keys, "run", "t", target.alias("q")), told


KNOTS, BOUND, SMALL, SMOOTH, LEAST_SPREAD = 9, 1.0, 0.6, 0.4, 0.3


def clamped_basis(t: np.ndarray, lo: float | np.ndarray, hi: float | np.ndarray, knots: int = KNOTS) -> np.ndarray:
    """Values at t (rows) of the cubic splines on evenly spaced knots that are 1 at one inner knot and 0 at the others, flat at both ends.

    lo and hi: one span, or that of each t.
    """
    h, inner = (hi - lo) / (knots - 1), knots - 2
    nodes = np.zeros((knots, inner))
    nodes[1:-1] = np.eye(inner)
    m = np.diag(np.full(inner, 4.0)) + np.diag(np.ones(inner - 1), 1) + np.diag(np.ones(inner - 1), -1)
    slopes = np.zeros_like(nodes)  # times h
    slopes[1:-1] = np.linalg.solve(m, 3 * (nodes[2:] - nodes[:-2]))
    k = np.clip(((t - lo) / h).astype(int), 0, knots - 2)
    u = ((t - lo) / h - k)[:, None]
    return nodes[k] * (2 * u**3 - 3 * u**2 + 1) + slopes[k] * (u**3 - 2 * u**2 + u) + nodes[k + 1] * (3 * u**2 - 2 * u**3) + slopes[k + 1] * (u**3 - u**2)


def _mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (aw, ax, ay, az), (bw, bx, by, bz) = np.moveaxis(a, -1, 0), np.moveaxis(b, -1, 0)
    return np.stack([aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw], -1)


def _exp(v: np.ndarray) -> np.ndarray:
    n = np.radians(np.linalg.norm(v, axis=-1, keepdims=True))
    return np.concatenate([np.cos(n / 2), np.radians(v) * np.where(n > 1e-12, np.sin(n / 2) / np.maximum(n, 1e-12), 0.5)], -1)


def _log(q: np.ndarray) -> np.ndarray:
    q = q * np.where(q[..., :1] < 0, -1, 1)
    n = np.linalg.norm(q[..., 1:], axis=-1, keepdims=True)
    return np.degrees(q[..., 1:] * np.where(n > 1e-12, 2 * np.arctan2(n, q[..., :1]) / np.maximum(n, 1e-12), 2.0))


def _inverse(q: np.ndarray) -> np.ndarray:
    return q * [1, -1, -1, -1]


def _with_cross(x: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The matrices 1 + first [x] + second [x]^2, [x] y being x cross y; scalars have a last axis of 1."""
    out = (second * x)[..., :, None] * x[..., None, :]
    out[..., range(3), range(3)] += 1 - second * (x * x).sum(-1, keepdims=True)
    f = first * x
    for i, j, k in ((2, 1, 0), (0, 2, 1), (1, 0, 2)):
        out[..., i, j] += f[..., k]
        out[..., j, i] -= f[..., k]
    return out


def _step_of_exp(v: np.ndarray) -> np.ndarray:
    """Matrices m with exp(v + d) = exp(v) exp(m d) for small d."""
    x = np.radians(v)
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    s = np.maximum(n, 1e-4)
    return _with_cross(x, np.where(n > 1e-4, -2 * np.sin(s / 2) ** 2 / s**2, -0.5 + n * n / 24), np.where(n > 1e-4, (s - np.sin(s)) / s**3, 1 / 6 - n * n / 120))


def _step_of_log(v: np.ndarray) -> np.ndarray:
    """Matrices m with log(exp(v) exp(d)) = v + m d for small d; transposed, those with log(exp(d) exp(v)) = v + m d."""
    x = np.radians(v)
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    s = np.maximum(n, 1e-4)
    return _with_cross(x, np.full_like(n, 0.5), np.where(n > 1e-4, (1 - s / 2 * np.cos(s / 2) / np.sin(s / 2)) / s**2, 1 / 12 + n * n / 720))


def bounded_splines(ba: np.ndarray, bb: np.ndarray, qa: np.ndarray, qb: np.ndarray, target: np.ndarray, sigma: np.ndarray, bound: float = BOUND, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """bounded_spline() of many groups that advance together: all arrays have the groups first; rows with an infinite sigma fill up the shorter ones."""
    size, _, inner = ba.shape
    second = np.diff(np.vstack([np.zeros(inner), np.eye(inner), np.zeros(inner)]), n=2, axis=0)
    prior = np.kron(np.vstack([np.eye(inner) / SMALL, second / SMOOTH]), np.eye(3))
    # what is given of each group: bases, the inverse target, the rotation from qb to qa, the scale, and the target's matrix, transposed
    turned = np.stack([_mul(_mul(_inverse(target), np.broadcast_to(np.eye(4)[k], target.shape)), target)[..., 1:] for k in (1, 2, 3)], -1)
    given = [ba, bb, _inverse(target), _mul(_inverse(qb), qa), sigma[..., None], turned]

    def curves(g: list, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes = p.reshape(-1, inner, 3)
        return g[0] @ nodes, g[1] @ nodes

    def residual(g: list, p: np.ndarray) -> np.ndarray:
        ca, cb = curves(g, p)
        e = _log(_mul(_mul(g[2], _exp(-cb)), _mul(g[3], _exp(ca)))) / g[4]
        return np.hstack([e.reshape(len(p), -1), p @ prior.T])

    def cost(r: np.ndarray) -> np.ndarray:
        return 2 * np.sum(np.sqrt(1 + r * r) - 1, 1)

    def jacobian(g: list, p: np.ndarray, r: np.ndarray) -> np.ndarray:
        ca, cb = curves(g, p)
        rows = ca.shape[1] * 3
        log = _step_of_log(r[:, :rows].reshape(ca.shape) * np.where(np.isinf(g[4]), 0.0, g[4]))
        a = log @ _step_of_exp(ca) / g[4][..., None]
        b = np.swapaxes(log, -1, -2) @ g[5] @ _step_of_exp(cb) / -g[4][..., None]
        return (a[:, :, :, None] * g[0][:, :, None, :, None] + b[:, :, :, None] * g[1][:, :, None, :, None]).reshape(len(p), rows, inner * 3)

    found, costs, at = np.zeros((size, inner * 3)), np.zeros(size), np.arange(size)
    p, damp, diagonal = found.copy(), np.full(size, 1e-3), np.arange(inner * 3)
    r = residual(given, p)
    best = cost(r)
    for _ in range(rounds):
        j, w = jacobian(given, p, r), 1 / np.sqrt(1 + r * r)
        rows = j.shape[1]
        gradient = (j.swapaxes(1, 2) @ (w * r)[:, :rows, None])[..., 0] + (w * r)[:, rows:] @ prior
        free = ~(((p >= bound) & (gradient < 0)) | ((p <= -bound) & (gradient > 0)))
        gradient[~free] = 0  # with a row and a column of their own, nodes at the bound stand still
        m = (j * w[:, :rows, None]).swapaxes(1, 2) @ j + (prior.T * w[:, None, rows:]) @ prior
        m *= free[:, :, None] & free[:, None, :]
        m[:, diagonal, diagonal] += ~free
        before, moved = best.copy(), np.zeros(len(p), bool)
        wait = np.flatnonzero(~(np.abs(gradient).max(1) < 1e-9))
        while len(wait):
            damped = m[wait]
            damped[:, diagonal, diagonal] *= 1 + damp[wait, None]
            step = np.linalg.solve(damped, gradient[wait, :, None])[..., 0]
            trial = np.clip(p[wait] - step, -bound, bound)
            rt = residual(given if len(wait) == len(p) else [x[wait] for x in given], trial)
            ct = cost(rt)
            better = ct < best[wait]
            # what is expected of this step would end the rounds: a shorter one does not help
            least = 2 * (step * gradient[wait]).sum(1) < 1e-14 * np.maximum(best[wait], 1e-300)
            took = wait[better]
            p[took], r[took], best[took], moved[took] = trial[better], rt[better], ct[better], True
            damp[took] = np.maximum(damp[took] / 5, 1e-12)
            damp[wait[~better]] *= 4
            wait = wait[~better & ~least & (damp[wait] < 1e12)]
        done = ~moved | (before - best < 1e-14 * np.maximum(best, 1e-300))
        found[at], costs[at] = p, best
        if done.all():
            break
        if done.any():
            at, p, r, best, damp, *given = (x[~done] for x in (at, p, r, best, damp, *given))
    return found.reshape(size, inner, 3), costs


def bounded_spline(ba: np.ndarray, bb: np.ndarray, qa: np.ndarray, qb: np.ndarray, target: np.ndarray, sigma: np.ndarray, bound: float = BOUND, rounds: int = 150) -> tuple[np.ndarray, float]:
    """The inner nodes (knots - 2 by 3, degrees, each within the bound) of a curve c for which (qb exp(c(tb)))^-1 qa exp(c(ta)) comes near to target, and the cost.

    ba, bb: clamped_basis() at ta and tb. What is left is over sigma; small nodes and small second differences are asked for too, and all
    residuals r count as 2 (sqrt(1 + r^2) - 1). Damped least squares, in which nodes at the bound that would leave it stand still.
    """
    nodes, cost = bounded_splines(*(x[None] for x in (ba, bb, qa, qb, target, sigma)), bound, rounds)
    return nodes[0], float(cost[0])


#: Rows of spans, filled up to the longest of them, that advance together.
TOGETHER = 1 << 14


def spline_fit(pairs: DataFrame, keys: list[str], knots: int = KNOTS, bound: float = BOUND, together: int = TOGETHER) -> DataFrame:
    """keys, knot (1 to knots - 2), at (seconds), x, y, z (degrees), cost and n of each span.

    pairs: keys, lo and hi (the span), ta, tb (seconds), qa, qb (attitudes there), target (the rotation from b to a that is seen, a struct of w,
    x, y, z) and spread (degrees; at least LEAST_SPREAD counts). See bounded_spline(); the curve and its slope are 0 at lo and hi.
    """
    flat = [F.col(f"{n}.{k}").cast("double").alias(f"{n}_{k}") for n in ("qa", "qb", "target") for k in Q.PARTS]
    known = pairs.select(*keys, *(F.col(c).cast("double").alias(c) for c in ("lo", "hi", "ta", "tb")), *flat, F.greatest(F.col("spread").cast("double"), F.lit(LEAST_SPREAD)).alias("spread")).dropna()

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        n, inner = np.diff(np.append(starts, table.num_rows)), knots - 2
        lo, hi = (table[c].to_numpy()[starts] for c in ("lo", "hi"))
        if (lo == hi).any():
            raise ValueError("a span has no length")
        ba, bb = (clamped_basis(table[c].to_numpy(), np.repeat(lo, n), np.repeat(hi, n), knots) for c in ("ta", "tb"))
        qa, qb, target = (_columns(table, [f"{c}_{k}" for k in Q.PARTS]) for c in ("qa", "qb", "target"))
        spread = table["spread"].to_numpy()
        nodes, costs = np.zeros((len(n), inner, 3)), np.zeros(len(n))
        by_size = np.argsort(n, kind="stable")
        while len(by_size):
            # the longest spans that are left, as many as fit
            some = by_size[-max(1, together // int(n[by_size[-1]])) :]
            by_size = by_size[: -len(some)]
            rows = starts[some, None] + np.arange(n[some[-1]])
            own = np.arange(n[some[-1]]) < n[some, None]
            rows = np.where(own, rows, starts[some, None])
            nodes[some], costs[some] = bounded_splines(ba[rows], bb[rows], qa[rows], qb[rows], target[rows], np.where(own, spread[rows], np.inf), bound)
        out = table.select(keys).take(pa.array(np.repeat(starts, inner)))
        at = lo[:, None] + (hi - lo)[:, None] * np.arange(1, knots - 1) / (knots - 1)
        for name, x in (("knot", np.tile(np.arange(1, knots - 1), len(n))), ("at", at.ravel()), *zip("xyz", nodes.reshape(-1, 3).T), ("cost", np.repeat(costs, inner)), ("n", np.repeat(n, inner))):
            out = out.append_column(name, pa.array(x))
        return out

    types = ", ".join(f"`{k}` {dict(pairs.dtypes)[k]}" for k in keys)
    return whole_groups(known, keys, ["ta", "tb"], run, f"{types}, knot long, at double, x double, y double, z double, cost double, n long")


#: Instants of a full rate that are listed in one task.
GRID = 1 << 16


def fullrate_trial(samples: DataFrame, windows: DataFrame, keys: list[str], rate: float, hz: float, fade: float, gain: float = 1.0, shift: float = 0.0) -> DataFrame:
    """keys, t, q and applied (degrees): samples in windows, turned towards their motion below hz.

    samples: keys, t (seconds) and q; windows: keys, lo and hi. Each series is resampled at `rate` from 2.5 s (or 5 / hz, or shift + 1 s) before its
    first window to as long after its last, smoothed part by part, and read `shift` seconds later; an error where that lies beyond it. The
    way there is scaled by a gate - 0 at a window's ends, 1 from `fade` inside, the largest of windows that overlap - and by gain.
    """
    if not (0 < hz < rate / 2) or gain < 0 or not np.isfinite([gain, shift]).all():
        raise ValueError("hz must be below half the rate, gain not negative, and both gain and shift finite")
    pad = max(2.5, 5 / hz, abs(shift) + 1)
    span = samples.groupBy(*keys).agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    reach = windows.groupBy(*keys).agg((F.min("lo") - pad).alias("_a"), (F.max("hi") + pad).alias("_b")).join(span, keys)
    reach = reach.select(*keys, F.greatest("_a", "_first").alias("_a"), F.least("_b", "_last").alias("_b"))
    # the instants of GRID frames are listed in one task, those of a series in as many as it takes
    last = F.floor((F.col("_b") - F.col("_a")) * rate + 0.5).cast("int")
    blocks = reach.select(*keys, "_a", last.alias("_n"), F.explode(F.sequence(F.lit(0), F.floor(last / GRID).cast("int"))).alias("_g"))
    blocks = blocks.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_g")
    frame = F.explode(F.sequence(F.col("_g") * GRID, F.least(F.col("_n"), F.col("_g") * GRID + GRID - 1)))
    grid = blocks.select(*keys, "_a", frame.alias("frame")).withColumn("t", F.col("_a") + F.col("frame") / rate).drop("_a")
    dense = asof.slerped(samples.select(*keys, "t", "q"), grid, keys, "t", "q", asof.STRETCH_S)
    # the instants are told again from where a series begins, not joined row by row; and both results rest on what is stored here
    begins = F.broadcast(reach.select(*keys, "_a"))
    smooth = filters.smoothed_rotations(dense, keys, "frame", "q", rate, hz).join(begins, keys).select(*keys, (F.col("_a") + F.col("frame") / rate).alias("t"), "q")
    smooth = stored(smooth, "smooth")
    inside = G.within(samples.select(*keys, "t", F.col("q").alias("_q")), windows.select(*keys, "lo", "hi"), keys, "t", "lo", "hi", 1.0)
    gate = inside.groupBy(*keys, "t").agg(F.max(G.cosine_gate(F.col("t"), F.col("lo"), F.col("hi"), fade)).alias("_gate"), F.first("_q").alias("_q")).where("_gate > 0")
    ends = smooth.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    asked = gate.join(F.broadcast(ends), keys).withColumn("_own", F.col("t")).withColumn("t", F.col("_own") + shift)
    beyond = (F.col("t") < F.col("_a") - 1e-9) | (F.col("t") > F.col("_b") + 1e-9)
    asked = asked.withColumn("t", F.when(beyond, F.raise_error(F.lit("not enough samples for this shift")).cast("double")).otherwise(F.col("t")))
    met = asof.slerped(smooth, asked, keys, "t", "q", asof.STRETCH_S)
    turn = Q.let(Q.increment(F.col("_q"), F.col("q")), lambda v: Q.vec(*(v[a] * F.col("_gate") * gain for a in "xyz")))
    met = met.withColumn("applied", turn)
    return met.select(*keys, F.col("_own").alias("t"), Q.product(F.col("_q"), Q.from_rotation_vector(F.col("applied"))).alias("q"), "applied")


# Support of a pair of pictures, and the calm share of pairs that the order of axes is fitted on.
SUPPORT, CALM_SHARE, CALM_FROM, FIT_PAIRS = 80, 0.85, 200, 30


def session_rates(samples: DataFrame, pairs: DataFrame, keys: list[str], fps: float, readout: float) -> DataFrame:
    """keys, frame, x, y, z (degrees a second, in the axes of the pictures) and err: what is told of the motion between two frames.

    pairs: keys, frame (the first of two), sx, sy, sz (what is seen, null where unknown) and support. Attitudes are read half the readout (ms)
    after each frame. The signed order of axes is that of the pairs with support, of more than CALM_FROM of them the calmest CALM_SHARE; an
    error where fewer than FIT_PAIRS are left. Pairs beyond the samples are an error too.
    """
    offset = readout / 2000
    ends = samples.groupBy(*keys).agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    asked = pairs.select(*keys, "frame", F.explode(F.array(F.lit(0), F.lit(1))).alias("_end")).withColumn("t", (F.col("frame") + F.col("_end")) / fps + offset).join(F.broadcast(ends), keys)
    beyond = (F.col("t") < F.col("_lo")) | (F.col("t") > F.col("_hi"))
    asked = asked.withColumn("t", F.when(beyond, F.raise_error(F.lit("the samples do not reach all frames")).cast("double")).otherwise(F.col("t"))).drop("_lo", "_hi")
    at = asof.slerped(samples.select(*keys, "t", "q"), asked, keys, "t", "q", asof.STRETCH_S)
    both = at_both_ends(at, [*keys, "frame"], "ab")
    rate = both.withColumn("v", Q.increment(F.col("b"), F.col("a"))).select(*keys, "frame", *((F.col(f"v.{a}") * fps).alias(f"r{a}") for a in "xyz"))
    d = pairs.join(rate, [*keys, "frame"])
    seen = F.col("sx").isNotNull() & F.col("sy").isNotNull() & F.col("sz").isNotNull() & (F.col("support") >= SUPPORT)
    busy = F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry") + F.col("rz") * F.col("rz"))
    d = d.withColumn("_busy", busy).withColumn("_ok", F.coalesce(seen, F.lit(False)))
    limit = d.groupBy(*keys).agg(F.when(F.count_if("_ok") > CALM_FROM, F.percentile(F.when(F.col("_ok"), F.col("_busy")), F.lit(CALM_SHARE))).otherwise(F.lit(float("inf"))).alias("_most"))
    d = d.join(F.broadcast(limit), keys).withColumn("_fit", F.col("_ok") & (F.col("_busy") <= F.col("_most")))
    maps = corrections.axis_map(d, keys, ["sx", "sy", "sz"], ["rx", "ry", "rz"], F.col("_fit"), 1, float("inf"))
    few = F.col("n") < FIT_PAIRS
    maps = maps.select(*keys, F.when(few, F.raise_error(F.lit("too few pairs to fit the axes")).cast("array<int>")).otherwise(F.col("p")).alias("p"), "s", "err")
    met = d.join(F.broadcast(maps), keys)
    return met.select(*keys, "frame", *((F.array("rx", "ry", "rz")[F.col("p")[j]] * F.col("s")[j]).alias(a) for j, a in enumerate("xyz")), "err")


# Least confidence of a picture's rates, seconds beside a window whose rates count, and of the running median that is their slow part.
CONFIDENCE, BESIDE_S, DETAIL_S = 0.20, 0.1, 0.12


def detail_targets(samples: DataFrame, windows: DataFrame, rates: DataFrame, maps: DataFrame, keys: list[str], dt: float, offset: float = 0.0, ends: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(targets, windows): an attitude for each sample in a window whose motion has the detail that pictures show, and ends where it did.

    samples: keys, t (seconds) and q; windows: keys, run, lo and hi; rates: keys, frame, t, gx, gy, gz (told) and sx, sy, sz (seen, degrees a second
    in the pictures' axes, null where unknown) and confidence, dt apart and told `offset` seconds after t; maps: keys, p and s, the signed order of axes of
    session_rates(). What is told less its running median gives way to what is seen less its own; the rates at the window's samples are
    taken on lines between those with confidence, summed up as rotations from the attitude at lo, and what is missing at hi is blended in
    smoothly. With fewer than two such rates the target is the shortest arc between both ends.

    ends: as context_curves() takes them. targets: keys, run, t and q. windows: keys, run, method (detail or bridge), used (rates) and drift (degrees
    at hi; null of a bridge). Both are parts of one table, which is kept.
    """
    size = max(3, round(DETAIL_S / dt))
    size += size % 2 == 0
    told, seen = [f"g{a}" for a in "xyz"], [f"s{a}" for a in "xyz"]
    slow = rates.select(*keys, "frame", *(F.col(c).alias(f"_o_{c}") for c in (*told, *seen)), "t", "confidence", *told, *seen)
    d = corrections.details(slow, keys, "frame", [*told, *seen], size).join(F.broadcast(maps.select(*keys, "p", "s")), keys)
    common = [F.col(f"_o_{g}") + F.col(s) - F.col(g) for g, s in zip(told, seen)]
    raw = [sum((F.when(F.col("p")[j] == k, common[j] / F.col("s")[j]).otherwise(0.0) for j in range(3)), F.lit(0.0)) for k in range(3)]
    known = d.select(*keys, "t", *(c.alias(f"r{a}") for c, a in zip(raw, "xyz")), "confidence").where(F.col("confidence") >= CONFIDENCE).dropna()
    ends = span_ends(samples, windows, keys) if ends is None else windows.select(*keys, "run").join(ends, [*keys, "run"])
    near = windows.select(*keys, "run", (F.col("lo") - BESIDE_S).alias("_from"), (F.col("hi") + BESIDE_S).alias("_to"))
    have = G.within(known, near, keys, "t", "_from", "_to", 1.0).select(*keys, "run", F.lit(0).alias("kind"), (F.col("t") + offset).alias("at"), "rx", "ry", "rz")
    inner = G.within(samples.select(*keys, "t"), windows.select(*keys, "run", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), keys, "t", "_lo", "_hi", 1.0)
    none = [F.lit(None).cast("double").alias(f"r{a}") for a in "xyz"]
    grid = inner.select(*keys, "run", F.lit(1).alias("kind"), F.col("t").alias("at"), *none).union(ends.select(*keys, "run", F.lit(2).alias("kind"), F.col("lo"), *none))
    rows = have.union(grid).join(ends, [*keys, "run"]).select(*keys, "run", "kind", "at", "rx", "ry", "rz", "lo", "hi", *(F.col(f"q{k}.{p}").alias(f"q{k}{p}") for k in (0, 1) for p in Q.PARTS))

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        parts = []
        for i, j in zip(starts, np.append(starts[1:], table.num_rows)):
            group = table.slice(i, j - i)
            kind, at = group["kind"].to_numpy(), group["at"].to_numpy()
            lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
            q0, q1 = (np.array([[group[f"q{k}{p}"][0].as_py() for p in Q.PARTS]]) for k in (0, 1))
            t, given = at[kind == 1], at[kind == 0]
            whole = np.concatenate([[lo], t, [hi]])
            u = ((whole - lo) / (hi - lo) if hi > lo else np.zeros(len(whole)))[:, None]
            drift = None
            if len(given) >= 2:
                rate = np.column_stack([np.interp(whole, given, group[f"r{a}"].to_numpy()[kind == 0]) for a in "xyz"])
                steps = _exp(-(rate[:-1] + rate[1:]) / 2 * np.diff(whole)[:, None])
                path = [q0[0]]
                for s in steps:  # a window's samples
                    q = _mul(path[-1][None], s[None])[0]
                    path.append(q / np.linalg.norm(q))
                path = np.array(path)
                missing = _log(_mul(_inverse(path[-1:]), q1))
                drift = float(np.linalg.norm(missing))
                path = _mul(path, _exp(u * u * (3 - 2 * u) * missing))
            else:
                path = _mul(np.repeat(q0, len(whole), 0), _exp(_log(_mul(_inverse(q0), q1)) * u))
            # a row for each sample, and one without an instant for the window itself
            path = path[1:-1] / np.linalg.norm(path[1:-1], axis=1, keepdims=True)
            head = group.select([*keys, "run"]).take(pa.array([0] * (len(t) + 1)))
            values = {"t": [*t.tolist(), None], **{p: [*x.tolist(), None] for p, x in zip(Q.PARTS, path.T)}, "used": [len(given)] * (len(t) + 1), "drift": [drift] * (len(t) + 1)}
            for name, x in values.items():
                head = head.append_column(name, pa.array(x, pa.int64() if name == "used" else pa.float64()))
            parts.append(head)
        return pa.concat_tables(parts)

    types = ", ".join(f"`{k}` {dict(windows.dtypes)[k]}" for k in (*keys, "run"))
    found = kept(whole_groups(rows, [*keys, "run"], ["kind", "at"], run, f"{types}, t double, w double, x double, y double, z double, used long, drift double"))
    told_windows = found.where("t is null").select(*keys, "run", F.when(F.col("used") >= 2, "detail").otherwise("bridge").alias("method"), "used", "drift")
    return found.where("t is not null").select(*keys, "run", "t", Q.quat(*(F.col(p) for p in Q.PARTS)).alias("q")), told_windows
