"""Robust statistics and fits over groups of rows; exact percentiles throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A normal distribution's standard deviation over its median absolute deviation.
MAD_TO_SIGMA = 1.4826


def mad_scale(df: DataFrame, keys: list[str], value: str, floor: float = 0.0, name: str = "scale") -> DataFrame:
    """keys and name: 1.4826 times the median distance from the median, at least floor."""
    middle = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    off = df.select(*keys, value).join(middle, keys).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    return off.groupBy(*keys).agg(F.greatest(F.lit(float(floor)), MAD_TO_SIGMA * F.percentile("_d", F.lit(0.5))).alias(name))


def scalar_gain(df: DataFrame, keys: list[str], x: str, y: str, use: Column, least: int) -> DataFrame:
    """keys, gain (slope of y over x with an intercept), corr and n of the rows to use; gain 1 below `least` rows."""
    ok = use & F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    found = df.groupBy(*keys).agg(F.count(a).alias("n"), F.regr_slope(b, a).alias("_g"), F.corr(a, b).alias("_c"))
    enough = F.col("n") >= least
    return found.select(*keys, F.when(enough, F.col("_g")).otherwise(1.0).alias("gain"), F.when(enough, F.col("_c")).alias("corr"), "n")


def plane_fit(df: DataFrame, keys: list[str], xs: tuple[str, str, str], y: str) -> DataFrame:
    """keys and a, b, c of the least squares y = a*x0 + b*x1 + c*x2: nine sums and Cramer's rule."""
    sums = [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"s{i}{j}") for i, j in PLANE] + [F.sum(F.col(x) * F.col(y)).alias(f"t{i}") for i, x in enumerate(xs)]
    return plane_of(df.groupBy(*keys).agg(*sums), keys)


#: The products of two of three unknowns.
PLANE = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


def plane_of(s: DataFrame, keys: list[str]) -> DataFrame:
    """keys and a, b, c from a row of sums for each: of xi * xj as sij (PLANE), and of xi * y as ti."""
    m = [[F.col(f"s{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    t = [F.col(f"t{i}") for i in range(3)]

    def det(r) -> Column:
        return r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0]) + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])

    whole = det(m)
    part = lambda k: F.try_divide(det([[t[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]), whole)
    return s.select(*keys, *(part(k).alias(n) for k, n in enumerate("abc")))


def ranks(value: str, window) -> Column:
    """Ranks from 1 in the order of the window, ties at their mean; `window` is partitioned, without an order."""
    ordered = window.orderBy(value)
    ties = F.count(F.lit(1)).over(window.orderBy(value).rangeBetween(0, 0))
    return F.rank().over(ordered) + (ties - 1) / 2


def axis_fit(df: DataFrame, keys: list[str], xs: tuple[str, str, str], y: str, use: Column, least_corr: float, least: int = 200, otherwise: tuple[float, float, float] | None = None) -> DataFrame:
    """keys, ax, ay, az (of length one), gain, corr and n: the direction along which xs tell y, by least squares over the rows to use.

    With fewer than `least` rows, a gain of nothing or a correlation under least_corr it is the direction and length of `otherwise`, or null; corr
    stays what was found.
    """
    known = df.where(use & F.col(y).isNotNull())
    fit = plane_fit(known, keys, xs, y)
    predicted = sum((F.col(n) * F.col(x) for n, x in zip("abc", xs)), F.lit(0.0))
    told = known.join(fit, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(predicted, F.col(y)).alias("corr"), *(F.first(n).alias(n) for n in "abc"))
    every = df.select(*keys).distinct().join(told, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    length = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    good = (F.col("n") >= least) & (length >= 1e-9) & F.coalesce(F.col("corr") >= least_corr, F.lit(False))
    size = None if otherwise is None else sum(v * v for v in otherwise) ** 0.5
    other = [F.lit(None).cast("double")] * 3 if otherwise is None else [F.lit(v / size) for v in otherwise]
    axis = [F.when(good, F.col(n) / length).otherwise(o).alias(f"a{k}") for n, k, o in zip("abc", "xyz", other)]
    return every.select(*keys, *axis, F.when(good, length).otherwise(F.lit(size).cast("double")).alias("gain"), F.when(F.col("n") >= least, F.col("corr")).alias("corr"), "n")
