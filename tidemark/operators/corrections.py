"""Corrections put together from runs, windows and joins, and comparisons of two readings of a series."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quaternion as Q
from . import filters
from . import gates as G
from . import islands as I
from .windows import medians

#: Frames that a membership join looks at together.
STRETCH = 64


def spans(runs: DataFrame, df: DataFrame, keys: list[str], order: str, margin: int) -> DataFrame:
    """keys, run, a and b of runs with a margin, within the ends of their series."""
    ends = df.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    return runs.join(ends, keys).select(*keys, "run", F.greatest(F.col("first") - margin, F.col("_lo")).alias("a"), F.least(F.col("last") + margin, F.col("_hi")).alias("b"))


def burst_angle(df: DataFrame, keys: list[str], order: str, gap: str, rate: str, least: float, soft_rate: float, rate_max: float, margin: int, gap_rows: int) -> DataFrame:
    """keys, order and angle where bursts are: the summed disagreement of each, tapered, and nothing at its ends.

    Rows are in a burst if the disagreement is over `least` and the rate under rate_max; bursts fewer than
    gap_rows - 1 rows apart are one. The faster, the less of it counts. Where bursts overlap, their angles add up.
    """
    runs = I.islands(df.where((F.abs(gap) > least) & (F.col(rate) < rate_max)), keys, order, gap_rows - 1)
    soft = F.coalesce(F.col(gap), F.lit(0.0)) / (1 + F.pow(F.col(rate) / soft_rate, F.lit(2.0)))
    met = G.within(df.select(*keys, order, soft.alias("angle")), spans(runs, df, keys, order, margin), keys, order, "a", "b", STRETCH)
    return G.deramped(met, "angle", [*keys, "run"], order).groupBy(*keys, order).agg(F.sum("angle").alias("angle"))


def control_segments(df: DataFrame, busy: DataFrame, keys: list[str], order: str, length: int, step: int, edge: int, count: int) -> DataFrame:
    """keys, start and end of `count` stretches that no busy span (a, b) touches, spread evenly over those there are and
    not overlapping each other; order counts from 0."""
    ends = df.groupBy(*keys).agg(F.max(order).alias("_hi")).where(F.col("_hi") - edge - length >= edge)
    starts = ends.select(*keys, F.explode(F.sequence(F.lit(edge), (F.col("_hi") - edge - length).cast("int"), F.lit(step))).alias("start"))
    # a start is taken by a busy span if it lies from its first frame less the length to its last
    taken = G.within(starts, busy.select(*keys, (F.col("a") - length + 1).alias("a"), "b"), keys, "start", "a", "b", STRETCH).select(*keys, "start").distinct()
    free = starts.join(taken, [*keys, "start"], "left_anti")
    by = Window.partitionBy(*keys).orderBy("start")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    free = free.withColumn("_k", F.row_number().over(by) - 1).withColumn("_n", n)
    many = F.least(F.lit(count), F.col("_n"))
    place = lambda i: F.when(many > 1, F.bround(i * (F.col("_n") - 1) / (many - 1))).otherwise(0.0)
    picked = free.where(F.exists(F.sequence(F.lit(0), many - 1), lambda i: place(i) == F.col("_k")))
    # count is small: the rows that are picked go through one after another
    kept = picked.groupBy(*keys).agg(F.array_sort(F.collect_list("start")).alias("s"))
    apart = F.aggregate("s", F.array().cast("array<int>"), lambda out, s: F.when((F.size(out) == 0) | (s - F.try_element_at(out, F.lit(-1)) >= length), F.concat(out, F.array(s))).otherwise(out))
    return kept.select(*keys, F.explode(apart).alias("start")).withColumn("end", F.col("start") + length)


def block_bootstrap(df: DataFrame, keys: list[str], block: str, a: str, b: str, resamples: int) -> DataFrame:
    """keys, ratio (root of the sum of b over that of a), low, high (2.5 and 97.5 % of resamples of blocks) and mark.

    Which block a resample takes at each place is a hash of the two, so a run repeats another. The mark is + if all
    of the interval is below 0.97, - if it is above 1.03.
    """
    sums = df.groupBy(*keys, block).agg(F.sum(a).alias("a"), F.sum(b).alias("b"))
    n = sums.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("_j", F.row_number().over(Window.partitionBy(*keys).orderBy(block)) - 1)
    draw = n.select(*keys, "_n", "_j", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_r"))
    at = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("_r").cast("string"), F.col("_j").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("_n")
    # the draws are resamples times as many as the blocks: it is the blocks that the join holds, in parts, and neither side is broadcast
    blocks = n.select(*keys, F.col("_j").cast("long").alias("_j"), "a", "b").hint("shuffle_hash")
    met = draw.select(*keys, "_r", at.alias("_j")).join(blocks, [*keys, "_j"])
    each = met.groupBy(*keys, "_r").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select(*keys, F.sqrt(F.col("b") / F.greatest("a", F.lit(1e-12))).alias("v"))
    interval = each.groupBy(*keys).agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    whole = sums.groupBy(*keys).agg(F.sqrt(F.sum("b") / F.greatest(F.sum("a"), F.lit(1e-12))).alias("ratio"))
    low, high = F.col("p")[0], F.col("p")[1]
    return whole.join(interval, keys).select(*keys, "ratio", low.alias("low"), high.alias("high"), F.when(high < 0.97, "+").when(low > 1.03, "-").otherwise(" ").alias("mark"))


def whole(df: DataFrame, keys: list[str], order: str, axes: list[str]) -> DataFrame:
    """df with the gaps of all axes filled; an error where an axis has fewer than two values."""
    few = df.groupBy(*keys).agg(F.array_compact(F.array(*(F.when(F.count(a) < 2, F.lit(a)) for a in axes))).alias("_few"))
    told = F.raise_error(F.concat(F.lit("too few values on "), F.array_join("_few", ", "))).cast("double")
    full = medians(df, keys, order, 1, {f"_l_{a}": a for a in axes}, fill=True)
    # a row for each series is sent to all tasks, so that no task gets a whole series
    each = F.broadcast(few.select("_few", *(F.col(k).alias(f"_k_{k}") for k in keys)))
    met = full.join(each, reduce(Column.__and__, [F.equal_null(k, f"_k_{k}") for k in keys]))
    return met.select(*(F.when(F.size("_few") > 0, told).otherwise(F.col(f"_l_{c}")).alias(c) if c in axes else F.col(c) for c in df.columns))


def compared(want: DataFrame, found: DataFrame, keys: list[str], on: list[str], values: list[str], at: str) -> DataFrame:
    """keys, n, missing, extra, differ and shift: two tables matched row by row. shift is what `at` moved by, null if not
    all rows moved alike."""
    a = want.select(*keys, *on, F.col(at).alias("_a"), *(F.col(v).alias(f"_a_{v}") for v in values))
    b = found.select(*keys, *on, F.col(at).alias("_b"), *(F.col(v).alias(f"_b_{v}") for v in values))
    met = a.join(b, [*keys, *on], "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    same = F.lit(True)
    for v in values:
        same = same & F.equal_null(F.col(f"_a_{v}"), F.col(f"_b_{v}"))
    moved = F.when(both, F.col("_b") - F.col("_a"))
    return met.groupBy(*keys).agg(F.count_if(both).alias("n"), F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("extra"), F.count_if(both & ~same).alias("differ"), F.when(F.min(moved) == F.max(moved), F.min(moved)).alias("shift"))


def edited(samples: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """samples (keys, q, inverted) with the rotations of edits (keys, kind: stored, camera or angles, and a column of each),
    and whether there was one. Camera rotations and angles carry the sign of the series, which is undone where the
    sample was turned; edits that meet no sample are left out."""
    angles = Q.from_euler(F.col("angles.yaw"), F.col("angles.pitch"), F.col("angles.roll"))
    given = F.when(F.col("kind") == "angles", angles).otherwise(F.col("camera"))
    met = samples.join(edits, keys, "left").withColumn("_c", given)
    turned = F.when(F.col("inverted"), Q.negate(F.col("_c"))).otherwise(F.col("_c"))
    met = met.withColumn("_c", turned).withColumn("_s", Q.to_sensor(F.col("_c")))
    new = F.when(F.col("kind").isNull(), F.col("q")).when(F.col("kind") == "stored", F.col("stored")).otherwise(Q.normalized(F.col("_s")))
    return met.select(*keys, *(c for c in samples.columns if c not in (*keys, "q")), new.alias("q"), F.col("kind").isNotNull().alias("edited"))


def smoother(u: Column) -> Column:
    """From 0 to 1 with no slope and no bend at either end."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), u))
    return x * x * x * (x * (x * 6 - 15) + 10)


def bridged(df: DataFrame, keys: list[str], at: str, angles: list[str], fade: float) -> DataFrame:
    """df with angles (degrees) on a smooth bridge from the first to the last row of each span, on one branch of the circle."""
    own = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.select("*", F.first(at).over(own).alias("_t0"), F.last(at).over(own).alias("_t1"), *(x for n in angles for x in (F.first(n).over(own).alias(f"_a_{n}"), F.last(n).over(own).alias(f"_b_{n}"))))
    near = lambda v, base: base + F.pmod(v - base + 180, F.lit(360.0)) - 180
    blend = smoother((F.col(at) - F.col("_t0")) / (F.col("_t1") - F.col("_t0")))
    inner = F.least(F.col(at) - F.col("_t0"), F.col("_t1") - F.col(at))
    weight = smoother(inner / fade)

    def one(n: str) -> Column:
        a = F.col(f"_a_{n}")
        v, b = near(F.col(n), a), near(F.col(f"_b_{n}"), a)
        return F.when(inner > 0, v + weight * (a + blend * (b - a) - v)).otherwise(F.col(n)).alias(n)

    return d.select(*(one(c) if c in angles else F.col(c) for c in df.columns))


def details(df: DataFrame, keys: list[str], order: str, values: list[str], size: int, good: Column | None = None) -> DataFrame:
    """df with each value less the running median of `size` rows around it, of the values with gaps filled; null where the
    value is, or where good is not true."""
    use = F.lit(True) if good is None else good
    known = df.select("*", *(F.when(use, F.col(v)).alias(f"_r_{v}") for v in values))
    met = medians(known, keys, order, size, {f"_m_{v}": f"_r_{v}" for v in values}, fill=True)
    own = {v: (F.col(f"_r_{v}") - F.col(f"_m_{v}")).alias(v) for v in values}
    return met.select(*(own.get(c, F.col(c)) for c in df.columns))


def _norm(columns: list[Column]) -> Column:
    return F.sqrt(sum((F.coalesce(c, F.lit(0.0)) * F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0)))


def window_disagreement(df: DataFrame, keys: list[str], order: str, told: list[str], first: list[str], second: list[str], usable: Column, size: int, estimator: str = "mean") -> DataFrame:
    """keys, order, d_<axis> and reliable: how far two estimates of a motion together leave what was told of it.

    Each estimate's difference loses its slow part, a running median of size rows. The row is reliable if the two
    agree: they point the same way, and differ by at most 0.6 of the longer plus 0.3. The result is their
    mean, or the one that is longer (max) or shorter (min); null where a row is not usable.
    """
    if estimator not in ("mean", "max", "min"):
        raise ValueError("the estimator is mean, max or min")
    gaps = {f"{n}_{a}": F.col(e) - F.col(a) for n, es in (("_a", first), ("_b", second)) for e, a in zip(es, told)}
    ok = usable
    for e in (*first, *second):
        ok = ok & F.col(e).isNotNull()
    d = df.select(*keys, order, F.coalesce(ok, F.lit(False)).alias("_ok"), *(c.alias(n) for n, c in gaps.items()))
    d = details(d, keys, order, list(gaps), size, F.col("_ok"))
    a, b = ([F.col(f"{n}_{x}") for x in told] for n in ("_a", "_b"))
    na, nb, apart = _norm(a), _norm(b), _norm([x - y for x, y in zip(a, b)])
    same = sum((x * y for x, y in zip(a, b)), F.lit(0.0)) > 0
    reliable = F.col("_ok") & same & (apart <= 0.6 * F.greatest(na, nb) + 0.3)
    pick = {"mean": lambda x, y: (x + y) / 2, "max": lambda x, y: F.when(na >= nb, x).otherwise(y), "min": lambda x, y: F.when(na <= nb, x).otherwise(y)}[estimator]
    return d.select(*keys, order, *(pick(x, y).alias(f"d_{n}") for x, y, n in zip(a, b, told)), F.coalesce(reliable, F.lit(False)).alias("reliable"))


def event_windows(df: DataFrame, keys: list[str], order: str, least: int, merge: int, margin: int) -> DataFrame:
    """keys, run, a, b, first, last: the windows of events. df: rows with selected, spike and size (how large each is).

    Selected rows with at most two others between them are one event, if there are `least` of them or a spike is
    among them; events with fewer than `merge` rows between them are one, and all get a margin.
    """
    runs = I.islands(df.where("selected"), keys, order, 2, F.max("spike").alias("spike")).where((F.col("n") >= least) | F.col("spike"))
    joined = I.merged(runs, keys, merge - 1)
    numbered = joined.withColumn("run", F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1)
    return spans(numbered, df, keys, order, margin).join(numbered.select(*keys, "run", "first", "last"), [*keys, "run"])


def event_segments(
    df: DataFrame, keys: list[str], order: str, gaps: list[str], told: list[str], reliable: str, rate: str, least: float, size: int, ratio: float = 0.5, rate_max: float = 150.0, min_rows: int = 2, merge: int = 6, margin: int = 3,
    model: str = "image", context: int = 10, gain: float = 1.0, fine: list[str] | None = None, witness: list[str] | None = None, witnessed: str | None = None, camera: str | None = None, camera_max: float = 60.0,
    zero_net: bool = True, free: DataFrame | None = None, fps: float = 50.0, lowpass_hz: float = 8.0, pad_s: float = 2.0, keep: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(segments, events) of stretches where what was told of a motion and what was seen of it disagree.

    gaps: seen less told, of the axes in told, without the axis that is not to be touched. A row is selected if it is
    reliable, slower than rate_max (and camera, the rate without jumps, than camera_max), and its disagreement, less its slow
    part, is at least `least` and ratio times the motion itself; spikes (columns spike and contaminated of df) are selected too.

    image: the disagreement of each window under a taper, without its mean, so that nothing turns for good; rows that a
    spike contaminates, and spikes, add nothing, and a window with spikes keeps its mean over the other rows. fine: the same
    disagreement row by row, which counts in place of gaps where it is known; witness: a second one, which must then be known too and may
    differ from it by 0.5 + 0.5 times its length at most, where the column witnessed (none: everywhere) is true. Windows that begin or end in a span of
    free (keys, lo, hi; both inclusive), and all without zero_net, keep their mean.
    bridge: what was told becomes a straight line between the means of `context` rows before and after the window.
    lowpass: what was told is smoothed below lowpass_hz, on the window with pad_s on both sides, so each window is filtered by
    itself, of any series and however windows overlap.

    keep: what stores the rows of all windows, as both results rest on them.

    segments: keys, run, order and c_<axis>, of each window; events: keys, run, a, b, peak, mean_rate, spike, free_net.
    """
    if model not in ("image", "bridge", "lowpass"):
        raise ValueError("the model is image, bridge or lowpass")
    d = df
    if fine:
        d = d.select("*", *(F.col(f).alias(f"_f_{a}") for f, a in zip(fine, told)), *(F.coalesce(F.col(f), F.lit(0.0)).alias(f"_w_{a}") for f, a in zip(witness or [], told)))
        d = details(d, keys, order, [f"_{k}_{a}" for k in ("fw" if witness else "f") for a in told], size)
    d = details(d, keys, order, gaps, size)
    length, moved = _norm([F.col(g) for g in gaps]), _norm([F.col(a) for a in told])
    d = d.withColumn("size", length)
    known = F.lit(True)
    for g in gaps:
        known = known & F.col(g).isNotNull()
    chosen = F.col(reliable) & known & (F.col("size") >= least) & (F.col(rate) < rate_max) & (F.col("size") >= ratio * moved)
    if camera:
        chosen = chosen & (F.col(camera) < camera_max)
    d = d.withColumn("selected", F.coalesce(chosen, F.lit(False)) | F.col("spike"))
    windows = event_windows(d, keys, order, min_rows, merge, margin)
    if free is not None:
        near = [*keys, "run"]
        hit = F.lit(False)
        for at in (F.col("a"), F.col("b") + 1):
            hit = hit | ((at >= F.col("lo")) & (at <= F.col("hi")))
        windows = windows.join(windows.join(free, keys).where(hit).select(*near).distinct().withColumn("_free", F.lit(True)), near, "left")
    else:
        windows = windows.withColumn("_free", F.lit(False))
    windows = windows.withColumn("_free", F.coalesce("_free", F.lit(False)))
    reach = {"image": 0, "bridge": context, "lowpass": round(pad_s * fps)}[model]
    wide = windows.select("*", (F.col("a") - reach).alias("_lo"), (F.col("b") + reach).alias("_hi"))
    met = G.within(d, wide, keys, order, "_lo", "_hi", STRETCH)
    inside = F.col(order).between(F.col("a"), F.col("b"))
    rows = F.col("b") - F.col("a") + 1
    edge = F.least(F.lit(3), F.floor(rows / 2))
    soft = G.taper(F.col(order) - F.col("a"), rows, edge)
    one = Window.partitionBy(*keys, "run")
    if model == "image":
        trusted = F.lit(False)
        if fine:
            trusted = F.lit(True)
            for a in told:
                trusted = trusted & F.col(f"_f_{a}").isNotNull()
            if witness:
                seen = F.lit(True)
                for w in witness:
                    seen = seen & F.col(w).isNotNull()
                veto = _norm([F.col(f"_f_{a}") - F.col(f"_w_{a}") for a in told]) <= 0.5 + 0.5 * _norm([F.col(f"_f_{a}") for a in told])
                trusted = trusted & ((seen & veto) if witnessed is None else (~F.col(witnessed) | (seen & veto)))
        quiet = F.col("spike") | (F.col("contaminated") & ~trusted)
        value = {a: F.when(trusted, F.col(f"_f_{a}")).otherwise(F.coalesce(F.col(g), F.lit(0.0))) if fine else F.coalesce(F.col(g), F.lit(0.0)) for a, g in zip(told, gaps)}
        met = met.select("*", *((F.when(quiet, 0.0).otherwise(v) * soft * gain).alias(f"_s_{a}") for a, v in value.items()))
        # of a window's rows those that are no spikes share the mean that goes; without spikes these are all
        mean = lambda a: F.avg(F.when(~F.col("spike"), F.col(f"_s_{a}"))).over(one)
        goes = ~F.col("spike") & ~F.col("_free") if zero_net else F.lit(False)
        shared = [F.col(f"_s_{a}") - F.when(goes, mean(a)).otherwise(0.0) for a in told]
    elif model == "bridge":
        ends = []
        for a in told:
            before, after = (F.avg(F.when(side, F.col(a))).over(one) for side in (F.col(order) < F.col("a"), F.col(order) > F.col("b")))
            at_a, at_b = (F.max(F.when(F.col(order) == F.col(x), F.col(a))).over(one) for x in ("a", "b"))
            ends += [F.coalesce(before, at_a).alias(f"_u_{a}"), F.coalesce(after, at_b).alias(f"_v_{a}")]
        met = met.select("*", *ends)
        u = F.when(rows > 1, (F.col(order) - F.col("a")) / (rows - 1)).otherwise(0.0)
        shared = [(F.col(f"_u_{a}") + (F.col(f"_v_{a}") - F.col(f"_u_{a}")) * u - F.col(a)) * soft * gain for a in told]
    else:
        met = _smoothed(met, [*keys, "run"], order, told, filters.butterworth("low", lowpass_hz, fps))
        shared = [(F.col(f"_l_{a}") - F.col(a)) * soft * gain for a in told]
    own = F.col(order).between(F.col("first"), F.col("last"))
    rows = met.where(inside).select(*keys, "run", order, "a", "b", own.alias("_own"), "size", F.col(rate).alias("_rate"), "spike", "_free", *(c.alias(f"c_{a}") for c, a in zip(shared, told)))
    rows = keep(rows) if keep else rows
    events = rows.groupBy(*keys, "run", "a", "b").agg(F.max(F.when(F.col("_own"), F.col("size"))).alias("peak"), F.avg(F.when(F.col("_own"), F.col("_rate"))).alias("mean_rate"), F.max("spike").alias("spike"), F.max("_free").alias("_free"))
    events = events.select(*keys, "run", "a", "b", "peak", "mean_rate", "spike", (F.col("_free") | F.col("spike")).alias("free_net"))
    return rows.select(*keys, "run", order, *(f"c_{a}" for a in told)), events


def _smoothed(rows: DataFrame, keys: list[str], order: str, values: list[str], sections: list) -> DataFrame:
    """rows with _l_<value>: the values of each group (a padded window) forward and backward through the sections, nulls as zero."""
    schema = T.StructType([*rows.schema, *(T.StructField(f"_l_{v}", T.DoubleType()) for v in values)])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        for v in values:
            x = np.nan_to_num(table[v].cast(pa.float64()).to_numpy())
            table = table.append_column(f"_l_{v}", pa.array(filters.zero_phase(x, sections, 6 * len(sections) + 3)))
        return table

    return rows.groupBy(*keys).applyInArrow(run, schema)


def event_correction(df: DataFrame, keys: list[str], order: str, gaps: list[str], told: list[str], *args, **named) -> tuple[DataFrame, DataFrame]:
    """event_segments(), with the segments summed over windows: keys, order and c_<axis>."""
    segments, events = event_segments(df, keys, order, gaps, told, *args, **named)
    return segments.groupBy(*keys, order).agg(*(F.sum(f"c_{a}").alias(f"c_{a}") for a in told)), events


def event_checks(segments: DataFrame, seen: DataFrame, keys: list[str], order: str, told: list[str], also: list[str]) -> DataFrame:
    """keys, run, n, corr, gain and verdict of events whose correction can be held against a second estimate of the disagreement.

    Both are taken over all axes and rows of the event, the corrections as summed over events; rows where they are zero or the estimate is unknown
    don't count. Fewer than 6 rows, or one that does not vary, give no row. Over 0.5 confirms, under -0.3 opposes, else it is unclear.
    """
    total = segments.groupBy(*keys, order).agg(*(F.sum(f"c_{a}").alias(f"_c_{a}") for a in told))
    met = segments.select(*keys, "run", order).join(total, [*keys, order]).join(seen.select(*keys, order, *also), [*keys, order])
    pairs = F.explode(F.array(*(F.struct(F.col(f"_c_{a}").alias("c"), F.col(s).alias("s")) for a, s in zip(told, also))))
    p = met.select(*keys, "run", pairs.alias("p")).select(*keys, "run", "p.*").where("c <> 0 and s is not null")
    g = p.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n"), F.corr("c", "s").alias("corr"), (F.sum(F.col("c") * F.col("s")) / F.sum(F.col("c") * F.col("c"))).alias("gain"), F.stddev_pop("c").alias("_c"), F.stddev_pop("s").alias("_s"))
    verdict = F.when(F.col("corr") > 0.5, "confirmed").when(F.col("corr") < -0.3, "opposed").otherwise("unclear")
    return g.where("n >= 6 and _c >= 1e-9 and _s >= 1e-9").select(*keys, "run", "n", "corr", "gain", verdict.alias("verdict"))


def weighted_events(segments: DataFrame, events: DataFrame, checks: DataFrame, keys: list[str], order: str, told: list[str], unclear: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(corrections, events): segments summed by row with the weight of their event - 1 with a spike or confirmed, 0 if opposed, else `unclear`."""
    weight = F.when(F.col("spike") | (F.col("verdict") == "confirmed"), 1.0).when(F.col("verdict") == "opposed", 0.0).otherwise(unclear)
    told_events = events.join(checks.select(*keys, "run", "corr", "gain", "verdict"), [*keys, "run"], "left").withColumn("weight", weight)
    met = segments.join(told_events.select(*keys, "run", "weight"), [*keys, "run"])
    return met.groupBy(*keys, order).agg(*(F.sum(F.col("weight") * F.col(f"c_{a}")).alias(f"c_{a}") for a in told)), told_events


# The signed order of axes of the camera in the telemetry's frame.
AXIS_ORDER, AXIS_SIGNS = (0, 1, 2), (-1, 1, 1)


def axis_map(df: DataFrame, keys: list[str], told: list[str], seen: list[str], use: Column, least: int = 100, clear: float = 0.9) -> DataFrame:
    """keys, p (the axis of seen for each of told), s (its sign), err and n: the signed order of axes with the least mean distance.

    It is that of the rows to use if there are `least` of them and it is better than `clear` times the known one, AXIS_ORDER and
    AXIS_SIGNS; ties: the first of all orders and signs. err is null where it was not looked for.
    """
    maps = list(itertools.product(itertools.permutations(range(3)), itertools.product((1, -1), repeat=3)))
    distance = lambda p, s: F.sqrt(sum(((F.col(seen[p[j]]) * s[j] - F.col(told[j])) * (F.col(seen[p[j]]) * s[j] - F.col(told[j])) for j in range(3)), F.lit(0.0)))
    errors = F.array(*(F.avg(F.when(use, distance(p, s))) for p, s in maps))
    found = df.groupBy(*keys).agg(F.count_if(use).alias("n"), errors.alias("_e"))
    known = maps.index((AXIS_ORDER, AXIS_SIGNS))
    k = F.array_position("_e", F.array_min("_e")).cast("int") - 1
    k = F.when((F.col("n") >= least) & (F.array_min("_e") <= clear * F.col("_e")[known]), k).otherwise(known)
    table = F.array(*(F.struct(F.array(*map(F.lit, p)).alias("p"), F.array(*map(F.lit, s)).alias("s")) for p, s in maps))
    return found.select(*keys, "n", "_e", k.alias("_k")).select(*keys, table[F.col("_k")]["p"].alias("p"), table[F.col("_k")]["s"].alias("s"), F.when(F.col("n") >= least, F.col("_e")[F.col("_k")]).alias("err"), "n")
