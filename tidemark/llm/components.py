"""Connected components of an undirected graph by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: Each round at least contracts every tree by a constant factor; a graph that needs more rounds is an error.
MAX_ROUNDS = 60


def _to_least(pairs: DataFrame) -> DataFrame:
    """src, dst and the least neighbour of src, itself included."""
    least = pairs.groupBy("src").agg(F.min("dst").alias("least")).select("src", F.least("src", "least").alias("least"))
    return pairs.join(least, "src")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """node and root (the least node of its component) for each node but the roots; edges: src and dst, long."""
    both = lambda e: e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    stars = written(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src > dst").distinct(), what)
    before = _state(stars)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        large = _to_least(both(stars)).where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()
        near = _to_least(large)
        small = near.where("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst")).union(near.select("src", F.col("least").alias("dst")))
        stars = written(small.distinct(), what)
        now = _state(stars)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"{what}: not connected after {MAX_ROUNDS} rounds")
    return stars.select(F.col("src").alias("node"), F.col("dst").alias("root"))
