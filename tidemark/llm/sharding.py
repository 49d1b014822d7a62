"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard has VNODES points on the ring. A key belongs to the shard of the next point clockwise; if that
shard is full it goes on to the next shard on the ring that is not. Keys arrive in the order of a hash, dealt
into ``buckets`` of arrival for each arc of the ring, so what the driver decides on - how many keys of each
cell of arc and bucket go to which shard - is a table of arcs * buckets counts whatever the number of keys.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import bounded_batches, written

SHARDS, VNODES, BUCKETS = 8, 128, 32
#: Copies of one row that a task gives out at once.
COPIES = 50_000


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) of all points in the order of the ring; places are signed 64-bit."""
    at = lambda s, v: int.from_bytes(hashlib.md5(f"shard {s} point {v}".encode()).digest()[:8], "big", signed=True)
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def clockwise(points: list[tuple[int, int]], arc: int) -> list[int]:
    """The different shards in the order in which a key of this arc meets them; arc k ends at point k."""
    met = dict.fromkeys(points[(arc + k) % len(points)][1] for k in range(len(points)))
    return list(met)


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """What each shard may hold. Without slack they add up to the total and differ by one at most."""
    if slack:
        return [-int(-total * (1 + slack) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def plan(cells: list[tuple[int, int, int]], points: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, bucket, shard, from, to): which stretch of each cell's weight goes where.

    cells: (arc, bucket, weight). Buckets arrive in order, arcs within them too.
    """
    room, orders, out = list(room), {}, []
    for arc, bucket, weight in sorted(cells, key=lambda x: (x[1], x[0])):
        if arc not in orders:
            orders[arc] = clockwise(points, arc)
        at = 0
        for shard in orders[arc]:
            part = min(room[shard], weight - at)
            if part > 0:
                out.append((arc, bucket, shard, at, at + part))
                room[shard] -= part
                at += part
            if at == weight:
                break
    return out


def arc_of(place: Column, points: list[tuple[int, int]]) -> Column:
    ends = np.array([x[0] for x in points])

    @F.pandas_udf("int")
    def found(x: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(ends, x.to_numpy(np.int64), "left") % len(ends)).astype(np.int32))

    return found(place)


def assigned(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, law: str = "rows", slack: float = 0.0, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of docs.

    law: ``rows`` bounds each shard's number of rows, ``bytes`` its bytes (UTF-8 of the text, plus 1 for each
    row). Without slack, counts differ by one at most; bytes by no more than one document for each cell that
    is cut. slot counts a shard's rows from 0. A null text has no bytes; rows without a doc_id go by their
    text; repeated rows are placed each, in any order; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    points = ring(shards, vnodes)
    data = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    slim = slim.withColumn("turn", F.xxhash64("doc_id", "text_crc32", "size", F.lit(1))).withColumn("arc", arc_of(place, points))
    slim = slim.withColumn("bucket", F.pmod("turn", F.lit(buckets)).cast("int")).withColumn("weight", F.lit(1).cast("long") if law == "rows" else F.col("size"))
    # rows that are equal in all of this are one with a number of copies, so that no cell is larger than its different rows
    own = ["doc_id", "size", "text_crc32", "turn", "arc", "bucket", "weight"]
    slim = written(slim.groupBy(*own).agg(F.count(F.lit(1)).alias("copies")), "shard-keys")

    cells = [tuple(x) for x in slim.groupBy("arc", "bucket").agg(F.sum(F.col("weight") * F.col("copies"))).toLocalIterator()]  # arcs * buckets rows at most
    parts = plan(cells, points, capacities(sum(x[2] for x in cells), shards, slack))
    parts_df = spark.createDataFrame(parts, "arc int, bucket int, shard int, low long, high long")
    in_cell = Window.partitionBy("arc", "bucket").orderBy("turn", "doc_id", "text_crc32", "size")
    before = F.sum(F.col("weight") * F.col("copies")).over(in_cell.rowsBetween(Window.unboundedPreceding, -1))
    running = slim.withColumn("before", F.coalesce(before, F.lit(0)))
    # copies of a row whose weight begins in a part belong to it
    first_from = lambda edge: F.greatest(F.lit(0), F.least(F.col("copies"), F.expr(f"({edge} - before + weight - 1) div weight")))
    met = running.join(F.broadcast(parts_df), ["arc", "bucket"]).where("low < before + weight * copies and high > before").withColumn("n", first_from("high") - first_from("low")).where("n > 0")
    met = written(met.select("doc_id", "size", "text_crc32", "turn", "arc", "bucket", "shard", "n"), "shard-rows")

    counts = sorted((tuple(x) for x in met.groupBy("shard", "bucket", "arc").agg(F.sum("n")).toLocalIterator()))  # a few more than cells
    starts = []
    for _, group in groupby(counts, key=lambda x: x[0]):
        at = 0
        for s, b, a, n in group:
            starts.append((s, b, a, at))
            at += n
    starts_df = spark.createDataFrame(starts, "shard int, bucket int, arc int, first long")
    in_part = Window.partitionBy("arc", "bucket", "shard").orderBy("turn", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = met.withColumn("before", F.coalesce(F.sum("n").over(in_part), F.lit(0))).join(F.broadcast(starts_df), ["shard", "bucket", "arc"])
    placed = placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("before")).alias("at"), "n")
    many = placed.where(F.col("n") > COPIES).select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")).alias("block"))
    many = many.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("block") * COPIES).alias("at"), F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("block") * COPIES).alias("n"))
    every = placed.where(F.col("n") <= COPIES).union(many.repartition("at"))
    return every.select("doc_id", "size", "text_crc32", "shard", F.explode(F.expr("sequence(at, at + n - 1)")).alias("slot"))


def sharded(docs: DataFrame) -> DataFrame:
    """assigned() by the law of equal counts, with the columns of the shard report."""
    found = assigned(docs, law="rows")
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
