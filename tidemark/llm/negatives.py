"""Hard negatives by a pivot table: which rows of another label score just below an anchor's best rows of its own label.

Scores are inner products of whole numbers. With M the largest norm, a vector x becomes (x, sqrt(M^2 - |x|^2)) and an anchor q
becomes (q, 0), so that their distance d has d^2 = |q|^2 + M^2 - 2 q.x: the nearer, the higher the score. The pivot table
holds the distances of each row from a few pivots. A tile is TILE rows that lie together, and for each pivot it has
an interval [low, high] of these distances; by the triangle inequality every row of the tile is at least
max(low - d(q, p), d(q, p) - high) and at most min(high + d(q, p)) away from the anchor, which brackets its scores. Anchors
meet the tiles whose bracket can still matter to them, and what survives is scored exactly.

Anchors come in blocks of bounded size, each broadcast and held against all rows twice: for the best rows of the own label, whose
scores limit those of the negatives, then for the negatives. Tasks keep the best rows so far and hand on a bounded number for an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import bounded_batches, new_path, written

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
#: Negatives score from LOW to HIGH hundredths of the positive.
LOW, HIGH = 30, 90
#: Pivots, and the rows of least hash that they are chosen from; both change the speed only, not the result.
PIVOTS, SAMPLE = 16, 2048
TILE = 64
#: Bytes of the anchors that are broadcast at once, and scores that are held at once.
BLOCK_BYTES, SCORES = 4 << 20, 1 << 21
#: Components at most, so that a score of up to 2^15 of them fits in a long.
LARGEST = 1 << 23


def usable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label (long) and v, the whole numbers floor(scale * x) of each component, of the rows that take part.

    A row whose vec_id, label or vector is null takes no part, nor does one with a component that is null, not finite or of
    LARGEST or more once scaled.
    """
    whole = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < LARGEST / scale), F.lit(False)))
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    plain = plain.where("vec_id is not null and label is not null and embedding is not null").where(fine)
    return plain.select("vec_id", "label", whole.cast("array<int>").alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of ints as rows of doubles, filled up with zeros."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat[offsets[0] : offsets[-1]]
    return out


def _distances(v: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each vector, with its extra coordinate, from each pivot."""
    square = (v * v).sum(1) + extra * extra
    to = (pivots * pivots).sum(1)
    return np.sqrt(np.maximum(square[:, None] + to - 2 * (v @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1]), 0))


def choose_pivots(sample: np.ndarray, most: float, count: int = PIVOTS) -> np.ndarray:
    """Pivots with their extra coordinate: each the row of the sample that is farthest from those before it."""
    if not len(sample):
        return np.zeros((0, sample.shape[1] + 1))
    full = np.hstack([sample, np.sqrt(np.maximum(most - (sample * sample).sum(1), 0))[:, None]])
    chosen, far = [0], np.full(len(full), np.inf)
    while len(chosen) < min(count, len(full)):
        far = np.minimum(far, ((full - full[chosen[-1]]) ** 2).sum(1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return full[chosen]


def pivot_table(rows: DataFrame, width: int, most: float, pivots: np.ndarray) -> DataFrame:
    """vec_id, label, v and dist (from each pivot) of rows of usable(), those near the same pivot and equally far from it together."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2), width)
            dist = _distances(v, np.sqrt(np.maximum(most - (v * v).sum(1), 0)), shared.value)
            cell = dist.argmin(1) if dist.shape[1] else np.zeros(len(v), int)
            away = dist[np.arange(len(v)), cell] if dist.shape[1] else np.zeros(len(v))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dist.shape[1]), pa.array(dist.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(cell.astype(np.int32)), pa.array(away)], names=["vec_id", "label", "v", "dist", "cell", "away"])

    table = rows.mapInArrow(run, "vec_id long, label long, v array<int>, dist array<double>, cell int, away double")
    return table.repartitionByRange("cell", "away", "vec_id").sortWithinPartitions("cell", "away", "vec_id").drop("cell", "away")


class _Best:
    """The k best (score, id) of each of n lists: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self) -> tuple[np.ndarray, np.ndarray]:
        return self.score[:, -1], self.id[:, -1]

    def add(self, of: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        lists, back = np.unique(of, return_inverse=True)
        k = self.k
        of = np.concatenate([np.repeat(np.arange(len(lists)), k), back])
        score = np.concatenate([self.score[lists].reshape(-1), score])
        id_ = np.concatenate([self.id[lists].reshape(-1), id_])
        order = np.lexsort((id_, ~score, of))  # ~score falls as score rises
        of, score, id_ = of[order], score[order], id_[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        kept = place < k
        self.score[lists] = score[kept].reshape(-1, k)
        self.id[lists] = id_[kept].reshape(-1, k)

    def rows(self) -> tuple[np.ndarray, ...]:
        of, place = np.nonzero(self.score > np.iinfo(np.int64).min)
        return of, self.score[of, place], self.id[of, place]


def _brackets(anchor_dist: np.ndarray, low: np.ndarray, high: np.ndarray, square: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score that a row of each tile can have with each anchor (anchors by tiles)."""
    least = np.zeros((len(anchor_dist), len(low)))
    largest = np.full_like(least, np.inf)
    for p in range(low.shape[1]):
        d = anchor_dist[:, p, None]
        np.maximum(least, np.maximum(low[:, p] - d, d - high[:, p]), out=least)
        np.minimum(largest, d + high[:, p], out=largest)
    total = square[:, None] + most
    slack = 1 + 1e-9 * total  # of the rounding of distances
    return (total - largest * largest) / 2 - slack, (total - least * least) / 2 + slack


class _Anchors:
    """A block of anchors, in the driver and by broadcast in the tasks."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, pivots: np.ndarray) -> None:
        self.id, self.label, self.v = ids, labels, v
        self.square = (v * v).sum(1)
        self.dist = _distances(v, np.zeros(len(v)), pivots)


def _tiles(batch: pa.RecordBatch, anchors: _Anchors, width: int, most: float, wanted) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Exact scores of the anchors and tiles that wanted(least, largest) leaves: the anchors' places, the rows' ids and labels, and the scores."""
    ids, labels, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), width)
    dist = batch.column(3)
    dist = dist.values.to_numpy()[dist.offsets[0].as_py() : dist.offsets[-1].as_py()].reshape(len(ids), -1)
    exact = width * max(np.abs(v).max(initial=0), 1) * max(np.abs(anchors.v).max(initial=0), 1) < 1 << 53
    starts = np.arange(0, len(ids), TILE)
    low, high = np.minimum.reduceat(dist, starts), np.maximum.reduceat(dist, starts)
    step = max(1, SCORES // max(1, len(anchors.id)) // TILE)
    for i in range(0, len(starts), step):
        least, largest = _brackets(anchors.dist, low[i : i + step], high[i : i + step], anchors.square, most)
        open_ = wanted(least, largest)
        who, tiles = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if len(who):
            at = (starts[i + tiles][:, None] + np.arange(TILE)).reshape(-1)
            at = at[at < len(ids)]
            score = anchors.v[who] @ v[at].T if exact else anchors.v[who].astype(np.int64) @ v[at].T.astype(np.int64)
            yield who, ids[at], labels[at], score.astype(np.int64)


def _better(score: np.ndarray, ids: np.ndarray, worst: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    least, least_id = worst[0][:, None], worst[1][:, None]
    return (score > least) | ((score == least) & (ids < least_id))


def _positives(shared, width: int, most: float, k: int):
    """For mapInArrow over the pivot table: the best k rows of an anchor's own label, in this task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: _Anchors = shared.value[0]
        best = _Best(len(anchors.id), k)
        for batch in batches:
            for who, ids, labels, score in _tiles(batch, anchors, width, most, lambda least, largest: largest >= best.score[:, -1:]):
                worst = best.worst()
                ok = _better(score, ids, (worst[0][who], worst[1][who])) & (labels == anchors.label[who][:, None]) & (ids != anchors.id[who][:, None])
                x, y = np.nonzero(ok)
                if len(x):
                    best.add(who[x], score[x, y], ids[y])
        of, score, ids = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(score), pa.array(ids)], names=["anchor", "score", "id"])

    return run


def _negatives(shared, width: int, most: float, k: int):
    """For mapInArrow over the pivot table: the best k rows of another label between the limits of each anchor and positive, in this task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, anchor, floor, ceiling = shared.value  # anchor: that of each list
        best = _Best(len(anchor), k)
        highest = np.full(len(anchors.id), -np.inf)
        np.maximum.at(highest, anchor, ceiling.astype(float))
        by_place = [np.flatnonzero(np.arange(len(anchor)) - np.searchsorted(anchor, anchor) == j) for j in range(int(np.bincount(anchor).max(initial=0)))]

        def wanted(least: np.ndarray, largest: np.ndarray) -> np.ndarray:
            needed = np.full(len(anchors.id), np.inf)
            np.minimum.at(needed, anchor, np.maximum(floor, best.score[:, -1]).astype(float))
            return (largest >= needed[:, None]) & (least <= highest[:, None])

        for batch in batches:
            for who, ids, labels, score in _tiles(batch, anchors, width, most, wanted):
                other = labels != anchors.label[who][:, None]
                place = np.full(len(anchors.id), -1)
                place[who] = np.arange(len(who))
                for lists in by_place:
                    lists = lists[place[anchor[lists]] >= 0]
                    at = place[anchor[lists]]
                    worst = best.worst()
                    mine = score[at]
                    ok = other[at] & (mine <= ceiling[lists][:, None]) & (mine >= floor[lists][:, None]) & _better(mine, ids, (worst[0][lists], worst[1][lists]))
                    x, y = np.nonzero(ok)
                    if len(x):
                        best.add(lists[x], mine[x, y], ids[y])
        of, score, ids = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(score), pa.array(ids)], names=["list", "score", "id"])

    return run


def _blocks(anchors: DataFrame, width: int, pivots: np.ndarray) -> Iterator[_Anchors]:
    """The anchors in blocks of BLOCK_BYTES; the driver holds one of them, and one partition of the anchors' table."""
    size, held = max(1, BLOCK_BYTES // (8 * (width + len(pivots)) + 48)), []

    def block(rows: list) -> _Anchors:
        v = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            v[i, : len(r["v"])] = r["v"]
        return _Anchors(np.array([r["vec_id"] for r in rows]), np.array([r["label"] for r in rows]), v, pivots)

    for row in anchors.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield block(held)
            held = []
    if held:
        yield block(held)


def _first(found: DataFrame, of: str, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(of).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score; rows: those of usable().

    Anchors are the rows whose vec_id is divisible by `every`; an anchor's positives are its best other rows of the same label, and each of
    them has the best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score. Of equal scores the
    smaller id comes first. A positive without such rows, or with a negative score, has none. A shorter vector is filled up with zeros. Rows that
    repeat a vec_id are rows of their own, but not positives of each other; each that is an anchor has its own rows. An empty table gives no rows.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    width, most = rows.agg(F.max(F.size("v")), F.max(square)).first()
    width, most = max(width or 0, 1), most or 0.0
    sample = rows.select(F.xxhash64("vec_id", "v").alias("h"), "v").orderBy("h").limit(SAMPLE).collect()
    matrix = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        matrix[i, : len(r["v"])] = r["v"]
    pivots = choose_pivots(matrix, most)
    table = written(pivot_table(rows, width, most, pivots), "negatives-pivots")
    anchors = written(table.where(F.col("vec_id") % every == 0).select("vec_id", "label", "v"), "negatives-anchors")

    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    paths = []
    for block in _blocks(anchors, width, pivots):
        shared = spark.sparkContext.broadcast((block,))
        found = table.mapInArrow(_positives(shared, width, most, positives), "anchor long, score long, id long")
        best = _first(found, "anchor", positives).toPandas().sort_values(["anchor", "rank"])  # `positives` rows for an anchor of the block
        best = best[best["score"] >= 0].reset_index(drop=True)
        shared.unpersist()
        lists = (best["anchor"].to_numpy().astype(np.int64), -(-low * best["score"].to_numpy() // 100), high * best["score"].to_numpy() // 100)
        limits = spark.sparkContext.broadcast((block, *lists))
        found = _first(table.mapInArrow(_negatives(limits, width, most, negatives), "list long, score long, id long"), "list", negatives)
        named = spark.createDataFrame(pd.DataFrame({"list": np.arange(len(best)), "anchor_id": block.id[lists[0]], "positive_id": best["id"].to_numpy(), "positive_score": best["score"].to_numpy()}), "list long, anchor_id long, positive_id long, positive_score long")
        paths.append(new_path(spark, "negatives"))
        found.join(named, "list").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(paths[-1])
        limits.unpersist()
    return spark.read.schema(out).parquet(*paths) if paths else spark.createDataFrame([], out)


def oracle_sql() -> str:
    """The query over the view embeddings by all pairs, for DuckDB; vec_id must be unique."""
    return """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
    n AS (SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
    SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 10
    """
