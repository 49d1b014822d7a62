import random

import pytest

from tidemark.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, v string, dist string"


def brute(rows, every=3, positives=5, count=10):
    fine = [(i, [int(256 * x // 1) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and abs(x) < negatives.LARGEST / 256 for x in v)]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for i, v, label in fine:
        if i % every:
            continue
        own = sorted((-score(v, w), j) for j, w, other in fine if other == label and j != i)[:positives]
        rest = sorted((-score(v, w), j) for j, w, other in fine if other != label)
        for ps, p in own:
            found = [(s, j) for s, j in rest if 30 * -ps <= 100 * -s <= 90 * -ps][:count]
            out += [(i, p, k + 1, j, -ps, -s) for k, (s, j) in enumerate(found)]
    return sorted(out)


def table(seed, n=160, width=6, spread=4):
    draw = random.Random(seed)
    rows = [(i, [round(draw.uniform(-1, 1) * draw.choice([0.5, 1, 2]), draw.choice([1, spread])) for _ in range(width)], draw.randrange(3)) for i in range(n)]
    rows += [(n + i, rows[5][1], rows[5][2]) for i in range(40)]  # a third vector of many copies
    rows += [(n + 50, None, 1), (n + 51, [0.1, None], 1), (n + 52, [float("nan")] * width, 1), (n + 53, [float("inf")] * width, 2), (n + 54, [0.5] * width, None), (None, [0.5] * width, 1)]
    rows += [(n + 55, [], 1), (n + 56, [0.7, -0.2], 2), (n + 57, [9e9] * width, 0), (-3, [0.4] * width, 0), (3, [0.3] * width, 1), (3, [0.3] * width, 1)]
    return rows


def made(spark, rows):
    return spark.createDataFrame([(*r, "extra", "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("tile,block", [(64, 4 << 20), (3, 500)])  # one block of anchors, then many of a few
def test_matches_all_pairs(spark, monkeypatch, tile, block):
    monkeypatch.setattr(negatives, "TILE", tile)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", block)
    rows = table(4)
    if block == 500:
        rows = rows[:60]
    found = negatives.hard_negatives(negatives.usable(made(spark, rows)), every=9)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, every=9)


def test_scores_beyond_doubles_are_exact(spark):
    draw = random.Random(8)
    rows = [(i, [draw.randrange(20000, 32000) + 0.5 for _ in range(9000)], i % 2) for i in range(10)]
    found = negatives.hard_negatives(negatives.usable(made(spark, rows)))
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, every=100)


def test_empty_and_without_anchors(spark):
    assert negatives.hard_negatives(negatives.usable(made(spark, []))).collect() == []
    assert negatives.hard_negatives(negatives.usable(made(spark, [(1, [0.5], 0), (2, [0.4], 1)]))).collect() == []


def test_brackets_hold_every_score_and_prune_clusters():
    import numpy as np

    draw = np.random.default_rng(2)
    centres = draw.normal(0, 100, (8, 5))
    v = np.floor(np.repeat(centres, 32, 0) + draw.normal(0, 3, (256, 5)))
    most = float((v * v).sum(1).max())
    pivots = negatives.choose_pivots(v[::4], most)
    dist = negatives._distances(v, np.sqrt(np.maximum(most - (v * v).sum(1), 0)), pivots)
    starts = np.arange(0, 256, 32)
    anchors = negatives._Anchors(np.arange(20), np.zeros(20), v[:20], pivots)
    least, largest = negatives._brackets(anchors.dist, np.minimum.reduceat(dist, starts), np.maximum.reduceat(dist, starts), anchors.square, most)
    score = (v[:20] @ v.T).reshape(20, 8, 32)
    assert (least <= score.min(2)).all() and (score.max(2) <= largest).all()
    best = np.sort(score.reshape(20, -1))[:, -10]
    assert (largest < best[:, None]).mean() > 0.5  # tiles that can't reach the best ten
