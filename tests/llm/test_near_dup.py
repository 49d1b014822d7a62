import collections
import random

import pytest

from tidemark.llm import near_dup

from .conftest import plain


def brute(rows, least=0.8):
    sets = []
    for _, text in rows:
        w = (text or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and common >= least * (len(a) + len(sets[j]) - common) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least_id = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least_id[find(i)].append(doc)
    return [(doc, min(least_id[find(i)], default=None), links[i]) for i, (doc, _) in enumerate(rows)]


def rows():
    draw = random.Random(3)
    base = [f"w{draw.randrange(999)}" for _ in range(120)]
    out = [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, "x y"), (6, "x y"), (7, "x  y\n"), (None, "x y"), (None, "q r s t u v w"), (8, "b b b b b b b b"), (8, "b b b b b b b b"), (9, "z " * 5000)]
    for i in range(120):
        w = list(base)
        for _ in range(draw.randrange(5)):
            w[draw.randrange(len(w))] = draw.choice("abcdefgh") * 3
        out.append((100 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("bounds", [(1_000_000, 3000), (6000, 40), (400, 6)])  # whole groups, then blocks of them
def test_matches_brute_force(docs, monkeypatch, bounds):
    monkeypatch.setattr(near_dup, "ITEM_SHINGLES", bounds[0])
    monkeypatch.setattr(near_dup, "ITEM_NODES", bounds[1])
    found = near_dup.near_duplicates(docs(rows())).collect()
    assert plain(found) == plain(brute(rows()))


def test_few_texts_beyond_the_bound_are_counted_once(docs, monkeypatch):
    monkeypatch.setattr(near_dup, "ITEM_SHINGLES", 100)
    draw, table = random.Random(5), []
    for n in (2, 3, 4, 5) * 3:  # more blocks than texts, so some blocks of a bucket are empty
        base = [f"w{draw.randrange(10**6)}" for _ in range(130)]
        table += [(len(table) + i, " ".join([*base, f"end{i}"])) for i in range(n)]
    assert plain(near_dup.near_duplicates(docs(table)).collect()) == plain(brute(table))


def test_bounds_do_not_change_links(docs, monkeypatch):
    """Pairs near the threshold, found by two bands of four, so that many share no band: the same ones at any bound."""
    draw, table = random.Random(9), []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(90)]
        for _ in range(9):
            w = list(base)
            for _ in range(draw.choice((1, 2, 2, 3))):
                w[draw.randrange(90)] = f"x{draw.randrange(10**9)}"
            table.append((len(table), " ".join(w)))
    table += [(1000 + k, " ".join(f"c{i}" for i in range(k, k + 60))) for k in range(0, 120, 3)]  # a chain: buckets are smaller than its group
    monkeypatch.setattr(near_dup, "banding", lambda *a: (2, 4))
    found = []
    for bounds in ((1_000_000, 3000), (700, 8), (300, 4)):
        monkeypatch.setattr(near_dup, "ITEM_SHINGLES", bounds[0])
        monkeypatch.setattr(near_dup, "ITEM_NODES", bounds[1])
        found.append(plain(near_dup.near_duplicates(docs(table)).collect()))
    assert found[0] == found[1] == found[2]
    assert sum(r[2] for r in found[0]) < sum(r[2] for r in brute(table))


def test_measured_recall_of_links(docs):
    draw, table = random.Random(11), []
    for g in range(40):
        base = [f"g{g}w{k}" for k in range(200)]
        for _ in range(6):
            w = list(base)
            for _ in range(draw.choice((1, 2, 3, 4))):
                w[draw.randrange(200)] = f"x{draw.randrange(10**9)}"
            table.append((len(table), " ".join(w)))
    told, right = (sum(r[2] for r in x) for x in (near_dup.near_duplicates(docs(table)).collect(), brute(table)))
    assert right > 400 and 0.999 * right <= told <= right


def test_one_document_of_each_group_stays(docs):
    table = docs(rows())
    kept = near_dup.representatives(table)
    assert kept.columns == table.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({c for d, c, _ in brute(rows()) if d == c and d is not None})
    assert ids.count(None) == 2
    assert near_dup.near_duplicates(table.limit(0)).count() == 0


def test_each_class_keeps_a_row_where_ids_clash(docs):
    a, b, c = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    table = docs([(1, a), (1, b), (2, a), (3, b), (0, c), (1, c), (4, None), (4, ""), (1, a)])
    found = near_dup.representatives(table)
    assert found.columns == table.columns
    assert plain((r.doc_id, r.text) for r in found.collect()) == plain([(1, a), (1, b), (0, c), (4, None), (4, "")])


def test_banding_reaches_the_recall():
    bands, size = near_dup.banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**size) ** bands >= 0.9999


def test_representatives_with_any_columns_and_one_row_of_repeated_ones(spark):
    text = " ".join(f"w{i}" for i in range(30))
    names = "doc_id long, text string, _key string, _kept int, _kept_key int, key string, order int, row string, node int, `a.b` int, m map<string,int>"
    rows = [(1, text, f"k{i}", i, 7, "key", 9 - i, "row", i, i, {"x": i}) for i in range(6)] + [(2, text + " more", "k", 1, 1, "key", 1, "row", 1, 1, None), (None, "no id", "k", 1, 1, "key", 1, "row", 1, 1, None)]
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows, names).repartition(parts, "order")
        found = near_dup.representatives(docs)
        assert found.columns == docs.columns
        assert sorted((r["doc_id"] or 0, r["_key"]) for r in found.collect()) == [(0, "k"), (1, "k0")]
