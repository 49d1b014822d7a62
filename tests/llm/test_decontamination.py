import random
import re

import pyarrow as pa

from tidemark.llm import decontamination as D
from tidemark.llm import words as W


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [x for x in re.split(r"[\x20\x09-\x0D!-/:-@\[-`{-~]+", low) if x]


def tiling(a, b, least):
    in_a, in_b, out = set(), set(), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in in_a and j + k not in in_b:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (i, j, k)
        if best is None:
            return out
        out.append(best)
        in_a.update(range(best[0], best[0] + best[2]))
        in_b.update(range(best[1], best[1] + best[2]))


def test_tiles_match_brute_force():
    draw = random.Random(5)
    for _ in range(150):
        letters = "a b c d e F. g,".split()[: draw.randint(2, 7)]
        items = [(i, " ".join(draw.choice(letters) for _ in range(draw.randint(0, 20)))) for i in range(4)]
        texts = [" ".join(draw.choice(letters) for _ in range(draw.randint(0, 25))) for _ in range(4)] + [items[0][1][10:] + " " + items[0][1][:10], None]
        block = D.Items.of_rows(items, 3)
        found = [(c.first + t, *rest) for c in W.chunks(pa.array(texts, pa.string()), lower=True, marks=True, size=60) for t, *rest in D.matches(c, block, 3, 0.5)]
        expected = []
        for t, text in enumerate(texts):
            for k, (_, item) in enumerate(items):
                marked = tiling(tokens(text), tokens(item), 3)
                covered, total = sum(x[2] for x in marked), len(tokens(item))
                if covered and covered >= 0.5 * total:
                    expected.append((t, k, covered, total, marked))
        assert found == expected


def test_both_ways_of_tiling_agree(monkeypatch):
    draw = random.Random(6)
    texts = [" ".join(draw.choice("ab" if i % 2 else "abcdefgh") for _ in range(draw.randint(0, 60))) for i in range(12)]
    items = [(i, " ".join(draw.choice("ab" if i % 2 else "abcdefgh") for _ in range(draw.randint(0, 40)))) for i in range(12)]
    found = []
    for pairs in (1 << 40, 0):
        monkeypatch.setattr(D, "PAIRS", pairs)
        found.append([x for c in W.chunks(pa.array(texts), lower=True, marks=True) for x in D.matches(c, D.Items.of_rows(items, 3), 3, 0.1)])
    assert found[0] == found[1] and len(found[0]) > 50


def test_a_word_that_fills_a_long_text_and_item():
    """20,000 times one word on both sides: 4e8 pairs of places, of which none is listed."""
    block = D.Items.of_rows([(1, "same " * 20000)], 5)
    (c,) = W.chunks(pa.array(["same " * 20010]), lower=True, marks=True)
    assert list(D.matches(c, block, 5, 0.5)) == [(0, 0, 20000, 20000, [(0, 0, 20000)])]


def test_leaks_and_clean(spark, docs, monkeypatch):
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(7, item), (8, None), (9, "short"), (None, "nothing like this anywhere in here at all")], "item_id long, text string")
    rows = [(1, f"before {item} after"), (2, "Six, seven; eight nine TEN. One two three four five!"), (3, "one two three four"), (4, None), (None, item), (5, ""), (5, "")]
    for size in (D.BLOCK_BYTES, 100):  # one block, then several
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        found = {(r.doc_id, r.item_id): r.coverage for r in D.leaks(docs(rows), items).collect()}
        assert found == {(1, 7): 1.0, (2, 7): 1.0, (None, 7): 1.0}
        left = D.clean(docs(rows), items)
        assert left.columns == docs(rows).columns
        assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 5]
    assert D.leaks(docs(rows), items.limit(0)).count() == 0 and D.leaks(docs(rows).limit(0), items).count() == 0


def test_repeated_items_do_not_fill_a_block(spark, docs, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    text = "one two three four five six seven"
    rows = [(7, text)] * 300 + [(i, f"other words {i} that nobody has ever read here") for i in range(100, 140)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    blocks = D._blocks(items)
    assert len(blocks) > 2 and max(b.count() for b in blocks) < 30
    found = D.leaks(docs([(1, text), (2, "none")]), items).collect()
    assert [(r.doc_id, r.item_id, r.coverage) for r in found] == [(1, 7, 1.0)] * 300
    assert [r.doc_id for r in D.clean(docs([(1, text), (2, "none")]), items).collect()] == [2]
