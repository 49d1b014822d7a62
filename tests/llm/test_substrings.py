import collections
import hashlib
import random

import pytest

from tidemark.llm import substrings

from .conftest import plain


def brute(rows, size):
    all_ = [(text or "").encode().split() for _, text in rows]
    count = collections.Counter(tuple(w[i : i + size]) for w in all_ for i in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(rows, all_):
        gone = {i + k for i in range(len(w) - size + 1) if count[tuple(w[i : i + size])] > 1 for k in range(size)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def rows(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    out = [(1, None), (2, ""), (3, "a " * 300), (4, "b " * 40), (5, "a " * 36), (6, "x y " * 60), (7, "x y " * 25), (8, " ".join(words)), (8, " ".join(words)), (None, "q " + " ".join(words))]
    passages = [[draw.choice(words) for _ in range(draw.randint(30, 90))] for _ in range(8)]
    for i in range(120):
        text = []
        for _ in range(draw.randint(0, 4)):
            if draw.random() < 0.5:
                text.append(" ".join(draw.choice(words) for _ in range(draw.randint(1, 60))))
            else:
                p = draw.choice(passages)
                text.append(" ".join(p[draw.randint(0, 10) : len(p) - draw.randint(0, 10)]))
        out.append((100 + i, "\n".join(text)))
    return out


@pytest.mark.parametrize("size", [35, 8])
def test_matches_brute_force(docs, size):
    found = substrings.digests(docs(rows(size)), size).collect()
    assert plain(found) == plain(brute(rows(size), size))


def test_cut_texts_keep_columns_and_clean_rows(docs):
    passage = " ".join(f"p{i}" for i in range(50))
    table = docs([(1, f"one\ntwo  {passage} three"), (2, f"{passage} four"), (3, "clean\n\ntext  here"), (4, None)])
    cut = substrings.cut_texts(table)
    assert cut.columns == table.columns and cut.dtypes == table.dtypes
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "one two three", 2: "four", 3: "clean\n\ntext  here", 4: None}
    assert substrings.digests(table.limit(0)).count() == 0
