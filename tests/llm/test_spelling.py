import collections
import random
import re
import zlib

import pytest

from tidemark.llm import spelling

from .conftest import plain


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    out, form = [], {}
    for w in n:
        best = min(((-n[v], v) for v in n if near(w, v)), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], sum(near(w, v) for v in n), n[form[w]] if form[w] else None))
    return out


def rows(seed=3):
    draw = random.Random(seed)
    base = ["".join(draw.choice("abcéÿ") for _ in range(draw.randrange(6, 12))) for _ in range(40)]
    base += ["aaaaaaaa", "aaaaaaab", "aaaaaaa", "BAAAAAAA", "Àaaaaaaa", "xyzxyzxyz" * 30]
    often = {w: draw.choice([1, 3, 30, 300]) for w in base}
    texts = []
    for w in base:
        for _ in range(often[w]):
            v = list(w)
            if draw.random() < 0.05:
                v[draw.randrange(len(v))] = draw.choice(["", "b", "bb", "è"])
            texts.append("".join(v))
    draw.shuffle(texts)
    out = [(None if i % 50 == 7 else i % 90, draw.choice([" ", "-", "Ā", "7"]).join(texts[i : i + 9])) for i in range(0, len(texts), 9)]
    return out + [(1, None), (2, ""), (3, "1234567 ĀāĂăĄąĆ"), (4, "w" * 30_000 + " " + "w" * 30_000), (5, "w" * 29_999), (5, "w" * 29_999), *[(6, "Commons Common5 commonss commons")] * 3]


@pytest.mark.parametrize("group,bundle", [(1 << 20, 1 << 19), (400_000, 300), (40, 300)])  # one automaton, many, and large groups by gaps
def test_matches_brute_force(docs, monkeypatch, group, bundle):
    monkeypatch.setattr(spelling, "GROUP_SIZE", group)
    monkeypatch.setattr(spelling, "BUNDLE_SIZE", bundle)
    table = [r for r in rows() if group > 40 or len(r[1] or "") < 20_000]
    found = spelling.spelling_variants(docs(table)).collect()
    assert plain(found) == plain(brute(table))


def test_automaton_numbers_words_and_is_minimal():
    words = sorted(x.encode() for x in ("tap", "taps", "top", "tops", "stop", "stops"))
    found = spelling.Automaton(words)
    assert found.states == 7  # root, s, t, a and o in one, p, its end, and the end after s
    for i, w in enumerate(words):
        state, number = found.start, 0
        for c in w:
            edge = int(found.step(*(spelling.np.array([x]) for x in (state, c)))[0])
            state, number = int(found.target[edge]), number + int(found.passed[edge])
        assert found.final[state] and number == i


def test_empty(docs):
    assert spelling.spelling_variants(docs([])).collect() == []
    assert spelling.spelling_variants(docs([(1, None), (2, "singular words here")])).collect() == []
