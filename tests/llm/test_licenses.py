import math
import random
import re

from tidemark.llm import licenses

from .conftest import plain


def brute(rows):
    out = []
    for doc, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places, base, labels, share = [], set(), set(), 0.0
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        b = 0
        while True:
            block = set(words[b : b + licenses.BLOCK])
            for template, label in licenses.TEMPLATES:
                t = set(template.split())
                if len(t & block) >= math.ceil(licenses.CONTAINMENT * len(t) - 1e-9):
                    labels.add(label)
                    share = max(share, len(t & block) / len(t))
            if b + licenses.BLOCK >= len(words):
                break
            b += licenses.STEP
        out.append((doc, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else share))
    return out


def rows():
    draw = random.Random(6)
    fill = [f"w{i}" for i in range(50)] + ["the", "license", "of", "under", "software", "cc", "by", "version"]
    out = [(1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (None, "CC-BY-NC; cc by nc by nc, CC\x00by/nc"), (5, "apache license version 2 apache license, version 2.0"), (6, "license mit the under"), (7, "é under the mit licenseé"), (8, "the " * 40_000 + "under the mit license"), (9, "mit"), (10, "under the mit"), (11, "2")]
    for i in range(120):
        words = [draw.choice(fill) for _ in range(draw.randrange(300))]
        for _ in range(draw.randrange(3)):
            t = draw.choice(licenses.TEMPLATES)[0].split()
            for _ in range(draw.randrange(4)):
                t[draw.randrange(len(t))] = "other"
            at = draw.randrange(len(words) + 1)
            words[at:at] = [x.upper() for x in t]
        out.append((100 + i, draw.choice([" ", ", ", "\n"]).join(words)))
    return out


def test_matches_brute_force(docs):
    assert plain(licenses.license_scan(docs(rows())).collect()) == plain(brute(rows()))


def test_blocks_are_whole_and_told_once(docs):
    text = "x " * 30 + "This work is licensed under the GNU General Public License, version 3 " + "y " * 100
    found = licenses.license_blocks(docs([(1, text), (1, text), (2, "gnu")])).collect()
    at = [i for i in range(0, 143, licenses.STEP) if i <= 33 and i + licenses.BLOCK >= 42]
    assert plain(found) == plain([(1, b, 6, "gpl-3", 1.0) for b in at for _ in range(2)])


def test_no_python_in_the_plan(docs):
    plan = licenses.license_scan(docs(rows()[:9]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty(docs):
    assert licenses.license_scan(docs([])).collect() == []
