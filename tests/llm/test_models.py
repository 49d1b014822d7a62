import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import hmm, token_counts, toxicity
from tidemark.llm import words as W

SF = "/root/testdata/sf0.01"


def test_ftrl_is_sparse_and_learns():
    draw = np.random.default_rng(0)
    model = toxicity.Ftrl(bits=10)
    for _ in range(2000):
        label = int(draw.random() < 0.3)
        model.learn(np.unique(np.append(draw.integers(10, 1024, 20), 5 if label else 6)), label)
    w = model.weights(np.arange(1024))
    assert w[5] > 1 and w[6] < -1 and np.count_nonzero(w) < 300


def test_held_out_toxicity(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    rank, pos = found["score"].rank(), found["toxic"] == 1
    n1, n0 = pos.sum(), (~pos).sum()
    assert (rank[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.95
    assert found[~pos]["predicted"].mean() < 0.01


def test_toxicity_of_odd_rows(spark, docs):
    table = docs([(1, None), (2, ""), (None, "a b"), (3, "x"), (3, "x"), (4, "word " * 20000)])
    labels = spark.createDataFrame([(3, 1), (None, 1), (4, 0), (4, 0)], "doc_id long, toxic int")
    found = toxicity.toxicity(table, labels).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2)}) == 1
    assert toxicity.toxicity(table.limit(0), labels.limit(0)).count() == 0


def test_weights_and_scores_match_a_plain_learner(docs, spark):
    """FTRL-proximal coordinate by coordinate; repeated rows of an id are one row to it."""
    draw = np.random.default_rng(4)
    words = [f"v{i}" for i in range(30)]
    rows = [(i, " ".join(draw.choice(words, 12)) + (" bad worse" if i % 3 == 0 else "")) for i in range(300)]
    labels = [(i, int(i % 3 == 0)) for i in range(300)]
    table = docs(rows + rows[:40] * 3 + [(None, "bad"), (999, None)])
    marked = spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, toxic int, text string")
    at, w = toxicity.train(table, marked)

    def own(text):
        (c,) = W.chunks(pa.array([text], pa.string()), lower=True, marks=True)
        return toxicity.features(c)[0].tolist()

    z, n = collections.Counter(), collections.Counter()

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    learn = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    for epoch in range(toxicity.EPOCHS):
        turn = lambda i: int(W.mix(np.array([i], np.uint64), np.array([epoch + 1], np.uint64))[0])
        for i in sorted(learn, key=lambda i: (turn(i), i)):
            x = own(rows[i][1])
            g = 1 / (1 + math.exp(-sum(map(weight, x)))) - labels[i][1]
            for k, v in [(k, weight(k)) for k in x]:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / toxicity.ALPHA * v
                n[k] += g * g
    told = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(at.tolist(), w.tolist())) == pytest.approx(told) and told
    found = toxicity.toxicity(table, marked).collect()
    assert len(found) == len(rows) + 122
    text = dict(rows) | {None: "bad", 999: None}
    for r in found:
        score = 1 / (1 + math.exp(-sum(told.get(i, 0.0) for i in own(text[r.doc_id]))))
        assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def test_language_model_counts_and_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: lower(r.text).split() + [None] for r in docs.collect()}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    count = collections.Counter(w for d in texts for w in texts[d] if not out[d])
    total, kinds = sum(count.values()), len(count)
    found = {r.doc_id: r for r in hmm.language_model_scores(docs).collect()}
    assert found.keys() == texts.keys()
    for d, r in found.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[d], len(texts[d]), sum(count[w] > 0 for w in texts[d]), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in texts[d]))
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_of_odd_rows(docs):
    table = docs([(1, None), (2, ""), (None, "A b"), (3, "a b c"), (3, "a b c"), (4, "w " * 5000)])
    found = hmm.language_model_scores(table, states=2, rounds=1).collect()
    assert sorted(r.n_tokens for r in found) == [1, 1, 3, 4, 4, 5001] and all(math.isfinite(r.score) for r in found)
    assert hmm.language_model_scores(table.limit(0), states=2, rounds=1).count() == 0


def toy(states=3, classes=5):
    """A model over classes alone, and texts of 1 to 1500 of them."""
    draw = np.random.default_rng(0)
    none = np.zeros(0, np.uint64)
    counts = draw.integers(1, 1000, classes)
    pad = np.zeros(0, np.int64)
    model = hmm.Model(none, counts, pad, pad, 0, 0, draw.dirichlet(np.ones(states)), draw.dirichlet(np.ones(states), states), draw.dirichlet(np.ones(classes), states).T, none, pad)
    of = np.cumsum([0, 1, 3, 14, 42, 7, 1500, 1, 1500, 600])
    return model, draw.integers(0, classes, of[-1]), of


def passes(model, x):
    """Forward and backward of a text in plain scaled form, and its log likelihood."""
    emit, n, k = model.emit, len(x), len(model.start)
    ahead, back, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t in range(n):
        v = (model.start if t == 0 else ahead[t - 1] @ model.step) * emit[x[t]]
        scale[t] = v.sum()
        ahead[t] = v / scale[t]
    for t in range(n - 2, -1, -1):
        back[t] = model.step @ (emit[x[t + 1]] * back[t + 1]) / scale[t + 1]
    return ahead, back, scale, np.log(scale).sum()


def test_likelihood_and_expected_counts_are_exact():
    model, cls, of = toy()
    starts, steps, emissions, likely = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), []
    for i, j in zip(of, of[1:]):
        x = cls[i:j]
        ahead, back, scale, log = passes(model, x)
        likely.append(log)
        starts += ahead[0] * back[0]
        np.add.at(emissions, x, ahead * back)
        for t in range(1, len(x)):
            steps += np.outer(ahead[t - 1], model.emit[x[t]] * back[t] / scale[t]) * model.step
    assert hmm.log_likelihood(model, cls, of) == pytest.approx(likely)
    for a, b in zip(hmm.expected(model, cls, of), (starts, steps, emissions)):
        assert a == pytest.approx(b, rel=1e-3)
    assert [x.sum() for x in hmm.expected(model, cls[:0], of[:1])] == [0, 0, 0]


def test_a_text_counts_alike_alone_and_among_others():
    model, cls, of = toy()
    whole = hmm.expected(model, cls, of)
    each = [hmm.expected(model, cls[i:j], np.array([0, j - i])) for i, j in zip(of, of[1:])]
    for a, b in zip(whole, map(sum, zip(*each))):
        assert a == pytest.approx(b, rel=1e-4)


@pytest.mark.parametrize("known", [hmm.KNOWN, 1])  # all counts shared, and rare words by the join
def test_scores_of_a_table_match_brute_force(docs, monkeypatch, known):
    monkeypatch.setattr(hmm, "HEADS", 40)
    monkeypatch.setattr(hmm, "KNOWN", known)
    draw = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(draw.choice(words, draw.integers(0, 40), p=np.arange(1, 61) / 1830)) + f" only{i}") for i in range(60)] + [(100, "w1 w2 " * 1500), (None, "w3"), (101, None)]
    made, kept = [], hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a: made.append(kept(*a)) or made[-1])
    found = hmm.language_model_scores(docs(rows), states=3).collect()
    (model,) = made
    text = {d: lower(t).split() for d, t in rows}
    learn = [t for d, t in text.items() if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    count = collections.Counter(w for t in learn for w in [*t, None])
    heads = {w for w, c in count.items() if c * 40 >= sum(count.values()) or w is None}
    assert len(found) == len(rows) and len(heads) == len(model.heads) < len(count)

    def word_class(w):
        (c,) = W.chunks(pa.array([(w or b"").decode()]))
        h, tail, _ = hmm.with_ends(c)
        return int(model.classes(h, tail)[0])  # of the word, or of the end of a text without words

    size = collections.Counter()
    for w, c in count.items():
        if w not in heads:
            size[word_class(w)] += c + 1
    for r in found:
        t = [*text[r.doc_id], None]
        log = passes(model, [word_class(w) for w in t])[3] / math.log(10)
        log += sum(math.log10((count[w] + 1) / (size[word_class(w)] + 1)) for w in t if w not in heads)
        assert r.score == pytest.approx(log)
        assert r.n_known == sum(count[w] > 0 for w in t)


def test_without_training_texts_every_word_is_unknown(docs):
    out = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = hmm.language_model_scores(docs([(out, "a b")]), states=2, rounds=1).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(r.score)


def best_count(vocab, word):
    w, best = "▁" + word, [(0, 0)]
    for end in range(1, len(w) + 1):
        size = len(w[end - 1].encode())
        choices = [(best[end - 1][0] + size * vocab.byte_cost, best[end - 1][1] + size)]
        for k in range(1, min(end, vocab.longest) + 1):
            if (cost := vocab.pieces.get(w[end - k : end])) is not None:
                choices.append((best[end - k][0] + cost, best[end - k][1] + 1))
        best.append(min(choices))
    return best[-1][1]


def test_token_counts_match_brute_force(spark, docs):
    vocab = token_counts.vocabulary(token_counts.default_model())
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()] + ["", None, "日本語 x y", "z" * 500, "a\tb\nc"]
    found = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.token_counts(docs(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        words = [x.decode() for x in (text or "").encode().split()]
        assert found[i] == (len(words), sum(best_count(vocab, w) for w in words))
    assert token_counts.token_counts(docs([]).limit(0)).count() == 0


def test_features_are_distinct_and_bounded():
    (c,) = W.chunks(pa.array(["a b c a b", "", None, "a"]))
    at, bounds = toxicity.features(c)
    sizes = np.diff(bounds).tolist()
    assert sizes[1] == sizes[2] == 1 and sizes[3] == 2 and sizes[0] == 1 + 3 + 3 + 3
