import collections
import random
import zlib

import duckdb
import numpy as np
import pytest
import tokenizers

import corpus_pipeline
from tidemark.llm import packing, quality

from .test_decontamination import tiling, tokens
from .test_near_dup import brute as near_brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"
ITEMS = [(1, " ".join(f"item{k}" for k in range(24))), (2, None), (3, "too short"), (4, " ".join(f"other{k % 9}" for k in range(30)))]


def rows():
    draw = random.Random(21)
    word = lambda: f"word{draw.randrange(4000)}"
    texts = [" ".join(word() for _ in range(draw.randint(60, 120))) for _ in range(70)]
    near = texts[0].split()
    near[30] = "changed"
    passage = " ".join(word() for _ in range(50))
    leak = ITEMS[0][1].split()
    texts += [" ".join(near), texts[1], texts[1] + " "]  # near and exact copies
    texts += [f"{texts[k]} {passage}\n{texts[k + 1][:200]}" for k in (10, 20)]  # a passage of two texts, and words of a third
    texts += [f"{texts[30]} {' '.join(leak[12:])} {texts[31]} {' '.join(leak[:12])}", f"{texts[32]} {' '.join(leak[:8])}"]
    texts += [None, "", "few words", "### $$$ " * 80, "again and again " * 40, "<|endoftext|> " + texts[33], "long " + " ".join(word() for _ in range(6000))]
    out = [(i, t, ("en", "de", None)[i % 3], ("web", "book")[i % 2], len(t or ""), False) for i, t in enumerate(texts)]
    draw.shuffle(out)
    return out


def kept_by_quality(own):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in own])
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality.oracle_sql()}) WHERE kept").fetchall()}
    return [r for r in own if r[0] in kept]


def one_of_each(own):
    stands = {d for d, c, _ in near_brute([r[:2] for r in own]) if d == c}
    return [r for r in own if r[0] in stands]


def without_windows(own, size=35):
    words = {r[0]: (r[1] or "").encode().split() for r in own}
    often = collections.Counter(tuple(w[i : i + size]) for w in words.values() for i in range(len(w) - size + 1))
    out = []
    for d, text, lang, source, n, kept in own:
        w = words[d]
        gone = {i + k for i in range(len(w) - size + 1) if often[tuple(w[i : i + size])] > 1 for k in range(size)}
        left = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else text
        out.append((d, left, lang, source, len(left or "") if left is not None else None, kept))
    return out


def without_leaks(own):
    def leaks(text):
        x = tokens(text)
        for _, item in ITEMS:
            y = tokens(item)
            # a text shares five words in a row with the item before it is worth tiling
            if not {tuple(x[i : i + 5]) for i in range(len(x) - 4)} & {tuple(y[i : i + 5]) for i in range(len(y) - 4)}:
                continue
            if sum(t[2] for t in tiling(x, y, 5)) >= 0.5 * len(y):
                return True
        return False

    return [r for r in own if not leaks(r[1])]


BRUTE = {"quality_rules": kept_by_quality, "near_duplicates": one_of_each, "substring_dedup": without_windows, "decontaminate": without_leaks}


def check_packed(found, own):
    tokenizer = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    ids = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in own}
    met, filled = collections.defaultdict(int), collections.Counter()
    for r in found:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.length, r.doc_tokens, r.ids_crc32) == (len(part), len(ids[r.doc_id]), zlib.crc32(np.array(part, "<u4").tobytes()))
        met[r.doc_id] += r.length
        filled[r.sequence_id] += r.length
    assert met == {d: len(x) for d, x in ids.items()}
    assert max(filled.values()) <= packing.WINDOW


@pytest.fixture
def tables(spark, tmp_path):
    def make(own):
        spark.createDataFrame(own, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id long, text string, doc_id string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return make


def test_stages_and_run_match_brute_force(spark, tables):
    own = rows()
    sf_dir = tables(own)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, own = len(own), BRUTE[name](own)
        found = stage(spark, docs, sf_dir)
        assert found.columns == docs.columns and found.dtypes == docs.dtypes
        assert sorted(map(tuple, found.collect())) == sorted(own, key=lambda r: r[0]), name
        assert len(own) < before or name == "substring_dedup"
        found.write.parquet(f"{sf_dir}/after-{name}")
        docs = spark.read.parquet(f"{sf_dir}/after-{name}")
    check_packed(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), own)
    check_packed(corpus_pipeline.run(spark, sf_dir).collect(), own)


def test_odd_rows_and_an_empty_table(spark, tables):
    own = rows()
    odd = [(None, *own[0][1:]), own[3], own[3], (5, None, None, None, None, None), (None, None, None, None, None, None), (5, *own[8][1:])]
    sf_dir = tables(own + odd)
    found = corpus_pipeline.run(spark, sf_dir).collect()
    total = collections.Counter()
    for r in found:
        total[r.doc_id] += r.length
    assert found and set(total) <= {r[0] for r in own + odd}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf_dir)
        assert found.count() == 0, name
