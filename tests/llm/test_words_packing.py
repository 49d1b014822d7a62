import collections
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import tokenizers

from tidemark.llm import packing, token_counts, words

TEXTS = ["a b", "b", "", "  x y\n", "ab", None, "a", "é è a b", "b a", "x\x1cy z", "q" * 300]


def test_words_are_those_of_bytes_split():
    for size in (1, 5, 1 << 20):
        names = {}
        found = []
        for c in words.chunks(pa.array(TEXTS), size=size):
            for k in range(c.count):
                own = range(c.of[k], c.of[k + 1])
                found.append([c.word(i) for i in own])
                assert all(names.setdefault(c.word(i), c.hash[i]) == c.hash[i] for i in own)
        assert found == [(t or "").encode().split() for t in TEXTS]
        assert len(set(names.values())) == len(names)


def test_windows_name_equal_stretches():
    (c,) = words.chunks(pa.array(["a b c a b c d", "b c a b"]))
    for size in (1, 2, 3, 5):
        h, ok = words.windows(c.hash, size), words.window_ok(c, size)
        all_ = [c.word(i) for i in range(len(c.hash))]
        seen = {}
        for i in np.flatnonzero(ok):
            assert seen.setdefault(tuple(all_[i : i + size]), h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)


def plain_ids(text):
    """By the tokenizer as its file gives it, a new one that nothing has changed."""
    return tokenizers.Tokenizer.from_file(packing.default_tokenizer()).encode(text or "", add_special_tokens=False).ids


def test_pieces_encode_as_whole_texts():
    encode = packing.encoder(packing.default_tokenizer())
    own = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    draw = random.Random(1)
    alphabet = [*"ab é\n \t\xa0'sx1.,|  \x1c\x85　ñ<|>²½ªβ中̀(-\"/", "<|endoftext|>", "<|endoftext", "endoftext|>"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(3000)] + ["<|endoftext|> a", "", " a", "a ", "\n\n a", "a <|endoftext|>", "<|endoftext|>" * 3]
    for text, found in zip(texts, encode(texts)):
        assert np.frombuffer(found, "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_rows_of_the_query_match_the_tokenizer(spark, docs):
    """ids_crc32, start, length, doc_tokens and offset of each row, recomputed from whole texts."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(150).collect()]
    rows = list(enumerate([*texts, None, "", "<|endoftext|> a <|endoftext|>", "long word " * 3000]))
    found = packing.digests(packing.pack(docs(rows))).collect()
    ids = {d: [*plain_ids(t), 1] for d, t in rows}
    filled, seen = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r.doc_id].append((r.start, r.length))
        filled[r.sequence_id].append((r.offset, r.length))
    for d, pieces in seen.items():
        assert [a for a, _ in sorted(pieces)] == np.cumsum([0] + [n for _, n in sorted(pieces)])[:-1].tolist() and sum(n for _, n in pieces) == len(ids[d])
    assert seen.keys() == ids.keys()
    for pieces in filled.values():
        assert [a for a, _ in sorted(pieces)] == np.cumsum([0] + [n for _, n in sorted(pieces)])[:-1].tolist() and sum(n for _, n in pieces) <= 2048


def test_packer_places_every_id_once():
    draw = random.Random(2)
    for _ in range(150):
        window = draw.choice([8, 16, 64])
        packer = packing.Packer(window, draw.choice([2, 5, 100]), 0)
        docs = [np.arange(draw.randint(1, 3 * window), dtype="<u4").tobytes() for _ in range(draw.randint(0, 60))]
        for i, ids in enumerate(docs):
            packer.add(i, ids)
        packer.end()
        by_doc, by_sequence = {}, {}
        for row in packer.rows:
            by_doc.setdefault(row[0], []).append(row)
            by_sequence.setdefault(row[5], []).append(row)
        for i, ids in enumerate(docs):
            rows = sorted(by_doc[i], key=lambda r: r[1])
            assert b"".join(r[3] for r in rows) == ids
            assert [r[1] for r in rows] == np.cumsum([0] + [r[2] for r in rows])[:-1].tolist()
        fills = []
        for rows in by_sequence.values():
            rows.sort(key=lambda r: r[6])
            assert [r[6] for r in rows] == np.cumsum([0] + [r[2] for r in rows])[:-1].tolist()
            fills.append(sum(r[2] for r in rows))
        assert all(f <= window for f in fills) and sum(f < window for f in fills) <= 1


def test_level_minimises_the_sum_of_squares():
    draw = random.Random(3)
    packer = packing.Packer(16, 100, 0)
    for _ in range(300):
        packer.levels = np.array([0] + [draw.choice([0, 0, 1, 2, 3]) for _ in range(15)] + [0])
        size = draw.randint(1, 15)

        def cost(level):
            n = packer.levels.copy()
            if level:
                n[level] -= 1
            if level + size < 16:
                n[level + size] += 1
            return int((n[1:16] ** 2).sum())

        choices = [0] + [h for h in range(1, 17 - size) if packer.levels[h]]
        assert cost(packer.level_for(size)) == min(map(cost, choices))


def test_packs_odd_rows(docs):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "same"), (3, "same"), (4, "long word " * 3000)]
    found = packing.digests(packing.pack(docs(rows))).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in found if r.doc_id in (1, 2)) == [(1, 1), (2, 1)]
    assert sum(r.length for r in found) == sum({r.doc_id: r.doc_tokens * (2 if r.doc_id == 3 else 1) for r in found}.values())
    assert packing.pack(docs(rows).limit(0)).count() == 0


def test_long_words_by_place_are_those_of_the_trie(monkeypatch):
    draw = random.Random(4)
    pieces = {x: token_counts.cost(i) for i, x in enumerate(["a", "b", "ab", "ba", "aba", "abab", "é", "éa", "bbbb", "aaaaaaa"])}
    vocab = token_counts.Vocabulary(pieces, token_counts.cost(len(pieces)))
    own = sorted({"".join(draw.choice("abé語") for _ in range(draw.randrange(1, 120))) for _ in range(200)})
    trie = vocab.terminal_counts(own).tolist()
    monkeypatch.setattr(token_counts, "LONG", 0)
    for stretch in (1 << 16, 7):
        monkeypatch.setattr(token_counts, "STRETCH", stretch)
        assert vocab.terminal_counts(own).tolist() == trie
    monkeypatch.undo()
    began = time.time()
    found = vocab.terminal_counts(sorted([*own, "ab" * 500_000, "語" * 20_000]))
    assert max(found) == 250_000 and time.time() - began < 60
    assert 60_000 in found.tolist()  # three bytes each, which no piece has
