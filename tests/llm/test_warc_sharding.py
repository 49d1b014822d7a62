import base64
import bisect
import collections
import hashlib
import zlib

import pytest

from tidemark.llm import sharding, warc

from .conftest import plain

PAGES = [(3, "http://a/\r\nX: y é", None), (1, None, ""), (2, "u", "é" * 5000), (5, "u", "é" * 5000), (4, "u", "é" * 5000), (6, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n\r\n\r\n" * 30), (7, "v", "0\r\n\r\n"), (7, "v", "0\r\n\r\n"), (None, "w", "lonely? no"), (9, "w", "lonely? no")]


def brute(rows):
    first, seen, out = {}, set(), []
    for page, _, html in rows:
        first[html or ""] = min(first.get(html or "", 1 << 60), page if page is not None else 1 << 59)
    for page, _, html in rows:
        data = (html or "").encode()
        response = page == first[html or ""] and html not in seen
        if response:
            seen.add(html)
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first[html or ""]))
    return out


@pytest.mark.parametrize("segment", [warc.SEGMENT, 7])
def test_round_trip(spark, segment):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert plain(warc.round_trip(pages, segment).collect()) == plain(brute(PAGES))


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_problems_are_told(spark, tmp_path):
    name = "urn:x:1"
    parts = list(warc.records(name, 1, "u", "D", b"payload " * 40, None, 100))
    cases = {"whole": parts, "gap": [parts[0], *parts[2:]], "headless": parts[1:], "twice": parts + parts[1:2], "endless": parts[:-1]}
    for case, records in cases.items():
        folder = tmp_path / case
        folder.mkdir()
        (folder / "part-0.txt").write_bytes(b"".join(x + b"\r\n\r\n" for x in reversed(records)))
        (row,) = warc.read_archives(spark, f"file://{folder}").collect()
        if case in ("whole", "twice"):
            assert row.payload == b"payload " * 40 and row.problem is None
        else:
            assert row.payload is None and "missing" in row.problem


def test_chunked_framing():
    for data in (b"", b"a", b"x" * 5000):
        assert warc.dechunked(warc.chunked(data, 7)) == data
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_shards_are_even_and_slots_gapless(docs):
    rows = [(i, f"text {i}" * (i % 9)) for i in range(997)] + [(None, "x"), (None, None), (5, "again"), (5, "again")]
    found = sharding.assigned(docs(rows)).collect()
    assert len(found) == len(rows)
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.assigned(docs(rows).limit(0)).count() == 0


def test_one_more_shard_moves_few(docs):
    table = docs([(i, f"t{i}") for i in range(3000)])
    a, b = ({r.doc_id: r.shard for r in sharding.assigned(table, n).collect()} for n in (8, 9))
    assert sum(a[i] != b[i] for i in a) / len(a) < 0.25  # 1/9 must move


def test_shards_match_a_walk_on_the_ring(spark):
    """Every key in its turn: to the next point clockwise whose shard has room. Size, checksum and slot too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "x"), (None, None), (10**9, ""), (10**9 + 1, None), (10**9 + 2, "long " * 50000)], docs.schema)
    docs = docs.union(odd)
    size, crc = "octet_length(encode(coalesce(text, ''), 'UTF-8')) + 1L", "crc32(encode(coalesce(text, ''), 'UTF-8'))"
    keys = docs.selectExpr("doc_id", "text", f"CASE WHEN doc_id IS NULL THEN xxhash64({crc}, {size}) ELSE xxhash64(doc_id) END AS place", f"xxhash64(doc_id, {crc}, {size}, 1) AS turn").collect()
    points = sharding.ring(8)
    ends = [p for p, _ in points]
    room = [len(keys) // 8 + (s < len(keys) % 8) for s in range(8)]
    arc = {k: bisect.bisect_left(ends, k.place) % len(points) for k in keys}
    expected, slots = {}, [[] for _ in range(8)]
    for k in sorted(keys, key=lambda k: (k.turn % sharding.BUCKETS, arc[k], k.turn)):
        at = arc[k]
        while not room[points[at][1]]:
            at = (at + 1) % len(points)
        shard = points[at][1]
        room[shard] -= 1
        slots[shard].append(k)
    for shard, own in enumerate(slots):
        for slot, k in enumerate(own):
            data = (k.text or "").encode()
            expected[(k.doc_id, len(data) + 1, zlib.crc32(data))] = (shard, slot)
    found = {(r.doc_id, r.size, r.text_crc32): (r.shard, r.slot) for r in sharding.sharded(docs).collect()}
    assert found == expected and len(found) == len(keys)


def test_few_keys_move_to_a_ninth_shard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    a, b = ({r.doc_id: r.shard for r in sharding.assigned(docs, n).select("doc_id", "shard").collect()} for n in (8, 9))
    assert 1 / 9 <= sum(a[i] != b[i] for i in a) / len(a) < 0.15


def test_bytes_are_bounded(docs):
    table = docs([(i, "x" * (i % 100)) for i in range(4000)])
    found = sharding.assigned(table, law="bytes", slack=0.05).groupBy("shard").sum("size").collect()
    total = sum(r[1] for r in found)
    assert max(r[1] for r in found) <= 1.05 * total / 8 + 8 * 101


def test_keys_overflow_clockwise():
    points = sharding.ring(3, 4)
    order = sharding.clockwise(points, 0)
    assert sharding.plan([(0, 0, 10)], points, [4, 4, 4]) == [(0, 0, order[0], 0, 4), (0, 0, order[1], 4, 8), (0, 0, order[2], 8, 10)]


def test_copies_of_one_row_fill_no_cell(docs, monkeypatch):
    """Two thirds of the rows are one row: all of them are placed, evenly and gapless, and those past a full shard go on."""
    rows = [(7, "the same text")] * 4000 + [(i, f"text {i}") for i in range(100, 2000)] + [(None, None)] * 50
    table = docs(rows)
    found = {}
    for copies in (50_000, 70):
        monkeypatch.setattr(sharding, "COPIES", copies)
        out = sharding.assigned(table).collect()
        counts = collections.Counter(r.shard for r in out)
        assert len(out) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
        for shard, n in counts.items():
            assert sorted(r.slot for r in out if r.shard == shard) == list(range(n))
        assert collections.Counter(r.doc_id for r in out) == collections.Counter(r[0] for r in rows)
        found[copies] = sorted((r.shard, r.slot, r.doc_id or 0) for r in out)
    assert found[70] == found[50_000] and len({r.shard for r in out if r.doc_id == 7}) > 4
    out = sharding.assigned(table, law="bytes").groupBy("shard").sum("size").collect()
    assert max(r[1] for r in out) - min(r[1] for r in out) <= 40
