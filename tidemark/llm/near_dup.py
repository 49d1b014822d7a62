"""Join of near-equal texts: MinHash banding finds candidates, full word n-gram sets decide.

Texts with the same n-gram set are one node. Two nodes are linked if they share a band and their sets are near
enough, whatever else the table holds. The nodes of a connected candidate group that is small enough are
compared in one work item. A larger group is dealt into blocks, and each pair of blocks is a work item; where
it takes fewer copies of sets, the same is done bucket by bucket, and a pair is left to the first band that it
shares. So no work item is larger than ITEM_SHINGLES n-grams or ITEM_NODES nodes while each candidate pair
is compared exactly once, and where it is compared does not change the result. A work item gives a row for
each of its nodes - its number of links and the root of its linked part - never a row for a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .store import bounded_batches, written

SIZE, SIMILARITY, RECALL = 5, 0.8, 0.99999
MAX_HASHES = 160
#: N-grams and nodes of a work item at most, for a node of up to that size.
ITEM_SHINGLES, ITEM_NODES = 400_000, 600
#: Pairs whose bands are looked at together.
PAIRS = 100_000
#: An n-gram with at most so many owners in a work item is counted by pairs of owners, others by matrix products.
FEW = 48


def banding(similarity: float = SIMILARITY, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which bands * rows hashes reach the recall for pairs at the similarity."""
    for rows in range(max_hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows))) if similarity < 1 else 1
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("too few hashes for this recall")


def shingle_sets(c: W.Words, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, one after another, and their bounds.

    A text of fewer words than size has one n-gram, of all its words; a text without words has none.
    """
    text = c.text
    at = np.flatnonzero(W.window_ok(c, size))
    owner, value = text[at], W.windows(c.hash, size)[at]
    counts = np.diff(c.of)
    for m in range(1, size):
        short = np.flatnonzero(counts == m)
        h = np.full(len(short), m, np.uint64)
        for k in range(m):
            h = W.mix(h, c.hash[c.of[short] + k])
        owner, value = np.append(owner, short), np.append(value, h)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(c.count + 1))


def _set_names(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set that does not depend on an order; sets that are empty get 0."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), np.uint64)
    if len(full):
        seed = np.full(len(value), 7, np.uint64)
        sums = np.add.reduceat(W.mix(value, seed), bounds[full])
        out[full] = W.mix(sums, sizes[full].astype(np.uint64))
    return out


def _bands(value: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band hashes of each non-empty set: an array of sets by bands."""
    full = bounds[:-1][np.diff(bounds) > 0]
    draw = np.random.default_rng(20240611)
    a = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    out = np.zeros((len(full), bands), np.uint64)
    step = max(1, len(full))
    if not len(full):
        return out
    # a few sets at a time, so that their n-grams stay in the processor's cache
    cuts, total = [0], np.append(full, bounds[-1])
    while cuts[-1] < step:
        j = int(np.searchsorted(total, total[cuts[-1]] + 30_000, "right")) - 1
        cuts.append(min(step, max(j, cuts[-1] + 1)))
    for i, j in zip(cuts, cuts[1:]):
        part, at = value[total[i] : total[j]], total[i:j] - total[i]
        for k in range(bands):
            h = np.full(j - i, k, np.uint64)
            for r in range(k * rows, (k + 1) * rows):
                h = W.mix(h, np.minimum.reduceat(part * a[r] + b[r], at))
            out[i:j, k] = h
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key and text; rows that are equal in doc_id and text have the same key."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def signatures(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, key (of the row), node (name of the text's n-gram set; null without words), n_shingles and bands of each row."""
    bounded_batches(docs.sparkSession)
    bands, rows = banding(similarity, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for c in W.chunks(batch.column(2)):
                value, bounds = shingle_sets(c, size)
                sizes = np.diff(bounds)
                found = _bands(value, bounds, bands, rows)
                offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1).view(np.int64)))
                nodes = pa.array(_set_names(value, bounds).view(np.int64), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, c.count), batch.column(1).slice(at, c.count), nodes, pa.array(sizes, pa.int64()), lists], names=["doc_id", "key", "node", "n_shingles", "bands"])
                at += c.count

    return _keyed(docs).mapInArrow(run, "doc_id long, key long, node long, n_shingles long, bands array<long>")


def _share_band(bands: np.ndarray, i: np.ndarray, j: np.ndarray, band: int) -> np.ndarray:
    """Which pairs are this work item's: those that share any band (-1), or none before the given one."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), PAIRS):
        a, b = bands[i[k : k + PAIRS]], bands[j[k : k + PAIRS]]
        out[k : k + PAIRS] = (a == b).any(1) if band < 0 else ~(a[:, :band] == b[:, :band]).any(1)
    return out


def _compare(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, cross: bool, bands: np.ndarray, band: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set of a work item (counted with copies), and the index of the root of its linked part.

    cross: only sets of different side are compared, even if all that came are of one side. band: of the bucket
    that the item is for, or -1 for an item of a whole group.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = often > 1
    row, column = row[shared[column]], column[shared[column]]
    links, root = np.zeros(n, np.int64), np.arange(n)
    if not len(row):
        return links, root
    # n-grams with the same owners count together: near copies have few such kinds
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    starts = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    owners = np.add.reduceat(W.mix(row.astype(np.uint64), np.full(len(row), 3, np.uint64)), starts)
    _, first, kind, weight = np.unique(owners, return_index=True, return_inverse=True, return_counts=True)
    ends = np.append(starts[1:], len(row))
    common = np.zeros((n, n), np.float32)
    sizes_of = ends[first] - starts[first]
    for m in np.unique(sizes_of[sizes_of <= FEW]):  # kinds of few owners, pair by pair of owners
        at = starts[first[sizes_of == m]]
        part = weight[sizes_of == m].astype(np.float32)
        for a in range(m):
            for b in range(m):
                if a != b:
                    np.add.at(common, (row[at + a], row[at + b]), part)
    many = np.flatnonzero(sizes_of > FEW)
    for k in range(0, len(many), 2048):
        part = many[k : k + 2048]
        member = np.zeros((n, len(part)), np.float32)
        for j, f in enumerate(part):
            member[row[starts[first[f]] : ends[first[f]]], j] = 1
        common += (member * weight[part].astype(np.float32)) @ member.T
    step = max(1, 4_000_000 // n)
    for i in range(0, n, step):
        part = common[i : i + step].astype(np.float64)
        linked = part >= similarity * (sizes[i : i + step, None] + sizes[None, :] - part) - 1e-9
        linked &= part > 0
        linked[np.arange(len(part)), np.arange(i, i + len(part))] = False
        if cross:
            linked &= side[i : i + step, None] != side[None, :]
        x, y = np.nonzero(linked)
        linked[x, y] = _share_band(bands, x + i, y, band)
        links[i : i + step] += linked @ copies
        for x in range(len(part)):
            near = np.flatnonzero(linked[x])
            near = near[near > i + x]
            if len(near):
                _union(root, i + x, near)
    for x in range(n):
        root[x] = _find(root, x)
    return links, root


def _find(root: np.ndarray, x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return int(x)


def _union(root: np.ndarray, x: int, others: np.ndarray) -> None:
    own = _find(root, x)
    for r in np.unique(root[others]):
        r = _find(root, int(r))
        if r != own:
            own, r = min(own, r), max(own, r)
            root[r] = own


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """node, copies, bands and shingles (sorted uint64 as bytes) of rows node, copies, bands and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            at, nodes = 0, batch.column(0).to_numpy()
            new = np.append(nodes[:1] != last, nodes[1:] != nodes[:-1])  # repeated rows of the table follow each other
            last = nodes[-1] if len(nodes) else last
            batch = batch.filter(pa.array(new))
            for c in W.chunks(batch.column(3)):
                value, bounds = shingle_sets(c, size)
                raw = [value[i:j].astype("<u8").tobytes() for i, j in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, c.count) for i in range(3)), pa.array(raw, pa.binary())], names=["node", "copies", "bands", "shingles"])
                at += c.count

    return texts.select("node", "copies", "bands", "text").mapInArrow(run, "node long, copies long, bands array<long>, shingles binary")


def _verifier(similarity: float):
    """For mapInArrow over the rows of work items, each item's rows one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, rows, out = None, [], []

        def finish() -> None:
            if len(rows) > 1:
                nodes, side, copies = (np.array([x[k] for x in rows]) for k in range(3))
                links, root = _compare([x[4] for x in rows], copies, side, rows[0][6], np.stack([x[3] for x in rows]), rows[0][5], similarity)
                out.append((nodes, links, nodes[root]))
            rows.clear()

        for batch in batches:
            work, node, band, side, cross, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            bands, sets = batch.column(6), batch.column(7)
            for i in range(batch.num_rows):
                if work[i] != item:
                    finish()
                    item = work[i]
                if not rows or rows[-1][0] != node[i]:  # else a repeated row of the table
                    rows.append((node[i], side[i], copies[i], bands[i].values.to_numpy(), np.frombuffer(sets[i].as_py(), "<u8"), band[i], cross[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["node", "links", "root"])
                out.clear()
        finish()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["node", "links", "root"])

    return run


def _parts(weight: str, n: str):
    """Into how many blocks so many n-grams and nodes are dealt, so that two blocks fit into a work item."""
    whole = (F.col(weight) <= ITEM_SHINGLES) & (F.col(n) <= ITEM_NODES)
    half = F.greatest(F.ceil(F.col(weight) / (ITEM_SHINGLES // 2)), F.ceil(F.col(n) / (ITEM_NODES // 2)))
    return F.when(whole, 1).otherwise(half).cast("int")


def _dealt(rows: DataFrame, of: str, band) -> DataFrame:
    """Work rows of node and parts: a row of each node for every pair of blocks of its group or bucket."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return dealt.select(F.xxhash64(of, low, high, band).alias("work"), "node", band.alias("band"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), (low < high).alias("cross"))


def _work(nodes: DataFrame, groups: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows (work, node, band, side, cross): who is compared where. buckets: band, bucket, node."""
    sized = groups.join(nodes.select("node", "n_shingles"), "node")
    whole = sized.groupBy("root").agg(F.sum("n_shingles").alias("weight"), F.count(F.lit(1)).alias("n")).withColumn("parts", _parts("weight", "n"))
    placed = written(sized.join(whole, "root"), "near-placed")

    large = placed.where("parts > 1")
    rest = written(buckets.join(large.select("node", "n_shingles", "root"), "node"), "near-large")
    full = rest.groupBy("root", "bucket").agg(F.sum("n_shingles").alias("weight"), F.count(F.lit(1)).alias("n")).where("n > 1")
    full = written(full.select("root", "bucket", "weight", _parts("weight", "n").alias("parts")), "near-buckets")
    # n-grams that are sent, by buckets or by the whole group
    cost = full.groupBy("root").agg(F.sum(F.col("weight") * F.col("parts")).alias("cost"))
    fewer = cost.join(large.groupBy("root").agg(F.max(F.col("weight") * F.col("parts")).alias("own")), "root").where("cost < own").select("root")
    fewer = written(fewer, "near-by-bucket")
    by_group = placed.join(fewer, "root", "left_anti")
    by_bucket = rest.join(full.join(fewer, "root").select("bucket", "parts"), "bucket")
    return _dealt(by_group, "root", F.lit(-1)).union(_dealt(by_bucket, "bucket", F.col("band")))


def _classes(docs: DataFrame, size: int, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The signatures of docs, and node, root (one for each class), head (the class's least doc_id and key; null without ids) and n_links of each node."""
    signed = written(signatures(docs, size, similarity, recall), "near-signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("head"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    nodes = written(nodes, "near-nodes")

    members = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    buckets = written(members.join(written(shared, "near-shared"), "bucket"), "near-members")
    groups = components(buckets.select(F.col("node").alias("src"), F.col("least").alias("dst")), "near-candidates")
    groups = groups.union(groups.select(F.col("root").alias("node"), "root").distinct())

    work = _work(nodes, groups, buckets.select("band", "bucket", "node"))
    asked = written(groups.select("node").join(nodes.select("node", "copies", "key", "bands"), "node"), "near-asked")
    # merge joins at every size: a third of the rows under one key is split, and no size is broadcast
    texts = asked.hint("merge").join(_keyed(docs).drop("doc_id"), "key")
    items = work.hint("merge").join(_sets(texts, size), "node").select("work", "node", "band", "side", "cross", "copies", "bands", "shingles")
    found = items.repartition("work").sortWithinPartitions("work", "node").mapInArrow(_verifier(similarity), "node long, links long, root long")
    found = written(found, "near-found")
    linked = components(found.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")), "near-classes")

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "copies", F.col("head").alias("least")).join(linked, "node", "left").join(counts, "node", "left")
    named = named.select("node", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    heads = named.groupBy("root").agg(F.min("least").alias("head"))
    return signed, written(named.join(heads, "root").select("node", "root", "head", "n_links"), "near-named")


def near_duplicates(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id and n_links of each row of docs.

    Two documents are linked if the Jaccard similarity of their sets of word n-grams is at least the
    given one; copies of a text are linked too. n_links counts the linked rows; class_id is the least
    doc_id that is connected by links. A text of fewer words than size has one n-gram, of all its words.
    A null or text without words has no links and is its own class. A null doc_id stays null and is never
    a class_id unless all of its class are null. Repeated rows are documents of their own; an empty table
    gives none; other columns are left out.
    """
    signed, named = _classes(docs, size, similarity, recall)
    classes = named.select("node", F.col("head.doc_id").alias("class_id"), "n_links")
    return signed.select("doc_id", "node").join(classes, "node", "left").select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def representatives(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their class: one with its least doc_id.

    Rows without a doc_id stay, and so do texts without words. Of repeated rows with one doc_id and text one
    stays - where their other columns differ, that whose columns come first as JSON text; rows of other classes with that
    doc_id don't count as such. Columns beside doc_id and text may have any name.
    """
    signed, named = _classes(docs, size, similarity, recall)
    kept = named.where("head is not null").select("head.doc_id", "head.key").union(signed.where("node is null and doc_id is not null").select("doc_id", "key")).distinct()
    kept = written(kept, "near-kept")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    own = docs.where("doc_id is not null").select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), (F.to_json(F.struct(*rest)) if rest else F.lit("")).alias("order"), F.struct("*").alias("row"))
    found = own.join(kept.hint("merge"), ["doc_id", "key"], "left_semi").groupBy("doc_id", "key").agg(F.min_by("row", "order").alias("row"))
    return found.select("row.*").union(docs.where("doc_id is null"))


def oracle_sql(size: int = SIZE, similarity: float = SIMILARITY) -> str:
    """near_duplicates() over the view documents by comparing all pairs that share an n-gram, for DuckDB; doc_id must be unique."""
    return rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {size - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {size - 1}, least(len(ws), 1)) + 1)) AS i FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {similarity} * (x.n + y.n - c)),
    reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
    SELECT doc_id, least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)) AS class_id, (SELECT count(*) FROM link WHERE a = doc_id) AS n_links FROM documents
    """
