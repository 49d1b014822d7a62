"""Greedy string tiling of benchmark items over documents.

Seeds - stretches of ``min_tile`` words that a document and an item share - are joined by their running
hashes. For each document and item with shared seeds the longest match of unmarked words is marked again
and again until none of min_tile words is left, so a passage counts however its parts are ordered. The
share of an item's words that are marked is its coverage; documents that cover enough of an item leak it.

The items are handed to all tasks, in blocks of at most BLOCK_BYTES of text; a larger benchmark takes as
many passes over the documents as it has blocks, one after another, so that the driver holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import bounded_batches, written

MIN_TILE, COVERAGE = 5, 0.5
BLOCK_BYTES = 16 << 20
#: Pairs of places of shared seeds that are listed at once; a text and an item with more are tiled length by length.
PAIRS = 50_000


@dataclass
class Items:
    """A block of items: their words one after another, and for each seed the items that have it, with its places."""

    ids: list
    copies: list  # how many rows each stands for
    of: np.ndarray
    hash: np.ndarray  # of each word
    seeds: np.ndarray  # sorted hashes
    first: np.ndarray  # where each seed's rows start in the next three
    item: np.ndarray
    start: np.ndarray  # where the places of a seed in an item start in places
    count: np.ndarray
    places: np.ndarray  # words of the block where seeds start

    @classmethod
    def of_rows(cls, rows: list[tuple], min_tile: int) -> "Items":
        none = np.zeros(0, np.int64)
        if not rows:
            return cls([], [], np.zeros(1, np.int64), none.astype(np.uint64), none.astype(np.uint64), np.zeros(1, np.int64), none, none, none, none)
        (c,) = W.chunks(pa.array([x[1] for x in rows], pa.string()), lower=True, marks=True, size=1 << 62)
        at = np.flatnonzero(W.window_ok(c, min_tile))
        h = W.windows(c.hash, min_tile)[at]
        order = np.argsort(h, kind="stable")
        seeds, seed = np.unique(h[order], return_inverse=True)
        places = at[order]
        item = np.searchsorted(c.of, places, "right") - 1
        start = np.flatnonzero(np.append(True, (seed[1:] != seed[:-1]) | (item[1:] != item[:-1]))) if len(places) else none
        return cls([x[0] for x in rows], [x[2] if len(x) > 2 else 1 for x in rows], c.of, c.hash, seeds, np.searchsorted(seed[start], np.arange(len(seeds) + 1)), item[start], start, np.diff(np.append(start, len(places))), places)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first to first+count-1 of each, one after another."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def tiles(doc: np.ndarray, item: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (doc word, item word, length) from the places where seeds match; longest first, ties leftmost."""
    out = []
    while len(doc):
        order = np.lexsort((doc, item - doc))
        doc, item = doc[order], item[order]
        new = np.append(True, (np.diff(doc) != 1) | (np.diff(item) != 1))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(doc)))
        best = np.lexsort((item[start], doc[start], -size))[0]
        d, i, n = int(doc[start[best]]), int(item[start[best]]), int(size[best]) + min_tile - 1
        out.append((d, i, n))
        free = ((doc + min_tile <= d) | (doc >= d + n)) & ((item + min_tile <= i) | (item >= i + n))
        doc, item = doc[free], item[free]
    return out


def tiles_by_length(x: np.ndarray, y: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """The same tiles from the word hashes of a text and an item, in memory that grows with their lengths only.

    Running hashes of one length after another, from the longest that both have: of each length all tiles are marked,
    leftmost first, before the next shorter one is looked for.
    """
    marked = [np.zeros(len(x), bool), np.zeros(len(y), bool)]

    def free(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and hashes of the stretches of a text without a marked word."""
        out = []
        for h, taken in zip((x, y), marked):
            total = np.concatenate([[0], np.cumsum(taken)])
            at = np.flatnonzero(total[size:] == total[: len(total) - size])
            out.append((at, W.windows(h, size)[at]))
        return out

    def common(size: int) -> bool:
        (_, a), (_, b) = free(size)
        return bool(np.isin(a, b).any())

    out, high = [], min(len(x), len(y))
    while high >= min_tile and common(min_tile):
        low = min_tile
        while low < high:  # the longest length that both have
            size = (low + high + 1) // 2
            low, high = (size, high) if common(size) else (low, size - 1)
        (at, a), (places, b) = free(low)
        order = np.argsort(b, kind="stable")
        b, places = b[order], places[order]
        shared = np.isin(a, b)
        first, last = np.searchsorted(b, a[shared], "left"), np.searchsorted(b, a[shared], "right")
        turn: dict[int, int] = {}  # of the places with one hash, those before are taken
        for d, f, e in zip(at[shared].tolist(), first.tolist(), last.tolist()):
            if marked[0][d : d + low].any():
                continue
            k = turn.get(f, f)
            while k < e and marked[1][places[k] : places[k] + low].any():
                k += 1
            turn[f] = k
            if k < e:
                i = int(places[k])
                marked[0][d : d + low] = marked[1][i : i + low] = True
                out.append((d, i, low))
        high = low - 1
    return out


def matches(c: W.Words, items: Items, min_tile: int, coverage: float) -> Iterator[tuple]:
    """(text, item, covered words, item words, tiles) of the texts of a chunk that cover enough of an item."""
    h = W.windows(c.hash, min_tile)
    if not len(h) or not len(items.seeds):
        return
    found = np.minimum(np.searchsorted(items.seeds, h), len(items.seeds) - 1)
    at = np.flatnonzero((items.seeds[found] == h) & W.window_ok(c, min_tile))
    if not len(at):
        return
    owner = c.text[at]
    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
    sizes = np.diff(items.of)
    for lo, hi in zip(cuts, cuts[1:]):
        text = int(owner[lo])
        order = np.argsort(found[at[lo:hi]], kind="stable")
        doc = at[lo:hi][order] - c.of[text]  # places in the text, seed by seed
        seed, doc_first, doc_count = np.unique(found[at[lo:hi]][order], return_index=True, return_counts=True)
        often = items.first[seed + 1] - items.first[seed]
        row = _ranges(items.first[seed], often)  # the seeds' rows: a seed in an item
        of_row = np.repeat(np.arange(len(seed)), often)
        kinds, kind = np.unique(items.item[row], return_inverse=True)
        places = np.bincount(kind, weights=items.count[row])
        pairs = np.bincount(kind, weights=items.count[row] * doc_count[of_row])
        for j in np.flatnonzero(places * min_tile >= coverage * sizes[kinds]):  # else even disjoint seeds would not cover enough
            k = int(kinds[j])
            if pairs[j] > PAIRS:
                marked = tiles_by_length(c.hash[c.of[text] : c.of[text + 1]], items.hash[items.of[k] : items.of[k + 1]], min_tile)
            else:
                own = np.flatnonzero(kind == j)
                r, s = row[own], of_row[own]
                n = items.count[r] * doc_count[s]
                within = _ranges(np.zeros(len(n), np.int64), n)
                per = np.repeat(items.count[r], n)
                d = doc[np.repeat(doc_first[s], n) + within // per]
                i = items.places[np.repeat(items.start[r], n) + within % per] - items.of[k]
                marked = tiles(d, i, min_tile)
            covered = sum(x[2] for x in marked)
            if covered >= coverage * sizes[k]:
                yield text, k, covered, int(sizes[k]), marked


def _blocks(items: DataFrame) -> list[DataFrame]:
    """The distinct items with their numbers of rows, in blocks of BLOCK_BYTES / 2 on average: repeated rows can't fill one."""
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    plain = plain.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    total = plain.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = int(total // (BLOCK_BYTES // 2)) + 1
    return [plain] if n == 1 else [plain.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _shared(items: DataFrame, min_tile: int):
    """A broadcast block: by its size at most about BLOCK_BYTES of text."""
    rows = [(x["item_id"], x["text"], x["copies"]) for x in items.toLocalIterator()]
    return items.sparkSession.sparkContext.broadcast(Items.of_rows(sorted(rows, key=lambda x: (x[0] is None, x[0], x[1])), min_tile))


def leaks(docs: DataFrame, items: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, covered, item_words, coverage and tiles of each document and item it covers enough of.

    Words are lower-cased (A to Z) stretches without white space and ASCII punctuation. Null or empty
    texts and items of fewer words than a tile give no rows; repeated rows give theirs each; null ids stay
    null; other columns are left out.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, covered long, item_words long, tiles array<struct<doc_word: long, item_word: long, length: long>>"
    tile = pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("length", pa.int64())]))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one(block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for c in W.chunks(batch.column(1), lower=True, marks=True):
                    for text, k, covered, total, marked in matches(c, block.value, min_tile, coverage):
                        row = (batch.column(0)[c.first + text].as_py(), block.value.ids[k], covered, total, [dict(zip(("doc_word", "item_word", "length"), x)) for x in marked])
                        rows += [row] * block.value.copies[k]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 4 + [tile])], names=["doc_id", "item_id", "covered", "item_words", "tiles"])

        return plain.mapInArrow(run, schema)

    blocks, done = _blocks(items), []
    for part in blocks:
        block = _shared(part, min_tile)
        done.append(one(block) if len(blocks) == 1 else written(one(block), "leaks"))
        if len(blocks) > 1:
            block.destroy()
    found = reduce(DataFrame.union, done)
    return found.select("doc_id", "item_id", "covered", "item_words", (F.col("covered") / F.col("item_words")).alias("coverage"), "tiles")


def clean(docs: DataFrame, items: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, with all their columns, that leak no item; nothing is shuffled.

    Null and empty texts, and rows without a doc_id, are kept or go by their text alone; repeated rows fare alike;
    an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)

    def keep(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for c in W.chunks(batch.column("text").cast(pa.string()), lower=True, marks=True):
                    for text, *_ in matches(c, block.value, min_tile, coverage):
                        good[c.first + text] = False
                yield batch.filter(pa.array(good))

        return run

    blocks = _blocks(items)
    for part in blocks:
        block = _shared(part, min_tile)
        docs = docs.mapInArrow(keep(block), docs.schema)
        if len(blocks) > 1:
            docs = written(docs, "clean")
            block.destroy()
    return docs
