"""Repeated word windows by recompression.

Each round renames a document's sequence of symbols: runs of one symbol, and pairs of neighbours of which
the first is in the left and the second in the right half of the alphabet, become one symbol. A name is a
hash of what it stands for and of the round, so it is the same in all documents, and what happens to a
symbol depends only on its neighbours: equal stretches of text get equal symbols except near their ends.
With each symbol goes the stretch of words that decided it (its context).

A window of words is assigned to the longest symbol whose context it holds. Equal windows have equal
assigned symbols, so Spark names each group of consecutive windows with one assigned symbol by that
symbol, counts the groups of each name, and

- a name that occurs once repeats nowhere: its windows stay;
- groups of one name with the same words verify each other: all their windows repeat;
- only other groups of a shared name (cut short by an edit or the end of a passage), and windows that hold
  no context, are compared window by window with one group of each wording, by hashes of 128 bits.

Groups of the same words within one Arrow batch are verified there and sent on as one, so a passage that
very many documents share adds a row for each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import bounded_batches, written

WINDOW, ROUNDS = 35, 4
#: Rounds that name runs before pairs.
RUN_ROUNDS = (0, 2)
#: Bits of a symbol's place in a chunk of texts; a single text may have as many symbols.
_PLACE = 28

_RUN, _PAIR, _HALF, _SECOND = (np.uint64(x) for x in (0x52554E, 0x50414952, 0x48414C46, 0x5345434F4E44))


def _named(a: np.ndarray, b: np.ndarray, kind: np.uint64, turn: int) -> np.ndarray:
    return W.mix(W.mix(a, b), np.full(len(a), kind + np.uint64(turn), np.uint64))


def symbols(c: W.Words, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name, first word, end, and context (start, end) of the symbols of all texts after the rounds.

    A context that reaches beyond its text starts before or ends after it.
    """
    n = len(c.hash)
    text = c.text
    low, high = c.of[text] - 1, c.of[text + 1] + 1  # context of what a text's end decided
    name = c.hash
    start, end = np.arange(n), np.arange(n) + 1
    left, right = start.copy(), end.copy()
    for turn in range(rounds):
        if not n:
            break
        same = text[1:] == text[:-1]
        if turn in RUN_ROUNDS:
            first = np.flatnonzero(np.append(True, ~same | (name[1:] != name[:-1])))
            last = np.append(first[1:], len(name)) - 1
            before = np.where(np.append(True, ~same)[first], low[first], left[np.maximum(first - 1, 0)])
            after = np.where(np.append(~same, True)[last], high[last], right[np.minimum(last + 1, len(name) - 1)])
            size = (last - first + 1).astype(np.uint64)
            name = np.where(size > 1, _named(name[first], size, _RUN, turn), name[first])
            start, end, left, right = start[first], end[last], before, after
            text, low, high = text[first], low[first], high[first]
            same = text[1:] == text[:-1]
        is_left = (W.mix(name, np.full(len(name), _HALF + np.uint64(turn), np.uint64)) & np.uint64(1)) == 0
        joined = np.append(same & is_left[:-1] & ~is_left[1:], False)
        second = np.append(False, joined[:-1])
        after = np.where(np.append(~same, True), high, np.append(right[1:], 0))
        before = np.where(np.append(True, ~same), low, np.append(0, left[:-1]))
        new_left = np.where(is_left, left, before)
        new_right = np.where(joined, np.append(right[1:], 0), np.where(is_left, after, right))
        next_name = np.append(name[1:], np.uint64(0))
        name = np.where(joined, _named(name, next_name, _PAIR, turn), name)
        end = np.where(joined, np.append(end[1:], 0), end)
        keep = ~second
        name, start, end, left, right = (x[keep] for x in (name, start, end, new_left, new_right))
        text, low, high = text[keep], low[keep], high[keep]
    return name, start, end, left, right


def _assigned(symbol: tuple, at: np.ndarray, window: int) -> np.ndarray:
    """For each window that starts at a word of at, the number of its symbol; -1 if it holds no context."""
    name, start, end, left, right = symbol
    if not len(at) or not len(name):
        return np.full(len(at), -1)
    size = np.minimum(end - start, 63).astype(np.uint64)
    rank = ((np.uint64(63) - size) << np.uint64(58)) | ((W.mix(name, size) >> np.uint64(34)) << np.uint64(_PLACE)) | np.arange(len(name), dtype=np.uint64)
    # contexts are ordered, so those within a window are neighbours: the least rank of a range of symbols
    first = np.searchsorted(left, at, "left")
    last = np.searchsorted(right, at + window, "right")
    count = last - first
    out = np.full(len(at), -1)
    some = np.flatnonzero(count > 0)
    level, power = rank, 1
    while len(some):
        fits = some[(count[some] >= power) & (count[some] < 2 * power)]
        if len(fits):
            best = np.minimum(level[first[fits]], level[last[fits] - power])
            out[fits] = (best & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        some = some[count[some] >= 2 * power]
        if len(some):
            level = np.minimum(level[: len(level) - power], level[power:])
            power *= 2
    return out


def _groups(c: W.Words, window: int, rounds: int):
    """Groups of consecutive windows with one assigned symbol: text, first window, windows, name, hash of their words.

    The name of windows that hold no context is 0.
    """
    at = np.flatnonzero(W.window_ok(c, window))
    symbol = symbols(c, rounds)
    found = _assigned(symbol, at, window)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    text = c.text[at]
    first = np.flatnonzero(np.append(True, (found[1:] != found[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)))
    count = np.diff(np.append(first, len(at)))
    names = np.where(found[first] >= 0, symbol[0][np.maximum(found[first], 0)], np.uint64(0))
    windows = W.windows(c.hash, window)[at]
    # the words of a group are those of its windows: its first, and its windows at every 35th word and its last
    folded = W.mix(windows[first], count.astype(np.uint64))
    for k in range(window, int(count.max()), window):
        more = count > k
        folded[more] = W.mix(folded[more], windows[first[more] + k])
    folded = W.mix(folded, windows[first + count - 1])
    return text[first], at[first] - c.of[text[first]], count, names, folded


def _keyed(docs: DataFrame) -> DataFrame:
    """key, doc (a struct of all columns but text, and whether that is null) and text; rows equal in doc_id and
    text have the same key and the same result."""
    text = docs["text"].cast("string")
    rest = [docs[f"`{x}`"].alias(f"c{i}") for i, x in enumerate(docs.columns) if x != "text"]
    return docs.select(F.xxhash64("doc_id", text).alias("key"), F.struct(*rest, text.isNull().alias("no_text")).alias("doc"), text.alias("text"))


#: What is known of a group where it was found: nothing, that it repeats, or that its windows have no symbol.
_ASK, _SURE, _BARE = 0, 1, 2


def _occurrences(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """name, span, c, state, key, at and n of each group of windows.

    Of groups with equal words in a batch one has state _ASK and their number as c; the rest are _SURE.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts = batch.column(0).to_numpy(), []
            for c in W.chunks(batch.column(1)):
                text, at, count, name, span = _groups(c, window, rounds)
                parts.append((keys[c.first + text], at, count, name, span))
            key, at, count, name, span = (np.concatenate(x) for x in zip(*parts))
            _, first, kind, often = np.unique(W.mix(name, span), return_index=True, return_inverse=True, return_counts=True)
            state = np.full(len(name), _SURE, np.int32)
            state[first] = _ASK
            state[name == 0] = _BARE
            often = np.where(state == _ASK, often[kind], 0)
            columns = (name.view(np.int64), span.view(np.int64), often.astype(np.int64), state, key, at.astype(np.int32), count.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["name", "span", "c", "state", "key", "at", "n"])

    return _keyed(docs).select("key", "text").mapInArrow(run, "name long, span long, c long, state int, key long, at int, n int")


def _places(occurred: DataFrame) -> DataFrame:
    """key, sure and open: of each row with repeats the groups that are verified, and those to compare by windows."""
    alone = F.xxhash64("key", "at")  # rows that ask nothing have names of their own, so that they spread
    asked = occurred.withColumn("name", F.when(F.col("state") == _ASK, F.col("name")).otherwise(alone))
    by_name, by_span = Window.partitionBy("name"), Window.partitionBy("name", "span")
    told = asked.withColumn("all", F.sum("c").over(by_name)).withColumn("lo", F.min("span").over(by_name)).withColumn("hi", F.max("span").over(by_name))
    told = told.withColumn("same", F.sum("c").over(by_span)).withColumn("rank", F.row_number().over(by_span.orderBy("key", "at")))
    sure = (F.col("state") == _SURE) | (F.col("same") > 1)
    shared = (F.col("state") == _ASK) & (F.col("all") > 1) & (F.col("lo") != F.col("hi"))
    compare = (F.col("state") == _BARE) | (shared & (F.col("rank") == 1))
    told = told.select("key", "at", "n", sure.alias("s"), compare.alias("o")).where("s or o")
    told = told.groupBy("key").agg(F.collect_set(F.struct("s", "o", "at", "n")).alias("g"))
    pick = lambda x: F.transform(F.filter("g", lambda g: g[x]), lambda g: F.struct(g["at"].alias("at"), g["n"].alias("n")))
    return told.select("key", pick("s").alias("sure"), pick("o").alias("open"))


def _second_hash(c: W.Words, window: int) -> np.ndarray:
    return W.windows(W.mix(c.hash, np.full(len(c.hash), _SECOND, np.uint64)), window)


def _cut(text: bytes, sure: list, more: list, window: int) -> tuple[int, int, bytes, str]:
    """Words, removed words, the kept text and its digest; more: repeated windows beside the sure groups."""
    own = text.split()
    change = np.zeros(len(own) + 1, np.int64)
    for g in sure:
        change[g["at"]] += 1
        change[g["at"] + g["n"] + window - 1] -= 1
    if len(more):
        at = np.unique(np.array(more))
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
    gone = np.cumsum(change[:-1]) > 0
    count = int(np.count_nonzero(gone))
    left = b" ".join([own[i] for i in np.flatnonzero(~gone)] if count else own)
    return len(own), count, left, hashlib.sha256(left).hexdigest()


def _shown(result: tuple, text: bytes | None, texts: bool) -> tuple:
    """The result with the text itself where no word goes; without any text if texts is false."""
    return (*result[:2], (text if result[1] == 0 else result[2]) if texts else None, result[3])


_RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())]
_GROUPS = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())]))


def _results(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
    arrays = [pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)]
    arrays[2] = arrays[2].cast(pa.string())
    return arrays


def _first_pass(met: DataFrame, window: int, texts: bool) -> DataFrame:
    """From key, doc, text, sure and open: the results of rows without open groups; of the others text and groups."""
    kind = met.schema["doc"].dataType
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc", kind), T.StructField("text", T.StringType()), T.StructField("sure", _GROUPS), T.StructField("open", _GROUPS), *_RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure, open_ = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            text = batch.column(2).cast(pa.binary()).to_pylist()
            rows = [(None,) * 4 if o else _shown(_cut(t or b"", s or (), (), window), t, texts) for t, s, o in zip(text, sure, open_)]
            left = pc.if_else(pa.array([bool(x) for x in open_]), batch.column(2), pa.nulls(len(rows), pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), left, batch.column(3), batch.column(4), *_results(rows)], names=schema.names)

    return met.select("key", "doc", "text", "sure", "open").mapInArrow(run, schema)


def _windows(unsettled: DataFrame, window: int) -> DataFrame:
    """one, two (hashes), key and at of each window of an open group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, open_ = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for c in W.chunks(batch.column(1)):
                places = [np.unique(np.concatenate([np.arange(g["at"], g["at"] + g["n"]) for g in x])) for x in open_[c.first : c.first + c.count]]
                sizes = [len(x) for x in places]
                flat = np.concatenate(places)
                where = flat + np.repeat(c.of[:-1], sizes)
                one, two = W.windows(c.hash, window)[where], _second_hash(c, window)[where]
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.repeat(keys[c.first : c.first + c.count], sizes)), pa.array(flat.astype(np.int32))], names=["one", "two", "key", "at"])

    return unsettled.select("key", "text", "open").mapInArrow(run, "one long, two long, key long, at int")


def _settled(rest: DataFrame, window: int, texts: bool) -> DataFrame:
    """The results of rows (doc, text, sure, more) once their repeated windows are known."""
    schema = T.StructType([T.StructField("doc", rest.schema["doc"].dataType), *_RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            rows = [_shown(_cut(text or b"", sure or (), more or (), window), text, texts) for text, sure, more in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_results(rows)], names=schema.names)

    return rest.select("doc", "text", "sure", "more").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, texts: bool = True) -> DataFrame:
    """doc (a struct of all columns but text), n_words, n_removed, kept (the words that stay, joined by a space,
    or the text itself if all stay; null if texts is false), kept_sha256 (of the words joined by a space).

    A word goes if a window of consecutive words that covers it also starts at another place of the same
    or another row. Repeated rows are documents of their own, so all of their words go if they are as long
    as a window. A null or empty text has no words and keeps an empty text; ids may be null; an empty table
    stays empty.
    """
    bounded_batches(docs.sparkSession)
    places = written(_places(_occurrences(docs, window, rounds)), "repeat-places")
    # merge joins at every size: plans don't change with the input, and a key of many rows is split
    first = written(_first_pass(_keyed(docs).join(places.hint("merge"), "key", "left"), window, texts), "repeat-first")

    unsettled = first.where("n_words is null")
    single = _windows(unsettled, window)
    twice = written(single.groupBy("one", "two").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("one", "two"), "repeat-twice")
    again = written(single.join(twice.hint("merge"), ["one", "two"]).groupBy("key").agg(F.collect_set("at").alias("more")), "repeat-again")
    rest = unsettled.select("key", "doc", "text", "sure").join(again.hint("merge"), "key", "left")
    result = ["doc", *(x.name for x in _RESULT)]
    return first.where("n_words is not null").select(*result).union(_settled(rest, window, texts).select(*result))


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    return without_repeats(docs.select("doc_id", "text"), window, texts=False).select(F.col("doc.c0").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def cut_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the texts that lose words cut to the words that stay; others are unchanged. n_chars, if there,
    follows the text."""
    cut = without_repeats(docs, window)
    text = F.when(~F.col("doc.no_text"), F.col("kept"))  # null texts stay null
    value = {"text": text, "n_chars": F.char_length(text)}
    return cut.select(*((value[x].cast(t) if x in value else F.col(f"doc.c{i}")).alias(x) for i, (x, t) in enumerate(docs.dtypes)))


def oracle_sql(window: int = WINDOW) -> str:
    """digests() over the view documents, for DuckDB; doc_id must be unique."""
    return rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {window - 1}], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM w)),
    twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM win) WHERE n > 1),
    gone AS (SELECT DISTINCT doc_id, i + k AS i FROM twice, range(0, {window}) t(k)),
    word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
    """
