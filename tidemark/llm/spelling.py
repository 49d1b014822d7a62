"""Spelling variants: words of a corpus one code point apart, and the frequent form that a rare one goes back to.

If two words differ by one code point, then of either word one half stands unchanged in the other. So words are brought
together by the forward half (the first length // 2 code points) and by the backward half (the rest). Each task builds, for
either direction, the minimal acyclic automaton of the words of its groups, in which a word's number is the sum of the
words that its path leaves behind it. A word walks its half exactly, then its other half with one error; the states
that it ends in give the numbers of the words near to it. A pair that both directions find is left to the forward one.

A group whose words are longer than GROUP_SIZE together is not given to a task: its words meet by what is left of them
without one code point, and at most as many words meet there as the alphabet has letters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, written
from .words import mix

LEAST_LENGTH, LEAST_COUNT, RATIO, EVERY = 7, 2, 10, 31
#: Code points of a group's words at most, and those of the groups that share an automaton. Which way a group goes does not change the result.
GROUP_SIZE, BUNDLE_SIZE = 1 << 20, 1 << 19
#: Code points of the rows that a task gets, on average.
TASK_SIZE = 1 << 21
_LETTERS = "A-Za-z\\u00C0-\\u00FF"
_SEED = np.uint64(11)


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word and n, its occurrences: the runs of letters of all texts, A to Z lower-cased, one in `every` of them without a code point.

    A null or empty text has none; a null doc_id is the empty string in what is hashed; each of repeated rows counts;
    columns other than doc_id and text are not looked at.
    """
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.expr(f"regexp_extract_all(text, '[{_LETTERS}]{{{least_length},}}', 0)")).alias("run"))
    found = found.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    found = found.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"), F.length("run").alias("size"))
    cut = F.expr("concat(left(run, cast(h % size as int)), substring(run, cast(h % size as int) + 2, size))")
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return found.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words (bytes), by levels of their trie from the longest to the root.

    States are told apart by 64-bit hashes of the sets of endings that lead from them to the end of a word.
    """

    def __init__(self, sorted_words: list[bytes]) -> None:
        sizes = np.array([len(x) for x in sorted_words], np.int64)
        flat = np.frombuffer(b"".join(sorted_words), np.uint8).astype(np.int64)
        at = np.cumsum(sizes) - sizes
        of, node, total = np.arange(len(sizes)), np.zeros(len(sizes), np.int64), 1  # words of at least the depth, and their nodes there
        levels, ends = [], []
        for depth in range(int(sizes.max(initial=0))):
            long = sizes[of] > depth
            of, above = of[long], node[long]
            letter = flat[at[of] + depth]
            new = np.ones(len(of), bool)
            new[1:] = (letter[1:] != letter[:-1]) | (above[1:] != above[:-1])
            node = total + np.cumsum(new) - 1
            levels.append((above[new], letter[new], node[new]))
            ends.append(node[sizes[of] == depth + 1])
            total += int(new.sum())
        final = np.zeros(total, bool)
        for x in ends:
            final[x] = True
        below = final.astype(np.int64)
        name = np.where(final, np.uint64(0x9E3779B97F4A7C15), np.uint64(1))
        for parent, letter, child in reversed(levels):
            first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            name[child] = mix(name[child], np.full(len(child), _SEED))
            name[parent[first]] += np.add.reduceat(mix(name[child], letter.astype(np.uint64)), first)
            below[parent[first]] += np.add.reduceat(below[child], first)
        name[0] = mix(name[:1], np.full(1, _SEED))[0]
        _, kept, state = np.unique(name, return_index=True, return_inverse=True)
        self.start, self.final, self.states, self.words = int(state[0]), final[kept], len(kept), len(sorted_words)
        parent, letter, child = (np.concatenate(x) for x in zip(*levels)) if levels else np.zeros((3, 0), np.int64)
        own = kept[state[parent]] == parent  # the edges of one node for each state
        parent, letter, child = state[parent[own]], letter[own], child[own]
        order = np.lexsort((letter, parent))
        self.source, self.letter, child = parent[order], letter[order], child[order]
        self.target, count = state[child], below[child]
        self.key = self.source * 256 + self.letter
        self.first = np.searchsorted(self.source, np.arange(self.states + 1))
        #: words that are passed by taking an edge: those that end before it, and those of the edges to its left
        passed = np.cumsum(count) - count
        self.passed = passed - passed[self.first[self.source]] + self.final[self.source] if len(passed) else passed

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The edge that is taken from each state with each letter; -1 where there is none."""
        if not len(self.key):
            return np.full(len(state), -1)
        key = state * 256 + letter
        edge = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[edge] == key, edge, -1)

    def edges(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all edges of the states: the place in state, and the edge."""
        many = self.first[state + 1] - self.first[state]
        which = np.repeat(np.arange(len(state)), many)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + self.first[state][which]

    def near(self, asked: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in asked, word number): words that begin with the first exact[i] letters of word i and are one letter off after them."""
        sizes = np.array([len(x) for x in asked], np.int64)
        flat = np.frombuffer(b"".join(asked), np.uint8).astype(np.int64)
        at = np.cumsum(sizes) - sizes
        who, state, number = np.arange(len(sizes)), np.full(len(sizes), self.start), np.zeros(len(sizes), np.int64)
        late, late_state, late_number = (np.zeros(0, np.int64) for _ in range(3))  # with an error behind them
        found = []
        for depth in range(int(sizes.max(initial=-1)) + 1):
            open_ = depth >= exact[who]
            ask, here, passed = who[open_], state[open_], number[open_]
            left = depth < sizes[ask]
            which, edge = self.edges(here)  # a letter more than in the asked word: its own next letter is yet to come
            more = (ask[which], self.target[edge], passed[which] + self.passed[edge])
            # the errors so far take the letter at this depth
            go = depth < sizes[late]
            done = ~go & self.final[late_state]
            found.append((late[done], late_number[done]))
            late, late_state, late_number = late[go], late_state[go], late_number[go]
            taken = self.step(late_state, flat[at[late] + depth])
            ok = taken >= 0
            late, late_state, late_number = late[ok], self.target[taken[ok]], late_number[ok] + self.passed[taken[ok]]
            # another letter in place of the asked word's, or that left out
            own = flat[np.minimum(at[ask[which]] + depth, max(len(flat) - 1, 0))] if len(which) else np.zeros(0, np.int64)
            swap = left[which] & (self.letter[edge] != own)
            spent = [(x[swap]) for x in more], [ask[left], here[left], passed[left]]
            # a letter more, which stays at this depth: it takes the asked word's letter now
            go = depth < sizes[more[0]]
            done = ~go & self.final[more[1]]
            found.append((more[0][done], more[2][done]))
            taken = self.step(more[1][go], flat[at[more[0][go]] + depth])
            ok = taken >= 0
            extra = [more[0][go][ok], self.target[taken[ok]], more[2][go][ok] + self.passed[taken[ok]]]
            late, late_state, late_number = (np.concatenate(x) for x in zip((late, late_state, late_number), *spent, extra))
            if len(late) > 32 * len(asked) + 1000:  # the same word by several errors, as in runs of one letter
                _, one = np.unique(np.stack([late, late_state, late_number]), axis=1, return_index=True)
                late, late_state, late_number = late[one], late_state[one], late_number[one]
            # and those without an error go on
            go = depth < sizes[who]
            who, state, number = who[go], state[go], number[go]
            taken = self.step(state, flat[at[who] + depth])
            ok = taken >= 0
            who, state, number = who[ok], self.target[taken[ok]], number[ok] + self.passed[taken[ok]]
        pairs = np.unique(np.concatenate([who * self.words + number for who, number in found]))
        return pairs // self.words, pairs % self.words


def _groups(found: DataFrame, least_length: int) -> DataFrame:
    """A row of each word for each of its groups: key, backward, asks (whether the word asks there), word and n."""
    size, rows = F.length("word"), []
    for backward in (False, True):
        # the halves that words one code point shorter, as long, and one longer ask with
        sizes = [F.floor((size + d + int(backward)) / 2).cast("int") for d in (-1, 0, 1)]
        half = (lambda k: F.right(F.col("word"), k)) if backward else (lambda k: F.left(F.col("word"), k))
        keys = F.array_distinct(F.array(*(F.when(size + d >= least_length, F.xxhash64(F.lit(backward), half(k))) for d, k in zip((-1, 0, 1), sizes))))
        rows.append(found.select(F.explode(keys).alias("key"), F.lit(backward).alias("backward"), F.xxhash64(F.lit(backward), half(sizes[1])).alias("own"), "word", "n"))
    return rows[0].union(rows[1]).where("key is not null").select("key", "backward", (F.col("key") == F.col("own")).alias("asks"), "word", "n")


def _bundle(rows: dict[bytes, list], backward: bool) -> list[tuple]:
    """The near pairs of the words of some groups; rows: n and whether it asks, of each word."""
    turn = (lambda x: x[::-1]) if backward else (lambda x: x)
    table = sorted(turn(x) for x in rows)
    asked = [x for x in table if rows[turn(x)][1]]
    if len(table) < 2 or not asked:
        return []
    exact = np.array([(len(x) + 1) // 2 if backward else len(x) // 2 for x in asked], np.int64)
    who, number = Automaton(table).near(asked, exact)
    out = []
    for i, k in zip(who.tolist(), number.tolist()):
        word, near = turn(asked[i]), turn(table[k])
        half = len(word) // 2
        if word != near and not (backward and word[:half] == near[:half]):
            out.append((word.decode("latin-1"), rows[word][0], near.decode("latin-1"), rows[near][0]))
    return out


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _groups(), those of a group one after another, to near pairs; a letter is a byte of Latin-1."""
    kinds, group, last, size = {False: {}, True: {}}, [], None, 0

    def close() -> int:
        """Puts a group into its bundle, unless no two words or no word that asks is in it."""
        if len(group) < 2 or not any(asks for _, asks, _, _ in group):
            return 0
        for backward, asks, raw, n in group:
            kinds[backward].setdefault(raw, [n, False])[1] |= asks
        return sum(len(x[2]) for x in group)

    def flush() -> Iterator[pa.RecordBatch]:
        for backward, rows in kinds.items():
            found = _bundle(rows, backward)
            rows.clear()
            for i in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found[i : i + 50_000])], names=["word", "n", "near", "near_n"])

    for batch in batches:
        for key, backward, asks, word, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if key != last:
                size += close()
                group.clear()
                last = key
                if size >= BUNDLE_SIZE:
                    yield from flush()
                    size = 0
            group.append((backward, asks, word.encode("latin-1"), n))
    close()
    yield from flush()


def _by_gaps(rows: DataFrame) -> DataFrame:
    """The near pairs of groups that are too large for a task: words that are equal without one code point of their unmatched half."""
    size, half = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    low, high = F.when(F.col("backward"), 0).otherwise(half - 1), F.when(F.col("backward"), half + 1).otherwise(size)
    places = F.sequence(F.greatest(low, F.lit(0)), F.least(high, size) - 1)
    gaps = rows.select("key", "backward", "asks", "word", "n", F.explode(places).alias("place"))
    gaps = gaps.withColumn("rest", F.expr("concat(left(word, place), substring(word, place + 2, length(word)))"))
    a, b = gaps.alias("a"), gaps.alias("b")
    same = [F.col(f"a.{x}") == F.col(f"b.{x}") for x in ("key", "place", "rest")]
    pair = [F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"), F.col("a.backward").alias("backward")]
    swapped = a.join(b, [*same, F.col("a.word") != F.col("b.word")]).where("a.asks").select(*pair)
    whole = rows.alias("b")
    cut = a.join(whole, [F.col("a.key") == F.col("b.key"), F.col("a.rest") == F.col("b.word")])
    less = cut.where("a.asks").select(*pair)
    more = cut.where("b.asks").select(F.col("b.word").alias("word"), F.col("b.n").alias("n"), F.col("a.word").alias("near"), F.col("a.n").alias("near_n"), F.col("a.backward").alias("backward"))
    forward = F.expr("left(near, cast(floor(length(word) / 2) as int)) = left(word, cast(floor(length(word) / 2) as int))")
    back = F.expr("right(near, length(word) - cast(floor(length(word) / 2) as int)) = right(word, length(word) - cast(floor(length(word) / 2) as int))")
    found = swapped.union(less).union(more).where(F.when(F.col("backward"), back & ~forward).otherwise(forward))
    return found.drop("backward").distinct()


def near_pairs(found: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n, near and near_n: each ordered pair of distinct words, one inserted, deleted or replaced code point apart, once.

    found: word (letters up to U+00FF, no word twice) and n.
    """
    bounded_batches(found.sparkSession)
    rows = written(_groups(found, least_length), "spelling-groups")
    sizes = rows.groupBy("key").agg(F.sum(F.length("word")).alias("size"))
    total = rows.agg(F.sum(F.length("word"))).first()[0] or 0
    large = written(sizes.where(F.col("size") > GROUP_SIZE).select("key"), "spelling-large")
    tasks = max(1, math.ceil(total / TASK_SIZE))
    small = rows.join(large, "key", "left_anti").repartition(tasks, "key").sortWithinPartitions("key")
    matched = small.mapInArrow(_matched, "word string, n long, near string, near_n long")
    return matched.union(_by_gaps(rows.join(large, "key")))


def variants(found: DataFrame, least_length: int = LEAST_LENGTH, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each row of words().

    form: the near word with the largest n (ties: the least in code-point order) if that n is at least ratio times the
    word's; root: where the forms of forms end. A form has at least ratio times the count of its word, so chains are
    short, and paths are doubled until the longest one possible is followed.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, else forms could go round in circles")
    found = written(found, "spelling-words")
    best = near_pairs(found, least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    told = found.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.minus") >= ratio * F.col("n"), F.col("best")).alias("best"))
    told = written(told.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.minus")).alias("form_n")), "spelling-forms")
    paths = written(told.where("form is not null").select("word", F.col("form").alias("root")), "spelling-paths")
    most, longest = told.agg(F.max("n")).first()[0] or 1, 1
    while ratio**longest < most:
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        paths = written(paths.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "spelling-paths")
        longest *= 2
    return told.join(paths, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """variants() of words(); an empty table, or one whose words all occur once, gives no row."""
    return variants(words(docs))


def oracle_sql() -> str:
    """spelling_variants() over the view documents for DuckDB, which has no CRC-32: it is reckoned byte by byte from a table."""
    return r"""
    WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
    r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    d AS (SELECT id, run, count(*) AS n FROM r GROUP BY ALL),
    b AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS bytes FROM d),
    h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t),
    c AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
    w AS (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    g AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
    p AS (SELECT a.word AS word, b.word AS near FROM g a JOIN g b USING (i, rest) WHERE a.word <> b.word
      UNION SELECT g.word, w.word FROM g JOIN w ON g.rest = w.word UNION SELECT w.word, g.word FROM g JOIN w ON g.rest = w.word),
    q AS (SELECT p.word, count(*) AS n_near, min((-w.n, p.near)) AS best FROM p JOIN w ON w.word = p.near GROUP BY p.word),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 10 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 10 * w.n THEN -best[1] END AS form_n FROM w LEFT JOIN q USING (word)),
    e AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, e.root FROM f JOIN e ON f.form = e.word)
    SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
    """
