"""A hidden Markov language model over words, trained by Baum-Welch with counts summed over partitions.

States emit word classes. A frequent word - with at least a share 1/HEADS of all training tokens, so there
are HEADS at most - is a class of its own; the others fall into TAILS classes by their last bytes, and
within such a class a word has its share of the class's training tokens plus one, with one place for
words not met in training. So what all tasks hold is bounded: the classes, and the counts of the words with at
least a share 1/KNOWN of all tokens. The counts of all words stay a table; a text's rarer words are joined
with it by shuffles, in which no word is frequent.

Texts are read twice: once for the counts, and once to be written as sequences of classes, on which the
rounds of training and the scoring work. Training starts from a small sample (it only breaks the symmetry of
the states) and then passes over all training texts. No text is cut: forward and backward run over the
whole of each, the texts of a batch side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import bounded_batches, written

STATES, HEADS, TAILS, KNOWN = 8, 1 << 15, 1 << 12, 1 << 20
#: Documents that training starts from, its rounds over them, and rounds over all training documents.
START_DOCS, START_ROUNDS, ROUNDS = 2000, 12, 3
#: Weight of the corpus's class shares in each state's emissions, and of each transition and start.
PRIOR, STEP_PRIOR = 500.0, 0.5
#: Steps between scalings. The best way through two steps loses at most a factor (8 * tokens / PRIOR)**2,
#: which single precision holds for 10**13 tokens, and for eight steps double precision does.
SINGLE, DOUBLE = 2, 8

END = int(W.mix(np.array([1], np.uint64), np.array([2], np.uint64))[0])  # the hash that stands for the end
_SUFFIX = np.uint64(0x535546)


def held_out(doc_id: Column) -> Column:
    """Texts that the model doesn't learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tail_class(c: W.Words) -> np.ndarray:
    """The class by the last three bytes of each word, as if it were not frequent."""
    code = np.zeros(len(c.start), np.uint64)
    for k in (1, 2, 3):
        at = c.end - k
        code = code * np.uint64(256) + np.where(at >= c.start, c.data[np.maximum(at, 0)], 0).astype(np.uint64)
    return (W.mix(code, np.full(len(code), _SUFFIX, np.uint64)) % np.uint64(TAILS)).astype(np.int64)


def with_ends(c: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and tail class (-1 for the end) of each token, with an end after each text, and the texts' bounds."""
    n = np.diff(c.of) + 1
    of = np.concatenate([[0], np.cumsum(n)])
    h, tail = np.full(of[-1], END, np.uint64), np.full(of[-1], -1, np.int64)
    at = np.arange(len(c.hash)) + c.text
    h[at], tail[at] = c.hash, tail_class(c)
    return h, tail, of


@dataclass
class Model:
    heads: np.ndarray  # sorted hashes of the frequent words, the end among them
    head_counts: np.ndarray
    tail_tokens: np.ndarray  # training tokens of each tail class
    tail_words: np.ndarray  # words of each tail class
    tokens: int
    words: int
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # classes by states
    known: np.ndarray  # sorted hashes of the words next in frequency
    known_counts: np.ndarray

    def classes(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.heads, h), len(self.heads) - 1)
        return np.where(self.heads[at] == h, at, len(self.heads) + tail)

    @property
    def shares(self) -> np.ndarray:
        """The share of each class in training, with one place for unknown words in each tail class."""
        count = np.concatenate([np.maximum(self.head_counts, 1), self.tail_tokens + self.tail_words + 1]).astype(float)
        return count / count.sum()

    @property
    def ratios(self) -> np.ndarray:
        """Emissions over the classes' shares: of order one, however rare a class is."""
        return self.emit / self.shares[:, None]

    def counts_of(self, h: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Training tokens of each word that is frequent or known; -1 for others, which only the table tells."""
        out = np.where(cls < len(self.heads), np.append(self.head_counts, 0)[np.minimum(cls, len(self.heads))], -1)
        tail = np.flatnonzero(out < 0)
        if len(self.known) and len(tail):
            at = np.minimum(np.searchsorted(self.known, h[tail]), len(self.known) - 1)
            out[tail] = np.where(self.known[at] == h[tail], self.known_counts[at], -1)
        return out


def _by_step(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens in the order of their place in their texts, longest text first: these, where each place's tokens
    start, and the texts in order. A place's texts are the first of those of the place before it."""
    n = np.diff(of)
    order = np.argsort(-n, kind="stable")
    longest = int(n[order[0]]) if len(n) else 0
    live = np.searchsorted(-n[order], -np.arange(longest), "left")
    base = np.concatenate([[0], np.cumsum(live)])
    rank = np.empty(len(n), np.int64)
    rank[order] = np.arange(len(n))
    owner = np.repeat(np.arange(len(n)), n)
    token = np.empty(of[-1] - of[0], np.int64)
    token[base[np.arange(len(owner)) - (of - of[0])[owner]] + rank[owner]] = np.arange(len(owner))
    return token, base, order


def expected(model: Model, cls: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, steps and emissions (by class) of the texts under the model, by forward and backward."""
    token, base, _ = _by_step(of)
    k, steps = len(model.start), len(base) - 1
    if not steps:
        return np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit)
    cls, step = cls[token], model.step.astype(np.float32)
    seen = model.ratios.astype(np.float32)[cls]
    ahead, back = seen.copy(), np.ones_like(seen)
    ahead[: base[1]] *= model.start.astype(np.float32)
    at = base.tolist()
    for t in range(1, steps):
        now = ahead[at[t] : at[t + 1]]
        now *= ahead[at[t - 1] : at[t - 1] + len(now)] @ step
        if t % SINGLE == 0:
            now /= now.sum(1, keepdims=True)
    turned = np.ascontiguousarray(step.T)
    for t in range(steps - 1, 0, -1):
        now = seen[at[t] : at[t + 1]]
        now *= back[at[t] : at[t + 1]]  # from here on what follows, seen from the state at t
        before = back[at[t - 1] : at[t - 1] + len(now)]
        np.matmul(now, turned, out=before)
        if t % SINGLE == 0:
            before /= before.sum(1, keepdims=True)
    # each row only matters up to a factor
    for x in (ahead, back, seen):
        x /= x.sum(1, keepdims=True)
    live = np.diff(base)
    earlier = ahead[np.arange(at[1], len(cls)) - np.repeat(live[:-1], live[1:])]
    onward = seen[at[1] :]
    onward /= np.einsum("ij,ij->i", earlier @ step, onward)[:, None]
    moves = (earlier.T @ onward).astype(float) * model.step
    ahead *= back
    ahead /= ahead.sum(1, keepdims=True)
    starts = ahead[: at[1]].sum(0, dtype=float)
    emissions = np.stack([np.bincount(cls, weights=ahead[:, s], minlength=len(model.emit)) for s in range(k)], 1)
    return starts, moves, emissions


def renewed(model: Model, starts: np.ndarray, steps: np.ndarray, emissions: np.ndarray) -> Model:
    """The model that expected counts give."""
    emit = emissions + PRIOR * model.shares[:, None]
    step = steps + STEP_PRIOR
    start = starts + STEP_PRIOR
    return Model(model.heads, model.head_counts, model.tail_tokens, model.tail_words, model.tokens, model.words, start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0), model.known, model.known_counts)


def log_likelihood(model: Model, cls: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The exact natural logarithm of the probability of each text's classes, by the scaled forward recursion."""
    token, base, order = _by_step(of)
    n, at, steps = len(of) - 1, base.tolist(), len(base) - 1
    if not n:
        return np.zeros(0)
    seen, logs, done = model.ratios[cls[token]], np.zeros(n), np.zeros(n)
    now = model.start
    for t in range(steps):
        size = at[t + 1] - at[t]
        now = (now[:size] @ model.step if t else now) * seen[at[t] : at[t + 1]]
        if t % DOUBLE == DOUBLE - 1:
            total = now.sum(1)
            logs[:size] += np.log(total)
            now /= total[:, None]
        after = at[t + 2] - at[t + 1] if t + 1 < steps else 0
        if after < size:
            done[after:size] = np.log(now[after:].sum(1))
    out = np.zeros(n)
    out[order] = logs + done
    return out + np.add.reduceat(np.log(model.shares)[cls], of[:-1])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """h, tail and c: hash, tail class and number of each training token; the end has tail class -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in W.chunks(batch.column(0), lower=True):
                h, tail, _ = with_ends(c)
                word, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(tail[first].astype(np.int32)), pa.array(n)], names=["h", "tail", "c"])

    found = docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(run, "h long, tail int, c long")
    return found.groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))


def _blank(counts: DataFrame, states: int) -> Model:
    """The model before training: frequent words and tail classes, with states that don't differ."""
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    tokens, words = int(total[0] or 0), int(total[1])
    frequent = (F.col("c") * HEADS >= tokens) | (F.col("tail") < 0)

    def ordered(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = rows.select("h", "c").toPandas()
        h = found["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        return h[order], found["c"].to_numpy(np.int64)[order]

    heads, head_counts = ordered(counts.where(frequent))  # HEADS + 1 rows at most
    if not len(heads):
        heads, head_counts = np.array([END], np.uint64), np.zeros(1, np.int64)
    known, known_counts = ordered(counts.where(~frequent & (F.col("c") * KNOWN >= tokens)))  # KNOWN rows at most
    tails = counts.where(~frequent).groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toPandas()
    tail_tokens, tail_words = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    tail_tokens[tails["tail"]], tail_words[tails["tail"]] = tails["c"], tails["n"]
    model = Model(heads, head_counts, tail_tokens, tail_words, tokens, words, np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), np.zeros((0, states)), known, known_counts)
    noise = np.random.default_rng(7).uniform(0.5, 1.5, (len(model.heads) + TAILS, states))
    emit = model.shares[:, None] * noise
    model.emit = emit / emit.sum(0)
    return model


#: A row for each chunk of texts. Of each text: row, doc_id, held; tokens, known tokens and, over its frequent and
#: known words, the sums of the logarithms of the base score and of the shares within their classes. Then, as
#: bytes, the bounds of the texts (int64), the tokens' classes (uint16), and of each text's other words
#: the number of the text in the chunk (int32), hash (int64), tail class (int16) and times (int32).
_ENCODED = [("rows", "array<long>"), ("docs", "array<long>"), ("held", "array<boolean>"), ("tokens", "array<long>"), ("known", "array<long>"), ("base", "array<double>"), ("within", "array<double>"), ("bounds", "binary"), ("classes", "binary"), ("rare_text", "binary"), ("rare_word", "binary"), ("rare_tail", "binary"), ("rare_times", "binary")]


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """The texts of docs as classes, with what the model's shared counts tell of them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # KNOWN and (HEADS + TAILS) * states numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        size = np.log10(own.tail_tokens + own.tail_words + 1.0)
        total = np.log10(own.tokens + own.words + 1.0)
        for batch in batches:
            for c in W.chunks(batch.column(3), lower=True):
                h, tail, of = with_ends(c)
                cls = own.classes(h, tail)
                count = own.counts_of(h, cls)
                told = count >= 0
                sums = lambda x: np.add.reduceat(x, of[:-1])
                log = np.log10(np.where(told, count, 0) + 1.0)
                head, seen = cls < len(own.heads), count > 0
                base, within = np.where(told, log - total, 0.0), np.where(told & ~head, log - size[np.maximum(tail, 0)], 0.0)
                at = np.flatnonzero(~told)
                owner, word = np.repeat(np.arange(c.count), np.diff(of))[at], h[at]
                order = np.lexsort((word, owner))
                owner, word, which = owner[order], word[order], tail[at][order]
                first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(word)))
                part = batch.slice(c.first, c.count)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                raw = lambda x, t: pa.array([x.astype(t).tobytes()], pa.binary())
                texts = [part.column(0), part.column(1), part.column(2), *(pa.array(x) for x in (np.diff(of), sums(seen.astype(np.int64)), sums(base), sums(within)))]
                bytes_ = [raw(of, "<i8"), raw(cls, "<u2"), raw(owner[first], "<i4"), raw(word[first].view(np.int64), "<i8"), raw(which[first], "<i2"), raw(times, "<i4")]
                yield pa.RecordBatch.from_arrays([*map(one, texts), *bytes_], names=[x for x, _ in _ENCODED])

    plain = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held"), "text")
    return plain.mapInArrow(run, ", ".join(f"{x} {t}" for x, t in _ENCODED))


def _sequences(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """held, bounds and classes of each row of a batch with these columns first."""
    for held, bounds, cls in zip(*(batch.column(i) for i in range(3))):
        yield held.values.to_numpy(zero_copy_only=False), np.frombuffer(bounds.as_py(), "<i8"), np.frombuffer(cls.as_py(), "<u2").astype(np.int64)


def _only(pick: np.ndarray, bounds: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and classes of the texts that are picked."""
    n = np.diff(bounds)
    return np.concatenate([[0], np.cumsum(n[pick])]), cls[np.repeat(pick, n)]


def _counted(chunks: DataFrame, model: Model, rounds: int) -> Model:
    """The model after rounds of Baum-Welch over the texts that are not held out; each task sends the sums of its texts."""
    spark, k = chunks.sparkSession, len(model.start)
    names = [f"s{i}" for i in range(k)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)  # (HEADS + TAILS) * states numbers at most, and KNOWN

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, sums = shared.value, None
            for batch in batches:
                for held, bounds, cls in _sequences(batch):
                    of, cls = _only(~held, bounds, cls)
                    found = expected(own, cls, of)
                    sums = found if sums is None else tuple(a + b for a, b in zip(sums, found))
            if sums is not None:
                every = np.concatenate([sums[0][None], sums[1], sums[2]])
                at = np.flatnonzero(every.any(1))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(every[at, s].astype(np.float32)) for s in range(k))], names=["at", *names])

        sums = chunks.select("held", "bounds", "classes").mapInArrow(run, "at int, " + ", ".join(f"{x} float" for x in names))
        found = sums.groupBy("at").agg(*(F.sum(x).alias(x) for x in names)).toPandas()
        every = np.zeros((1 + k + len(model.emit), k))
        every[found["at"]] = found[names].to_numpy()
        model = renewed(model, every[0], every[1 : 1 + k], every[1 + k :])
        shared.unpersist()
    return model


def _start(chunks: DataFrame, docs: int) -> DataFrame:
    """held, bounds and classes of at most `docs` training texts: those with the least hash of their doc_id."""
    each = chunks.select(F.explode(F.arrays_zip("rows", "docs", "held")).alias("t")).where("not t.held and t.docs is not null")
    each = each.select("t.rows", F.col("t.docs").alias("doc_id"))
    n = each.count()
    # ids with a small hash first, so that what is sorted does not grow with the table
    few = each.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 1))) < 2 * docs).select("rows", "doc_id", F.xxhash64("doc_id").alias("turn"))
    picked = written(few.orderBy("turn", "doc_id", "rows").limit(docs).select("rows"), "hmm-start-rows")
    rows = chunks.sparkSession.sparkContext.broadcast(np.sort(picked.toPandas()["rows"].to_numpy(np.int64)))  # `docs` numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (_, bounds, cls), row in zip(_sequences(batch), batch.column(3)):
                pick = np.isin(row.values.to_numpy(), rows.value)
                if pick.any():
                    of, cls = _only(pick, bounds, cls)
                    held = pa.ListArray.from_arrays(pa.array([0, len(of) - 1], pa.int32()), pa.array(np.zeros(len(of) - 1, bool)))
                    yield pa.RecordBatch.from_arrays([held, pa.array([of.astype("<i8").tobytes()]), pa.array([cls.astype("<u2").tobytes()])], names=["held", "bounds", "classes"])

    return written(chunks.select("held", "bounds", "classes", "rows").mapInArrow(run, "held array<boolean>, bounds binary, classes binary"), "hmm-start")


def train(chunks: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """The model after Baum-Welch over the texts of chunks, a table of encoded(), that are not held out."""
    return _counted(chunks, _counted(_start(chunks, START_DOCS), model, START_ROUNDS), rounds)


def score(chunks: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each text of chunks."""
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = ["row", "doc_id", "h", "n", "tail", "tokens", "known", "base", "model"]
    schema = "row long, doc_id long, h long, n long, tail int, tokens long, known long, base double, model double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for i, (_, bounds, cls) in enumerate(_sequences(batch)):
                rows, docs, tokens, known, base, within = (batch.column(k)[i].values for k in range(3, 9))
                n, zero = len(rows), lambda m, t=np.int64: pa.array(np.zeros(m, t))
                likely = log_likelihood(own, cls, bounds) / np.log(10) + within.to_numpy()
                yield pa.RecordBatch.from_arrays([rows, docs, rows, zero(n), zero(n, np.int32), tokens, known, base, pa.array(likely)], names=names)
                text, word, tail, times = (np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in zip(range(9, 13), ("<i4", "<i8", "<i2", "<i4")))
                m = len(text)
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(text)), pa.nulls(m, pa.int64()), pa.array(word), pa.array(times.astype(np.int64)), pa.array(tail.astype(np.int32)), zero(m), zero(m), zero(m, np.float64), zero(m, np.float64)], names=names)

    needed = chunks.select("held", "bounds", "classes", "rows", "docs", "tokens", "known", "base", "within", "rare_text", "rare_word", "rare_tail", "rare_times")
    told = needed.mapInArrow(run, schema).join(counts.select("h", "c").hint("merge"), "h", "left")
    tails = spark.createDataFrame([(i, float(t + w + 1)) for i, (t, w) in enumerate(zip(model.tail_tokens.tolist(), model.tail_words.tolist()))], "tail int, size double")
    told = told.join(F.broadcast(tails), "tail")  # TAILS rows
    c = F.coalesce("c", F.lit(0))
    told = told.select(
        "row", "doc_id", "tokens",
        (F.col("known") + F.when((F.col("n") > 0) & (c > 0), F.col("n")).otherwise(0)).alias("known"),
        (F.col("base") + F.col("n") * F.log10((c + 1) / F.lit(float(model.tokens + model.words + 1)))).alias("base"),
        (F.col("model") + F.col("n") * F.log10((c + 1) / F.col("size"))).alias("model"),
    )
    done = told.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(x).alias(x) for x in ("tokens", "known", "base", "model")))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"))


def language_model_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """The scores of every row of docs by a model of those that are not held out.

    A text is its words, A to Z in lower case, and an end; a null or empty text is the end alone. A null
    doc_id is not held out. Repeated rows count, and are scored, as often as they stand there. Without
    training texts every word is unknown. An empty table gives no rows; other columns are left out.
    """
    bounded_batches(docs.sparkSession)
    plain = _texts(docs)
    counts = written(word_counts(plain), "hmm-counts")
    model = _blank(counts, states)
    chunks = written(encoded(plain, model), "hmm-encoded")
    return score(chunks, counts, train(chunks, model, rounds))
