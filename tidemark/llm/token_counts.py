"""Token counts by a unigram model whose scores are computed once for each shared prefix.

The pieces are those of a public vocabulary, with a cost that grows with the logarithm of their rank. The
distinct pre-tokens of a batch form a trie: words in order share the nodes of their common prefixes. Level
by level, each node gets the least cost of a segmentation of its prefix and how many pieces it has, from the
nodes of its last pieces; what stands at the end of a word is its terminal count. Words longer than LONG, which share
few nodes, are gone through one by one, so that neither time nor memory is the longest word times the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import bounded_batches

#: Words of which a worker remembers the terminal count, before it starts anew.
KNOWN_WORDS = 1_000_000
#: Code points of a word in the trie; the count of one of that length is far below 2^_COUNT_BITS.
LONG = 128
_COUNT_BITS = 24
#: Places of a long word whose pieces are looked up together.
STRETCH = 1 << 16
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

_vocabularies: dict[str, "Vocabulary"] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def cost(rank: int) -> int:
    """Thousandths of the natural logarithm of the rank, as a piece's share falls with its rank."""
    return int(round(1000 * float(np.log(rank + 2))))


def _code_hash(codes: np.ndarray) -> np.ndarray:
    return W.mix(codes.astype(np.uint64), np.full(len(codes), 99, np.uint64)) | np.uint64(1)


class Vocabulary:
    """Pieces by length, as sorted hashes with their values: cost above, one piece below."""

    def __init__(self, pieces: dict[str, int], byte_cost: int):
        self.pieces, self.byte_cost = pieces, byte_cost
        self.known: dict[int, int] = {}
        self.longest = max(map(len, pieces), default=1)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, self.longest + 1):
            own = [(self.name(x), (c << _COUNT_BITS) + 1) for x, c in pieces.items() if len(x) == n]
            if own:
                own.sort()
                self.by_length[n] = (np.array([x[0] for x in own], np.uint64), np.array([x[1] for x in own], np.int64))

    @staticmethod
    def name(piece: str) -> int:
        h = _code_hash(np.frombuffer(piece.encode("utf-32-le"), "<u4"))
        power = np.cumprod(np.append(np.uint64(1), np.full(len(h) - 1, _MULTIPLIER, np.uint64)))
        return int((h * power).sum())

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        return cls({model.id_to_piece(i): cost(k) for k, i in enumerate(plain)}, cost(len(plain)))

    def terminal_counts(self, words: list[str]) -> np.ndarray:
        """The number of pieces of the best segmentation of each of these sorted, distinct words."""
        long = np.array([len(x) > LONG for x in words], bool)
        out = np.zeros(len(words), np.int64)
        out[~long] = self._by_trie([x for x, far in zip(words, long) if not far])
        out[long] = [self._by_place(x) for x, far in zip(words, long) if far]
        return out

    def _by_place(self, word: str) -> int:
        """The count of one word of any length: for each place the least cost up to it, and its pieces, from the pieces that end there."""
        codes = np.frombuffer(word.encode("utf-32-le"), "<u4")
        power = np.cumprod(np.append(np.uint64(1), np.full(len(codes), _MULTIPLIER, np.uint64)))
        inverse = np.cumprod(np.append(np.uint64(1), np.full(len(codes), _INVERSE, np.uint64)))
        ahead = np.append(np.uint64(0), np.cumsum(_code_hash(codes) * power[:-1]))
        utf8 = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4))).tolist()
        costs, counts = [0], [0]
        for low in range(0, len(codes), STRETCH):
            ends = np.arange(low + 1, min(low + STRETCH, len(codes)) + 1)
            found = []
            for k, (names, values) in self.by_length.items():
                own = ends[ends >= k]
                h = (ahead[own] - ahead[own - k]) * inverse[own - k]
                at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                hit = names[at] == h
                found.append((own[hit], np.full(int(hit.sum()), k), values[at[hit]] >> _COUNT_BITS))
            end, size, price = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            order = np.argsort(end, kind="stable")
            first = np.searchsorted(end[order], np.append(ends, ends[-1] + 1)).tolist()
            size, price = size[order].tolist(), price[order].tolist()
            for i, e in enumerate(ends.tolist()):
                best = (costs[e - 1] + utf8[e - 1] * self.byte_cost, counts[e - 1] + utf8[e - 1])
                for j in range(first[i], first[i + 1]):
                    from_ = e - size[j]
                    best = min(best, (costs[from_] + price[j], counts[from_] + 1))
                costs.append(best[0])
                counts.append(best[1])
        return counts[-1]

    def _by_trie(self, words: list[str]) -> np.ndarray:
        n = len(words)
        size = np.array([len(x) for x in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        start = np.cumsum(size) - size
        power = np.cumprod(np.append(np.uint64(1), np.full(len(codes), _MULTIPLIER, np.uint64)))
        inverse = np.cumprod(np.append(np.uint64(1), np.full(len(codes), _INVERSE, np.uint64)))
        ahead = np.append(np.uint64(0), np.cumsum(_code_hash(codes) * power[:-1]))
        utf8 = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
        level: dict[int, np.ndarray] = {0: np.zeros(n, np.int64)}
        out = np.zeros(n, np.int64)
        alive = np.flatnonzero(size > 0)
        same = np.ones(n, bool)  # the word's prefix up to here is that of the word before
        depth = 0
        while len(alive):
            depth += 1
            last = codes[start[alive] + depth - 1]
            shared = np.zeros(len(alive), bool)
            shared[1:] = same[alive[1:]] & (alive[1:] == alive[:-1] + 1) & (last[1:] == last[:-1])
            same[alive] = shared
            nodes = alive[~shared]
            end = start[nodes] + depth
            best = level[depth - 1][nodes] + ((utf8[end - 1].astype(np.int64) * self.byte_cost) << _COUNT_BITS) + utf8[end - 1]
            for k, (names, values) in self.by_length.items():
                if k > depth:
                    break
                begin = end - k
                h = (ahead[end] - ahead[begin]) * inverse[begin]
                at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                hit = names[at] == h
                best = np.where(hit, np.minimum(best, level[depth - k][nodes] + values[at]), best)
            now = np.zeros(n, np.int64)
            now[alive] = best[np.cumsum(~shared) - 1]
            level[depth] = now
            level.pop(depth - self.longest, None)
            done = alive[size[alive] == depth]
            out[done] = now[done]
            alive = alive[size[alive] > depth]
        return out & ((1 << _COUNT_BITS) - 1)


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary.load(path)
    return _vocabularies[path]


def counts_of(c: W.Words, vocab: Vocabulary) -> np.ndarray:
    """The number of pieces of each text of a chunk."""
    if len(vocab.known) > KNOWN_WORDS:
        vocab.known.clear()
    names, first, kind = np.unique(c.hash, return_index=True, return_inverse=True)
    values = np.array([vocab.known.get(x, -1) for x in names.tolist()], np.int64)
    new = np.flatnonzero(values < 0)
    if len(new):
        words = ["▁" + c.word(i).decode("utf-8", "replace") for i in first[new]]
        order = sorted(range(len(words)), key=words.__getitem__)
        found = vocab.terminal_counts([words[i] for i in order])
        values[new[order]] = found
        vocab.known.update(zip(names[new].tolist(), values[new].tolist()))
    total = np.concatenate([[0], np.cumsum(values[kind])]) if len(c.hash) else np.zeros(1, np.int64)
    return total[c.of[1:]] - total[c.of[:-1]]


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of each row of docs; nothing is shuffled.

    Words are stretches without white space, each with a word-start mark before it; characters that no piece
    has count as their UTF-8 bytes. A null or empty text has no tokens; ids may be null; repeated rows are
    counted each; an empty table gives no rows; other columns are left out. Texts without white space are one word
    and are segmented whole: time and memory grow with their length.
    """
    bounded_batches(docs.sparkSession)
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for c in W.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.count), pa.array(np.diff(c.of).astype(np.int64)), pa.array(counts_of(c, vocab).astype(np.int64))], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
