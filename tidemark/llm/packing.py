"""Sum-of-squares packing of tokenized documents into windows of a fixed length.

Every input partition is one stream with its own level array, so nothing is shuffled. A document first
fills whole windows alone; what is left of it goes to the fill level that keeps the sum over levels of
the squared number of partially filled windows smallest. Windows still open at the end of a stream, or
when more than ``max_open`` are open, are merged by cutting the emptiest into the gaps of the fullest, so
that one window at most stays partial in each stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches

WINDOW, END_ID, MAX_OPEN = 2048, 1, 1024
#: Entries of the piece cache of a worker, which is emptied beyond them: about 200 MB.
CACHE_ENTRIES = 800_000

_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS, _MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", ".,;:!?|*#%$&<>()\"/"
#: Stretches of a text that the byte-level pre-tokenizer never joins with their neighbours, so that each is
#: encoded the same alone as within its text: plain words and marks, other stretches without white space,
#: and white space.
PIECE = re.compile(f" ?[{_LETTERS}]+(?=[{_MARKS}{_WS}]|$)| ?[{_MARKS}]+(?=[{_LETTERS}{_WS}]|$)| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
_BLANK = re.compile(f"[{_WS}]*")

_encoders: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of texts as little-endian uint32 bytes; pieces met before aren't encoded again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the tokenizer's own tokens (end of text and the like) are found first, and what lies between is cut
        self.own = {x.content: np.array([i], "<u4").tobytes() for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.own, key=len, reverse=True))) + ")").split if self.own else lambda text: [text]
        (self.line_feed,) = self._ids("\n")
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces at once, as lines: a line feed between them is a token of its own."""
        ids = np.array(self._ids("\n".join(pieces)), "<u4")
        cuts = np.flatnonzero(ids == self.line_feed)
        assert len(cuts) == len(pieces) - 1
        raw = ids.tobytes()
        for piece, a, b in zip(pieces, [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), len(raw)]):
            self.known[piece] = raw[a:b]

    def _pieces(self, text: str) -> list[str]:
        first, *rest = self.split(text)
        out = PIECE.findall(first)
        for own, between in zip(rest[::2], rest[1::2]):
            self.known[own] = self.own[own]
            out += [own, *PIECE.findall(between)]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        known, pieces = self.known, [self._pieces(x) for x in texts]
        new = list(set().union(*pieces).difference(known)) if pieces else []
        solid = [x for x in new if not _BLANK.fullmatch(x)]
        for i in range(0, len(solid), 500):
            self._learn(solid[i : i + 500])
        for x in set(new).difference(solid):
            known[x] = np.array(self._ids(x), "<u4").tobytes()
        return [b"".join(map(known.__getitem__, x)) for x in pieces]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """One stream of documents into windows; rows of closed windows gather in ``rows``."""

    def __init__(self, window: int, max_open: int, first_sequence: int):
        self.window, self.max_open, self.sequence = window, max_open, first_sequence
        self.levels = np.zeros(window + 1, np.int64)
        self.bins: dict[int, list[list[tuple]]] = {}
        self.open = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, ids, total, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def put(self, level: int, pieces: list[tuple]) -> None:
        self.levels[level] += 1
        self.bins.setdefault(level, []).append(pieces)
        self.open += 1

    def take(self, level: int) -> list[tuple]:
        self.levels[level] -= 1
        self.open -= 1
        return self.bins[level].pop()

    def level_for(self, size: int) -> int:
        """The level that an item of this size goes to; 0 stands for a new window. Ties: the fullest."""
        n, room = self.levels, self.window - size
        best, cost = 0, 2 * n[size] + 1
        if room > 0:
            change = 2 * (n[1 + size : room + size + 1] - n[1 : room + 1] + 1)
            change[-1] = 1 - 2 * n[room]  # the window becomes full and is no longer counted
            change[n[1 : room + 1] == 0] = np.iinfo(np.int64).max
            last = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[last] <= cost:
                best = last + 1
        return best

    def add(self, doc_id, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            self.close([(doc_id, start, ids[4 * start : 4 * (start + self.window)], total)])
            start += self.window
        size = total - start
        if not size:
            return
        level = self.level_for(size)
        pieces = self.take(level) if level else []
        pieces.append((doc_id, start, ids[4 * start :], total))
        if level + size == self.window:
            self.close(pieces)
        else:
            self.put(level + size, pieces)
            if self.open > self.max_open:
                self.merge()

    def merge(self) -> None:
        """Cuts the emptiest open windows into the gaps of the fullest, until one at most is open."""
        queue = [(level, pieces) for level in sorted(self.bins, reverse=True) for pieces in self.bins[level]]
        self.bins.clear()
        self.levels[:] = 0
        self.open = 0
        low, i = len(queue) - 1, 0
        spare = list(queue[low][1]) if queue else []
        while i < low:
            level, pieces = queue[i]
            while level < self.window and i < low:
                doc_id, start, ids, total = spare[-1]
                part = min(self.window - level, len(ids) // 4)
                keep = len(ids) // 4 - part
                pieces.append((doc_id, start + keep, ids[4 * keep :], total))
                level += part
                if keep:
                    spare[-1] = (doc_id, start, ids[: 4 * keep], total)
                else:
                    spare.pop()
                    if not spare:
                        low -= 1
                        spare = list(queue[low][1]) if low > i else []
            if level == self.window:
                self.close(pieces)
            else:
                spare = pieces
            i += 1
        if spare:
            self.put(sum(len(x[2]) for x in spare) // 4, spare)

    def end(self) -> None:
        self.merge()
        for level in list(self.bins):
            while self.bins[level]:
                self.close(self.take(level))


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _rows(packer: Packer) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*packer.rows), _ARROW)], schema=_ARROW)
    packer.rows = []
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN) -> DataFrame:
    """The pieces of all documents with their place in the packed windows.

    docs: doc_id and text; other columns are left out. Each document is its token ids and then end_id,
    so a null or empty text is one token. Columns: doc_id, start (the document's ids before the piece),
    length, ids (little-endian uint32), doc_tokens, sequence_id, offset. Repeated rows are packed as
    often as they stand there; a null doc_id stays null; an empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        packer = Packer(window, max_open, TaskContext.get().partitionId() << 33)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(ids), 256):
                for doc_id, found in zip(ids[i : i + 256], encode([x or "" for x in texts[i : i + 256]])):
                    packer.add(doc_id, found + end)
                if len(packer.rows) > 2000:
                    yield _rows(packer)
        packer.end()
        if packer.rows:
            yield _rows(packer)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, SCHEMA)


def digests(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
