"""Words of many texts at once, as numpy arrays: no Python object per word.

A word is a longest stretch of bytes other than space and 0x09 to 0x0D, so its 64-bit hash is the same
wherever it stands. Texts are Arrow string arrays; null counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARK = _SPACE.copy()
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 4 << 20


def mix(a, b):
    """A 64-bit hash of the ordered pair (a, b), for arrays or numpy scalars of uint64."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of texts first to first+count-1 of the array; byte positions are within data."""

    first: int
    data: np.ndarray
    text_start: np.ndarray  # byte where each text starts, and the end of the last
    start: np.ndarray  # byte where each word starts
    end: np.ndarray
    hash: np.ndarray
    of: np.ndarray  # the word where each text's words start, and the number of words

    @property
    def count(self) -> int:
        return len(self.text_start) - 1

    @property
    def text(self) -> np.ndarray:
        """For each word, the number of its text within this chunk."""
        return np.repeat(np.arange(self.count), np.diff(self.of))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def _hashes(raw: np.ndarray, word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """raw: the bytes of all words without what lies between; word: where each starts in raw."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(int(sizes.max()), _STEP, np.uint64), dtype=np.uint64)
    within = np.arange(len(raw)) - np.repeat(word, sizes)
    sums = np.add.reduceat(_BYTE[raw] * powers[within], word)
    return mix(sums, sizes.astype(np.uint64))


def chunks(texts: pa.Array, lower: bool = False, marks: bool = False, size: int = CHUNK) -> Iterator[Words]:
    """The words of all texts, in chunks of whole texts.

    lower: A to Z count as a to z. marks: ASCII punctuation counts as space.
    """
    space = _MARK if marks else _SPACE
    raw, at = _buffer(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, n)
        data = raw[at[i] : at[j]]
        if lower:
            data = _UPPER[data]
        bounds = at[i : j + 1] - at[i]
        inside = ~space[data]
        edge = np.zeros(len(data) + 1, bool)  # a word starts or ends here
        if len(data):
            edge[1:-1] = inside[1:] != inside[:-1]
            edge[0], edge[-1] = inside[0], inside[-1]
        starts = edge[:-1] & inside
        ends = edge.copy()
        ends[:-1] &= ~inside
        # two texts that touch without a space between them are still two words
        for b in bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]:
            if inside[b] and inside[b - 1]:
                starts[b] = ends[b] = True
        s, e = np.flatnonzero(starts), np.flatnonzero(ends)
        sizes = e - s
        hashes = _hashes(data[inside], np.cumsum(sizes) - sizes, sizes)
        yield Words(i, data, bounds, s, e, hashes, np.searchsorted(s, bounds, "left"))
        i = j


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all stretches of size consecutive words, by doubling; across texts too, which the caller leaves out."""
    out, done, power, width = None, 0, hashes, 1
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    while True:
        if size & width:
            part = power[done : done + n]
            out = part if out is None else mix(out, part)
            done += width
        width *= 2
        if width > size:
            break
        power = mix(power[: -(width // 2)], power[width // 2 :])
    return out if size & (size - 1) else mix(out, np.full(len(out), size, np.uint64))


def window_ok(words: Words, size: int) -> np.ndarray:
    """Which of windows() lie within one text."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    ends = np.repeat(words.of[1:], np.diff(words.of))[:n]
    return np.arange(n) + size <= ends
