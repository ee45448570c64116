"""Words of texts as arrays of hashes, a bounded number of words at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Words that a task holds at once, but for a text that is longer by itself.
CHUNK_WORDS = 1 << 19
#: Words whose hashes a task remembers.
_KNOWN_WORDS = 250_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD1342543DE82EF95


class Lexicon(dict):
    """XXH64 of words (bytes), remembered; `forget` keeps it small."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = found = xxhash.xxh64_intdigest(word)
        return found

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def forget(self) -> None:
        if len(self) > _KNOWN_WORDS:
            self.clear()


def mixed(h: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits spread over all of them, one to one."""
    h = (h ^ (h >> np.uint64(31))) * _ODD
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_SPACES = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
_SPACE = np.zeros(256, bool)
_SPACE[list(b"".join(_SPACES))] = True
_BYTE_STEP = 0xE7037ED1A0B428DB
#: A stretch of text whose words are hashed at once, and a word's length from which it is by itself.
_STRETCH, _LONG_WORD = 1 << 17, 64


@cache
def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of the step and of its inverse."""
    letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    powers = np.full(_STRETCH + 1, _BYTE_STEP, np.uint64)
    back = np.full(_STRETCH + 1, pow(_BYTE_STEP, -1, 1 << 64), np.uint64)
    powers[0] = back[0] = 1
    return letters, np.cumprod(powers), np.cumprod(back)


def _stretch_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a stretch: a polynomial of a word's bytes, by sums of all."""
    import xxhash

    letters, powers, back = _byte_tables()
    b = np.frombuffer(data, np.uint8)
    word = np.zeros(len(b) + 2, bool)
    word[1:-1] = ~_SPACE[b]
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, end = edges[::2], edges[1::2]
    if len(b) > _STRETCH:  # one word that is longer than a stretch
        return np.array([xxhash.xxh64_intdigest(data[s:e]) for s, e in zip(start, end)], np.uint64), start
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(letters[b] * powers[: len(b)], out=sums[1:])
    h = (sums[end] - sums[start]) * back[start]
    h = mixed(h + (end - start).astype(np.uint64) * _ODD)
    for k in np.flatnonzero(end - start >= _LONG_WORD).tolist():
        h[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]])
    return h, start


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words between ASCII white space, and how many words each text has."""
    data = b"\n".join(texts)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + _STRETCH)
        if end < len(data):
            # Up to the last white space; a word that is longer than a stretch is one by itself.
            last = max(data.rfind(c, at, end) for c in _SPACES)
            later = [k for k in (data.find(c, end) for c in _SPACES) if k >= 0] if last < 0 else [last]
            end = min(later, default=len(data) - 1) + 1
        h, start = _stretch_hashes(data[at:end])
        hashes.append(h)
        starts.append(start + at)
        at = end
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    found = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return found, np.diff(np.searchsorted(start, bounds))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive word hashes: a polynomial, by differences of its sums."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    powers = np.full(n, _STEP, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    back = np.full(n - width + 1, pow(_STEP, -1, 1 << 64), np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers, out=sums[1:])
    return (sums[width:] - sums[:-width]) * back


def chunks(batches: Iterator[pa.RecordBatch], words_of, text: int, most: int = CHUNK_WORDS):
    """(rows, words) lists: rows as tuples of the other columns, and the words of each.

    `words_of` makes the list of words of a text given as bytes; a null text is empty.
    """
    rows: list[tuple] = []
    words: list[list[bytes]] = []
    held = 0
    for b in batches:
        others = [b.column(k).to_pylist() for k in range(b.num_columns) if k != text]
        for t, *row in zip(b.column(text).cast(pa.binary()), *others):
            own = words_of(t.as_py() or b"")
            rows.append(tuple(row))
            words.append(own)
            held += len(own)
            if held >= most:
                yield rows, words
                rows, words, held = [], [], 0
    if rows:
        yield rows, words
