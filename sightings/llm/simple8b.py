"""Simple-8b coding of unsigned integers in NumPy.

A 64-bit word holds a 4-bit selector in its low bits and 60 bits of values, all of one width:
the selector says how many. Each word takes as many of the next values as fit. A value of
2**60 and more is an escape: a word of selector 0 holds its place in a list of whole values.

Values are coded in blocks of equal length that share no word. With the offset of each block's
first word, any block is decoded alone and all blocks are decoded at once, without a loop over
words.
"""

from __future__ import annotations

import numpy as np

# How many values of how many bits the selectors 1, 2, ... stand for.
LAYOUTS = [
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
    (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
]
ESCAPE = 0
SELECTOR_BITS = 4
BLOCK = 512
#: Values that are coded together, for memory.
_AT_ONCE = 1 << 16

_COUNTS = np.array([1] + [n for n, _ in LAYOUTS] + [0], np.int64)


_SHORT = np.array([v.bit_length() for v in range(1 << 16)], np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, exact for all 64 bits."""
    if values.max(initial=0) < len(_SHORT):
        return _SHORT[values.astype(np.uint16)]
    out = np.zeros(values.shape, np.uint8)
    for part in range(4):
        piece = (values >> np.uint64(16 * part)).astype(np.uint16)
        np.maximum(out, _SHORT[piece] + np.uint8(16 * part) * (piece > 0), out=out)
    return out


def _selectors(widths: np.ndarray, block: int) -> np.ndarray:
    """The densest selector that fits from each place on; widths has 60 empty places per block."""
    reach = {1: widths}

    def widest(n: int) -> np.ndarray:
        if n not in reach:
            half = 1 << ((n - 1).bit_length() - 1)
            base = widest(half)
            shifted = np.zeros_like(base)
            shifted[:, : base.shape[1] - (n - half)] = base[:, n - half :]
            reach[n] = np.maximum(base, shifted)
        return reach[n]

    out = np.full(widths.shape, ESCAPE, np.uint8)
    for k in range(len(LAYOUTS), 0, -1):
        n, bits = LAYOUTS[k - 1]
        fits = widest(n) <= bits
        if fits.any():
            np.copyto(out, np.uint8(k), where=fits)
    return out[:, :block]


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, offset of each block's first word and the end, escaped values)."""
    words, offsets, escaped = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], [np.zeros(0, np.uint64)]
    taken = 0
    step = max(1, _AT_ONCE // block) * block
    for k in range(0, len(values), step):
        w, o, e = _encode_part(np.ascontiguousarray(values[k : k + step], np.uint64), block, taken)
        words.append(w)
        offsets.append(o[1:] + offsets[-1][-1])
        escaped.append(e)
        taken += len(e)
    return np.concatenate(words), np.concatenate(offsets), np.concatenate(escaped)


def _encode_part(
    values: np.ndarray, block: int, taken: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for some blocks, with `taken` escapes before them."""
    n = len(values)
    rows = -(-n // block)
    wide = np.zeros((rows, block + 60), np.uint64)
    even = n // block
    wide[:even, :block] = values[: even * block].reshape(even, block)
    wide[even:, : n - even * block] = values[even * block :]
    selectors = _selectors(_widths(wide), block)
    ends = np.full(rows, block, np.int64)
    ends[-1] = n - (rows - 1) * block

    # All blocks take a word at each step, until the last one is through.
    at, every, steps = np.zeros(rows, np.int64), np.arange(rows), []
    while True:
        live = at < ends
        if not live.any():
            break
        steps.append(np.where(live, at, -1))
        at = at + np.where(live, _COUNTS[selectors[every, np.minimum(at, block - 1)]], 0)
    places = np.stack(steps, axis=1)
    row, step = np.nonzero(places >= 0)
    place = places[row, step]
    chosen = selectors[row, place]
    words = np.zeros(len(row), np.uint64)
    flat, at = wide.reshape(-1), row * wide.shape[1] + place
    for k in np.unique(chosen):
        if k == ESCAPE:
            continue
        many, bits = LAYOUTS[k - 1]
        own = np.nonzero(chosen == k)[0]
        first, packed = at[own], np.full(len(own), k, np.uint64)
        for i in range(many):
            packed |= flat.take(first + i) << np.uint64(SELECTOR_BITS + bits * i)
        words[own] = packed
    escaped = np.nonzero(chosen == ESCAPE)[0]
    places_of = np.arange(taken, taken + len(escaped), dtype=np.uint64)
    words[escaped] = places_of << np.uint64(SELECTOR_BITS)
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum((places >= 0).sum(axis=1), out=offsets[1:])
    return words, offsets, wide[row[escaped], place[escaped]]


def decode(
    words: np.ndarray,
    offsets: np.ndarray,
    escaped: np.ndarray,
    n: int,
    block: int = BLOCK,
    first: int = 0,
    last: int | None = None,
) -> np.ndarray:
    """The values of blocks `first` to `last` (end exclusive, default all); n: all values."""
    rows = len(offsets) - 1
    last = rows if last is None else min(last, rows)
    if first >= last:
        return np.zeros(0, np.uint64)
    bounds = offsets[first : last + 1] - offsets[first]
    part = words[offsets[first] : offsets[last]]
    selectors = (part & np.uint64(15)).astype(np.uint8)
    if (selectors > len(LAYOUTS)).any():
        raise ValueError("a word has a selector that is not in use")
    counts = _COUNTS[selectors]
    before = np.cumsum(counts) - counts
    row = np.repeat(np.arange(last - first), np.diff(bounds))
    place = before - before[bounds[:-1]][row]
    out = np.zeros((last - first, block + 60), np.uint64)
    for k in np.unique(selectors):
        own = np.nonzero(selectors == k)[0]
        if k == ESCAPE:
            out[row[own], place[own]] = escaped[(part[own] >> np.uint64(SELECTOR_BITS)).astype(np.int64)]
            continue
        many, bits = LAYOUTS[k - 1]
        shifts = (SELECTOR_BITS + bits * np.arange(many)).astype(np.uint64)
        taken = (part[own][:, None] >> shifts) & np.uint64((1 << bits) - 1)
        out[row[own][:, None], place[own][:, None] + np.arange(many)] = taken
    return out[:, :block].reshape(-1)[: min(n, last * block) - first * block]
