"""Count-min sketches built by tasks, merged by blocks, and looked up as a bitmap in tasks.

A sketch has a few rows of cells; an item adds its occurrences to one cell per row, so the least
of its cells is never below its count. Only one question is asked of the merged sketch: may an
item occur `threshold` times? So counts stop at the threshold, and what is kept is one bit a
cell. Items that do occur so often are never missed; others pass by chance, the more often the
fuller the sketch is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sightings.llm.storage import forget, get_file, kept, new_folder, put_file
from sightings.llm.wording import mixed

_BLOCK_BITS = 16
_BLOCK = 1 << _BLOCK_BITS
_BLOCKS_PER_FILE = 16
#: Occurrences that a task gathers before it hands over its part of the sketch.
_HELD = 1 << 21


@dataclass(frozen=True)
class Plan:
    """Rows of 2**bits cells; a count of `threshold` (255 at most) makes a cell full.

    `more` has higher counts, ascending, that are told apart too; these are not exact, as a task
    adds 255 at most to a cell at a time.
    """

    bits: int
    rows: int
    threshold: int
    more: tuple[int, ...] = ()

    @classmethod
    def of(
        cls, items: float, threshold: int, most_bits: int, rows: int = 2, room: float = 2.0, more: tuple[int, ...] = ()
    ) -> Plan:
        """As many cells a row as `room` times the items, and 2**most_bits at most."""
        bits = max(_BLOCK_BITS, min(most_bits, int(max(1.0, items * room)).bit_length()))
        return cls(bits, rows, min(threshold, 255), more)

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        own = mixed(h + np.uint64((row + 1) * 0xA0761D6478BD642F % (1 << 64)))
        return (own >> np.uint64(64 - self.bits)) + np.uint64(row << self.bits)


def _parts(plan: Plan, hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The cells that some hashes add to: block, and its cells with their counts, packed."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    h = np.concatenate(hashes)
    for row in range(plan.rows):
        cell, n = np.unique(plan.cells(h, row), return_counts=True)
        n = np.minimum(n, 255).astype(np.uint8)
        block = (cell >> np.uint64(_BLOCK_BITS)).astype(np.int32)
        at = (cell & np.uint64(_BLOCK - 1)).astype("<u2")
        del cell
        starts = np.nonzero(np.diff(block, prepend=-1))[0].tolist()
        packed = []
        for a, z in zip(starts, [*starts[1:], len(block)]):
            gaps = np.diff(at[a:z], prepend=at.dtype.type(0)).view(np.uint8)
            # Low bytes, high bytes and counts each by themselves compress best.
            packed.append(pack(gaps[::2].tobytes() + gaps[1::2].tobytes() + n[a:z].tobytes()))
        yield pa.RecordBatch.from_pydict({"block": pa.array(block[starts]), "cells": pa.array(packed, pa.binary())})


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(3, -1)
    gaps = raw[0].astype(np.uint16) | (raw[1].astype(np.uint16) << np.uint16(8))
    return np.cumsum(gaps, dtype=np.uint16), raw[2]


def build(df: DataFrame, hashed: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], plan: Plan) -> str:
    """The folder of the merged sketch of all items of `df`.

    `hashed` gives the items of a task's batches as arrays of unsigned 64-bit hashes. Each task
    hands over the cells that it added to, some bytes a cell; parts of a block are added up as
    they come, so a merging task holds one block and one file of bits.
    """
    folder = new_folder(df.sparkSession, "sketch")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(but=KIND)
        held: list[np.ndarray] = []
        for h in hashed(batches):
            if len(h):
                held.append(h)
            if sum(map(len, held)) >= _HELD:
                yield from _parts(plan, held)
                held = []
        if held:
            yield from _parts(plan, held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(but=KIND)
        file, block = -1, -1
        counts = (plan.threshold, *plan.more)
        bits = np.zeros((len(counts), _BLOCKS_PER_FILE, _BLOCK // 8), np.uint8)
        sums = np.zeros(_BLOCK, np.uint32)

        def close_block() -> None:
            if block >= 0:
                for k, n in enumerate(counts):
                    bits[k, block % _BLOCKS_PER_FILE] = np.packbits(sums >= n, bitorder="little")
                sums[:] = 0

        def close_file() -> pa.RecordBatch:
            put_file(folder, _name(file), [bits.tobytes()])
            out = pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32())})
            bits[:] = 0
            return out

        for b in batches:
            for own, data in zip(b.column(0).to_pylist(), b.column(1)):
                if own != block:
                    close_block()
                    block = own
                    if own // _BLOCKS_PER_FILE != file:
                        if file >= 0:
                            yield close_file()
                        file = own // _BLOCKS_PER_FILE
                at, n = _unpacked(data.as_py())
                sums[at] += n
        close_block()
        if file >= 0:
            yield close_file()

    parts = df.mapInArrow(count, "block int, cells binary")
    files = (plan.rows << plan.bits) // _BLOCK // _BLOCKS_PER_FILE + 1
    placed = parts.selectExpr(f"block div {_BLOCKS_PER_FILE} as file", "block", "cells")
    placed = placed.repartition(files, "file").sortWithinPartitions("block").select("block", "cells")
    placed.mapInArrow(merge, "file int").write.format("noop").mode("overwrite").save()
    return folder


def _name(file: int) -> str:
    return f"{file:06d}.bits"


#: Bitmaps that a task's worker holds: of the last few sketches.
_LOADED = 3
KIND = "bitmaps"


class Lookup:
    """Answers in a task whether items may occur `threshold` times; the bits are read once."""

    def __init__(self, folder: str, plan: Plan) -> None:
        self.folder, self.plan = folder, plan

    def _bits(self) -> np.ndarray:
        loaded: dict[str, np.ndarray] = kept(KIND)
        if self.folder not in loaded:
            forget(but=KIND)
            while len(loaded) >= _LOADED:
                loaded.pop(next(iter(loaded)))
            n = (self.plan.rows << self.plan.bits) // 8
            size = _BLOCKS_PER_FILE * _BLOCK // 8
            bits = np.zeros((1 + len(self.plan.more), n), np.uint8)
            for file in range(-(-n // size)):
                data = get_file(self.folder, _name(file))  # none where no cell was touched
                if data:
                    own = np.frombuffer(data, np.uint8).reshape(len(bits), size)[:, : n - file * size]
                    bits[:, file * size : file * size + own.shape[1]] = own
            loaded[self.folder] = bits
        return loaded[self.folder]

    def _reached(self, h: np.ndarray, counts: int) -> np.ndarray:
        bits = self._bits()
        out = np.ones((counts, len(h)), bool)
        for row in range(self.plan.rows):
            cell = self.plan.cells(h, row)
            at, bit = cell >> np.uint64(3), (cell & np.uint64(7)).astype(np.uint8)
            for k in range(counts):
                out[k] &= ((bits[k, at] >> bit) & 1).astype(bool)
        return out

    def may_reach(self, h: np.ndarray) -> np.ndarray:
        return self._reached(h, 1)[0]

    def level(self, h: np.ndarray) -> np.ndarray:
        """How many of the plan's counts each item may reach."""
        return self._reached(h, 1 + len(self.plan.more)).sum(axis=0)
