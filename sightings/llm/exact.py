"""Exact duplicates by counting quotient filters (operator 5)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightings.session import cut, ship

#: Fingerprints that one shard of the filter should hold.
SHARD_FINGERPRINTS = 2_000_000
#: Bits that name a shard at most: 65,536 shards of the above are 130 billion rows.
MOST_SHARD_BITS = 16
#: Fingerprints that a task gathers before it hands over its filter.
BUFFER = 2_000_000
#: Repeated fingerprints (8 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_FINGERPRINTS = 1_000_000

_HEADER = struct.Struct("<4sBBQQ")
_MAGIC = b"CQF2"
_PACKED_AT_ONCE = 1 << 16


def _pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned numbers of `width` bits, one after the other."""
    out, carry = [], np.zeros(0, np.uint8)
    for k in range(0, len(values), _PACKED_AT_ONCE):
        part = values[k : k + _PACKED_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits = np.concatenate([carry, np.unpackbits(part, axis=1)[:, 64 - width :].reshape(-1)])
        whole = len(bits) // 8 * 8
        out.append(np.packbits(bits[:whole]).tobytes())
        carry = bits[whole:]
    return b"".join([*out, np.packbits(carry).tobytes()])


def _unpack(data: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    step = _PACKED_AT_ONCE // 8 * 8  # whole bytes, whatever the width
    for k in range(0, n, step):
        m = min(step, n - k)
        at = k * width // 8
        bits = np.unpackbits(data[at : at + -(-m * width // 8)])[: m * width].reshape(m, width)
        wide = np.zeros((m, 64), np.uint8)
        wide[:, 64 - width :] = bits
        out[k : k + m] = np.packbits(wide, axis=1).view(">u8").reshape(-1)
    return out


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


class CountingQuotientFilter:
    """A multiset of 64-bit fingerprints as runs of sorted remainders.

    A fingerprint's first bits name the shard, which is the filter's `prefix` of `bits` bits; the
    next `q` bits are its quotient, the rest its remainder. `occupied` has a bit per quotient that
    has a run. `slots` has the runs one after the other, remainders ascending, and `run_end` marks
    the last slot of each. A remainder that occurs more than once is followed by its count, in
    slots that `counter` marks. So a fingerprint costs its remainder and two bits, and its share
    of the quotients' bits; a count costs a slot. Runs are in the order of the fingerprints, so
    filters merge as sorted lists do, without loss and without the texts.
    """

    def __init__(self, prefix, bits, q, occupied, run_end, counter, slots) -> None:
        self.prefix, self.bits, self.q = prefix, bits, q
        self.occupied, self.run_end, self.counter, self.slots = occupied, run_end, counter, slots

    @classmethod
    def from_sorted(cls, fingerprints: np.ndarray, counts: np.ndarray, prefix: int = 0, bits: int = 0):
        """From distinct ascending fingerprints that begin with the prefix, and their counts."""
        n = len(fingerprints)
        # No more quotients than fingerprints; slots wide enough for a count in two.
        q = min(max(0, n.bit_length() - 1), 32 - bits)
        r = 64 - bits - q
        quotient = ((fingerprints >> np.uint64(r)) & np.uint64((1 << q) - 1)).astype(np.int64)
        remainder = fingerprints & np.uint64((1 << r) - 1)
        counts = counts.astype(np.uint64)
        high = counts >> np.uint64(r)
        digits = (counts > 1).astype(np.int64) + (high > 0)
        at = np.cumsum(1 + digits) - 1 - digits
        slots = np.zeros(n + int(digits.sum()), np.uint64)
        counter = np.ones(len(slots), bool)
        slots[at], counter[at] = remainder, False
        slots[at[digits > 0] + 1] = counts[digits > 0] & np.uint64((1 << r) - 1)
        slots[at[digits > 1] + 2] = high[digits > 1]
        occupied, run_end = np.zeros(1 << q, bool), np.zeros(len(slots), bool)
        occupied[quotient] = True
        if n:
            last = np.append(quotient[1:] != quotient[:-1], True)
            run_end[(at + digits)[last]] = True
        return cls(prefix, bits, q, occupied, run_end, counter, slots)

    @classmethod
    def of(cls, fingerprints: np.ndarray, prefix: int = 0, bits: int = 0):
        """From unsigned fingerprints in any order; equal ones are counted."""
        return cls.from_sorted(*np.unique(fingerprints, return_counts=True), prefix, bits)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct fingerprints, ascending, and their counts."""
        r = 64 - self.bits - self.q
        own = ~self.counter
        # A slot's run is the number of run ends before it; runs are those of the occupied quotients.
        run = np.cumsum(self.run_end) - self.run_end
        quotient = np.nonzero(self.occupied)[0][run[own]].astype(np.uint64)
        head = np.uint64(self.prefix << (64 - self.bits) if self.bits else 0)
        found = head | (quotient << np.uint64(r)) | self.slots[own]
        place = np.cumsum(own) - 1
        counts = np.ones(len(found), np.uint64)
        first = self.counter & ~np.append(False, self.counter[:-1])
        counts[place[first]] = self.slots[first]
        second = self.counter & ~first
        counts[place[second]] += self.slots[second] << np.uint64(r)
        return found, counts.astype(np.int64)

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both as one: two ascending lists are laid into each other, equal ones add their counts."""
        if (self.prefix, self.bits) != (other.prefix, other.bits):
            raise ValueError("filters of different shards don't merge")
        (x, n), (y, m) = self.items(), other.items()
        at = np.searchsorted(x, y)
        same = at < len(x)
        same[same] = x[at[same]] == y[same]
        n[at[same]] += m[same]
        y, m, at = y[~same], m[~same], at[~same]
        to = at + np.arange(len(y))
        both, counts = np.empty(len(x) + len(y), np.uint64), np.empty(len(x) + len(y), np.int64)
        rest = np.ones(len(both), bool)
        rest[to] = False
        both[to], counts[to] = y, m
        both[rest], counts[rest] = x, n
        return self.from_sorted(both, counts, self.prefix, self.bits)

    def to_bytes(self) -> bytes:
        head = _HEADER.pack(_MAGIC, self.bits, self.q, self.prefix, len(self.slots))
        flags = [_bits(self.occupied), _bits(self.run_end), _bits(self.counter)]
        return b"".join([head, *flags, _pack(self.slots, 64 - self.bits - self.q)])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        magic, bits, q, prefix, n = _HEADER.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a counting quotient filter")
        raw, at = np.frombuffer(data, np.uint8), _HEADER.size
        flags = []
        for size in (1 << q, n, n):
            flags.append(np.unpackbits(raw[at : at + -(-size // 8)], count=size).astype(bool))
            at += -(-size // 8)
        return cls(prefix, bits, q, *flags, _unpack(raw[at:], n, 64 - bits - q))


def _shards(fingerprints: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """A filter per shard, which the first bits name."""
    f, n = np.unique(fingerprints, return_counts=True)
    top = (f >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(f), np.int64)
    bounds = np.searchsorted(top, np.arange((1 << bits) + 1))
    for k in np.unique(top).tolist():
        own = slice(bounds[k], bounds[k + 1])
        yield k, CountingQuotientFilter.from_sorted(f[own], n[own], k, bits).to_bytes()


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """fp, n of the 64-bit fingerprints (column fp) that occur more than once.

    Each task builds filters of what it reads, one per shard; the filters of a shard merge two by
    two as they come, so a merging task holds the distinct fingerprints of a shard, whatever
    their counts. `rows` sets the number of shards.
    """
    bits = min(MOST_SHARD_BITS, max(0, (rows // SHARD_FINGERPRINTS).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def give() -> pa.RecordBatch:
            parts = list(_shards(np.concatenate(held).view(np.uint64), bits))
            held.clear()
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([k for k, _ in parts], pa.int32()),
                    "filter": pa.array([x for _, x in parts], pa.binary()),
                }
            )

        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= BUFFER:
                yield give()
        if held:
            yield give()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Parts come sorted by shard. Two merge when the later is as large, so each item few times.
        shard: int | None = None
        waiting: list[CountingQuotientFilter] = []

        def told() -> pa.RecordBatch:
            while len(waiting) > 1:
                last = waiting.pop()
                waiting[-1] = waiting[-1].merged(last)
            found, counts = waiting.pop().items()
            more = counts > 1
            return pa.RecordBatch.from_pydict(
                {"fp": pa.array(found[more].view(np.int64)), "n": pa.array(counts[more], pa.int64())}
            )

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                if k != shard and waiting:
                    yield told()
                shard = k
                waiting.append(CountingQuotientFilter.from_bytes(x.as_py()))
                while len(waiting) > 1 and len(waiting[-1].slots) >= len(waiting[-2].slots):
                    last = waiting.pop()
                    waiting[-1] = waiting[-1].merged(last)
        if waiting:
            yield told()

    parts = fingerprints.select("fp").mapInArrow(build, "shard int, filter binary")
    placed = parts.repartition(max(1, 1 << bits), "shard").sortWithinPartitions("shard")
    return placed.mapInArrow(merge, "fp long, n long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the largest
    doc_id stays. Fingerprints (XXH64 of the text) are counted in counting quotient filters;
    only texts whose fingerprint occurs more than once are compared, as whole texts, in an
    aggregate that combines copies before the shuffle, so a group of any size is no task's own.
    A document is named by its doc_id: rows that repeat id and text share its fate. A row
    without an id stays only where no row of its text has one. Other columns are left aside;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base = base.withColumn("fp", F.xxhash64("text"))
    rows = base.count()
    suspects = cut(repeated_fingerprints(base, rows))
    few = suspects.count() <= BROADCAST_FINGERPRINTS
    wanted = F.broadcast(suspects.select("fp")) if few else suspects.select("fp")
    named = base.select("doc_id", "fp", F.sha2("text", 256).alias("text_sha256"))
    compared = (
        base.join(wanted, "fp", "left_semi")
        .groupBy("fp", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("fp", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    d = named.join(compared, ["fp", "text_sha256"], "left")
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return d.select(
        "doc_id",
        keep.alias("keep_id"),
        size.alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
