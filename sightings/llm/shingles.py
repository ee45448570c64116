"""Near copies by the Jaccard similarity of whole shingle sets, without a miss.

SimHash fingerprints find what is nearest; what lies further apart than their index carries meets
by shared prefixes of the shingle sets. Every candidate is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightings.llm import simhash, sketch
from sightings.llm.components import components
from sightings.llm.storage import forget
from sightings.llm.wording import hashed_words, mixed, window_hashes
from sightings.session import cut, ship

SHINGLE = 5
SIMILARITY = 0.8
#: Occurrences from which a shingle is taken for more frequent than others; they decide about time alone.
FREQUENT = (8, 32, 128, 512, 2048, 8192)
#: Cells of the sketch of frequencies and of the one of keys, as a power of two: 4 MB of bits for each
#: frequency and 16 MB in each Python worker.
FREQUENT_BITS, MOST_BITS = 25, 27
#: Parity bits of a text at least.
LEAST_BITS = 1024
#: Nodes of a key that meet in one task; a key of more is dealt out as pairs of blocks.
BLOCK = 1024
#: Rounds in which a key gives no more pairs than connect its nodes, before the rest are compared.
SPANNING_ROUNDS = 3

_NEAR_ZERO = 1e-9
_WORD_BYTES = 6
#: Nodes whose keys a task has given and doesn't give again, and pairs that it has compared.
_KNOWN_NODES = 1 << 18
_KNOWN_PAIRS = 1 << 18
#: Bytes of shingle sets that a task remembers while it compares pairs.
_KNOWN_BYTES = 64 << 20


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Per text the hashes of its distinct shingles, ascending; words as in `simhash`."""
    h, sizes = hashed_words([t.lower() for t in texts])
    whole = mixed(window_hashes(h, shingle))
    out, at = [], 0
    for n in sizes.tolist():
        if n >= shingle:
            out.append(np.unique(whole[at : at + n - shingle + 1]))
        else:
            out.append(mixed(window_hashes(h[at : at + n], n)) if n else np.zeros(0, np.uint64))
        at += n
    return out


def _sets(batches: Iterator[pa.RecordBatch], shingle: int, text: int = 0):
    """Each batch with the shingle sets of its texts."""
    for b in batches:
        yield b, shingle_sets([t.as_py() or b"" for t in b.column(text).cast(pa.binary())], shingle)


def prefix(found: np.ndarray, similarity: float, level: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which similar sets share one; `level` grows with their frequency.

    Sets of n shingles share ceil(similarity * n) at least, so one of any n - that + 1 of them
    is shared, and under one order of all shingles it is among the first ones of both. The order
    is by level, then by digest, so that the rarest come first.
    """
    n = len(found)
    taken = n - math.ceil(similarity * n - _NEAR_ZERO) + 1
    return found[np.argsort(level, kind="stable")[: min(taken, n)]]


def parity(found: np.ndarray) -> bytes:
    """Bits that say of how many shingles fall on each, modulo two: about one bit a shingle.

    Sets differ in at least as many shingles as their bits differ.
    """
    bits = max(LEAST_BITS, 1 << max(0, len(found) - 1).bit_length())
    odd = np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _folded(x: bytes) -> np.ndarray:
    """The parity bits of as few places as any text has."""
    a = np.frombuffer(x, np.uint64)
    while len(a) > LEAST_BITS // 64:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def least_difference(x: bytes, y: bytes) -> int:
    """Shingles in which two sets differ at least, by their bits."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _room(n: int | np.ndarray, m: int | np.ndarray, similarity: float):
    """Shingles in which sets of n and m may differ."""
    return (n + m) * (1 - similarity) / (1 + similarity) + _NEAR_ZERO


def keyed(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key, node, n, fp, bits, keys per row: digest and size of the shingle set.

    Rows of one set are one node. fp (its SimHash), bits (its parity) and keys (places and
    shingles of its prefix that may occur in another prefix too) are given with a node's first
    row in a task, and null with later ones. Two sketches over all texts serve: one tells how
    frequent shingles are, so that rare ones come first in all prefixes, the other keys that occur once.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"))
    items = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / _WORD_BYTES
    common = sketch.Plan.of(items, FREQUENT[0], FREQUENT_BITS, rows=1, room=0.25, more=FREQUENT[1:])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, sets in _sets(batches, shingle):
            yield np.concatenate(sets) if sets else np.zeros(0, np.uint64)

    frequent = sketch.Lookup(sketch.build(texts, shingles, common), common)
    share = 1 - similarity
    twice = sketch.Plan.of(items * share, 2, MOST_BITS, rows=1, room=4.0)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, sets in _sets(batches, shingle):
            yield np.concatenate([prefix(s, similarity, frequent.level(s)) for s in sets])

    repeated = sketch.Lookup(sketch.build(texts, prefixes, twice), twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        given: set[int] = set()
        for b, sets in _sets(batches, shingle, 2):
            nodes, sizes, prints, bits, keys = [], [], [], [], []
            for t, found in zip(b.column(2), sets):
                node = xxhash.xxh64_intdigest(found.tobytes())
                nodes.append(node)
                sizes.append(len(found))
                if node in given:
                    prints.append(None)
                    bits.append(None)
                    keys.append(None)
                    continue
                if len(given) < _KNOWN_NODES:
                    given.add(node)
                fp = simhash.fingerprint(t.as_py(), shingle)
                prints.append(fp - ((fp >> 63) << 64))
                bits.append(parity(found))
                first = prefix(found, similarity, frequent.level(found))
                at = np.nonzero(repeated.may_reach(first))[0]
                keys.append([{"pos": p, "key": k} for p, k in zip(at.tolist(), first[at].view(np.int64).tolist())])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(bits, pa.binary()),
                    pa.array(keys, pa.list_(pa.struct([("pos", pa.int32()), ("key", pa.int64())]))),
                ],
                ["doc_id", "text_key", "node", "n", "fp", "bits", "keys"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), text.alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id long, text_key long, node long, n int, fp long, bits binary, keys array<struct<pos:int,key:long>>",
    )


def _text_key() -> F.Column:
    """The digest by which `simhash.keep_first` knows a row's text."""
    return F.xxhash64(F.col("text").cast("string"))


def _may_reach(a: str, b: str, similarity: float):
    """Whether sizes and places of a shared key leave room for the similarity.

    What two sets share at or after the key is at most what the shorter rest has; where they
    share an earlier key too, this one adds no pair that the earlier doesn't.
    """
    need = F.lit(similarity / (1 + similarity)) * (F.col(f"{a}n") + F.col(f"{b}n"))
    rest = F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos"))
    sizes = F.least(f"{a}n", f"{b}n") >= F.lit(similarity) * F.greatest(f"{a}n", f"{b}n") - _NEAR_ZERO
    return sizes & (rest >= need - _NEAR_ZERO)


def _by_bits(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose parity bits leave room for the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[2:]]
            held = [least_difference(x, y) <= _room(n, m, similarity) for n, x, m, y in zip(*columns)]
            yield batch.select([0, 1]).filter(pa.array(held, pa.bool_()))

    side = lambda c, n, x: nodes.select(F.col("node").alias(c), F.col("n").alias(n), F.col("bits").alias(x))
    both = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
    return both.select("a", "b", "n", "x", "m", "y").mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (columns a, b of nodes) whose whole shingle sets reach the similarity.

    Parity bits leave few pairs. Of their nodes one text each is fetched; texts that no pair
    needs are sorted out by a bitmap where they are read, before the shuffle.
    """
    left = cut(_by_bits(pairs, nodes, similarity))
    wanted = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    wanted = cut(nodes.join(wanted, "node").select("node", "text_key"))
    n = wanted.count()
    if n == 0:
        return left
    plan = sketch.Plan.of(n, 1, MOST_BITS, rows=2, room=8.0)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            yield b.column(0).to_numpy().view(np.uint64)

    lookup = sketch.Lookup(sketch.build(wanted.select("text_key"), asked, plan), plan)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(lookup.may_reach(b.column(0).to_numpy().view(np.uint64))))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(_text_key().alias("text_key"), text.alias("text")).mapInArrow(only, "text_key long, text string")
    texts = cut(texts.join(wanted, "text_key").dropDuplicates(["node"]).select("node", "text"))
    both = left.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known: dict[int, np.ndarray] = {}
        size = 0

        def found(node: int, text: pa.Scalar) -> np.ndarray:
            nonlocal size
            if (own := known.get(node)) is None:
                (own,) = shingle_sets([text.as_py().encode()], shingle)
                if size + own.nbytes > _KNOWN_BYTES:
                    known.clear()
                    size = 0
                known[node] = own
                size += own.nbytes
            return own

        for batch in batches:
            held = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                one, other = found(a, x), found(b, y)
                shared = len(np.intersect1d(one, other, assume_unique=True))
                held.append(shared >= similarity * (len(one) + len(other) - shared) - _NEAR_ZERO)
            yield batch.select([0, 1]).filter(pa.array(held, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _fingerprint_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """a, b: nodes of equal fingerprints, and the least nodes of fingerprints that are near."""
    lead = cut(nodes.groupBy("fp").agg(F.min("node").alias("lead")))
    alike = nodes.join(lead, "fp").filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    links = simhash.links(lead.select("fp"), distance)
    links = links.join(lead.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a")
    links = links.join(lead.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b")
    return alike.unionByName(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def _bucket_pairs(
    shared: DataFrame, nodes: DataFrame, tied: DataFrame, similarity: float, block: int, spanning: int | None = None
) -> DataFrame:
    """a, b: nodes that share a key, are not yet in one component, and may reach the similarity.

    The nodes of a key meet in one task, with their bits, and only pairs that pass sizes, places
    and bits become rows. A key of more than `block` nodes is cut into blocks, each pair of blocks
    being a piece of its own. With the number of a `spanning` round a piece gives only as many
    pairs as connect what its pairs connect, so a group of near copies gives a row per node; each
    round takes the nodes in another order, and so other pairs.
    """
    of = shared.join(tied, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = of.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("nodes"))
    blocks = F.when(F.col("nodes") > block, F.ceil(F.col("nodes") / block * 2)).otherwise(1).cast("long")
    several = several.filter("low <> high").select("key", blocks.alias("blocks"))
    of = cut(of.join(several, "key").join(nodes.select("node", "bits"), "node"))
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks"))
    met = of.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    piece = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    met = met.select("key", piece.alias("piece"), side.alias("side"), "node", "n", "pos", "root", "bits")
    order = F.xxhash64("node", F.lit(spanning or 0))
    met = met.withColumn("order", order).repartition("key", "piece").sortWithinPartitions("key", "piece", "order")
    met = met.drop("order")

    def pairs_of(rows: list[tuple], seen: set) -> Iterator[tuple[int, int]]:
        side, node, n, pos, root = (np.array(c, np.int64) for c in zip(*[r[:5] for r in rows]))
        bits = np.stack([_folded(r[5]) for r in rows])
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, len(rows)) if spanning is None else np.flatnonzero(root != root[i])
            both = n[i] + n[j]
            rest = np.minimum(n[i] - pos[i], n[j] - pos[j])
            fits = (root[j] != root[i]) & ((side[j] != side[i]) | (side[j] == 2))
            fits &= np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - _NEAR_ZERO
            fits &= rest >= similarity / (1 + similarity) * both - _NEAR_ZERO
            if not fits.any():
                continue
            j = j[fits]
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            j = j[apart <= _room(n[i], n[j], similarity)]
            if spanning is not None:
                # One pair for each component that this node meets; they are one from now on.
                roots, first = np.unique(root[j], return_index=True)
                root = np.where(np.isin(root, roots), root[i], root)
                j = j[first]
            for k in j.tolist():
                pair = (int(min(node[i], node[k])), int(max(node[i], node[k])))
                if pair in seen:
                    continue
                if len(seen) < _KNOWN_PAIRS:
                    seen.add(pair)
                if least_difference(rows[i][5], rows[k][5]) <= _room(n[i], n[k], similarity):
                    yield pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[tuple[int, int]] = set()
        at, rows, out = None, [], []

        def give() -> pa.RecordBatch:
            a, b = zip(*out) if out else ((), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for key, piece, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if (key, piece) != at:
                    out.extend(pairs_of(rows, seen) if len(rows) > 1 else ())
                    at, rows = (key, piece), []
                rows.append(row)
            if len(out) > 50_000:
                yield give()
        out.extend(pairs_of(rows, seen) if len(rows) > 1 else ())
        yield give()

    return met.mapInArrow(run, "a long, b long").distinct()


def similar_groups(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY,
    distance: int = simhash.DISTANCE, block: int = BLOCK,
) -> DataFrame:
    """doc_id, text_key, root per row: groups linked by similar shingle sets.

    Two texts link when the Jaccard similarity of their whole sets of shingles is at least
    `similarity`; root is the least node of the component. Null and empty texts are one node,
    rows that repeat a text too; an empty table gives no rows, other columns are left aside.

    Candidates come in three steps, each verified before the next. SimHash fingerprints of the
    same shingles that differ in `distance` bits at most link most copies that were hardly
    changed. Similar sets always share a key of their prefixes: each node meets the least node of
    each of its keys, and then, over keys whose nodes are still in several components, those
    of different ones: for some rounds as many as may connect them, at last all that are left. So a
    group of near copies costs some pairs per node and not all its pairs; no key is capped, and no
    similar pair is left unlinked.
    """
    rows = cut(keyed(docs, shingle, similarity))
    nodes = rows.filter("bits is not null").select("node", "n", "fp", "bits", "text_key", "keys").dropDuplicates(["node"])
    nodes = cut(nodes)
    found = cut(similar(_fingerprint_pairs(nodes.select("node", "fp"), distance), nodes, docs, shingle, similarity))

    keys = nodes.select("node", "n", F.explode("keys").alias("_k")).select("node", "n", "_k.pos", "_k.key")
    lead = keys.groupBy("key").agg(F.min(F.struct("node", "n", "pos")).alias("lead"), F.max("node").alias("last"))
    lead = lead.filter("lead.node <> last").select(
        "key", F.col("lead.node").alias("pnode"), F.col("lead.n").alias("pn"), F.col("lead.pos").alias("ppos")
    )
    shared = cut(keys.join(lead, "key"))
    met = shared.filter("pnode <> node").filter(_may_reach("", "p", similarity))
    met = met.select(F.col("pnode").alias("a"), F.col("node").alias("b")).distinct()
    tied = cut(components(found))
    met = cut(_untied(met, tied))
    found = cut(found.unionByName(similar(met, nodes, docs, shingle, similarity)))

    tied = cut(components(found))
    of = shared.select("key", "node", "n", "pos")
    for spanning in (*range(SPANNING_ROUNDS), None):
        more = _bucket_pairs(of, nodes, tied, similarity, block, spanning)
        more = cut(more.join(met, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            met = cut(met.unionByName(more))
            linked = cut(similar(more, nodes, docs, shingle, similarity))
            if not linked.isEmpty():
                found = cut(found.unionByName(linked))
                tied = cut(components(found))
    d = rows.select("doc_id", "text_key", "node").join(tied, "node", "left")
    return d.select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))


def _untied(pairs: DataFrame, tied: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    of = lambda c: tied.select(F.col("node").alias(c), F.col("root").alias(f"{c}root"))
    d = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return d.filter(F.coalesce("aroot", "a") != F.coalesce("broot", "b")).select("a", "b")
