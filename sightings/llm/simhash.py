"""SimHash near-duplicates by deletion-variant signatures (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightings.llm.components import components
from sightings.session import cut, ship

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Fingerprints of one bucket that are linked in one task; a larger bucket is dealt out in blocks.
BLOCK = 2048

_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text; see `fingerprints`."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII alone, as bytes
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
    width = min(shingle, n)
    lo, hi = starts[: n - width + 1].tolist(), (starts[width:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, len(lo), _HASHES_AT_ONCE):
        h = np.array(
            [digest(joined[a:z], seed) for a, z in zip(lo[k : k + _HASHES_AT_ONCE], hi[k : k + _HASHES_AT_ONCE])],
            "<u8",
        )
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    out = np.packbits(2 * ones > len(lo), bitorder="little").view("<u8")
    return int(out[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_key, fp (long, the bits of the fingerprint) per row.

    Words are what stands between ASCII white space, A-Z lower-cased; shingles are `shingle`
    words joined by a space, repeats included; a text of fewer words is one shingle. A bit is
    set if it is in over half the shingles' XXH64. Null and empty texts have fingerprint zero.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_py(), shingle, seed) for t in b.column(2)]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp], ["doc_id", "text_key", "fp"])

    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def signature_plan(rows: int, distance: int = DISTANCE) -> list[list[int]]:
    """Bit places of the keys, one list per choice of segments.

    The bits are cut into the fewest segments of which one differs in at most one bit: three for
    a distance of 4. A key of so few bits collides by chance where there are many fingerprints,
    so with their number the key takes 2, 3, ... of as many segments as make sure that these
    together differ in at most one bit. Every plan finds every pair; only the chance meetings
    differ, of which a bucket of a plan has eight or fewer on average.
    """
    taken = 1
    while True:
        m = distance // 2 + 1 if taken == 1 else taken + distance - 1
        cuts = [64 * k // m for k in range(m + 1)]
        choices = [
            [bit for s in chosen for bit in range(cuts[s], cuts[s + 1])]
            for chosen in combinations(range(m), taken)
        ]
        if rows >> (min(map(len, choices)) - 1) <= 8 or taken == 4:
            return choices
        taken += 1


def signatures(nodes: DataFrame, plan: list[list[int]]) -> DataFrame:
    """fp, key: for each choice of segments, its bits with each one left out in turn.

    Two of them that differ in at most one bit share the variant that leaves this bit out.
    """
    variants = []
    for k, bits in enumerate(plan):
        whole = sum(1 << b for b in bits)
        for bit in bits:
            mask = whole & ~(1 << bit)
            mask -= (mask >> 63) << 64  # as a signed number
            name = F.lit(64 * k + bit)
            variants.append(F.xxhash64(name, F.col("fp").bitwiseAND(F.lit(mask).cast("long"))))
    return nodes.select("fp", F.explode(F.array(*variants)).alias("key"))


_BITS = np.array([bin(k).count("1") for k in range(1 << 16)], np.uint8)


def _apart(x: np.ndarray) -> np.ndarray:
    """Set bits of unsigned 64-bit numbers."""
    return _BITS[x.view(np.uint16).reshape(*x.shape, 4)].sum(axis=-1, dtype=np.int64)


def spanning_links(left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links that connect all that links of `left` to `right` connect.

    All links within distance are found, but a link is left out when its ends are connected by
    links already given. Fingerprints within `distance` of a pivot join it at once, so a bucket
    of near copies costs a few passes, not all pairs. `left` and `right` may be the same.
    """
    same = left is right
    nodes = left if same else np.concatenate([left, right])
    root = np.arange(len(nodes))
    a_out, b_out = [], []
    rows = np.arange(len(left))
    others = np.arange(len(nodes)) if same else np.arange(len(left), len(nodes))
    for k in rows:
        # One pass per fingerprint that isn't yet connected to all: those of another root.
        open_ = others[root[others] != root[k]]
        if not len(open_):
            continue
        near = open_[_apart(nodes[open_] ^ nodes[k]) <= distance]
        if not len(near):
            continue
        roots, first = np.unique(root[near], return_index=True)
        a_out.append(np.full(len(first), nodes[k]))
        b_out.append(nodes[near[first]])
        root[np.isin(root, roots)] = root[k]
    if not a_out:
        return left[:0], left[:0]
    return np.concatenate(a_out), np.concatenate(b_out)


def _links_of(d: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Links within whole buckets; rows sorted by bucket. Side 0 meets side 1, side 2 itself."""
    fp, side = d["fp"].to_numpy().view(np.uint64), d["side"].to_numpy()
    names = d[["key", "pair"]].to_numpy()
    new = np.ones(len(d), bool)
    new[1:] = (names[1:] != names[:-1]).any(axis=1)
    starts = np.nonzero(new)[0]
    sizes = np.diff(np.append(starts, len(d)))
    group = np.repeat(np.arange(len(sizes)), sizes)
    a, b = [fp[:0]], [fp[:0]]
    # Buckets of a few: all their pairs at once, by the distance of their places.
    few = (sizes <= 8) & (side[starts] == 2)
    small = few[group]
    for step in range(1, 8):
        i = np.nonzero(small[:-step] & (group[:-step] == group[step:]))[0] if len(d) > step else starts[:0]
        i = i[_apart(fp[i] ^ fp[i + step]) <= distance]
        a.append(fp[i])
        b.append(fp[i + step])
    for g in np.nonzero(~few)[0]:
        own = slice(starts[g], starts[g] + sizes[g])
        if side[own.start] == 2:
            x, y = spanning_links(fp[own], fp[own], distance)
        else:
            x, y = spanning_links(fp[own][side[own] == 0], fp[own][side[own] == 1], distance)
        a.append(x)
        b.append(y)
    out = pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})
    return out.drop_duplicates().assign(large=0)


def _bucket_links(
    batches: Iterator[pd.DataFrame], distance: int, most: int
) -> Iterator[pd.DataFrame]:
    """a, b, large: links within buckets, from rows sorted by bucket.

    A bucket of more than `most` rows is only counted: its row has the key as a, its size as
    large. So a task holds some thousand rows, whatever the buckets.
    """
    held = pd.DataFrame({"key": [], "pair": [], "fp": [], "side": []}).astype(np.int64)
    counted, n = None, 0
    for d in batches:
        if counted is not None:
            more = (d["key"] == counted[0]) & (d["pair"] == counted[1])
            n += int(more.sum())
            if more.all():
                continue
            yield pd.DataFrame({"a": [counted[0]], "b": [counted[1]], "large": [n]})
            counted, d = None, d[~more]
        held = pd.concat([held, d], ignore_index=True)
        last = (held["key"] == held["key"].iloc[-1]) & (held["pair"] == held["pair"].iloc[-1])
        if last.sum() > most:
            counted, n = (held["key"].iloc[-1], held["pair"].iloc[-1]), int(last.sum())
            if not last.all():
                yield from _in_parts(held[~last], distance, most)
            held = held.iloc[:0]
        elif len(held) >= 50_000 and not last.all():
            yield from _in_parts(held[~last], distance, most)
            held = held[last]
    if counted is not None:
        yield pd.DataFrame({"a": [counted[0]], "b": [counted[1]], "large": [n]})
    elif len(held):
        yield from _in_parts(held, distance, most)


def _in_parts(d: pd.DataFrame, distance: int, most: int) -> Iterator[pd.DataFrame]:
    """Whole buckets, those that are too large counted."""
    n = d.groupby(["key", "pair"])["fp"].transform("size")
    for (key, pair), k in d[n > most].groupby(["key", "pair"]).size().items():
        yield pd.DataFrame({"a": [key], "b": [pair], "large": [int(k)]})
    rest = d[n <= most]
    if len(rest):
        yield _links_of(rest, distance)


def links(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """a, b: verified links of distinct fingerprints (column fp) that connect all that is near.

    Fingerprints that share a signature meet by a shuffle on it. A bucket of more than `block`
    is found on the way and cut into blocks; each pair of blocks is then a task's piece of work,
    so that neither memory nor time of a task grows with the bucket.
    """
    signed = signatures(nodes, signature_plan(nodes.count(), distance))

    def meet(rows: DataFrame, most: int) -> DataFrame:
        dealt = rows.repartition("key", "pair").sortWithinPartitions("key", "pair", "side", "fp")
        return dealt.mapInPandas(
            lambda x: _bucket_links(x, distance, most), "a long, b long, large long"
        )

    alone = signed.select("key", F.lit(0).cast("long").alias("pair"), "fp", F.lit(2).cast("long").alias("side"))
    first = cut(meet(alone, block))
    found = first.filter("large = 0").select("a", "b")
    large = first.filter("large > 0").select(F.col("a").alias("key"), "large")
    if large.isEmpty():
        return found.distinct()
    blocks = F.ceil(F.col("large") / block * 2).cast("long")
    met = signed.join(large.withColumn("blocks", blocks), "key")
    met = met.withColumn("own", F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    met = met.select("key", "fp", "blocks", "own", other)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    pairs = met.select("key", (low * F.col("blocks") + high).alias("pair"), "fp", side.cast("long").alias("side"))
    # Blocks are of half the size on average; one is never counted only.
    more = meet(pairs, 1 << 62).select("a", "b")
    return found.unionByName(more).distinct()


def near_groups(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED
) -> DataFrame:
    """doc_id, text_key, fp, root, component_id per row: SimHash groups of documents.

    Two fingerprints link when they differ in at most `distance` bits; component_id is the
    smallest doc_id reachable over links, the own one included (null where no row of the
    component has an id), root the least fingerprint of the component. Rows of equal fingerprint are one node, so copies cost nothing; null
    and empty texts share fingerprint zero. Other columns are left aside; an empty table gives
    no rows. Nothing is capped: every bucket is searched whole.
    """
    rows = cut(fingerprints(docs, shingle, seed))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tied = components(cut(links(nodes.select("fp"), distance)))
    of = F.coalesce("root", "fp")
    rooted = nodes.join(tied.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", of)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = cut(rooted.select("fp", "root").join(named, "root"))
    return rows.join(known, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def first_of_groups(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay: of each group the one of the smallest doc_id, columns unchanged.

    In a component without ids, the row of the smallest text digest stays. Rows that repeat id
    and text are one document and give one row.
    """
    return keep_first(docs, near_groups(docs, **options))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The same for groups given as rows of doc_id, text_key and root, one per row of `docs`."""
    # One row per component: the smallest id, ids before nulls, then the smallest digest.
    lead = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))).alias("_lead")
    kept = groups.groupBy("root").agg(lead)
    kept = kept.select(F.col("_lead.doc_id").alias("_id"), F.col("_lead.text_key").alias("_key"))
    times = groups.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("_n"))
    several = times.filter("_n > 1").select(F.col("doc_id").alias("_rid"), F.col("text_key").alias("_rkey"))
    kept = cut(
        kept.join(several, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_key") == F.col("_rkey")), "left")
        .select("_id", "_key", F.col("_rkey").isNotNull().alias("_repeats"))
        .distinct()
    )
    d = docs.select(
        F.struct(*docs.columns).alias("_doc"),
        F.col("doc_id").cast("long").alias("_did"),
        F.xxhash64(F.col("text").cast("string")).alias("_dkey"),
    )
    out = d.join(kept, F.col("_did").eqNullSafe(F.col("_id")) & (F.col("_dkey") == F.col("_key")))
    if kept.filter("_repeats").isEmpty():
        return out.select("_doc.*")
    once = out.filter("_repeats").dropDuplicates(["_did", "_dkey"])
    return out.filter("not _repeats").unionByName(once).select("_doc.*")
