"""How the words of sources differ within a language (operator 11)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightings.session import cut, ship

MIN_DOCUMENTS = 30
PRIOR = 5
SCALE = 1_000_000_000
MOST_TERMS = 50
#: Distinct terms of all groups that a task holds before it hands them over.
_HELD_TERMS = 600_000
#: Shares (terms times sources) that a task holds at once, and sources whose pairs it adds up.
_HELD_SHARES = 1 << 20
_TILE = 512

#: One pass over the bytes: capitals to small letters, all else in ASCII but letters to a space.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms(text: bytes) -> Counter:
    """The terms of a text and how often it has each."""
    return Counter(text.translate(_TABLE).split())


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents; a row without term per group."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def give() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, of) in held.items():
                found = list(n)
                names = pa.array([None, *found], pa.binary()).cast(pa.string())
                m = len(names)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * m), pa.array([source] * m), names,
                        pa.array([0, *n.values()], pa.int64()),
                        pa.array([0, *(of[t] for t in found)], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                own = terms(text.as_py())
                n, of = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(own)
                of.update(own.keys())
                size += len(n)
                if size >= _HELD_TERMS:
                    yield from give()
                    held, size = {}, 0
        yield from give()

    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    parts = docs.select(*names).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, prior: int) -> F.Column:
    """1 + floor(SCALE (n + prior) / (total + prior kept)), by whole numbers of 38 digits."""
    wide = "cast({} as decimal(20,0))".format
    over = f"({wide(total)} + {wide('kept')} * {prior})"
    return F.expr(f"1 + ({wide(n)} + {prior}) * {SCALE} div {over}")


def _shares(n: np.ndarray, over: int, prior: int) -> np.ndarray:
    """The same for an array of one group; beyond 64 bits in Python's own numbers."""
    if over < (1 << 62) // SCALE:
        return 1 + (n + prior) * SCALE // over
    return np.array([1 + (x + prior) * SCALE // over for x in n.tolist()], np.int64)


def _pair_sums(kept: DataFrame, groups: DataFrame, prior: int) -> DataFrame:
    """lang, a, b (a before b), value: the sum over a language's kept terms of the differences.

    A language's terms are dealt into blocks of bounded size, its sources into tiles; a task has
    the terms of one block and adds up the pairs of one tile with all later sources.
    """
    langs = groups.groupBy("lang").agg(F.sum("held").alias("held"), F.count(F.lit(1)).alias("sources"))
    langs = langs.select(
        "lang",
        F.greatest(F.lit(1), F.ceil(F.col("held") / _HELD_SHARES * 4)).cast("int").alias("blocks"),
        F.ceil(F.col("sources") / _TILE).cast("int").alias("tiles"),
    )

    def every(c: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(c) - 1))

    left = kept.join(langs, "lang").select(
        "lang", "of", F.pmod(F.hash("term"), "blocks").alias("block"), every("tiles").alias("tile")
    )
    right = groups.join(langs, "lang").withColumn("block", every("blocks")).withColumn("tile", every("tiles"))
    right = right.select("lang", "source", "total", "kept", "block", "tile")

    def add(terms: pa.Table, sources: pa.Table) -> pa.Table:
        names = sources.column("source").to_pylist()
        order = sorted(range(len(names)), key=lambda k: names[k].encode())
        names = [names[k] for k in order]
        place = {x: k for k, x in enumerate(names)}
        vocabulary = sources.column("kept")[0].as_py()
        over = [int(sources.column("total")[k].as_py()) + prior * vocabulary for k in order]
        tile = sources.column("tile")[0].as_py()
        tiled = range(tile * _TILE, min(len(names), (tile + 1) * _TILE))
        sums = np.zeros((len(tiled), len(names)), np.int64)
        many = max(1, _HELD_SHARES // len(names))
        of = terms.column("of").combine_chunks() if terms.num_rows else None
        for k in range(0, terms.num_rows, many):
            part = of.slice(k, many)
            sizes = pa.compute.list_value_length(part).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(part)), sizes)
            flat = part.flatten()
            column = np.fromiter((place[x] for x in flat.field(0).to_pylist()), np.int64, len(flat))
            n = np.zeros((len(names), len(part)), np.int64)
            n[column, row] = flat.field(1).to_numpy(zero_copy_only=False)
            p = np.stack([_shares(own, total, prior) for own, total in zip(n, over)])
            for i, a in enumerate(tiled):
                sums[i, a + 1 :] += np.abs(p[a + 1 :] - p[a]).sum(axis=1)
        a = np.concatenate([np.full(len(names) - k - 1, k) for k in tiled])
        b = np.concatenate([np.arange(k + 1, len(names)) for k in tiled])
        value = np.concatenate([sums[i, k + 1 :] for i, k in enumerate(tiled)])
        known = pa.array(names, pa.string())
        lang = pa.array([sources.column("lang")[0].as_py()] * len(a), pa.string())
        return pa.table([lang, known.take(pa.array(a)), known.take(pa.array(b)), pa.array(value)], ["lang", "a", "b", "value"])

    keys = ["lang", "block", "tile"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    parts = parts.applyInArrow(add, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, prior: int = PRIOR, most_terms: int = MOST_TERMS
) -> DataFrame:
    """lang, source, part, item, value, rank: sources against each other, and what marks a source.

    Nulls in text, lang and source are ''. Terms are runs of letters and of what isn't ASCII, A-Z
    in lower case; a language keeps those that `min_documents` of its documents have. A group
    (lang, source) and a language give each kept term a smoothed share per `SCALE`, in exact
    arithmetic. Part `pair` has the sum of differences to each other source of the language,
    part `term` the `most_terms` terms whose share exceeds the language's most. Ranks go by value
    descending, then by the item's bytes. Repeated rows count as often as they occur, a group
    without terms is a group, other columns are left aside; an empty table gives no rows.
    """
    counts = cut(term_counts(docs))
    # One row per term of a language, with the sources that have it: no more than there are.
    of = F.collect_list(F.struct("source", "n")).alias("of")
    kept = counts.filter("term is not null").groupBy("lang", "term")
    kept = kept.agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole"), of)
    kept = cut(kept.filter(F.col("docs") >= min_documents).select("lang", "term", "whole", "of"))
    own = kept.select("lang", "term", "whole", F.explode("of").alias("_of")).select("lang", "term", "whole", "_of.*")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("whole").alias("lang_total"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    groups = counts.filter("term is null").select("lang", "source")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    numbers = ["total", "held", "kept", "lang_total"]
    groups = cut(groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers]))

    p, q = _share("n", "total", prior), _share("whole", "lang_total", prior)
    shares = own.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    more = (F.col("p") - F.col("q")).alias("value")
    marks = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), more)
    marks = marks.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most_terms)

    sums = _pair_sums(kept, groups, prior)
    there = sums.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    back = sums.select("lang", F.col("b").alias("source"), F.lit("pair").alias("part"), F.col("a").alias("item"), "value")
    pairs = there.unionByName(back).withColumn("rank", F.row_number().over(by))
    return pairs.unionByName(marks)
