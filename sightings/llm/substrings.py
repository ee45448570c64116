"""Passages that repeat across documents, by a count-min prefilter (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightings.llm import sketch
from sightings.llm.wording import Lexicon, chunks, mixed, window_hashes
from sightings.session import cut, ship

WIDTH = 13
#: Cells of a row of the sketch, as a power of two: 32 MB of bits a row in each Python worker.
MOST_BITS = 28
#: Bytes of a word with its space, to size the sketch by.
_WORD_BYTES = 6
_NO_ID = (1 << 63) - 1

_SEED = np.uint64(0x5851F42D4C957F2D)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, at (place among the ids; none is last), text_key, again, own, text.

    Two digests name a text; `own` stands for the text at its place.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    at = F.coalesce("doc_id", F.lit(_NO_ID).cast("long"))
    d = d.select("doc_id", at.alias("at"), F.xxhash64("text").alias("text_key"), F.xxhash64(F.lit("again"), "text").alias("again"), "text")
    return d.withColumn("own", F.xxhash64("text_key", "again", "at"))


class _Those:
    """In a task: which rows a bitmap of their digests lets pass. It holds all that it was made of."""

    def __init__(self, rows: DataFrame, column: str, count: int) -> None:
        plan = sketch.Plan.of(count, 1, MOST_BITS, rows=2, room=8.0)

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for b in batches:
                yield b.column(0).to_numpy().view(np.uint64)

        self.lookup = sketch.Lookup(sketch.build(rows.select(column), listed, plan), plan)

    def of(self, digests: pa.Array) -> np.ndarray:
        return self.lookup.may_reach(digests.to_numpy().view(np.uint64))

    def only(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that pass by their first column."""
        for b in batches:
            yield b.filter(pa.array(self.of(b.column(0))))


def _windows(words: list[list[bytes]], lexicon: Lexicon, width: int):
    """(document, start, first hash, second hash) of each window of some documents, as arrays."""
    sizes = np.array([len(w) for w in words], np.int64)
    h = lexicon.hashes([x for w in words for x in w])
    lexicon.forget()
    per = np.maximum(sizes - width + 1, 0)
    doc = np.repeat(np.arange(len(words)), per)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    at = np.repeat(np.cumsum(sizes) - sizes, per) + start
    one = window_hashes(h, width)
    other = window_hashes(mixed(h ^ _SEED), width)
    if not len(at):
        return doc, start, one[:0], other[:0]
    return doc, start, mixed(one[at]), mixed(other[at]) >> np.uint64(33)


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive starts of one document as (place of the first, length)."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.nonzero(new)[0]
    return first, np.diff(np.append(first, len(doc)))


def _met(rows, words, lexicon: Lexicon, lookup: sketch.Lookup, width: int) -> pa.RecordBatch:
    """What a chunk of documents hands over for the exact grouping.

    Within the chunk, windows of later documents are decided (rows with a length, as runs); of
    those that the sketch lets pass, the windows of a window's first document in the chunk go on.
    """
    doc, start, one, other = _windows(words, lexicon, width)
    ids = np.array([r[0] for r in rows], np.int64)
    keys = np.array([r[1] for r in rows], np.int64)
    order = np.argsort(one, kind="stable")
    same = one[order[1:]] == one[order[:-1]]
    if (same & (other[order[1:]] != other[order[:-1]])).any():
        order = np.lexsort((other, one))
    first = np.ones(len(order), bool)
    first[1:] = (one[order[1:]] != one[order[:-1]]) | (other[order[1:]] != other[order[:-1]])
    group = np.cumsum(first) - 1
    at = ids[doc[order]]
    least = np.minimum.reduceat(at, np.nonzero(first)[0]) if len(at) else at
    later = np.zeros(len(doc), bool)
    later[order] = at > least[group] if len(at) else False
    open_ = ~later
    open_[open_] = lookup.may_reach(one[open_])
    d, s = doc[later], start[later]
    head, length = _runs(d, s)
    runs = d[head]
    rest = doc[open_]
    return pa.RecordBatch.from_pydict(
        {
            # Decided rows go wherever their own key sends them.
            "one": pa.array(np.concatenate([one[open_].view(np.int64), keys[runs] + s[head]])),
            "other": pa.array(np.concatenate([other[open_].astype(np.int32), np.full(len(head), -1, np.int32)])),
            "at": pa.array(np.concatenate([ids[rest], ids[runs]])),
            "text_key": pa.array(np.concatenate([keys[rest], keys[runs]])),
            "start": pa.array(np.concatenate([start[open_], s[head]]).astype(np.int32)),
            "length": pa.array(np.concatenate([np.zeros(len(rest), np.int32), length.astype(np.int32)])),
        }
    )


def _firsts(rows: DataFrame) -> _Those:
    """The first row of each distinct text, and rows that repeat it with the same id."""
    first = cut(rows.groupBy("text_key", "again").agg(F.min("at").alias("at")))
    return _Those(first.select(F.xxhash64("text_key", "again", "at").alias("own")), "own", first.count())


def repeated_starts(
    rows: DataFrame, firsts: _Those, width: int = WIDTH, most_bits: int = MOST_BITS
) -> DataFrame:
    """at, text_key, runs per document with repeats: starts of windows that an earlier document has.

    Of equal texts the first alone is looked at, as the others lose all their windows to it. A run
    (start, length) stands for consecutive starts. A first pass counts all windows in a count-min
    sketch per task and merges these; a second one groups exactly, by 95 bits of hash, the windows
    that the sketch estimates to occur twice or more, which loses none that does. A window reaches
    the grouping once per chunk of documents, so the rows of one that is everywhere grow with the
    tasks and not with its copies.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = sketch.Plan.of(size / _WORD_BYTES, 2, most_bits)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        lexicon = Lexicon()
        for _, words in chunks(firsts.only(batches), bytes.split, 1):
            yield _windows(words, lexicon, width)[2]

    lookup = sketch.Lookup(sketch.build(rows.select("own", "text"), hashed, plan), plan)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for own, words in chunks(firsts.only(batches), bytes.split, 3):
            yield _met([r[1:] for r in own], words, lexicon, lookup, width)

    met = rows.select("own", "at", "text_key", "text").mapInArrow(
        meet, "one long, other int, at long, text_key long, start int, length int"
    )
    # The first of a window's rows in order of the documents; no frame has to be held for it.
    order = Window.partitionBy("one", "other").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    told = met.withColumn("least", F.first("at").over(order)).filter("length > 0 or at > least")
    run = F.struct("start", F.greatest("length", F.lit(1)).alias("length"))
    return told.groupBy("at", "text_key").agg(F.collect_list(run).alias("runs"))


def without_repeats(docs: DataFrame, width: int = WIDTH, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept per row: documents without passages that earlier ones have.

    Words are what stands between ASCII white space. Each word goes that a window of `width`
    words covers which also starts in a document of a smaller doc_id; `kept` has the others,
    joined by a space. All windows are judged on the texts as given. Rows of equal doc_id don't
    remove from each other, rows without an id remove from none and lose what any row with an id
    has. A null text has no words, an empty table gives no rows, other columns are left aside.

    Texts with nothing to remove, and copies of an earlier text, which lose all their windows, are
    told by bitmaps where they are read; only the others are shuffled to meet their runs.
    """
    ship(docs.sparkSession)
    rows = _rows(docs)
    firsts = _firsts(rows)
    starts = cut(repeated_starts(rows, firsts, width, most_bits).withColumn("hit", F.xxhash64("at", "text_key")))
    hits = _Those(starts, "hit", starts.count())
    result = ["doc_id", "n_words", "n_removed", "kept"]

    def table(ids: pa.Array, words: list[list[bytes]], gone: list[np.ndarray | bool]) -> pa.RecordBatch:
        """`gone` says of each text which words go, or whether all or none do."""
        kept, removed = [], []
        for w, g in zip(words, gone):
            if isinstance(g, np.ndarray):
                removed.append(int(g.sum()))
                w = [w[k] for k in np.nonzero(~g)[0].tolist()]
            else:
                removed.append(len(w) if g else 0)
                w = [] if g else w
            kept.append(b" ".join(w))
        sizes = pa.array([len(w) for w in words], pa.int64())
        return pa.RecordBatch.from_arrays([ids, sizes, pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], result)

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = firsts.of(b.column(0))
            here = ~(first & hits.of(b.column(1)))
            copies = ~first[here]
            b = b.filter(pa.array(here))
            words = [t.as_py().split() for t in b.column(3).cast(pa.binary())]
            yield table(b.column(2), words, [bool(c) and len(w) >= width for w, c in zip(words, copies)])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(firsts.of(b.column(0)) & hits.of(b.column(1))))

    def cleared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [t.as_py().split() for t in b.column(1).cast(pa.binary())]
            gone = []
            for w, runs in zip(words, b.column(2)):
                if not runs.is_valid:
                    gone.append(False)
                    continue
                start = runs.values.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                end = start + runs.values.field(1).to_numpy(zero_copy_only=False) + width - 1
                edge = np.zeros(len(w) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, end, -1)
                gone.append(np.cumsum(edge)[:-1] > 0)
            yield table(b.column(0), words, gone)

    schema = "doc_id long, n_words long, n_removed long, kept string"
    told = rows.select("own", F.xxhash64("at", "text_key").alias("hit"), "doc_id", "at", "text_key", "text")
    done = told.select("own", "hit", "doc_id", "text").mapInArrow(at_once, schema)
    rest = told.mapInArrow(later, told.schema).join(starts.select("at", "text_key", "runs"), ["at", "text_key"], "left")
    return done.unionByName(rest.select("doc_id", "text", "runs").mapInArrow(cleared, schema))
