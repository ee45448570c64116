"""Collocations by top-order marginalisation (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightings.llm import sketch
from sightings.llm.wording import Lexicon, chunks, mixed
from sightings.session import cut, ship

ORDER = 4
MIN_COUNT = 30
MOST = 2000
#: Cells of a row of the sketch, as a power of two: 16 MB of bits a row in each Python worker.
MOST_BITS = 27
#: Parts that a language's phrases are ranked in before the best of all parts meet.
SHARES = 64
_WORD_BYTES = 6

#: What ends a piece becomes a line end, a tab a space.
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)]


def pieces(text: bytes) -> list[bytes]:
    """Words of a text in lower case, with a line end wherever a piece ends."""
    return [w for w in text.lower().translate(_ENDS).replace(b"\n", b" \n ").split(b" ") if w]


class _Windows:
    """The lead columns of a chunk: at each word, it and the words after it within the piece.

    `columns[k]` has the local number of the k-th word after, and 0 beyond the piece's end;
    `prefix(k)` hashes the first k + 1 words together with the language.
    """

    def __init__(self, rows: list[tuple], words: list[list[bytes]], lexicon: Lexicon, order: int) -> None:
        flat = [x for w in words for x in (*w, b"\n")]
        number: dict[bytes, int] = {b"\n": 0}
        local = np.fromiter((number.setdefault(w, len(number)) for w in flat), np.int64, len(flat))
        self.words = list(number)
        hashes = lexicon.hashes(self.words)
        lexicon.forget()
        langs: dict[str, int] = {}
        of = np.fromiter((langs.setdefault(r[0], len(langs)) for r in rows), np.int64, len(rows))
        self.langs = list(langs)
        lang = np.repeat(of, [len(w) + 1 for w in words])
        at = np.nonzero(local)[0]
        self.lang = lang[at]
        seed = mixed(lexicon.hashes([x.encode() for x in self.langs]))
        padded = np.concatenate([local, np.zeros(order, np.int64)])
        self.columns, self._prefixes = [], []
        inside = np.ones(len(at), bool)
        h = seed[self.lang] if len(at) else np.zeros(0, np.uint64)
        for k in range(order):
            word = padded[at + k]
            inside = inside & (word > 0)
            self.columns.append(np.where(inside, word, 0))
            h = mixed(h + hashes[word] * _MULTIPLIERS[k % 4])
            self._prefixes.append(h)

    def prefix(self, k: int) -> np.ndarray:
        """Hashes of windows that have k + 1 words, and which windows these are."""
        return self._prefixes[k][self.columns[k] > 0]

    def ended(self, lookup: sketch.Lookup) -> list[np.ndarray]:
        """The columns, each window ended before the first prefix that is too rare."""
        out, open_ = [], np.ones(len(self.lang), bool)
        for k, column in enumerate(self.columns):
            open_ = open_ & (column > 0)
            open_[open_] = lookup.may_reach(self._prefixes[k][open_])
            out.append(np.where(open_, column, 0))
        return out

    def counted(self, columns: list[np.ndarray]) -> pa.RecordBatch:
        """lang, w1, w2, ..., n: the distinct windows and how often each occurs."""
        group = self.lang
        for c in columns:
            _, group = np.unique((group << 32) | c, return_inverse=True)
        _, first, n = np.unique(group, return_index=True, return_counts=True)
        names = pa.array(self.langs, pa.string()).take(pa.array(self.lang[first]))
        known = pa.array([None, *self.words[1:]], pa.binary()).cast(pa.string())
        found = [known.take(pa.array(c[first])) for c in columns]
        labels = ["lang", *[f"w{k + 1}" for k in range(len(columns))], "n"]
        return pa.RecordBatch.from_arrays([names, *found, pa.array(n, pa.int64())], labels)


def phrase_counts(
    docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, most_bits: int = MOST_BITS
) -> DataFrame:
    """lang, words (array, empty for the language's total), f: phrases of at least `min_count`.

    Only the longest windows are counted: at each word, it and the `order` - 1 words after it,
    padded beyond the end of its piece. ROLLUP over their columns sums the windows by
    ever shorter prefixes, which are the phrases of each length, and the total of all words.
    Phrases are only as frequent as their prefixes, so a window is padded from where a count-min
    sketch of all prefixes proves that fewer than `min_count` are left; the counts of frequent
    phrases don't change by it.
    """
    spark = docs.sparkSession
    ship(spark)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    d = docs.select(lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Cells may hold several rare items before they seem frequent.
    plan = sketch.Plan.of(order * size / _WORD_BYTES, min_count, most_bits, rows=1, room=0.25)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        lexicon = Lexicon()
        for rows, words in chunks(batches, pieces, 1):
            own = _Windows(rows, words, lexicon, order)
            for k in range(order):
                yield own.prefix(k)

    lookup = sketch.Lookup(sketch.build(d, hashed, plan), plan)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for rows, words in chunks(batches, pieces, 1):
            own = _Windows(rows, words, lexicon, order)
            yield own.counted(own.ended(lookup))

    lead = [f"w{k + 1}" for k in range(order)]
    schema = f"lang string, {', '.join(f'{c} string' for c in lead)}, n long"
    counted = d.mapInArrow(windows, schema).groupBy("lang", *lead).agg(F.sum("n").alias("n"))
    summed = counted.rollup("lang", *lead).agg(F.sum("n").alias("f"), F.grouping_id().alias("id"))
    # A level of k words is a phrase where its last word is no padding.
    level = F.lit(order) - F.bit_count("id").cast("int")
    words = F.slice(F.array(*lead), 1, level)
    whole = summed.filter(f"id < {(1 << (order + 1)) - 1}").select("lang", level.alias("k"), words.alias("words"), "f")
    frequent = (F.col("f") >= min_count) & F.forall("words", lambda w: w.isNotNull())
    return whole.filter((F.col("k") == 0) | frequent).select("lang", "words", "f")


def collocations(
    docs: DataFrame,
    order: int = ORDER,
    min_count: int = MIN_COUNT,
    most: int = MOST,
    contained: int = 80,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases that stick together most.

    Pieces end at any of . , ; : ! ? and the line ends from U+000A to U+000D; words are what
    stands between spaces and tabs, A-Z in lower case. A phrase of two to `order` words that
    occurs a >= `min_count` times is cut in two wherever its score, floor(2000000 a / (l + r)),
    is least, the earliest on ties; l and r count its parts. Phrases inside a longer one that has
    `contained` per cent of their occurrences are left out. A null language is `und`, a null text
    has no words, repeated rows count as often as they occur, other columns are left aside; an
    empty table gives no rows. Phrases of equal score go by a, then by their bytes.
    """
    f = cut(phrase_counts(docs, order, min_count, most_bits))
    total = f.filter("size(words) = 0").select("lang", F.col("f").alias("n"))
    known = f.filter("size(words) > 0")
    found = known.filter("size(words) > 1").withColumnRenamed("f", "a")
    parts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    parts = parts.select(
        "lang", "words", "a", "k",
        F.slice("words", F.lit(1), F.col("k")).alias("left"),
        F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("right"),
    )
    left = known.select("lang", F.col("words").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("words").alias("right"), F.col("f").alias("r"))
    # Each phrase of `found` has its parts in `known`: they are no rarer.
    scored = parts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    ratio = F.expr("cast((cast(a as decimal(19,0)) * 2000000) div (cast(l as decimal(19,0)) + r) as long)")
    least = F.min(F.struct(ratio.alias("score"), "k", "l", "r")).alias("cut")
    scored = scored.groupBy("lang", "words", "a").agg(least).select("lang", "words", "a", "cut.*")
    inner = F.expr(
        "flatten(transform(sequence(2, size(words) - 1), k -> "
        "transform(sequence(1, size(words) - k + 1), i -> slice(words, i, k))))"
    )
    longer = found.filter("size(words) > 2").select("lang", F.explode(inner).alias("words"), "a")
    longer = longer.groupBy("lang", "words").agg(F.max("a").alias("most"))
    part_of = (F.col("most").cast("decimal(38,0)") * 100) >= (F.col("a").cast("decimal(38,0)") * contained)
    left_out = found.join(longer, ["lang", "words"]).filter(part_of).select("lang", "words")
    own = scored.join(left_out, ["lang", "words"], "left_anti")
    own = own.select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "score")
    order_by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each share first, so that no task ranks all phrases of a language.
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).alias("share")
    best = own.select("*", share)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order_by)))
    best = best.filter(F.col("rank") <= most)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order_by)))
    best = best.filter(F.col("rank") <= most).join(total, "lang")
    numbers = [F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *numbers)
