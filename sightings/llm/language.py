"""Language identification by prediction by partial matching (operator 3).

Each language has a tree of byte contexts up to three bytes long, with counts of what follows.
The code length of a byte is that of the longest known context; a byte that never followed it
costs an escape (method C: as many escapes as different followers) and is looked up in the
context one byte shorter, down to all bytes alike. Statistics are frozen before scoring, so the
code length of a byte depends on it and the three bytes before it alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings.session import cut, ship

ORDER = 3
#: Bytes of distinct texts, about, that the trees are learnt from: per language, and of all together.
#: Nothing else bounds the model; all contexts of the sample are in it.
SAMPLE_BYTES = 2_000_000
TOTAL_BYTES = 24_000_000
#: Languages whose trees share a table.
GROUP = 8
UNKNOWN = "und"

_CHUNK = 1 << 20


def sampled(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> DataFrame:
    """lang, text of about `sample_bytes` per language: the distinct texts of the smallest draws.

    The draw is a digest of the text, the bound a share of the bytes of each language's distinct
    texts; with many languages each has an equal share of `total_bytes`. A text that is longer
    than the bound is drawn whole or not at all. Copies of a text count once.
    """
    d = docs.filter("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    draw = F.xxhash64(F.lit("ppm"), "text")
    distinct = d.select("lang", draw.alias("draw"), F.octet_length("text").alias("bytes")).distinct()
    total = cut(distinct.groupBy("lang").agg(F.sum("bytes").alias("bytes")))
    most = min(float(sample_bytes), total_bytes / max(1, total.count()))
    unit = F.pmod(draw, F.lit(1 << 30)) / float(1 << 30)
    d = d.withColumn("_unit", unit).join(total, "lang")
    return d.filter(F.col("_unit") * F.col("bytes") < most).select("lang", "text").distinct()


def followers(sample: DataFrame) -> DataFrame:
    """lang, gram, n: counts of four-byte windows. A text is preceded by three zero bytes."""
    ship(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = np.frombuffer(b"\0" * ORDER + text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                for k in range(0, len(data) - ORDER, _CHUNK):
                    part = data[k : k + _CHUNK + ORDER].astype(np.uint32)
                    gram = part[:-3] << 24 | part[1:-2] << 16 | part[2:-1] << 8 | part[3:]
                    value, n = np.unique(gram, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(value), pa.string()),
                            pa.array(value.astype(np.int64)),
                            pa.array(n.astype(np.int64)),
                        ],
                        ["lang", "gram", "n"],
                    )

    counted = sample.mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """The contexts of one length, and what followed each of them in any language of a group.

    rows: context (places of its bytes) -> row, the last one for contexts that never occurred.
    known: per row the bytes that followed, a bit each; first: per word of bits, the code lengths
    before it. codes: [follower, language] in bits; escapes: [row, language].
    """

    rows: np.ndarray
    known: np.ndarray
    first: np.ndarray
    codes: np.ndarray
    escapes: np.ndarray


@dataclass
class ContextModel:
    """Code lengths by context and byte, as sparse as what occurred.

    letters: byte -> its place among the bytes that were seen (all others share the last one, and
    never followed anything). groups: of some languages each, the levels from no byte of context up.
    """

    langs: list[str]
    letters: np.ndarray
    size: int
    groups: list[list[Level]]

    def lengths(self, text: str) -> np.ndarray:
        """The exact code length of a whole text in each language."""
        data = np.frombuffer(b"\0" * ORDER + text.encode("utf-8", "surrogatepass"), np.uint8)
        parts = [0.0] * len(self.groups)
        for k in range(0, len(data) - ORDER, _CHUNK):
            x = self.letters[data[k : k + _CHUNK + ORDER]]
            for g, levels in enumerate(self.groups):
                parts[g] = parts[g] + self._length(x, levels)
        return np.concatenate(parts) if parts and len(data) > ORDER else np.zeros(len(self.langs))

    def _length(self, x: np.ndarray, levels: list[Level]) -> np.ndarray:
        at = np.arange(ORDER, len(x))
        total = np.zeros(levels[0].codes.shape[1])
        words = levels[0].known.shape[1]
        for order in range(ORDER, -1, -1):
            level, byte = levels[order], x[at]
            context = np.zeros(len(at), np.int64)
            for back in range(order, 0, -1):
                context = context * self.size + x[at - back]
            row = level.rows[context]
            place = row * words + (byte >> 6)
            known = level.known.reshape(-1)[place]
            bit = np.uint64(1) << (byte & 63).astype(np.uint64)
            followed = (known & bit) != 0
            code = level.first.reshape(-1)[place] + np.bitwise_count(known & (bit - np.uint64(1)))
            total += level.codes[code[followed]].sum(axis=0, dtype=np.float64)
            if followed.all():
                return total
            at = at[~followed]
            total += level.escapes[row[~followed]].sum(axis=0, dtype=np.float64)
        return total + 8.0 * len(at)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the shortest code, and its share if all are equally likely before.

        A text without a letter, null too, is `und` with 0. Of equal codes the first language
        by name holds.
        """
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        bits = self.lengths(text)
        best = int(np.argmin(bits))
        odds = np.exp2(-np.minimum(bits - bits[best], 1000.0))
        return self.langs[best], float(1.0 / odds.sum())


def _levels(x: list[np.ndarray], n: np.ndarray, lang: np.ndarray, a: int, langs: int) -> list[Level]:
    """From windows (places of their four bytes), their counts and languages."""
    out: list[Level] = []
    below, shorter = np.zeros(0, np.int64), np.zeros((0, langs), np.float32)
    words = -(-a // 64)
    for order in range(ORDER + 1):
        key = np.zeros(len(n), np.int64)
        for part in x[ORDER - order :]:
            key = key * a + part
        names, at = np.unique(key, return_inverse=True)
        counts = np.zeros((len(names), langs))
        np.add.at(counts, (at, lang), n)
        contexts, starts, of = np.unique(names // a, return_index=True, return_inverse=True)
        different = np.add.reduceat(counts > 0, starts, axis=0, dtype=np.int64)
        whole = np.add.reduceat(counts, starts, axis=0) + different
        with np.errstate(divide="ignore", invalid="ignore"):
            escapes = np.where(different > 0, np.log2(np.maximum(whole, 1)) - np.log2(np.maximum(different, 1)), 0.0)
            own = np.log2(whole[of]) - np.log2(counts)
        # A byte that followed a context also followed the context one byte shorter.
        less = shorter[np.searchsorted(below, names % a**order)] if order else np.full(counts.shape, 8.0)
        codes = np.where(counts > 0, own, escapes[of] + less)
        byte = names % a
        known = np.zeros((len(contexts) + 1, words), np.uint64)
        np.bitwise_or.at(known, (of, byte >> 6), np.uint64(1) << (byte & 63).astype(np.uint64))
        bits = np.bitwise_count(known).astype(np.int64).reshape(-1)
        first = (np.cumsum(bits) - bits).reshape(known.shape)
        rows = np.full(a**order, len(contexts), np.int32)
        rows[contexts] = np.arange(len(contexts), dtype=np.int32)
        escapes = np.concatenate([escapes, np.zeros((1, langs))])
        out.append(Level(rows, known, first.astype(np.int32), codes.astype(np.float32), escapes.astype(np.float32)))
        below, shorter = names, codes
    return out


def build(counts: pd.DataFrame, group: int = GROUP) -> ContextModel:
    """Trees from lang, gram, n."""
    langs = sorted(counts["lang"].unique())
    if not langs:
        return ContextModel([], np.zeros(256, np.int64), 1, [])
    gram = counts["gram"].to_numpy()
    n = counts["n"].to_numpy().astype(np.float64)
    lang = np.searchsorted(langs, counts["lang"].to_numpy().astype(str))
    seen = np.unique(np.concatenate([[0], *[gram >> s & 255 for s in (24, 16, 8, 0)]])).astype(int)
    letters = np.full(256, len(seen), np.int64)
    letters[seen] = np.arange(len(seen))
    a = len(seen) + 1
    x = [letters[gram >> s & 255] for s in (24, 16, 8, 0)]
    groups = []
    for k in range(0, len(langs), group):
        own = (lang >= k) & (lang < k + group)
        groups.append(_levels([p[own] for p in x], n[own], lang[own] - k, a, min(group, len(langs) - k)))
    return ContextModel(langs, letters, a, groups)


def fit(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> ContextModel:
    """The model of the given labelled documents; what the driver holds is bounded by the sample."""
    return build(followers(cut(sampled(docs, sample_bytes, total_bytes))).toPandas())


def predicted(docs: DataFrame, model: ContextModel, text: str = "text") -> list[Column]:
    """Columns lang_pred and score for every whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the contexts of TOTAL_BYTES at most

    @F.pandas_udf("lang_pred string, score double")
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            yield pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score"])

    got = tell(F.col(text).cast("string"))
    return [got["lang_pred"].alias("lang_pred"), got["score"].alias("score")]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def languages(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from the documents that are not held out. A document without an id is not held out;
    without any labelled text every prediction is `und`. Other columns are left aside.
    """
    model = fit(docs.filter(~held_out(F.col("doc_id"))), sample_bytes, total_bytes)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        *predicted(docs, model),
    )
