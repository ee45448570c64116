"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 7)."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings.llm.storage import forget
from sightings.session import ship

#: Places of the hashed weights.
PLACES = 1 << 22
#: Labelled documents that the model is fitted on: those of the smallest draws.
SAMPLE_ROWS = 12_000
#: Features in fewer sample documents than this have no weight.
MIN_DOCUMENTS = 8
#: A feature has a weight when the log odds of the top grade among its documents are this far
#: from those of all, by so many standard deviations more than the best of all features would be
#: by chance; the clearest so many features at most.
MIN_SHIFT, MIN_DEVIATION, MAX_FEATURES = 1.5, 0.5, 8192
ITERATIONS, STEP, SHRINK = 400, 0.1, 1e-4
#: Tail probability of the highest grade from which a document is selected.
SELECT_FROM = 0.7

#: Words that a worker remembers: with their score, and with their features.
_KEPT_SCORES, _KEPT_FEATURES = 200_000, 40_000


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade from labels (quality, toxic): 0 toxic, 1 of poor quality, 2 good.

    Labels without an id or without quality are left aside; null toxic counts as not toxic. Of
    several labels of a document the lowest grade holds.
    """
    grade = F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).when(F.col("quality") <= 0, 1).otherwise(2)
    known = labels.filter("doc_id is not null and quality is not null")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def _place(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % PLACES


def word_features(word: str) -> list[int]:
    """Places of a word: lower-cased, its first three to five letters, the shape of its end."""
    low = word.lower()
    names = [low]
    names += [f"{n}<{low[:n]}" for n in (3, 4, 5) if len(low) > n]
    if not word.isalnum():
        names.append("#" + "".join("a" if c.isalnum() else c for c in word[-3:]))
    if len(word) > 3 and word.isupper():
        names.append("#upper")
    return [_place(n) for n in names]


def text_features(words: list[str]) -> list[int]:
    """Places of what the words are together: how much the most frequent one and repeats make up."""
    if not words:
        return [_place("=none")]
    many = Counter(words)
    top = 10 * max(many.values()) // len(words) if len(words) >= 20 else 0
    return [_place(f"=top{max(top, 2)}"), _place(f"=repeats{min(12, len(words) // len(many))}")]


class _Words:
    """A worker's memory of what a word stands for, bounded."""

    def __init__(self, make, most: int) -> None:
        self.make, self.most, self.known = make, most, {}

    def __call__(self, word: str):
        got = self.known.get(word)
        if got is None:
            got = self.make(word)
            if len(self.known) < self.most:  # the first ones, among them the frequent ones
                self.known[word] = got
        return got


@dataclass
class OrdinalModel:
    """P(grade >= k) = logistic(score - threshold k); thresholds ascend, weights are shared."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scorer(self):
        """Score of a text: the weights of its distinct words' features and of the text's own."""
        w = self.weights
        words = _Words(lambda x: float(sum(w[i] for i in word_features(x))), _KEPT_SCORES)

        def score(text: str | None) -> float:
            found = (text or "").split()
            return sum(map(words, set(found))) + sum(w[i] for i in text_features(found))

        return score

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -60, 60)))

    def to_bytes(self) -> bytes:
        at = np.nonzero(self.weights)[0].astype("<i4")
        head = np.array([len(self.thresholds), len(at)], "<i8")
        return b"".join(
            x.tobytes() for x in (head, self.thresholds.astype("<f8"), at, self.weights[at].astype("<f8"))
        )

    @classmethod
    def from_bytes(cls, data: bytes) -> OrdinalModel:
        k, n = np.frombuffer(data, "<i8", 2).tolist()
        at = np.frombuffer(data, "<i4", n, 16 + 8 * k)
        weights = np.zeros(PLACES)
        weights[at] = np.frombuffer(data, "<f8", n, 16 + 8 * k + 4 * n)
        return cls(weights, np.frombuffer(data, "<f8", k, 16))


def fit_grades(features: list[np.ndarray], grades: np.ndarray, levels: int) -> OrdinalModel:
    """Cumulative-link fit by gradient steps (Adam) on the features that tell grades apart.

    features: per document the distinct places of its features.
    """
    n = len(features)
    top = grades == levels - 1
    share = float(np.clip(top.mean(), 0.5 / n, 1 - 0.5 / n))
    many, good = np.zeros(PLACES, np.int32), np.zeros(PLACES, np.int32)
    for f, t in zip(features, top):
        many[f] += 1
        if t:
            good[f] += 1
    tried = np.nonzero(many >= MIN_DOCUMENTS)[0]
    seen, kept = many[tried].astype(float), good[tried].astype(float)
    off = np.abs(kept - seen * share) / np.sqrt(seen * share * (1 - share) + 1e-9)
    odds = np.log((kept + share) / (seen - kept + 1 - share)) - np.log(share / (1 - share))
    off[np.abs(odds) < MIN_SHIFT] = 0
    clear = np.nonzero(off >= np.sqrt(2 * np.log(max(2, len(tried)))) + MIN_DEVIATION)[0]
    columns = tried[np.sort(clear[np.argsort(-off[clear], kind="stable")][:MAX_FEATURES])]
    del good
    index = many  # no longer needed
    index[:] = -1
    index[columns] = np.arange(len(columns))
    used = [x[x >= 0] for x in (index[f] for f in features)]
    doc, flat, m = np.repeat(np.arange(n), [len(x) for x in used]), np.concatenate(used), len(columns)
    below = np.cumsum(np.bincount(grades, minlength=levels) / n)[:-1].clip(1e-3, 1 - 1e-3)
    x = np.concatenate([np.zeros(m), np.log(below / (1 - below))])
    above = grades[:, None] >= np.arange(1, levels)[None, :]
    mean, power = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, ITERATIONS + 1):
        s = np.bincount(doc, weights=x[:m][flat], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(s[:, None] - x[None, m:], -60, 60)))
        slope = p - above
        g = np.concatenate(
            [np.bincount(flat, weights=slope.sum(axis=1)[doc], minlength=m), -slope.sum(axis=0)]
        ) / n
        g[:m] += SHRINK * x[:m]
        mean, power = 0.9 * mean + 0.1 * g, 0.999 * power + 0.001 * g * g
        x = x - STEP * (mean / (1 - 0.9**k)) / (np.sqrt(power / (1 - 0.999**k)) + 1e-8)
        x[m:] = np.maximum.accumulate(x[m:])
    weights = np.zeros(PLACES)
    weights[columns] = x[:m]
    return OrdinalModel(weights, x[m:])


def fit(docs: DataFrame, grades: DataFrame, sample_rows: int = SAMPLE_ROWS, levels: int = 3) -> OrdinalModel | None:
    """Fit on the labelled documents of the smallest draws, `sample_rows` rows at most.

    None where fewer than two grades occur among them. Ids are drawn by a digest; of rows that
    repeat id and text one counts, and where ids repeat with other texts, so many rows are drawn
    once more. Texts become places of features where they are read; one task fits the model.
    """
    spark = docs.sparkSession
    ship(spark)
    drawn = grades.withColumn("_draw", F.xxhash64(F.lit("grade-sample"), F.col("doc_id")))
    drawn = drawn.orderBy("_draw").limit(sample_rows)
    text = F.col("text").cast("string")
    draw = F.xxhash64(F.lit("grade-row"), F.col("doc_id").cast("long"), text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), draw.alias("draw"), text.alias("text"))
    rows = rows.join(drawn.select("doc_id", "grade"), "doc_id")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        words = _Words(word_features, _KEPT_FEATURES)
        for b in batches:
            out = []
            for text in b.column("text"):
                found = (text.as_py() or "").split()
                flat = [i for x in set(found) for i in words(x)] + text_features(found)
                out.append(np.unique(np.array(flat, "<i4")).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("draw"), b.column("grade").cast(pa.int32()), pa.array(out, pa.binary())],
                ["draw", "grade", "places"],
            )

    def learn(d: pd.DataFrame) -> pd.DataFrame:
        # In an order of its own, so that a run again adds up alike; of equal texts one counts.
        d = d.drop_duplicates(["grade", "places"]).sort_values(["grade", "places"])
        if d["grade"].nunique() < 2:
            return pd.DataFrame({"model": pd.Series([], dtype=object)})
        features = [np.frombuffer(x, "<i4") for x in d["places"]]
        return pd.DataFrame({"model": [fit_grades(features, d["grade"].to_numpy(), levels).to_bytes()]})

    sample = rows.select("draw", "grade", "text").mapInArrow(places, "draw long, grade int, places binary")
    sample = sample.dropDuplicates(["draw"]).orderBy("draw").limit(sample_rows).select("grade", "places")
    got = sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(learn, "model binary").collect()
    return OrdinalModel.from_bytes(bytes(got[0][0])) if got else None


def scored(docs: DataFrame, model: OrdinalModel | None, text: str = "text") -> list[Column]:
    """Columns expected_grade and tail (P of the highest grade) for every whole text.

    A text of no words, null too, has the score 0. Without a model both are null.
    """
    if model is None:
        return [F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail")]
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.to_bytes())  # fixed size: PLACES weights

    @F.pandas_udf("expected_grade double, tail double")
    def grade(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        m = OrdinalModel.from_bytes(shared.value)
        score = m.scorer()
        for texts in batches:
            p = m.tails(np.array([score(t) for t in texts], float))
            yield pd.DataFrame({"expected_grade": p.sum(axis=1), "tail": p[:, -1]})

    found = grade(F.col(text).cast("string"))
    return [found["expected_grade"].alias("expected_grade"), found["tail"].alias("tail")]


def grades(docs: DataFrame, labels: DataFrame, select_from: float = SELECT_FROM, **options) -> DataFrame:
    """One row per document: doc_id, expected_grade, tail, selected.

    The model learns from `labels` and the texts of labelled documents. A document is selected
    when the probability of the highest grade is at least `select_from`; where there is nothing
    to learn from (no labels, or one grade), every document is selected and has no grade.
    """
    model = fit(docs, graded(labels), **options)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *scored(docs, model))
    return d.withColumn("selected", F.coalesce(F.col("tail") >= select_from, F.lit(True)))


def select_documents(docs: DataFrame, labels: DataFrame, select_from: float = SELECT_FROM, **options) -> DataFrame:
    """The documents that `grades` selects, with their columns unchanged.

    Rows that repeat are selected alike; a null text counts as empty; an empty table gives no rows.
    """
    model = fit(docs, graded(labels), **options)
    if model is None:
        return docs
    row = F.struct(*docs.columns).alias("_doc")
    tail = scored(docs, model)[1]
    return docs.select(row, tail.alias("_tail")).filter(F.col("_tail") >= select_from).select("_doc.*")
