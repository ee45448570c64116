"""Benchmark decontamination by a broadcast hash set of test n-grams (operator 10).

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings.session import cut

WINDOW = 13
#: Windows of the test sets that may be broadcast (100 bytes each, about); more are shuffled.
BROADCAST_WINDOWS = 500_000
#: Share of a document's words that makes it contaminated, as 1 in so many.
ONE_IN = 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Digits, ASCII letters, and everything beyond ASCII.
_TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """A text's words with A-Z lower-cased; null has none."""
    # lower() touches letters beyond ASCII, so it serves for texts without such.
    plain = F.octet_length(text) == F.char_length(text)
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    found = F.regexp_extract_all(folded, F.lit(_TOKEN), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """hash, length, gram (its words), items (distinct ids) of all windows of the test items.

    A window is `window` consecutive words; an item of fewer, but not none, is one window. Items
    with equal windows share the row. Null ids count as the empty text among items.
    """
    w = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        words(F.col("text").cast("string")).alias("words"),
    ).filter(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    w = w.withColumn("length", n).select(
        "item_id", "words", "length", F.explode(F.sequence(F.lit(1), F.size("words") - n + 1)).alias("at")
    )
    grams = w.select("item_id", "length", F.slice("words", F.col("at"), F.col("length")).alias("gram"))
    return grams.groupBy("length", "gram").agg(F.collect_set("item_id").alias("items")).select(
        F.xxhash64("gram").alias("hash"), "length", "gram", "items"
    )


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, text_key, at, length, items: each occurrence of a test window in a document.

    Every window of every document is hashed and looked up; what the hash finds is compared
    word by word. The set is broadcast where its size, counted before, allows it. Beyond, places
    and hashes alone are shuffled, and the words of a document with a hit meet them once.
    """
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # WINDOW at most
    small = windows.count() <= BROADCAST_WINDOWS
    text = F.col("text").cast("string")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), words(text).alias("words")
    )
    d = base
    if not lengths:
        d = d.filter(F.lit(False))
    d = d.filter(F.size("words") >= (lengths[0] if lengths else 0))
    d = d.select("doc_id", "text_key", "words", F.posexplode("words").alias("at", "_word")).drop("_word")
    if len(lengths) == 1:
        d = d.withColumn("length", F.lit(lengths[0]))
    else:
        d = d.withColumn("length", F.explode(F.array(*[F.lit(n) for n in lengths] or [F.lit(0)])))
    d = d.filter(F.col("at") + F.col("length") <= F.size("words"))
    gram = F.slice("words", F.col("at") + 1, F.col("length"))
    d = d.withColumn("hash", F.xxhash64(gram))
    w = windows.withColumnRenamed("length", "_length")
    same = (F.col("length") == F.col("_length")) & (gram == F.col("gram"))
    if small:
        found = d.join(F.broadcast(w), "hash").filter(same)
        return found.select("doc_id", "text_key", "at", "length", "items")
    met = d.select("doc_id", "text_key", "at", "length", "hash").join(w, "hash").filter("length = _length")
    # Rows that repeat id and text have the same places; one of them is compared.
    met = met.dropDuplicates(["doc_id", "text_key", "at", "length", "hash", "gram"])
    met = met.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "length", "gram", "items")).alias("met"))
    met = met.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "met")
    mine = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    sure = F.filter("met", lambda m: F.slice("words", m["at"] + 1, m["length"]) == m["gram"])
    found = base.join(met, mine).select("doc_id", "text_key", F.explode(sure).alias("m"))
    return found.select("doc_id", "text_key", "m.at", "m.length", "m.items")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, n_items, items, spans, contaminated.

    A word inside any occurrence of a test window is hit; items are the ids, as sorted texts, of
    items with an occurring window; spans are the joined hit ranges of words (first, last, end
    exclusive). A document is contaminated when at least one word in `ONE_IN` is hit. Null and
    empty texts have no words and no hits; rows that repeat id and text get the same result.
    A document's hits meet by its id and text; they are bounded by its own words.
    """
    windows = cut(test_windows(items, window))
    key = ["doc_id", "text_key"]
    found = hits(docs, windows)
    of_doc = found.groupBy(*key).agg(
        F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("length")).alias("to")))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # Ranges in order: each either goes on with the last span or opens a new one.
    start = F.struct(
        F.lit(-1).alias("first"), F.lit(-1).alias("to"), F.array().cast("array<struct<first:int,to:int>>").alias("done")
    )

    def step(acc: Column, r: Column) -> Column:
        goes_on = r["at"] <= acc["to"]
        closed = F.when(
            goes_on | (acc["to"] < 0), acc["done"]
        ).otherwise(F.array_append(acc["done"], F.struct(acc["first"].alias("first"), acc["to"].alias("to"))))
        return F.struct(
            F.when(goes_on, acc["first"]).otherwise(r["at"]).alias("first"),
            F.greatest(r["to"], acc["to"]).alias("to"),
            closed.alias("done"),
        )

    spans = F.aggregate(
        "ranges", start, step,
        lambda acc: F.array_append(acc["done"], F.struct(acc["first"].alias("first"), acc["to"].alias("to"))),
    )
    of_doc = of_doc.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "items", spans.alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["to"] - s["first"])
    text = F.col("text").cast("string")
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0)).cast("long").alias("n_words"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    d = counted.join(of_doc, same, "left").withColumn("n_hit", F.coalesce(n_hit, F.lit(0)).cast("long"))
    none = F.array().cast("array<string>")
    return d.select(
        *key,
        "n_words",
        "n_hit",
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,to:int>>")).alias("spans"),
        ((F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, columns unchanged.

    Null and empty texts are clean, rows that repeat share their fate, and columns may have any
    names; an empty table gives no rows.
    """
    bad = contamination(docs, items, window).filter("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")
    )
    bad = cut(bad.distinct())
    row = F.struct(*docs.columns).alias("_doc")
    d = docs.select(
        row, F.col("doc_id").cast("long").alias("_did"), F.xxhash64(F.col("text").cast("string")).alias("_dkey")
    )
    same = F.col("_did").eqNullSafe(F.col("_id")) & (F.col("_dkey") == F.col("_key"))
    return d.join(bad, same, "left_anti").select("_doc.*")


def without_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with `text` of hit documents reduced to the words outside their spans, space-joined.

    Documents without a hit, null and empty texts among them, are unchanged; other columns stay as
    they are, whatever their names. Rows that repeat are all reduced; an empty table gives no rows.
    """
    hit = contamination(docs, items, window).filter("n_hit > 0").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans"
    ).dropDuplicates(["_id", "_key"])
    row = F.struct(*docs.columns).alias("_doc")
    d = docs.select(
        row, F.col("doc_id").cast("long").alias("_did"), F.xxhash64(F.col("text").cast("string")).alias("_dkey")
    )
    same = F.col("_did").eqNullSafe(F.col("_id")) & (F.col("_dkey") == F.col("_key"))
    d = d.join(hit, same, "left")
    left = F.filter(
        words(F.col("_doc.text").cast("string")),
        lambda w, i: ~F.exists("spans", lambda s: (s["first"] <= i) & (i < s["to"])),
    )
    text = F.when(F.col("spans").isNull(), F.col("_doc.text").cast("string")).otherwise(F.array_join(left, " "))
    return d.withColumn("_text", text).select(
        *[F.col("_text").alias("text") if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns]
    )
