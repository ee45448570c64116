"""Mixing sources to target weights by capped water-filling (operator 2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightings.llm.storage import word_count
from sightings.session import cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
#: Parts that a source's documents are cut into by their draw; only one is put in order.
DRAW_PARTS = 4096

_DRAW_BITS = 48


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A document's draw, 0 to 2**48 - 1: the head of a digest of seed, id and text."""
    name = F.concat(F.lit(seed + "/"), F.coalesce(doc_id.cast("string"), F.lit("~")))
    body = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(name, F.lit("/"), body).cast("binary"))
    return F.conv(F.substring(digest, 1, _DRAW_BITS // 4), 16, 10).cast("long")


def source_weights(sizes: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """source, source_size, weight: weights in turn, sources by code point, null last.

    Ranks are counted per range of names, so no task holds all sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    ranged = cut(
        per.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    line = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    base = counts.select("_part", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_base"))
    rank = F.col("_base") + inside
    turn = F.array(*[F.lit(float(w)) for w in weights])
    placed = ranged.withColumn("_part", part).join(base, "_part")
    weight = F.element_at(turn, (rank % len(weights) + 1).cast("int"))
    return placed.select("source", "source_size", weight.alias("weight"))


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds `target`: share of all sizes by weight, clamped at max_epochs times the own size.

    What clamping frees goes to the rest by weight, until no target is above its clamp. Each
    round is one sum over the sources; a clamped source stays clamped, so rounds end.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    wanted = min(share, max_epochs) * total
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        full = F.col("source_size") * F.lit(float(max_epochs)) <= F.col("weight") * F.lit(level)
        taken, rest, n = sources.agg(
            F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))
        ).first()
        if n == clamped or not rest:
            break
        clamped, level = n, (wanted - (taken or 0.0)) / rest
    target = F.least(cap, F.col("weight") * F.lit(level)) if rest else cap
    return sources.withColumn("target", target)


def repetitions(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, reps: how often a mix takes a document.

    A source of `target` words in all and `source_size` of its own takes each document
    floor(target / source_size) times, and once more those of the lowest draws, up to the
    fraction that is left. The draws are cut into parts; sums of parts say in which part the
    limit lies, and only that part is put in order, so a source with most documents is no
    single task's work. A source is off its target by half a document at most, unless no part
    of it can be taken. Draws depend on seed, id and text alone, so runs agree; rows of equal
    id and text share their draw and what it gives.
    Null text has size 0, and a document of no words follows its draw like others; null source
    is a source of its own, null ids are allowed, empty tables give no rows.
    """
    text = F.col("text").cast("string")
    sized = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(text).alias("text_key"),
            F.col("source").cast("string").alias("source"),
            word_count(text).alias("size"),
            draw(F.col("doc_id"), text, seed).alias("draw"),
        )
    )
    sources = cut(water_fill(source_weights(sized, weights), share, max_epochs))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = sources.withColumn("whole", F.floor(ratio)).withColumn(
        "extra", F.col("target") - F.col("whole") * F.col("source_size")
    )
    part = F.shiftright("draw", _DRAW_BITS - (DRAW_PARTS - 1).bit_length())
    parts = sized.groupBy("source", part.alias("part")).agg(F.sum("size").alias("part_size"))
    line = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part_size").over(line), F.lit(0)))
    same_source = F.col("p.source").eqNullSafe(F.col("s.source"))
    parts = (
        parts.alias("p")
        .join(plan.alias("s"), same_source)
        .select("p.source", "part", "part_size", "before", "source_size", "target", "whole", "extra")
    )
    d = sized.withColumn("part", part)
    d = (
        d.alias("d")
        .join(
            parts.alias("p"),
            F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.part") == F.col("p.part")),
        )
        .select("d.*", "part_size", "before", "source_size", "target", "whole", "extra")
    )
    below = (F.col("extra") > 0) & (F.col("before") + F.col("part_size") <= F.col("extra"))
    edge = ~below & (F.col("before") < F.col("extra"))
    inner = Window.partitionBy("source", "part").orderBy("draw", "doc_id", "text_key")
    upto = F.sum("size").over(inner.rangeBetween(Window.unboundedPreceding, 0)) + F.col("before")
    more = upto - F.col("size") / 2 <= F.col("extra")
    out = ["doc_id", "text_key", "source", "size", "source_size", "target"]
    sure = d.filter(~edge).select(*out, (F.col("whole") + below.cast("int")).cast("int").alias("reps"))
    rest = d.filter(edge).withColumn("_more", more)
    rest = rest.select(*out, (F.col("whole") + F.col("_more").cast("int")).cast("int").alias("reps"))
    return sure.unionByName(rest)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs with each row as often as the mix takes it, columns unchanged."""
    r = repetitions(docs, **options)
    n = r.groupBy("doc_id", "text_key", "source").agg(F.max("reps").alias("reps")).filter("reps > 0")
    d = docs.select(
        F.struct(*docs.columns).alias("_doc"),
        F.col("doc_id").cast("long").alias("_id"),
        F.xxhash64(F.col("text").cast("string")).alias("_key"),
        F.col("source").cast("string").alias("_source"),
    )
    same = (
        F.col("_id").eqNullSafe(F.col("doc_id"))
        & (F.col("_key") == F.col("text_key"))
        & F.col("_source").eqNullSafe(F.col("source"))
    )
    times = F.explode(F.sequence(F.lit(1), F.col("reps")))
    return d.join(n, same).select("_doc", times.alias("_t")).select("_doc.*")
