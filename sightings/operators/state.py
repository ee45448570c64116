"""Entity states (switches, presence) at frame time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings.functions.timing import mode
from sightings.operators.ordered import last, running

MOST_BUCKETS = 256


def asof_state(
    frames: DataFrame,
    states: DataFrame,
    entities: Sequence[str],
    slice_s: int = 600,
    buckets: int | None = None,
    tie: str = "state",
) -> DataFrame:
    """Last known state of each entity at each frame, all entities in one pass.

    states: entity, ts, state. Adds one column per entity, and `missing_state` where some
    entity was never seen. Of states of one entity and time the last by `tie` holds. All cameras
    share the switches, so frames are dealt into buckets and each bucket gets all states: set
    `buckets` by how many frames there are for each state.
    """
    cols = frames.columns
    if buckets is None:
        n = states.filter(F.col("entity").isin(*entities)).count()
        buckets = max(1, min(MOST_BUCKETS, frames.count() // max(1, n)))
    f = frames.select(
        F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in cols]), F.lit(buckets)).alias("_bucket"),
        F.col("frame_ts").alias("_time"), F.lit(1).alias("_side"), F.struct(*cols).alias("_frame"),
    )
    s = states.filter(F.col("entity").isin(*entities)).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("_bucket"),
        F.col("ts").alias("_time"), F.lit(0).alias("_side"), "entity", "state",
        F.col(tie).alias("_tie"),
    )
    both = f.unionByName(s, allowMissingColumns=True)
    values = {e: last(F.when(F.col("entity") == e, F.col("state"))) for e in entities}
    own = F.col("_side") == 1
    d = running(both, ["_bucket"], ["_time", "_side", "_tie"], values, slice_s, keep=own)
    missing = F.lit(False)
    for e in entities:
        missing = missing | F.col(e).isNull()
    return d.select("_frame.*", *entities, missing.alias("missing_state"))


def with_mode(df: DataFrame, night: str = "night_mode", presence: str = "presence") -> DataFrame:
    """Household mode from the two state columns; null only where neither decides it."""
    known: Column = mode(F.col(night) == "on", F.col(presence) == "home")
    return df.withColumn("mode", known)
