"""Sequential steps of a camera, written as running values over its frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightings.functions.timing import epoch_us
from sightings.operators.ordered import as_of, highest, lag, last, rows_since, running, total
from sightings.schema import FRAME_ORDER
from sightings.session import cut

# Priority before the first alert; priority at or under which nothing is kept.
NO_PRIORITY = -4
SILENT_PRIORITY = -3


def departed_tags(per_frame: DataFrame, silent: int = SILENT_PRIORITY) -> DataFrame:
    """Tags of the previous frame that are gone, if that frame's priority was loud enough.

    per_frame: one row per processed frame with `tags` (array) and `priority`.
    """
    d = running(
        per_frame,
        ["cam"],
        FRAME_ORDER,
        {"prior_tags": lag("tags"), "prior_priority": lag("priority")},
    )
    gone = F.array_sort(F.array_except("prior_tags", "tags"))
    return (
        d.withColumn("departed", gone)
        .filter((F.size("departed") > 0) & (F.col("prior_priority") > silent))
        .select("cam", "frame_id", *FRAME_ORDER, "departed")
    )


def carry_priority(per_frame: DataFrame) -> DataFrame:
    """Frame priority with carry-forward.

    per_frame: has_new, has_valid, scored (priority if the frame alerts, null in warm-up).
    A frame with new objects takes its score, one with only known objects keeps the value
    of the frame before, an empty one falls back to the lowest.
    """
    anchor = F.when(F.col("has_new"), F.coalesce(F.col("scored"), F.lit(NO_PRIORITY))).when(
        ~F.col("has_valid"), F.lit(NO_PRIORITY)
    )
    d = running(per_frame, ["cam"], FRAME_ORDER, {"priority": last(anchor)})
    return d.withColumn("priority", F.coalesce("priority", F.lit(NO_PRIORITY)).cast("int"))


def count_changes(counts: DataFrame) -> DataFrame:
    """Counts that differ from the last one published for the camera and tag.

    counts: one row per frame and published tag (zero-filled).
    """
    d = running(counts, ["cam", "tag"], FRAME_ORDER, {"_prior": lag("count")})
    return d.filter(~F.col("count").eqNullSafe(F.col("_prior"))).drop("_prior")


def show_changes(shows: DataFrame) -> DataFrame:
    """Show flags sent; the sum is compared, so a true flag may repeat."""
    d = running(shows, ["cam"], FRAME_ORDER, {"_prior": lag("show_count")})
    return d.filter(F.coalesce("_prior", F.lit(-1)) != F.col("show_count")).drop("_prior")


def warmed_up(frames: DataFrame, frames_needed: int = 2, once: bool = False) -> DataFrame:
    """Mark frames that may alert: from the third of a camera on; all with `once`.

    Frames that `link_frames` counted are not counted again.
    """
    d = frames
    if "cam_age" not in d.columns:
        d = running(frames, ["cam"], FRAME_ORDER, {"cam_age": total(F.lit(1))})
    return d.withColumn("warm", F.lit(True) if once else F.col("cam_age") > frames_needed)


def frame_before(per_frame: DataFrame) -> DataFrame:
    """For each saved frame, the frame before it unless that one was saved itself."""
    d = running(
        per_frame,
        ["cam"],
        FRAME_ORDER,
        {
            "prior_frame_id": lag("frame_id"),
            "prior_frame_ts": lag("frame_ts"),
            "_prior_saved": lag("saved"),
        },
    )
    return d.filter(F.col("saved") & ~F.col("_prior_saved")).drop("_prior_saved")


def capture_health(attempts: DataFrame, reboot_over: int = 3) -> DataFrame:
    """Back-off after failed captures: the k-th in a row (from 0) skips 2^k cycles.

    attempts: cam, ts, ok.
    """
    d = rows_since(attempts, ["cam"], ["ts"], F.col("ok"), "_fails")
    fails = F.when(F.col("ok"), F.lit(0)).otherwise(F.col("_fails")).cast("int")
    skip = F.when(F.col("ok"), F.lit(0.0)).otherwise(F.pow(F.lit(2.0), F.col("_fails") - 1))
    return d.select(
        *attempts.columns,
        fails.alias("fails"),
        skip.alias("skip"),
        (skip > reboot_over).alias("reboot"),
    )


def throttle(
    df: DataFrame, keys: list[str], ts: str = "ts", period_s: int = 86_400, tie: str | None = None
) -> DataFrame:
    """Events that fire when each may only follow the last *fired* one by more than a period.

    Each event points to the first one more than a period later; what fires is the chain of
    pointers from the first event of a key. A gap longer than a period always starts a new
    chain, so chains are cut there. Chains are followed by doubling the pointers: the number
    of joins grows with the logarithm of the longest chain, and no key is folded in one task.
    Events of equal time count as one; pass `tie` to name the column that picks it.
    """
    us = "_us"
    d = df.withColumn(us, epoch_us(ts))
    period = period_s * 1_000_000
    times = d.groupBy(*keys, us).agg(F.min(tie).alias("_tie") if tie else F.lit(0).alias("_tie"))
    stamp = F.timestamp_micros(us)
    times = times.withColumn("_ts", stamp)
    times = cut(running(times, keys, ["_ts"], {"_prior": lag(us)}))
    fresh = F.col("_prior").isNull() | (F.col(us) - F.col("_prior") > period)
    times = running(
        times.withColumn("_fresh", fresh),
        keys,
        ["_ts"],
        {"_chain": highest(F.when(F.col("_fresh"), F.col(us)))},
    )
    probe = times.select(*keys, us, "_chain", "_fresh", "_tie").withColumn(
        "_limit", F.timestamp_micros(F.col(us) + period)
    )
    target = times.select(
        *keys, "_ts", F.col(us).alias("_next"), F.col("_chain").alias("_next_chain")
    )
    nodes = as_of(probe, target, keys, "_limit", ["_next", "_next_chain"], "_ts", forward=True)
    same = F.col("_next_chain") == F.col("_chain")
    nodes = cut(
        nodes.select(*keys, us, "_chain", "_fresh", "_tie", F.when(same, F.col("_next")).alias("_next"))
    )
    span = nodes.groupBy(*keys, "_chain").agg((F.max(us) - F.min(us)).alias("_span"))
    longest = span.agg(F.max("_span")).first()[0] or 0
    # Most chains end at once; only those of more than a period go through the loop.
    long = span.filter(F.col("_span") > period).select(*keys, "_chain")
    first = nodes.filter("_fresh").select(*keys, us)
    follow = nodes.join(long, [*keys, "_chain"], "left_semi")
    fired = follow.filter("_fresh").select(*keys, us)
    jump = follow.filter("_next is not null").select(*keys, us, "_next")
    for _ in range(math.ceil(math.log2(longest // period + 2)) if longest > period else 0):
        step = fired.join(jump, [*keys, us]).select(*keys, F.col("_next").alias(us))
        fired = cut(fired.unionByName(step).distinct())
        far = jump.select(*keys, F.col(us).alias("_next"), F.col("_next").alias("_far"))
        jump = cut(
            jump.join(far, [*keys, "_next"]).select(*keys, us, F.col("_far").alias("_next"))
        )
    picked = first.unionByName(fired).distinct().join(nodes.select(*keys, us, "_tie"), [*keys, us])
    hit = d.join(picked, [*keys, us])
    if tie:
        return hit.filter(F.col(tie) == F.col("_tie")).drop(us, "_tie")
    once = Window.partitionBy(*keys, us).orderBy(*df.columns)
    return hit.withColumn("_rn", F.row_number().over(once)).filter("_rn = 1").drop(
        us, "_tie", "_rn"
    )


def drop_repeat_frames(frames: DataFrame) -> DataFrame:
    """Drop a frame whose hash equals that of the camera's previous frame (A, B, A all stay).

    A frame without a hash is no repeat, and none follows it.
    """
    d = running(frames, ["cam"], FRAME_ORDER, {"_prior": lag("hash")})
    repeats = F.coalesce(F.col("hash") == F.col("_prior"), F.lit(False))
    return d.filter(~repeats).drop("_prior")
