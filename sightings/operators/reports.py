"""Counts, sets and reports per frame and per cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings.functions.columns import with_lookup
from sightings.functions.text import detection_label, underscored

# Age reported for a frame without detections; icon prefix of a sensor.
NO_AGE = 1_000_000
ICON_PREFIX = "mdi:"


def tag_counts(
    tracked: DataFrame, frames: DataFrame, cameras: DataFrame
) -> DataFrame:
    """Detections per frame and published tag of its camera, zeros included.

    A package counts once its age is over 0. Detections are first
    reduced to one row per frame and tag; blank tags are dropped.
    """
    counted = (F.col("tag") != "package") | (F.col("age") > 0)
    seen = (
        tracked.filter(F.col("ignore").isNull() & counted)
        .groupBy("frame_id", "tag")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    wanted = (
        frames.select("cam", "frame_id", "frame_no", "frame_ts")
        .join(cameras.select("cam", "publish"), "cam")
        .withColumn("tag", F.explode("publish"))
        .filter(F.col("tag") != "")
        .drop("publish")
    )
    return wanted.join(seen, ["frame_id", "tag"], "left").withColumn(
        "count", F.coalesce("count", F.lit(0))
    )


def show_flag(counts: DataFrame, frames: DataFrame) -> DataFrame:
    """Sum of counts and show flag of every frame, also of cameras that publish no tag."""
    sums = counts.groupBy("frame_id").agg(F.sum("count").alias("show_count"))
    d = frames.select("cam", "frame_id", "frame_no", "frame_ts").join(sums, "frame_id", "left")
    d = d.withColumn("show_count", F.coalesce("show_count", F.lit(0).cast("long")))
    return d.withColumn("show", F.col("show_count") > 0)


def object_sets(df: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Sorted set of tags per frame, and of new tags where `is_new` is known.

    With `frames`, frames without detections get empty sets.
    """
    aggs = [F.array_sort(F.collect_set("tag")).alias("tags")]
    if "is_new" in df.columns:
        aggs.append(
            F.array_sort(F.collect_set(F.when(F.col("is_new"), F.col("tag")))).alias("new_tags")
        )
    sets = df.groupBy("frame_id").agg(*aggs)
    if frames is None:
        return sets
    empty = F.expr("cast(array() as array<string>)")
    out = frames.select("frame_id", "cam", "frame_no", "frame_ts").join(sets, "frame_id", "left")
    for c in sets.columns[1:]:
        out = out.withColumn(c, F.coalesce(c, empty))
    return out


def min_age(df: DataFrame, frames: DataFrame) -> DataFrame:
    youngest = df.groupBy("frame_id").agg(F.min("age").alias("min_age"))
    return (
        frames.select("frame_id", "cam")
        .join(youngest, "frame_id", "left")
        .withColumn("min_age", F.coalesce("min_age", F.lit(NO_AGE)))
    )


def frame_labels(df: DataFrame) -> DataFrame:
    """`cam=[label,label]` per frame, in the order of the detections."""
    label = detection_label(
        *[F.col(c) for c in ("tag", "prob", "iou", "ignore", "priority", "priority_type", "age")]
    )
    listed = F.array_sort(F.collect_list(F.struct("det_no", label.alias("label"))))
    return (
        df.groupBy("frame_id", "cam")
        .agg(listed.alias("_labels"))
        .select(
            "frame_id",
            "cam",
            F.concat(
                F.col("cam"),
                F.lit("=["),
                F.array_join(F.transform("_labels", lambda x: x["label"]), ","),
                F.lit("]"),
            ).alias("message"),
        )
    )


def cycle_report(df: DataFrame, window: str = "30 seconds") -> DataFrame:
    """Frames processed per cycle with summed times and the sorted messages.

    df: one row per processed frame: frame_ts, cam, prediction_s, notify_s, message. A cycle
    holds at most one frame of each camera.
    """
    return (
        df.groupBy(F.window(F.col("frame_ts"), window).alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("frames"),
            F.sum("prediction_s").alias("prediction_s"),
            F.sum("notify_s").alias("notify_s"),
            F.array_join(F.array_sort(F.collect_list("message")), ",").alias("messages"),
        )
        .select(F.col("_w")["start"].alias("cycle_start"), "frames", "prediction_s", "notify_s", "messages")
    )


def sensor_catalogue(cameras: DataFrame, icons: DataFrame) -> DataFrame:
    """One sensor per camera and published tag, and one show sensor per camera."""
    cam = underscored("cam")
    tags = (
        cameras.select("cam", F.explode("publish").alias("tag")).filter(F.col("tag") != "")
    )
    tags = with_lookup(tags, icons, "tag", "icon")
    counts = tags.select(
        "cam",
        "tag",
        F.lit("sensor").alias("kind"),
        F.concat_ws("-", cam, F.col("tag")).alias("uniq_id"),
        _title(F.concat_ws(" ", F.col("cam"), F.col("tag"), F.lit("Count"))).alias("title"),
        F.concat_ws("/", cam, F.col("tag"), F.lit("count")).alias("topic"),
        F.coalesce("icon", F.concat(F.lit(ICON_PREFIX), F.col("tag"))).alias("icon"),
    )
    shows = cameras.select(
        "cam",
        F.lit(None).cast("string").alias("tag"),
        F.lit("binary_sensor").alias("kind"),
        F.concat(F.lit("show-"), cam).alias("uniq_id"),
        _title(F.concat(F.lit("Show "), F.col("cam"))).alias("title"),
        F.concat(cam, F.lit("/show")).alias("topic"),
        F.lit(None).cast("string").alias("icon"),
    )
    both = counts.unionByName(shows)
    payload = F.to_json(
        F.struct(
            F.col("title").alias("name"),
            F.col("topic").alias("state_topic"),
            F.col("uniq_id"),
            F.col("icon"),
        )
    )
    return both.withColumn("payload", payload)


def _title(text: Column) -> Column:
    """Capital after every character that is not a letter, as a title-casing of names does."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, F.initcap), "")
