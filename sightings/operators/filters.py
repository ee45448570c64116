"""Row-wise steps of the detection pipeline, and the hysteresis threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sightings.functions.geometry import box_center, polyline_legs, polyline_y
from sightings.functions.timing import HOUR, time_bucket
from sightings.operators.ordered import held, lag, running, total
from sightings.schema import FRAME_ORDER

# The confidence a tag needs while it was present one frame earlier.
STICKY_CONFIDENCE = 0.4


def route_models(raw: DataFrame, frames: DataFrame, cameras: DataFrame) -> DataFrame:
    """Keep each frame's boxes of the model that fits it, vehicle boxes where asked for.

    `raw` has frame_id, model, det_no and any other columns; frames give cam and is_grey,
    cameras vehicle_check. Detections are renumbered, vehicle boxes last.
    """
    f = frames.select("frame_id", "cam", "frame_no", "frame_ts", "is_grey")
    c = cameras.select("cam", "vehicle_check")
    main = F.col("model") == F.when(F.col("is_grey"), "grey").otherwise("color")
    vehicle = (F.col("model") == "vehicle") & F.coalesce(F.col("vehicle_check"), F.lit(False))
    frame = Window.partitionBy("frame_id").orderBy(F.col("model") == "vehicle", "det_no")
    kept = (
        raw.drop("cam", "frame_no", "frame_ts")
        .join(f, "frame_id")
        .join(c, "cam", "left")
        .filter(main | vehicle)
    )
    return kept.withColumn("det_no", (F.row_number().over(frame) - 1).cast("int")).drop(
        "is_grey", "vehicle_check"
    )


def with_center(df: DataFrame) -> DataFrame:
    return df.withColumn("center", box_center(F.col("box")))


def begin(df: DataFrame) -> DataFrame:
    """Add the columns that later steps fill: center, raw_tag, road_y, ignore."""
    return (
        with_center(df)
        .withColumn("raw_tag", F.col("tag"))
        .withColumn("road_y", F.lit(None).cast("double"))
        .withColumn("ignore", F.lit(None).cast("string"))
    )


def classify_road(df: DataFrame, cameras: DataFrame) -> DataFrame:
    """Rename what is on the road: everywhere (`all`) or above a road line.

    Above a line a vehicle is also ignored; in `all` mode nothing is.
    """
    road = cameras.select(
        "cam", "road_mode", "road_line", polyline_legs("road_line").alias("_legs")
    )
    d = df.join(road, "cam", "left")
    line = F.col("road_mode") == "line"
    d = d.withColumn(
        "road_y", F.when(line, polyline_y(F.col("center")["x"], "road_line", "_legs"))
    )
    above = line & (F.col("center")["y"] < F.col("road_y"))
    on_road = F.coalesce((F.col("road_mode") == "all") | above, F.lit(False))
    tag = F.col("tag")
    return d.select(
        *[F.col(c) for c in df.columns if c not in ("tag", "ignore", "road_y")],
        F.col("road_y"),
        F.when(on_road & tag.isin("person", "vehicle", "dog"), F.concat(tag, F.lit("_road")))
        .otherwise(tag)
        .alias("tag"),
        F.when(F.coalesce(above, F.lit(False)) & (tag == "vehicle"), "road")
        .otherwise(F.col("ignore"))
        .alias("ignore"),
    )


def apply_region_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Camera-specific regions, as data; rules run in `ord` and see earlier renames.

    rules: cam, ord, tags, max_bottom, min_left, max_center_x, ignore, rename_road. A null
    bound does not restrict. One camera's rules are folded into one array, so that the
    detections need no shuffle.
    """
    fields = ["ord", "tags", "max_bottom", "min_left", "max_center_x", "ignore", "rename_road"]
    per_cam = rules.groupBy("cam").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("_rules")
    )
    d = df.join(per_cam, "cam", "left")
    box, center = F.col("box"), F.col("center")

    def within(bound: Column, test: Column) -> Column:
        return bound.isNull() | test

    def step(acc: Column, r: Column) -> Column:
        hit = (
            F.array_contains(r["tags"], acc["tag"])
            & within(r["max_bottom"], box["top"] + box["height"] < r["max_bottom"])
            & within(r["min_left"], box["left"] > r["min_left"])
            & within(r["max_center_x"], center["x"] < r["max_center_x"])
        )
        renamed = F.when(r["rename_road"], F.concat(acc["tag"], F.lit("_road"))).otherwise(
            acc["tag"]
        )
        return F.struct(
            F.when(hit, renamed).otherwise(acc["tag"]).alias("tag"),
            F.when(hit, F.coalesce(r["ignore"], acc["ignore"]))
            .otherwise(acc["ignore"])
            .alias("ignore"),
        )

    start = F.struct(F.col("tag").alias("tag"), F.col("ignore").alias("ignore"))
    result = F.when(F.col("_rules").isNull(), start).otherwise(
        F.aggregate(F.col("_rules"), start, step)
    )
    return (
        d.withColumn("_result", result)
        .withColumn("tag", F.col("_result")["tag"])
        .withColumn("ignore", F.col("_result")["ignore"])
        .drop("_rules", "_result")
    )


def valid(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ignore").isNull())


def sample_frames(df: DataFrame, every: int = 15, min_prob: float = 0.6) -> DataFrame:
    """Every n-th frame, confident detections only."""
    return df.filter((F.pmod(F.col("frame_no"), F.lit(every)) == 0) & (F.col("prob") > min_prob))


def link_frames(frames: DataFrame, count: bool = False) -> DataFrame:
    """Frames with the id and time of the camera's frame before; kept if already there.

    With `count` also the camera's number of frames so far, as `changes.warmed_up` asks for it.
    Runs a job, which reads the frames once.
    """
    if "prev_frame_id" in frames.columns:
        return frames
    values = {"prev_frame_id": lag("frame_id"), "prev_frame_ts": lag("frame_ts")}
    if count:
        values["cam_age"] = total(F.lit(1))
    return running(frames, ["cam"], FRAME_ORDER, values, keep=F.lit(True))


def with_links(df: DataFrame, frames: DataFrame) -> DataFrame:
    """Detections with the id and time of the frame before theirs, so that later steps need no frames."""
    linked = link_frames(frames).select("frame_id", "prev_frame_id", "prev_frame_ts")
    return df.join(linked, "frame_id", "left")


def tag_presence(
    df: DataFrame,
    frames: DataFrame,
    thresholds: DataFrame,
    default: float,
    low: float = STICKY_CONFIDENCE,
) -> DataFrame:
    """Frames at which a tag counts as present, for the hysteresis threshold.

    A tag is present where a detection of it passes its threshold, and stays present over
    directly following frames of the camera that see it above `low`. Detections that were
    renamed or ignored do not count. Only frames that see the tag make rows, so nothing is
    crossed with all tags. Detections `with_links` are taken as those of the frames.

    Returns cam, tag, frame_id, frame_ts, frame_no, present.
    """
    d = df.filter(F.col("ignore").isNull() & (F.col("tag") == F.col("raw_tag")))
    d = _with_threshold(d, thresholds, default)
    strong = F.col("prob") > F.col("_thr")
    seen = d.filter(strong | (F.col("prob") > low)).withColumn("_slice", time_bucket(FRAME_ORDER[0], HOUR))
    own = ["cam", "tag", "_slice", "frame_id", *FRAME_ORDER]
    if "prev_frame_id" in df.columns:
        # Dealt out as the windows of `held` ask for it, a frame's rows of a tag are in one place too.
        seen = seen.repartition("cam", "tag", "_slice").groupBy(*own, "prev_frame_id")
        seen = seen.agg(F.max(strong).alias("_strong"))
    else:
        linked = link_frames(frames).select("frame_id", "prev_frame_id")
        seen = seen.groupBy(*own).agg(F.max(strong).alias("_strong")).join(linked, "frame_id")
    return held(
        seen, ["cam", "tag"], FRAME_ORDER, F.col("_strong"), "frame_id", "prev_frame_id", "present"
    ).select("cam", "tag", "frame_id", *FRAME_ORDER, "present")


def _with_threshold(df: DataFrame, thresholds: DataFrame, default: float) -> DataFrame:
    """Threshold of the tag the model gave."""
    t = thresholds.select(F.col("tag").alias("_key"), F.col("min_prob").alias("_min"))
    return (
        df.join(t, F.col("raw_tag") == F.col("_key"), "left")
        .withColumn("_thr", F.coalesce(F.col("_min"), F.lit(default)))
        .drop("_key", "_min")
    )


def may_pass(
    df: DataFrame, thresholds: DataFrame, default: float, low: float = STICKY_CONFIDENCE
) -> DataFrame:
    """Raw detections that `hysteresis_filter` may keep: above their threshold or above `low`.

    The others neither pass nor make a tag present, whatever marks they get, so they need none.
    """
    least = F.min(F.coalesce("min_prob", F.lit(default))).alias("min_prob")
    own = thresholds.groupBy("tag").agg(least)  # a row of a tag with several is not repeated
    d = df.withColumn("raw_tag", F.col("tag")).transform(_with_threshold, own, default)
    return d.filter((F.col("prob") > F.col("_thr")) | (F.col("prob") > low)).select(*df.columns)


def hysteresis_filter(
    df: DataFrame,
    frames: DataFrame,
    thresholds: DataFrame,
    default: float,
    low: float = STICKY_CONFIDENCE,
) -> DataFrame:
    """Keep detections above their threshold, or above `low` if the tag was just present.

    Runs after road, region and exclusion steps (they do not depend on it); the tag the
    model gave is compared with the final tags of the camera's previous frame. Only detections
    under their threshold are looked up. Detections `with_links` are not joined with the frames.
    """
    frames = link_frames(frames)
    present = (
        tag_presence(df, frames, thresholds, default, low)
        .filter("present")
        .select(F.col("frame_id").alias("_held_frame"), F.col("tag").alias("_held_tag"))
    )
    d = _with_threshold(df, thresholds, default)
    strong = F.col("prob") > F.col("_thr")
    weak = d.filter((F.col("prob") > low) & ~strong)
    if "prev_frame_id" not in df.columns:
        weak = weak.join(frames.select("frame_id", "prev_frame_id"), "frame_id", "left")
    weak = weak.join(
        present,
        (F.col("prev_frame_id") == F.col("_held_frame")) & (F.col("raw_tag") == F.col("_held_tag")),
        "left_semi",
    )
    return d.filter(strong).select(*df.columns).unionByName(weak.select(*df.columns))


def overdue_cameras(frames: DataFrame, cameras: DataFrame, as_of) -> DataFrame:
    """Cameras whose last frame is older than their interval, or that have none."""
    newest = frames.groupBy("cam").agg(F.max("frame_ts").alias("last_ts"))
    now = F.lit(as_of).cast("timestamp")
    age = (F.unix_micros(now) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 1e6
    return (
        cameras.select("cam", "interval_s")
        .join(newest, "cam", "left")
        .filter(F.col("last_ts").isNull() | (age > F.col("interval_s")))
    )
