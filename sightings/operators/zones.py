"""Exclusion zones and the stateless link between consecutive frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings.functions.columns import first_of
from sightings.functions.geometry import box_iou, box_meets


def apply_exclusions(df: DataFrame, excludes: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """Mark detections that overlap a zone of their camera.

    Zones for any tag ('*') come first, those of the final tag override them; the first hit
    in list order counts. Rows already ignored stay as they are. The zones of a camera for any
    tag, and those for one of its tags, travel as an array each, so the detections are not
    shuffled, and are compared with the zones of their tag alone.
    """
    zone = F.struct("ord", "tag", "box", "comment")
    listed = F.array_sort(F.collect_list(zone))
    any_tag = excludes.filter(F.col("tag") == "*").groupBy("cam").agg(listed.alias("_any"))
    own = excludes.filter(F.col("tag") != "*").groupBy("cam", F.col("tag").alias("_tag"))
    own = own.agg(listed.alias("_own")).withColumnRenamed("cam", "_cam")
    d = df.join(any_tag, "cam", "left")
    d = d.join(own, (F.col("cam") == F.col("_cam")) & (F.col("tag") == F.col("_tag")), "left")
    box = F.col("box")
    # A box with a side that is no number (NaN) is compared in full, and with a limit under 0 all are.
    d = d.withColumn("_odd", F.isnan(box["left"] + box["width"] + box["top"] + box["height"]) | F.lit(min_iou < 0))

    def overlaps(z: Column) -> Column:
        # Most zones lie apart from a box, which takes less to tell than the overlap.
        return (F.col("_odd") | box_meets(z["box"], box)) & (box_iou(z["box"], box) > min_iou)

    by_tag = F.transform(
        F.filter("_own", overlaps),
        lambda z: F.coalesce(
            z["comment"],
            F.concat(F.lit("static iou "), box_iou(z["box"], box).cast("string")),
        ),
    )
    by_any = F.transform(
        F.filter("_any", overlaps), lambda z: F.coalesce(z["comment"], F.lit("static"))
    )
    reason = F.coalesce("ignore", first_of(by_tag), first_of(by_any))
    return d.withColumn("ignore", reason).drop("_any", "_own", "_cam", "_tag", "_odd")


def frame_pairs(df: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """Pairs of one tag in consecutive frames of a camera whose boxes overlap.

    Joined on (cam, tag, frame number): a group is one frame, whatever the size of the camera.
    """
    now = df.select("cam", "tag", "frame_no", "frame_id", "det_no", "box")
    old = df.select(
        "cam",
        "tag",
        (F.col("frame_no") + 1).alias("frame_no"),
        F.col("frame_id").alias("prev_frame_id"),
        F.col("det_no").alias("prev_det_no"),
        F.col("box").alias("prev_box"),
    )
    return (
        now.join(old, ["cam", "tag", "frame_no"])
        .withColumn("iou", box_iou(F.col("prev_box"), F.col("box")))
        .filter(F.col("iou") > min_iou)
        .drop("box", "prev_box")
    )
