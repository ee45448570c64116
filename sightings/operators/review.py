"""Flag requests and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightings.functions.text import base_name, strip_extension, underscored
from sightings.operators.ordered import as_of

# Models and tags a flag stands for.
VEHICLE_FLAG, VEHICLE_MODEL, VEHICLE_TAGS = "flag_vehicle", "vehicle", "vehicle,package"
OTHER_MODEL = "detection"


def parse_flag_topic(flags: DataFrame, root: str, topic: str = "topic") -> DataFrame:
    """Requests on `{root}/{camera}/{flag}/set`; other topics are dropped."""
    parts = F.split(F.col(topic), "/")
    return (
        flags.withColumn("_p", parts)
        .filter(
            (F.size("_p") == 4)
            & (F.get("_p", F.lit(0)) == root)
            & (F.get("_p", F.lit(3)) == "set")
        )
        .withColumn("cam_key", F.get("_p", F.lit(1)))
        .withColumn("flag_type", F.get("_p", F.lit(2)))
        .drop("_p")
    )


def flags_to_frames(
    flags: DataFrame, frames: DataFrame, cameras: DataFrame, root: str = "sightings"
) -> DataFrame:
    """Latest frame of the flagged camera at the time of each request.

    flags: ts, topic. Adds cam, flag_type, model, tags, frame_id and status: `ok`,
    `unknown camera` or `no image`.
    """
    named = cameras.select(
        "cam",
        underscored("cam").alias("cam_key"),
        F.array_join(F.array_sort(F.array_remove("publish", "")), ",").alias("_published"),
    )
    d = parse_flag_topic(flags, root).join(named, "cam_key", "left")
    d = as_of(d, frames, ["cam"], "ts", ["frame_id"], "frame_ts", tie=["frame_no"])
    vehicle = F.col("flag_type") == VEHICLE_FLAG
    return d.select(
        *[F.col(c) for c in flags.columns],
        "cam",
        "flag_type",
        F.when(vehicle, F.lit(VEHICLE_MODEL)).otherwise(F.lit(OTHER_MODEL)).alias("model"),
        F.when(vehicle, F.lit(VEHICLE_TAGS)).otherwise(F.col("_published")).alias("tags"),
        "frame_id",
        F.when(F.col("cam").isNull(), "unknown camera")
        .when(F.col("frame_id").isNull(), "no image")
        .otherwise("ok")
        .alias("status"),
    )


def route_review(flags: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """Where each flagged file goes: one row per project that covers one of its tags.

    flags: file, tags (comma list) and more; files: file; projects: project_id, classes.
    Status 404 = no such file, 400 = no project, ready = one row per project. Tags and
    classes meet in an equi-join, so nothing is crossed; flags are read once. A flag that
    repeats in all its columns is routed once.
    """
    named = flags.withColumn("file", base_name("file"))
    here = files.select(base_name("file").alias("file")).distinct().withColumn("_here", F.lit(True))
    d = named.join(here, "file", "left").withColumn("_here", F.coalesce("_here", F.lit(False)))
    wanted = F.array_distinct(F.filter(F.split("tags", ","), lambda t: t != ""))
    classes = projects.select("project_id", F.explode("classes").alias("_tag"))
    found = (
        d.withColumn("_tag", F.explode_outer(F.when(F.col("_here"), wanted)))
        .join(classes, "_tag", "left")
        .groupBy(*named.columns, "_here")
        .agg(F.array_sort(F.collect_set("project_id")).alias("_projects"))
    )
    none = F.size("_projects") == 0
    status = F.when(~F.col("_here"), "404").when(none, "400").otherwise("ready")
    return found.select(
        *named.columns, status.alias("status"), F.explode_outer("_projects").alias("project_id")
    )


def review_queue(flags: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """Routed flags with the upload name and tags. flags: file, model, cam, tags."""
    return route_review(flags, files, projects).select(
        "file",
        "status",
        "project_id",
        strip_extension("file").alias("name"),
        F.concat_ws(",", underscored("cam"), underscored("model")).alias("upload_tags"),
    )
