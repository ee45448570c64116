"""Sidecar documents: one JSON text per frame, one row per prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.schema import PREDICTION, SIDECAR


def _rows(docs: DataFrame) -> DataFrame:
    """One row per prediction; a document without any keeps one row, whose `status` says why."""
    listed = F.when(F.size("predictions") > 0, F.lit("ok")).when(
        F.col("predictions").isNotNull(), F.lit("empty")
    )
    return docs.withColumn("status", listed.otherwise("unreadable")).select(
        *[c for c in docs.columns if c != "predictions"],
        "status",
        F.posexplode_outer("predictions").alias("pos", "prediction"),
    )


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Scan an archive of indented documents below `path`."""
    docs = (
        spark.read.schema(SIDECAR)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.txt")
        .json(path)
    )
    return _rows(docs.withColumn("time", F.try_to_timestamp("time")))


def parse_sidecars(docs: DataFrame, body: str = "body") -> DataFrame:
    """The same from a column of document texts."""
    d = docs.withColumn("_d", F.from_json(F.col(body), SIDECAR)).select(
        *[c for c in docs.columns if c != body], "_d.*"
    )
    return _rows(d.withColumn("time", F.try_to_timestamp("time")))


def make_sidecars(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """One document text per frame with detections."""
    have = set(detections.columns)
    fields = {
        "probability": "prob", "tagId": "tag_id", "tagName": "tag", "boundingBox": "box",
        "center": "center", "camName": "cam", "road_y": "road_y", "ignore": "ignore",
        "iou": "iou", "age": "age", "priority": "priority", "priority_type": "priority_type",
        "start_time": "start_ts", "last_time": "last_ts",
    }
    parts = []
    for name, source in fields.items():
        if source not in have:
            continue
        c = F.col(source)
        if source in ("start_ts", "last_ts"):
            c = c.cast("string")
        parts.append(c.alias(name))
    item = F.struct("det_no", F.struct(*parts).alias("p"))
    lists = detections.groupBy("frame_id").agg(F.array_sort(F.collect_list(item)).alias("_p"))
    return frames.join(lists, "frame_id").select(
        "frame_id",
        F.to_json(
            F.struct(
                F.col("source"),
                F.col("frame_ts").cast("string").alias("time"),
                F.transform("_p", lambda x: x["p"]).alias("predictions"),
            )
        ).alias("body"),
    )


__all__ = ["PREDICTION", "make_sidecars", "parse_sidecars", "read_sidecars"]
