"""Folder of dropped image files as a source of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def read_frames_dir(
    spark: SparkSession,
    path: str,
    stream: bool = False,
    max_age: str = "5 minutes",
    as_of: Column | None = None,
) -> DataFrame:
    """Image files below `path`, with the hash of their bytes; too old ones are left out.

    The camera is the folder right below `path` that a file lies in, however deep. Batch reads compare with `as_of` (default: now),
    streams with the time of their micro-batch. The content is read only if asked for.
    """
    reader = spark.readStream if stream else spark.read
    files = (
        reader.format("binaryFile")
        .schema(BINARY_FILE)
        .option("pathGlobFilter", "*.jpg")
        .option("recursiveFileLookup", True)
        .load(path)
    )
    now = F.current_timestamp() if as_of is None else as_of
    return files.filter(F.col("modificationTime") >= now - F.expr(f"interval {max_age}")).select(
        _camera(path).alias("cam"),
        F.col("modificationTime").alias("frame_ts"),
        F.col("path").alias("source"),
        F.md5("content").alias("hash"),
        "length",
    )


def _camera(root: str) -> Column:
    """First folder of a file's address below `root`; null for files that lie in none."""
    inner = root.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    below = F.substring_index("path", inner, -1)
    return F.when(below.contains("/"), F.substring_index(below, "/", 1))


def next_files(files: DataFrame) -> DataFrame:
    """The oldest file of each camera, which a poll would take."""
    first = F.min_by(F.struct("source", "hash"), F.struct("frame_ts", "source"))
    return (
        files.groupBy("cam")
        .agg(F.min("frame_ts").alias("frame_ts"), first.alias("_f"))
        .select("cam", "frame_ts", "_f.source", "_f.hash")
    )
