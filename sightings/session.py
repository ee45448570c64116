"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Tasks of a shuffle for each core, if they have a megabyte each.
TASKS_PER_CORE = 3

#: Bytes that a row takes in the hash table of a broadcast for each byte that the planner sees in a file.
#: Repeated texts take nearly none there, and 20 of them count as read; a narrow row in a hash table takes 55.
PACKED = 20

#: With this, Spark deletes the shuffle files of an execution at its end, and not when the driver happens to collect garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession, packed: float = 1.0) -> SparkSession:
    """Set the run-time options every operator relies on.

    `packed`: how many times the size of its files a table is planned with. Where files say little
    of what rows take in memory, the driver would gather broadcasts of any size.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(float(packed)))
    # Rows may hold long texts: batches for Python are bounded by their bytes, not by rows alone.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    # Shuffles of any size would else become about as many tasks as cores, and a few more than those
    # leave most cores idle in a second wave.
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionNum", tasks)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sightings-"), "sightings.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    A temporary folder of the driver's machine serves only where executors are on it too; on a
    cluster the missing setting is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    root = root or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sightings-")
    return root


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_root(spark))
    return sc.getCheckpointDir()


_written: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables and files that operators write inside are deleted at the end, so use up the results before.

    Without a scope they stay until the folder of the application is removed. Checkpoints go
    with spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    _written.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for p in _written.pop():
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def written(path: str) -> str:
    """Enter a folder that the open scope, if there is one, deletes at its end."""
    if _written:
        _written[-1].append(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """The same for a summary that a loop rewrites: a reliable checkpoint, which starts faster."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and read it back.

    A lost executor then replays no more than the step at hand, later steps read only the
    columns they need, and the planner knows the real size of the table. Shuffle files that
    served to make it are deleted.
    """
    spark = df.sparkSession
    path = written(f"{_folder(spark)}/sightings/{uuid.uuid4().hex}")
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        # A frame made now; of one that the caller has, files may be read again.
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)
