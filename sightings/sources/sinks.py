"""Sinks that a retry leaves as they were: sightings by day, and tables of a stream by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_day(df: DataFrame, ts: str = "frame_ts") -> DataFrame:
    return df.withColumn("dt", F.date_format(ts, "yyyyMMdd"))


def write_sightings(df: DataFrame, path: str, mode: str = "overwrite", batch: int | None = None) -> None:
    """Write sightings to one folder per day, replacing the days that `df` holds and no others.

    With `batch`, a number that a retry repeats, the rows of that batch alone are replaced within
    their days, so a day can be filled piece by piece. `mode="append"` adds without replacing.
    Rows are rebalanced by day: small days share a task, and a busy day is split over several.
    """
    d, keys = with_day(df), ["dt"]
    if batch is not None:
        d, keys = d.withColumn("batch", F.lit(batch).cast("long")), ["dt", "batch"]
    writer = d.hint("rebalance", "dt").write.mode(mode).partitionBy(*keys)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def today(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """Sightings of the day of `as_of`; only that day's folder is read."""
    day = F.date_format(F.lit(as_of).cast("timestamp"), "yyyyMMdd")
    stored = spark.read.option("basePath", path).parquet(path)
    return stored.filter(F.col("dt").cast("string") == day)


class BatchLedger:
    """Tables that micro-batches add to, each batch once.

    A batch writes its rows to a folder of its own number, which a retry replaces, and is entered
    in the ledger when all its tables are there. Readers see entered batches only. What a batch
    hands to the next one is kept by number too, and the versions before are dropped.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def entered(self) -> int:
        """The last batch that is entered; -1 before the first. Spark numbers them one by one."""
        fs, folder = self._fs(f"{self.path}/_entered")
        if not fs.exists(folder):
            return -1
        return max((int(f.getPath().getName()) for f in fs.listStatus(folder)), default=-1)

    def write(self, table: str, rows: DataFrame, batch: int) -> DataFrame:
        """Write the batch's rows of a table, and return them as they were written."""
        place = f"{self.path}/{table}/batch={batch}"
        rows.write.mode("overwrite").parquet(place)
        return self.spark.read.schema(rows.schema).parquet(place)

    def read(self, table: str) -> DataFrame:
        """All rows of the entered batches, with `batch`."""
        place = f"{self.path}/{table}"
        return self.spark.read.option("basePath", place).parquet(place).filter(F.col("batch") <= self.entered())

    def keep(self, name: str, rows: DataFrame, batch: int) -> None:
        """Hand rows to the next batch."""
        rows.write.mode("overwrite").parquet(f"{self.path}/_kept/{name}/{batch}")

    def kept(self, name: str, schema: str, batch: int) -> DataFrame:
        """What the batch before handed over; no rows for the first."""
        place = f"{self.path}/_kept/{name}/{batch - 1}"
        fs, where = self._fs(place)
        if not fs.exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(place)

    def enter(self, batch: int) -> None:
        fs, place = self._fs(f"{self.path}/_entered/{batch}")
        fs.create(place, True).close()
        kept, folder = self._fs(f"{self.path}/_kept")
        if kept.exists(folder):
            for name in kept.listStatus(folder):
                for version in kept.listStatus(name.getPath()):
                    if int(version.getPath().getName()) < batch:
                        kept.delete(version.getPath(), True)

    def once(self, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """`write(batch, number)` for `foreachBatch`, left out for batches that are entered."""

        def run(rows: DataFrame, batch: int) -> None:
            if batch > self.entered():
                write(rows, batch)
                self.enter(batch)

        return run


def write_changes(
    changes: DataFrame, write, checkpoint: str, trigger: dict | None = None, ledger: BatchLedger | None = None
):
    """Start a stream of changes; `write(batch, number)` stores each micro-batch.

    With a ledger a batch that was entered is not written again. Spark numbers batches by the
    stream's checkpoint, so a ledger belongs to one checkpoint.
    """
    return (
        changes.writeStream.foreachBatch(ledger.once(write) if ledger else write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def store_changes(
    changes: DataFrame, spark: SparkSession, path: str, checkpoint: str, trigger: dict | None = None
) -> tuple[BatchLedger, object]:
    """Start a stream whose rows are stored once, as table `changes` of the ledger; (ledger, query)."""
    ledger = BatchLedger(spark, path)

    def write(rows: DataFrame, batch: int) -> None:
        ledger.write("changes", rows, batch)

    return ledger, write_changes(changes, write, checkpoint, trigger, ledger)
