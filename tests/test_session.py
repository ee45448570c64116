import os
import re
import time

import pytest
from pyspark.sql import functions as F

from sightings.plans import fixtures
from sightings.plans.queries import QUERIES
from sightings.session import TASKS_PER_CORE, TIDY, checkpoint_root, cut, prepare, scope

SF = "/root/testdata/sf0.001"


def stored(spark):
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/sightings"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_a_scope_frees_what_was_written(spark):
    cut(spark.range(1))
    before = stored(spark)
    with scope(spark):
        assert QUERIES["e1_count_changes"](spark, SF).count() > 0
        assert stored(spark) > before
    assert stored(spark) == before


def test_a_cluster_must_name_its_folder():
    class Conf(dict):
        pass

    class Context:
        master = "spark://host:1"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())


def test_a_shuffle_has_some_tasks_for_each_core(spark):
    """Else a few tasks more than cores keep most cores waiting."""
    cores, before = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(16 * cores))
        rows = prepare(spark).range(1_000_000 * cores).repartition("id")
        assert rows.rdd.getNumPartitions() >= TASKS_PER_CORE * cores
        assert prepare(spark).range(100).repartition("id").rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tables_are_broadcast_by_what_they_take_in_memory(spark, tmp_path):
    """A file of repeated texts is small; the driver would gather a hash table of dozens of times its size."""
    spark.range(400_000).selectExpr(
        "id as event_id", "id as user_id", "concat('cam', id % 3) as event_type", "'off' as props"
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4m")
        wide = fixtures.load(spark, str(tmp_path), "events")
        table = cut(wide)
        many = spark.range(40_000_000).selectExpr("id as event_id", "rand() as x")
        p = many.join(table.select("event_id", "props"), "event_id")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in p, p
        few = spark.range(10_000).selectExpr("id as event_id", "'x' as x").coalesce(1)
        p = many.join(cut(few), "event_id")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in p, p
        # Text operators plan with the size of their files.
        assert float(prepare(spark).conf.get("spark.sql.sources.fileCompressionFactor")) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shuffle_files_go_when_a_table_is_written(spark):
    """Else they stay until the driver happens to collect garbage, and add up over the steps of a query."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return set(re.findall(r"shuffle_(\d+)_", blocks.getAllFiles().toString()))

    before, held = shuffled(), spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    table = cut(held)
    for _ in range(100):
        if not (shuffled() - before):
            break
        time.sleep(0.1)
    assert not (shuffled() - before)
    assert spark.conf.get(TIDY) == "false"
    # What the caller has can still be read, and again.
    assert sorted(held.collect()) == sorted(held.collect()) == sorted(table.collect())
