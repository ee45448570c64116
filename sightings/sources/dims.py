"""Loaders of the configuration files: zones, plates, labels.

These files describe one installation (zones of its cameras, its known plates) and are read
as whole documents; everything after the read is distributed like any other table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ZONE = "struct<left:double,top:double,width:double,height:double,comment:string>"
_PLATE = "struct<owner:string,color:string,make:string,model:string,announce:boolean>"


def parse_excludes(docs: DataFrame, body: str = "value") -> DataFrame:
    """`{camera: {tag or "*": [zone, ...]}}` to one row per zone, in list order."""
    m = F.from_json(F.col(body), f"map<string,map<string,array<{_ZONE}>>>")
    d = docs.select(F.explode(m).alias("cam", "_tags"))
    d = d.select("cam", F.explode("_tags").alias("tag", "_zones"))
    d = d.select("cam", "tag", F.posexplode("_zones").alias("ord", "_z"))
    z = F.col("_z")
    box = F.struct(*[z[c].alias(c) for c in ("left", "top", "width", "height")])
    return d.select("cam", "tag", "ord", box.alias("box"), z["comment"].alias("comment"))


def parse_known_plates(docs: DataFrame, body: str = "value") -> DataFrame:
    """`{plate: {owner?, color?, make?, model?, announce?}}`, numbered in file order.

    An unreadable document gives no rows.
    """
    m = F.from_json(F.col(body), f"map<string,{_PLATE}>")
    d = docs.select(F.posexplode(F.map_entries(m)).alias("ord", "_e"))
    return d.select(F.col("_e")["key"].alias("plate"), "ord", "_e.value.*").withColumn(
        "announce", F.coalesce("announce", F.lit(True))
    )


def load_excludes(spark: SparkSession, path: str) -> DataFrame:
    return parse_excludes(spark.read.text(path, wholetext=True))


def load_known_plates(spark: SparkSession, path: str) -> DataFrame:
    """Known plates; a missing file is an empty table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    docs = (
        spark.read.text(path, wholetext=True)
        if there
        else spark.createDataFrame([], "value string")
    )
    return parse_known_plates(docs)


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """One label per line; its id is the number of the line, from 0."""
    docs = spark.read.text(path, wholetext=True)
    text = F.regexp_replace("value", r"\n$", "")
    d = docs.select(F.posexplode(F.split(text, "\n")).alias("tag_id", "tag"))
    return d.withColumn("tag", F.trim(F.regexp_replace("tag", "\r", "")))
