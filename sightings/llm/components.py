"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightings.session import settle

#: Links that a task takes at least, where there are more tasks than cores.
TASK_LINKS = 200_000


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of `links` (long columns a, b): root is the component's least node.

    Alternates two steps until nothing changes. The large star links a node's larger neighbours
    to its least one, the small star the smaller ones. Both keep components, and rounds grow
    with the logarithm of the nodes. A node's neighbours never meet in one task: their least is
    an aggregate, and the join that hands it out can be split where a node has many.

    Each round has a dozen shuffles, whose files stay for a while. They have as many tasks as cores,
    or as links need, and not as many as the session's shuffles, which are set for whole texts.
    Links are counted first, so they are best a written table.
    """
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, math.ceil(links.count() / TASK_LINKS))

    def star(both: DataFrame, larger: bool) -> DataFrame:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        side = F.col("b") > F.col("a") if larger else F.col("b") <= F.col("a")
        out = both.join(least, "a").filter(side).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not larger:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").coalesce(tasks).distinct().coalesce(tasks)

    def mirrored(d: DataFrame) -> DataFrame:
        return d.unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)

    d = settle(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .coalesce(tasks)
        .distinct()
        .coalesce(tasks)
    )
    said = None
    while True:
        large = star(mirrored(d), True)
        # After the large star each link goes from a larger node to a smaller one.
        d = settle(star(large, False))
        # A sum of digests of all links, the same only when the links are.
        now = d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == said:
            break
        said = now
    roots = d.select(F.col("b").alias("node")).distinct()
    return d.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
