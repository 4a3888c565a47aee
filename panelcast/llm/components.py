"""Connected components by alternating large-star and small-star steps.

Every step is one aggregation and one equi-join over the links, and its result is
written to the shared folder, so lineage stays short and a lost executor costs one
step. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common


def _finished(links: DataFrame) -> bool:
    """Whether all links run from a node, once, to one that has no link of its own.
    As links run from the greater to the lesser node, each component is then a star
    around its least node."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out")).unionAll(links.select(F.col("b").alias("node"), F.lit(0).alias("out")))
    open_nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("n")).filter("out > 1 OR out = 1 AND n > 1")
    return open_nodes.isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return moved.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes but the least of each component; ``label`` is the
    component's least node. ``links`` has two long columns a and b."""
    now = common.staged(_small_star(_large_star(links.filter("a != b").select("a", "b"))), "links", small=True)
    while not _finished(now):
        now = common.staged(_small_star(_large_star(now)), "links", small=True)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
