"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.session import materialize


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, label)`` of every node of a link; the label is the smallest node of its component.

    Alternates large-star and small-star steps: every node links its larger (its smaller) neighbours to the
    smallest one it knows, until the links are stars.  Each step is one shuffle of a table that
    never holds more rows than there are links, and every second state is stored in the shared folder.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u <> v")
    count = links.count()
    lowest = F.min("v").over(Window.partitionBy("u"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", lowest)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", lowest).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.filter("u <> v"), "stars", count)
        # Done when the links are stars: every node has one smaller node or is a centre.
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("bigint").alias("up")))
        roles = ends.groupBy("node").agg(F.min("up").alias("a"), F.max("up").alias("b"), F.count_if(F.col("up").isNull()).alias("downs"))
        if not roles.filter("a <> b OR (a IS NOT NULL AND downs > 0)").count():
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
