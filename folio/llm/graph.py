"""Connected components over a links table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import checkpoint, release


#: Parts into which a node's links are dealt when its least neighbour is joined to them.
SALTS = 16


def _to_least(links: DataFrame) -> DataFrame:
    """Large star: each node's greater neighbours are linked to the least node around it."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    salts = F.explode(F.array(*(F.lit(i) for i in range(SALTS)))).alias("salt")
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top")).where("top > u").select("u", F.least("u", "m").alias("m"), salts)
    greater = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    # a node gets the same least node from many neighbours; what is equal is folded before it is dealt by node again
    return greater.join(least, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _inward(links: DataFrame) -> DataFrame:
    """Small star: each node and its lesser neighbours are linked to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u")
    return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root, its component's least node, for every node of links (u > v) that isn't a root itself.

    Large and small stars alternate until the links stay the same; each round is checkpointed.
    """
    links = checkpoint(links)
    before = None
    while True:
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now.n:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        links = checkpoint(_inward(_to_least(links)))
        release(links.sparkSession)
