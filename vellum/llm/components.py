"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.scratch import materialize


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the least node reachable.

    Large-star and small-star steps in turn: each node's larger neighbours, then its
    smaller ones, are tied to the least neighbour. The edges end as stars after a
    number of rounds that grows with the logarithm of the nodes. Each round is written
    to the shared folder; only a row count and a checksum come to the driver.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == (state[0], state[1]) or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = (state[0], state[1])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(tied.unionByName(least.withColumnRenamed("m", "v")).distinct(), tag)
