"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.tables import is_empty, written


def components(edges: DataFrame) -> DataFrame:
    """key and label (the smallest key that can be reached) of all ends of edges a, b.

    Each round connects the larger neighbours of every key to its smallest one,
    then the smaller ones; the rounds end when only stars are left. Smallest keys
    are partial aggregates, so a key with many edges is no large group.
    """
    e = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("u"), "v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").filter("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        e = written(small.unionByName(low.select(F.col("m").alias("u"), "v")).distinct(), "stars")
        # Stars already: each end has one centre, and no centre is an end.
        ends = e.select(F.col("v").alias("k"), F.lit(1).alias("end")).unionByName(e.select(F.col("u").alias("k"), F.lit(0).alias("end")).distinct())
        mixed = ends.groupBy("k").agg(F.sum("end").alias("ends"), F.count("*").alias("n")).filter("n > 1 and ends > 0")
        if is_empty(mixed):
            return e.select(F.col("v").alias("key"), F.col("u").alias("label")).unionByName(
                e.select(F.col("u").alias("key"), F.col("u").alias("label")).distinct()
            )
