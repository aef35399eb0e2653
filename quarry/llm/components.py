"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step groups narrow rows with partial aggregation and joins two written tables, so a node with very many links is split by
Spark's skew join; nothing is gathered on the driver but two counts a round. The number of rounds grows with the logarithm of
the longest path; links that already are stars, as the operators here make them, take one round.
"""

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """links: a, b (long). Returns node, root for each node with a link to another: root is the smallest node that it reaches.
    Links with a null end and links of a node with itself count for nothing."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.save(edges, f"{name}-0")
    step = 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-m{step}")
        # large star: each larger neighbour goes to the smallest one
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, f"{name}-l{step}")
        # small star: the node and its smaller neighbours go to the smallest of them
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-s{step}")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).where("u <> v").distinct()
        small = scratch.save(small, f"{name}-{step + 1}")
        same = small.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == edges.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{step}", f"{name}-m{step}", f"{name}-l{step}", f"{name}-s{step}")
        edges, step = small, step + 1
        if same:
            break
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return scratch.save(roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), f"{name}-roots")
