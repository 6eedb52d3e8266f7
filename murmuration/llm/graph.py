"""Connected components of an edge table, without the graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node each node of ``edges(a, b)`` reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a
    grouped minimum with map-side combining and a join on the node, so hubs of
    many edges pre-aggregate and their join can be split. Lineage is cut every
    round; the driver sees a count and a checksum. Each round that changes the
    table brings nodes nearer to their least, so the rounds end. Nulls and
    loops are ignored.
    """
    now = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    # small graphs take few tasks, and so few files, between their many short shuffles
    few = max(1, now.count() // 20_000)

    def packed(df: DataFrame) -> DataFrame:
        return df.coalesce(few)

    now, seen = packed(now), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(few)
        low = packed(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")))
        # large star: every larger neighbour v of u points to u's minimum
        large = packed(packed(now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u")).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())
        # small star: u and its smaller neighbours point to the least of them
        low = packed(large.groupBy("u").agg(F.min("v").alias("low")))
        small = packed(large.join(low, "u")).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = packed(cut(packed(small.unionByName(low.select("u", F.col("low").alias("v"))).distinct())))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
