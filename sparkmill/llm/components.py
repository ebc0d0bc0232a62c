"""Connected components of an edge table, in Spark: large-star and small-star rounds over checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import cut, packed_in


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b), of any type with an order; the component is its smallest node.

    Every round links each node's neighbours to the smallest among them, so a star grows around the smallest node of a
    component; hubs are aggregated before they are joined back, never gathered into one row. Rounds go on until one changes
    nothing; every round lowers some node's least neighbour, so they end.
    """
    pairs = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rows = pairs.count()
    if not rows:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        parts = packed_in(rows)
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(parts)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(parts)
        small_m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_m, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        pairs = cut(small.filter("a <> b").coalesce(parts).distinct().coalesce(parts))
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).coalesce(parts)
        before, rows = now, now[0]
