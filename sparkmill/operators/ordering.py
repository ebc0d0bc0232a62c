"""Positions and running totals over an order, without a window that gathers all rows in one task.

Keys alone are range-partitioned, sorted and checkpointed (so that both passes over them see the same partitions); one
sum for each partition, an ordered sum over those few rows, and what is left is a sum within each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.operators.checkpoints import cut

_PLACE = (1 << 33) - 1


def running_total(df: DataFrame, order: list[str], amount: Column | None = None) -> DataFrame:
    """The columns of `order`, `amount` (1 where none is given) and `upto`, the sum of it up to and with each row. Rows
    of equal order are summed in any order."""
    one = amount is None
    keys = df.select(*order, (F.lit(1) if one else amount).cast("long").alias("amount"))
    ids = F.monotonically_increasing_id()
    ranged = cut(keys.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(ids, 33).cast("int").alias("part"), ids.bitwiseAND(F.lit(_PLACE)).alias("place")))
    parts = ranged.groupBy("part").agg(F.sum("amount").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row per partition
    within = F.col("place") + 1 if one else F.sum("amount").over(Window.partitionBy("part").orderBy("place"))
    return ranged.withColumn("within", within).join(F.broadcast(before), "part").select(*order, "amount", (F.col("before") + F.col("within")).alias("upto"))


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` with `position`, 1-based in the order of columns that name a row. Rows keep their partitions until they meet
    their positions, so that a column which nothing reads later is never read or moved."""
    return df.join(running_total(df, order).select(*order, F.col("upto").alias("position")), order)
