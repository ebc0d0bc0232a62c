"""Failure policies over source order, and sliding windows of the rate limiter's kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.operators.ordering import running_total


def allowed(errors) -> int | None:
    """Rejections that a run survives; None without a policy that stops it on the way."""
    return 0 if errors.strict else errors.max_failed_records


def violated(errors, good: int, bad: int, final: bool) -> str | None:
    """The policy that the counts break. Shares, and that not all may be rejected, count at the end alone."""
    most, total = allowed(errors), good + bad
    if most is not None and bad > most:
        return "strict" if errors.strict else "max_failed_records"
    if not final or not total:
        return None
    if not good:
        return "all_rejected"
    return "max_failed_ratio" if errors.max_failed_ratio is not None and bad / total > errors.max_failed_ratio else None


def cut_at(df: DataFrame, bad: str, most: int) -> DataFrame:
    """Rows up to and with the one whose rejection is one too many. The violating row is the (most + 1)-th rejection,
    so a top-k over the rejections finds it; no running sum over all rows is needed."""
    nth = df.filter(F.col(bad) > 0).select("position").orderBy("position").limit(most + 1)
    edge = nth.agg(F.when(F.count(F.lit(1)) > most, F.max("position")).alias("edge"))
    return df.join(F.broadcast(edge), F.col("edge").isNull() | (F.col("position") <= F.col("edge"))).drop("edge")  # one row


def budget_edge(rows: DataFrame, room: int) -> int | None:
    """The first position that needs room for a key when `room` keys are held; rows (position, good) are unique ones, and
    the good ones keep their key. A running total is made only where the rows may exceed the room."""
    if rows.count() <= room:
        return None
    held = running_total(rows.select("position", F.col("good").cast("long").alias("good")), ["position"], F.col("good"))
    return held.filter(F.col("upto") - F.col("amount") >= room).agg(F.min("position").alias("p")).first()["p"]


def final(df: DataFrame, bad: str, ratio: float) -> DataFrame:
    total, rejected = F.count(F.lit(1)), F.coalesce(F.sum(bad), F.lit(0)).cast("long")
    return df.agg(total.alias("total"), rejected.alias("rejected")).select("total", "rejected", (F.col("rejected") / F.col("total") > ratio).alias("violated"), ((F.col("total") > 0) & (F.col("rejected") == F.col("total"))).alias("all_rejected"))


def rate_window(df: DataFrame, key: str, ts: str, amount: str, seconds: int = 60) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumns({"requests": F.count(F.lit(1)).over(w), "amount": F.round(F.sum(amount).over(w), 4)})
