"""Source order and the categories of rejected records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.operators.ordering import positions

RESERVED = ("generated", "judge", "_meta")


def admit(df: DataFrame) -> DataFrame:
    """Refuses inputs that hold a reserved column."""
    clash = [c for c in df.columns if c in RESERVED]
    if clash:
        raise ValueError(f"reserved fields in the input: {', '.join(clash)}")
    return df


def reserved(keys: Column) -> Column:
    """Whether the names of an object's fields hold a reserved one."""
    return F.arrays_overlap(keys, F.array(*map(F.lit, RESERVED)))


def with_position(df: DataFrame, *order: str) -> DataFrame:
    """1-based positions in the order of the columns that name a row."""
    return positions(admit(df), list(order))


def judge_failure(score: Column, least: float) -> Column:
    return F.when(score.isNull(), "judge_output").when(score < least, "judge_score")


def judge_category(score: Column, least: float) -> Column:
    return F.coalesce(judge_failure(score, least), F.lit("accepted"))
