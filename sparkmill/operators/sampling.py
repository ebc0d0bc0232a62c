"""A bounded sample of any number of rows, which parts of the rows can be sampled into and merged.

Every row has a place by a hash of a seed and of what names it; the sample is the rows of the least places. So each set of
rows of the sample's size is as likely as any other, the sample of a union is the sample of its parts' samples, in
whatever order they are merged, and a task that runs again draws the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a sample for percentiles: of a rank's share p, the standard error is sqrt(p (1 - p) / SIZE), 0.8 % at most.
SIZE = 4096


def place(keys: list[str], seed: int) -> Column:
    """Where a row stands; `keys` name it, and a null key reads as no characters."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def sampled(rows: DataFrame, keys: list[str], size: int = SIZE, seed: int = 7) -> DataFrame:
    """At most `size` rows; each task passes on its own `size` least at most."""
    return rows.orderBy(place(keys, seed), *keys).limit(size)


def merged(a: DataFrame, b: DataFrame, keys: list[str], size: int = SIZE, seed: int = 7) -> DataFrame:
    """The sample of the rows of which a and b are samples."""
    return sampled(a.unionByName(b), keys, size, seed)


def percentiles(rows: DataFrame, value: str, keys: list[str], ranks: dict[str, float], size: int = SIZE, seed: int = 7) -> DataFrame:
    """One row: the values at rank round((n - 1) f) of a sample of the rows with a value, exact where there are no more
    than `size`; null without any."""
    held = sampled(rows.filter(F.col(value).isNotNull()).select(*keys, value), keys, size, seed)
    values = held.agg(F.sort_array(F.collect_list(value)).alias("v"))  # `size` values at most
    return values.select(*[F.get("v", F.round((F.size("v") - 1) * F.lit(f)).cast("int")).alias(k) for k, f in ranks.items()])
