"""Look-ups by keys that very many rows share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of one key are dealt to.
SALTS = 64


def looked_up(rows: DataFrame, by: list[str], table: DataFrame) -> DataFrame:
    """The rows joined to `table`, which holds each key once. What it holds for a key goes to those parts of the key that
    have rows, and the rows of a part meet it there: no task gets all rows of one key, and no copies are made for keys
    that few rows share."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    parts = salted.select(*by, "_salt").distinct().join(table, by)
    return salted.join(parts, [*by, "_salt"]).drop("_salt")
