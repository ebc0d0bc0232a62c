"""Bounded samples of labelled documents for the operators that train a model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import cut

#: Bytes of text that a sample holds at most; a text that would exceed it is left out, and so is a longer one.
MOST_BYTES = 48 << 20


def labelled(docs: DataFrame, labels: DataFrame, names: tuple[str, ...], most: int, held_out: bool = True, key: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts, and the label columns `names` as a matrix, of at most `most` rows and `most_bytes` of text, by the smallest
    hash of their id; with held_out, rows whose crc32(id as text) mod 5 is 0 are never drawn. Rows without text, id or
    a label take no part; of repeated ids one label row counts, and every text."""
    there = F.lit(True)
    for n in (key, *names):
        there = there & F.col(n).isNotNull()
    known = labels.filter(there).select(F.col(key).alias("k"), F.array(*[F.col(n).cast("int") for n in names]).alias("y"))
    if held_out:
        known = known.filter(F.crc32(F.col("k").cast("string")) % 5 != 0)
    ids = known.groupBy("k").agg(F.min("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(most)
    chosen = docs.sparkSession.createDataFrame([(k, r["k"], r["y"]) for k, r in enumerate(ids.collect())], "place int, k long, y array<int>")
    texts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    rows = cut(texts.join(F.broadcast(chosen), "k").select("place", "text", "y"))
    held, allowed = 0, set()
    for r in sorted(rows.groupBy("place").agg(F.sum(F.octet_length("text")).alias("n")).collect()):  # a row for each of `most` at most
        if held + r["n"] <= most_bytes:
            held += r["n"]
            allowed.add(r["place"])
    kept = docs.sparkSession.createDataFrame([(k,) for k in sorted(allowed)], "place int")
    found = rows.join(F.broadcast(kept), "place").toArrow().sort_by([("place", "ascending"), ("text", "ascending")])
    return found.column("text").to_pylist(), np.array(found.column("y").to_pylist(), np.int64).reshape(len(found), len(names))
