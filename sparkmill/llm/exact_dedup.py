"""Exact dedup: Grace hash partitioning down to open-addressing tables that compare complete content.

Each map task first folds its own rows: records are partitioned by hash to spill files, again and again with another
part of the hash, until a bucket fits `table_bytes`; the bucket then goes through an open-addressing table whose slots
compare hash, length and the complete normalised content. So a text leaves a task once, however many copies the task
held. Spark's exchange on the hash is the next level of the same partitioning, and the tasks beyond it fold what is
left. The outcome (one row per distinct text) joins the documents by SHA-256; a hot text is one row on the small side,
and adaptive execution splits the rows on the other.

Spill files live in the task's own temporary folder and vanish with the task; a lost task starts over.

A null text counts as empty, so all null and empty (or all-blank) texts are one group. Of equal texts the row with the
most code points of original text stays, ties go to the smallest doc_id (null last); rows repeated in full, id
included, are copies of each other and exactly one of them is kept. Extra columns are carried by `dedup`; `decide`
returns its own columns and those named by `carry`.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import SPACES, arrow_stage, cut, small, text_or_empty

TABLE_BYTES = 48 << 20
FAN_OUT = 16
MOST_DEPTH = 8

_DELETE = bytes(SPACES)
_NO_ID = (1 << 63) - 1
SCHEMA = "hash long, content binary, best_length long, best_id long, n_best long, n long, text_sha256 string"


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (length, id, rows): the longer, then the smaller id; rows of the same place add up."""
    if a[:2] == b[:2]:
        return (*a[:2], a[2] + b[2])
    return a if (-a[0], a[1]) < (-b[0], b[1]) else b


class OpenTable:
    """Linear probing over slots that hold an entry's number; entries keep hash, content, best row and count."""

    def __init__(self, expected: int) -> None:
        self.mask = (1 << max(4, (2 * expected).bit_length())) - 1
        self.slots = [-1] * (self.mask + 1)
        self.entries: list[list] = []

    def add(self, key: int, content: bytes, best: tuple, n: int) -> None:
        at = (key ^ key >> 32) & self.mask
        while (k := self.slots[at]) >= 0:
            e = self.entries[k]
            if e[0] == key and e[1] == content:
                e[2], e[3] = _better(e[2], best), e[3] + n
                return
            at = (at + 1) & self.mask
        self.slots[at] = len(self.entries)
        self.entries.append([key, content, best, n])
        if 2 * len(self.entries) > self.mask:
            self.grow()

    def grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for k, e in enumerate(self.entries):
            at = (e[0] ^ e[0] >> 32) & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = k


_HEAD = struct.Struct("<qIqqqq")


def _read(path: str) -> Iterator[tuple]:
    with open(path, "rb", buffering=1 << 20) as f:
        while head := f.read(_HEAD.size):
            key, size, length, doc, rows, n = _HEAD.unpack(head)
            yield key, f.read(size), (length, doc, rows), n


def fold(records: Iterable[tuple], table_bytes: int = TABLE_BYTES, fan_out: int = FAN_OUT, depth: int = 0, folder: str | None = None) -> Iterator[list]:
    """One entry [hash, content, best, n] per distinct content of (hash, content, (length, id, rows), n) records."""
    table, held = OpenTable(64), 0
    source = iter(records)
    for r in source:
        before = len(table.entries)
        table.add(*r)
        held += (len(table.entries) > before) * (len(r[1]) + 150)
        if held > table_bytes and depth < MOST_DEPTH:
            break
    else:
        yield from table.entries
        return
    with tempfile.TemporaryDirectory(prefix="grace-", dir=folder) as at:
        paths = [os.path.join(at, str(k)) for k in range(fan_out)]
        files = [open(p, "wb", buffering=1 << 16) for p in paths]
        shift = 4 * depth + 4

        def put(key: int, content: bytes, best: tuple, n: int) -> None:
            f = files[((key & (2**64 - 1)) * 0x9E3779B97F4A7C15 >> shift) % fan_out]
            f.write(_HEAD.pack(key, len(content), *best, n))
            f.write(content)

        for e in table.entries:
            put(*e)
        del table
        for r in source:
            put(*r)
        for f in files:
            f.close()
        for p in paths:
            yield from fold(_read(p), table_bytes, fan_out, depth + 1, at)
            os.unlink(p)


def _key(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)


def _emit(entries: Iterable[list], content: bool) -> Iterator[pa.RecordBatch]:
    names = ["hash", "content", "best_length", "best_id", "n_best", "n", "text_sha256"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    rows: list[list] = [[] for _ in names]
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names)

    for key, text, (length, doc, same), n in entries:
        for x, v in zip(rows, (key, text if content else None, length, None if doc == _NO_ID else doc, same, n, None if content else hashlib.sha256(text).hexdigest()), strict=True):
            x.append(v)
        held += len(text)
        if held > 8 << 20 or len(rows[0]) >= 20_000:
            yield batch()
            rows, held = [[] for _ in names], 0
    if rows[0]:
        yield batch()


def _local(table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    raw = text.as_py() or ""
                    content = raw.encode().translate(None, _DELETE)
                    yield _key(content), content, (len(raw), _NO_ID if doc is None else doc, 1), 1

        yield from _emit(fold(records(), table_bytes), True)

    return run


def _merge(table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for b in batches:
                for r in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                    yield r[0], r[1], (r[2], _NO_ID if r[3] is None else r[3], r[4]), r[5]

        yield from _emit(fold(records(), table_bytes), False)

    return run


def groups(df: DataFrame, text: str = "text", key: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct normalised text: keep_id, group_size, text_sha256."""
    local = arrow_stage(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), _local(table_bytes), SCHEMA)
    merged = arrow_stage(local.repartition("hash"), _merge(table_bytes), SCHEMA)
    return merged.select(F.col("best_id").alias("keep_id"), F.col("n").alias("group_size"), "n_best", "text_sha256")


def digest(text: str = "text"):
    return F.sha2(F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", "").cast("binary"), 256)


def decide(df: DataFrame, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = (), table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the columns named by `carry`."""
    found = cut(groups(df, text, key, table_bytes))
    rows = df.select(F.col(key).alias("_id"), digest(text).alias("text_sha256"), *[F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)])
    out = rows.join(found, "text_sha256").withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")))
    if not found.filter("n_best > 1").isEmpty():  # whole rows repeat: the first of each stays
        alone, same = out.filter("not kept or n_best = 1"), out.filter("kept and n_best > 1")
        same = cut(same.withColumn("_place", F.monotonically_increasing_id()))
        firsts = same.groupBy("text_sha256").agg(F.min("_place").alias("_place")).withColumn("_first", F.lit(True))
        out = alone.unionByName(same.join(firsts, ["text_sha256", "_place"], "left").withColumn("kept", F.coalesce("_first", F.lit(False))).drop("_place", "_first").select(*alone.columns))
    return out.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256", *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)])


def dedup(df: DataFrame, text: str = "text", key: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, with all their columns. Only ids and digests of the rows that go are joined back."""
    found = cut(groups(df, text, key, table_bytes))
    whole = df.select(F.struct("*").alias("row"), F.col(key).alias("id"), digest(text).alias("text_sha256"))
    rows = whole.select("id", "text_sha256")
    gone = rows.join(found.filter("group_size > 1"), "text_sha256").filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias("gone"), F.col("text_sha256").alias("sha")).distinct()
    out = whole.join(small(cut(gone)), (F.col("text_sha256") == F.col("sha")) & F.col("id").eqNullSafe(F.col("gone")), "left_anti")
    if not found.filter("n_best > 1").isEmpty():  # whole rows repeat
        out = out.dropDuplicates(["text_sha256"])
    return out.select("row.*")
