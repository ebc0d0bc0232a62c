"""Helpers that the training-data operators share: packed Arrow text, vectorised word hashes, checkpoints."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SPACES = b" \t\n\x0b\x0c\r"
WS_REGEX = r"[\x20\x09-\x0D]+"
WORD_REGEX = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def session_paths(spark: SparkSession) -> None:
    """Sets a checkpoint folder where the cluster names none (as in tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkmill-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    session_paths(df.sparkSession)
    return df.checkpoint(eager=True)


def packed_in(rows: int, each: int = 20_000) -> int:
    """Partitions for so many short rows: a stage of few rows then leaves few files, whatever the shuffle's partitions."""
    return max(8, -(-rows // each))


#: Rows of ids or digests that are broadcast at most (some 20 to 100 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 200_000


def small(df: DataFrame, most: int = MOST_BROADCAST, weight: Column | None = None) -> DataFrame:
    """A checkpointed table with a broadcast hint where its rows (or the sum of their weights) are few enough."""
    n = df.count() if weight is None else df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= most else df


#: Bytes of an Arrow batch of texts, at most (or one row): what a task holds of it, on both sides, is a few times that.
BATCH_BYTES = 4 << 20
_HELD: list = []


def held_by_worker(maxsize: int) -> Callable:
    """A cache of what one operator's tasks use again; a Python worker drops it when a task of another operator comes."""

    def cached(make: Callable):
        found = lru_cache(maxsize)(make)
        _HELD.append(found)
        return found

    return cached


def drop_others(module: str) -> None:
    for found in _HELD:
        if found.__module__ != module:
            found.cache_clear()


def arrow_stage(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`run` over Arrow batches of bounded bytes, however long the texts are; the session keeps a lower bound of its own."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    own = re.fullmatch(r"(\d+)([kmgtp]?)b?", conf.get(name).strip().lower())
    if not own or not 0 < int(own[1]) << 10 * " kmgtp".index(own[2] or " ") <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(released(run), schema)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same stage, which gives what its task held back to the system at its end: workers live on for other stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(run.__module__)
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # a C library without it
                pass

    return wrapped


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def packed(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer row has a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


#: Longer units are hashed one by one; a text of n bytes holds n / LONG of them at most.
LONG = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U64)


def unit_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int = 1) -> list[np.ndarray]:
    """Hashes of the byte runs data[start:end], 64 bits for each of up to two lanes that share no constants.

    A run is taken in words of eight bytes, each mixed into what came before it (no polynomial, so no family of texts
    collides by its form); of equal length up to eight bytes no two runs collide.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    window = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded.data, strides=(1,))
    size = ends - starts
    out = [mix(size.astype(U64) * U64(c)) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[:lanes]]
    own, at, rest = np.flatnonzero((size > 0) & (size <= LONG)), None, None
    at, rest = starts[own], size[own]
    while len(own):
        chunk = window[at] & _MASKS[np.minimum(rest, 8)]
        out[0][own] = mix(out[0][own] ^ chunk)
        if lanes > 1:
            out[1][own] = mix((out[1][own] + chunk) * U64(0xA0761D6478BD642F))
        more = rest > 8
        own, at, rest = own[more], at[more] + 8, rest[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=16).digest()
        for lane in range(lanes):
            out[lane][k] = int.from_bytes(digest[8 * lane : 8 * lane + 8], "little")
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each word (a run of bytes other than ASCII white space) of the packed rows."""
    n = len(data)
    if n == 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    inside = ~_IS_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (first[:n] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets))), starts, ends


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of each word of the packed rows."""
    row, starts, ends = word_spans(data, offsets)
    (hashes,) = unit_hashes(_LOWER[data] if lower else data, starts, ends)
    return hashes, row, starts, ends


_WINDOW = (0x9FB21C651E98DF25, 0xD1B54A32D192ED03)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, lanes: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct windows of `width` words of each packed row, A-Z lowered: where each row's begin (one more entry
    than rows), and the hashes of each lane, sorted by the first lane within a row. Fewer words are one window."""
    n = len(offsets) - 1
    row, starts, ends = word_spans(data, offsets)
    hashes = unit_hashes(_LOWER[data], starts, ends, lanes)
    edges = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(edges)
    windows = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    begins = np.concatenate(([0], np.cumsum(windows)))
    doc = np.repeat(np.arange(n), windows)
    place = np.arange(begins[-1]) - begins[doc] + edges[doc]
    size = np.minimum(count, width)[doc]
    found = [mix(size.astype(U64) * U64(c)) for c in _WINDOW[:lanes]]
    full = bool((size == width).all())
    for k in range(width):
        own = slice(None) if full else np.flatnonzero(size > k)
        for lane in range(lanes):
            found[lane][own] = mix(found[lane][own] * U64(_WINDOW[lane]) + hashes[lane][place[own] + k])
    if lanes == 1:
        only = found[0]
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            only[a:b].sort()
    else:
        edge = begins.tolist()
        order = np.concatenate([np.zeros(0, np.int64), *[found[0][a:b].argsort() + a for a, b in zip(edge[:-1], edge[1:], strict=True)]])
        found = [x[order] for x in found]
        tie = (found[0][1:] == found[0][:-1]) & (doc[1:] == doc[:-1])
        if (found[1][1:] != found[1][:-1])[tie].any():
            order = np.lexsort((found[1], found[0], doc))
            found = [x[order] for x in found]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = doc[1:] != doc[:-1]
    for x in found:
        fresh[1:] |= x[1:] != x[:-1]
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return kept[begins], [x[fresh] for x in found]


def same_bytes(data: np.ndarray, starts: np.ndarray, other: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether data[start:start + size] equals other[at:at + size], for each of many runs."""
    begins = np.cumsum(sizes) - sizes
    step = np.arange(int(sizes.sum()))
    unlike = data[step + np.repeat(starts - begins, sizes)] != other[step + np.repeat(at - begins, sizes)]
    out = np.ones(len(sizes), bool)
    if unlike.any():
        out[np.searchsorted(begins + sizes, np.flatnonzero(unlike), side="right")] = False
    return out


class UnitStore:
    """Ids of text units in sorted numpy arrays: lookups and output are vectorised.

    Units are found by a 64-bit hash, and every hit is compared byte by byte; a unit whose hash another one holds is
    encoded whenever it comes. `encode` maps a list of units to lists of ids. The store holds at most `most` units and
    `most_bytes` of their text and starts anew beyond that.
    """

    def __init__(self, encode, most: int = 1_000_000, most_bytes: int = 32 << 20) -> None:
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self.clear()

    def clear(self) -> None:
        none = (np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(4)))  # hash; place, number of ids; place, size of the text
        self.main, self.recent = none, none
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.texts, self.filled = np.zeros(1 << 16, np.uint8), 0

    @staticmethod
    def _grown(pool: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        while used + len(more) > len(pool):
            pool = np.concatenate((pool, np.zeros(len(pool), pool.dtype)))
        pool[used : used + len(more)] = more
        return pool

    def _put(self, ids: list) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.pool = self._grown(self.pool, self.used, np.fromiter((x for i in ids for x in i), np.uint32, int(sizes.sum())))
        places = self.used + np.cumsum(sizes) - sizes
        self.used += int(sizes.sum())
        return places, sizes

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        order = np.argsort(np.concatenate((a[0], b[0])), kind="stable")
        return tuple(np.concatenate((x, y))[order] for x, y in zip(a, b, strict=True))

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units one after the other, and how many each unit has."""
        if len(self.main[0]) + len(self.recent[0]) > self.most or self.filled > self.most_bytes:
            self.clear()
        sizes = ends - starts
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        taken = np.zeros(len(keys), bool)  # another unit holds the hash
        for level in (self.main, self.recent):
            if len(level[0]):
                k = np.minimum(np.searchsorted(level[0], keys), len(level[0]) - 1)
                hit = np.flatnonzero(level[0][k] == keys)
                own, k = first[hit], k[hit]
                same = level[4][k] == sizes[own]
                same[same] = same_bytes(data, starts[own[same]], self.texts, level[3][k[same]], sizes[own[same]])
                at[hit[same]], count[hit[same]] = level[1][k[same]], level[2][k[same]]
                taken[hit[~same]] = True
        raw = None

        def encoded(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            nonlocal raw
            raw = data.tobytes() if raw is None else raw
            return self._put(self.encode([raw[a:b].decode() for a, b in zip(starts[units].tolist(), ends[units].tolist(), strict=True)]))

        lost = np.flatnonzero((at < 0) & ~taken)
        if len(lost):
            at[lost], count[lost] = encoded(first[lost])
            text = np.concatenate([data[a:b] for a, b in zip(starts[first[lost]].tolist(), ends[first[lost]].tolist(), strict=True)])
            self.texts = self._grown(self.texts, self.filled, text)
            width = sizes[first[lost]]
            self.recent = self._merged(self.recent, (keys[lost], at[lost], count[lost], self.filled + np.cumsum(width) - width, width))
            self.filled += len(text)
            if 4 * len(self.recent[0]) > len(self.main[0]):
                self.main, self.recent = self._merged(self.main, self.recent), tuple(x[:0] for x in self.recent)
        at, count = at[back], count[back]
        own = first[back]
        odd = taken[back] | (sizes != sizes[own])
        like = np.flatnonzero(~odd & (own != np.arange(len(own))))
        odd[like] = ~same_bytes(data, starts[like], data, starts[own[like]], sizes[like])
        odd = np.flatnonzero(odd)
        if len(odd):
            at[odd], count[odd] = encoded(odd)
        begins = np.cumsum(count) - count
        return self.pool[np.arange(int(count.sum())) + np.repeat(at - begins, count)], count
