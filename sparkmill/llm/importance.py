"""Importance resampling towards a target distribution, over hashed runs of words.

The UTF-8 bytes of an Arrow column are one array. A table of 256 entries says which bytes belong to words; where that
changes, words begin and end. The CRC-32 of all words advances together, a byte at a time, by the usual table of 256
entries; the few words that outlast LONG bytes go on in zlib from the state they have reached. A run of k + 1 words goes
on from the state of the run of k: a space, then the next word's bytes.

Counts of buckets are summed within tasks first; the model is two lists of `buckets` numbers, whatever the input. A
document's weight is the sum of its buckets' gains; Gumbel noise by the document's id makes the highest scores a draw
without replacement in proportion to exp(weight / 1000). Places come from a range partition, never from one task.

A null text has no words: weight 0. A null id reads as no characters in the noise, and sorts before all others in ties;
rows repeated in full are scored and drawn one by one, in any order among them. Without a target text, or without
documents, all counts are 0 and every gain is the same. An empty table gives an empty result. Extra columns take no part,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import blocks, cut, packed, released
from sparkmill.operators.ordering import running_total

#: Bytes of a word that advance with those of all others; what is beyond goes through zlib.
LONG = 48
#: Bytes of texts that are worked on together.
STEP = 1 << 21
_POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, row >> 1 ^ np.uint32(_POLYNOMIAL), row >> 1).astype(np.uint32)
    return row


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words once A-Z are lowered (digits, letters, all beyond ASCII), and the lowering."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[128:] = True
    return inside[lower], lower


_CRC = _crc_table()
_INSIDE, _LOWER = _word_table()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of packed rows, and the first word of each row (one more entry than rows)."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[:-1] = _INSIDE[data]
    change = np.diff(inside, prepend=np.int8(0))
    starts, ends = change == 1, change == -1
    # Where one row ends in a word and the next begins with one, nothing changes.
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    both = edge[(inside[edge] == 1) & (inside[edge - 1] == 1)]
    starts[both] = ends[both] = True
    begins = np.flatnonzero(starts)
    return begins, np.flatnonzero(ends), np.searchsorted(begins, offsets)


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC states (not inverted) after the bytes data[start:end] of each run."""
    state = state.copy()
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, own = starts[order], state[order]
    longest = int(size.max(initial=0))
    # Runs in falling length: those with a k-th byte are the first ones.
    more = np.searchsorted(-size[order], -np.arange(1, min(longest, LONG) + 1), side="right")
    for k, n in enumerate(more.tolist()):
        own[:n] = _CRC[(own[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ own[:n] >> np.uint32(8)
    state[order] = own
    for k in np.flatnonzero(size > LONG).tolist():
        state[k] = zlib.crc32(data[starts[k] + LONG : ends[k]].tobytes(), int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def features(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The CRC-32 and row of each run of 1 to `width` consecutive words, joined by a space, and the words of each row."""
    data = _LOWER[data]
    starts, ends, first = words(data, offsets)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    state = advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, ends)
    found, rows = [state], [row]
    own = np.arange(len(row))  # the words that a run starts at
    for k in range(1, width):
        on = np.flatnonzero(row[np.minimum(own + k, len(row) - 1)] == row[own]) if len(own) else own
        on = on[own[on] + k < len(row)]
        own, state = own[on], state[on]
        state = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ state >> np.uint32(8)
        state = advance(state, data, starts[own + k], ends[own + k])
        found.append(state)
        rows.append(row[own])
    return np.concatenate(found) ^ np.uint32(0xFFFFFFFF), np.concatenate(rows), count


def _lots(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in batches:
        data, offsets = packed(b.column(column))
        for first, last in blocks(offsets, STEP):
            yield b.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


def bucket_counts(texts: DataFrame, buckets: int, width: int = 1, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket: a sum over one list of `buckets` numbers a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, data, offsets in _lots(batches, 0):
            total += np.bincount(features(data, offsets, width)[0] % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    found = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(released(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the log of the target's smoothed share over the source's, rounded down."""
    n = len(source)
    above = (target + 1).astype(float) * float(int(source.sum()) + n)
    below = (source + 1).astype(float) * float(int(target.sum()) + n)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, width: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_features and weight of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for rows, data, offsets in _lots(batches, 1):
            found, row, count = features(data, offsets, width)
            own = gain[found % np.uint32(len(gain))]
            if width > 1:  # the runs of one length come before those of the next
                order = np.argsort(row, kind="stable")
                own, row = own[order], row[order]
            edge = np.searchsorted(row, np.arange(len(rows) + 1))
            total = np.concatenate(([0], np.cumsum(own)))[edge]
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, (count, np.diff(edge), np.diff(total)))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(released(run), "doc_id long, n_words long, n_features long, weight long")


def _noise(seed: int):
    """Gumbel noise in thousandths, by the id: the first 32 bits of a SHA-256 as a place between 0 and 1."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, width: int = 1, percent: int = 10, least_words: int = 20, seed: int = 2024, text: str = "text", key: str = "doc_id", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; the rank is null where the document is not drawn."""
    gain = gains(bucket_counts(docs, buckets, width, text), bucket_counts(target, buckets, width, target_text))
    scored = weighted(docs, gain, width, text, key).withColumn("score", F.col("weight") + _noise(seed))
    scored = cut(scored.select((F.col("n_words") < least_words).alias("short"), (-F.col("score")).alias("behind"), "doc_id", "n_features", "weight", "score"))
    drawn = scored.filter("NOT short").count() * percent // 100
    placed = running_total(scored, scored.columns)
    rank = F.when(~F.col("short") & (F.col("upto") <= drawn), F.col("upto"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
