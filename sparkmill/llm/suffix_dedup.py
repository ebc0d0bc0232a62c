"""Suffix-array dedup: strings of `length` bytes that start more than once, by longest-previous-factor arrays.

A suffix array of the whole corpus has no place to stand, so suffixes are first dealt to small groups that no match
crosses. Every window of `length` bytes has an anchor, the least hash of its GRAM-byte strings, which depends on the
window's bytes alone: equal windows have equal anchors at equal places. Anchors that occur once go. The windows that an
anchor stands for are cut into chunks; a chunk's windows share a core, and (place, core) is the group. Common strings
that stand in many different texts so fall into many groups, and a group holds only windows that agree on their core.

Within a group the suffixes of its segments are sorted, equal segments with their multiplicity. Of the positions in
suffix order, the previous and the next smaller give the longest earlier match of every suffix (LPF), the previous and
next larger ones the longest later match (LNF). `keep="first"` removes what an earlier copy covers (LPF >= length);
`keep="none"` what any other copy covers. Nothing is removed that these arrays do not report.

Anchors that repeat within a task are known there. Segments that a task holds at several places run their factors in
it, and one place of each goes to where its group meets, so a string that a third of all texts hold reaches that task
once for each task of the stage before.

Whole texts move twice, to where their repeated anchors and where their covered bytes are. Only those move that a
broadcast bitmap of the keys in question lets pass; false positives cost, and lose nothing.

Texts are UTF-8 bytes; null is empty; no match crosses texts. Equal texts (repeated rows, too) are one text with a
count, known by 128 bits of SHA-256; windows are compared by their bytes. All segments of such a text stand in their
groups twice, for the smallest doc_id's row and for the others, so all of each that is long enough is covered (with
keep="first", of all but the smallest doc_id's). Lists gathered per text are bounded by that
text's length. Extra columns take no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.llm.common import U64, blocks, cut, mix, packed, released, text_or_empty

LENGTH = 400
GRAM = 32
CHUNK = 192
#: Anchors, and bytes of different segments, that a task holds to find those that repeat in it.
HELD_ANCHORS = 2_000_000
HELD_BYTES = 64 << 20
#: Segments of small groups whose suffixes are sorted together; a larger group is sorted by itself.
MOST_MEMBERS = 4096
#: Longs of a bitmap of keys: eight bits a key, and so many at most (16 MB broadcast); beyond, more texts pass.
MOST_WORDS = 1 << 20


#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 20)
        pair = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, U64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        have = (pair[0], pair[1])
        if size <= 1 << 22:
            _POWERS[0] = have
    return have[0][:n], have[1][:n]


def rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums P and inverse powers so that (P[j] - P[i]) * inv[i] hashes data[i:j]; it picks anchors, and texts are compared by their bytes."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[data] * up[:-1], out=sums[1:])
    return sums, down


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, anchor, first and last window start (all within the packed bytes) and anchor hash of each run of windows."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    n, width = len(data), length - gram + 1
    if n < length:
        return none
    sums, down = rolling(data)
    grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    m = len(grams)
    value = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(m, dtype=np.uint64)  # the leftmost of equal hashes
    rows = -(-m // width)
    grid = np.full(rows * width, np.uint64(2**64 - 1))
    grid[:m] = value
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    least = np.minimum(ahead[: m - width + 1], behind[width - 1 : m])
    where = (least & np.uint64(2**32 - 1)).astype(np.int64)
    sizes = np.maximum(0, np.diff(offsets) - length + 1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(row)) + np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes)
    if not len(start):
        return none
    own = where[start]
    begins = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (row[1:] != row[:-1]))))
    ends = np.append(begins[1:], len(own)) - 1
    return row[begins], own[begins], start[begins], start[ends], grams[own[begins]].astype(np.int64)


def _anchor_rows(length: int):
    """Runs of windows by anchor. `state` is 0 for anchors that the task met at one place alone; those met at more are
    dealt by a salt above 0, and one of them goes along with state -1 to tell other tasks."""
    names = ["key", "at", "first", "last", "h", "state"]

    def flushed(held: list[tuple]) -> pa.RecordBatch:
        key = pa.concat_arrays([x[0] for x in held])
        at, first, last, h = (np.concatenate([x[k] for x in held]) for k in range(1, 5))
        place = mix(np.frombuffer(key.buffers()[1], "<u8")[2 * key.offset : 2 * (key.offset + len(key)) : 2] + at.astype(U64))
        order = np.argsort(h, kind="stable")
        begins = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        again = np.minimum.reduceat(place[order], begins) != np.maximum.reduceat(place[order], begins)
        state = np.zeros(len(h), np.int32)
        sizes = np.diff(np.append(begins, len(h)))
        sure = order[np.repeat(again, sizes)]
        state[sure] = 1 + (place[sure] & U64(1023)).astype(np.int32)
        told = order[begins[again]]
        rows = np.concatenate((np.arange(len(h)), told))
        state = np.concatenate((state, np.full(len(told), -1, np.int32)))
        return pa.RecordBatch.from_arrays([key.take(pa.array(rows)).cast(pa.binary()), *(pa.array(x[rows].astype(np.int32)) for x in (at, first, last)), pa.array(h[rows]), pa.array(state)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            keys = b.column(0).cast(pa.binary(16)) if len(b) else None
            data, offsets = packed(b.column(1))
            for i, j in blocks(offsets):
                base = offsets[i : j + 1] - offsets[i]
                row, at, first, last, h = anchors(data[offsets[i] : offsets[j]], base, length)
                if len(row):
                    zero = base[row]
                    held.append((keys.take(pa.array(i + row)), at - zero, first - zero, last - zero, h))
                    size += len(row)
                if size > HELD_ANCHORS:
                    yield flushed(held)
                    held, size = [], 0
        if held:
            yield flushed(held)

    return run


def _segment_rows(length: int, chunk: int, keep: str):
    """Segments of the chunks of each repeated anchor: group, place of the core in the segment, text, start, copy, bytes.

    A text that more rows hold (`n`) stands for two copies, the second one for all but the smallest doc_id's; all of its
    segments are looked at. Segments that the task holds at two places or more run their factors here, and the windows
    found are rows without bytes (`align` is their length); one place of each goes on."""
    names = ["core", "align", "doc_id", "key", "start", "copy", "segment"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}  # places of a segment, and whether it goes on
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            bytes_ = 0
            for (core, align, segment), (places, on) in held.items():
                if on:
                    none, doc, key, at, copy = min(places)
                    rows.append((core, align, None if none else doc, key, at - align, copy, segment))
                    bytes_ += len(segment)
                    if bytes_ > 8 << 20:
                        yield batch(rows)
                        rows, bytes_ = [], 0
            again = [(k, align, segment, sorted(places)) for k, ((_, align, segment), (places, _)) in enumerate(held.items()) if len(places) > 1]
            for i in range(0, len(again), MOST_MEMBERS):
                for doc, key, first, last, copy in group_spans(again[i : i + MOST_MEMBERS], length, keep):
                    rows.append((int.from_bytes(key[:8], "little", signed=True) ^ first, last - first, doc, key, first, copy, None))
                yield batch(rows)
                rows = []
            yield batch(rows)

        for b in batches:
            for doc, key, text, runs, n in zip(*(b.column(k) for k in range(5)), strict=True):
                raw, doc, key = text.as_py().encode(), doc.as_py(), key.as_py()
                go = {(r["at"], r["first"], r["last"]) for r in runs.as_py() or []}
                copies = 2 if n.as_py() else 1
                looked = go
                if copies > 1:
                    _, at, first, last, _ = anchors(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), length)
                    looked = go | set(zip(at.tolist(), first.tolist(), last.tolist(), strict=True))
                for at, first, last in sorted(looked):
                    on = (at, first, last) in go
                    for c in range((at - last) // chunk, (at - first) // chunk + 1):
                        low, high = max(first, at - chunk * c - chunk + 1), min(last, at - chunk * c)
                        core = at - chunk * c
                        digest = hashlib.blake2b(raw[core : core - chunk + 1 + length], digest_size=8, key=c.to_bytes(2, "little")).digest()
                        entry = (int.from_bytes(digest, "little", signed=True), core - low, raw[low : high + length])
                        before = held.get(entry)
                        if before is None:
                            before = held[entry] = [set(), False]
                            size += len(entry[2]) + 200
                        before[0].update((doc is None, doc or 0, key, core, k) for k in range(copies))
                        before[1] = before[1] or on
                        size += 150 * copies
                if size > HELD_BYTES:
                    yield from flushed()
                    held, size = {}, 0
        yield from flushed()

    return run


def longest_factors(order: np.ndarray, lcp: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LPF and LNF of each suffix: its longest match with one at a smaller, and at a larger, place.

    `lcp` is that of each suffix in `order` with the one before. The longest match at a smaller place is with the
    previous or the next smaller place in suffix order; all suffixes look for theirs at once. A suffix whose candidate
    is not smaller goes on to that one's candidate: all that it passed over is larger still.
    """
    n = len(order)
    out = []
    for sign in (1, -1):
        best = np.zeros(n, np.int64)
        for step in (1, -1):
            place = sign * np.asarray(places)[order][::step]
            reach = np.concatenate(([0], np.asarray(lcp)[1:] if step > 0 else np.asarray(lcp)[:0:-1])).astype(np.int64)[:n]
            found = np.arange(-1, n - 1)
            going = np.flatnonzero(reach > 0)
            while len(going := going[place[found[going]] >= place[going]]):
                other = found[going]
                least = np.minimum(reach[going], reach[other])
                reach[going], found[going] = least, found[other]
                going = going[least > 0]
            best = np.maximum(best, reach[::step])
        own = np.zeros(n, np.int64)
        own[order] = best
        out.append(own)
    return out[0], out[1]


def covered_windows(group: np.ndarray, align: np.ndarray, segments: list[bytes], first: np.ndarray, second: np.ndarray, length: int, keep: str) -> Iterator[tuple[np.ndarray, ...]]:
    """(copy, segment, first, last window) of the runs of covered windows of different segments.

    The suffix array is that of the groups' segments put one after the other, built from the right: a suffix is its
    letter and the suffix behind it, so the order at one place is that of (letter, rank at the place behind). A segment
    with two places (`second` >= 0) is there twice. Windows of a group that are equal stand at one place relative to
    the core, where all suffixes of that place are at hand: their LCPs, cut at `length`, and LPF and LNF.
    """
    n, sizes = len(segments), np.array([len(x) for x in segments], np.int64)
    begins = align.max() - align
    ends = begins + sizes
    text = np.zeros((n, int(ends.max())), np.uint8)
    row, ahead = np.repeat(np.arange(n), sizes), np.cumsum(sizes) - sizes
    text[row, np.arange(len(row)) + np.repeat(begins - ahead, sizes)] = np.frombuffer(b"".join(segments), np.uint8)
    rank = np.zeros(n, np.int64)
    high = np.full((2, n), -1, np.int64)
    for r in range(text.shape[1] - 1, -1, -1):
        keys = (group * 257 + np.where(r < ends, text[:, r].astype(np.int64) + 1, 0)) * n + rank
        order = np.argsort(keys)
        ordered = keys[order]
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        hit = np.zeros((2, n), bool)
        here = order[(r >= begins[order]) & (r <= ends[order] - length)]
        if len(here):
            lcp = np.zeros(len(here), np.int64)
            pair = 1 + np.flatnonzero((group[here[1:]] == group[here[:-1]]) & (text[here[1:], r] == text[here[:-1], r]))
            for part in np.split(pair, range(1 << 16, len(pair), 1 << 16)):
                lcp[part] = length * (text[here[part], r : r + length] == text[here[part - 1], r : r + length]).all(1)
            counts = 1 + (second[here] >= 0)
            starts = np.cumsum(counts) - counts
            member = np.repeat(here, counts)
            copy = np.ones(len(member), np.int64)
            copy[starts] = 0
            full = np.full(len(member), length)
            full[starts] = lcp
            earlier, later = longest_factors(np.arange(len(member)), full, np.where(copy > 0, second[member], first[member]))
            hit[copy, member] = (earlier >= length) | ((later >= length) & (keep == "none"))
        over = (high >= 0) & ~hit
        if over.any():
            copy, member = np.nonzero(over)
            yield copy, member, r + 1 - begins[member], high[over] - begins[member]
            high[over] = -1
        high[hit & (high < 0)] = r
    copy, member = np.nonzero(high >= 0)
    yield copy, member, -begins[member], high[copy, member] - begins[member]


def group_spans(members: list[tuple], length: int, keep: str) -> Iterator[tuple]:
    """(doc_id, key, first, last byte + 1, copy) that are covered, of different segments (group, align, bytes, sorted
    places) of some groups. Of equal segments the third and later ones have the second one's factors."""
    if not members:
        return
    names = {g: k for k, g in enumerate(sorted({x[0] for x in members}))}
    ranks = {p: k for k, p in enumerate(sorted({p for x in members for p in x[3][:2]}))}
    group = np.array([names[x[0]] for x in members], np.int64)
    align = np.array([x[1] for x in members], np.int64)
    first = np.array([ranks[x[3][0]] for x in members], np.int64)
    second = np.array([ranks[x[3][1]] if len(x[3]) > 1 else -1 for x in members], np.int64)
    for runs in covered_windows(group, align, [x[2] for x in members], first, second, length, keep):
        for later, k, a, b in zip(*(x.tolist() for x in runs), strict=True):
            _, own, _, places = members[k]
            for none, doc, key, at, copy in places[1:] if later else places[:1]:
                yield None if none else doc, key, at - own + a, at - own + b + length, copy if keep == "first" else 0


def _span_rows(length: int, keep: str):
    """Covered bytes from segments that come sorted by group and bytes; small groups share one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple] = set()
        members: list[tuple] = []  # whole groups, and the open one

        def batch() -> pa.RecordBatch:
            cols = zip(*out, strict=True) if out else [()] * 5
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["doc_id", "key", "a", "b", "copy"])

        def close() -> None:
            sizes = Counter(x[0] for x in members)
            out.update(group_spans([(g, align, segment, sorted(places)) for g, align, segment, places in members if sizes[g] > 1 or len(places) > 1], length, keep))
            members.clear()

        for rows in batches:
            for group, align, doc, key, start, copy, segment in zip(*(rows.column(k).to_pylist() for k in range(7)), strict=True):
                if segment is None:
                    out.add((doc, key, start, start + align, copy))
                    continue
                if members and group != members[-1][0] and len(members) >= MOST_MEMBERS:
                    close()
                if not members or (group, align, segment) != members[-1][:3]:
                    members.append((group, align, segment, set()))
                members[-1][3].add((doc is None, doc or 0, key, start + align, copy))
            if len(out) > 20_000:
                yield batch()
                out.clear()
        close()
        yield batch()

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    t = text_or_empty(text).cast("string")
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.substring(F.unhex(F.sha2(t.cast("binary"), 256)), 1, 16).alias("key"), t.alias("text"))


def marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with `may`, which is true for all whose key is in the checkpointed `keys`, and for few others."""
    words = min(MOST_WORDS, 1024 + keys.count() // 8)
    h = F.xxhash64("key")
    slot, bit = F.pmod(h, F.lit(words)), F.expr("shiftleft(1L, cast(shiftrightunsigned(xxhash64(key), 40) & 63 AS int))")
    bits = keys.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    found = rows.withColumn("slot", slot).join(F.broadcast(bits), "slot", "left")
    return found.withColumn("may", F.coalesce("bits", F.lit(0).cast("long")).bitwiseAND(bit) != 0).drop("slot", "bits")


def spans(rows: DataFrame, length: int = LENGTH, keep: str = "none", chunk: int = CHUNK) -> DataFrame:
    """(key, spans) of each text that has covered bytes; a span of copy 0 is of its doc_id's row, one of copy 1 of the
    other rows of that text (keep="first"; else all rows have the same spans)."""
    found = rows.select("key", "text").mapInArrow(released(_anchor_rows(length)), "key binary, at int, first int, last int, h long, state int")
    w = Window.partitionBy("h", F.greatest("state", F.lit(0)))
    place = F.struct("key", "at")
    again = found.withColumns({"lo": F.min(place).over(w), "hi": F.max(place).over(w), "told": F.max(F.col("state") != 0).over(w)}).filter("(told OR lo <> hi) AND state >= 0")
    runs = again.groupBy("key").agg(F.collect_set(F.struct("at", "first", "last")).alias("runs"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("size")).filter((F.col("n") > 1) & (F.col("size") >= length))
    runs = cut(runs.join(counts.select("key", "n"), "key", "full_outer"))
    rows = marked(rows, runs).filter("may").drop("may")
    first = rows.groupBy("key").agg(F.min("doc_id").alias("least"))
    # By key and id, so that the rows of one text that very many documents hold do not meet in one task.
    wanted = runs.join(first, "key").select(F.col("key").alias("own"), "least", "runs", "n")
    texts = rows.join(wanted, (F.col("key") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("doc_id", "key", "text", "runs", "n")
    schema = "core long, align int, doc_id long, key binary, start int, copy int, segment binary"
    dealt = texts.mapInArrow(released(_segment_rows(length, chunk, keep)), schema).repartition("core").sortWithinPartitions("core", "align", "segment")
    covered = dealt.mapInArrow(released(_span_rows(length, keep)), "doc_id long, key binary, a int, b int, copy int")
    return covered.groupBy("key").agg(F.collect_set(F.struct("a", "b", "copy", "doc_id")).alias("spans"))


def remove(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, keep: str = "none", kept_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, starts and ends of the removed runs and the
    kept bytes of every row."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    rows = keyed(docs, text, key)
    info = cut(spans(rows, length, keep))
    dealt = marked(rows, info)
    both = dealt.filter("may").join(info, "key", "left").select("doc_id", "text", "spans")
    both = both.unionByName(dealt.filter("NOT may").select("doc_id", "text", F.lit(None).cast(info.schema["spans"].dataType).alias("spans")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", starts array<long>, ends array<long>, kept binary" * kept_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(8 if kept_text else 5)]
            for doc, text, found in zip(*(b.column(k) for k in range(3)), strict=True):
                raw, doc, found = text.as_py().encode(), doc.as_py(), found.as_py() or []
                runs = merged([(s["a"], s["b"]) for s in found if keep == "none" or s["copy"] == (doc != s["doc_id"])])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                row = (doc, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
                for c, v in zip(cols, (*row, [r[0] for r in runs], [r[1] for r in runs], kept) if kept_text else row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names[: len(cols)])

    return both.mapInArrow(released(run), schema)
