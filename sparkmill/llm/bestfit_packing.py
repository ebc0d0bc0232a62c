"""Best-two-fit packing of tokenized documents into sequences of bounded length.

Bins are filled greedily, best fit first: pieces in falling length, each into the fullest bin that takes it. Then
each bin with a gap gives up its smallest piece where two unpacked pieces fill the expanded gap more tightly than the
piece did; the piece goes back to the unpacked ones.

A plan needs only how many pieces there are of each length, so it works on counts: at most `capacity` numbers reach
the driver however many documents there are, and bins of one pattern (a multiset of lengths) are planned together with
their number. Packing all pieces on counts is a global plan, not one per task. Spark then numbers the pieces within
each length (counts of salted parts first, summed in the cluster, so that a length that a third of all pieces share
stays spread) and every piece finds its run in the plan's table by halving. A plan exhausts a length with each pattern
or two, so the table's size depends on `capacity` alone, not on the input.

Texts are cut into units that the tokenizer encodes independently; units that repeat are looked up, by a hash and then
byte by byte.

A null text counts as empty: one end id. Documents over the capacity are cut into pieces of `capacity` ids; the first
piece takes what is left over. Rows repeated in full are packed as often as they come; an empty table gives an empty
result. Extra columns of documents take no part, whatever their names; those of pieces are carried by `pack`, but for
columns named like its outputs, which are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.llm.common import UnitStore, arrow_stage, cut, held_by_worker, released, small, unit_hashes

CAPACITY = 1024
END = 2
#: Texts that are encoded together.
STEP = 400

# Characters whose classes the vectorised splitter knows (tab, line feed, printable ASCII other than the
# apostrophe, Latin-1 letters); texts with others go through the tokenizer whole.
_SAFE = re.compile(r"[\n\t -&(-~ªµºÀ-ÖØ-öø-ÿ]*\Z")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = _LETTER


def split_units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the units that the byte-level pattern splits safe texts into; a unit ends where the next starts.

    A unit is a run of one class, with the space before it; of other white space before a run, the last character
    stands alone, and what comes before that is one unit, as is white space at the end of a text.
    """
    n = len(data)
    kind = _CLASS[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    space = kind == _SPACE
    before = np.concatenate(([False], space[:-1])) & ~first[:n]
    followed = np.concatenate((~space[1:], [False])) & ~first[1:]
    attached = before & np.concatenate(([False], (data == 32)[:-1]))
    changed = first[:n] | np.concatenate(([True], kind[1:] != kind[:-1]))
    return np.flatnonzero(np.where(space, ~before | followed, changed & ~attached))


class Tokens:
    """Packed ids of texts; a unit of the splitting pattern is encoded by the tokenizer once and then looked up."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = self.tokenizer.pre_tokenizer
        self.bytewise = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and self.tokenizer.normalizer is None
        alphabet = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(alphabet)]
        self.shown = {b: chr(b) for b in alphabet} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.store = UnitStore(self._units)

    def _units(self, units: list[str]) -> list[list[int]]:
        model, shown = self.tokenizer.model, self.shown
        return [[t.id for t in model.tokenize(u.encode().decode("latin-1").translate(shown))] for u in units]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the tokenizer gives them without added special tokens."""
        safe = [self.bytewise and _SAFE.match(t) is not None and not any(x in t for x in self.special) for t in texts]
        raw = [t.encode() if s else b"" for t, s in zip(texts, safe, strict=True)]
        offsets = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        out = [None if s else self._whole(t) for t, s in zip(texts, safe, strict=True)]
        if len(data):
            starts = split_units(data, offsets)
            ends = np.append(starts[1:], len(data))
            ids, counts = self.store.lookup(data, starts, ends, unit_hashes(data, starts, ends)[0])
            total = np.concatenate(([0], np.cumsum(counts)))
            edges = total[np.searchsorted(starts, offsets)].tolist()
            for k, s in enumerate(safe):
                if s:
                    out[k] = ids[edges[k] : edges[k + 1]]
        return [np.zeros(0, np.uint32) if x is None else x for x in out]


@held_by_worker(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, carry_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of each piece of each document."""
    tail = np.array([end], np.uint32)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * carry_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(path)
        for b in batches:
            for k in range(0, len(b), STEP):
                part = b.slice(k, STEP)
                cols: list[list] = [[] for _ in range(5 + carry_ids)]
                for doc, ids in zip(part.column(0).to_pylist(), t.encode([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    n = len(ids) + 1
                    raw = np.concatenate((ids, tail)).tobytes()
                    first = n % capacity or capacity
                    edges = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
                    for nth, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                        own = raw[4 * a : 4 * z]
                        row = [doc, nth, a, z - a, zlib.crc32(own)]
                        for c, v in zip(cols, [*row, np.frombuffer(own, np.int32)] if carry_ids else row, strict=True):
                            c.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[i]) for i, c in enumerate(cols)], names[: len(cols)])

    return arrow_stage(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, schema)


def _below(left: np.ndarray, most: int) -> int:
    """The longest length at most `most` that is left, or 0."""
    hits = np.flatnonzero(left[1 : most + 1])
    return int(hits[-1]) + 1 if len(hits) else 0


def _best_pair(left: np.ndarray, gap: int) -> tuple[int, int]:
    """Two unpacked lengths whose sum is the largest at most `gap`; (0, 0) if no two fit."""
    lengths = np.flatnonzero(left[: gap + 1])
    lengths = lengths[lengths > 0]
    best, pair = 0, (0, 0)
    for a in lengths[::-1]:
        if 2 * a < best:
            break
        rest = min(int(a), gap - int(a))
        if rest < 1:
            continue
        b = _below(left, rest)
        if b == a and left[a] < 2:
            b = _below(left, int(a) - 1)
        if b and a + b > best:
            best, pair = int(a) + b, (int(a), b)
            if best == gap:
                break
    return pair


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a bin) with the number of bins of each; every piece is in exactly one bin."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] += n
    out: Counter[tuple[int, ...]] = Counter()
    while top := _below(left, capacity):
        own: list[int] = []
        gap = capacity
        while gap and (k := _below(left, min(gap, top))):  # greedy: the longest piece that fits
            own.append(k)
            left[k] -= 1
            gap -= k
        while gap and len(own) > 1:  # two for the smallest
            small = own[-1]
            a, b = _best_pair(left, gap + small)
            if a + b <= small:
                break
            left[small] += 1
            left[a] -= 1
            left[b] -= 1
            own[-1:] = [a, b]
            own.sort(reverse=True)
            gap -= a + b - small
        # As many bins of the pattern as the pieces left allow, so that the loop runs over patterns, not bins.
        need = Counter(own)
        more = min(int(left[k]) // n for k, n in need.items())
        for k, n in need.items():
            left[k] -= n * more
        out[tuple(own)] += 1 + more
    return sorted(out.items(), reverse=True)


def runs(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, offset): where the pieces of a length, by rank, go."""
    out, rank, first = [], Counter(), 0
    for own, n in patterns:
        at = 0
        for size in own:
            out.append((size, rank[size], rank[size] + n, first, at))
            rank[size] += n
            at += size
        first += n
    return out


def pack(found: DataFrame, capacity: int = CAPACITY, chunk: int = 1 << 13) -> DataFrame:
    """Adds sequence_id and offset to pieces; `found` should be cheap to read twice (written or checkpointed).

    The ranks of a length's pieces come in two steps: counts by (length, salt) and their running sums over the salts of
    a length, which stay in the cluster, then a rank within each (length, salt).
    """
    spark = found.sparkSession
    salts = max(1, min(4096, found.count() // chunk))
    order = ["row.doc_id", "row.piece", "row.start", "row.ids_crc32"]
    own = [c for c in found.columns if c not in ("sequence_id", "offset")]
    rows = found.select(F.struct(*own).alias("row")).withColumns({"length": F.col("row.length").cast("long"), "salt": F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")})
    counts = cut(rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = np.array(sorted(runs(plan(by_length, capacity))), np.int64).reshape(-1, 5)
    known = spark.sparkContext.broadcast((table[:, 0] << 40 | table[:, 1], table[:, 3] - table[:, 1], table[:, 4]))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    begun = small(cut(counts.select("length", "salt", before.alias("begin"))))
    ranked = rows.join(begun, ["length", "salt"]).select("row", "length", (F.col("begin") + F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shift, offsets = known.value
        for b in batches:
            rank = b.column(2).to_numpy()
            k = np.searchsorted(keys, b.column(1).to_numpy() << 40 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rank + shift[k]), pa.array(offsets[k])], ["row", "sequence_id", "offset"])

    return ranked.mapInArrow(released(place), f"row {ranked.schema['row'].dataType.simpleString()}, sequence_id long, offset long").select("row.*", "sequence_id", "offset")


def pack_documents(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(pieces(df, path, text, key, capacity, end)), capacity)
