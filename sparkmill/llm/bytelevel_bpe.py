"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The splitting pattern is a small automaton over classes of code points: letters (those of the contractions 's 't 're 've
'm 'll 'd apart), digits, other characters, the apostrophe, the space and other white space. What a run of characters does
to the automaton is a function from states to states; there are few such functions, so they have numbers, and tables
compose them. Composition is associative: all blocks of a batch advance together, the functions of whole blocks are
scanned in the same way, and one more look-up turns each place's function into its state. A place starts a slice by the
state before it, its class and the class after it, and no regular expression runs.

Slices are cached by their bytes. New ones are merged together, a column for each place: in every round the pair of least
rank, the leftmost of equal ones, merges in every slice at once. A slice of more than WIDE bytes goes by a heap. Each
token keeps its byte offset; decoding concatenates the bytes that the ids stand for.

Letters and digits are what the tokeniser library's own Unicode tables say: it is asked once, on the driver, for all code
points, and the table (1.1 million small numbers, whatever the input) is broadcast.

A null text counts as empty: no ids, and the empty text decoded. Repeated rows are encoded one by one; an empty table
gives an empty result; texts of any length are taken whole. Extra columns take no part, whatever their names. An id that
the vocabulary does not hold, or a null one, is an error when decoded; null ids (no list) decode to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import UnitStore, blocks, packed, released, unit_hashes

#: Slices of more bytes are merged by a heap, one by one.
WIDE = 48
#: Places of a block of the scan.
BLOCK = 64
#: Bytes of texts that are encoded together.
STEP = 1 << 21

# Classes of code points, and what the pattern's \s matches.
LETTER, SINGLE, ELL, ARVEE, EE, DIGIT, OTHER, QUOTE, SPACE, WHITE = range(10)
CONTRACTIONS = {"s": SINGLE, "t": SINGLE, "m": SINGLE, "d": SINGLE, "l": ELL, "r": ARVEE, "v": ARVEE, "e": EE}
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CLASSES = 10

# States: nothing read of this slice; a run of letters, digits, others; white space that ends in a space, or not; an
# apostrophe that starts a slice; it and an l; it and an r or v.
FRESH, LETTERS, DIGITS, OTHERS, SPACED, BLANK, QUOTED, QUOTED_L, QUOTED_RV = range(9)
STATES = 9


def step(state: int, kind: int) -> int:
    """The state after a character of class `kind`."""
    if kind <= EE:
        if state == QUOTED:
            return {SINGLE: FRESH, ELL: QUOTED_L, ARVEE: QUOTED_RV}.get(kind, LETTERS)
        return FRESH if (state, kind) in ((QUOTED_L, ELL), (QUOTED_RV, EE)) else LETTERS
    if kind == QUOTE:
        return OTHERS if state in (SPACED, OTHERS, QUOTED) else QUOTED
    return {DIGIT: DIGITS, OTHER: OTHERS, SPACE: SPACED, WHITE: BLANK}[kind]


def starts_slice(state: int, kind: int, after: int) -> bool:
    """Whether a character of class `kind` starts a slice after `state`; `after` is the next one's class, or CLASSES at a
    text's end."""
    if kind in (SPACE, WHITE):
        return state not in (SPACED, BLANK) or after not in (SPACE, WHITE, CLASSES)
    if kind <= EE:
        if state == QUOTED:
            return not (kind == SINGLE or (kind, after) in ((ELL, ELL), (ARVEE, EE)))
        return state not in (LETTERS, SPACED, QUOTED_L, QUOTED_RV)
    if kind == DIGIT:
        return state not in (DIGITS, SPACED)
    return state not in (OTHERS, SPACED, QUOTED)


class Transitions:
    """The functions that runs of characters make of states, numbered, with tables: `compose` (first, then), `acts`
    (function, state), and the functions of single classes; a class plus CLASSES is the first character of a text."""

    def __init__(self) -> None:
        one = [tuple(step(s, k) for s in range(STATES)) for k in range(CLASSES)]
        one += [(step(FRESH, k),) * STATES for k in range(CLASSES)]
        found = {tuple(range(STATES)): 0}
        for f in one:
            found.setdefault(f, len(found))
        order = list(found)
        for f in order:  # grows while it is read: all products of single functions
            for g in one:
                product = tuple(g[x] for x in f)
                if product not in found:
                    found[product] = len(found)
                    order.append(product)
        if len(order) > 256:
            raise ValueError("the numbers of functions must fit a byte")
        self.single = np.array([found[f] for f in one], np.uint8)
        self.acts = np.array(order, np.uint8)
        self.compose = np.array([[found[tuple(g[x] for x in f)] for g in order] for f in order], np.uint8)

    def states(self, functions: np.ndarray, first: int = FRESH) -> np.ndarray:
        """The state after each place of a row of functions, from the state `first`."""
        n = len(functions)
        if n <= BLOCK:
            out = np.zeros(n, np.uint8)
            for k, f in enumerate(functions.tolist()):
                out[k] = first = self.acts[f, first]
            return out
        rows = -(-n // BLOCK)
        padded = np.zeros((BLOCK, rows), np.uint8)  # the identity fills the last block
        flat = np.zeros(rows * BLOCK, np.uint8)
        flat[:n] = functions
        padded[:] = flat.reshape(rows, BLOCK).T
        wide = self.compose.shape[1]
        table = self.compose.ravel()
        for k in range(1, BLOCK):
            padded[k] = table[padded[k - 1].astype(np.intp) * wide + padded[k]]
        ends = self.states(padded[-1], first)
        begins = np.concatenate(([first], ends[:-1])).astype(np.intp)
        return self.acts.ravel()[padded.astype(np.intp) * STATES + begins].T.reshape(-1)[:n]


@lru_cache(maxsize=1)
def transitions() -> Transitions:
    return Transitions()


@lru_cache(maxsize=1)
def _starts() -> np.ndarray:
    return np.array([[[starts_slice(s, k, a) for a in range(CLASSES + 1)] for k in range(CLASSES)] for s in range(STATES)])


@lru_cache(maxsize=2)
def code_point_classes(pattern: str) -> np.ndarray:
    """The class of every code point, as the library's pattern sees it: behind a letter (or a digit) a character is
    merged with it where both are in one slice."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    for lead in range(256):
        for own in b"a1":
            ranks.setdefault(bytes([own, lead]), len(ranks))
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    known = np.full(0x110000, OTHER, np.uint8)
    points = np.setdiff1d(np.arange(0x110000), np.arange(0xD800, 0xE000)).astype(np.uint32)
    for own, kind in (("a", LETTER), ("1", DIGIT)):
        for part in np.array_split(points, 16):
            rows = np.full((len(part), 3), 10, np.uint32)
            rows[:, 0], rows[:, 1] = ord(own), part
            ids = np.array(probe.encode_ordinary(rows.tobytes().decode("utf-32-le")), np.int64)
            size = 1 + (ids >= 256)
            place = np.cumsum(size) - size
            width = 3 + (part >= 0x80).astype(np.int64) + (part >= 0x800) + (part >= 0x10000)
            begins = np.cumsum(width) - width
            known[part[np.isin(begins, place[size == 2])]] = kind
    known[list(WHITE_SPACE)] = WHITE
    known[0x20], known[0x27] = SPACE, QUOTE
    for letter, kind in CONTRACTIONS.items():
        known[ord(letter)] = kind
    return known


def slices(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The byte offsets at which the slices of packed UTF-8 rows start; a slice ends where the next one starts."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    kind = known[points]
    firsts = np.unique(np.searchsorted(leads, offsets[:-1][np.diff(offsets) > 0]))
    first = np.zeros(len(kind), bool)
    first[firsts] = True
    t = transitions()
    state = t.states(t.single[kind + np.uint8(CLASSES) * first])
    before = np.concatenate((np.zeros(1, np.uint8), state[:-1]))
    before[first] = FRESH
    after = np.concatenate((kind[1:], np.full(1, CLASSES, np.uint8)))
    after[firsts[1:] - 1] = CLASSES
    begins = _starts().ravel()[(before.astype(np.intp) * CLASSES + kind) * (CLASSES + 1) + after]
    return leads[begins]


class Ranks:
    """The vocabulary of a rank file, its pairs, and the cached merging of slices."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.ids = {base64.b64decode(token): int(rank) for token, rank in rows}
        top = max(self.ids.values()) + 1
        self.held = np.zeros(top, bool)
        self.sizes = np.zeros(top, np.int64)
        for token, rank in self.ids.items():
            self.held[rank], self.sizes[rank] = True, len(token)
        self.begins = np.zeros(top, np.int64)
        in_order = sorted(self.ids.items(), key=lambda x: x[1])
        self.flat = np.frombuffer(b"".join(t for t, _ in in_order), np.uint8)
        self.begins[[r for _, r in in_order]] = np.cumsum([0, *[len(t) for t, _ in in_order[:-1]]])
        self.bytes = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ids.items():
            for k in range(1, len(token)):
                a, b = self.ids.get(token[:k]), self.ids.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.none = top
        self.names = [str(k) for k in range(top)]
        self.store = UnitStore(self.merged)

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's concatenation, `none` where the vocabulary lacks it or a place is empty (-1)."""
        want = np.where((a < 0) | (b < 0), -1, a << 32 | b)
        k = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[k] == want, self.values[k], self.none) if len(self.keys) else np.full(want.shape, self.none)

    def merged(self, units: list[str]) -> list[list[int]]:
        """The ids of each slice."""
        raw = [u.encode() for u in units]
        out: list = [[self.ids[u]] if u in self.ids else None for u in raw]
        by_size: dict[int, list[int]] = {}
        for k, u in enumerate(raw):
            if out[k] is None:
                by_size.setdefault(len(u) if len(u) <= WIDE else 0, []).append(k)
        for k in by_size.pop(0, []):
            out[k] = self.heaped(raw[k])
        for size, rows in by_size.items():
            table = self.bytes[np.frombuffer(b"".join(raw[k] for k in rows), np.uint8)].reshape(len(rows), size)
            for k, ids in zip(rows, self.together(table), strict=True):
                out[k] = ids
        return out

    def together(self, table: np.ndarray) -> list[list[int]]:
        """Merges rows of equal length; a place that a merge empties moves to the end as -1."""
        n, size = table.shape
        done: list = [None] * n
        own = np.arange(n)
        rank = self.ranked(table[:, :-1], table[:, 1:])
        while len(own):
            at = rank.argmin(axis=1)
            line = np.arange(len(own))
            best = rank[line, at]
            live = best < self.none
            for k in np.flatnonzero(~live).tolist():
                done[own[k]] = [x for x in table[k].tolist() if x >= 0]
            own, table, rank, at, best = own[live], table[live], rank[live], at[live], best[live]
            if not len(own):
                break
            line = np.arange(len(own))
            table[line, at] = best
            place = np.arange(table.shape[1] - 1)
            table = np.take_along_axis(table, place + (place > at[:, None]), axis=1)
            if table.shape[1] == 1:
                for k in range(len(own)):
                    done[own[k]] = table[k].tolist()
                break
            place = place[:-1]
            rank = np.take_along_axis(rank, place + (place >= at[:, None]), axis=1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < table.shape[1] - 1)
            rank[left, at[left] - 1] = self.ranked(table[left, at[left] - 1], table[left, at[left]])
            rank[right, at[right]] = self.ranked(table[right, at[right]], table[right, at[right] + 1])
        return done

    def heaped(self, unit: bytes) -> list[int]:
        """The same merges for one slice of any length: pairs wait in a heap by rank and place."""
        ids = self.bytes[np.frombuffer(unit, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k) for k in range(n - 1) if (r := self.pairs.get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j < 0 or self.pairs.get(ids[k] << 32 | ids[j]) != rank:
                continue  # one of the pair has merged with another since
            ids[k], ids[j], after[k] = rank, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a in (before[k], k):
                b = after[a] if a >= 0 else -1
                if b >= 0 and (r := self.pairs.get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [x for x in ids if x >= 0]

    def encode(self, data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of packed rows, and where each row's begin (one more entry than rows)."""
        starts = slices(data, offsets, known)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        ids, counts = self.store.lookup(data, starts, ends, unit_hashes(data, starts, ends)[0])
        total = np.concatenate(([0], np.cumsum(counts)))
        return ids.astype(np.int64), total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and where each id's begin (one more entry than ids)."""
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.held) and self.held[ids].all()):
            raise ValueError("an id that the vocabulary does not hold")
        sizes = self.sizes[ids]
        at = np.concatenate(([0], np.cumsum(sizes)))
        return self.flat[np.arange(at[-1]) + np.repeat(self.begins[ids] - at[:-1], sizes)], at


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def _mapped(df: DataFrame, path: str, pattern: str, schema: str, rows: Callable) -> DataFrame:
    """`rows(held, keys, data, offsets, known)` gives a batch for each lot of texts of the columns key, text."""
    shared = df.sparkSession.sparkContext.broadcast(code_point_classes(pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ranks(path)
        for b in batches:
            data, offsets = packed(b.column(1))
            for first, last in blocks(offsets, STEP):
                yield rows(held, b.column(0).slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], shared.value)

    return df.mapInArrow(released(run), schema)


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, ids and starts: for each id, the byte of the text at which its token starts."""

    def rows(held: Ranks, keys: pa.Array, data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        ids, edges = held.encode(data, offsets, known)
        size = held.sizes[ids]
        starts = np.cumsum(size) - size - np.repeat(offsets[:-1], np.diff(edges))
        lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x)) for x in (ids.astype(np.int32), starts)]
        return pa.RecordBatch.from_arrays([keys, *lists], ["doc_id", "ids", "starts"])

    return _mapped(_texts(docs, text, key), path, pattern, "doc_id long, ids array<int>, starts array<long>", rows)


def decode(df: DataFrame, path: str, ids: str | Column = "ids", key: str = "doc_id") -> DataFrame:
    """doc_id and the bytes (UTF-8 where the ids are those of a whole text) of each list of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ranks(path)
        for b in batches:
            out = []
            for x in b.column(1):
                own = x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0)
                if len(own) and np.isnan(own.astype(float)).any():
                    raise ValueError("a null id")
                out.append(held.decode(own.astype(np.int64))[0].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    own = F.col(ids) if isinstance(ids, str) else ids
    return df.select(F.col(key).cast("long").alias("doc_id"), own.cast("array<long>").alias("ids")).mapInArrow(released(run), "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the decimal ids, joined by commas, and of the bytes that they decode to."""

    def rows(held: Ranks, keys: pa.Array, data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        ids, edges = held.encode(data, offsets, known)
        back, at = held.decode(ids)
        names = list(map(held.names.__getitem__, ids.tolist()))
        edge, place, raw = edges.tolist(), at[edges].tolist(), back.tobytes()
        listed = [hashlib.sha256(",".join(names[a:b]).encode()).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        decoded = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(place[:-1], place[1:], strict=True)]
        return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(edges)), pa.array(listed), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(_texts(docs, text, key), path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
