"""SentencePiece BPE encoding and decoding with byte offsets into the original text.

`Codec` reads a model file's pieces and its compiled character map (a double-array trie and its replacement strings).
Normalisation takes the longest prefix that the map knows at each place, or else one character, and records for every
normalised byte the original byte it came from; pieces are then projected to original byte spans. Merging follows the
model's scores: the best-scored adjacent pair first, ties to the left; unknown characters fall back to their bytes.

Where no piece holds a word mark after another character, merges never cross the start of a word mark run (nor a line
end that no piece holds); a text is then a sequence of independent units, and units that repeat are looked up instead
of merged again. New units go through the sentencepiece library's merge loop, without its normaliser, a batch at a
time; `merge` is the same loop in Python, for models whose units can't be told apart. The store of units is bounded
(`MOST_UNITS`); once full, further units are merged whenever they come.

Null counts as empty: begin and end ids alone, decoded to the empty text. Repeated rows are encoded one by one; empty
tables give empty results; whole texts of any length are encoded; extra columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import released

MARK = "▁"
MOST_UNITS = 400_000
#: Texts whose units are looked up together.
STEP = 500
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class CharMap:
    """A compiled character map: length of the trie, its units (little-endian 32-bit), then zero-ended strings."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data[at:] and what replaces it."""
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.strings[value : self.strings.index(b"\0", value)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Codec:
    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2:
            raise ValueError("the codec reads BPE models")
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type in (_NORMAL, _USER, _UNUSED)}
        self.bytes = {int(p.piece[1:-1], 16): k for k, p in enumerate(model.pieces) if p.type == _BYTE}
        self.unknown = self.kinds.index(_UNKNOWN)
        t, n = model.trainer_spec, model.normalizer_spec
        self.bos, self.eos, self.unknown_surface = t.bos_id, t.eos_id, t.unk_surface
        self.suffix, self.fallback = t.treat_whitespace_as_suffix, t.byte_fallback
        self.dummy, self.trim, self.escape = n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces
        self.map = CharMap(n.precompiled_charsmap)
        self.user = sorted((p for p, k in self.ids.items() if self.kinds[k] == _USER), key=len, reverse=True)
        self.identity = not self.map.units and not self.trim and not self.suffix and not self.user
        self.splits = self.escape and not self.user and not self.suffix and not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.model = model
        self.lines = not any("\n" in p for p in self.ids)
        self.store: dict[str, bytes] = {}
        self.changed: set[str] = set()
        self.forms = [self._form(k) for k in range(len(self.pieces))]
        self.sizes_array = np.array([1 if kind == _BYTE else len(p.encode()) for p, kind in zip(self.pieces, self.kinds, strict=True)])

    # Normalisation

    def normalize(self, text: str) -> tuple[bytes, list[int]]:
        """The normalised UTF-8 text and, for each of its bytes and its end, the original byte offset."""
        data = text.encode()
        if not data:
            return b"", [0]
        mark = MARK.encode() if self.escape else b" "
        chunks: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(data):
            user = next((u for u in self.user if data.startswith(u.encode(), at)), None)
            if user is not None:
                size, new = len(user.encode()), user.encode()
            elif (hit := self.map.longest(data, at)) is not None:
                size, new = hit
            else:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[at : at + size]
            chunks.append((new, at, size))
            at += size
        if self.trim:
            while chunks and chunks[0][0] in (b" ", b""):
                chunks.pop(0)
            if not chunks:
                return b"", [len(data)]
        out, source = bytearray(), []
        add = lambda b, where: (out.extend(b), source.extend([where] * len(b)))
        if self.dummy and not self.suffix:
            add(mark, chunks[0][1])
        space = self.trim
        for new, where, _ in chunks:
            while space and new.startswith(b" "):
                new = new[1:]
            if new:
                for b in new:
                    add(mark if b == 32 else bytes([b]), where)
                space = self.trim and new.endswith(b" ")
            elif not self.trim:
                space = False
        end = len(data)
        if self.trim:
            while out.endswith(mark):
                end = source[len(out) - len(mark)]
                del out[len(out) - len(mark) :], source[len(source) - len(mark) :]
        if self.dummy and self.suffix:
            add(mark, end)
        return bytes(out), [*source, end]

    # Encoding

    def merge(self, text: str) -> list[tuple[int, int]]:
        """(id, length in bytes of the normalised text) of each piece; a byte piece of a character takes one byte."""
        symbols: list[str | None] = list(text)
        if self.user:
            pattern = "|".join(map(re.escape, self.user)) + "|(?s:.)"
            symbols = re.findall(pattern, text)
        fixed = [s in self.user for s in symbols] if self.user else None
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, int]] = []
        halves: dict[str, tuple[str, str]] = {}

        def offer(a: int, b: int) -> None:
            if a < 0 or b < 0 or fixed and (fixed[a] or fixed[b]):
                return
            whole = symbols[a] + symbols[b]
            k = self.ids.get(whole)
            if k is not None:
                heapq.heappush(heap, (-self.scores[k], a, b, len(whole)))
                if self.kinds[k] == _UNUSED:
                    halves[whole] = (symbols[a], symbols[b])

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if symbols[a] is None or symbols[b] is None or len(symbols[a]) + len(symbols[b]) != size or right[a] != b:
                continue
            symbols[a] += symbols[b]
            symbols[b] = None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        out: list[tuple[int, int]] = []

        def put(s: str) -> None:
            k = self.ids.get(s)
            if k is not None and self.kinds[k] != _UNUSED:
                out.append((k, len(s.encode())))
            elif k is not None and s in halves:
                for h in halves[s]:
                    put(h)
            elif self.fallback:
                out.extend((self.bytes[b], 1) for b in s.encode())
            else:
                out.append((self.unknown, len(s.encode())))

        for s in symbols:
            if s is not None:
                put(s)
        return out

    @cached_property
    def engine(self):
        """The library's merge loop over text that is normalised already."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.CopyFrom(self.model)
        n = model.normalizer_spec
        n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = b"", False, False, True
        return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def learn(self, units: Iterable[str]) -> dict[str, tuple]:
        """Packed ids of units that the store lacks; those that fit are stored."""
        new = list(dict.fromkeys(units))
        if self.splits:  # one call for many units: a mark starts each, so none merges with its neighbour
            joint = [u for u in new if u[0] == MARK and u[-1] != MARK]
            alone = [u for u in new if u[0] != MARK or u[-1] == MARK]
            groups = [joint[k : k + 256] for k in range(0, len(joint), 256)] + [[u] for u in alone]
        else:
            groups = [[u] for u in new]
        if self.splits:
            encoded = self.engine.encode(["".join(g) for g in groups], num_threads=1)
        else:
            encoded = [[k for k, _ in self.merge(g[0])] for g in groups]
        out = {}
        for group, ids in zip(groups, encoded, strict=True):
            flat, packed = array("I", ids), array("I", ids).tobytes()
            ends = np.cumsum(self.sizes_array[np.frombuffer(packed, np.uint32)]).searchsorted(np.cumsum([len(u.encode()) for u in group])) + 1
            first = 0
            for u, last in zip(group, ends.tolist(), strict=True):
                out[u] = packed[4 * first : 4 * last]
                first = last
            if self.surface(flat) != "".join(group).replace(MARK, " ").encode():
                self.changed.update(u for u in group if self.surface(array("I", out[u])) != u.replace(MARK, " ").encode())
        if len(self.store) + len(out) <= MOST_UNITS:
            self.store.update(out)
        return out

    _UNITS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
    _WHOLE = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def units(self, normal: str) -> list[str]:
        if not self.splits:
            return [normal] if normal else []
        return (self._UNITS if self.lines else self._WHOLE).findall(normal)

    def parts(self, texts: list[str]) -> list[tuple[list[str], list[bytes]]]:
        """The units and their packed ids, of normalised texts."""
        get, cuts, lost = self.store.get, [], set()
        for t in texts:
            cuts.append((u := self.units(t), [get(x) for x in u]))
            if None in cuts[-1][1]:
                lost.update(x for x, f in zip(*cuts[-1], strict=True) if f is None)
        if lost:
            new = self.learn(lost)
            cuts = [(u, [new[x] if f is None else f for x, f in zip(u, found, strict=True)] if None in found else found) for u, found in cuts]
        return cuts

    def encode_batch(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text (id, begin, end) of each piece, as byte spans of the original text; no begin or end ids."""
        return [list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True)) for _, _, ids, begins, ends in self.projected(texts)]

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        return self.encode_batch([text])[0]

    def projected(self, texts: list[str]) -> Iterator[tuple[str, list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """The normalised text, its units, ids, begins and ends of each text."""
        normal = [self.plain(t) for t in texts]
        for text, n, (units, found) in zip(texts, normal, self.parts(normal), strict=True):
            ids, source = np.frombuffer(b"".join(found), "<u4"), self.source(text)
            at = np.concatenate(([0], np.cumsum(self.sizes_array[ids])))
            yield n, units, ids, source[at[:-1]], source[at[1:]]

    def plain(self, text: str) -> str:
        """The normalised text alone; the identity map needs no walk over its characters."""
        if self.identity:
            mark = MARK if self.escape else " "
            return (mark if self.dummy and text else "") + text.replace(" ", mark)
        return self.normalize(text)[0].decode()

    def source(self, text: str) -> np.ndarray:
        """The alignment that `normalize` gives; of the identity map, each byte's character start, in one numpy pass."""
        if not self.identity:
            return np.array(self.normalize(text)[1], np.int64)
        data = np.frombuffer(text.encode(), np.uint8)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        mark = len(MARK.encode()) if self.escape else 1
        widths = np.where(data[starts] == 32, mark, np.diff(starts, append=len(data)))
        prefix = mark if self.dummy and text else 0
        return np.concatenate((np.zeros(prefix, np.int64), np.repeat(starts, widths), [len(data)]))

    def digests(self, texts: list[str]) -> list[tuple[int, str, str, str]]:
        """Number of ids with begin and end, digests of the ids, of the text decoded from them, and of the pieces' spans."""
        out = []
        bos, eos = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        for n, units, pieces, begins, ends in self.projected(texts):
            ids = b"".join([bos, pieces.tobytes(), eos])
            if self.changed and not self.changed.isdisjoint(units) or not self.splits:
                shown = self.decode([k for (k,) in struct.iter_unpack("<I", ids)])
            else:  # the surface of every unit's ids is the unit
                shown = n.replace(MARK, " ")
                shown = shown[1:] if self.dummy else shown
            spans = np.stack((begins, ends), 1).astype("<i8").tobytes()
            out.append((len(ids) // 4, *(hashlib.sha256(x).hexdigest() for x in (ids, shown.encode(), spans))))
        return out

    # Decoding

    def _form(self, k: int) -> bytes:
        kind = self.kinds[k]
        if kind == _BYTE:
            return bytes([int(self.pieces[k][1:-1], 16)])
        if kind == _CONTROL:
            return b""
        if kind == _UNKNOWN:
            return self.unknown_surface.encode()
        return self.pieces[k].replace(MARK, " ").encode()

    def surface(self, ids: list[int]) -> bytes:
        return b"".join([self.forms[k] for k in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: word marks are spaces, the dummy prefix goes, broken byte sequences become U+FFFD."""
        shown = self.surface(ids)
        first = next((k for k in ids if self.kinds[k] != _CONTROL), None)
        if first is not None and self.kinds[first] in (_NORMAL, _UNUSED) and self.dummy and shown.startswith(b" "):
            shown = shown[1:]
        return "".join(_lenient(shown))


def _lenient(data: bytes) -> Iterator[str]:
    """UTF-8 with one U+FFFD for each byte that belongs to no character."""
    at = 0
    while at < len(data):
        try:
            yield data[at:].decode()
            return
        except UnicodeDecodeError as e:
            yield data[at : at + e.start].decode() + "�"
            at += e.start + 1


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id with ids, begins and ends (byte spans of the original text) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            rows = c.encode_batch([x or "" for x in b.column(1).to_pylist()])
            lists = [pa.array([[p[k] for p in r] for r in rows], pa.list_(kind)) for k, kind in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["doc_id", "ids", "begins", "ends"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(released(run), "doc_id long, ids array<int>, begins array<long>, ends array<long>")


def digests(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, with begin and end ids, and spans_sha256.

    The last is of begin and end of each piece in order, little-endian 64-bit byte offsets into the original text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            rows = [r for k in range(0, len(b), STEP) for r in c.digests([x or "" for x in b.column(1).slice(k, STEP).to_pylist()])]
            n, *digest = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in digest)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
