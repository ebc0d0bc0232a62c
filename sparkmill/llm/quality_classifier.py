"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words, all of them. Every passage is encoded (measures of its words and
characters, and hashed words, through one tanh layer); gated attention, learned from document labels alone, weighs the
passages, and a logistic unit scores the weighted sum. Ids, languages, sources and labels are never inputs.

The model is fitted on at most MOST_LABELLED labelled rows (and MOST_BYTES of their text) outside the held-out fifth;
every text is then scored whole. A null text, or one without words, is a single passage of zeros and gets that bag's
score. Repeated rows are scored one by one; an empty table gives an empty result, and without any labelled row every
bag gets the untrained model's score. Extra columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import blocks, packed, released, words
from sparkmill.llm.training import labelled

MOST_LABELLED = 5000
PASSAGE = 64
HASHED = 64
HIDDEN = 16
GATE = 8
THRESHOLD = 0.3

_GROUPS = [np.zeros(256, np.int8) for _ in range(6)]
for _group, _chars in zip(_GROUPS, (b"#*$%&|<>", b"!?", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:", b"\n"), strict=True):
    _group[list(_chars)] = 1
MEASURES = len(_GROUPS) + 4


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document of each passage and its inputs; a document without words has one passage of zeros."""
    n = len(offsets) - 1
    hashes, row, starts, ends = words(data, offsets)
    per = np.bincount(row, minlength=n)
    bags = np.maximum(1, -(-per // PASSAGE))
    first_bag = np.cumsum(bags) - bags
    doc = np.repeat(np.arange(n), bags)
    x = np.zeros((len(doc), MEASURES + HASHED), np.float32)
    if not len(hashes):
        return doc, x
    first_word = np.cumsum(per) - per
    bag = first_bag[row] + (np.arange(len(hashes)) - first_word[row]) // PASSAGE
    begins = np.flatnonzero(np.concatenate(([True], bag[1:] != bag[:-1])))
    own, lasts = bag[begins], np.append(begins[1:], len(bag)) - 1
    size = (lasts - begins + 1).astype(np.float32)
    chars = np.maximum(1, ends[lasts] - starts[begins]).astype(np.float32)
    for k, group in enumerate(_GROUPS):
        total = np.concatenate(([0], np.cumsum(group[data], dtype=np.int64)))
        x[own, k] = np.minimum(2, (total[ends[lasts]] - total[starts[begins]]) / (chars if k == 2 else size))
    k = len(_GROUPS)
    distinct = np.unique(bag.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    x[:, k] = np.bincount((distinct >> np.uint64(40)).astype(np.int64), minlength=len(x)) / np.maximum(1, np.bincount(bag, minlength=len(x)))
    x[own, k + 1] = np.add.reduceat((ends - starts).astype(np.float32), begins) / size / 10
    same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (bag[1:] == bag[:-1])))
    x[own, k + 2] = np.add.reduceat(same.astype(np.float32), begins) / size
    x[own, k + 3] = size / PASSAGE
    slot = (hashes >> np.uint64(8)).astype(np.int64) % HASHED
    counts = np.bincount(bag * HASHED + slot, minlength=len(x) * HASHED).reshape(len(x), HASHED)
    x[:, MEASURES:] = counts / np.maximum(1, counts.sum(1, keepdims=True)) * 4
    return doc, x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Mil:
    def __init__(self, inputs: int, hidden: int = HIDDEN, gate: int = GATE, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        draw = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": draw(inputs, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)

    def forward(self, doc: np.ndarray, x: np.ndarray) -> dict:
        """`doc` rises and has no gaps from 0."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        begins = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        a = np.exp(e - np.maximum.reduceat(e, begins)[doc])
        a /= np.add.reduceat(a, begins)[doc]
        z = np.add.reduceat(a[:, None] * h, begins)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"]), "begins": begins}

    def gradient(self, doc: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict:
        p, f = self.p, self.forward(doc, x)
        dy = (f["y"] - y) / len(y)
        dz = (dy[:, None] * p["c"])[doc]
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["begins"])[doc])
        dt, ds = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}

    def fit(self, doc: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Mil:
        if not len(y):
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 0.05
        x = (x - self.mean) / self.scale
        share = np.clip(y.mean(), 0.01, 0.99)
        self.p["d"][:] = np.log(share / (1 - share))
        begins = np.searchsorted(doc, np.arange(len(y) + 1))
        r, t = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for _ in range(epochs):
            order = r.permutation(len(y))
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                rows = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in own])
                d = np.repeat(np.arange(len(own)), begins[own + 1] - begins[own])
                g, t = self.gradient(d, x[rows], y[own]), t + 1
                for name in self.p:
                    q = g[name] + decay * self.p[name]
                    m[name] = 0.9 * m[name] + 0.1 * q
                    v[name] = 0.999 * v[name] + 0.001 * q * q
                    self.p[name] -= rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
        return self

    def score(self, texts: pa.Array) -> np.ndarray:
        data, offsets = packed(texts)
        parts = []
        for a, b in blocks(offsets):
            doc, x = passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            parts.append(self.forward(doc, (x - self.mean) / self.scale)["y"])
        return np.concatenate(parts) if parts else np.zeros(0)


def fit(texts: list[str], labels: list[int]) -> Mil:
    """Bags that are longer than others count as one label each, as any bag does."""
    data, offsets = packed(pa.array(texts, pa.string()))
    parts = []
    for a, b in blocks(offsets):  # the sample's words are never held all at once
        doc, x = passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        parts.append((doc + a, x))
    doc = np.concatenate([np.zeros(0, np.int64), *[d for d, _ in parts]])
    x = np.concatenate([np.zeros((0, MEASURES + HASHED), np.float32), *[x for _, x in parts]])
    return Mil(MEASURES + HASHED).fit(doc, x, np.array(labels, float))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, label: str = "quality") -> Mil:
    texts, y = labelled(docs, labels, (label,), most)
    return fit(texts, y[:, 0])


def score(df: DataFrame, model: Mil, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.score(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(released(run), "doc_id long, score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
