"""Toxicity by a classifier chain.

The chain predicts its categories in order. Every link is a logistic regression over hashed words and word beginnings
plus the probabilities of the links before it; a link is trained with the earlier links' out-of-fold predictions, so
that it sees earlier probabilities as unsure as they will be on new texts. Within a fold the kinds are found, the
features are selected, and the link is fitted, from the other folds' rows alone.

The categories are the label columns that `train` is given, the last one the verdict. Where there is one label alone,
the categories before it are kinds of positive texts: the words that tell positive from negative texts best are
clustered by the positive texts they stand in, and a positive text is of the kind that its words point at most. No word
is listed here; kinds are numbered by size.

The model is fitted on at most MOST_LABELLED labelled rows (and MOST_BYTES of their text) and then scores every whole
text. A null or empty text has no features and gets the intercepts' probabilities, which are low; with no positive or no
negative label in the sample every score is about the share of positives. Repeated rows are scored one by one; an empty
table gives an empty result. Extra columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import blocks, packed, released, unit_hashes, words
from sparkmill.llm.training import labelled

MOST_LABELLED = 6000
FEATURES = 4096
FOLDS = 4
THRESHOLD = 0.5
_BITS = 20

#: Kinds of positive texts that come before the one label in the chain, and the words that they are found by.
KINDS = 3
MARKS = 48


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the hashed words and of the beginnings (4 and 5 bytes) of longer words; rows repeat slots."""
    hashes, row, starts, ends = words(data, offsets)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    rows, slots = [row], [hashes]
    for n in (4, 5):
        long = ends - starts > n
        rows.append(row[long])
        slots.append(~unit_hashes(lower, starts[long], starts[long] + n)[0])
    return np.concatenate(rows), (np.concatenate(slots) >> np.uint64(64 - _BITS)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Link:
    """Weights of the chosen features, of the earlier links' probabilities, and the intercept."""

    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def predict(self, row: np.ndarray, feature: np.ndarray, earlier: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(row, self.weights[feature], n) + self.bias
        return _sigmoid(z + earlier @ self.chain if earlier.shape[1] else z)


def fit_link(row: np.ndarray, feature: np.ndarray, earlier: np.ndarray, y: np.ndarray, size: int, steps: int = 120, decay: float = 1e-3) -> Link:
    """Logistic regression by Adam over all rows, with an L2 penalty."""
    n, k = len(y), earlier.shape[1]
    share = np.clip(y.mean() if n else 0, 1e-3, 1 - 1e-3)
    theta = np.zeros(size + k + 1)
    theta[-1] = np.log(share / (1 - share))
    if not 0 < y.sum() < n:
        return Link(theta[:size], theta[size:-1], float(theta[-1]))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        p = Link(theta[:size], theta[size:-1], theta[-1]).predict(row, feature, earlier, n)
        e = (p - y) / n
        g = np.concatenate((np.bincount(feature, e[row], size), earlier.T @ e, [e.sum()]))
        g[:-1] += decay * theta[:-1] / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Link(theta[:size], theta[size:-1], float(theta[-1]))


def select(row: np.ndarray, slot: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots that tell positive from negative rows best, at most `size`, and how far each speaks for positive.
    `row` and `slot` hold each slot of a row once; slots of fewer than four rows take no part."""
    pos, neg = np.bincount(slot, y[row], 1 << _BITS), np.bincount(slot, 1 - y[row], 1 << _BITS)
    a, b = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    weight = np.where(pos + neg >= 4, (pos / a - neg / b) / np.sqrt((pos + neg + 1) / max(1, len(y))), 0)
    top = np.argsort(-np.abs(weight), kind="stable")[:size]
    return top, weight[top]


def kinds(row: np.ndarray, slot: np.ndarray, y: np.ndarray, n: int = KINDS, marks: int = MARKS) -> np.ndarray:
    """A column for each of n kinds: 1 for the positive rows of that kind. Marks are clustered by their cosine over the
    positive rows, from the first marks that are farthest from each other."""
    out = np.zeros((len(y), n))
    top, weight = select(row, slot, y, 1 << _BITS)
    top = top[weight > 0][:marks]
    positive = np.flatnonzero(y > 0)
    if len(top) < n or not len(positive):
        return out
    where, place = np.full(1 << _BITS, -1), np.cumsum(y > 0) - 1
    where[top] = np.arange(len(top))
    hit = (where[slot] >= 0) & (y[row] > 0)
    there = np.zeros((len(top), len(positive)))
    there[where[slot[hit]], place[row[hit]]] = 1
    unit = there / np.maximum(1e-9, np.linalg.norm(there, axis=1, keepdims=True))
    centre = unit[:1]
    for _ in range(n - 1):
        centre = np.vstack((centre, unit[np.argmin((unit @ centre.T).max(1))]))
    for _ in range(20):
        own = np.argmax(unit @ centre.T, 1)
        moved = np.array([unit[own == k].sum(0) if (own == k).any() else centre[k] for k in range(n)])
        centre = moved / np.maximum(1e-9, np.linalg.norm(moved, axis=1, keepdims=True))
    votes = np.array([there[own == k].sum(0) for k in range(n)])
    kind = np.where(votes.sum(0) > 0, votes.argmax(0), -1)
    order = np.argsort([-(kind == k).sum() for k in range(n)], kind="stable")
    for k, old in enumerate(order):
        out[positive[kind == old], k] = 1
    return out


def fold_targets(row: np.ndarray, slot: np.ndarray, y: np.ndarray, train: np.ndarray) -> np.ndarray:
    """The targets of a fold: kinds found from the rows of `train` alone, other rows 0, then the label. Kinds are told
    which is which by the rows of `train` that they share with the columns of `y`."""
    own = np.zeros_like(y)
    where, mine = np.cumsum(train) - 1, train[row]
    found = kinds(where[row[mine]], slot[mine], y[train, -1], y.shape[1] - 1)
    shared = y[train, :-1].T @ found
    for _ in range(found.shape[1]):  # the pair that shares most, then the next of those left
        k, j = np.unravel_index(np.argmax(shared), shared.shape)
        own[train, k] = found[:, j]
        shared[k], shared[:, j] = -1, -1
    own[train, -1] = y[train, -1]
    return own


@dataclass
class Chain:
    names: tuple[str, ...]
    table: np.ndarray
    links: list[Link] = field(default_factory=list)

    def _rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, slot = features(data, offsets)
        chosen = self.table[slot]
        hit = chosen >= 0
        keys = np.unique(row[hit] * len(self.table) + chosen[hit])
        return keys // len(self.table), keys % len(self.table)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        row, feature = self._rows(data, offsets)
        out = np.zeros((n, 0))
        for link in self.links:
            out = np.column_stack((out, link.predict(row, feature, out, n)))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        data, offsets = packed(texts)
        parts = [self.predict(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.links)))


def _fold(row: np.ndarray, slot: np.ndarray, y: np.ndarray, seen: np.ndarray, train: np.ndarray, size: int) -> tuple[Link, np.ndarray]:
    """The link of the rows of `train`, and every row's features by what those rows select."""
    where, mine = np.cumsum(train) - 1, train[row]
    top, _ = select(where[row[mine]], slot[mine], y[train, -1], size)
    table = np.full(1 << _BITS, -1, np.int64)
    table[top] = np.arange(len(top))
    use = mine & (table[slot] >= 0)
    return fit_link(where[row[use]], table[slot[use]], seen[train], y[train, seen.shape[1]], len(top)), table


def fit(texts: list[str], labels, folds: int = FOLDS, size: int = FEATURES, names: tuple[str, ...] = ("toxic",)) -> Chain:
    """`labels`: a number for each text, or a matrix with a column for each of `names`."""
    y = np.array(labels, float).reshape(len(texts), len(names))
    n = len(texts)
    data, offsets = packed(pa.array(texts, pa.string()))
    found = []
    for a, b in blocks(offsets):  # the sample's bytes are never expanded all at once
        row, slot = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        found.append(np.unique((row + a) * (1 << _BITS) + slot))
    keys = np.concatenate(found) if found else np.zeros(0, np.int64)
    row, slot = keys >> _BITS, keys & ((1 << _BITS) - 1)
    found_kinds = len(names) == 1
    if found_kinds:
        y = np.column_stack((kinds(row, slot, y[:, 0]), y))
        names = (*(f"{names[0]}_kind_{k + 1}" for k in range(y.shape[1] - 1)), *names)
    fold = np.arange(n) % folds
    targets = [fold_targets(row, slot, y, fold != f) for f in range(folds)] if found_kinds else [y] * folds
    seen = np.zeros((n, 0))
    chain = None
    for k in range(len(names)):
        out = np.zeros(n)
        for f in range(folds):
            train, test = fold != f, fold == f
            if not train.any() or not test.any():
                continue
            link, table = _fold(row, slot, targets[f], seen, train, size)
            use = table[slot] >= 0
            out[test] = link.predict(row[use], table[slot[use]], seen, n)[test]
        link, table = _fold(row, slot, y, seen, np.ones(n, bool), size)
        chain = chain or Chain(names, table)
        chain.links.append(link)
        seen = np.column_stack((seen, out))
    return chain


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, names: tuple[str, ...] = ("toxic",), held_out: bool = True) -> Chain:
    texts, y = labelled(docs, labels, names, most, held_out)
    return fit(texts, y, names=names)


def score(df: DataFrame, chain: Chain, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the probability of each category, and `predicted` (1 where the last one reaches the threshold)."""
    model, names = df.sparkSession.sparkContext.broadcast(chain), chain.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.value.score(b.column(1))
            cols = [pa.array(p[:, k]) for k in range(p.shape[1])]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array((p[:, -1] >= threshold).astype(np.int32))], ["doc_id", *names, "predicted"])

    schema = "doc_id long, " + ", ".join(f"`{c}` double" for c in names) + ", predicted int"
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(released(run), schema)
