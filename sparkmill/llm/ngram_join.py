"""N-gram Jaccard join: a size-aware heavy-light join of word-shingle sets.

Documents with equal sets form a class. Two sets of Jaccard similarity t or more share a token among their first
n - ceil(t n) + 1 tokens of any global order, and two tokens among one more. Small sets (up to a boundary x) enumerate
the pairs of that longer prefix, fixed-size subsets that few sets share; large sets, and the small ones that are near
enough to the boundary to link with them, go by inverted lists of single tokens. x is where the cost of both, summed
over the sizes that the corpus holds, is least. The order puts tokens that many sets hold last.

Candidates come in three steps, each checked and joined to components before the next. First every class meets one
other: of the clearest members of its lists, the one of most of them, so a group of near copies costs a pair for each
member. Then the other clearest members that lie in another component. Last, in the lists that are mixed even so, the
pairs across components. At each step a pair must still be able to reach the threshold by the sizes and by how many of
its prefix tokens any other set shares; no link that would join two components is missed. A check first compares bitmaps
of the sets, four bits or more a token, which bound the intersection from above; the pairs that the bound leaves
intersect the full sets.

In the last step, a component of many sets and the sets that met it without a link are a group, whose pairs come from
what its sets differ in: with c the tokens that more than half of the group hold and D(s) those in which s and c differ,
s and t differ in |D(s)| + |D(t)| - 2 |D(s) and D(t) in common| tokens. Sets that are near c link with the set nearest to
it; any other link needs common tokens of D, at least as many as sizes say, and is found by prefixes of D. Only pairs
that do not lie in one group go by the mixed lists.

Words and shingles have two 64-bit hashes that share no constants. Sets and classes are known by both (two classes whose
first halves meet get ids of their own); candidates come by the first, and intersections are counted by the second.

Null and empty texts, and texts without words, have the empty set and link with nothing; a text of fewer words than the
shingle is one shingle. Repeated rows are one class. A null doc_id never becomes a component's id unless all are null.
Extra columns take no part in `join` and are carried by `keep_one`, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.llm.common import U64, arrow_stage, blocks, cut, mix, packed, packed_in, released, shingle_sets, small
from sparkmill.llm.components import components

SHINGLE = 5
PERCENT = 80
#: Frequent tokens that the order knows by count; others count as rare. A bound of what is broadcast (16 bytes each).
MOST_FREQUENT = 1 << 18
#: A token that so many sets of one task hold is a candidate for the frequent ones.
LOCAL_COUNT = 8
#: Tokens that a task holds to count them.
HELD_TOKENS = 2_000_000
#: Classes of a component, and of those that met it, that go by their differences in the last step; fewer go by lists.
GROUP = 32
#: Longs of the bounded filters of texts and classes that need their sets again.
FILTER_WORDS = 1 << 16


class Identity:
    """Class ids: 64 bits of a set, or those that `clashes` renames by the other 64 bits. 0 is the empty set's.

    `bits` below 64 makes ids meet; tests use it."""

    def __init__(self, bits: int = 64) -> None:
        self.bits, self.clashes = bits, [np.zeros(0, np.int64)]

    def renamed(self, clash: list[int]) -> None:
        self.clashes.append(np.sort(np.array(clash, np.int64)))

    def of(self, edges: np.ndarray, lanes: list[np.ndarray]) -> list[np.ndarray]:
        """The id of each set and, with two lanes, what tells apart the sets of one id."""
        n = len(edges) - 1
        if not len(lanes[0]):
            return [np.zeros(n, np.int64) for _ in range(2)]
        held = np.flatnonzero(np.diff(edges))
        out = []
        for tokens in lanes:
            both = np.bitwise_xor.reduceat(mix(tokens ^ U64(0x5851F42D4C957F2D)), edges[held]) + np.add.reduceat(tokens, edges[held]) * U64(3)
            out.append(mix(both))
        key = np.maximum(out[0] & U64(2**self.bits - 1), U64(1))
        for turn, clash in enumerate(self.clashes):
            if len(clash):
                meets = np.isin(key.astype(np.int64), clash)
                if meets.any() and len(lanes) < 2:
                    raise ValueError("renamed classes need both lanes")
                fresh = mix(out[-1] + mix(key + U64(turn) * U64(0x9E3779B97F4A7C15)))
                key = np.where(meets, np.maximum(fresh, U64(1)), key)
        full = [np.zeros(n, np.int64) for _ in range(2)]
        full[0][held] = key.astype(np.int64)
        full[1][held] = out[-1].astype(np.int64)
        return full

    @property
    def lanes(self) -> int:
        return 1 if len(self.clashes) == 1 else 2


def _sets(batch: pa.RecordBatch, width: int, known: Identity, lanes: int, where: np.ndarray | None = None) -> Iterator[tuple]:
    """Blocks of rows: the first row, edges of the rows' sets, tokens of each lane, class ids and their other halves."""
    data, offsets = packed(batch.column(1))
    for a, b in blocks(offsets):
        edges, tokens = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, lanes)
        yield a, edges, tokens, *known.of(edges, tokens)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bit for each token, in a power of two of words, 16 tokens a word at most; a bitmap of half as many words is its
    halves' union."""
    size = 1 << max(0, -(-len(tokens) // 16) - 1).bit_length()
    hit = np.zeros(64 * size, np.uint8)
    hit[((tokens & np.uint64(size - 1)) << np.uint64(6) | tokens >> np.uint64(58)).astype(np.int64)] = 1
    return np.packbits(hit, bitorder="little").view(np.int64)


def _required(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _repeated(held: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that come `least` times or more, and how often; empties `held`, and makes one sorted copy alone."""
    tokens = np.concatenate([np.zeros(0, U64), *held])
    held.clear()
    tokens.sort()
    later = tokens[least - 1 :]
    u = np.unique(later[later == tokens[: len(later)]])
    return u, np.searchsorted(tokens, u, side="right") - np.searchsorted(tokens, u)


def classes(docs: DataFrame, width: int, known: Identity) -> DataFrame:
    """Rows of kind 0: doc_id, cls, n, other half of the class; the first row of a class in each task carries the hash
    of its text and the bitmap of its set. Rows of kind 1 hold frequent tokens (cls) and their counts (n)."""
    names = ["kind", "doc_id", "cls", "n", "half", "mark", "bits"]
    long, some = pa.int64(), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            u, c = _repeated(held, LOCAL_COUNT)
            none = [pa.nulls(len(u), t) for t in (long, long, some)]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), np.int32)), pa.nulls(len(u), long), pa.array(u.astype(np.int64)), pa.array(c.astype(np.int64)), *none], names)

        for b in batches:
            for first, edges, tokens, cls, half in _sets(b, width, known, 2):
                n = np.diff(edges)
                bits: list = [None] * len(cls)
                for k, key in enumerate(cls.tolist()):
                    if key and key not in seen:
                        seen.add(key)
                        own = tokens[0][edges[k] : edges[k + 1]]
                        bits[k] = bitmap(own)
                        held.append(own)
                        size += len(own)
                rows = b.slice(first, len(cls))
                new = pa.array([x is None for x in bits], pa.bool_())
                mark = pa.compute.if_else(new, pa.scalar(None, long), rows.column(2))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(cls), np.int32)), rows.column(0), pa.array(cls), pa.array(n), pa.array(half), mark, pa.array(bits, some)], names)
                if size > HELD_TOKENS:
                    yield frequent()
                    held, size = [], 0
        yield frequent()

    return arrow_stage(docs, run, "kind int, doc_id long, cls long, n long, half long, mark long, bits array<long>")


def boundary(sizes: dict[int, int], share: float, list_length: float, percent: int) -> int:
    """The largest set that enumerates pairs: the x of least cost. A list entry costs itself and, where its token is
    frequent (`share`), half the list; a pair costs itself, and pairs that are frequent cost share squared as much."""
    best, where = None, 0
    sizes = dict(sorted(sizes.items()))
    pairs = {n: (p := n - _required(n, percent) + 2) * (p - 1) // 2 for n in sizes}
    singles = {n: n - _required(n, percent) + 1 for n in sizes}
    for x in (0, *sizes):
        small = sum(c * pairs[n] * (1 + share * share * list_length / 2) for n, c in sizes.items() if n <= x)
        large = sum(c * singles[n] * (1 + share * list_length / 2) for n, c in sizes.items() if 100 * n >= percent * (x + 1))
        if best is None or small + large < best:
            best, where = small + large, x
    return where


def prefixes(docs: DataFrame, width: int, percent: int, known: Identity, frequent: np.ndarray, ranks: np.ndarray, x: int) -> DataFrame:
    """(key, cls, n, p) of each class: p keys that a similar set must share one of."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, ranks))

    def keys(tokens: np.ndarray) -> list[np.ndarray]:
        frequent, ranks = shared.value
        n = len(tokens)
        p = n - _required(n, percent) + 1
        rank = np.zeros(n, np.int64)
        if len(frequent):
            k = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
            rank = np.where(frequent[k] == tokens, ranks[k], 0)
        order = np.lexsort((tokens, rank))[: p + 1]
        first = tokens[order]
        out = []
        if n <= x and n > 1:
            a, b = np.triu_indices(len(first), 1)
            out.append(mix(np.minimum(first[a], first[b]) * np.uint64(3) + mix(np.maximum(first[a], first[b]))))
        if 100 * n >= percent * (x + 1):
            out.append(first[:p])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, edges, tokens, cls, _ in _sets(b, width, known, known.lanes):
                found: list[tuple[np.ndarray, int, int]] = []
                for k, key in enumerate(cls.tolist()):
                    if key and key not in seen:
                        seen.add(key)
                        own = tokens[0][edges[k] : edges[k + 1]]
                        found += [(x, key, len(own)) for x in keys(own)]
                sizes = [len(k) for k, _, _ in found]
                cols = [np.concatenate([k for k, _, _ in found]).astype(np.int64) if found else np.zeros(0, np.int64), np.repeat(np.array([c for _, c, _ in found], np.int64), sizes), np.repeat(np.array([n for _, _, n in found], np.int32), sizes), np.repeat(np.array(sizes, np.int32), sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "cls", "n", "p"])

    return arrow_stage(docs, run, "key long, cls long, n int, p int")


def _filter(values: DataFrame) -> np.ndarray:
    """A bitmap of the longs in the one column of `values`, FILTER_WORDS longs however many there are; false positives
    cost, and lose nothing."""
    slot, bit = F.pmod("v", F.lit(FILTER_WORDS)).cast("int"), F.expr("shiftleft(1L, cast(shiftrightunsigned(v, 40) & 63 AS int))")
    out = np.zeros(FILTER_WORDS, np.int64)
    for r in values.toDF("v").select(slot.alias("s"), bit.alias("b")).groupBy("s").agg(F.bit_or("b").alias("b")).collect():
        out[r["s"]] = r["b"]
    return out


def _passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (bits[values % FILTER_WORDS] >> (values.view(np.uint64) >> U64(40) & U64(63)).astype(np.int64) & 1).astype(bool)


def full_sets(docs: DataFrame, width: int, known: Identity, wanted: DataFrame) -> DataFrame:
    """(cls, tokens) of the classes in `wanted` (cls, mark), each once; of the texts, only those marked build sets. The
    tokens are of the second lane."""
    both = docs.sparkSession.sparkContext.broadcast((_filter(wanted.select("mark")), _filter(wanted.select("cls"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        marks, bits = both.value
        for b in batches:
            b = b.filter(pa.array(_passes(marks, b.column(2).to_numpy())))
            for _, edges, tokens, cls, _ in _sets(b, width, known, 2):
                rows = []
                for k in np.flatnonzero(_passes(bits, cls)).tolist():
                    key = int(cls[k])
                    if key and key not in seen:
                        seen.add(key)
                        rows.append((key, tokens[1][edges[k] : edges[k + 1]].astype(np.int64)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.list_(pa.int64()))], ["cls", "tokens"])

    found = arrow_stage(docs, run, "cls long, tokens array<long>")
    return found.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def _able(a: str, b: str, percent: int) -> str:
    """Whether sizes and shared prefix tokens leave room for the threshold: at most what both share of their prefixes,
    and all beyond the prefix of the set whose prefix ends first, can be in common."""
    return (
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND "
        f"least({a}.shared, {b}.shared) + greatest({a}.n - {a}.p, {b}.n - {b}.p) >= ({percent} * ({a}.n + {b}.n) + {99 + percent}) div {100 + percent}"
    )


def _alike(percent: int) -> str:
    """Whether two bitmaps leave room for the threshold: a bit that one set alone has stands for a token of it alone.
    Bitmaps whose sizes differ by more than a factor of two bound nothing."""
    folded = lambda x, y: f"CASE WHEN size({x}) = 2 * size({y}) THEN transform(slice({x}, 1, size({y})), (v, i) -> v | element_at({x}, i + size({y}) + 1)) ELSE {x} END"
    alone = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p & ~q)), 0, (s, v) -> s + v)"
    left = f"least(n_a - {alone('x.a', 'x.b')}, n_b - {alone('x.b', 'x.a')})"
    return (
        f"exists(array(named_struct('a', {folded('bits_a', 'bits_b')}, 'b', {folded('bits_b', 'bits_a')})), x -> "
        f"size(x.a) <> size(x.b) OR {100 + percent} * {left} >= {percent} * (n_a + n_b))"
    )


def alike(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps of `known` (cls, n, bits) leave; no pair that links goes."""
    side = lambda x: known.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_alike(percent)).select("a", "b")


def verified(docs: DataFrame, width: int, known: Identity, pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link. `bitmaps` (cls, n, bits, mark) rules most others out; only the sets of the
    classes that are left in a pair are built again and moved."""
    pairs = cut(alike(pairs, bitmaps.select("cls", "n", "bits"), percent))
    rows = pairs.count()
    if not rows:
        return pairs
    pairs = pairs.coalesce(packed_in(rows))
    own = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = cut(bitmaps.select("cls", "mark").join(own, "cls", "left_semi")).coalesce(packed_in(2 * rows))
    sets = full_sets(docs, width, known, wanted)
    a = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("_a"))
    b = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("_b"))
    both = pairs.join(a, "a").join(b, "b").withColumn("_i", F.size(F.array_intersect("_a", "_b")))
    return cut(both.filter(100 * F.col("_i") >= percent * (F.size("_a") + F.size("_b") - F.col("_i"))).select("a", "b").coalesce(packed_in(rows)))


def labelled(rows: DataFrame, reached: DataFrame, cls: str, out: str) -> DataFrame:
    """The rows with the component of a class column, a class without links being its own."""
    return rows.join(reached.toDF("node_", "component_"), F.col(cls) == F.col("node_"), "left").withColumn(out, F.coalesce("component_", cls)).drop("node_", "component_")


def mixed(lists: DataFrame, reached: DataFrame) -> DataFrame:
    """The lists whose sets lie in more than one component, each set with its component."""
    label = labelled(lists, reached, "cls", "component")
    open_keys = label.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    return cut(label.join(open_keys, "key", "left_semi"))


def grouped(lists: DataFrame, stars: DataFrame, reached: DataFrame) -> DataFrame:
    """(cls, hub) of the classes of mixed lists that lie in a group of GROUP classes or more: a component, and the classes
    without links that met one of it in most lists."""
    met = stars.groupBy("cls").agg(F.max(F.struct("times", "centre")).alias("m")).select("cls", "m.centre")
    met = labelled(met, reached, "centre", "near").select("cls", "near")
    own = lists.select("cls").distinct().join(reached.toDF("cls", "linked"), "cls", "left").join(met, "cls", "left")
    own = cut(own.select("cls", F.coalesce("linked", "near", "cls").alias("hub")))
    return cut(own.join(own.groupBy("hub").count().filter(F.col("count") >= GROUP).select("hub"), "hub", "left_semi").select("cls", "hub"))


def _common_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, token, times) of the sets (hub, tokens) that a task reads, counted in bounded lots."""
    held: dict[int, list[np.ndarray]] = {}
    size = 0

    def counts() -> Iterator[pa.RecordBatch]:
        for hub, sets in held.items():
            token, times = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), hub, np.int64)), pa.array(token), pa.array(times.astype(np.int64))], ["hub", "token", "times"])

    for b in batches:
        for hub, tokens in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            held.setdefault(hub, []).append(tokens.values.to_numpy())
            size += len(tokens.values)
            if size > HELD_TOKENS:
                yield from counts()
                held, size = {}, 0
    yield from counts()


def differing(docs: DataFrame, width: int, known: Identity, members: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components of the members (cls, hub, n, p, shared, component) of one group; every pair of
    different components that links is among them, or both link with a third that it is in a pair with."""
    wanted = cut(bitmaps.select("cls", "mark").join(members.select("cls"), "cls", "left_semi"))
    sets = cut(full_sets(docs, width, known, wanted).join(members, "cls"))
    size = members.groupBy("hub").agg(F.count(F.lit(1)).alias("size"))
    times = sets.select("hub", "tokens").mapInArrow(released(_common_counts), "hub long, token long, times long").groupBy("hub", "token").agg(F.sum("times").alias("times"))
    middle = times.join(size, "hub").filter("2 * times > size").groupBy("hub").agg(F.collect_list("token").alias("middle"))
    # A hub whose sets share no token has an empty middle.
    apart = sets.join(small(cut(size.select("hub").join(middle, "hub", "left"))), "hub").withColumn("middle", F.coalesce("middle", F.array().cast("array<long>")))
    apart = apart.withColumn("diff", F.concat(F.array_except("tokens", "middle"), F.array_except("middle", "tokens")))
    weight = (100 - percent) * F.size("tokens") - (100 + percent) * F.size("diff")
    apart = cut(apart.select("hub", "cls", "component", "n", "p", "shared", weight.cast("long").alias("weight"), "diff"))
    # Two sets link if their weights and 2 (100 + percent) for each common token of their differences sum to 0 or more.
    best = apart.groupBy("hub").agg(F.max(F.struct("weight", "cls", "component")).alias("best"))
    edge = apart.select("hub", "weight").join(best, "hub").filter("weight + best.weight < 0").groupBy("hub").agg(F.max("weight").alias("beyond"))
    bounds = small(cut(best.join(edge, "hub", "left").select("hub", "best", "beyond")))
    both = apart.join(bounds, "hub").withColumn("far", F.expr("weight + best.weight < 0"))
    near = both.filter("NOT far AND component <> best.component").select(F.least("cls", "best.cls").alias("a"), F.greatest("cls", "best.cls").alias("b"))
    step = 2 * (100 + percent)
    need = F.expr(f"greatest(1, ({step - 1} - weight - CASE WHEN far THEN best.weight ELSE beyond END) div {step})")
    tokens = both.filter("beyond IS NOT NULL").withColumn("need", need.cast("int")).select("hub", "cls", "component", "n", "p", "shared", "weight", "far", "need", F.explode("diff").alias("token"))
    tokens = tokens.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("hub", "token"))).filter("times > 1")
    own = Window.partitionBy("cls")
    tokens = tokens.withColumns({"at": F.row_number().over(own.orderBy("times", "token")), "rows": F.count(F.lit(1)).over(own)}).filter("at <= rows - need + 1")
    tokens = cut(tokens.withColumn("left", (F.col("rows") - F.col("at") + 1).cast("int")).drop("times", "rows", "need", "at"))
    x, y = tokens.alias("x"), tokens.alias("y")
    link = f"x.hub = y.hub AND x.token = y.token AND x.cls < y.cls AND x.component <> y.component AND (x.far OR y.far) AND x.weight + y.weight + {step} * least(x.left, y.left) >= 0 AND " + _able("x", "y", percent)
    return near.unionByName(x.join(y, F.expr(link)).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))).distinct()


def last_pairs(docs: DataFrame, width: int, known: Identity, lists: DataFrame, stars: DataFrame, reached: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) across components that mixed lists leave: those of one group by their differences, others by lists."""
    groups = grouped(lists, stars, reached)
    rows = lists.join(small(groups), "cls", "left")
    most = rows.filter("hub IS NOT NULL").groupBy("key", "hub").count().groupBy("key").agg(F.max(F.struct("count", "hub")).alias("m")).select("key", F.col("m.hub").alias("main"))
    # Of a list's largest group, two sets do not meet here.
    rows = cut(rows.join(most, "key", "left").withColumn("other", F.expr("hub IS NULL OR hub <> main")).drop("main"))
    x, y = rows.filter("other").alias("x"), rows.alias("y")
    pair = "x.key = y.key AND x.component <> y.component AND (NOT y.other OR x.component < y.component) AND (x.hub IS NULL OR y.hub IS NULL OR x.hub <> y.hub) AND "
    rest = x.join(y, F.expr(pair + _able("x", "y", percent))).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))
    if groups.isEmpty():
        return rest.distinct()
    members = cut(lists.select("cls", "n", "p", "shared", "component").distinct().join(groups, "cls"))
    return rest.unionByName(differing(docs, width, known, members, bitmaps, percent)).distinct()


def identified(docs: DataFrame, width: int, known: Identity) -> DataFrame:
    """The checkpointed rows of `classes`, with classes that share an id renamed. The ids that meet are some
    N squared / 2^65 of N sets: none at a billion, some seventy at fifty billion. New ids have all 64 bits of both halves,
    so a round that leaves as many clashes as before means a fault, and ends the job."""
    before = None
    while True:
        found = cut(classes(docs, width, known))
        clash = found.filter("kind = 0 AND cls <> 0").groupBy("cls").agg(F.min("half").alias("lo"), F.max("half").alias("hi")).filter("lo <> hi").select("cls")
        clash = [r["cls"] for r in clash.collect()]
        if not clash:
            return found
        if before is not None and len(clash) >= before:
            raise RuntimeError(f"{len(clash)} class ids meet after renaming, {before} before")
        before = len(clash)
        known.renamed(clash)


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE, percent: int = PERCENT, bits: int = 64) -> DataFrame:
    """One row per row of `docs`: doc_id, cls (equal sets), n_shingles, component_id."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    known = Identity(bits)
    found = identified(docs, width, known)
    rows = found.filter("kind = 0").select("doc_id", "cls", "n")

    top = found.filter("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cls").limit(MOST_FREQUENT).toArrow()
    token, count = top.column("cls").to_numpy().astype(np.uint64), top.column("n").to_numpy()
    order = np.argsort(token)
    bitmaps = cut(found.filter("kind = 0 AND bits IS NOT NULL").select("cls", "n", "bits", "mark").dropDuplicates(["cls"]))
    # Sizes beyond 256 count as the power of two above them: at most 256 + 55 rows.
    sizes = {r["size"]: r["count"] for r in bitmaps.groupBy(F.expr("CASE WHEN n <= 256 THEN n ELSE shiftleft(1L, cast(ceil(log2(n)) AS int)) END").alias("size")).count().collect()}
    total = bitmaps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 1
    x = boundary(sizes, float(count.sum()) / total, float(count.mean()) if len(count) else 1.0, percent)

    grouped = Window.partitionBy("key")
    lists = prefixes(docs, width, percent, known, token[order], count[order], x)
    lists = lists.withColumns({"lo": F.min("cls").over(grouped), "hi": F.max("cls").over(grouped)}).filter("lo <> hi").drop("lo", "hi")
    # A set of the overlap zone has pairs and single tokens among its keys; what a pair shares bounds nothing there.
    shared = F.count(F.lit(1)).over(Window.partitionBy("cls"))
    bound = F.when(F.col("n") > x, shared).otherwise(F.col("n")).cast("int")
    size = F.when(F.col("n") > x, F.col("p")).otherwise(F.lit(0)).cast("int")
    lists = cut(lists.dropDuplicates(["key", "cls"]).select("key", "cls", "n", size.alias("p"), bound.alias("shared")))

    clear = F.struct((F.col("shared") - F.col("p")).alias("x"), F.col("shared").alias("s"), F.col("cls").alias("cls"), F.col("n").alias("n"), F.col("p").alias("p"))
    centres = lists.groupBy("key").agg(F.max(clear).alias("c")).select("key", F.col("c.cls").alias("cls"), F.col("c.n").alias("n"), F.col("c.p").alias("p"), F.col("c.s").alias("shared"))
    met = lists.alias("l").join(centres.alias("c"), F.expr("l.key = c.key AND l.cls <> c.cls AND " + _able("l", "c", percent)))
    stars = cut(met.select(F.col("l.cls").alias("cls"), F.col("c.cls").alias("centre")).groupBy("cls", "centre").agg(F.count(F.lit(1)).alias("times")))
    pair = lambda df: df.select(F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b")).distinct()
    best = cut(pair(stars.groupBy("cls").agg(F.max(F.struct("times", "centre")).alias("m")).select("cls", "m.centre")))
    links = verified(docs, width, known, best, bitmaps, percent)
    reached = cut(components(links))
    others = labelled(labelled(stars, reached, "cls", "own"), reached, "centre", "other").filter("own <> other")
    others = cut(pair(others).join(best, ["a", "b"], "left_anti"))
    if not others.isEmpty():
        more = verified(docs, width, known, others, bitmaps, percent)
        if not more.isEmpty():
            links = cut(links.unionByName(more))
            reached = cut(components(links))
    open_lists = mixed(lists, reached)
    rest = last_pairs(docs, width, known, open_lists, stars, reached, bitmaps, percent)
    rest = cut(rest.join(pair(stars), ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        last = verified(docs, width, known, rest, bitmaps, percent)
        if not last.isEmpty():
            reached = cut(components(links.unionByName(last)))

    # Nodes are a class's smallest doc_id (a class without any comes last), so a component's smallest one names it.
    node = F.struct(F.col("first").isNull().alias("none"), "first", "cls")
    named = cut(rows.filter("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("first")).select("cls", node.alias("node")))
    members = reached.withColumnRenamed("node", "cls").join(named, "cls")
    firsts = small(cut(members.groupBy("component").agg(F.min("node").alias("least"))))
    joined = members.join(firsts, "component").select("cls", "least")
    ids = named.join(joined, "cls", "left").select("cls", F.coalesce("least", "node").getField("first").alias("component_id"))
    out = rows.filter("cls <> 0").join(ids, "cls").select("doc_id", "cls", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.filter("cls = 0").select("doc_id", "cls", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of the smallest doc_id of each component, with all their columns. Rows without id stay, and so do rows that
    repeat the id that stays."""
    found = join(docs, text, key, width, percent).filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct()
    whole = docs.select(F.struct("*").alias("row"))
    return whole.join(small(cut(found)), F.col("row").getField(key) == F.col("gone"), "left_anti").select("row.*")
