"""Conversation prefix trie: leaf peeling by messages between nodes.

Conversations with the same first turns share nodes. A node is known by its depth and 128 bits: the exclusive or, over its
turns, of two hashes of the place and the SHA-256 of role and text, which a running total within a conversation gives for
all its prefixes at once. A node's address is its smallest member and its depth. Nodes of one smallest member form a chain
down to that conversation's last turn; the top of a chain hangs on a node of another one.

Peeling: every chain counts the children on other chains that its nodes still wait for. In each round the chains that wait
for none are complete: each sends its subtree's totals to the node it hangs on, messages to one node being added up on
the way, and goes; chains whose counters reach 0 are complete in the next round, until the root's alone is left and
finishes. Rounds are as many as chains that hang on one another, not as the trie is deep. What each node was sent, added up from the
end of its chain, gives its own totals.

No step holds a conversation or the members of a node in one task: turns are placed by a range partition, running totals
go by parts of PART turns, look-ups by a key that many rows share go by SALTS parts of it, and member lists are written as
texts of ids of neighbouring numbers, which the digests read in order.

Turns go by turn (null first), then by the SHA-256 of role and text; a null role or text becomes empty, and a turn that
repeats in full counts as often as it comes. Rows without conv_id take no part. An empty table has no node. Remainders have
the sign of the id, as in SQL. Extra columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.llm.common import cut, packed_in, released
from sparkmill.operators.ordering import running_total

#: Turns, or nodes of a chain, whose running totals one task makes.
PART = 4096
#: Parts that rows of one key are dealt to where they look something up.
SALTS = 64
#: Neighbouring ids whose text is one row.
NEIGHBOURS = 256
#: Conversations of one block exchange their first turns: fewer than HEAD of them.
BLOCK, HEAD = 100, 6


def zero() -> Column:
    return F.lit(0).cast("long")


def slim(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, turn, content, chars) of every turn with a conversation: SHA-256 of role and text, and the text's code points."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return turns.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).cast("long").alias("turn"), F.unhex(F.sha2(both, 256)).alias("content"), F.length(text).cast("long").alias("chars"))


def looked_up(rows: DataFrame, by: list[str], table: DataFrame) -> DataFrame:
    """The rows with the columns that `table` has for their key (each key once). What `table` holds for a key goes to the
    parts of the key that rows have, so no task gets all rows of one key."""
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns]), F.lit(SALTS)).alias("salt")
    rows = rows.select("*", salt)
    parts = rows.select(*by, "salt").distinct().join(table, by)
    return rows.join(parts, [*by, "salt"]).drop("salt")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, length) and turns (c, d, content, chars) after the exchange: the first h turns of the block's first
    conversation, then a conversation's own turns after its first h. `placed` has c, content, chars and upto."""
    first = placed.groupBy("c").agg((F.min("upto") - 1).alias("before"), F.count(F.lit(1)).alias("n"))
    first = first.select("c", "before", "n", (F.col("c") - F.col("c") % BLOCK).alias("s"), (F.crc32(F.col("c").cast("string")) % HEAD).alias("h"))
    lead = first.select(F.col("c").alias("s"), F.col("n").alias("lead"))
    convs = first.join(lead, "s", "left").withColumn("m", F.least("h", F.coalesce("lead", zero())))
    convs = cut(convs.select("c", "s", "before", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), zero())).alias("length")))
    ranked = looked_up(placed.select("c", "content", "chars", "upto"), ["c"], convs.select("c", "before", "h", "m")).withColumn("rank", F.col("upto") - F.col("before"))
    ranked = cut(ranked.select("c", "rank", "h", "m", "content", "chars"))
    own = ranked.filter("rank > h").select("c", (F.col("rank") - F.col("h") + F.col("m")).alias("d"), "content", "chars")
    heads = ranked.filter((F.col("c") % BLOCK == 0) & (F.col("rank") < HEAD)).select(F.col("c").alias("s"), F.col("rank").alias("d"), "content", "chars")
    lent = convs.filter("m > 0").select("c", "s", "m").join(heads, "s").filter("d <= m").select("c", "d", "content", "chars")
    return convs.select("c", "length"), own.unionByName(lent)


def scanned(rows: DataFrame, key: str, at: str, values: dict[str, Column], total, falling: bool = False) -> DataFrame:
    """The rows with running totals (an aggregate such as F.sum or F.bit_xor) of `values` along `at` within each key, in
    parts of PART places; totals of whole parts are added to the parts after them."""
    rows = rows.withColumn("part", F.floor(F.col(at) / PART) * (-1 if falling else 1))
    inside = Window.partitionBy(key, "part").orderBy(F.desc(at) if falling else F.asc(at)).rowsBetween(Window.unboundedPreceding, 0)
    here = cut(rows.select("*", *[total(v).over(inside).alias(f"{n}_in") for n, v in values.items()]))
    kept = [c for c in rows.columns if c != "part"]
    wide = here.filter("part <> 0").select(key).distinct()
    if wide.isEmpty():  # no key has a second part
        return here.select(*kept, *[F.col(f"{n}_in").alias(n) for n in values])
    ends = F.max_by(F.struct(*[F.col(f"{n}_in").alias(n) for n in values]), -F.col(at) if falling else F.col(at))
    parts = here.join(wide, key, "left_semi").groupBy(key, "part").agg(ends.alias("end"))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    carried = parts.select(key, "part", *[total(F.col(f"end.{n}")).over(earlier).alias(f"{n}_before") for n in values])
    plus = (lambda a, b: a.bitwiseXOR(b)) if total is F.bit_xor else (lambda a, b: a + b)
    return here.join(carried, [key, "part"], "left").select(*kept, *[plus(F.col(f"{n}_in"), F.coalesce(F.col(f"{n}_before"), zero())).alias(n) for n in values])


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, d, chars, x, y, px, py): for each rebuilt turn, the hashes of the prefix that it ends and of the one before it."""
    lane = lambda k: F.xxhash64(F.lit(k), "d", "content", F.lit(~k))
    rows = turns.select("c", "d", "chars", lane(1).alias("u"), lane(2).alias("v"))
    rows = scanned(rows, "c", "d", {"x": F.col("u"), "y": F.col("v")}, F.bit_xor)
    return rows.select("c", "d", "chars", "x", "y", F.col("x").bitwiseXOR(F.col("u")).alias("px"), F.col("y").bitwiseXOR(F.col("v")).alias("py"))


def tree(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes: d, x, y, conv (smallest member), n members, chars of the last turn, and the parent's hashes px, py."""
    inner = rows.groupBy("d", "x", "y").agg(F.min("c").alias("conv"), F.count(F.lit(1)).alias("n"), F.min("chars").alias("chars"), F.min("px").alias("px"), F.min("py").alias("py"))
    root = convs.agg(F.min("c").alias("conv"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    return root.select(zero().alias("d"), zero().alias("x"), zero().alias("y"), "conv", "n", zero().alias("chars"), zero().alias("px"), zero().alias("py")).unionByName(inner)


def chains(nodes: DataFrame) -> DataFrame:
    """(conv, bottom, saved, up, up_d): each chain's last depth, its own savings, and the node that its top hangs on."""
    top = F.min(F.struct("d", "px", "py")).alias("top")
    own = nodes.groupBy("conv").agg(top, F.max("d").alias("bottom"), F.sum((F.col("n") - 1) * F.col("chars")).alias("saved"))
    own = cut(own.select("conv", "bottom", "saved", (F.col("top.d") - 1).alias("d"), F.col("top.px").alias("x"), F.col("top.py").alias("y")))
    hung = looked_up(own.filter("d >= 0"), ["d", "x", "y"], nodes.select("d", "x", "y", F.col("conv").alias("up")))
    hung = hung.select("conv", "bottom", "saved", "up", F.col("d").alias("up_d"))
    none = F.lit(None).cast("long")
    return hung.unionByName(own.filter("d < 0").select("conv", "bottom", "saved", none.alias("up"), none.alias("up_d")))


def peeled(chain: DataFrame) -> DataFrame:
    """The messages (conv, d, children, leaves, saved) that each node with children on other chains has been sent."""
    waits = chain.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv"), F.col("up_d").alias("d")).agg(F.count(F.lit(1)).alias("k"))
    of_chain = waits.groupBy("conv").agg(F.sum("k").alias("waiting"), F.max("d").alias("deepest"))
    state = chain.join(of_chain, "conv", "left")
    # A chain's last node is a leaf unless another chain hangs on it.
    leaf = F.when(F.col("deepest") == F.col("bottom"), zero()).otherwise(F.lit(1).cast("long"))
    state = cut(state.select("conv", "up", "up_d", F.coalesce("waiting", zero()).alias("waiting"), leaf.alias("leaves"), "saved"))
    sent = []
    rows = state.count()
    while rows:
        complete = state.filter("waiting = 0")
        parcel = cut(complete.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv"), F.col("up_d").alias("d")).agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).coalesce(packed_in(rows)))
        sent.append(parcel)
        got = parcel.groupBy("conv").agg(F.sum("children").alias("children"), F.sum("leaves").alias("more"), F.sum("saved").alias("plus"))
        state = state.filter("waiting > 0").join(got, "conv", "left")
        add = lambda a, b: (F.col(a) + F.coalesce(b, zero())).alias(a)
        state = cut(state.select("conv", "up", "up_d", (F.col("waiting") - F.coalesce("children", zero())).alias("waiting"), add("leaves", "more"), add("saved", "plus")).coalesce(packed_in(rows)))
        left = state.count()
        if left == rows:
            raise RuntimeError("no chain is complete, yet some are left")
        rows = left
    if not sent:
        return chain.select("conv", F.col("bottom").alias("d"), zero().alias("children"), zero().alias("leaves"), "saved").limit(0)
    messages = sent[0]
    for parcel in sent[1:]:
        messages = messages.unionByName(parcel)
    return messages.groupBy("conv", "d").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, which come in order: rows d, x, y, nearby, piece."""
    names = ["d", "x", "y", "ends_sha256"]
    node, state = None, None
    for b in batches:
        out = []
        keys = list(zip(*[b.column(k).to_pylist() for k in range(3)], strict=True))
        for key, piece in zip(keys, b.column(4).to_pylist(), strict=True):
            if key != node:
                if state is not None:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, state.hexdigest())], names)


def end_digests(ends: DataFrame) -> DataFrame:
    """(d, x, y, ends_sha256) of the nodes that conversations (c, d, x, y) end at."""
    nearby = F.floor(F.col("c") / NEIGHBOURS).alias("nearby")
    pieces = ends.groupBy("d", "x", "y", nearby).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("piece"))
    return pieces.repartition("d", "x", "y").sortWithinPartitions("d", "x", "y", "nearby").mapInArrow(released(_hashed), "d long, x long, y long, ends_sha256 string")


def build(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each node of the trie of rebuilt conversations."""
    thin = slim(turns, conv, turn, role, text)
    placed = running_total(thin, ["c", "turn", "content", "chars"])
    convs, found = rebuilt(placed)
    rows = cut(prefixes(found))
    nodes = cut(tree(convs, rows))
    chain = cut(chains(nodes))
    messages = peeled(chain)

    own = nodes.join(messages, ["conv", "d"], "left").select(*nodes.columns, *[F.coalesce(c, zero()).alias(c) for c in ("children", "leaves", "saved")])
    bottom = chain.select("conv", "bottom", "up", "up_d")
    own = looked_up(own, ["conv"], bottom)
    last = F.col("d") == F.col("bottom")
    leaf = F.when(last & (F.col("children") == 0), F.lit(1).cast("long")).otherwise(zero())
    own = own.withColumn("inner", (~last).cast("long"))
    total = scanned(own.withColumnsRenamed({"leaves": "sent_leaves", "saved": "sent_saved"}), "conv", "d", {"n_leaves": F.col("sent_leaves") + leaf, "saved_tokens": F.col("sent_saved") + (F.col("n") - 1) * F.col("chars")}, F.sum, falling=True)
    ends = rows.join(convs, (rows.c == convs.c) & (F.col("d") == F.col("length"))).select(rows.c, "d", "x", "y")
    ends = ends.unionByName(convs.filter("length = 0").select("c", zero().alias("d"), zero().alias("x"), zero().alias("y")))
    out = total.join(end_digests(ends), ["d", "x", "y"], "left")
    parent = F.when(F.col("d") == F.col("up_d") + 1, F.col("up")).when(F.col("d") > 0, F.col("conv"))
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), parent.alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.col("children") + F.col("inner")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
