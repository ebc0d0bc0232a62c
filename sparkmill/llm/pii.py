"""PII by bootstrapped contextual extraction, in DataFrame and SQL functions alone.

Seeds are the identifiers that fixed expressions find. The words around a seed induce lexical patterns; patterns and
instances form a bipartite graph that Spark scores round by round: a pattern's confidence is the share of its distinct
instances that are known, an instance is promoted where patterns of high confidence (CONFIDENCE) and enough known
instances (SUPPORT) point at it, and a promoted instance counts as known in the next round, until a round promotes
nothing. Promoted instances become further spans; seeds always stay. Candidates are tokens between white space, and runs
of digit groups joined by single spaces, dots, dashes or parentheses; a run is taken whole, with any number that stands
next to it.

Positions are code points, found by splitting a text at its matches: a match starts after all gaps and matches before
it. Their sums are folded in blocks, and contexts come from the gaps, so the work is linear in the text. A pattern holds
whole words, however long; it reaches back over two matches of the expression and on over one, and what is glued to
the far one is not part of it.

A null text counts as empty and has no spans; texts are taken whole. Rows that repeat get equal results, ids that repeat
with other texts their own. An empty table gives an empty result. Extra columns pass through `redact`, whatever their
names; `report` returns its own columns.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.llm.common import cut, small, text_or_empty

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 5
CONFIDENCE = 0.8
#: Promoted spans up to this number are broadcast (some 50 bytes each); more are joined by a shuffle.
BROADCAST_SPANS = 200_000
#: Entries of an array that are folded together; the folds of such blocks are folded in turn.
BLOCK = 256
#: Code points of the blocks that a text is cut into before its spans are replaced.
CUT = 1024

# The four base expressions. Possessive quantifiers keep Java's matcher from recursing; a look-behind (or
# the end of the last match) starts an address where its run of characters starts, so that long runs take linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IDENTIFIER = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Runs of digit groups, joined by a space, dot, dash or parenthesis.
GROUPS = r"(?<![0-9])\+?\(?[0-9]++(?:(?:\)[\x20.-]?|[\x20.-]?\(|[\x20.-])[0-9]++)++"

_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_LUHN = (
    "aggregate(sequence(1, length(d)), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN int(substr(d, -i, 1)) "
    "WHEN int(substr(d, -i, 1)) > 4 THEN 2 * int(substr(d, -i, 1)) - 9 ELSE 2 * int(substr(d, -i, 1)) END) % 10 = 0"
)

_INTS = "array<int>"
_PLAIN = "struct<rank:int,kind:string,start:int,end:int>"


def running(values: str, combine: str) -> str:
    """SQL for the fold of all entries before each entry of an array of int, from 0; `combine` joins {a} and {b}."""
    f = lambda a, b: combine.format(a=a, b=b)
    block = f"aggregate(slice(v, {BLOCK} * b + 1, {BLOCK}), named_struct('at', 0, 'out', cast(array() AS {_INTS})), (a, x) -> named_struct('at', {f('a.at', 'x')}, 'out', array_append(a.out, a.at)))"
    blocks = f"transform(sequence(0, cast((size(v) - 1) div {BLOCK} AS int)), b -> {block})"
    whole = f"aggregate({blocks}, named_struct('at', 0, 'out', cast(array() AS array<{_INTS}>)), (a, y) -> named_struct('at', {f('a.at', 'y.at')}, 'out', array_append(a.out, transform(y.out, x -> {f('a.at', 'x')}))), a -> flatten(a.out))"
    return f"get(transform(array({values}), v -> CASE WHEN size(v) = 0 THEN cast(array() AS {_INTS}) ELSE {whole} END), 0)"


def _matched(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Adds for each expression the texts between its matches (g_), the matches (m_) and where each gap starts (p_)."""
    digit = F.col("text").rlike("[0-9]")
    found = {
        "email": (EMAIL, F.col("text").contains("@")), "ip": (IP, digit & F.col("text").contains(".")), "card": (CARD, digit), "phone": (PHONE, digit & F.col("text").contains("+")),
        "token": (IDENTIFIER, F.lit(True)), "run": (GROUPS, F.col("text").rlike(r"[0-9][\x20().-]")),
    }
    none = F.array().cast("array<string>")
    for n in names:
        regex, trigger = found[n]
        df = df.withColumns({f"g_{n}": F.when(trigger, F.split("text", regex, -1)).otherwise(none), f"m_{n}": F.when(trigger, F.regexp_extract_all("text", F.lit(regex), F.lit(0))).otherwise(none)})
    return df.withColumns({f"p_{n}": F.expr(running(f"transform(m_{n}, (x, i) -> length(g_{n}[i]) + length(x))", "{a} + {b}")) for n in names})


# What holds of a match `x`; a failing match is dropped and not tried again.
_HOLDS = {
    "email": "true",
    "ip": rf"x RLIKE r'^{_PART}\.{_PART}\.{_PART}\.{_PART}$'",
    "card": f"exists(array(regexp_replace(x, '[^0-9]', '')), d -> CASE WHEN length(d) BETWEEN 16 AND 19 THEN {_LUHN} ELSE false END)",
    "phone": "length(regexp_replace(x, '[^0-9]', '')) BETWEEN 8 AND 15",
}


def _held(n: str) -> str:
    """Places of the matches of an expression that hold."""
    holds = _HOLDS.get(n, "true")
    return f"filter(transform(m_{n}, (x, i) -> CASE WHEN {holds} THEN i END), i -> i IS NOT NULL)"


def _spans(n: str, rank: int) -> str:
    start = f"p_{n}[i] + length(g_{n}[i])"
    return f"transform({_held(n)}, i -> named_struct('rank', {rank}, 'kind', '{n}', 'start', {start}, 'end', {start} + length(m_{n}[i])))"


def base_spans(df: DataFrame) -> DataFrame:
    """Adds `base` to rows with a text: (rank of kind, kind, start, end), by kind as listed, then start."""
    own = df.columns
    df = _matched(df, KINDS)
    return df.select(*own, F.expr(f"concat({', '.join(_spans(n, k) for k, n in enumerate(KINDS))})").cast(f"array<{_PLAIN}>").alias("base"))


_KIND = """CASE WHEN rank < 4 THEN element_at(array('email', 'ip', 'card', 'phone'), rank + 1)
 WHEN value RLIKE '[^@]@[^@]' THEN 'email' WHEN value RLIKE '^[^0-9]*[0-9]+([.][0-9]+)+[^0-9]*$' AND digits >= 4 THEN 'ip'
 WHEN digits BETWEEN 14 AND 19 AND value RLIKE '^[^A-Za-z]*$' THEN 'card' WHEN digits BETWEEN 7 AND 13 AND value RLIKE '^[^A-Za-z]*$' THEN 'phone' END"""
_WORD, _GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def _around(n: str, rank: int) -> str:
    """The matches of an expression that hold, with the text before and behind, cut down to the words that count."""
    at = lambda array, i: f"coalesce(get({array}, {i}), '')"
    near = lambda array, i, end: f"coalesce(get({array}, {i}).{end}, '')"
    left = f"concat({at(f'm_{n}', 'i - 2')}, {near(f'c_{n}', 'i - 1', 'tail')}, {at(f'm_{n}', 'i - 1')}, {near(f'c_{n}', 'i', 'tail')})"
    right = f"concat({near(f'c_{n}', 'i + 1', 'head')}, {at(f'm_{n}', 'i + 1')}, {near(f'c_{n}', 'i + 2', 'head')})"
    start = f"p_{n}[i] + length(g_{n}[i])"
    return f"transform({_held(n)}, i -> named_struct('rank', {rank}, 'start', {start}, 'end', {start} + length(m_{n}[i]), 'value', m_{n}[i], 'left', lower({left}), 'right', lower({right})))"


def occurrences(df: DataFrame) -> DataFrame:
    """Seeds and candidates of rows (id, text, mark) with their contexts: id, mark, start, end, kind, instance, seed, patterns."""
    names = (*KINDS, "token", "run")
    df = _matched(df.filter(F.col("text").rlike("[0-9@]")), names)
    ends = "struct(array_join(slice(w, 1, 3), ' ') AS head, array_join(slice(w, greatest(1, size(w) - 3), 4), ' ') AS tail)"
    df = df.withColumns({f"c_{n}": F.expr(f"transform(CASE WHEN size(m_{n}) > 0 THEN transform(g_{n}, x -> split(x, r'{_GAP}')) END, w -> {ends})") for n in names})
    # The row number keeps the filter that comes with `inline` above this projection, which would be computed twice.
    df = df.select("id", "mark", F.expr(f"concat({', '.join(_around(n, k) for k, n in enumerate(names))})").alias("all"), F.monotonically_increasing_id().alias("place"))
    rows = df.filter("place >= 0").select("id", "mark", F.inline("all"))
    rows = rows.withColumn("digits", F.length(F.regexp_replace("value", "[^0-9]", ""))).withColumn("kind", F.expr(_KIND)).filter("kind IS NOT NULL")
    trimmed = F.regexp_replace("value", "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    rows = rows.withColumn("instance", F.lower(F.when(F.col("rank") < 4, F.col("value")).otherwise(trimmed))).filter("instance <> ''")
    l1, l2 = F.regexp_extract("left", f"({_WORD})[\\x20\\x09-\\x0D]*$", 1), F.regexp_extract("left", f"({_WORD}){_GAP}{_WORD}[\\x20\\x09-\\x0D]*$", 1)
    r1 = F.regexp_extract("right", f"^[^\\x20\\x09-\\x0D]*{_GAP}({_WORD})", 1)
    patterns = F.array(F.concat_ws(" ", F.lit("<"), l2, l1), F.concat_ws(" ", F.lit("<>"), l1, r1))
    rows = rows.select("id", "mark", "rank", "start", "end", "kind", "instance", patterns.alias("patterns"))
    # A candidate that meets a seed goes, and so does a run within a candidate token.
    text = Window.partitionBy("id", "mark")
    up, down = text.orderBy("start").rangeBetween(Window.unboundedPreceding, 0), text.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    seed = F.col("rank") < 4
    rows = rows.withColumns({"before": F.max(F.when(seed, F.col("end"))).over(up), "next": F.min(F.when(seed, F.col("start"))).over(down)})
    rows = rows.filter("rank < 4 OR (coalesce(before, 0) <= start AND coalesce(next, end) >= end)")
    rows = rows.withColumn("held", F.max(F.when(F.col("rank") == 4, F.col("end"))).over(up)).filter("rank < 5 OR coalesce(held, 0) < end")
    return rows.select("id", "mark", "start", "end", "kind", "instance", seed.alias("seed"), "patterns")


def promoted(found: DataFrame, rounds: int | None = None, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame | None:
    """(kind, instance) that contexts promote, or None; every round counts distinct instances of all patterns.

    Rounds go on until one promotes nothing (known instances only grow, so they end), or for as many as `rounds` names.
    """
    edges = cut(found.select("kind", "instance", "seed", F.explode("patterns").alias("pattern")).groupBy("kind", "instance", "pattern").agg(F.max("seed").alias("seed")))
    known = edges.filter("seed").select("kind", "instance").distinct()
    added = None
    for _ in count() if rounds is None else range(rounds):
        marked = edges.join(known.withColumn("hit", F.lit(1)), ["kind", "instance"], "left")
        scored = marked.groupBy("kind", "pattern").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count(F.lit(1)).alias("all"))
        good = scored.filter((F.col("hits") >= support) & (F.col("hits") >= confidence * F.col("all")) & (F.col("hits") < F.col("all")))
        new = edges.join(good, ["kind", "pattern"]).join(known, ["kind", "instance"], "left_anti").select("kind", "instance").distinct()
        new = cut(new)
        if new.isEmpty():
            break
        known = cut(known.unionByName(new))
        added = new if added is None else cut(added.unionByName(new))
    return added


def annotate(df: DataFrame, text: str = "text", key: str = "doc_id", rounds: int | None = None) -> DataFrame:
    """row (the whole input row), id, text, and base and spans, arrays of (rank, kind, start, end); spans holds the base and
    what the method adds."""
    whole = df.select(F.struct("*").alias("row"), F.col(key).alias("id"), text_or_empty(text).alias("text"))
    marked = whole.withColumn("mark", F.sha2("text", 256))
    found = cut(occurrences(marked.select("id", "text", "mark")))
    added = promoted(found, rounds)
    if added is None:
        return base_spans(whole).withColumn("spans", F.col("base"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    extra = found.filter("not seed").join(added, ["kind", "instance"], "left_semi")
    extra = extra.groupBy(F.col("id").alias("xid"), F.col("mark").alias("xmark")).agg(F.collect_set(F.struct(rank.alias("rank"), "kind", "start", "end")).alias("extra"))
    extra = small(cut(extra), BROADCAST_SPANS, F.size("extra"))
    out = base_spans(marked).join(extra, F.col("id").eqNullSafe(F.col("xid")) & (F.col("mark") == F.col("xmark")), "left")
    return out.select("row", "id", "text", "base", F.array_sort(F.concat("base", F.coalesce(F.col("extra").cast(f"array<{_PLAIN}>"), F.array().cast(f"array<{_PLAIN}>")))).alias("spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    out = annotate(df, text, key)
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(F.col("id").alias("doc_id"), *[number(k) for k in KINDS], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows, each span of the text replaced by its kind in brackets; overlapping spans become one."""
    out = annotate(df, text, key).withColumn("s", F.array_sort(F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["kind"]))))
    out = out.withColumn("at", F.expr(running("transform(s, x -> x.end)", "greatest({a}, {b})")))
    out = out.withColumn("parts", F.when(F.size("s") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))))
    piece = lambda a, b: f"substring(array_join(slice(parts, cast({a} div {CUT} AS int) + 1, cast({b} div {CUT} - {a} div {CUT} AS int) + 1), ''), {a} % {CUT} + 1, {b} - {a})"
    pieces = f"transform(s, (x, i) -> CASE WHEN x.start >= at[i] THEN concat({piece('at[i]', 'x.start')}, '[', upper(x.kind), ']') ELSE '' END)"
    last = "array_max(transform(s, x -> x.end))"
    body = F.expr(f"concat(array_join({pieces}, ''), {piece(last, 'length(text)')})")
    changed = F.when(F.size("s") > 0, body).otherwise(F.col("row").getField(text))
    out = out.withColumn("changed", changed)
    return out.select(*[(F.col("changed") if c == text else F.col("row").getField(c)).alias(c) for c in df.columns])
