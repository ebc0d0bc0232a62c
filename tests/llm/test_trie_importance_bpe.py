import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from sparkmill.llm import bytelevel_bpe, conversation_trie, importance

TURNS = "conv_id long, turn long, role string, text string, depth string"
DOCS = "doc_id long, text string, score string, rank string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def trie(rows):
    """The trie's nodes by brute force."""
    own = {}
    for c, turn, role, text, _ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    first = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in first.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(first.get(c - c % 100, [])[:h] + turns[h:])
    members, children, sums, out = {}, {}, {}, []
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        sums[node] = sum(sums[x][0] for x in below) if below else 1, saved + sum(sums[x][1] for x in below)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(made[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: x[:2])


def built(spark, rows):
    return sorted(map(tuple, conversation_trie.build(spark.createDataFrame(rows, TURNS)).collect()), key=lambda x: x[:2])


@pytest.mark.parametrize("part", [4096, 2])
def test_trie_against_brute_force(spark, monkeypatch, part):
    """Nulls, ties, repeated rows, missing first conversations, turnless ones, a long one, and parts of two turns."""
    monkeypatch.setattr(conversation_trie, "PART", part)
    r, rows = random.Random(1), [(None, 0, "user", "lost", "x")]
    for c in [*range(8), 100, 101, 150, 205, 300, 302, 7000, 7001]:
        for t in range(r.choice([0, 1, 2, 3, 5, 7]) + (c == 300) * 9):
            rows.append((c, None if r.random() < 0.1 else t, r.choice(["user", None]), r.choice(["a", "aé", "", None]), "x"))
    rows += rows[:6]
    assert built(spark, rows) == trie(rows)


def test_trie_of_one_hot_conversation_and_of_copies(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PART", 64)
    monkeypatch.setattr(conversation_trie, "NEIGHBOURS", 8)
    rows = [(1000, t, "user", f"t{t % 7} " + "long " * 2000 * (t == 3), None) for t in range(400)]
    rows += [(c, t, "user", f"same {t}", None) for c in range(2000, 2090) for t in range(4)]
    assert built(spark, rows) == trie(rows)
    assert built(spark, []) == []


def drawn(docs, target, buckets, width, percent, least):
    """The resampling by brute force."""
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def used(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(upper))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, width + 1) for i in range(len(w) - k + 1)]

    found, aim = [used(t) for _, t in docs], [b for t in target for b in used(t)[1]]
    s, t = (np.bincount(np.array(x, int), minlength=buckets) for x in ([b for _, f in found for b in f], aim))
    gain = [math.floor(1000 * math.log(float(int(b) + 1) * float(int(s.sum()) + buckets) / (float(int(a) + 1) * float(int(t.sum()) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for (doc, _), (n, f) in zip(docs, found, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    order = sorted((x for x in rows if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    ranks = {}
    for place, x in enumerate(order[: len(order) * percent // 100]):
        ranks.setdefault(id(x), place + 1)
    return sorted(((*x[:4], ranks.get(id(x))) for x in rows), key=repr)


@pytest.mark.parametrize(("width", "percent", "buckets"), [(1, 10, 10_000), (3, 60, 50)])
def test_importance_against_brute_force(spark, width, percent, buckets):
    r = random.Random(2)
    some = ["Alpha", "beta", "ünï", "中文", "x" * 60, "9", "be_ta", "\u0001", "delta-echo", "\n", "Ω"]
    docs = [(k, " ".join(r.choice(some) for _ in range(r.randint(0, 40)))) for k in range(150)]
    docs += [(200, None), (201, ""), (202, " .,-"), (203, "long" * 50_000), (204, "many " * 20_000), (None, "alpha " * 30), docs[3], docs[3]]
    target = ["alpha beta gamma", None, "", "delta " * 5]
    got = importance.resample(spark.createDataFrame([(*x, "clash", "clash") for x in docs], DOCS), spark.createDataFrame([(x,) for x in target], "text string"), buckets, width, percent, 5)
    assert sorted(map(tuple, got.collect()), key=repr) == drawn(docs, target, buckets, width, percent, 5)


def test_importance_of_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c", "", "")], DOCS)
    assert importance.resample(none, some).collect() == []
    assert [x.weight for x in importance.resample(some, none, least_words=1, percent=100).collect()] == [3 * math.floor(1000 * math.log(10_003 / (2 * 10_000)))]


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def mixed_texts():
    r = random.Random(3)
    some = ["a", "b", "s", "t", "re", "ve", "ll", "l", "r", "v", "e", "m", "d", "'", "'", " ", " ", "\n", "\t", "1", "2", "!", "é", "ß", "中", " ", "　", "٣", "😀", "é", "S", "\x00", "\x1c", " ", "Ⅷ", "Ᲊ"]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    return [None, "", *texts, "ab" * 40_000 + " " * 300, "'" * 99 + "s", "x" * 49, " " * 100, "\n" * 77 + "a", "it's we'll they've 'tis ''s 'llo"]


def test_bytelevel_bpe_against_the_library(spark, encoding):
    texts = mixed_texts()
    texts += texts[5:9]
    docs = spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens string")
    coded = bytelevel_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    digests = {x.doc_id: x for x in bytelevel_bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    back = {x.doc_id: bytes(x.bytes) for x in bytelevel_bpe.decode(coded, RANKS).collect()}
    for x in coded.collect():
        text = texts[x.doc_id] or ""
        ids, raw = encoding.encode_ordinary(text), text.encode()
        assert x.ids == ids and back[x.doc_id] == raw
        pieces = [encoding.decode_single_token_bytes(i) for i in ids]
        assert all(raw[a : a + len(p)] == p for a, p in zip(x.starts, pieces, strict=True))
        d = digests[x.doc_id]
        assert (d.n_tokens, d.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert d.decoded_sha256 == hashlib.sha256(raw).hexdigest()
    assert len(back) == len(digests) == len(texts)
    assert bytelevel_bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
    assert bytelevel_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), RANKS).first().bytes == b""
    with pytest.raises(Exception, match="vocabulary does not hold"):
        bytelevel_bpe.decode(spark.createDataFrame([(1, [7, 10**6])], "doc_id long, ids array<int>"), RANKS).collect()


def test_slices_against_the_pattern():
    import regex

    known = bytelevel_bpe.code_point_classes(public_tokenizers.PATTERN)
    for text in mixed_texts():
        text = (text or "").replace("Ᲊ", "")  # a letter that not every Unicode table has yet
        raw = text.encode()
        want = [len(text[: m.start()].encode()) for m in regex.finditer(public_tokenizers.PATTERN, text)] if len(text) < 1000 else None
        got = bytelevel_bpe.slices(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), known).tolist()
        assert want is None or got == want


def test_transitions_are_associative():
    t = bytelevel_bpe.transitions()
    n = len(t.acts)
    a, b, c = np.meshgrid(*[np.arange(n)] * 3)
    assert (t.compose[t.compose[a, b], c] == t.compose[a, t.compose[b, c]]).all()
    r = np.random.default_rng(4)
    for size in (1, 63, 64, 65, 5000):
        functions = r.choice(t.single, size)
        state, want = 0, []
        for f in functions:
            state = t.acts[f, state]
            want.append(state)
        assert t.states(functions).tolist() == want


def test_merging_together_and_by_heap():
    held = bytelevel_bpe.ranks(RANKS)
    r = random.Random(5)
    for size in range(2, 30):
        raw = [bytes(r.choice(b"aeinrst e\xc3\xa9") for _ in range(size)) for _ in range(40)]
        table = held.bytes[np.frombuffer(b"".join(raw), np.uint8)].reshape(len(raw), size)
        assert held.together(table) == [held.heaped(x) for x in raw]
