import hashlib
import random
import re
import struct
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402


def test_stages_against_brute_force(spark, tmp_path):
    import zlib

    from tokenizers import Tokenizer

    from sparkmill.llm.queries import tokenizer_path

    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    clean = lambda n=80: " ".join(r.choice(["the", "and", "of", word(), word()]) for _ in range(n))
    base = clean(120).split()
    near = [" ".join(w if k != at else word() for k, w in enumerate(base)) for at in (3, 60, 100)]
    good = [clean() for _ in range(6)]
    texts = [None, "", "too short", *good, good[0] + " ", good[1].replace(" ", "  "), *near, "### $$$ " * 60, "the same words again " * 40, clean() + " mail me@here.example.com or +1 (22) 333-4444 at 10.0.0.1", clean(3000)]
    rows = [(k, t, "en", "s", len(t or ""), "x") for k, t in enumerate(texts)] + [(3, texts[3], "en", "s", len(texts[3]), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    kept = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]
        kept.append(sorted((x.doc_id, x.text) for x in docs.collect()))
    junk = {k for k, t in enumerate(texts) if t is None or len(t.split()) < 50 or "###" in t or "same words" in t}
    assert {k for k, _ in kept[0]} == set(range(len(texts))) - junk and len(kept[0]) == len(texts) - len(junk) + 1

    groups = defaultdict(list)
    for k, t in {(k, t) for k, t in kept[0]}:
        groups["".join(t.split())].append((-len(t), k))
    assert [k for k, _ in kept[1]] == sorted(min(own)[1] for own in groups.values())

    left = dict(kept[1])
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in left.items() if (w := t.lower().split())}
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert [k for k, _ in kept[2]] == sorted(set(root.values()))

    mail = next(k for k, t in enumerate(texts) if t and "me@here" in t)
    for (k, before), (same, after) in zip(kept[2], kept[3], strict=True):
        assert k == same and (after == before if k != mail else after == re.sub(r" mail .*", " mail [EMAIL] or [PHONE] at [IP]", before))

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {k: [*t.encode(x, add_special_tokens=False).ids, 2] for k, x in kept[3]}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == set(want)
    bins = defaultdict(int)
    for x in packed:
        own = want[x.doc_id][x.start : x.start + x.length]
        assert x.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own)) and len(own) == x.length
        bins[x.sequence_id] += x.length
    assert max(bins.values()) <= 1024 and sum(bins.values()) == sum(map(len, want.values()))


def char_map(entries):
    """The compiled character map of a few entries: a double array laid out by trying one block after the other."""
    strings, places = b"", {}
    for key, new in entries.items():
        places[key.encode()] = len(strings)
        strings += new.encode() + b"\0"
    units, taken = [0] * 65536, {0}

    def lay(node, prefix):
        labels = {k[len(prefix)] for k in places if k.startswith(prefix) and len(k) > len(prefix)}
        leaf = prefix in places
        base = next(b for b in range(256, 65536, 256) if not any(b ^ c in taken for c in [*labels, *([0] if leaf else [])]))
        taken.update(base ^ c for c in [*labels, *([0] if leaf else [])])
        units[node] |= (node ^ base) << 10 | leaf << 8
        if leaf:
            units[base] = places[prefix] | 1 << 31
        for c in sorted(labels):
            units[base ^ c] = c
            lay(base ^ c, prefix + bytes([c]))

    lay(0, b"")
    used = -(-(max(taken) + 1) // 256) * 256
    return struct.pack("<I", 4 * used) + struct.pack(f"<{used}I", *units[:used]) + strings


def test_codec_with_a_character_map(spark, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    from sparkmill.llm import sentencepiece_codec
    from sparkmill.llm.queries import tokenizer_path

    model = pb.ModelProto()
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.precompiled_charsmap = char_map({"Ａ": "A", "ﬁ": "fi", "½": "1/2", "é": "e", "éa": "ea!", "\t": " ", "­": ""})
    r = random.Random(32)
    for trim in (False, True):
        model.normalizer_spec.remove_extra_whitespaces = trim
        path = tmp_path / f"{trim}.model"
        path.write_bytes(model.SerializeToString())
        library, codec = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepiece_codec.Codec(str(path))
        texts = ["", "ＡﬁnЖ", "éa é a\tb", *["".join(r.choice(["Ａ", "ﬁ", "½", "é", "a", "b", " ", "\t", "­", "日", "the "]) for _ in range(r.randint(1, 30))) for _ in range(200)]]
        got = {x.doc_id: x for x in sentencepiece_codec.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(path)).collect()}
        for k, t in enumerate(texts):
            ids = library.encode(t)
            assert [x for x, _, _ in codec.encode(t)] == ids, t
            assert got[k].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids) + 2}I", 1, *ids, 2)).hexdigest()
            assert got[k].decoded_sha256 == hashlib.sha256(library.decode([1, *ids, 2]).encode()).hexdigest()
            ends = [(a, b) for _, a, b in codec.encode(t)]
            assert all(0 <= a <= b <= len(t.encode()) for a, b in ends) and ends == sorted(ends)
