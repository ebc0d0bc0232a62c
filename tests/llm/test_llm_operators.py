import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparkmill.llm import bestfit_packing, exact_dedup, ngram_join, pii, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup, toxicity, url_filters
from sparkmill.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, n_words string"


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(k, t, None, "clash") for k, t in enumerate(texts)], schema)


def test_longest_factors_against_brute_force():
    r = random.Random(1)
    for _ in range(200):
        texts = ["".join(r.choice("ab") for _ in range(6)).encode() for _ in range(r.randint(1, 12))]
        places = r.sample(range(100), len(texts))
        order = sorted(range(len(texts)), key=texts.__getitem__)
        lcp = [0] + [next((i for i in range(6) if texts[a][i] != texts[b][i]), 6) for a, b in zip(order, order[1:])]
        lpf, lnf = suffix_dedup.longest_factors(np.array(order), np.array(lcp), np.array(places))
        for k, t in enumerate(texts):
            def reach(other):
                return next((i for i in range(6) if t[i] != other[i]), 6)
            assert lpf[k] == max([reach(u) for j, u in enumerate(texts) if places[j] < places[k]], default=0)
            assert lnf[k] == max([reach(u) for j, u in enumerate(texts) if places[j] > places[k]], default=0)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_suffix_dedup(spark, keep):
    r = random.Random(2)
    base = ["".join(r.choice("abcdefgh ") for _ in range(700)) for _ in range(4)]
    texts = [base[0] + base[1], base[1][100:] + "x" + base[2], base[2], base[3], base[3], None, "", base[0][:399], base[3], "z" * 900]
    texts += [base[0][150:600] + str(k) * k for k in range(8)]
    got = {x.doc_id: x for x in suffix_dedup.remove(frame(spark, texts), keep=keep, kept_text=True).collect()}
    seen = defaultdict(list)
    for k, t in enumerate(texts):
        for i in range(len(t or "") - 399):
            seen[t[i : i + 400]].append((k, i))
    for k, t in enumerate(texts):
        gone = set()
        for i in range(len(t or "") - 399):
            all_at = seen[t[i : i + 400]]
            if len(all_at) > 1 and (keep == "none" or min(all_at) != (k, i)):
                gone |= set(range(i, i + 400))
        assert bytes(got[k].kept).decode() == "".join(c for i, c in enumerate(t or "") if i not in gone), k


def test_ngram_join_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [None, "", " \t", "One two", "one TWO"]
    for size in (6, 8, 20, 60, 150):
        base = [r.choice(vocabulary) for _ in range(size)]
        for k in range(12):
            own = list(base)
            for _ in range(k // 3):
                own[r.randrange(size)] = r.choice(vocabulary)
            texts.append(" ".join(own))
    for width, percent in ((4, 85), (5, 80), (1, 80)):
        sets = [frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w := (t or "").lower().split()) >= width else frozenset([tuple(w)] * bool(w)) for t in texts]
        root = list(range(len(texts)))
        for _ in texts:
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    if a and 100 * len(a & b) >= percent * len(a | b):
                        root[i] = root[j] = min(root[i], root[j])
        got = {x.doc_id: x for x in ngram_join.join(frame(spark, texts), width=width, percent=percent).collect()}
        assert [got[k].component_id for k in range(len(texts))] == root
        assert [got[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]
    assert ngram_join.join(frame(spark, [])).count() == 0


def test_bitmaps_lose_no_link(spark):
    r = random.Random(8)
    tokens = [np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64)) for n in (1, 2, 15, 16, 17, 31, 33, 300, 520)]
    sets, pairs = [], []
    for t in tokens:
        for drop in (0, 1, len(t) // 12, len(t) // 6, len(t) // 2):
            sets.append(np.sort(np.concatenate((t[drop:], np.array([r.getrandbits(64) for _ in range(drop % 5)], np.uint64)))))
    rows = [(k, len(s), ngram_join.bitmap(s).tolist()) for k, s in enumerate(sets)]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b)]
    linked = {(a, b) for a, b in pairs if 100 * (i := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - i)}
    left = ngram_join.alike(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "cls long, n long, bits array<long>"), 80)
    left = {(x.a, x.b) for x in left.collect()}
    assert linked <= left and len(left) < len(pairs) / 2 and len(linked) > 10


def test_boundary_prefers_lists_where_pairs_are_many():
    assert ngram_join.boundary({100: 10}, 0.0, 1.0, 85) == 0
    # Size 6 has one pair among its prefix; beyond the zone next to x its lists, long ones here, are saved.
    assert ngram_join.boundary({6: 10, 20: 1}, 0.1, 1000.0, 85) == 20


def test_codec_against_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    r = random.Random(4)
    texts = ["", " ", "▁▁ a", "日本 🤯\u0000\n"] + ["".join(r.choice("ab zç日🤯▁ \n<>0") for _ in range(r.randint(0, 40))) for _ in range(300)]
    for t in texts:
        parts = codec.encode(t)
        ids = [k for k, _, _ in parts]
        assert ids == library.encode(t) and codec.decode([1, *ids, 2]) == library.decode([1, *ids, 2])
        assert [k for k, _ in codec.merge(codec.plain(t))] == ids
        assert all(0 <= a <= b <= len(t.encode()) for _, a, b in parts)


def test_codec_spans_reproduce_the_source(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    r = random.Random(9)
    texts = ["", " ", "▁▁ a", "日本 🤯\u0000\n"] + ["".join(r.choice("ab zç日🤯▁ \n<>0") for _ in range(r.randint(0, 40))) for _ in range(300)]
    got = {x.doc_id: x for x in sentencepiece_codec.digests(frame(spark, texts), path).collect()}
    for k, (t, parts) in enumerate(zip(texts, codec.encode_batch(texts), strict=True)):
        data = t.encode()
        assert codec.source(t).tolist() == codec.normalize(t)[1]
        surfaces = [data[a:b] for _, a, b in parts]
        assert b"".join(surfaces) == data and surfaces == [x.surface.encode() for x in library.encode(t, return_type="proto").pieces]
        ids = np.array([1, *[x for x, _, _ in parts], 2], "<u4").tobytes()
        spans = np.array([x[1:] for x in parts], "<i8").tobytes()
        want = [hashlib.sha256(x).hexdigest() for x in (ids, codec.decode([x for x, _, _ in parts]).encode(), spans)]
        assert [got[k].ids_sha256, got[k].decoded_sha256, got[k].spans_sha256] == want and got[k].n_tokens == len(parts) + 2


def test_exact_dedup_spills_and_keeps_the_longest(spark):
    texts = ["a b", "ab", "a  b", None, "", "x" * 5000, "x" * 4999 + " x", "y"] + [f"t{k} " * 200 for k in range(40)] * 2
    got = {x.doc_id: x for x in exact_dedup.decide(frame(spark, texts), table_bytes=3000).collect()}
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups["".join((t or "").split())].append((-len(t or ""), k))
    for own in groups.values():
        for _, k in own:
            assert (got[k].keep_id, got[k].group_size, got[k].kept) == (min(own)[1], len(own), min(own)[1] == k)
    same = spark.createDataFrame([(1, "q", None, ""), (1, "q", None, ""), (None, "r", None, "")], DOCS)
    assert exact_dedup.dedup(same).count() == 2
    assert sorted(x.kept for x in exact_dedup.decide(same).collect()) == [False, True, True]
    assert exact_dedup.decide(frame(spark, [])).count() == 0


def test_quality_rules_edges(spark):
    texts = [None, "", "a b c d a b c d", "the of " * 30, "word " + " ".join(f"the w{k}" for k in range(40))]
    got = {x.doc_id: x for x in quality_rules.judge(frame(spark, texts)).collect()}
    assert got[0].n_words == got[1].n_words == 0 and got[0].base_failed
    assert got[2].n_repeat_words == 8 and got[3].base_failed and got[4].kept


def test_url_filters_longest_rule_wins(spark):
    urls = [None, "no scheme", "http://a.example.com/en/7", "http://com/en/", "http://Example.NET/de/8?x", "https://x.org/fr/#y", "http://b.spam-farm.example.org/fr/1"]
    got = [(x.rule, x.verdict) for x in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got == [(None, "allow"), (None, "allow"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), (None, "allow"), (None, "block")]


def test_pii_spans_and_contexts(spark):
    seeds = [f"please write to user{k}@mail.example.com soon" for k in range(8)]
    texts = [None, "", "call +1 (988) 555-2485 or 4041894974608795, ip 1.2.3.4 not 1.2.3.999", "please write to hidden@localhost soon", "1" * 50_000, "a" * 50_000 + "@b.c_d@e.f", *seeds]
    got = {x.doc_id: x for x in pii.report(frame(spark, texts)).collect()}
    assert got[0].spans == "" and got[2].n_phone == 1 and got[2].n_ip == 1 and got[2].n_card == 1
    assert got[3].n_email == 0 and got[3].spans == "email:16:32"
    assert got[5].n_email == 2
    out = {x.doc_id: x.text for x in pii.redact(frame(spark, texts)).collect()}
    assert out[2] == "call [PHONE] or [CARD], ip [IP] not 1.2.3.999" and out[0] is None and out[6] == "please write to [EMAIL] soon"


def test_pii_finds_grouped_numbers_by_context(spark):
    def luhn(body):
        odd = [2 * int(x) - 9 * (int(x) > 4) if i % 2 == 0 else int(x) for i, x in enumerate(body)]
        return body + str(-sum(odd) % 10)

    phones = ["(415) 555-2671", "415 555 2671", "415-555.2672"]
    cards = ["4041 8949 7460 8796", "4041-8949-7460-8797"]
    seeds = [f"my phone is +1 988 555-{k}485 today" for k in range(20)] + [f"my card is {luhn(f'40418949746{k:04}')} today" for k in range(20)]
    texts = [f"my phone is {x} today" for x in phones] + [f"my card is {x} today" for x in cards] + ["1-" * 50_000, "my phone is 12 today", *seeds]
    out = [x.text for x in pii.redact(frame(spark, texts)).orderBy("doc_id").collect()]
    assert out[:3] == ["my phone is [PHONE] today"] * 3 and out[3:5] == ["my card is [CARD] today"] * 2
    assert out[5:7] == texts[5:7]


def test_pii_rounds_reach_the_fixed_point(spark):
    chain = [("phone", "seed", True, ["p0"]), *(("phone", f"i{k}", False, [f"p{k}", f"p{k + 1}"]) for k in range(5))]
    found = spark.createDataFrame(chain, "kind string, instance string, seed boolean, patterns array<string>")
    assert {x.instance for x in pii.promoted(found, support=1, confidence=0.5).collect()} == {f"i{k}" for k in range(5)}


def test_packing_is_whole_and_tight(spark):
    r = random.Random(5)
    rows = [(k, 0, 0, r.randint(1, 1024), k) for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    bins = defaultdict(list)
    for x in bestfit_packing.pack(df, chunk=500).collect():
        bins[x.sequence_id].append((x.offset, x.length))
    assert sum(map(len, bins.values())) == 3000
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.02 * sum(x[3] for x in rows) / 1024


def test_plan_uses_every_piece_once():
    r = random.Random(6)
    counts = Counter(r.randint(1, 64) for _ in range(500))
    used = Counter()
    for own, n in bestfit_packing.plan(dict(counts), 64):
        assert sum(own) <= 64
        for k in own:
            used[k] += n
    assert used == counts


def test_models_learn_and_take_empty_texts():
    clean, foul = "calm words about the sea and the sky ", "you idiot moron the sea "
    chain = toxicity.fit([clean * 3, foul * 3] * 40, [0, 1] * 40)
    p = chain.score(pa.array([clean, foul, None, ""]))[:, -1]
    assert p[1] > 0.5 > p[0] and p[2] == p[3]
    model = quality_classifier.fit([clean * 20, "%%% ### | " * 60] * 30, [1, 0] * 30)
    q = model.score(pa.array([clean * 20, "%%% ### | " * 60, None, ""]))
    assert q[0] > 0.5 > q[1] and q[2] == q[3]


def test_quality_keep_returns_own_columns(spark):
    from sparkmill.llm import quality_rules

    good = "The end of the day is near and it was a good one for us. " + " ".join(f"word{k} the" for k in range(60))
    rows = [(1, good, "x"), (2, None, "y"), (3, "", "z"), (1, good, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = quality_rules.keep(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, good, "x"), (1, good, "x")]
    assert quality_rules.keep(df.limit(0)).count() == 0


def thue_morse(flip):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(1024))


def test_words_of_one_polynomial_hash_are_told_apart(spark):
    a, b = thue_morse(0), thue_morse(1)
    got = {x.doc_id: x.component_id for x in ngram_join.join(frame(spark, [a, b, a])).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    t = bestfit_packing.Tokens(path)
    for text, ids in zip([a, b], t.encode([a, b]), strict=True):
        assert ids.tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


def test_unit_store_compares_bytes_where_hashes_meet():
    from sparkmill.llm.common import UnitStore

    r = random.Random(11)
    store = UnitStore(lambda units: [[ord(c) for c in u] * 2 for u in units], most=300)
    for _ in range(60):
        units = ["".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 50))]
        data = np.frombuffer("".join(units).encode(), np.uint8)
        ends = np.cumsum([len(u) for u in units])
        ids, counts = store.lookup(data, ends - [len(u) for u in units], ends, np.array([len(u) % 3 for u in units], np.uint64))
        assert ids.tolist() == [ord(c) for u in units for c in u * 2] and counts.tolist() == [2 * len(u) for u in units]


def roots(sets, percent):
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_ngram_join_with_meeting_class_ids(spark):
    r = random.Random(12)
    texts = [" ".join(r.choice("abcdefghij") for _ in range(r.randint(1, 12))) for _ in range(40)]
    texts += texts[:10]
    sets = [frozenset(tuple(w[k : k + 2]) for k in range(len(w) - 1)) if len(w := t.split()) > 1 else frozenset([tuple(w)]) for t in texts]
    got = {x.doc_id: x for x in ngram_join.join(frame(spark, texts), width=2, percent=60, bits=4).collect()}
    assert [got[k].component_id for k in range(len(texts))] == roots(sets, 60)
    assert [got[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]


def test_ngram_join_of_a_chain_and_of_a_large_group(spark):
    chain = [" ".join(f"c{k}" for k in range(at, at + 100)) for at in range(0, 80, 4)]  # each links with its neighbours alone
    base = [f"g{k}" for k in range(120)]
    r = random.Random(13)
    near = []
    for k in range(5000):
        own = list(base)
        own[r.randrange(120)] = f"x{k}"
        near.append(" ".join(own))
    texts = [*chain, *near, *["hello there this is short", "alone " * 3, "a b c d e f"]]
    got = {x.doc_id: x.component_id for x in ngram_join.join(frame(spark, texts)).collect()}
    n = len(chain)
    assert all(got[k] == 0 for k in range(n)) and all(got[k] == n for k in range(n, n + 5000))
    assert [got[k] for k in range(n + 5000, len(texts))] == list(range(n + 5000, len(texts)))


def linked(sets, percent):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(sets))]


def test_ngram_join_of_near_copies_around_the_threshold(spark, monkeypatch):
    """Sets of one base that link with some of their group or none: few pairs are checked, and no link is lost."""
    r = random.Random(19)
    texts = []
    for g, size in enumerate((150, 110)):
        base = [f"g{g}w{k}" for k in range(size)]
        for k in range(260):
            own = list(base)
            for _ in range(r.choice((1, 2, 2, 3, 3, 3, 4, 4))):
                at = r.randrange(size)
                own[at : at + r.choice((0, 1, 1, 2))] = [f"x{r.randrange(400)}"]
            texts.append(" ".join(own))
    r.shuffle(texts)
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in map(str.split, texts)]
    checked = []
    real = ngram_join.alike
    monkeypatch.setattr(ngram_join, "alike", lambda pairs, *a: checked.append(pairs.count()) or real(pairs, *a))
    for most in (None, 2):
        checked.clear()
        if most:
            monkeypatch.setattr(ngram_join, "GROUP", most)
        got = {x.doc_id: x.component_id for x in ngram_join.join(frame(spark, texts)).collect()}
        assert [got[k] for k in range(len(texts))] == linked(sets, 80)
        assert len(set(got.values())) > 20 and sum(checked) < 10 * len(texts), checked


def test_ngram_join_edges(spark):
    rows = [(None, "p q r s t u"), (None, "p q r s t u"), (7, "p q r s t u"), (7, "p q r s t u"), (None, "m n o p q r"), (9, None)]
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id long, text string, cls int, component_id int, gone int")
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.join(df).collect()), key=str)
    assert got == sorted([(None, 2, 7), (None, 2, 7), (7, 2, 7), (7, 2, 7), (None, 2, None), (9, 0, 9)], key=str)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and kept.count() == 6
    assert ngram_join.keep_one(df.limit(0)).count() == 0


def test_quality_windows_that_share_a_hash_are_compared(spark):
    r = random.Random(14)
    texts = [" ".join(r.choice("abcd") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 9, 30, 80)] + [" ".join(f"w{k}" for k in range(60)), "é ß " * 40]
    for window_hash in ("", "0L", "xxhash64(x) & 3L"):
        got = {x.doc_id: x.n_repeat_words for x in quality_rules.judge(frame(spark, texts), window_hash=window_hash).collect()}
        for k, t in enumerate(texts):
            w = t.split()
            at = defaultdict(list)
            for i in range(len(w) - 2):
                at[tuple(w[i : i + 3])].append(i)
            assert got[k] == len({j for own in at.values() if len(own) > 1 for i in own for j in (i, i + 1, i + 2)}), (k, window_hash)


def test_quality_rules_take_clashing_names(spark):
    df = spark.createDataFrame([(1, "the end of it " * 30, "a", "b", "c", 9)], "doc_id long, text string, words string, row string, t string, n_words int")
    got = quality_rules.judge(df).first()
    assert (got.words, got.row, got.t, got.n_words) == ("a", "b", "c", 120)
    assert quality_rules.judge(df.limit(0)).count() == 0 and quality_rules.keep(df).columns == df.columns


def base_by_hand(text):
    import re

    def luhn(d):
        return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (pattern, holds) in kinds.items() for m in re.finditer(pattern, text) if holds(m[0])]


def test_pii_base_spans_against_brute_force(spark):
    r = random.Random(15)
    bits = ["a@b.c", "x.y+z@q-r.st.", "@", ".", "-", " ", "  ", "\n", "+1 (22) 333-4444", "+", "12.34.56.78", "256.1.1.1", "1.2.3.4.5", "4041894974608795", "4041 8949 7460 8795", "7", "42", "é", "日本", "🤯", "(", "word", "A1", "%", "_"]
    texts = [None, "", *["".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(400)], "9" * 20_000, "1.2.3.4 a@b.cd 42 " * 700]
    got = {x.doc_id: x for x in pii.report(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        want = base_by_hand(t or "")
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest(), t
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == [sum(x[0] == kind for x in want) for kind in pii.KINDS]
        assert {f"{a}:{b}:{c}" for a, b, c in want} <= set(got[k].spans.split(","))


def test_pii_edges(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd now", "r", "i"), (1, "mail a@b.cd now", "r", "i"), (1, "other +1 988 555 2485", "r", "i"), (None, "ip 1.2.3.4", "r", "i"), (2, None, "r", "i")], "doc_id long, text string, row string, id string")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted(map(str, (x.text for x in out.collect()))) == ["None", "ip [IP]", "mail [EMAIL] now", "mail [EMAIL] now", "other [PHONE]"]
    assert pii.report(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_pii_promotes_across_long_gaps_and_words(spark):
    long = "w" * 300
    texts = [f"{long} contact {long}{k} at user{k}@mail.example.com now" for k in range(1)] * 1
    texts += [f"{long}y contact at u{k}@mail.example.com {long}z rest" for k in range(8)] + [f"{'pad ' * 500}{long}y contact at hidden@localhost {long}z rest", f"{long[1:]}y contactx at other@localhost {long[1:]}z rest"]
    got = {x.doc_id: x.spans for x in pii.report(frame(spark, texts)).collect()}
    assert got[9].startswith("email:") and got[10] == ""


@pytest.mark.parametrize("keep", ["none", "first"])
def test_groups_against_pairs_by_hand(keep):
    """Groups that share a pass, with segments at several places, give what windows compared by hand give."""
    r = random.Random(16)
    size = 14
    for _ in range(60):
        members, taken = [], set()
        for g in range(r.randint(1, 3)):
            core = bytes(r.choice(b"ab") for _ in range(12))
            for _ in range(r.choice((1, 2, 3, 9))):
                left, right = (bytes(r.choice(b"ab") for _ in range(r.randint(0, 6))) for _ in range(2))
                if len(left + core + right) < size or any((g, len(left), left + core + right) == x[:3] for x in members):
                    continue
                places = {(False, k, b"k%d" % k, 10 + len(left), 0) for k in r.sample(range(50), r.choice((1, 1, 2, 4)))} - taken
                taken |= places
                if places:
                    members.append((g, len(left), left + core + right, sorted(places)))
        at = defaultdict(list)
        for g, align, s, places in members:
            for i in range(len(s) - size + 1):
                at[g, s[i : i + size], i - align].extend(((p[1], p[3] - align + i), p) for p in places)
        want = {(place[0], place[1] + k) for own in at.values() if len(own) > 1 for place, _ in own if keep == "none" or place != min(own)[0] for k in range(size)}
        assert {(doc, x) for doc, _, a, b, _ in suffix_dedup.group_spans(members, size, keep) for x in range(a, b)} == want


@pytest.mark.parametrize("keep", ["none", "first"])
def test_every_removed_byte_has_a_longest_factor(spark, keep, monkeypatch):
    """The stages alone, task by task: what is removed are the windows whose LPF (or LNF) reaches the length, no others."""
    reached = []
    real = suffix_dedup.longest_factors

    def counted(*a):
        lpf, lnf = real(*a)
        reached.append(int(((lpf >= 400) | ((lnf >= 400) & (keep == "none"))).sum()))
        return lpf, lnf

    monkeypatch.setattr(suffix_dedup, "longest_factors", counted)
    r = random.Random(21)
    base = ["".join(r.choice("abcdefgh ") for _ in range(900)) for _ in range(3)]
    texts = [base[0], base[0], base[1] + base[0][:500], base[1][200:] + "x", base[2], "z" * 600]
    rows = pa.table({"key": [hashlib.sha256(t.encode()).digest()[:16] for t in texts], "text": texts})
    found = pa.Table.from_batches(suffix_dedup._anchor_rows(400)(rows.to_batches())).to_pylist()
    runs = defaultdict(list)
    for x in found:
        if x["state"] >= 0:
            runs[x["key"]].append({c: x[c] for c in ("at", "first", "last")})
    own = {}
    for k, t in enumerate(texts):
        own.setdefault(t, []).append(k)
    kind = pa.list_(pa.struct([("at", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))
    keys = [hashlib.sha256(t.encode()).digest()[:16] for t in own]
    dealt = pa.table({"doc_id": [d[0] for d in own.values()], "key": keys, "text": list(own), "runs": pa.array([runs[k] for k in keys], kind), "n": [len(d) if len(d) > 1 else None for d in own.values()]})
    segments = pa.Table.from_batches(suffix_dedup._segment_rows(400, 192, keep)(dealt.to_batches()))
    local = sum(reached)
    rows = sorted(segments.to_pylist(), key=lambda x: (x["core"], x["align"], x["segment"] or b""))
    spans = pa.Table.from_batches(suffix_dedup._span_rows(400, keep)(pa.Table.from_pylist(rows, segments.schema).to_batches())).to_pylist()
    windows = {(x["doc_id"], x["key"], x["copy"], i) for x in spans for i in range(x["a"], x["b"] - 399)}
    assert local >= 501 and sum(reached) > local and windows  # third and later copies have the second one's factors
    got = {x.doc_id: x.n_removed for x in suffix_dedup.remove(frame(spark, texts), keep=keep).collect()}
    for k, t in enumerate(texts):
        first = own[t][0]
        mine = {y for d, _, c, i in windows if d == first and (keep == "none" or c == (k != first)) for y in range(i, i + 400)}
        assert got[k] == len(mine), k
    monkeypatch.setattr(suffix_dedup, "longest_factors", lambda order, lcp, places: (np.zeros(len(order)), np.zeros(len(order))))
    segments = pa.Table.from_batches(suffix_dedup._segment_rows(400, 192, keep)(dealt.to_batches()))
    assert pa.Table.from_batches(suffix_dedup._span_rows(400, keep)(segments.to_batches())).num_rows == 0


def test_suffix_dedup_edges(spark):
    text = "".join(random.Random(17).choice("abcdef") for _ in range(900))
    rows = [(1, text), (1, text), (2, text[100:600] + "?"), (None, text), (3, "short"), (4, None), (5, ""), (6, "é" * 500)]
    df = spark.createDataFrame([(k, t, "key", 7) for k, t in rows], "doc_id long, text string, key string, spans int")
    got = sorted((x.doc_id or 0, x.n_bytes, x.n_removed, x.n_spans) for x in suffix_dedup.remove(df).collect())
    assert got == sorted([(1, 900, 900, 1), (1, 900, 900, 1), (2, 501, 500, 1), (0, 900, 900, 1), (3, 5, 0, 0), (4, 0, 0, 0), (5, 0, 0, 0), (6, 1000, 1000, 1)])
    assert suffix_dedup.remove(df.limit(0)).count() == 0


def test_suffix_dedup_of_a_hot_passage(spark):
    r = random.Random(18)
    passage = "".join(r.choice("abcdefgh ") for _ in range(450))
    texts = ["".join(r.choice("xyz") for _ in range(r.randint(0, 60))) + passage + "".join(r.choice("uvw") for _ in range(r.randint(0, 60))) for _ in range(300)]
    got = {x.doc_id: x for x in suffix_dedup.remove(frame(spark, texts).repartition(3), kept_text=True).collect()}
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    for k, t in enumerate(texts):
        gone = {j for i in range(len(t) - 399) if seen[t[i : i + 400]] > 1 for j in range(i, i + 400)}
        assert bytes(got[k].kept).decode() == "".join(c for i, c in enumerate(t) if i not in gone)


def test_packing_documents_against_the_tokenizer(spark):
    import zlib

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    t = bestfit_packing.Tokens(path).tokenizer
    r = random.Random(19)
    bits = ["the ", "cat's", " 42", "\n\n", "  ", "é", "日本", "🤯", "<|endoftext|>", "don't ", "x" * 9, "\t", "a" * 3000]
    texts = [None, "", *["".join(r.choice(bits) for _ in range(r.randint(1, 300))) for _ in range(40)], "word " * 5000]
    texts += texts[:5]
    df = spark.createDataFrame([(k, x, 1, 2) for k, x in enumerate(texts)], "doc_id long, text string, length int, rank int")
    rows = bestfit_packing.pack_documents(df, path).collect()
    own, bins = defaultdict(list), defaultdict(list)
    for x in rows:
        own[x.doc_id].append(x)
        bins[x.sequence_id].append((x.offset, x.length))
    for k, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(own[k], key=lambda p: p.piece):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            assert p.length == 1024 or p.piece == 0
            at += p.length
        assert at == len(ids)
    for places in bins.values():
        ends = [a + b for a, b in sorted(places)]
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert bestfit_packing.pack_documents(df.limit(0), path).count() == 0


def made_texts(seed, n):
    """Labelled texts whose positives hold one of three groups of marks that no list names."""
    r = random.Random(seed)
    plain = [f"plain{k}" for k in range(200)]
    groups = [[f"{g}mark{k}" for k in range(4)] for g in ("red", "blue", "green")]
    out = []
    for k in range(n):
        own = [r.choice(plain) for _ in range(40)]
        if k % 4 == 0:
            own[r.randrange(40)], own[r.randrange(40)] = (r.choice(groups[k // 4 % 3]) for _ in range(2))
        out.append((" ".join(own), int(k % 4 == 0)))
    return out


def test_toxicity_learns_kinds_and_the_label():
    texts, y = zip(*made_texts(20, 1200), strict=True)
    chain = toxicity.fit(list(texts[:900]), list(y[:900]))
    assert chain.names == ("toxic_kind_1", "toxic_kind_2", "toxic_kind_3", "toxic")
    p = chain.score(pa.array(texts[900:]))
    hit = (p[:, -1] >= 0.5) == np.array(y[900:], bool)
    assert hit.mean() > 0.97
    told = [[w[: w.index("mark")] for w in t.split() if "mark" in w] for t in texts[900:]]
    top = defaultdict(Counter)
    for own, row in zip(told, p, strict=True):
        if own:
            top[own[0]][int(row[:3].argmax())] += 1
    assert len({c.most_common(1)[0][0] for c in top.values()}) == 3  # each kind is a group of marks


def test_toxicity_folds_never_see_their_own_rows(monkeypatch):
    texts, y = zip(*made_texts(21, 200), strict=True)
    seen = []
    real = toxicity.select
    monkeypatch.setattr(toxicity, "select", lambda row, slot, labels, size: seen.append(len(labels)) or real(row, slot, labels, size))
    toxicity.fit(list(texts), list(y), folds=4)
    assert seen.count(150) == 20 and seen.count(200) == 5  # four links and the kinds of four folds; the last fits, and their kinds


def test_toxicity_kinds_of_a_fold_never_see_its_rows():
    """A fold's targets stay the same whatever the labels of its own rows are."""
    r = random.Random(22)
    words = {0: ["calm", "tree", "river"], 1: ["vile", "scum"], 2: ["hate", "burn"], 3: ["kill", "hurt"]}
    kind = [r.randrange(4) for _ in range(400)]
    texts = [" ".join(r.choice(words[0] + words[k]) for _ in range(30)) for k in kind]
    row, slot = toxicity.features(*toxicity.packed(pa.array(texts)))
    keys = np.unique(row * (1 << 20) + slot)
    row, slot = keys >> 20, keys & ((1 << 20) - 1)
    y = np.array([[float(k > 0)] for k in kind])
    y = np.column_stack((toxicity.kinds(row, slot, y[:, 0]), y))
    train = np.arange(400) % 4 != 1
    own = toxicity.fold_targets(row, slot, y, train)
    flipped = y.copy()
    flipped[~train, -1] = 1 - flipped[~train, -1]
    assert (toxicity.fold_targets(row, slot, flipped, train) == own).all() and not own[~train].any()
    assert (own[train] == y[train]).mean() > 0.9


def test_toxicity_takes_label_columns_and_edges(spark):
    texts, y = zip(*made_texts(22, 300), strict=True)
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)], "doc_id long, text string, toxic double")
    labels = spark.createDataFrame([(k, v, 1 - v) for k, v in enumerate(y)] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, calm int")
    chain = toxicity.train(docs, labels, names=("calm", "toxic"))
    rows = [(1, texts[0], 0.5), (1, texts[0], 0.5), (2, None, 0.5), (None, "", 0.5), (3, "long " * 200_000, 0.5)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, toxic double"), chain).collect()
    assert len(got) == 5 and got[0] == got[1] and got[2].toxic == got[3].toxic and set(got[0].asDict()) == {"doc_id", "calm", "toxic", "predicted"}
    assert toxicity.score(docs.limit(0), chain).count() == 0
    empty = toxicity.train(docs, labels.limit(0))
    assert [x.predicted for x in toxicity.score(docs.limit(2), empty).collect()] == [0, 0]


def test_quality_classifier_on_held_out_rows_and_edges(spark):
    r = random.Random(23)
    good = lambda: " ".join(r.choice(["sea", "sky", "day", "the", "of"]) + r.choice([".", ",", ""]) for _ in range(150))
    bad = lambda: " ".join(r.choice(["sea###", "$$$", "|", "sky***"]) for _ in range(150))
    rows = [(k, good() if k % 3 else good() + " " + bad(), 0.0) for k in range(300)] + [(900, None, 0.0), (901, "", 0.0), (901, "", 0.0), (None, "sea", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    held = [x for x in got if x.held_out and x.doc_id < 300]
    assert len(held) > 30 and np.mean([x.predicted == int(x.doc_id % 3 > 0) for x in held]) > 0.95
    assert len({x.score for x in got if x.doc_id in (900, 901)}) == 1 and all(0 <= x.score <= 1 for x in got)
    assert quality_classifier.score(docs.limit(0), model).count() == 0
    assert 0 <= quality_classifier.score(docs.limit(1), quality_classifier.train(docs, labels.limit(0))).first().score <= 1


def test_samples_are_bounded_by_bytes(spark):
    from sparkmill.llm.training import labelled

    docs = spark.createDataFrame([(k, "x" * 100 * (1 + k % 3)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    texts, y = labelled(docs, labels, ("quality",), 50, most_bytes=2000)
    assert 1500 < sum(map(len, texts)) <= 2000 and y.shape == (len(texts), 1)


def test_url_filters_of_a_large_table_run_few_expressions(spark):
    """1,200 rules: each url runs those of its rarest tokens alone, and gets the longest that fits."""
    rules = [url_filters.HostRule("block" if k % 2 else "allow", f"h{k}.example", f"/s{k % 7}/") for k in range(1000)]
    rules += [url_filters.HostRule("allow", f"h{k}.example", f"/s{k % 7}/x") for k in range(0, 1000, 5)]
    urls = [f"http://www.h{k}.example/s{k % 7}/{'x' if k % 2 else 'y'}/a" for k in range(0, 2000, 3)] + [None, "no scheme", "http://example/s1/"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = url_filters.judge(df, rules=rules, patterns=(), tested="n").collect()
    names = {r.name: r.action for r in rules}
    for x in got:
        fit = [r for r in (f"{x.host[4:]}{x.path[:n]}" for n in range(len(x.path) + 1)) if r in names] if x.host.startswith("www.") else []
        assert (x.rule, x.verdict) == ((fit[-1], names[fit[-1]]) if fit else (None, "allow")) and x.n <= 2
    assert max(x.n for x in got) == 2 and len(got) == len(urls)


def test_url_filters_hold_the_rules_of_the_contract(spark):
    """A url of net/de/ is allowed by its rule, though a content pattern would block it; example.net/de/8 is longer."""
    urls = ["http://a.net/de/1", "http://net/de/casino/", "http://x.example.net/de/7", "http://example.net/de/81", "http://example.com/en/6", "http://example.com/en/7", "http://a.org/es/"]
    got = [(x.rule, x.verdict) for x in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got == [("net/de/", "allow"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block")]


def test_url_filters_take_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/x", "a", "b", "c")], "page_id long, url string, tokens string, row string, rule string")
    got = url_filters.judge(df)
    assert got.columns == ["page_id", "url", "tokens", "row", "host", "path", "rule", "verdict"] and got.first().tokens == "a" and got.first().rule == "com/en/"
    assert url_filters.judge(df.limit(0)).count() == 0


def test_exact_dedup_carries_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y"), (2, "ab", "x", "y"), (1, "a b", "x", "y")], "doc_id long, text string, id string, gone string")
    assert exact_dedup.dedup(df).columns == df.columns and [tuple(x) for x in exact_dedup.dedup(df).collect()] == [(1, "a b", "x", "y")]
    assert exact_dedup.dedup(df.limit(0)).count() == 0


def test_suffix_dedup_moves_only_texts_that_repeat_something(spark):
    r = random.Random(20)
    letters = "".join(map(chr, range(48, 122)))
    passage = "".join(r.choices(letters, k=500))
    texts = ["".join(r.choices(letters, k=20_000)) for _ in range(100)] + [passage + str(k) for k in range(3)]
    jvm = spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    before = shuffled()
    got = {x.doc_id: x.n_removed for x in suffix_dedup.remove(frame(spark, texts)).collect()}
    assert all(n == (500 if k >= 100 else 0) for k, n in got.items()) and len(got) == len(texts)
    assert sum(v for k, v in shuffled().items() if k not in before) < 0.5 * sum(map(len, texts))


def test_codec_takes_empty_tables_and_clashing_names(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [None, "", "one text", "one text", "a long text, " * 40_000]
    df = spark.createDataFrame([(k, t, "clash", 7) for k, t in enumerate(texts)], "doc_id long, text string, ids_sha256 string, n_tokens int")
    got = {x.doc_id: x for x in sentencepiece_codec.digests(df, path).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert sentencepiece_codec.digests(df.limit(0), path).count() == 0


def test_long_texts_repeat_link_and_pack(spark):
    """Texts of a megabyte next to short ones: repeats inside one, links between two, pieces of all."""
    r = random.Random(23)
    words = [f"word{k}" for k in range(20_000)]
    long = " ".join(r.choice(words) for _ in range(120_000))
    passage = long[500_000:500_700]
    texts = [long, long + " one more word", "short " + passage, "short"]
    cut = {x.doc_id: x for x in suffix_dedup.remove(frame(spark, texts)).collect()}
    assert [cut[k].n_removed for k in range(4)] == [len(long), len(long), 700 + (long[499_999] == " "), 0]
    linked = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.join(frame(spark, texts), width=4, percent=85).collect()}
    assert [c for _, c in (linked[k] for k in range(4))] == [0, 0, 2, 3] and linked[0][0] > 119_000 and linked[3][0] == 1
    pieces = defaultdict(int)
    for x in bestfit_packing.pack_documents(frame(spark, texts), tokenizer_path("byte_bpe_50k.json")).collect():
        assert x.length <= 1024
        pieces[x.doc_id] += x.length
    assert len(pieces) == 4 and pieces[1] > pieces[0] > 120_000


def test_repeated_tokens_take_one_sorted_copy():
    import tracemalloc

    r = np.random.default_rng(3)
    held = [r.integers(0, 150_000, 10_000, dtype=np.uint64) for _ in range(100)]
    u, c = np.unique(np.concatenate(held), return_counts=True)
    want = dict(zip(u[c >= 8].tolist(), c[c >= 8].tolist(), strict=True))
    tracemalloc.start()
    got = ngram_join._repeated(held, 8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dict(zip(*(x.tolist() for x in got), strict=True)) == want and want and not held
    assert most < 20_000_000  # a copy is 8 MB; np.unique with counts takes over three
    assert [len(x) for x in ngram_join._repeated([], 8)] == [0, 0] == [len(x) for x in ngram_join._repeated([u[:3]], 8)]


def test_workers_drop_what_another_operator_keeps():
    from sparkmill.llm import common

    path = tokenizer_path("byte_bpe_50k.json")
    kept = bestfit_packing.tokens(path)
    own, other = (lambda batches: iter(()) for _ in range(2))
    own.__module__, other.__module__ = bestfit_packing.__name__, ngram_join.__name__
    list(common.released(own)(iter(())))
    assert bestfit_packing.tokens(path) is kept
    list(common.released(other)(iter(())))
    assert bestfit_packing.tokens.cache_info().currsize == 0


def test_arrow_batches_of_texts_are_bounded_by_bytes(spark):
    from sparkmill.llm import common

    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([len(b)])], ["n", "rows"])

    docs = spark.range(0, 2000, 1, 1).selectExpr("id", "repeat('abcdefghij', 1000) AS text")
    found = common.arrow_stage(docs, sizes, "n long, rows long").collect()
    assert sum(x.rows for x in found) == 2000 and max(x.n for x in found) < common.BATCH_BYTES + 100_000
    before = spark.conf.get(name)
    try:
        for own in ("1000000", "1m"):
            spark.conf.set(name, own)
            assert max(x.n for x in common.arrow_stage(docs, sizes, "n long, rows long").collect()) < 1_100_000
    finally:
        spark.conf.set(name, before)


def test_suffix_dedup_of_planted_passages(spark, tmp_path):
    """Of passages of over 50 words that two documents share, those of 400 bytes go whole, and shorter ones stay."""
    from sparkmill.llm.queries import op2_suffix_dedup

    r = random.Random(24)

    def prose(n):
        return " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(n))

    passages = [prose(100)[:n] for n in (365, 399, 400, 690)]
    assert all(len(p.split()) > 50 for p in passages)
    texts = [f"{prose(90)} {k}{passages[k % 4]}{k} {prose(90)}" for k in range(8)] + [prose(300) for _ in range(40)]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op2_suffix_dedup(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        kept = t.replace(passages[k % 4], "") if k < 8 and len(passages[k % 4]) >= 400 else t
        want = (len(t), len(t) - len(kept), int(kept != t), hashlib.sha256(kept.encode()).hexdigest(), kept)
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256, got[k].text) == want
