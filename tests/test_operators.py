import pytest

from sparkmill.operators import dedup, inspect, policies, records


def test_exact_first_wins_and_ineligible_rows_do_not_block(spark):
    df = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "a", True), (4, None, True)], "position long, k string, ok boolean")
    got = {r.position: r.duplicate for r in dedup.exact(df, ["k"], df.ok).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False}


def test_greedy_accepts_the_end_of_a_chain(spark):
    positions = spark.range(1, 5).toDF("position")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "early long, late long")
    got = {r.position: r.duplicate for r in dedup.greedy(positions, pairs).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}


def test_minhash_drops_near_and_empty_copies(spark):
    long = " ".join(f"w{k}" for k in range(200))
    df = spark.createDataFrame([(1, long), (2, long.upper()), (3, "other words here at all"), (4, ""), (5, "  ")], "position long, t string")
    got = {r.position: r.duplicate for r in dedup.minhash(df, "t", 16, 8, 0.8).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True}


def test_minhash_parameters(spark):
    with pytest.raises(ValueError):
        dedup.minhash(spark.createDataFrame([(1, "a")], "position long, t string"), "t", 10, 3)


def test_reserved_columns_are_refused(spark):
    with pytest.raises(ValueError, match="judge"):
        records.admit(spark.createDataFrame([(1,)], "judge int"))


def test_mean_does_not_overflow(spark):
    got = inspect.profile(spark.createDataFrame([(1e308,), (1e308,)], "x double")).first()
    assert got["mean"] == pytest.approx(1e308) and got["distinct"] == 1


def test_cut_keeps_the_violating_row(spark):
    df = spark.createDataFrame([(k, int(k in (2, 4))) for k in range(1, 7)], "position long, bad int")
    assert sorted(r.position for r in policies.cut_at(df, "bad", 1).collect()) == [1, 2, 3, 4]
    assert policies.cut_at(df, "bad", 2).count() == 6


def test_minhash_query_takes_the_default_signature(spark, tmp_path):
    from sparkmill.plans import catalog

    texts = []
    for k in range(60):  # pairs of a Jaccard similarity of some 0.75
        words = [f"w{k}x{i}" for i in range(170)]
        texts += [" ".join(words), " ".join(words[:-24] + [f"v{k}x{i}" for i in range(24)])]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = lambda df: {x.position for x in df.filter("duplicate").collect()}
    whole, short = (found(dedup.minhash(catalog.docs(spark, str(tmp_path)), "text", n, b, 0.8)) for n, b in ((128, 16), (32, 8)))
    assert found(catalog.minhash_greedy_accept(spark, str(tmp_path))) == whole != short


def test_minhash_of_empty_tables_and_texts(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "", 7), (4, "a b c d", 7), (5, "a b c d", 7)], "position long, t string, duplicate_of int")
    got = {r.position: r.duplicate for r in dedup.minhash(df, "t", 16, 8, 0.8).collect()}
    assert got[5] and not got[4] and set(got) == {1, 2, 3, 4, 5}
    assert dedup.minhash(df.limit(0), "t", 16, 8, 0.8).count() == 0
    pairs = spark.createDataFrame([], "early long, late long")
    assert dedup.greedy(df.select("position"), pairs).filter("duplicate").count() == 0


def test_inspect_queries_count_more_than_a_million_values(spark, tmp_path):
    from sparkmill.plans import catalog

    n = inspect.MOST_DISTINCT + 1
    spark.range(n).selectExpr("id AS o_orderkey", "id % 7 / 2 AS o_totalprice", "'O' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    got = {x["name"]: x.distinct for x in catalog.QUERIES["inspect_orders"](spark, str(tmp_path)).collect()}
    assert got == {"o_orderkey": n, "o_totalprice": 7, "o_orderstatus": 1}
    capped = inspect.profile(spark.read.parquet(f"{tmp_path}/orders.parquet").select("o_orderkey")).first()
    assert capped["distinct"] is None and capped["count"] == n


def test_json_profile_counts_every_value_and_column(spark, tmp_path):
    """Beyond the cap of values, the budget of bytes and the number of columns that a file's profile has."""
    import json

    from sparkmill.plans import catalog

    n, wide = inspect.MOST_DISTINCT + 1, json.dumps({f"c{i}": i for i in range(inspect.Limits().columns + 1)})
    rows = spark.range(n).selectExpr("""'{"k": ' || id || '}' AS props""").union(spark.createDataFrame([(wide,), (None,)], "props string"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(x) for x in catalog.QUERIES["inspect_json_props"](spark, str(tmp_path)).collect()]
    assert got == [("k", "number", n, 1, "0", str(n - 1), (n - 1) / 2, n)]
    few = spark.createDataFrame([(f'{{"a": {i % 2}, "b": {i}}}',) for i in range(9)], "record string")
    found = lambda *x: {c.name: c.distinct for c in inspect.profile_json(few, *x).collect()}
    room = 2 * (inspect.COLUMN_BYTES + 1)
    assert found() == {"a": 2, "b": 9} and found(None, 8) == {"a": 2, "b": None} == found(inspect.Limits(statistics_bytes=room + 10 * inspect.DISTINCT_BYTES))
    assert found(inspect.Limits(statistics_bytes=room + 11 * inspect.DISTINCT_BYTES)) == {"a": 2, "b": 9}
    with pytest.raises(inspect.InspectError):
        found(inspect.Limits(columns=1))


def test_json_profile_reads_each_text_once(spark, monkeypatch):
    """Every text that is parsed leaves a line; equal ones, and the budget's checks, leave no more."""
    import tempfile

    from sparkmill.functions import strictjson

    log = tempfile.mkdtemp() + "/parsed"
    plain = strictjson.parse

    def parse(text):
        with open(log, "a") as f:
            f.write("x\n")
        return plain(text)

    def fields(col):
        from pyspark.sql import functions as F

        return F.udf(lambda t: {k: strictjson.dump(x) for k, x in parse(t).items()} if t and t.lstrip()[:1] == "{" else None, "map<string,string>").asNondeterministic()(col)

    monkeypatch.setattr(strictjson, "fields", fields)
    texts = ['{"k": 1}', '{"k": 2}', ' {"k":1}', "[1]", None, '{"k": "a", "z": 2.5}'] * 50
    got = {x["name"]: x for x in inspect.profile_json(spark.createDataFrame([(t,) for t in texts], "record string")).collect()}
    k, z = got["k"], got["z"]
    assert (k["data_type"], k["count"], k["null_count"], k["min"], k["max"], k["distinct"]) == ("mixed", 200, 100, "1", "2", 3) and k["mean"] == pytest.approx(4 / 3)
    assert (z["data_type"], z["count"], z["null_count"], z["mean"], z["distinct"]) == ("number", 50, 250, 2.5, 1)
    assert len(open(log).readlines()) == 4


def test_signatures_are_the_least_values_of_the_hashes(spark, monkeypatch):
    """By hand, over blocks that end within a batch; null texts have signatures of nulls; one pass in Arrow batches makes
    all slots, whose number leaves the plan as it is."""
    import hashlib

    texts = [None, "", "a b", *[" ".join(f"w{k * i % 97}" for i in range(k)) for k in range(3, 60)], None, "x " * 500, None]
    df = spark.createDataFrame(list(enumerate(texts)), "position long, t string").coalesce(1)
    monkeypatch.setattr(dedup, "BLOCK", 64)
    got = {x.position: x.signature for x in dedup.signatures(df, "t", 16).collect()}
    for k, t in enumerate(texts):
        words = (t or "").split()
        shingles = {"\x1f".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))}
        h = [int(hashlib.md5(s.encode()).hexdigest()[:7], 16) for s in shingles]
        assert got[k] == ([None] * 16 if t is None else [min((x * a + b) % (2**31 - 1) for x in h) for a, b in map(dedup.permutation, range(16))])
    size = lambda n: len(dedup.signatures(df, "t", n)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(128) - size(8)) < 100


def test_all_pairs_compare_equal_signatures_once(spark, monkeypatch):
    rows = [(k, [1, 2, 3, 4]) for k in range(40)] + [(k, [1, 2, 3, 5]) for k in range(40, 60)] + [(60, [9, 9, 3, 4]), (61, [None] * 4), (62, [None] * 4)]
    df = spark.createDataFrame(rows, "position long, signature array<long>")
    key = lambda x: (x.early, x.late, x.similarity)
    for least in (0.0, 0.75):
        whole = sorted(map(key, dedup.near_pairs(df, 2, least, 4).collect()))
        seen, real = [], dedup.near_pairs
        with monkeypatch.context() as m:
            m.setattr(dedup, "near_pairs", lambda t, *a: (seen.append(t.count()), real(t, *a))[1])
            got = sorted(map(key, dedup.all_pairs(df, 2, least, 4).collect()))
        assert got == whole and len(got) == len(set(got)) > 1700 and seen == [4]
