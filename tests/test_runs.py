import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from sparkmill import __main__ as cli
from sparkmill.functions import strictjson
from sparkmill.operators import dedup, inspect
from sparkmill.plans import contracts, engine, providers, runs, spec, statistics
from sparkmill.sources import readers, sinks
from sparkmill.streaming import commits


def made(tmp_path, n=10, **more):
    path = tmp_path / "in.jsonl"
    if not path.exists():
        path.write_text("".join(json.dumps({"t": f"t{k % 4}", "n": k}) + "\n" for k in range(n)))
    base = {
        "version": 1, "dataset": {"name": "d"}, "source": {"type": "jsonl", "path": str(path)}, "output": {"format": "jsonl", "path": str(tmp_path / "out"), "commit_every": 4},
        "providers": {"m": {"type": "mock", "response": '{"t": {{ record.t | tojson }}, "n": {{ record.n | tojson }}}'}}, "generate": {"provider": "m", "prompt": "Say {{ t }}"},
    }
    return spec.check(base | more)


def rows(spark, path):
    return sorted((json.loads(r.value) for r in spark.read.text(path).collect()), key=lambda g: g["_meta"]["source_position"])


class StopAfter(runs.Progress):
    """Cancels the run at its first commit."""

    def __init__(self, token):
        super().__init__(lambda x: token.cancel() if x["phase"] == "commit" else None, every=60)


@pytest.mark.parametrize("least", [4096, 1])
def test_a_cancelled_run_resumes_where_it_was(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(runs, "LEAST_SPAN", least)
    s = made(tmp_path, dedup={"fields": ["t"]})
    token = runs.Token()
    with pytest.raises(runs.Cancelled):
        runs.run(spark, s, token, StopAfter(token))
    before = json.loads((tmp_path / "out.manifest.json").read_text())
    assert (before["status"], before["committed_position"], before["accepted"], before["rejected"]) == ("cancelled", 4, 4, 0)
    os.makedirs(tmp_path / "out.partial/batches/000001/accepted")  # what a killed run left of its second commit
    with pytest.raises(runs.RunFailed, match="pipeline changed"):
        runs.resume(spark, made(tmp_path, dedup={"fields": ["n"]}))
    report = runs.resume(spark, s)
    assert (report["status"], report["accepted"], report["rejected"], report["statistics"]["processed_records_total"]) == ("completed", 4, 6, 6)
    assert report["resumed_from"] == {"run_id": before["run_id"], "accepted": 4, "rejected": 0}
    assert [r["_meta"]["source_position"] for r in rows(spark, s.output["path"])] == [1, 2, 3, 4]
    assert not (tmp_path / "out.partial").exists()
    with pytest.raises(runs.RunFailed, match="completed"):
        runs.resume(spark, s)


def test_resume_refuses_what_changed(spark, tmp_path):
    s = made(tmp_path)
    token = runs.Token()
    with pytest.raises(runs.Cancelled):
        runs.run(spark, s, token, StopAfter(token))
    text = (tmp_path / "in.jsonl").read_text()
    (tmp_path / "in.jsonl").write_text(text.replace('"n": 9', '"n": 8'))
    with pytest.raises(runs.RunFailed, match="source changed"):
        runs.resume(spark, s)
    (tmp_path / "in.jsonl").write_text(text)
    at = str(tmp_path / "out.partial/batches/000000/accepted")
    kept = spark.read.parquet(at).collect()
    spark.createDataFrame([(r.position, r.row.replace("t1", "zz")) for r in kept], "position long, row string").write.mode("overwrite").parquet(at)
    with pytest.raises(runs.RunFailed, match="missing or changed"):
        runs.resume(spark, s)
    with sinks.Files(spark, s.output["path"]).lock(s.output["path"] + ".lock"), pytest.raises(sinks.LockError):
        runs.resume(spark, s)


def test_publication_never_replaces_and_is_finished_later(spark, tmp_path):
    s = made(tmp_path, n=3)
    real = runs.Run.publish

    def taken(self, report, contract):
        (tmp_path / "out").write_text("another writer's")
        real(self, report, contract)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(runs.Run, "publish", taken)
        with pytest.raises(runs.RunFailed) as e:
            runs.run(spark, s)
    assert e.value.category == "sink" and (tmp_path / "out").read_text() == "another writer's"
    with pytest.raises(runs.RunFailed, match="not those"):
        runs.resume(spark, s)
    os.unlink(tmp_path / "out")
    assert runs.resume(spark, s)["status"] == "completed" and len(rows(spark, s.output["path"])) == 3


def test_an_interrupted_publication_is_checked_and_finished(spark, tmp_path):
    s = made(tmp_path, n=3)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(runs.Run, "completed", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(runs.RunFailed):
            runs.run(spark, s)
    assert json.loads((tmp_path / "out.manifest.json").read_text())["status"] == "publishing" and (tmp_path / "out").exists()
    assert runs.resume(spark, s)["status"] == "completed"


@pytest.mark.parametrize(("errors", "processed"), [({"strict": True}, 2), ({"max_failed_records": 0}, 2), ({"max_failed_records": 1}, 4)])
def test_policies_stop_at_the_record_that_breaks_them(spark, tmp_path, errors, processed):
    (tmp_path / "in.jsonl").write_text('{"t":"a","n":1}\n{"n":1}\n{"t":"b","n":1}\n{"n":2}\n{"t":"c","n":1}\n')
    with pytest.raises(runs.RunFailed) as e:
        runs.run(spark, made(tmp_path, errors=errors))
    assert e.value.category == "failure_policy" and e.value.report["statistics"]["processed_records_total"] == processed
    assert e.value.report["committed_position"] == 0


def test_final_policies_and_empty_sources(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"n":1}\n{"n":2}\n')
    with pytest.raises(runs.RunFailed, match="all_rejected"):
        runs.run(spark, made(tmp_path))
    with pytest.raises(runs.RunFailed):
        runs.resume(spark, made(tmp_path))
    other = tmp_path / "empty"
    other.mkdir()
    (other / "in.jsonl").write_text("")
    s = made(other, output={"format": "parquet", "path": str(other / "out"), "schema": {"type": "object", "properties": {"n": {"type": "integer"}}}})
    assert runs.run(spark, s)["status"] == "completed"
    assert spark.read.parquet(s.output["path"]).columns == ["n", "_meta"] and spark.read.parquet(s.output["path"]).count() == 0


def test_source_errors_keep_whole_commits(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"t": "a", "n": k}) + "\n" for k in range(6)) + "\n")
    with pytest.raises(runs.RunFailed, match="row 7: blank") as e:
        runs.run(spark, made(tmp_path))
    assert e.value.category == "source" and e.value.report["committed_position"] == 4


def test_contracts_reject_rows_that_lose_something(spark, tmp_path):
    schema = {"type": "object", "required": ["n", "t"], "additionalProperties": False, "properties": {"n": {"type": ["integer", "null"]}, "t": {"type": "string"}, "x": {"type": "number"}, "u": {"type": "integer", "format": "uint64"}, "l": {"type": "array", "items": {"type": "boolean"}}, "generated": {"type": "object", "properties": {"k": {"type": "integer"}}}}}
    lines = [{"n": 1, "t": "a"}, {"n": None, "t": "b", "u": 2**64 - 1}, {"n": 1.0, "t": "c"}, {"n": 1, "t": "d", "x": 2**53 + 1}, {"n": 1, "t": "e", "x": 1, "l": [True]}, {"n": 1, "t": "f", "odd": 1}, {"t": "g"}, {"n": 1, "t": "h", "l": [1]}]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, lines)))
    s = made(tmp_path, providers={"m": {"type": "mock", "response": '{"k": 1}'}}, output={"format": "parquet", "path": str(tmp_path / "out"), "schema": schema})
    runs.run(spark, s)
    got = spark.read.parquet(s.output["path"])
    assert sorted(r.t for r in got.collect()) == ["a", "b", "e"] and str(got.filter("t = 'b'").first().u) == str(2**64 - 1)
    assert {json.loads(r.value)["diagnostic"]["category"] for r in spark.read.text(s.dead_letter).collect()} == {"sink_row"}
    for bad in ({"type": "object", "properties": {}}, {"type": "array", "items": {"type": "string"}}, {"type": "object", "properties": {"a": {"type": ["string", "integer"]}}}, {"type": "object", "properties": {"a": {"type": "string", "minLength": 1}}}, {"type": "object", "properties": {"_meta": {"type": "string"}}}):
        with pytest.raises(contracts.ContractError):
            contracts.compile_contract(bad)


@pytest.mark.parametrize("least", [4096, 1])
def test_the_first_accepted_row_fixes_inferred_types_and_unfit_rows_block_none(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(runs, "LEAST_SPAN", least)
    lines = [{"n": 1}, {"t": "a", "n": 1}, {"t": "b", "n": 1.5}, {"t": "b", "n": 3}, {"t": "b", "n": 4}, {"t": "c", "n": None}]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, lines)))
    s = made(tmp_path, dedup={"fields": ["t"]}, output={"format": "parquet", "path": str(tmp_path / "out"), "commit_every": 2})
    runs.run(spark, s)
    assert sorted((r.t, r.n) for r in spark.read.parquet(s.output["path"]).collect()) == [("a", 1), ("b", 3), ("c", None)]
    bad = {x["source_position"]: x["diagnostic"]["category"] for x in (json.loads(r.value) for r in spark.read.text(s.dead_letter).collect())}
    assert bad == {1: "template", 3: "sink_row", 5: "duplicate"}


def test_regeneration_sees_feedback(spark, tmp_path):
    response = "{% if feedback == 'none' %}{{ record.first }}{% else %}{{ record.second }}{% endif %}"
    lines = [{"t": "a", "first": '{"k":1}', "second": "x"}, {"t": "b", "first": "no", "second": '{"k":2}'}, {"t": "c", "first": '{"k":99}', "second": '{"k":98}'}]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, lines)))
    s = made(tmp_path, providers={"m": {"type": "mock", "response": response}}, generate={"provider": "m", "prompt": "Say {{ t }}", "regenerate_on_invalid": 2, "output_schema": {"properties": {"k": {"maximum": 5}}}})
    done = {r.position: r for r in engine.outcomes(readers.jsonl(spark, str(tmp_path / "in.jsonl")), s).collect()}
    assert [(done[k].generated, done[k].category, len(done[k].calls)) for k in (1, 2, 3)] == [('{"k":1}', None, 1), ('{"k":2}', None, 2), (None, "validation", 3)]


def test_strict_json_keeps_spelling(spark):
    texts = ['{"b":1,"a":1.0,"b":2}', '{"a":1}', '{"a":1.0}', "NaN", '{"a":1e999}', '"\\ud800"', "[" * 200 + "]" * 200, "{", '{"A":"ÄB","l":["C"]}', "1e5", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.c for r in df.select("k", strictjson.canonical("t").alias("c")).orderBy("k").collect()]
    assert got == ['{"a":1.0,"b":2}', '{"a":1}', '{"a":1.0}', None, None, None, None, None, '{"A":"ÄB","l":["C"]}', "100000.0", None]
    assert df.filter("k = 8").select(strictjson.key("t", None, True).alias("c")).first().c == '[{"A":"äb","l":["c"]}]'
    assert df.filter("k = 8").select(strictjson.key("t", ["l.0", "A"], False).alias("c")).first().c == '["C","ÄB"]'


class Stub(BaseHTTPRequestHandler):
    seen: list = []
    lock = threading.Lock()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompt = body["messages"][0]["content"]
        with self.lock:
            self.seen.append((prompt, self.headers["Authorization"], body))
            tries = sum(p == prompt for p, _, _ in self.seen)
        status, reply = 200, {"model": "stub-1", "usage": {"prompt_tokens": 10, "completion_tokens": 5}, "choices": [{"finish_reason": "stop", "message": {"content": '{"ok": true}'}}]}
        if "busy" in prompt and tries < 3:
            status, reply = 429, {}
        if "bad" in prompt:
            status, reply = 400, {"usage": {"prompt_tokens": 3, "completion_tokens": 0}}
        if "refuse" in prompt:
            reply["choices"][0]["message"]["refusal"] = "no"
        if "long" in prompt:
            reply["choices"][0]["finish_reason"] = "length"
        if "odd" in prompt:
            reply = ["?"]
        raw = json.dumps(reply).encode()
        self.send_response(status)
        if status == 429:
            self.send_header("Retry-After", "0")
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *_):
        pass


@pytest.fixture
def stub():
    Stub.seen = []
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def test_http_provider_retries_decodes_and_accounts(spark, tmp_path, stub, monkeypatch):
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"t": t, "n": 1}) + "\n" for t in ("fine", "busy", "bad", "refuse", "long", "odd")))
    p = {"type": "openai_compatible", "base_url": stub, "model": "m-1", "temperature": 0.5, "retry": {"max_attempts": 3, "initial_delay_ms": 1, "max_delay_ms": 5}}
    s = made(tmp_path, providers={"m": p}, pricing={"input_usd_per_mtok": 1.0, "output_usd_per_mtok": 2.0})
    report = runs.run(spark, s)
    bad = {x["source_position"]: x["diagnostic"]["category"] for x in (json.loads(r.value) for r in spark.read.text(s.dead_letter).collect())}
    assert bad == {3: "provider_http", 4: "provider_refusal", 5: "provider_truncated", 6: "provider_response"}
    good = rows(spark, s.output["path"])
    assert [(g["_meta"]["attempt"], g["_meta"]["generator_model"], g["generated"]) for g in good] == [(1, "stub-1", {"ok": True}), (3, "stub-1", {"ok": True})]
    used = report["statistics"]["provider_usage_by_name"]["m"]
    assert (used["requests"], used["retries"], used["usage_reports"], used["billed_prompt"]) == (8, 2, 5, 43)
    assert report["statistics"]["prompt_tokens_total"] == 20 and report["statistics"]["generation_failed_total"] == 4
    assert report["statistics"]["estimated_cost_usd"] == pytest.approx((43 * 1 + 20 * 2) / 1e6)
    assert Stub.seen[0][2]["temperature"] == 0.5 and "seed" not in Stub.seen[0][2] and len(Stub.seen) == 8  # no call is made twice


def test_http_keys_stay_out_of_everything(monkeypatch, stub):
    monkeypatch.setenv("A_KEY", "secret")
    client = providers.Client(providers.Http(stub, "m", api_key_env="A_KEY"))
    assert client.call("fine", "say it better")["text"] == '{"ok": true}'
    assert Stub.seen[0][1] == "Bearer secret" and "say it better" in Stub.seen[0][0] and "secret" not in repr(client.spec)
    monkeypatch.delenv("A_KEY")
    with pytest.raises(providers.ProviderError):
        providers.Client(providers.Http(stub, "m", api_key_env="A_KEY"))
    gone = providers.Client(providers.Http("http://127.0.0.1:9", "m", max_attempts=2, initial_delay_ms=1, max_delay_ms=1)).call("x", None)
    assert (gone["category"], gone["attempts"], gone["requests"]) == ("provider_network", 2, 2)


def test_delays_are_bounded():
    h = providers.Http("http://x", "m", initial_delay_ms=100, max_delay_ms=300)
    assert [h.delay(k, None, lambda a, b: (a, b)) for k in (1, 2, 3)] == [(0.05, 0.1), (0.1, 0.2), (0.15, 0.3)]
    assert h.delay(1, 9.0) == 0.3 and h.delay(1, 0.0) == 0.0


def test_limiter_admits_requests_and_tokens_of_a_window():
    now = [0.0]
    limit = providers.Limiter(2, 100, lambda: now[0])
    first, _ = limit.admit(60)
    assert limit.admit(50) == (None, 60.0)
    limit.correct(first, 10)
    now[0] = 1.0
    assert limit.admit(50)[0] is not None and limit.admit(1) == (None, 60.0)
    now[0] = 60.0
    assert limit.admit(40)[0] is not None
    with pytest.raises(providers.ProviderError):
        limit.admit(101)


def test_inspect_files(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a":1,"b":"x"}\n{"a":9007199254740993,"b":null}\n{"a":9007199254740992.0,"b":"y","c":null}\n[1]\n{"a":"z","b":"x"}\n')
    n, size, columns = inspect.summarize(spark, str(path))
    got = {r.name: r for r in columns.collect()}
    assert (n, size) == (5, path.stat().st_size)
    assert (got["a"].data_type, got["a"]["count"], got["a"].null_count, got["a"].min, got["a"].max, got["a"].distinct) == ("mixed", 4, 1, "1", "9007199254740993", 4)
    assert (got["b"].data_type, got["b"].null_count, got["b"].distinct, got["c"].data_type) == ("string", 2, 2, "empty")
    with pytest.raises(inspect.InspectError):
        inspect.summarize(spark, str(path), inspect.Limits(columns=2))
    with pytest.raises(inspect.InspectError):
        inspect.summarize(spark, str(path), inspect.Limits(row_bytes=10))
    path.write_text("{\n")
    with pytest.raises(inspect.InspectError):
        inspect.summarize(spark, str(path))
    spark.range(3).select(F.expr("id + 9007199254740993").alias("v")).write.parquet(str(tmp_path / "b.parquet"))
    assert inspect.summarize(spark, str(tmp_path / "b.parquet"))[2].first()["max"] == "9007199254740995"


def test_costs_and_their_default(spark):
    t = spark.createDataFrame([("a", 10, 1), ("b", 20, 2)], "provider string, prompt_tokens long, completion_tokens long")
    named = {"a": spec.Price(1.0, 2.0)}
    assert statistics.total_cost(statistics.costs(t, named)).first()["total"] is None
    assert statistics.total_cost(statistics.costs(t, named, spec.Price(3.0, 0.0))).first()["total"] == pytest.approx(72e-6)


def test_minhash_against_brute_force(spark):
    import hashlib
    import random

    r = random.Random(7)
    texts = []
    for _ in range(6):
        base = [f"w{r.randrange(60)}" for _ in range(30)]
        for k in range(6):
            own = list(base)
            for _ in range(k):
                own[r.randrange(30)] = f"w{r.randrange(60)}"
            texts.append(" ".join(own))
    r.shuffle(texts)

    def signature(t):
        w = t.lower().split()
        hashes = [int(hashlib.md5("\x1f".join(w[i : i + 3]).encode()).hexdigest()[:7], 16) for i in range(max(1, len(w) - 2))]
        return [min((h * a + b) % (2**31 - 1) for h in hashes) for a, b in map(dedup.permutation, range(16))]

    signed = [signature(t) for t in texts]
    fits = [k % 7 != 0 for k in range(len(texts))]
    kept, want = [], []
    for k, s in enumerate(signed):
        hit = any(any(s[2 * b : 2 * b + 2] == signed[j][2 * b : 2 * b + 2] for b in range(8)) and sum(x == y for x, y in zip(s, signed[j], strict=True)) >= 0.5 * 16 for j in kept)
        want.append(hit)
        if not hit and fits[k]:
            kept.append(k)
    df = spark.createDataFrame([(k + 1, t, f) for k, (t, f) in enumerate(zip(texts, fits, strict=True))], "position long, t string, fits boolean")
    got = {x.position: x.duplicate for x in dedup.minhash(df, "t", 16, 8, 0.5).collect()}
    assert [got[k + 1] for k in range(len(texts))] == want and 5 < sum(want) < len(want) - 5


def test_streamed_commits_keep_the_first(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/{k}.jsonl").write_text("".join(json.dumps({"k": i % 5}) + "\n" for i in range(k, k + 4)))
        os.utime(tmp_path / f"in/{k}.jsonl", (1000 + k, 1000 + k))
    for _ in range(2):
        commits.exact_commits(commits.lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.record for r in spark.read.parquet(*[str(p) for p in (tmp_path / "out").iterdir()]).collect()) == [f'{{"k":{k}}}' for k in range(5)]


def test_command_line(spark, tmp_path, capsys):
    s = {"version": 1, "dataset": {"name": "d"}, "source": {"type": "jsonl", "path": "in.jsonl"}, "output": {"format": "jsonl", "path": "out"}, "providers": {"m": {"type": "mock", "response": "{}"}}, "generate": {"provider": "m", "prompt": "p"}}
    (tmp_path / "p.json").write_text(json.dumps(s))
    (tmp_path / "in.jsonl").write_text('{"a":1}\n')
    assert cli.main(["validate", str(tmp_path / "p.json")]) == 0 and cli.main(["plan", str(tmp_path / "p.json")]) == 0
    assert "generate by m" in capsys.readouterr().out
    (tmp_path / "q.json").write_text(json.dumps(s | {"odd": 1}))
    assert cli.main(["validate", str(tmp_path / "q.json")]) == 1 and json.loads(capsys.readouterr().err)["error"]["category"] == "configuration"
    assert cli.main(["inspect", str(tmp_path / "in.jsonl"), "--json"]) == 0 and json.loads(capsys.readouterr().out)["columns"][0]["name"] == "a"
    loose, strict = (cli.loaded(str(tmp_path / "p.json"), x).digest() for x in (False, True))
    assert loose != strict and cli.loaded(str(tmp_path / "p.json")).output["path"] == str(tmp_path / "out")


@pytest.mark.parametrize("more", [
    {"providers": {"m": {"type": "openai_compatible", "base_url": "http://u:p@x", "model": "m"}}}, {"providers": {"m": {"type": "openai_compatible", "base_url": "http://x", "model": "m", "temperature": 3}}},
    {"providers": {"m": {"type": "openai_compatible", "base_url": "http://x", "model": "m", "rate_limit": {}}}}, {"providers": {"m": {"type": "mock", "response": "{{"}, "n": {"type": "mock"}}},
    {"dedup": {"method": "minhash", "field": "t", "tokenization": "bytes"}}, {"pricing": {"input_usd_per_mtok": -1, "output_usd_per_mtok": 0}}, {"provider_pricing": {"z": {"input_usd_per_mtok": 1, "output_usd_per_mtok": 0}}},
    {"generate": {"provider": "m", "prompt": "p", "regenerate_on_invalid": 4}}, {"errors": {"dead_letter": "in.jsonl"}, "source": {"type": "jsonl", "path": "in.jsonl"}},
])
def test_specifications_name_the_rule_they_break(tmp_path, more):
    with pytest.raises(spec.SpecError):
        made(tmp_path, **more)


def greedy_by_hand(signed, bands, threshold, fits):
    """Duplicates among signatures in order, each against the accepted ones before it."""
    width, kept, out = len(signed[0]) // bands, [], []
    for k, s in enumerate(signed):
        hit = any(any(s[width * b : width * (b + 1)] == signed[j][width * b : width * (b + 1)] for b in range(bands)) and sum(x == y for x, y in zip(s, signed[j], strict=True)) >= threshold * len(s) for j in kept)
        out.append(hit)
        if not hit and fits[k]:
            kept.append(k)
    return out


@pytest.mark.parametrize("crowded", [0, 4, 10**9])
def test_crowded_buckets_against_brute_force(spark, monkeypatch, crowded):
    """Leaders first, pairs at once, or both: groups of near copies, chains, rows that share a band but are not alike."""
    import random

    monkeypatch.setattr(dedup, "CROWDED", crowded)
    r, signed = random.Random(3), []
    for group in range(4):
        base = [r.randrange(1000) for _ in range(16)]
        for _ in range(40):
            own = list(base)
            for at in range(2, 16):  # the first band stays
                if r.random() < (0.05, 0.2, 0.5, 1)[group]:
                    own[at] = r.randrange(3)
            signed.append(own)
    r.shuffle(signed)
    signed += signed[:5]
    fits = [r.random() < 0.8 for _ in signed]
    df = spark.createDataFrame([(k, s, f) for k, (s, f) in enumerate(zip(signed, fits, strict=True))], "position long, signature array<long>, fits boolean")
    got = {x.position for x in dedup.near_late(df, 8, 0.6, 16).collect()}
    assert got == {k for k, hit in enumerate(greedy_by_hand(signed, 8, 0.6, fits)) if hit}


def test_fifty_thousand_near_copies_in_one_bucket(spark, monkeypatch):
    """No pairs of copies are made; what is accepted is what brute force accepts."""
    import random

    made = []
    real = dedup.near_pairs
    monkeypatch.setattr(dedup, "near_pairs", lambda df, *a: (made.append(df.count()), real(df, *a))[1])
    r = random.Random(4)
    base, signed = [r.randrange(10**6) for _ in range(16)], []
    for k in range(50_000):
        own = list(base)
        own[2 + k % 14] = k + 10**6
        if k % 10_000 == 5000:  # in the bucket, and like nothing else
            own[2:] = [k * 100 + j + 10**7 for j in range(14)]
        signed.append(own)
    df = spark.createDataFrame(list(enumerate(signed)), "position long, signature array<long>").withColumn("fits", F.lit(True)).repartition(8)
    late = {x.position for x in dedup.near_late(df, 8, 0.8, 16).collect()}
    assert sorted(set(range(50_000)) - late) == [0, 5000, 15000, 25000, 35000, 45000]
    assert sum(n * (n - 1) // 2 for n in made) < 10**6
    some = [0, *r.sample(range(1, 50_000), 60), 5000, 15000]
    assert [k in late for k in sorted(some)] == greedy_by_hand([signed[k] for k in sorted(some)], 8, 0.8, [True] * len(some))


def test_minhash_over_spans_signs_every_text_once(spark, tmp_path, monkeypatch):
    """Later spans probe the index of earlier ones; rows are those of one pass over all, and of a run that goes on."""
    import random

    r, texts = random.Random(5), []
    for _ in range(5):
        base = [f"w{r.randrange(50)}" for _ in range(25)]
        for k in range(5):
            own = list(base)
            for _ in range(k):
                own[r.randrange(25)] = f"w{r.randrange(50)}"
            texts.append(" ".join(own))
    r.shuffle(texts)
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"t": t, "n": k}) + "\n" for k, t in enumerate(texts)))
    one = spark.createDataFrame(list(enumerate(texts, 1)), "position long, t string")
    want = sorted(x.position for x in dedup.minhash(one, "t", 32, 16, 0.5).filter("NOT duplicate").collect())
    monkeypatch.setattr(runs, "LEAST_SPAN", 1)
    monkeypatch.setattr(runs, "MOST_SPANS", 3)
    signed = []
    real = dedup.signatures
    monkeypatch.setattr(dedup, "signatures", lambda df, *a: (signed.append(df.count()), real(df, *a))[1])
    s = made(tmp_path, dedup={"method": "minhash", "field": "t", "num_perm": 32, "bands": 16, "threshold": 0.5})
    token = runs.Token()
    with pytest.raises(runs.Cancelled):
        runs.run(spark, s, token, runs.Progress(lambda x: token.cancel() if x["phase"] == "commit" and x["processed"] >= 12 else None, every=60))
    runs.resume(spark, s)
    assert [x["_meta"]["source_position"] for x in rows(spark, s.output["path"])] == want and 5 < len(want) < 25
    assert signed == [12, 12, 1]
