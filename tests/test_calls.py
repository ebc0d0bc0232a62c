"""Leases of calls between tasks, calls in order that end early, commits at the interval asked for, and kept replies."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sparkmill.plans import engine, leases, providers, runs, spec


class Stub(BaseHTTPRequestHandler):
    """Answers by what a prompt says, and notes when each came."""

    protocol_version = "HTTP/1.1"

    def do_POST(self):
        prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
        with self.server.lock:
            self.server.seen.append((time.monotonic(), prompt))
            self.server.now += 1
            self.server.most = max(self.server.most, self.server.now)
        time.sleep(self.server.takes)
        status = 400 if "bad" in prompt and not self.server.mended else 200
        content = "no json" if "text" in prompt else '{"n": "x"}' if "type" in prompt else '{"n": 1}'
        raw = json.dumps({"choices": [{"message": {"content": content}}]}).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)
        with self.server.lock:
            self.server.now -= 1

    def log_message(self, *_):
        pass


@pytest.fixture
def stub():
    class Server(ThreadingHTTPServer):
        request_queue_size, daemon_threads = 128, True

    server = Server(("127.0.0.1", 0), Stub)
    server.seen, server.lock, server.takes, server.now, server.most, server.mended = [], threading.Lock(), 0.01, 0, 0, False
    threading.Thread(target=server.serve_forever, daemon=True).start()
    server.url = f"http://127.0.0.1:{server.server_port}/v1"
    yield server
    server.shutdown()


def made(tmp_path, stub, texts, **more):
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"t": t, "k": k}) + "\n" for k, t in enumerate(texts)))
    provider = {"type": "openai_compatible", "base_url": stub.url, "model": "m", "concurrency": 4} if stub else {"type": "mock", "response": '{"n": 1}'}
    base = {
        "version": 1, "dataset": {"name": "d"}, "source": {"type": "jsonl", "path": str(tmp_path / "in.jsonl")}, "output": {"format": "jsonl", "path": str(tmp_path / "out"), "commit_every": 1},
        "providers": {"m": provider}, "generate": {"provider": "m", "prompt": "{{ t }} {{ k }}", "output_schema": {"properties": {"n": {"type": "integer"}}}},
    }
    return spec.check(base | more)


def test_a_pool_holds_requests_tokens_and_permits_of_all():
    now = [0.0]
    pool = leases.Pool(2, requests=3, tokens=100, lasts=30, clock=lambda: now[0])
    a, b = pool.admit(40)["lease"], pool.admit(40)["lease"]
    assert "wait" in pool.admit(1)  # both permits are out
    pool.back(a, tokens=10)
    assert "wait" in pool.admit(60) and "lease" in pool.admit(50)  # 10 + 40 + 50
    now[0] = 10.0
    pool.back(b, ago=10.0)
    assert "wait" in pool.admit(0)  # three requests
    now[0] = 60.0 + leases.SLACK  # those of 0 have left; the third was never given back, and counts from when it ended
    assert "lease" in pool.admit(50) and "wait" in pool.admit(50) and pool.admit(101) == {"never": 100}
    assert pool.back("unknown") == {}
    with pytest.raises(ValueError):
        leases.Pool(1, requests=0)


def test_a_lost_lease_ends_by_itself():
    now = [0.0]
    pool = leases.Pool(1, lasts=30, clock=lambda: now[0])
    assert "lease" in pool.admit(1) and "wait" in pool.admit(1)
    now[0] = 31.0
    assert "lease" in pool.admit(1)


def test_a_gate_admits_in_order_and_stops():
    now = [0.0]
    pool = leases.Pool(2, gate=leases.Gate(1, 1), clock=lambda: now[0])
    first = pool.admit(1, 1)["lease"]
    assert "wait" in pool.admit(1, 3) and "lease" in pool.admit(1, 2)
    pool.outcomes([2], [True])
    pool.back(first)
    pool.outcomes([1, 3, 3], [False, True, True])  # told twice, counted once
    assert pool.gate.stopped_at == 3 and pool.admit(1, 4) == {"stop": 3} and "lease" in pool.admit(1, 3)


def test_a_call_goes_when_the_one_before_it_has_no_place_to_run():
    now = [0.0]
    pool = leases.Pool(1, gate=leases.Gate(1, 0), clock=lambda: now[0])
    assert "wait" in pool.admit(1, 9)
    now[0] = leases.STALLED + 1
    assert "lease" in pool.admit(1, 9)


def test_the_service_refuses_others():
    with leases.Service() as service:
        address = service.add("p", leases.Pool(1))
        assert "lease" in leases.Leases(address).admit(1)
        for odd in (leases.Address(address.host, address.port, "wrong", "p"), address.pool("none")):
            with pytest.raises(ConnectionError):
                leases.Leases(odd).admit(1)
        with pytest.raises(ConnectionError):
            leases.Leases(address).ask("_expire", now=1)
        assert address.secret not in repr(address)


def test_a_busy_task_has_the_whole_limit(spark, stub, monkeypatch):
    """Four tasks, one with all calls: the rate of 20 in a window of one second is reached, and never exceeded."""
    monkeypatch.setattr(leases, "WINDOW", 1.0)
    monkeypatch.setattr(leases, "SLACK", 0.1)
    http = providers.Http(stub.url, "m", concurrency=8)
    df = spark.range(1, 401).select(F.col("id").alias("position"), F.when(F.col("id") <= 100, F.concat(F.lit("p"), "id")).alias("ask"))
    with leases.Service() as service:
        address = service.add("m", leases.Pool(8, requests=20))
        got = providers.called(df, http, "ask", None, "reply", 4, address, F.lit(False), lambda _: False).collect()
    assert len(got) == 400 and sum(r.reply is not None and r.reply.text == '{"n": 1}' for r in got) == 100
    times = sorted(t for t, _ in stub.seen)
    assert len(times) == 100 and stub.most <= 8
    assert all(b - a > 1.0 for a, b in zip(times, times[20:], strict=False))
    assert times[-1] - times[0] < 8  # a quarter of the limit would take 19 s


@pytest.mark.parametrize("bad", ["bad", "text", "type"])
def test_a_policy_ends_calls_with_the_record_that_breaks_it(spark, tmp_path, stub, bad):
    """A refused call, a reply that is no JSON, one that breaks the schema: the third of 10,000 records."""
    s = made(tmp_path, stub, ["fine", "fine", bad, *["fine"] * 9997], errors={"strict": True})
    with pytest.raises(runs.RunFailed, match="strict") as e:
        runs.run(spark, s)
    assert len(stub.seen) <= 4 + 3
    report = e.value.report
    assert (report["committed_position"], report["commits"], report["accepted"], report["statistics"]["processed_records_total"]) == (2, 2, 2, 3)


def test_calls_end_in_the_middle_of_a_span(spark, stub):
    """One stage of 600 records, two rejections allowed: the third is at 300."""
    texts = ["bad" if k in (50, 51, 300) else "fine" for k in range(1, 601)]
    df = spark.createDataFrame([(k, f"{t} {k}") for k, t in enumerate(texts, 1)], "position long, ask string")
    http = providers.Http(stub.url, "m", concurrency=4)
    with leases.Service() as service:
        pool = leases.Pool(4, gate=leases.Gate(1, 2))
        got = providers.called(df, http, "ask", None, "reply", 4, service.add("m", pool), F.lit(False), lambda _: False).collect()
    assert pool.gate.stopped_at == 300 and 300 <= len(stub.seen) <= 304
    assert {r.position for r in got if r.reply.category == "stopped"} >= set(range(305, 601))


def test_commits_are_those_asked_for_and_a_run_goes_on_after_any(spark, tmp_path):
    s = made(tmp_path, None, ["a"] * 10_000, errors={})
    token, seen = runs.Token(), []

    def tell(state):
        if state["phase"] == "commit":
            seen.append(state["processed"])
            if state["processed"] in (1, 2345):
                token.cancel()

    def entered(report):
        tables = [spark.read.parquet(str(tmp_path / f"out.partial/batches/{b['name']}/entries")).filter(F.col("position") <= b["last"]) for b in report["batches"]]
        return sum(t.count() for t in tables)

    for at in (1, 2345):
        with pytest.raises(runs.Cancelled):
            (runs.run if at == 1 else runs.resume)(spark, s, token, runs.Progress(tell, every=60))
        report = json.loads((tmp_path / "out.manifest.json").read_text())
        assert (report["committed_position"], report["commits"], report["accepted"]) == (at, at, at) and entered(report) == at
        token = runs.Token()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(runs.Run, "publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(runs.RunFailed):
            runs.resume(spark, s, token, runs.Progress(tell, every=60))
    report = json.loads((tmp_path / "out.manifest.json").read_text())
    assert report["commits"] == 10_000 == entered(report) and sorted(set(seen)) == list(range(1, 10_001)) and len(report["batches"]) < 70
    assert runs.resume(spark, s)["accepted"] == 10_000
    assert spark.read.text(s.output["path"]).count() == 10_000


def test_entries_tell_what_changed(spark, tmp_path):
    s = made(tmp_path, None, ["a"] * 9)
    token = runs.Token()
    with pytest.raises(runs.Cancelled):
        runs.run(spark, s, token, runs.Progress(lambda x: token.cancel() if x["processed"] == 5 else None, every=60))
    at = str(tmp_path / "out.partial/batches/000000/entries")
    kept = spark.read.parquet(at).collect()
    spark.createDataFrame(kept[:-1], spark.read.parquet(at).schema).write.mode("overwrite").parquet(at)
    with pytest.raises(runs.RunFailed, match="missing or changed"):
        runs.resume(spark, s)


def test_no_call_is_paid_again_when_the_driver_is_lost(spark, tmp_path, stub):
    s = made(tmp_path, stub, ["fine"] * 40, judge={"provider": "m", "prompt": "judge {{ k }}", "score_field": "n", "min_score": 0})
    with pytest.MonkeyPatch.context() as m:
        m.setattr(engine, "admitted", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(runs.RunFailed):
            runs.run(spark, s)
    calls = len(stub.seen)
    assert calls > 0 and json.loads((tmp_path / "out.manifest.json").read_text())["committed_position"] == 0
    assert runs.resume(spark, s)["accepted"] == 40
    assert len(stub.seen) == 80 and len({p for _, p in stub.seen}) == 80


def test_replies_of_tasks_that_ended_are_kept(spark, tmp_path):
    """A second process calls for what the first has no good reply to, and one process never calls twice."""
    asked = []
    rows = spark.createDataFrame([(k, f"p{k}", None) for k in range(1, 11)], "position long, ask string, category string")

    def call(df):
        asked.append(sorted(r.position for r in df.filter("ask is not null").collect()))
        failed = F.when((F.col("position") == 3) & F.lit(len(asked) == 1), "provider_network")
        reply = F.when(F.col("ask").isNotNull(), F.struct(F.concat(F.lit("r"), "position").alias("text"), failed.alias("category")))
        return df.withColumn("reply", reply)

    with leases.Service() as service:
        for part, want in ((rows.filter("position <= 5"), [1, 2, 3, 4, 5]), (rows, [3, 6, 7, 8, 9, 10]), (rows, [])):
            calls = engine.Calls(service, str(tmp_path / "calls"))  # a new process each
            calls.begin(1, None)
            got = {r.position: r for r in calls.kept(part, "ask", "reply", call).collect()}
            assert asked[-1] == want and len(got) == part.count() and all(r.reply.text == f"r{p}" and r.ask for p, r in got.items())
            assert [p for p, r in got.items() if r.reply.category] == ([3] if len(asked) == 1 else [])


def test_a_call_that_failed_is_made_again_when_the_run_goes_on(spark, tmp_path, stub):
    """The second record's call fails under a strict policy; the provider is mended, and the run resumed."""
    s = made(tmp_path, stub, ["fine", "bad", "fine", "fine"], errors={"strict": True})
    with pytest.raises(runs.RunFailed, match="strict"):
        runs.run(spark, s)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(stub, "mended", True)
        assert runs.resume(spark, s)["accepted"] == 4
    assert sum("bad" in p for _, p in stub.seen) == 2 and sum(p == "fine 0" for _, p in stub.seen) == 1


def test_a_provider_of_the_user_s_own(spark, tmp_path):
    """Answers as texts and dicts, failures of both kinds, feedback, and names that the specification lacks."""

    def answer(prompt, feedback):
        if "raise" in prompt:
            raise KeyError("what the user's code raises")
        if "refuse" in prompt:
            raise providers.ProviderError("provider_refusal")
        if "number" in prompt:
            return 3
        if "again" in prompt:
            return '{"n": 5}' if feedback else '{"n": "x"}'
        return {"text": '{"n": 7}', "model": "mine-1", "prompt_tokens": 4, "completion_tokens": 2}

    s = made(tmp_path, None, ["fine", "again", "raise", "refuse", "number"], generate={"provider": "m", "prompt": "{{ t }}", "regenerate_on_invalid": 1, "output_schema": {"properties": {"n": {"type": "integer"}}}})
    report = runs.run(spark, s, own={"m": answer})
    bad = {x["source_position"]: x["diagnostic"]["category"] for x in (json.loads(r.value) for r in spark.read.text(s.dead_letter).collect())}
    assert bad == {3: "provider_response", 4: "provider_refusal", 5: "provider_response"} and report["accepted"] == 2
    good = sorted((json.loads(r.value) for r in spark.read.text(s.output["path"]).collect()), key=lambda g: g["_meta"]["source_position"])
    assert [(g["generated"]["n"], g["_meta"]["generator_model"], g["_meta"]["attempt"]) for g in good] == [(7, "mine-1", 1), (5, "m", 2)]
    assert report["statistics"]["prompt_tokens_total"] == 4
    with pytest.raises(runs.RunFailed, match="no provider z"):
        runs.run(spark, s, own={"z": answer})
