"""Budgets of accepted keys, by position, and bounded samples."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkmill.operators import inspect, sampling
from sparkmill.plans import runs, spec

EVENTS = "/root/testdata/sf0.01/events.parquet"


def made(tmp_path, lines, **more):
    (tmp_path / "in.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    base = {
        "version": 1, "dataset": {"name": "d"}, "source": {"type": "jsonl", "path": str(tmp_path / "in.jsonl")}, "output": {"format": "jsonl", "path": str(tmp_path / "out"), "commit_every": 1},
        "providers": {"m": {"type": "mock", "response": '{"t": {{ record.t | tojson }}}'}}, "generate": {"provider": "m", "prompt": "Say {{ t }}"}, "dedup": {"fields": ["t"]},
    }
    return spec.check(base | more)


@pytest.mark.parametrize(("dedup", "room"), [({"fields": ["t"]}, 128), ({"method": "minhash", "field": "t", "num_perm": 8, "bands": 2}, 128 + 64 + 256)])
def test_the_budget_ends_a_run_at_the_record_that_exceeds_it(spark, tmp_path, dedup, room):
    """Two keys have room: duplicates need none, the third unique record ends the run, and commits before it stay."""
    lines = [{"t": "alpha one"}, {"t": "alpha one"}, {"t": "beta two"}, {"t": "beta two"}, {"t": "alpha one"}, {"t": "gamma three"}, {"t": "delta"}]
    with pytest.raises(runs.RunFailed, match="budget is exceeded at row 6") as e:
        runs.run(spark, made(tmp_path, lines, dedup=dedup, dedup_max_bytes=3 * room - 1))
    report = e.value.report
    assert (report["committed_position"], report["accepted"], report["rejected"], e.value.category) == (5, 2, 3, "run")
    with pytest.raises(runs.RunFailed, match="row 6"):  # what is committed counts when the run goes on
        runs.resume(spark, made(tmp_path, lines, dedup=dedup, dedup_max_bytes=3 * room - 1))


def test_disk_storage_has_no_budget_and_duplicates_take_none(spark, tmp_path):
    lines = [{"t": "a"}, {"t": "b"}, {"t": "c"}]
    assert runs.run(spark, made(tmp_path, lines, dedup_storage="disk", dedup_max_bytes=128))["accepted"] == 3
    (tmp_path / "x").mkdir()
    assert runs.run(spark, made(tmp_path / "x", [{"t": "a"}] * 4, dedup_max_bytes=128))["rejected"] == 3


def test_samples_merge_in_any_order(spark):
    rows = spark.createDataFrame([(k, float(k * k % 1009)) for k in range(3000)], "k long, v double")
    whole = sorted(r.k for r in sampling.sampled(rows, ["k"], 200).collect())
    parts = [rows.filter(F.col("k") % 3 == p) for p in range(3)]
    for a, b, c in ((0, 1, 2), (2, 0, 1)):
        first = sampling.merged(sampling.sampled(parts[a], ["k"], 200), sampling.sampled(parts[b], ["k"], 200), ["k"], 200)
        assert sorted(r.k for r in sampling.merged(first, sampling.sampled(parts[c], ["k"], 200), ["k"], 200).collect()) == whole
    assert len(whole) == 200 and whole != sorted(r.k for r in sampling.sampled(rows, ["k"], 200, seed=8).collect())
    assert sampling.sampled(rows.limit(0), ["k"]).count() == 0 and sampling.sampled(rows.limit(5), ["k"]).count() == 5


def test_percentiles_of_a_sample(spark):
    """Exact up to the sample's size; beyond it, within five standard errors of the rank, on all events."""
    events = spark.read.parquet(EVENTS).select("event_id", "value")
    values = sorted(r.value for r in events.collect())
    ranks = {f"p{k}": k / 100 for k in (5, 50, 95, 99)}
    few = events.orderBy("event_id").limit(999)
    own = sorted(r.value for r in few.collect())
    got = sampling.percentiles(few, "value", ["event_id"], ranks).first()
    assert all(got[k] == own[int((len(own) - 1) * f + 0.5)] for k, f in ranks.items())
    for size in (200, 4096):
        got = sampling.percentiles(events, "value", ["event_id"], ranks, size).first()
        for k, f in ranks.items():
            low, high = (sum(v < got[k] for v in values) / len(values), sum(v <= got[k] for v in values) / len(values))
            error = 5 * (f * (1 - f) / size) ** 0.5 + 1 / size
            assert low - error <= f <= high + error
    assert tuple(sampling.percentiles(events.limit(0), "value", ["event_id"], ranks).first()) == (None,) * 4
    r = random.Random(1)
    nulls = spark.createDataFrame([(k, None if r.random() < 0.5 else 1.0) for k in range(50)], "k long, v double")
    assert inspect.latency(nulls, "v", ["k"]).first().asDict() == {"mean_ms": 1.0, "p50_ms": 1.0, "p95_ms": 1.0, "p99_ms": 1.0}
