"""Commits of streams: state in the store, batches that come again, and rows equal to those of one pass."""

import json
import os
import random

import pytest

from sparkmill.operators import dedup
from sparkmill.streaming import commits


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    at = 1000 + len(list(folder.iterdir()))
    os.utime(folder / name, (at, at))


def parts(path, inner=""):
    return sorted(str(p) + inner for p in path.iterdir() if p.name.isdigit())


def test_exact_keys_are_in_the_state_store(spark, tmp_path, monkeypatch):
    """A crash between the state and the written batch, a restart, more files later: each record once, and no batch reads
    what earlier ones wrote."""
    for k in range(3):
        put(tmp_path / "in", f"{k}.jsonl", [{"k": i % 7} for i in range(k, k + 4)])
    run = lambda: commits.exact_commits(commits.lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    real, lost = commits.Files.exists, []

    def crash(self, path):
        if "00000001" in path and not lost:
            lost.append(path)
            raise RuntimeError("the driver is lost")
        return real(self, path)

    monkeypatch.setattr(commits.Files, "exists", crash)
    with pytest.raises(Exception, match="the driver is lost"):
        run().awaitTermination()
    run().awaitTermination()
    put(tmp_path / "in", "3.jsonl", [{"k": 6}, {"k": 0}, {"k": 6}])
    query = run()
    query.awaitTermination()
    state = [s for p in query.recentProgress for s in p["stateOperators"]]
    assert state[-1]["numRowsTotal"] == 7 and state[-1]["numRowsUpdated"] == 1
    assert [sorted(json.loads(r.record)["k"] for r in spark.read.parquet(p).collect()) for p in parts(tmp_path / "out")] == [[0, 1, 2, 3], [4], [5], [6]]
    run().awaitTermination()
    assert len(parts(tmp_path / "out")) == 4


def test_minhash_commits_are_those_of_one_pass(spark, tmp_path):
    r, texts = random.Random(6), []
    for _ in range(4):
        base = [f"w{r.randrange(50)}" for _ in range(25)]
        for k in range(5):
            own = list(base)
            for _ in range(k):
                own[r.randrange(25)] = f"w{r.randrange(50)}"
            texts.append(" ".join(own))
    r.shuffle(texts)
    kept = spark.createDataFrame(list(enumerate(texts)), "position long, t string")
    want = sorted(x.position for x in dedup.minhash(kept, "t", 32, 16, 0.5).filter("NOT duplicate").collect())
    run = lambda: commits.minhash_commits(commits.lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), "t", 32, 16, 0.5).awaitTermination()
    for k in range(2):
        put(tmp_path / "in", f"{k}.jsonl", [{"t": t, "n": n} for n, t in enumerate(texts)][k * 10 : k * 10 + 10] + [{"n": "no text"}, {"t": None}])
        run()
    got = spark.read.parquet(*parts(tmp_path / "out", "/rows")).collect()
    assert sorted(json.loads(x.record)["n"] for x in got) == want and 4 <= len(want) < 20
    order = [json.loads(x.record)["n"] for x in sorted(got, key=lambda x: x.position)]
    assert order == sorted(order)
