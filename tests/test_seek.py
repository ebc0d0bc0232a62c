"""Readings that begin at a byte, and resumed runs that read only what is left."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkmill.plans import runs, spec
from sparkmill.sources import ranges, readers


@pytest.mark.parametrize("read", [1, 3, 100])
def test_ranges_hold_each_line_once(tmp_path, read):
    r = random.Random(1)
    for text in (b"", b"a", b"a\n", b"\n\n", b"ab\ncd\nef", b"".join(b"x" * r.randrange(6) + b"\n" for _ in range(40))):
        path = tmp_path / "f"
        path.write_bytes(text)
        want = text.split(b"\n")
        want = want[:-1] if want[-1] == b"" else want
        for step in (1, 2, 5, 1000):
            got = []
            for first in range(0, len(text), step):
                with open(path, "rb") as f:
                    for lot in ranges.lines(f, first, min(first + step, len(text)), read):
                        got += lot
            assert got == want


def test_a_reading_from_a_place_is_the_end_of_a_whole_one(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    r = random.Random(2)
    for k in range(3):
        (folder / f"{k} ä.jsonl").write_text("".join(json.dumps({"k": k, "n": n, "x": "é" * r.randrange(300)}, ensure_ascii=False) + "\n" for n in range(400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        whole = {x.position: x.value for x in readers.lines(spark, str(folder)).collect()}
        blocks = readers.blocks(spark, str(folder))
        assert sorted(whole) == list(range(1, 1201)) and blocks.count() > 10
        for committed in (0, 1, 399, 400, 650, 1199):
            since = readers.place(blocks, committed)
            assert since.before <= committed
            got = {x.position: x.value for x in readers.lines(spark, str(folder), since).collect()}
            assert got == {k: v for k, v in whole.items() if k > since.before} and committed + 1 in got
        assert readers.place(blocks, 1200) is None
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_resume_near_the_end_reads_little(spark, tmp_path, monkeypatch):
    """At 99 %: the ranges that are read, and nothing else, are under 5 % of the file."""
    path = tmp_path / "in.jsonl"
    path.write_text("".join(json.dumps({"t": "x" * 150, "n": k}) + "\n" for k in range(20_000)))
    size = path.stat().st_size
    base = {
        "version": 1, "dataset": {"name": "d"}, "source": {"type": "jsonl", "path": str(path)}, "output": {"format": "jsonl", "path": str(tmp_path / "out"), "commit_every": 100},
        "providers": {"m": {"type": "mock", "response": '{"n": {{ record.n | tojson }}}'}}, "generate": {"provider": "m", "prompt": "Say {{ n }}"},
    }
    s, token = spec.check(base), runs.Token()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 25))
    try:
        with pytest.raises(runs.Cancelled):
            runs.run(spark, s, token, runs.Progress(lambda x: token.cancel() if x["phase"] == "commit" and x["processed"] == 19_800 else None, every=60))
        read, texts = [], []
        real, text = ranges.read, readers._text
        monkeypatch.setattr(ranges, "read", lambda spark, uri, first, size, *a: (read.append(size - first), real(spark, uri, first, size, *a))[1])
        monkeypatch.setattr(readers, "_text", lambda *a: (texts.append(a), text(*a))[1])
        report = runs.resume(spark, s)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert not texts and len(read) == 1 and read[0] < 0.05 * size
    assert (report["accepted"], report["statistics"]["processed_records_total"]) == (20_000, 200)
    got = spark.read.json(s.output["path"]).agg(F.count("*"), F.countDistinct("n"), F.sum(F.col("generated.n") - F.col("n"))).first()
    assert tuple(got) == (20_000, 20_000, 0)


def test_a_touched_source_is_read_and_compared(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"a":1}\n{"a":2}\n')
    source = {"type": "jsonl", "path": str(path)}
    mark, state = readers.marked(spark, source), readers.state(spark, source)
    assert readers.unchanged(spark, source, mark, state)
    os.utime(path, (1, 1))
    assert readers.unchanged(spark, source, mark, state)
    path.write_text('{"a":1}\n{"a": 2}\n')  # the same record in another spelling is another source
    assert not readers.unchanged(spark, source, mark, state)
