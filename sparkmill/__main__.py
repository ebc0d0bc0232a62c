"""The command line: validate, plan, run, resume, inspect.

    python -m sparkmill run pipeline.json [--strict]

Reports are JSON on standard output, progress and errors JSON on standard error. Exit codes: 0 done, 1 refused before it
began or failed, 130 and 143 cancelled by SIGINT and SIGTERM; a second signal ends the process at once.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import signal
import sys

from pyspark.sql import SparkSession

from sparkmill.operators import inspect
from sparkmill.plans import runs, spec


def session() -> SparkSession:
    s = SparkSession.builder.appName("sparkmill").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def loaded(path: str, strict: bool = False) -> spec.Spec:
    """A checked specification; --strict is part of what its digest covers."""
    try:
        with open(path) as f:
            text = f.read()
    except OSError as e:
        raise spec.SpecError(f"cannot read {path}") from e
    out = spec.load(text, os.path.dirname(os.path.abspath(path)))
    return dataclasses.replace(out, errors=dataclasses.replace(out.errors, strict=True)) if strict else out


def watched(spark: SparkSession, token: runs.Token) -> list[int]:
    """Signals cancel the run's jobs; the first one seen is kept for the exit code."""
    seen: list[int] = []

    def stop(number: int, _: object) -> None:
        if seen:
            os._exit(128 + number)
        seen.append(number)
        token.cancel()
        spark.sparkContext.cancelAllJobs()

    for number in (signal.SIGINT, signal.SIGTERM):
        signal.signal(number, stop)
    return seen


def table(rows: list[dict]) -> str:
    names = ["name", "data_type", "count", "null_count", "min", "max", "mean", "distinct"]
    cells = [names, *[["-" if r[n] is None else str(r[n]) for n in names] for r in rows]]
    widths = [max(len(c[k]) for c in cells) for k in range(len(names))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(c, widths, strict=True)).rstrip() for c in cells)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkmill")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "plan", "run", "resume"):
        c = commands.add_parser(name)
        c.add_argument("pipeline")
        if name in ("run", "resume"):
            c.add_argument("--strict", action="store_true")
    c = commands.add_parser("inspect")
    c.add_argument("file")
    c.add_argument("--json", action="store_true")
    a = parser.parse_args(arguments)
    try:
        if a.command == "inspect":
            rows, size, columns = inspect.summarize(session(), os.path.abspath(a.file) if "://" not in a.file else a.file)
            found = [r.asDict() for r in columns.orderBy("name").collect()]  # a row for each column
            print(json.dumps({"path": a.file, "rows": rows, "bytes": size, "columns": found}) if a.json else f"{rows} rows, {size} bytes\n{table(found)}")
            return 0
        pipeline = loaded(a.pipeline, getattr(a, "strict", False))
        if a.command in ("validate", "plan"):
            print("valid" if a.command == "validate" else spec.plan(pipeline))
            return 0
    except (spec.SpecError, inspect.InspectError) as e:
        print(json.dumps({"error": {"category": "configuration", "message": str(e)}}), file=sys.stderr)
        return 1
    spark, token = session(), runs.Token()
    seen = watched(spark, token)
    try:
        report = (runs.run if a.command == "run" else runs.resume)(spark, pipeline, token, runs.Progress())
        print(json.dumps(report, sort_keys=True))
        return 0
    except (runs.RunFailed, runs.sinks.LockError) as e:
        if getattr(e, "report", None):
            print(json.dumps(e.report, sort_keys=True))
        print(json.dumps({"error": {"category": getattr(e, "category", "run"), "message": str(e)}}), file=sys.stderr)
        return 128 + seen[0] if seen else 1


if __name__ == "__main__":
    sys.exit(main())
