"""Record sources: rows (position, record), where record is one JSON object with sorted keys as text.

Positions are 1-based and follow the order of lines in files taken by path. They come from one count per input block,
so no row moves for them. A fatal row names the first position that fails; nothing after it is read into a result.

The blocks of JSONL sources (file, first byte, rows before) are a small table; a reading that goes on after a position
takes no file before that of its block, and of that file only what follows the block's first byte.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmill.functions import strictjson
from sparkmill.operators.records import RESERVED, reserved
from sparkmill.sources import ranges

MOST_BYTES = 8 << 20
MOST_FIELDS = 65_536
_LOCAL = (1 << 33) - 1


class SourceError(ValueError):
    """A source that cannot be read; the message holds a position and a rule, never a value. `position` is the row that
    cannot be read; the rows before it can."""

    def __init__(self, message: str, position: int = 1) -> None:
        super().__init__(message)
        self.position = position


def inline(spark: SparkSession, records: list) -> DataFrame:
    """Records listed in a specification; few by nature, and checked at once."""
    rows = []
    for k, r in enumerate(records, 1):
        if not isinstance(r, dict):
            raise SourceError(f"record {k} is not an object", k)
        if clash := [c for c in RESERVED if c in r]:
            raise SourceError(f"record {k} holds the reserved field {clash[0]}", k)
        rows.append((k, strictjson.dump(r)))
    return spark.createDataFrame(rows, "position long, record string")


@dataclass(frozen=True)
class Place:
    """Where a reading begins: a block of a file, and the rows before it."""

    file: str
    start: int
    before: int


def _placed(df: DataFrame) -> DataFrame:
    """Adds the block and the place in it to rows read straight from files."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL))
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), place.alias("_place"))


def _blocks(rows: DataFrame, base: int = 0) -> DataFrame:
    """(_file, _start, n, before, least) of rows with a block and a place in it, `base` rows being before all."""
    found = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("least"))
    before = F.sum("n").over(Window.orderBy("_file", "_start")) - F.col("n") + base  # one row per block, not per record
    return found.select("_file", "_start", "n", before.alias("before"), "least")


def _numbered(rows: DataFrame, base: int = 0) -> DataFrame:
    blocks = _blocks(rows, base).select("_file", "_start", (F.col("before") - F.col("least")).alias("_shift"))
    return rows.join(blocks, ["_file", "_start"]).withColumn("position", F.col("_place") + F.col("_shift") + 1).drop("_file", "_start", "_place", "_shift")


def numbered(df: DataFrame) -> DataFrame:
    """Adds `position` to rows read straight from files: lines before the block, and the place in the block."""
    return _numbered(_placed(df))


def _text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _placed(spark.read.option("lineSep", "\n").text(paths))


def listed(spark: SparkSession, path: str) -> list[tuple[str, str, int, int]]:
    """(address, path, bytes, time of change) of the files that Spark would read, in the order of positions."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, seen = [], [s for s in files.globStatus(at) or []]
    while seen:
        s = seen.pop()
        if s.isDirectory():
            seen += [c for c in files.listStatus(s.getPath()) if not c.getPath().getName().startswith((".", "_"))]
        else:
            found.append((_uri(s.getPath().toUri().toString()), s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(found)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a JSONL source, from one count of its lines."""
    return _blocks(_text(spark, path)).select("_file", "_start", "n", "before")


def place(blocks: DataFrame, committed: int) -> Place | None:
    """The block that the row after a position is in; None where no row follows."""
    found = blocks.filter(F.col("before") + F.col("n") > committed).orderBy("before").first()
    return found and Place(found["_file"], found["_start"], found["before"])


def _uri(path: str) -> str:
    """One spelling of local addresses."""
    return "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def lines(spark: SparkSession, path: str, since: Place | None = None) -> DataFrame:
    """(position, value) of the lines of a path, from a place on (or a little before it, where only Spark can open the
    file)."""
    if since is None:
        return _numbered(_text(spark, path))
    files = listed(spark, path)
    own, size = next((plain, size) for uri, plain, size, _ in files if uri == _uri(since.file))
    later = [plain for uri, plain, _, _ in files if uri > _uri(since.file)]
    local = own.removeprefix("file:") if own.startswith("file:") else _uri(since.file)
    if since.start and ranges.reachable(local):
        parts = [ranges.read(spark, local, since.start, size).withColumn("_file", F.lit(since.file))]
        base = since.before
    elif since.start:  # the whole file again: its rows before the place are those of its earlier blocks
        return lines(spark, path)
    else:
        parts, base, later = [], since.before, [own, *later]
    if later:
        parts.append(_text(spark, later))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return _numbered(rows, base)


def read_lines(spark: SparkSession, path: str, since: Place | None = None) -> DataFrame:
    """(position, record, problem) of lines that end with LF or CRLF (the last end may lack). Blank lines, bad JSON, other
    roots than objects, reserved fields and lines beyond 8 MiB have a problem."""
    found = lines(spark, path, since).select("position", F.regexp_replace("value", "\r$", "").alias("line"))
    rows = found.withColumn("record", strictjson.canonical("line")).withColumn("keys", F.map_keys(strictjson.fields("record")))
    problem = (
        F.when(F.octet_length("line") > MOST_BYTES, "longer than 8 MiB").when(F.trim("line") == "", "blank").when(F.col("record").isNull(), "not valid JSON")
        .when(F.col("keys").isNull(), "not an object").when(reserved(F.col("keys")), "holds a reserved field")
    )
    return rows.select("position", "record", problem.alias("problem"))


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(position, record); SourceError where a line has a problem."""
    rows, error = _stopped(read_lines(spark, path))
    if error:
        raise error
    return rows


def _stopped(rows: DataFrame) -> tuple[DataFrame, SourceError | None]:
    """The rows before the first that has a problem, and that problem."""
    bad = rows.filter("problem is not null").agg(F.min(F.struct("position", "problem")).alias("first")).first()["first"]
    if bad is None:
        return rows.select("position", "record"), None
    return rows.filter(F.col("position") < bad["position"]).select("position", "record"), SourceError(f"row {bad['position']}: {bad['problem']}", bad["position"])


def scan(spark: SparkSession, source: dict, since: Place | None = None) -> tuple[DataFrame, SourceError | None]:
    """The rows of a source up to its first error, and the error; JSONL sources may begin at a place."""
    if source["type"] == "inline":
        return inline(spark, source["records"]), None
    return _stopped(read_lines(spark, source["path"], since)) if source["type"] == "jsonl" else _stopped(read_csv(spark, source["path"]))


def csv_header(names: list[str]) -> list[str]:
    """The checked header; a byte order mark goes at the start of the file alone."""
    names = [names[0].removeprefix("﻿"), *names[1:]] if names else []
    if not names or any(not n.strip() for n in names):
        raise SourceError("the header is empty or has a blank name")
    if len(set(names)) < len(names):
        raise SourceError("the header repeats a name")
    if len(names) > MOST_FIELDS:
        raise SourceError("the header has too many fields")
    if clash := [n for n in names if n in RESERVED]:
        raise SourceError(f"the header holds the reserved field {clash[0]}")
    return names


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(position, record, problem) of a file with a header row: strings alone, quotes doubled inside quotes, line ends
    allowed in them. Ragged rows, rows beyond 8 MiB and bytes that are no UTF-8 have a problem."""
    options = {"quote": '"', "escape": '"', "multiLine": "true", "nullValue": "\0", "emptyValue": "", "encoding": "UTF-8", "maxCharsPerColumn": str(MOST_BYTES), "maxColumns": str(MOST_FIELDS)}
    first = spark.read.options(**options, header="false").csv(path).limit(1).collect()
    names = csv_header([x or "" for x in first[0]] if first else [])
    quoted = [f"`{n.replace('`', '``')}`" for n in names]
    ragged = "_ragged" + "_" * max(map(len, names))
    schema = ", ".join(f"{q} string" for q in [*quoted, f"`{ragged}`"])
    rows = numbered(spark.read.options(**options, header="true", enforceSchema="true", mode="PERMISSIVE", columnNameOfCorruptRecord=ragged).schema(schema).csv(path))
    own = {n: F.coalesce(F.col(q), F.lit("")) for n, q in zip(names, quoted, strict=True)}
    size = F.lit(0)
    for x in own.values():
        size = size + F.octet_length(x) + 1
    broken = F.lit(False)
    for x in own.values():
        broken = broken | x.contains("\ufffd")
    problem = F.when(F.col(f"`{ragged}`").isNotNull(), "has more or fewer fields than the header").when(size > MOST_BYTES, "longer than 8 MiB").when(broken, "not UTF-8")
    return rows.select("position", F.to_json(F.struct(*[own[n].alias(n) for n in sorted(names)])).alias("record"), problem.alias("problem"))


def csv(spark: SparkSession, path: str) -> DataFrame:
    """(position, record); SourceError where a row has a problem."""
    rows, error = _stopped(read_csv(spark, path))
    if error:
        raise error
    return rows


def fingerprint(rows: DataFrame) -> str:
    """A digest of all rows and their order, from one pass of partial sums; equal before and after a run that nobody
    changed the source under."""
    h = [F.sum(F.xxhash64(F.lit(k), "position", "record").cast("decimal(38,0)")).alias(f"h{k}") for k in range(4)]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *h).select(F.sha2(F.concat_ws(":", "n", "h0", "h1", "h2", "h3"), 256).alias("d")).first()
    return one["d"]


def marked(spark: SparkSession, source: dict) -> str:
    """The fingerprint of a source: of a JSONL source's bytes, line by line as they are, and of other sources' rows."""
    if source["type"] == "jsonl":
        return fingerprint(lines(spark, source["path"]).withColumnRenamed("value", "record"))
    return fingerprint(scan(spark, source)[0])


def state(spark: SparkSession, source: dict) -> list | None:
    """Names, sizes and times of change of a source's files: while these are as they were, so are their bytes."""
    return None if source["type"] == "inline" else [list(f) for f in listed(spark, source["path"])]


def unchanged(spark: SparkSession, source: dict, mark: str, before: list | None) -> bool:
    """Whether a source is as it was; its bytes are read where its files were touched."""
    return before is not None and state(spark, source) == before or marked(spark, source) == mark


def fields(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The rows with top-level fields of the record as columns of the given types."""
    v = F.parse_json("record")
    return rows.select("*", *[F.try_variant_get(v, f"$['{n}']", t).alias(n) for n, t in names.items()])
