"""Files through Spark's file systems: whole small texts, folders of rows, locks, and renames that never replace.

Rows are written beside their target and renamed to it when all is there. A small text (a manifest) is written under
another name and then renamed. Locks are advisory locks of the operating system where the folder is local, which end
with the process, and else files that only one can create.
"""

from __future__ import annotations

import fcntl
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SinkError(RuntimeError):
    pass


class LockError(RuntimeError):
    pass


class Files:
    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    @property
    def local(self) -> bool:
        return self._fs.getUri().getScheme() == "file"

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def folder(self, path: str) -> None:
        if not self._fs.mkdirs(self._at(path)):
            raise SinkError(f"{path} cannot be made")

    def delete(self, path: str) -> None:
        self._fs.delete(self._at(path), True)

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(path))) if self.exists(path) else []

    def move(self, old: str, new: str) -> None:
        """Renames; a target that exists is never replaced."""
        if self.exists(new) or not self._fs.rename(self._at(old), self._at(new)):
            raise SinkError(f"{new} exists")

    def read(self, path: str) -> str:
        if not self.exists(path):
            raise SinkError(f"{path} is missing")
        stream = self._fs.open(self._at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str, new: bool = False) -> None:
        """The whole text, or what was there before; with `new`, only where nothing is there."""
        if new:
            self._put(path, text, False)
            return
        beside = f"{path}.{uuid.uuid4().hex}"
        self._put(beside, text, True)
        if self.local:
            os.replace(self._plain(beside), self._plain(path))
            return
        options = self._jvm.org.apache.hadoop.fs.Options
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        rename = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        rename[0] = getattr(options, "Rename").OVERWRITE
        context.rename(self._at(beside), self._at(path), rename)

    def _plain(self, path: str) -> str:
        return self._at(path).toUri().getPath()

    def _put(self, path: str, text: str, over: bool) -> None:
        if self.local:
            try:
                with open(self._plain(path), "w" if over else "x") as f:
                    f.write(text)
                    f.flush()
                    os.fsync(f.fileno())
            except FileExistsError as e:
                raise SinkError(f"{path} exists") from e
            return
        if not over and self.exists(path):
            raise SinkError(f"{path} exists")
        out = self._fs.create(self._at(path), over)
        try:
            out.write(bytearray(text.encode()))
            out.hsync()
        finally:
            out.close()

    def lock(self, path: str) -> Lock:
        return Lock(self, path)


class Lock:
    """Held from `with` to its end; LockError at once where another run holds it."""

    def __init__(self, files: Files, path: str):
        self.files, self.path, self.handle = files, path, None

    def __enter__(self) -> Lock:
        if self.files.local:
            os.makedirs(os.path.dirname(self.files._plain(self.path)) or ".", exist_ok=True)
            self.handle = open(self.files._plain(self.path), "a")  # noqa: SIM115
            try:
                fcntl.flock(self.handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                self.handle.close()
                raise LockError("another run holds the run lock") from e
        else:
            try:
                self.files._put(self.path, "", False)
            except SinkError as e:
                raise LockError("another run holds the run lock, or left it") from e
        return self

    def __exit__(self, *_: object) -> None:
        if self.handle is not None:
            self.handle.close()
        else:
            self.files.delete(self.path)


def write_rows(rows: DataFrame, path: str) -> None:
    """(position, row) in source order: files sort by name as rows do by position."""
    rows.repartitionByRange("position").sortWithinPartitions("position").write.parquet(path)


def write_text(rows: DataFrame, path: str) -> None:
    """One row a line, in source order."""
    rows.repartitionByRange("position").sortWithinPartitions("position").select("row").write.text(path)


def write_typed(rows: DataFrame, path: str, schema, typed, batch_size: int) -> None:
    """Rows as the columns of a schema, `batch_size` rows a row group at most; no rows still give a file with the schema."""
    if rows.isEmpty():
        rows.sparkSession.createDataFrame([], schema).coalesce(1).write.parquet(path)
        return
    ordered = rows.repartitionByRange("position").sortWithinPartitions("position")
    ordered.select(typed.alias("t")).select("t.*").write.option("parquet.block.row.count.limit", str(batch_size)).parquet(path)


def summary(column: str) -> Column:
    """Number of rows and a digest of all of them with their positions, from partial sums."""
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(k), "position", column).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(3)]
    return F.struct(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", *sums).alias("digest"))


def digest(rows: DataFrame, column: str = "row") -> dict:
    return rows.agg(summary(column).alias("s")).first()["s"].asDict()
