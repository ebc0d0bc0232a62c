"""Commits hosted by Structured Streaming: every micro-batch of a folder of JSONL files is one commit.

The stream's checkpoint is the position in the source; a batch that was written before a crash and comes again is
recognised by its number and written once. No event time is involved, and nothing is late.

Exact keys are in the stream's state store: a batch costs what its rows cost, however many batches came before, and a
restarted stream has the keys of the batches that were committed. A store for more keys than memory holds is the session's
to choose (spark.sql.streaming.stateStore.providerClass). MinHash is greedy across buckets, which no state of one key
decides: batches keep signatures and buckets of what they accept beside their rows, and a batch probes the buckets of
earlier ones; no text is signed twice, and accepted rows are not compared again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkmill.functions import strictjson
from sparkmill.operators import dedup
from sparkmill.operators.checkpoints import cut
from sparkmill.operators.ordering import positions
from sparkmill.sources.sinks import Files

#: Positions of a batch start at its number times this.
BATCH = 1 << 40


def lines(spark: SparkSession, folder: str, files_per_commit: int = 1) -> DataFrame:
    """The lines of files that appear in a folder, each with its canonical record (null where it is not JSON)."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_commit).text(folder).select(strictjson.canonical("value").alias("record"))


def _hosted(rows: DataFrame, checkpoint: str, commit) -> StreamingQuery:
    return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exact_commits(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the first of equal records (key, record), one folder for each commit; ends when what is there has been taken."""
    files = Files(rows.sparkSession, path)
    fresh = rows.filter("record is not null").select(dedup.digest(["record"]).alias("key"), "record").dropDuplicates(["key"])

    def commit(batch: DataFrame, number: int) -> None:
        at = f"{path}/{number:08d}"
        if not files.exists(f"{at}/_SUCCESS"):  # else written before a crash, and asked for again
            batch.write.mode("overwrite").parquet(at)

    return _hosted(fresh, checkpoint, commit)


def minhash_commits(rows: DataFrame, path: str, checkpoint: str, field: str, num_perm: int = 128, bands: int = 16, threshold: float = 0.8, words: int = 3, tokenization: str = "words", chars: int = 3) -> StreamingQuery:
    """Writes records (position, record) whose text at a top-level field is like none that was accepted before, in the
    order of files and lines; a commit's folder holds rows, signatures and bands. Records without the text are left out."""
    spark = rows.sparkSession
    files = Files(spark, path)
    dedup.check_parameters(num_perm, bands, threshold, words, tokenization, chars)

    def commit(batch: DataFrame, number: int) -> None:
        at = f"{path}/{number:08d}"
        if files.exists(f"{at}/rows/_SUCCESS"):
            return
        own = cut(batch.filter("record is not null").select("record", F.monotonically_increasing_id().alias("line")))
        own = own.withColumn("text", F.try_variant_get(F.try_parse_json("record"), F.lit(f"$['{field}']"), "string")).filter("text is not null")
        own = cut(positions(own, ["line"]).withColumn("position", F.col("position") + number * BATCH).drop("line"))
        earlier = [f"{path}/{n}" for n in files.names(path) if n.isdigit() and int(n) < number and files.exists(f"{path}/{n}/rows/_SUCCESS")]
        before = dedup.Index(*[spark.read.parquet(*[f"{p}/{part}" for p in earlier]) for part in ("bands", "signatures")]) if earlier else None
        kept = cut(dedup.minhash(own, "text", num_perm, bands, threshold, words, tokenization, chars, before, carry=True).filter("NOT duplicate"))
        kept.select("position", "signature").write.mode("overwrite").parquet(f"{at}/signatures")
        dedup.bands(kept, bands, num_perm).write.mode("overwrite").parquet(f"{at}/bands")
        kept.select("position", "record").write.mode("overwrite").parquet(f"{at}/rows")  # last: it marks the commit

    return _hosted(rows, checkpoint, commit)
