"""A corpus pipeline: quality rules, exact dedup, n-gram Jaccard join, PII redaction, best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each result is written as Parquet
in the shared folder and read again as the next stage's input, so a lost executor costs at most one stage. A stage's
input is removed once its result is written; the last result stays for as long as the shared folder keeps it.

Null and empty texts have no words, so the first stage rejects them, and an empty table passes through all stages.
Repeated rows are one after exact dedup; ties go to the smallest doc_id. Texts are taken whole, and extra columns of
documents are carried up to packing, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.llm import bestfit_packing, exact_dedup, ngram_join, pii, quality_rules
from sparkmill.llm.common import session_paths
from sparkmill.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a threshold rejects go."""
    return quality_rules.keep(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the best stays."""
    return exact_dedup.dedup(docs).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays."""
    return ngram_join.keep_one(docs).select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence."""
    return bestfit_packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_join", near), ("pii", private), ("packing", packing)]

#: Tokens, contexts and components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_paths(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            files.delete(path(before), True)
        before = at
    return docs
