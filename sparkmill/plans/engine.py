"""A pipeline as one declarative plan: every record is accepted, or rejected with the category of its first failure.

The order of failures is template, provider, reply, schema (after the allowed regenerations), judge, dedup field,
duplicate, sink. Templates, schemas and the mock provider are expressions; an HTTP provider is an Arrow stage whose
outcome is checkpointed, so that no call is made twice. Deduplication shuffles positions and keys, never records.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.functions import strictjson
from sparkmill.functions.template import text_variant, compile_template
from sparkmill.functions.validation import broken, compile_schema
from sparkmill.operators import dedup as dedups
from sparkmill.operators.checkpoints import cut
from sparkmill.plans import leases, providers
from sparkmill.plans.contracts import Contract
from sparkmill.plans.spec import Spec
from sparkmill.sources import readers, sinks

MODEL = "sparkmill-mock-1"
ENGINE = "sparkmill"

# The stage of each category, and a message that holds no value of a record.
STAGES = {"configuration": "configuration", "structured_output": "parse", "validation": "validate", "judge_output": "judge", "judge_score": "judge", "duplicate": "dedup", "dedup_field": "dedup", "sink_row": "sink"}
MESSAGES = {
    "configuration": "the provider cannot take the request", "template": "the template failed", "structured_output": "no JSON object could be read from the reply", "validation": "the reply broke a rule of the schema",
    "judge_output": "the judge's reply has no usable score", "judge_score": "the judge's score is too low", "duplicate": "an accepted record has the same key", "dedup_field": "a field of the key is missing or no text",
    "sink_row": "the row does not fit the output schema", "provider_timeout": "the provider took too long", "provider_network": "the provider could not be reached", "provider_http": "the provider answered with an error",
    "provider_response": "the provider's answer cannot be read", "provider_response_size": "the provider's answer is too long", "provider_refusal": "the provider refused", "provider_truncated": "the provider's answer was cut",
}


@dataclass(frozen=True)
class Earlier:
    """What rows that are committed already mean for the ones to come: their keys, or the index of their signatures."""

    keys: DataFrame | None = None
    index: dedups.Index | None = None


@dataclass
class Calls:
    """What the HTTP stages of a run share: the lease service with a pool for each provider, the folder that keeps replies
    (None: a checkpoint does), how many of the records from `first` on may still fail (None: no policy stops calls), and the
    user's own providers by name, which stand in for those of the specification."""

    service: leases.Service
    folder: str | None = None
    first: int = 1
    allowed: int | None = None
    stage: int = 0
    pools: dict[str, leases.Pool] = field(default_factory=dict)
    own: dict[str, Callable[[str, str | None], providers.Answer]] = field(default_factory=dict)
    process: str = field(default_factory=lambda: uuid.uuid4().hex)

    def begin(self, first: int, allowed: int | None) -> None:
        """Stages count from here: the records from `first` on go through all of them."""
        self.first, self.allowed, self.stage = first, allowed, 0

    def address(self, name: str, http: providers.Http) -> leases.Address:
        pool = self.pools.get(name)
        if pool is None:
            pool = self.pools[name] = leases.Pool(http.concurrency, http.requests_per_minute, http.tokens_per_minute, http.timeout_ms / 1000 + 30)
        pool.gate = None if self.allowed is None else leases.Gate(self.first, self.allowed)
        return self.service.add(name, pool)

    def kept(self, rows: DataFrame, ask: str, out: str, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The called rows. With a folder, each task's replies are there from its own commit on, so that a run which goes
        on after its driver was lost calls for no row whose task had ended. Calls that failed are made again then."""
        stage, self.stage = f"{self.folder}/{self.stage:03d}", self.stage + 1
        if self.folder is None:
            return cut(call(rows))
        files, own = sinks.Files(rows.sparkSession, stage), f"{stage}/{self.process}"
        wanted = rows.columns + [out]
        before = [f"{stage}/{n}" for n in files.names(stage) if n != self.process and any(x.endswith(".parquet") for x in files.names(f"{stage}/{n}"))]
        fresh, done = rows, None
        if before:
            done = cut(self._stored(rows, before).filter(F.col(f"{out}.category").isNull()).select(*wanted))
            fresh = rows.join(done.select("position", F.lit(True).alias("_held")), "position", "left").withColumn(ask, F.when(F.col("_held").isNull(), F.col(ask)))
        called = call(fresh)
        called = called.filter("_held is null") if before else called
        called.select(*wanted).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(own)
        got = self._stored(rows, [own]).select(*wanted)
        return got if done is None else got.unionByName(done)

    def _stored(self, rows: DataFrame, paths: list[str]) -> DataFrame:
        """What is kept of the rows; the files of earlier spans are passed over by their positions."""
        there = rows.sparkSession.read.parquet(*paths).filter(F.col("position") >= self.first)
        return there.join(rows.select("position"), "position", "left_semi")


@contextlib.contextmanager
def calling(spark: SparkSession, folder: str | None = None, own: dict | None = None) -> Iterator[Calls]:
    with leases.beside(spark) as service:
        yield Calls(service, folder, own=own or {})


def source(spark: SparkSession, spec: Spec) -> DataFrame:
    kind = spec.source["type"]
    if kind == "inline":
        return readers.inline(spark, spec.source["records"])
    return (readers.jsonl if kind == "jsonl" else readers.csv)(spark, spec.source["path"])


def _call(df: DataFrame, spec: Spec, name: str, applies: Column, prompt: str, feedback: str | None, out: str, context: dict[str, Column], calls: Calls | None, rejects: Callable[[dict], bool]) -> DataFrame:
    """Adds the reply of a provider to the rows that ask it."""
    provider, answer = spec.providers[name], calls.own.get(name) if calls else None
    if provider["type"] == "mock" and answer is None:
        own = {"prompt": text_variant(F.col(prompt)), "prompt_hash": text_variant(F.sha2(prompt, 256)), **context}
        if feedback:
            own["feedback"] = F.coalesce(text_variant(F.col(feedback)), F.parse_json(F.lit("null")))
        return df.withColumn(out, providers.mocked(compile_template(provider["response"], F.col("_r"), own), MODEL, applies))
    http = spec.http(name) if provider["type"] != "mock" else providers.Http("", name, concurrency=provider.get("concurrency", 1))
    asked = df.withColumn("_ask", F.when(applies, F.col(prompt))).drop("_r", "_g")
    with contextlib.ExitStack() as stack:
        shared = calls or stack.enter_context(calling(df.sparkSession))
        address = shared.address(name, http)
        tasks = df.sparkSession.sparkContext.defaultParallelism
        called = shared.kept(asked, "_ask", out, lambda rows: providers.called(rows, http, "_ask", feedback, out, tasks, address, F.col("category").isNotNull(), rejects, answer))
    return called.withColumn("_r", F.parse_json("record")).drop("_ask")


def _unusable(schema: object) -> Callable[[dict], bool]:
    """Whether a reply is no object of the schema."""

    def check(reply: dict) -> bool:
        try:
            value = strictjson.parse(reply["text"])
        except ValueError:
            return True
        return not isinstance(value, dict) or broken(schema, value) is not None

    return check


def _unpassed(name: str, least: float) -> Callable[[dict], bool]:
    """Whether a judge's reply has no score, or too low a one."""

    def check(reply: dict) -> bool:
        try:
            value = strictjson.parse(reply["text"])
        except ValueError:
            return True
        score = value.get(name) if isinstance(value, dict) else None
        return isinstance(score, bool) or not isinstance(score, (int, float)) or score < least

    return check


def prompted(rows: DataFrame, template: str) -> DataFrame:
    """Rows (position, record) with record_id, prompt (null where the template fails) and prompt_hash. The id is of the
    position and the canonical record; the record's variant is `_r`."""
    df = rows.withColumn("_r", F.parse_json("record"))
    df = df.withColumn("record_id", F.sha2(F.concat_ws(":", F.col("position").cast("string"), "record"), 256))
    return df.withColumn("prompt", compile_template(template, F.col("_r"))).withColumn("prompt_hash", F.sha2("prompt", 256))


def unstructured(canonical: str) -> Column:
    """Whether a reply, as its canonical spelling (null: no JSON), is no object."""
    return F.col(canonical).isNull() | (F.substring(canonical, 1, 1) != "{")


def generated(rows: DataFrame, spec: Spec, calls: Calls | None = None) -> DataFrame:
    """position, record, record_id, prompt, prompt_hash, generated (canonical), calls, category, stage and paths."""
    df = prompted(rows.select("position", "record"), spec.generate["prompt"])
    text = F.lit(None).cast("string")
    df = df.withColumns({"calls": F.array().cast(f"array<{providers.REPLY}>"), "generated": text, "category": F.when(F.col("prompt").isNull(), "template"), "stage": F.when(F.col("prompt").isNull(), "generate"), "broken": F.lit(None).cast("struct<instance_path:string,schema_path:string>"), "feedback": text, "again": F.col("prompt").isNotNull()})
    attempts = 1 + spec.generate.get("regenerate_on_invalid", 0)
    for attempt in range(attempts):
        if attempt:  # a plan that holds several attempts grows with their product
            df = cut(df.drop("_r")).withColumn("_r", F.parse_json("record"))
        df = _call(df, spec, spec.generate["provider"], F.col("again"), "prompt", "feedback", "reply", {}, calls, _unusable(spec.generate.get("output_schema", True)) if attempt == attempts - 1 else lambda _: False)
        df = df.withColumn("_c", strictjson.canonical(F.col("reply.text"))).withColumn("_g", F.try_parse_json("_c"))
        df = df.withColumn("_b", compile_schema(spec.generate.get("output_schema", True), F.col("_g")))
        failed = F.when(F.col("reply.category").isNotNull(), F.col("reply.category")).when(unstructured("_c"), "structured_output").when(F.col("_b").isNotNull(), "validation")
        df = df.withColumn("_failed", failed)
        now = lambda new, old: F.when(F.col("again"), new).otherwise(F.col(old))
        said = F.when(F.col("_failed") == "structured_output", MESSAGES["structured_output"]).when(F.col("_failed") == "validation", F.concat(F.lit("the value at '"), "_b.instance_path", F.lit("' breaks the rule "), "_b.schema_path"))
        stage = F.when(F.col("_failed") == "template", "mock").when(F.col("_failed").startswith("provider"), "generate").otherwise(F.col("_failed"))
        df = df.withColumns({"calls": F.when(F.col("again"), F.array_append("calls", F.col("reply"))).otherwise(F.col("calls")), "generated": now(F.when(F.col("_failed").isNull(), F.col("_c")), "generated"), "category": now(F.col("_failed"), "category"), "stage": now(stage, "stage"), "broken": now(F.col("_b"), "broken"), "feedback": said, "again": F.col("again") & F.coalesce(F.col("_failed").isin("structured_output", "validation"), F.lit(False))})
        df = df.drop("reply", "_c", "_g", "_b", "_failed")
    return df.drop("again", "feedback")


def scored(df: DataFrame, spec: Spec, calls: Calls | None = None) -> DataFrame:
    """Adds judge_call, judge_model and score, and rejects what the judge does not pass."""
    none = F.lit(None)
    if not spec.judge:
        return df.withColumns({"judge_call": none.cast(providers.REPLY), "score": none.cast("double"), "judged": F.lit(False)})
    j = spec.judge
    df = df.withColumn("_g", F.try_parse_json("generated")).withColumn("judged", F.col("category").isNull())
    df = df.withColumn("_jp", compile_template(j.prompt, F.col("_r"), {"generated": F.col("_g"), "prompt": text_variant(F.col("prompt"))}))
    df = _call(df, spec, j.provider, F.col("judged") & F.col("_jp").isNotNull(), "_jp", None, "judge_call", {"generated": F.try_parse_json("generated")}, calls, _unpassed(j.score_field, j.min_score))
    df = df.withColumn("_v", F.get(F.transform(F.array(strictjson.fields(F.col("judge_call.text"))), lambda m: F.try_element_at(m, F.lit(j.score_field))), F.lit(0)))
    number = F.when(F.col("_v").rlike(r"^-?[0-9]"), F.col("_v").cast("double"))
    df = df.withColumn("score", number)
    failed = F.when(F.col("_jp").isNull(), "template").when(F.col("judge_call.category").isNotNull(), F.col("judge_call.category")).when(F.col("score").isNull(), "judge_output").when(F.col("score") < j.min_score, "judge_score")
    stage = F.when(F.col("_jp").isNull(), "judge").when(F.col("judge_call.category") == "template", "mock")
    return df.withColumns({"category": F.when(F.col("judged"), failed).otherwise(F.col("category")), "stage": F.when(F.col("judged"), stage).otherwise(F.col("stage"))}).drop("_g", "_jp", "_v")


def _keyed(df: DataFrame, spec: Spec) -> DataFrame:
    """Adds `key`: the 256-bit key of exact dedup, or the text of MinHash; rejects rows that have none."""
    d = spec.dedup
    if d is None:
        return df.withColumn("key", F.lit(None).cast("string"))
    if d.method == "minhash":
        found = strictjson.key("generated", [d.field], False)
        df = df.withColumn("_k", found)
        text = F.get(F.from_json("_k", "array<string>"), F.lit(0))
        df = df.withColumn("key", F.when(F.col("_k").startswith('["'), text)).drop("_k")
    else:
        df = df.withColumn("key", F.sha2(strictjson.key("generated", d.fields, d.normalize == "lowercase"), 256))
    return df.withColumn("category", F.when(F.col("category").isNull() & F.col("key").isNull(), "dedup_field").otherwise(F.col("category")))


def reached(rows: DataFrame, spec: Spec, calls: Calls | None = None) -> DataFrame:
    """Every row with its category so far; those without one have passed all but dedup and the sink. Checkpointed."""
    return cut(_keyed(scored(generated(rows, spec, calls), spec, calls).drop("_r"), spec))


def admitted(df: DataFrame, spec: Spec, contract: Contract | None = None, earlier: Earlier | None = None) -> DataFrame:
    """`reached` rows after dedup and the sink: duplicates of accepted rows, and rows that the contract does not take."""
    row = strictjson.merged("record", ("generated", F.col("generated")), ("judge", F.to_json(F.when(F.col("judged"), F.struct(F.coalesce("judge_call.model", F.lit("")).alias("model"), F.lit(spec.judge.provider if spec.judge else "").alias("provider"), "score")))))
    df = df.withColumn("fits", F.when(F.col("category").isNull(), contract.fits(row)).otherwise(F.lit(True)) if contract else F.lit(True))
    if spec.dedup:
        able = df.filter("category is null").select("position", "key", "fits")
        d = spec.dedup
        if d.method == "exact":
            late = dedups.late_positions(able, earlier.keys if earlier else None)
        else:
            found = cut(dedups.minhash(able, "key", d.num_perm, d.bands, d.threshold, d.shingle_words, d.tokenization, d.shingle_chars, earlier.index if earlier else None, carry=True).select("position", "signature", "duplicate"))
            late = found.filter("duplicate").select("position")
            df = df.join(found.select("position", "signature"), "position", "left")
        df = df.join(late.withColumn("late", F.lit(True)), "position", "left").withColumn("category", F.coalesce("category", F.when(F.col("late"), "duplicate"))).drop("late")
    return df.withColumn("category", F.coalesce("category", F.when(~F.col("fits"), "sink_row"))).drop("fits")


def outcomes(rows: DataFrame, spec: Spec, contract: Contract | None = None, earlier: Earlier | None = None) -> DataFrame:
    """position, record, record_id, prompt_hash, generated, calls, judge_call, score, key, category, stage, broken."""
    return admitted(reached(rows, spec), spec, contract, earlier)


def _attempts() -> Column:
    return F.coalesce(F.aggregate("calls", F.lit(0).cast("long"), lambda a, c: a + F.coalesce(c["attempts"], F.lit(0))), F.lit(0))


def accepted(rows: DataFrame, spec: Spec, run_id: str, mark: str) -> DataFrame:
    """(position, row): the record's fields, the judge's evidence, the reply and the lineage as one JSON object."""
    last = F.element_at("calls", -1)
    meta = {"run_id": F.lit(run_id), "record_id": F.col("record_id"), "source_position": F.col("position"), "source_fingerprint": F.lit(mark), "pipeline_hash": F.lit(spec.digest()), "pipeline_version": F.lit(spec.version).cast("long"), "stage": F.lit("generate"), "attempt": _attempts(), "generator_provider": F.lit(spec.generate["provider"]), "generator_model": last["model"], "prompt_hash": F.col("prompt_hash"), "template_engine": F.lit(ENGINE)}
    evidence = F.lit(None).cast("string")
    if spec.judge:
        meta |= {"judge_provider": F.lit(spec.judge.provider), "judge_model": F.col("judge_call.model"), "judge_score": F.col("score")}
        evidence = F.to_json(F.struct(F.col("judge_call.model").alias("model"), F.lit(spec.judge.provider).alias("provider"), "score"))
    lineage = F.to_json(F.struct(*[meta[k].alias(k) for k in sorted(meta)]))
    good = rows.filter("category is null")
    return good.select("position", strictjson.merged("record", ("generated", F.col("generated")), ("judge", evidence), ("_meta", lineage)).alias("row"))


def rejected(rows: DataFrame, run_id: str) -> DataFrame:
    """(position, row): the diagnostic of each rejected record, without any of its values."""
    lookup = lambda table, default: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("category")), default)
    broken = F.col("category") == "validation"
    stage = F.when(F.col("category").isin("template"), F.col("stage")).otherwise(lookup(STAGES, F.lit("generate")))
    attempts = F.greatest(F.lit(1), _attempts())
    diagnostic = F.struct(attempts.alias("attempts"), "category", F.when(broken, F.col("broken.instance_path")).alias("instance_path"), lookup(MESSAGES, F.lit("the record failed")).alias("message"), F.when(broken, F.col("broken.schema_path")).alias("schema_path"), stage.alias("stage"))
    return rows.filter("category is not null").select("position", F.to_json(F.struct(diagnostic.alias("diagnostic"), "record_id", F.lit(run_id).alias("run_id"), F.col("position").alias("source_position")), {"ignoreNullFields": "false"}).alias("row"))
