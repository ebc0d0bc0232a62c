"""Counters, latencies, tokens and costs of processed records, as aggregates over their outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.operators import inspect
from sparkmill.plans.spec import Price, Spec


def counters(done: DataFrame) -> DataFrame:
    """One row: how many calls, failures and rejections of each kind the processed records had."""
    good = F.size(F.filter("calls", lambda c: c["category"].isNull()))
    own = lambda k: F.count_if(F.coalesce(F.col("category") == k, F.lit(False)))
    unusable = F.col("judged") & (F.col("judge_call.category").isNotNull() | F.coalesce(F.col("category") == "judge_output", F.lit(False)))
    zero = F.lit(0).cast("long")
    tokens = lambda n: F.sum(F.aggregate("calls", zero, lambda a, c: a + F.coalesce(c[n], zero)) + F.coalesce(F.col(f"judge_call.{n}"), zero))
    out = {
        "processed_records_total": F.count(F.lit(1)), "generation_requests_total": F.sum(F.size("calls")), "generation_success_total": F.sum(good), "generation_failed_total": F.sum(F.size("calls") - good),
        "regeneration_attempts_total": F.sum(F.greatest(F.size("calls") - 1, F.lit(0))), "prompt_tokens_total": tokens("prompt_tokens"), "completion_tokens_total": tokens("completion_tokens"),
        "judge_requests_total": F.count_if("judged"), "judge_rejected_total": own("judge_score"), "judge_failed_total": F.count_if(unusable), "duplicate_records_total": own("duplicate"),
        "template_failed_total": F.count_if(F.coalesce((F.col("category") == "template") & (F.col("stage") == "generate"), F.lit(False))), "structured_output_failed_total": own("structured_output"), "validation_failed_total": own("validation"),
        "accepted_records_total": F.count_if(F.col("category").isNull()), "rejected_records_total": F.count_if(F.col("category").isNotNull()),
    }
    return done.agg(*[F.coalesce(v.cast("long"), F.lit(0)).alias(k) for k, v in out.items()])


def by_category(rows: DataFrame) -> DataFrame:
    """How many rows have each category."""
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def calls(done: DataFrame, spec: Spec) -> DataFrame:
    """(provider, call, position, nth) of every logical call: the calls of generation from 0 on, the judge's as -1."""
    generate = done.select(F.lit(spec.generate["provider"]).alias("provider"), "position", F.posexplode("calls").alias("nth", "call"))
    judge = done.filter("judge_call is not null").select(F.lit(spec.judge.provider if spec.judge else "").alias("provider"), "position", F.lit(-1).alias("nth"), F.col("judge_call").alias("call"))
    return generate.unionByName(judge)


def usage(every: DataFrame) -> DataFrame:
    """By provider: tokens that successful calls returned, and physical requests, retries, reported tokens and latency."""
    c = lambda n: F.coalesce(F.sum(f"call.{n}"), F.lit(0)).cast("long")
    returned = F.coalesce(F.sum(F.when(F.col("call.category").isNull(), F.lit(1))), F.lit(0)).cast("long")
    return every.groupBy("provider").agg(
        returned.alias("returned"), c("prompt_tokens").alias("prompt_tokens"), c("completion_tokens").alias("completion_tokens"), c("requests").alias("requests"),
        (F.sum("call.requests") - F.count_if(F.col("call.requests") > 0)).cast("long").alias("retries"), c("usage_reports").alias("usage_reports"), c("billed_prompt").alias("billed_prompt"), c("billed_completion").alias("billed_completion"), F.sum("call.latency_ms").alias("latency_ms"),
    )


def prices(spark: SparkSession, named: dict[str, Price]) -> DataFrame:
    return spark.createDataFrame([(k, float(p.input_usd_per_mtok), float(p.output_usd_per_mtok)) for k, p in named.items()], "provider string, price_in double, price_out double")


def costs(tokens: DataFrame, named: dict[str, Price], default: Price | None = None) -> DataFrame:
    """`tokens` (provider, prompt_tokens, completion_tokens) with `cost` in USD, by the provider's own price or the default
    one; null where there is neither."""
    table = F.broadcast(prices(tokens.sparkSession, named))  # a row for each price of a specification
    price = lambda own, other: F.coalesce(F.col(own), F.lit(float(other)) if default else F.lit(None).cast("double"))
    cost = (F.col("prompt_tokens") * price("price_in", default.input_usd_per_mtok if default else 0) + F.col("completion_tokens") * price("price_out", default.output_usd_per_mtok if default else 0)) / 1e6
    return tokens.join(table, "provider", "left").withColumn("cost", cost).drop("price_in", "price_out")


def total_cost(costed: DataFrame) -> DataFrame:
    """One row: the sum of all costs, null where a provider has none."""
    return costed.agg(F.when(F.count_if(F.col("cost").isNull()) == 0, F.coalesce(F.sum("cost"), F.lit(0.0))).alias("total"))


def report(done: DataFrame, spec: Spec, elapsed: float) -> dict:
    """What a manifest holds of one attempt's processed rows."""
    out = counters(done).first().asDict()
    every = calls(done, spec)
    out["latency_calls_total"] = every.count()
    out["latency"] = inspect.latency(every.select("position", "nth", F.col("call.latency_ms").alias("ms")), "ms", ["position", "nth"]).first().asDict()
    rows = {r["provider"]: r.asDict() for r in usage(every).collect()}  # a row for each provider of the specification
    out["provider_usage_by_name"] = rows
    out["returned_tokens_by_provider"] = {k: {n: r[n] for n in ("prompt_tokens", "completion_tokens")} for k, r in rows.items() if r["returned"]}
    out["elapsed_seconds"], out["records_per_second"] = elapsed, out["processed_records_total"] / max(elapsed, 1e-9)
    billable = [(k, r["billed_prompt"] if r["usage_reports"] else r["prompt_tokens"], r["billed_completion"] if r["usage_reports"] else r["completion_tokens"]) for k, r in rows.items() if r["returned"] or r["usage_reports"]]
    if spec.pricing or spec.provider_pricing:
        costed = costs(done.sparkSession.createDataFrame(billable, "provider string, prompt_tokens long, completion_tokens long"), spec.provider_pricing, spec.pricing)
        out["estimated_cost_by_provider"] = {r["provider"]: r["cost"] for r in costed.collect() if r["cost"] is not None}
        out["estimated_cost_usd"] = total_cost(costed).first()["total"]
    return out
