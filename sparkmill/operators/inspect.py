"""Dataset profiles: counts, types, exact extrema, overflow-safe means, distinct values, nearest-rank percentiles.

`profile` reads typed columns, `profile_json` the top-level fields of JSON rows, `summarize` a file of either kind.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmill.functions import strictjson
from sparkmill.operators import sampling
from sparkmill.operators.checkpoints import cut
from sparkmill.operators.ordering import running_total

MOST_DISTINCT = 1_000_000
#: Bytes that a distinct value and a column count for against a shared budget.
DISTINCT_BYTES, COLUMN_BYTES = 128, 512


class InspectError(ValueError):
    pass


@dataclass(frozen=True)
class Limits:
    row_bytes: int = 32 << 20
    statistics_bytes: int = 64 << 20
    columns: int = 4096


def mean(x: Column) -> Column:
    """The mean of doubles whose sum may overflow: sums of values scaled by a power of two (exact) cannot."""
    scale = F.lit(2.0**-60)
    return F.when(F.max(F.abs(x)) > 1e290, F.sum(x * scale) / F.count(x) / scale).otherwise(F.avg(x))


def _kind(f: T.StructField) -> str:
    for kind, name in ((T.NumericType, "number"), (T.BooleanType, "boolean"), (T.ArrayType, "array"), (T.StructType, "object"), (T.MapType, "object")):
        if isinstance(f.dataType, kind):
            return name
    return "string"


def profile(df: DataFrame, most_distinct: int | None = MOST_DISTINCT) -> DataFrame:
    """One row per column: name, data_type, count, null_count, min, max, mean, distinct (null beyond the cap; without a cap,
    exact for any number of values).

    Extrema are compared in the column's own type and shown as text, so none is rounded.
    """
    one = []
    for f in df.schema.fields:
        c, x = F.col(f"`{f.name}`"), F.col(f"`{f.name}`").cast("double")
        numeric = isinstance(f.dataType, T.NumericType)
        low, high = (F.min(c), F.max(c)) if numeric else (F.lit(None), F.lit(None))
        one += [F.count(c).alias(f"{f.name}|count"), low.alias(f"{f.name}|min"), high.alias(f"{f.name}|max"), (F.round(mean(x), 6) if numeric else F.lit(None)).cast("double").alias(f"{f.name}|mean")]
    totals = df.agg(F.count(F.lit(1)).alias("|rows"), *one)

    def part(f: T.StructField) -> DataFrame:
        # Counted by itself: values combine on the map side, and rows are not multiplied by the number of columns.
        distinct = df.select(F.col(f"`{f.name}`").alias("v")).filter("v IS NOT NULL").distinct().agg(F.count(F.lit(1)).alias("distinct"))
        at = lambda k: F.col(f"`{f.name}|{k}`")
        row = totals.select(F.lit(f.name).alias("name"), F.lit(_kind(f)).alias("data_type"), at("count").alias("count"), (F.col("`|rows`") - at("count")).alias("null_count"), at("min").cast("string").alias("min"), at("max").cast("string").alias("max"), at("mean").alias("mean"))
        row = row.join(distinct)  # one row each
        return row if most_distinct is None else row.withColumn("distinct", F.when(F.col("distinct") <= most_distinct, F.col("distinct")))

    return reduce(DataFrame.unionByName, map(part, df.schema.fields))


def _budgeted(counted: DataFrame, limits: Limits) -> DataFrame:
    """The columns' figures with distinct null where the budget has no room for its values; too many columns are refused."""
    counted = cut(counted)  # a row per column, kept, so that the checks read no row again
    charge = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("name") + COLUMN_BYTES), F.lit(0)).alias("bytes")).first()
    if charge["n"] > limits.columns or charge["bytes"] > limits.statistics_bytes:
        raise InspectError("inspect column statistics budget exceeded")
    # The budget that names leave is shared; a column takes its share in the order of its size, the smallest first.
    left = (limits.statistics_bytes - charge["bytes"]) // DISTINCT_BYTES
    shared = running_total(counted.select("distinct", "name"), ["distinct", "name"], F.col("distinct")).select("name", "upto")  # a row per column
    return counted.join(shared, "name").withColumn("distinct", F.when(F.col("upto") <= left, F.col("distinct")))


def profile_json(rows: DataFrame, limits: Limits | None = None, most_distinct: int | None = None) -> DataFrame:
    """The profile of the top-level fields of JSON rows (`record`, in any spelling): data_type is a JSON type, `mixed` or
    `empty`; an absent field counts as null; numbers alone count for min, max and mean, which compare whole numbers and
    fractions exactly; values are distinct by their spelling. Rows that are not objects count as rows.

    Exact for any number of columns and values; distinct is null beyond a cap or a budget only where the caller names one.
    Equal texts are read once."""
    total = rows.agg(F.count(F.lit(1)).alias("rows"))
    texts = rows.groupBy("record").agg(F.count(F.lit(1)).alias("n"))
    fields = texts.select("n", F.explode(strictjson.fields("record")).alias("name", "value"))
    first = F.substring("value", 1, 1)
    kind = F.when(F.col("value") == "null", None).when(first == '"', "string").when(first == "{", "object").when(first == "[", "array").when(F.col("value").isin("true", "false"), "boolean").otherwise("number")
    typed = fields.withColumn("kind", kind)
    # One row for each name and value; a double is exact in its shortest spelling, so extrema are found among distinct ones.
    values = typed.groupBy("name", "kind", "value").agg(F.sum("n").alias("n"))
    number = F.when(F.col("kind") == "number", F.col("value").cast("double"))
    # Doubles order numbers up to rounding; whole numbers of up to 38 digits that round alike are told apart as decimals.
    place = F.struct(number.alias("x"), F.coalesce(F.try_to_number(F.regexp_extract("value", r"^-?[0-9]{1,38}$", 0), F.lit("S" + "9" * 38)), number.cast("decimal(38,0)")).alias("y"), "value")
    known = F.when(F.col("kind") == "number", place)
    weighted = F.sum(F.when(number.isNotNull(), number * 2.0**-60 * F.col("n"))) / F.sum(F.when(number.isNotNull(), F.col("n"))) / F.lit(2.0**-60)
    plain = F.sum(F.when(number.isNotNull(), number * F.col("n"))) / F.sum(F.when(number.isNotNull(), F.col("n")))
    counted = values.groupBy("name").agg(
        F.sum(F.when(F.col("kind").isNotNull(), F.col("n")).otherwise(0)).alias("count"), F.count_if(F.col("kind").isNotNull()).alias("distinct"), F.collect_set("kind").alias("kinds"),
        F.min(known).getField("value").alias("min"), F.max(known).getField("value").alias("max"), F.when(F.max(F.abs(number)) > 1e290, weighted).otherwise(plain).alias("mean"),
    )
    counted = counted.withColumn("data_type", F.when(F.size("kinds") == 0, "empty").when(F.size("kinds") > 1, "mixed").otherwise(F.get("kinds", F.lit(0))))
    if limits is not None:
        counted = _budgeted(counted, limits)
    if most_distinct is not None:
        counted = counted.withColumn("distinct", F.when(F.col("distinct") <= most_distinct, F.col("distinct")))
    return counted.join(total).select("name", "data_type", "count", (F.col("rows") - F.col("count")).alias("null_count"), "min", "max", "mean", "distinct")  # one row of totals


def summarize(spark: SparkSession, path: str, limits: Limits | None = None) -> tuple[int, int, DataFrame]:
    """Rows, bytes, and the profile of a .jsonl, .ndjson or .parquet file or folder; other names are refused."""
    limits = limits or Limits()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    form = path.rstrip("/").rsplit(".", 1)[-1]
    if form == "parquet":
        df = spark.read.parquet(path)
        if len(df.columns) > limits.columns:
            raise InspectError("inspect column statistics budget exceeded")
        return df.count(), size, profile(df)
    if form not in ("jsonl", "ndjson"):
        raise InspectError("inspect supports .jsonl and .parquet files")
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.octet_length("value").alias("bytes"), strictjson.canonical("value").alias("record"))
    bad = lines.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("bytes"), F.lit(0)).alias("most"), F.count_if(F.col("record").isNull()).alias("bad")).first()
    if bad["most"] >= limits.row_bytes:
        raise InspectError("inspect row exceeds byte limit")
    if bad["bad"]:
        raise InspectError("invalid JSON row")
    return bad["n"], size, profile_json(lines.select("record"), limits, MOST_DISTINCT)


def nearest_ranks(df: DataFrame, value: str, ranks: dict[str, float]) -> DataFrame:
    """Values at rank round((n - 1) f), by running totals over the counts of distinct values."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    run = running_total(counted, [value], F.col("n"))
    total = F.broadcast(run.agg(F.max("upto").alias("total")))  # one row
    return run.join(total).agg(*[F.min(F.when(F.col("upto") >= F.round((F.col("total") - 1) * f) + 1, F.col(value))).alias(k) for k, f in ranks.items()])


def latency(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """mean_ms, p50_ms, p95_ms, p99_ms. The mean is of all rows; percentiles are exact, or, where `keys` name the rows, those
    of a bounded sample."""
    at = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    ranks = nearest_ranks(df, value, at) if keys is None else sampling.percentiles(df, value, keys, at)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return df.agg(F.avg(value).alias("mean_ms")).join(ranks).select(*[zero(c) for c in ("mean_ms", "p50_ms", "p95_ms", "p99_ms")])  # one row each
