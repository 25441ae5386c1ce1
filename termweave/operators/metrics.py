"""Metrics of judge calls: latency, tokens and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.sources.sinks import staged

#: Ranges that a counting pass cuts what is left of a group into.
RANGES = 4096
#: USD for a million tokens in and out, by model prefix, the first that fits. Fixed values.
PRICES = (("gpt-5-mini", 0.25, 2.00), ("gpt-5", 1.25, 10.00), ("gpt-4o-mini", 0.15, 0.60), ("gpt-4o", 2.50, 10.00))
#: Spellings of providers. Fixed values.
PROVIDERS = {"openai": "openai", "openai_api": "openai", "openai-open": "openai", "openai_open": "openai", "together": "together", "together_ai": "together", "together-ai": "together"}


#: Short names of models at one provider. Fixed values.
MODEL_ALIASES = {
    "mistral_small_24b": "mistralai/Mistral-Small-24B-Instruct-2501",
    "gpt_oss_20b": "openai/gpt-oss-20b",
    "llama4_maverick": "meta-llama/Llama-4-Maverick-17B-128E-Instruct-FP8",
}
ALIASED = "together"
#: Output tokens that a model may give, by the beginning of its name, and for all others. Fixed values.
CAPS, CAP = (("gpt-5", 128_000),), 2048


def provider(c: Column, default: str = "openai") -> Column:
    table = F.create_map(*(F.lit(x) for pair in PROVIDERS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), F.lit(default))


def price(model: Column) -> tuple[Column, Column]:
    """Price in and out by the first prefix that fits, 0 for unknown models."""
    low = F.lower(F.coalesce(model, F.lit("")))
    paid = [F.when(F.startswith(low, F.lit(PRICES[0][0])), PRICES[0][k]) for k in (1, 2)]
    for name, *values in PRICES[1:]:
        paid = [c.when(F.startswith(low, F.lit(name)), v) for c, v in zip(paid, values)]
    return paid[0].otherwise(0.0), paid[1].otherwise(0.0)


def model_name(provider_name: Column, model: Column) -> Column:
    """The stripped name, spelled out where the provider has short ones; null for an empty one."""
    table = F.create_map(*(F.lit(x) for pair in MODEL_ALIASES.items() for x in pair))
    name = F.nullif(F.trim(model), F.lit(""))
    return F.when(provider_name == ALIASED, F.coalesce(F.try_element_at(table, F.lower(name)), name)).otherwise(name)


def token_cap(model: Column) -> Column:
    """Output tokens that the model may give."""
    name = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    return F.coalesce(*(F.when(F.startswith(name, F.lit(p)), n) for p, n in CAPS), F.lit(CAP))


def cost(tokens_in: Column, tokens_out: Column, model: Column, provider_name: Column | None = None, prices: tuple[float, float] | None = None) -> Column:
    """USD of a call: by ``prices`` for a million tokens in and out if they are given, else by the model; other providers than the default one cost nothing."""
    per_in, per_out = map(F.lit, prices) if prices else price(model)
    if provider_name is not None and not prices:
        paid = provider(provider_name) == "openai"
        per_in, per_out = F.when(paid, per_in).otherwise(0.0), F.when(paid, per_out).otherwise(0.0)
    return tokens_in / 1e6 * per_in + tokens_out / 1e6 * per_out


def token_usage(c: Column) -> tuple[Column, Column, Column]:
    """(in, out, total) from usage JSON under any of its spellings; a total of 0 is the sum."""
    first = lambda *paths: F.coalesce(*(F.get_json_object(c, p).try_cast("bigint") for p in paths), F.lit(0).cast("bigint"))
    i = first("$.usage_metadata.input_tokens", "$.token_usage.prompt_tokens", "$.usage.prompt_tokens", "$.usage.input_tokens")
    o = first("$.usage_metadata.output_tokens", "$.token_usage.completion_tokens", "$.usage.completion_tokens", "$.usage.output_tokens")
    t = first("$.usage_metadata.total_tokens", "$.token_usage.total_tokens", "$.usage.total_tokens")
    return i, o, F.coalesce(F.nullif(t, F.lit(0)), i + o)


def call_records(answers: DataFrame, tag: str, model: str, provider_name: str = "openai", prices: tuple[float, float] | None = None) -> DataFrame:
    """A record for each of ``answers`` (usage, latency_ms, error, as ``score.asked`` gives them): what a call took and cost. One that failed has no tokens."""
    name = provider(F.lit(provider_name))
    called = F.lit(model) if model else F.lit(None).cast("string")
    tokens = [F.when(F.col("error").isNull(), c).otherwise(0).cast("long") for c in token_usage(F.col("usage"))]
    rows = answers.select(F.lit(tag).alias("tag"), "latency_ms", tokens[0].alias("tokens_in"), tokens[1].alias("tokens_out"), tokens[2].alias("tokens"), model_name(name, called).alias("model"), name.alias("provider"), F.col("error").isNull().alias("success"), "error")
    return rows.withColumn("cost_usd", cost(F.col("tokens_in"), F.col("tokens_out"), F.col("model"), F.col("provider"), prices))


def append_calls(records: DataFrame, path: str) -> None:
    """Add ``records`` to the log at ``path``; ``summary`` reads it."""
    records.write.mode("append").parquet(path)


def percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """by and, for each of ``shares`` (name: share from 0 to 1), the exact percentile of ``value``, interpolated; nulls and NaN don't count.

    A value of a given rank is found by counting: the span of a group is cut into even
    ranges, their counts say in which one it lies, and that one's least and greatest
    value are the next span, until they are equal. A pass divides the span by the number
    of ranges, so two or three do for most data. What a pass holds of a group is a count a range, and one row
    for each rank is kept between passes, however many distinct values there are.
    """
    v = F.col(value).cast("double")
    rows = rows.select(F.col(by).alias("by"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    spans = rows.groupBy("by").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    at = F.array(*(F.lit(float(s)) for s in shares.values()))
    place = F.explode(F.array_distinct(F.flatten(F.transform(at, lambda s: F.array(F.floor(s * (F.col("n") - 1)), F.ceil(s * (F.col("n") - 1)))))))
    left = staged(spans.select("by", "n", place.alias("rank"), "low", "high", F.lit(0).cast("long").alias("before")), "ranks")
    while left.where("low < high").limit(1).count():
        open_ = left.where("low < high")
        # Halves, so that the span of the largest doubles has a length.
        part = F.try_divide(F.col("v") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2)
        part = F.coalesce(part, F.when(F.col("v") > F.col("low"), 1.0).otherwise(0.0))  # the least doubles have no half
        seen = rows.join(open_, rows["by"].eqNullSafe(open_["by"])).drop(rows["by"]).where("v between low and high")
        seen = seen.withColumn("range", F.least(F.floor(part * ranges), F.lit(ranges - 1)))
        counts = seen.groupBy("by", "n", "rank", "before", "range").agg(F.count("*").alias("here"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("here").over(Window.partitionBy("by", "rank").orderBy("range"))  # at most ``ranges`` rows
        counts = counts.withColumn("upto", F.col("before") + upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("here") <= F.col("rank")))
        found = counts.select("by", "n", "rank", "low", "high", (F.col("upto") - F.col("here")).alias("before"))
        left = staged(found.unionByName(left.where("low >= high")), "ranks")
    held = F.map_from_entries(F.collect_list(F.struct("rank", "low")))  # two ranks a share

    def one(share: float) -> Column:
        pos = F.lit(float(share)) * (F.col("n") - 1)
        low, high = (F.element_at("held", f(pos)) for f in (F.floor, F.ceil))
        return low + (high - low) * (pos - F.floor(pos))

    return left.groupBy("by", "n").agg(held.alias("held")).select(F.col("by").alias(by), *(one(s).alias(name) for name, s in shares.items()))


def summary(calls: DataFrame, by: str | None = None) -> DataFrame:
    """Counts, latency and token sums of the calls (latency_ms, tokens, cost_usd, success), by tag or in all.

    Latencies are those of successful calls; percentiles interpolate.
    """
    ok = F.when(F.col("success"), F.col("latency_ms"))
    rows, key = (calls, by) if by else (calls.withColumn("_all", F.lit(True)), "_all")
    sums = rows.groupBy(key).agg(
        F.count("*").alias("calls"), F.count_if(F.col("success")).alias("succeeded"), F.avg(ok).alias("mean_ms"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd"),
    )
    exact = percentiles(rows.where("success"), key, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}).withColumnRenamed(key, "_of")
    out = sums.join(exact, F.col(key).eqNullSafe(F.col("_of")), "left")
    return out.select(*([by] if by else []), "calls", "succeeded", "mean_ms", "p50_ms", "p95_ms", "tokens", "cost_usd")
