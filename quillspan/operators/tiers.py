"""Length tiers: histograms, even picks, summaries, cost projection, scaling, token statistics, throttling and memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.text import TIER_BOUNDS, clock_ratio, let, tier_label, tier_of
from quillspan.operators.quantiles import exact_percentiles, join_groups

OVERHEAD, OVERHEAD_ASKED = 37, 41  # fixed values: tokens of the template without and with a question


def tier_list(spark: SparkSession, bounds: tuple[int, ...] = TIER_BOUNDS) -> DataFrame:
    return spark.range(len(bounds)).select(F.col("id").cast("int").alias("tier"))


def prompt_tokens(context: Column, question: Column, response: Column) -> Column:
    """Token counts added up with the template's overhead."""
    return context + question + response + F.when(question > 0, OVERHEAD_ASKED).otherwise(OVERHEAD)


def histogram(df: DataFrame, corpus: str, n: str, bounds: tuple[int, ...] = TIER_BOUNDS, cap: int | None = None) -> DataFrame:
    """``corpus``, ``tier``, ``tier_label``, ``n_samples`` with zeros for empty tiers; tiers above ``cap`` count in it."""
    tier = tier_of(F.col(n), bounds) if cap is None else F.least(tier_of(F.col(n), bounds), F.lit(cap))
    counts = df.groupBy(corpus, tier.alias("tier")).agg(F.count(F.lit(1)).alias("n_samples"))
    every = counts.select(corpus).distinct().crossJoin(F.broadcast(tier_list(df.sparkSession, bounds if cap is None else bounds[: cap + 1])))
    return every.join(counts, [corpus, "tier"], "left").select(corpus, "tier", tier_label(F.col("tier"), bounds).alias("tier_label"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"))


def _range_of(splits: Column, key: Column) -> Column:
    """How many of at most 255 sorted ``splits`` lie below ``key``, by sixteens and then within one."""
    below = lambda c: F.size(F.filter(c, lambda s: s < key))
    coarse = F.filter(splits, lambda _, i: i % 16 == 15)
    return let(below(coarse), lambda i: i * 16 + below(F.slice(splits, i * 16 + 1, 15)))


def spread(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """``n`` rows of each group evenly over its order with both ends, all rows of a smaller group; repeats of a place count once.

    Places are ``i * (size - 1) / (n - 1)`` rounded half to even, the last one pinned to the end; one place is the first row.
    A group is cut into 256 ranges of its whole order at the keys of a fixed sample of its rows; the ranges are counted, and
    only the rows of those that hold a wanted place are numbered. A value of the first column that all rows share is cut by
    the next ones; rows that are equal in all of ``order`` are interchangeable and stay in one range.
    """
    key = F.struct(*order)
    drawn = df.select(*by, key.alias("_key")).withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("_key")))).where("_nth < 256")
    splits = drawn.groupBy(*by).agg(F.sort_array(F.collect_set("_key")).alias("_splits"))
    rows = join_groups(df, splits, by).withColumn("_range", _range_of(F.col("_splits"), key)).drop("_splits")
    counts = rows.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_range"))
    counts = counts.withColumn("_from", upto - F.col("_c")).withColumn("_size", F.sum("_c").over(Window.partitionBy(*by)))
    step = (F.col("_size") - 1) / F.lit(float(max(n - 1, 1)))
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when((i == n - 1) & F.lit(n > 1), F.col("_size") - 1).otherwise(F.rint(i * step).cast("bigint")))
    inside = F.filter(F.transform(places, lambda p: p - F.col("_from")), lambda p: (p >= 0) & (p < F.col("_c")))
    wanted = counts.select(*by, "_range", (F.col("_size") <= n).alias("_all"), inside.alias("_places")).where(F.col("_all") | (F.size("_places") > 0))
    met = join_groups(rows, wanted, [*by, "_range"]).where(F.col("_all").isNotNull())
    met = met.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1)
    return met.where(F.col("_all") | F.array_contains("_places", F.col("_at").cast("bigint"))).select(df.columns)


def tier_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Timings by tier; percentiles are exact with linear interpolation."""
    total = lambda c: F.sum(F.col(c).cast("bigint"))
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples"), F.avg("n_tokens").alias("mean_tokens"), F.avg("end_to_end_ms").alias("mean_ms"), F.max("peak_vram_mb").alias("peak_vram_mb"), F.avg("n_chunks").alias("mean_chunks"), total("truncated").alias("n_truncated"), total("nonfinite").alias("n_nonfinite"))
    places = exact_percentiles(df, by, {"median_ms": ("end_to_end_ms", 0.5), "p90_ms": ("end_to_end_ms", 0.9), "forward_median_ms": ("forward_ms", 0.5)})
    return join_groups(sums, places, by).withColumn("forward_share", F.col("forward_median_ms") / F.col("median_ms"))


def project_cost(hist: DataFrame, cost: DataFrame, corpus: str = "corpus", quota_hours: float = 30.0) -> DataFrame:
    """Seconds, hours, ms a sample and percent of the quota; ``cost`` has ``tier``, ``seconds``; tiers without a cost drop out."""
    met = hist.join(F.broadcast(cost.select("tier", "seconds")), "tier")
    total = met.groupBy(corpus).agg(F.sum(F.col("n_samples") * F.col("seconds")).alias("seconds"), F.sum("n_samples").alias("n_samples"))
    return total.select(corpus, "n_samples", "seconds", (F.col("seconds") / 3600).alias("hours"), (F.col("seconds") * 1000 / F.greatest("n_samples", F.lit(1))).alias("ms_per_sample"), (F.col("seconds") / 36 / quota_hours).alias("quota_pct"))


def unmeasured_tiers(hist: DataFrame, cost: DataFrame, corpus: str = "corpus") -> DataFrame:
    return hist.where("n_samples > 0").join(cost, "tier", "left_anti").select(corpus, "tier", "n_samples")


def scaling_exponent(summaries: DataFrame, by: list[str], length: str = "mean_tokens", cost: str = "median_ms", untruncated_only: bool = True) -> DataFrame:
    """Least-squares slope of log cost on log length over tiers without truncation; NaN with fewer than two."""
    use = F.col("n_truncated") == 0 if untruncated_only else F.lit(True)
    x, y = F.when(use, F.ln(length)), F.when(use, F.ln(cost))
    slope = F.when(F.count(x) < 2, F.lit(float("nan"))).otherwise(F.coalesce(F.regr_slope(y, x), F.lit(float("nan"))))
    return (summaries.groupBy(*by) if by else summaries).agg(slope.alias("exponent"), F.count(x).alias("n_tiers"))


def token_stats(df: DataFrame, by: list[str], context_tokens: str, other_tokens: str, words: str, context: str, thresholds: tuple[int, ...] = (2048, 4096)) -> DataFrame:
    """Samples, distinct contexts, tokens a word, percentiles of context and total, and counts over thresholds."""
    ctx, total = F.col(context_tokens), F.col(context_tokens) + F.col(other_tokens)
    aggs = [F.count(F.lit(1)).alias("n_samples"), F.countDistinct(context).alias("n_unique_contexts"), (F.sum(ctx) / F.greatest(F.sum(words), F.lit(1))).alias("tokens_per_word"), F.max(ctx).cast("double").alias("ctx_max"), F.max(total).cast("double").alias("total_max")]
    for t in thresholds:
        over = (total > t).cast("int")
        aggs += [(F.avg(over) * 100).alias(f"over_{t}"), F.sum(over).cast("bigint").alias(f"n_over_{t}")]
    wanted = {f"{name}_p{int(p * 100)}": (c, p) for name, c, ps in (("ctx", ctx, (0.5, 0.9, 0.99)), ("total", total, (0.5, 0.99))) for p in ps}
    return join_groups(df.groupBy(*by).agg(*aggs), exact_percentiles(df, by, wanted), by)


def parse_telemetry(line: Column) -> Column:
    """Struct of the four numbers and the clock ratio, or null if the line has another number of fields or one isn't a number."""
    parts = F.split(line, ",", -1)
    value = [F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in range(4)]
    ok = F.size(parts) == 4
    for v in value:
        ok = ok & v.isNotNull()
    names = ("temperature_c", "sm_clock_mhz", "sm_clock_max_mhz", "utilization_pct")
    return F.when(ok, F.struct(*[v.alias(n) for v, n in zip(value, names, strict=True)], clock_ratio(value[1], value[2]).alias("clock_ratio")))


def throttling(df: DataFrame, by: list[str], order: str, drop_points: float = 2.0, heat_rise: float = 5.0) -> DataFrame:
    """First against last reading: ``clock_drop`` (points), ``heat_rise``, ``throttled``, ``verdict``; NaN ratios count for heat only."""
    usable = F.when(~F.isnan("clock_ratio"), F.col(order))
    ends = df.groupBy(*by).agg(F.count(usable).alias("n"), F.min_by("clock_ratio", usable).alias("r0"), F.max_by("clock_ratio", usable).alias("r1"), F.min_by("temperature_c", order).alias("t0"), F.max_by("temperature_c", order).alias("t1"))
    drop, rise = (F.col("r0") - F.col("r1")) * 100, F.col("t1") - F.col("t0")
    enough = F.col("n") >= 2
    verdict = F.when(~enough, "too few readings").when((drop > drop_points) & (rise > heat_rise), "clock drop with heat").when(drop > drop_points, "clock drop").when(rise > heat_rise, "heat only").otherwise("stable")
    return ends.select(*by, F.col("n").alias("n_readings"), F.when(enough, drop).alias("clock_drop"), rise.alias("heat_rise"), (enough & (drop > drop_points)).alias("throttled"), verdict.alias("verdict"))


def memory_budget(shapes: DataFrame, lengths: DataFrame, limit_gb: float = 14.0) -> DataFrame:
    """Model shapes x sequence lengths (both small): parameters, weight and attention bytes, decimal GB and the verdict.

    Linear layers are quantised; embeddings, head, norms and biases stay at two bytes. All products are bigint.
    """
    c = lambda n: F.col(n).cast("bigint")
    q, kv, h, inter, layers = c("n_heads") * c("head_dim"), c("n_kv_heads") * c("head_dim"), c("hidden_size"), c("intermediate_size"), c("n_layers")
    linear = h * q * 2 + h * kv * 2 + h * inter * 3
    other = q + kv * 2 + h * 2
    embedding = c("vocab_size") * h
    sized = shapes.withColumn("quantised", linear * layers).withColumn("kept_fp16", embedding * F.when(F.col("tied_embeddings"), 1).otherwise(2) + other * layers + h)
    sized = sized.withColumn("total", F.col("quantised") + F.col("kept_fp16")).withColumn("fp16_bytes", F.col("total") * 2).withColumn("nf4_bytes", F.col("quantised") * 0.5 + F.col("kept_fp16") * 2)
    met = sized.crossJoin(F.broadcast(lengths)).withColumn("layer_bytes", c("n_heads") * c("seq_len") * c("seq_len") * 2)
    met = met.withColumn("all_layers_bytes", F.col("layer_bytes") * layers).withColumn("peak_gb", (F.col("nf4_bytes") + F.col("layer_bytes")) / 1e9)
    return met.withColumn("fits", F.col("peak_gb") <= limit_gb)
