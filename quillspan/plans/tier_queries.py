"""Length tiers, cost projection, telemetry and memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import tiers
from quillspan.plans.registry import query
from quillspan.plans.views import SQL_READINGS, SQL_TIER, SQL_TIER_LABEL, SQL_TIMINGS, SQL_WORDS, readings, timings, word_counts

_N = f"(SELECT doc_id, lang, source, text, CAST(len({SQL_WORDS('text')}) AS BIGINT) AS n_words FROM documents)"
_HIST = f"""(SELECT lang, tier, {SQL_TIER_LABEL('tier')} AS tier_label, count(n_words) AS n_samples FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS tier)
  LEFT JOIN (SELECT lang, n_words, {SQL_TIER('n_words')} AS tier FROM {_N}) USING (lang, tier) GROUP BY ALL)"""
_COST = ((0, 0.389), (1, 0.779), (2, 1.401))  # seconds a sample; the last tier is not measured


def _hist(spark, d):
    return tiers.histogram(word_counts(spark, d), "lang", "n_words")


def _cost(spark):
    return spark.createDataFrame(list(_COST), "tier int, seconds double")


@query(f"SELECT * FROM {_HIST}")
def tier_histogram(spark, d):
    return _hist(spark, d)


@query(f"SELECT lang, least(tier, 2) AS tier, {SQL_TIER_LABEL('least(tier, 2)')} AS tier_label, CAST(sum(n_samples) AS BIGINT) AS n_samples FROM {_HIST} GROUP BY ALL")
def capped_histogram(spark, d):
    return tiers.histogram(word_counts(spark, d), "lang", "n_words", cap=2)


@query(f"SELECT coalesce(lang, 'all') AS lang, tier, CAST(sum(n_samples) AS BIGINT) AS n_samples FROM {_HIST} GROUP BY GROUPING SETS ((lang, tier), (tier))")
def corpus_totals(spark, d):
    h = _hist(spark, d)
    return h.select("lang", "tier", "n_samples").unionByName(h.groupBy("tier").agg(F.sum("n_samples").alias("n_samples")).withColumn("lang", F.lit("all")))


@query(f"""WITH t AS (SELECT doc_id, lang, n_words, {SQL_TIER('n_words')} AS tier FROM {_N}), r AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY lang, tier) AS size FROM t WINDOW w AS (PARTITION BY lang, tier ORDER BY n_words, doc_id))
SELECT doc_id, lang, n_words, tier FROM r WHERE size <= 8 OR list_contains(list_transform(generate_series(0, 7), lambda i: CASE WHEN i = 7 THEN size - 1 ELSE CAST(round_even(i * ((size - 1) / 7.0::DOUBLE), 0) AS BIGINT) END), place)""")
def tier_spread_sample(spark, d):
    rows = word_counts(spark, d).select("doc_id", "lang", "n_words").withColumn("tier", T.tier_of(F.col("n_words")))
    return tiers.spread(rows, ["lang", "tier"], ["n_words", "doc_id"], 8)


_SUMMARY = f"""(SELECT corpus, {SQL_TIER('n_tokens')} AS tier, count(*) AS n_samples, avg(n_tokens) AS mean_tokens, quantile_cont(end_to_end_ms, 0.5) AS median_ms, avg(end_to_end_ms) AS mean_ms, quantile_cont(end_to_end_ms, 0.9) AS p90_ms, quantile_cont(forward_ms, 0.5) AS forward_median_ms,
  quantile_cont(forward_ms, 0.5) / quantile_cont(end_to_end_ms, 0.5) AS forward_share, max(peak_vram_mb) AS peak_vram_mb, avg(n_chunks) AS mean_chunks, CAST(sum(truncated::INT) AS BIGINT) AS n_truncated, CAST(sum(nonfinite::INT) AS BIGINT) AS n_nonfinite FROM {SQL_TIMINGS} GROUP BY ALL)"""
_FLOATS = ("mean_tokens", "median_ms", "mean_ms", "p90_ms", "forward_median_ms", "forward_share", "peak_vram_mb", "mean_chunks")


def _summary(spark, d):
    return tiers.tier_summary(timings(spark, d).withColumn("tier", T.tier_of(F.col("n_tokens"))), ["corpus", "tier"])


@query(f"SELECT corpus, tier, n_samples, n_truncated, n_nonfinite, {', '.join(f'round({c}, 6) AS {c}' for c in _FLOATS)} FROM {_SUMMARY}")
def tier_summary(spark, d):
    return _summary(spark, d).withColumns({c: F.round(c, 6) for c in _FLOATS})


_CASE = "CASE tier " + " ".join(f"WHEN {t} THEN {s}::DOUBLE" for t, s in _COST) + " END"


@query(f"""SELECT lang, CAST(sum(n_samples) AS BIGINT) AS n_samples, round(sum(n_samples * s), 6) AS seconds, round(sum(n_samples * s) / 3600, 6) AS hours, round(sum(n_samples * s) * 1000 / greatest(sum(n_samples), 1), 6) AS ms_per_sample, round(sum(n_samples * s) / 36 / 30, 6) AS quota_pct
FROM (SELECT *, {_CASE} AS s FROM {_HIST}) WHERE s IS NOT NULL GROUP BY lang""")
def projected_cost(spark, d):
    return tiers.project_cost(_hist(spark, d), _cost(spark), "lang").withColumns({c: F.round(c, 6) for c in ("seconds", "hours", "ms_per_sample", "quota_pct")})


@query(f"SELECT lang, CAST(tier AS INT) AS tier, n_samples FROM {_HIST} WHERE tier = 3 AND n_samples > 0")
def unmeasured_tiers(spark, d):
    return tiers.unmeasured_tiers(_hist(spark, d), _cost(spark), "lang")


@query(f"SELECT corpus, round(regr_slope(ln(median_ms), ln(mean_tokens)), 6) AS exponent, count(*) AS n_tiers FROM {_SUMMARY} GROUP BY corpus")
def scaling_exponent(spark, d):
    return tiers.scaling_exponent(_summary(spark, d), ["corpus"], untruncated_only=False).withColumn("exponent", F.round("exponent", 6))


@query(f"""SELECT corpus, round(CASE WHEN count(*) FILTER (n_truncated = 0) < 2 THEN -1 ELSE regr_slope(ln(median_ms), ln(mean_tokens)) FILTER (n_truncated = 0) END, 6) AS exponent FROM (
  SELECT corpus, {SQL_TIER('n_tokens')} AS tier, quantile_cont(end_to_end_ms, 0.5) AS median_ms, avg(n_tokens) AS mean_tokens, CAST(sum((truncated AND n_tokens > 2048)::INT) AS BIGINT) AS n_truncated FROM {SQL_TIMINGS} GROUP BY ALL) GROUP BY corpus""")
def untruncated_exponent(spark, d):
    rows = timings(spark, d).withColumn("truncated", F.col("truncated") & (F.col("n_tokens") > 2048)).withColumn("tier", T.tier_of(F.col("n_tokens")))
    e = tiers.scaling_exponent(tiers.tier_summary(rows, ["corpus", "tier"]), ["corpus"])
    return e.select("corpus", F.round(F.when(F.isnan("exponent"), F.lit(-1.0)).otherwise(F.col("exponent")), 6).alias("exponent"))


@query(f"""SELECT lang, count(*) AS n_samples, count(DISTINCT text) AS n_unique_contexts, round(sum(n_chars) / greatest(sum(n_words), 1)::DOUBLE, 6) AS tokens_per_word, round(quantile_cont(n_chars, 0.5), 6) AS ctx_p50, round(quantile_cont(n_chars, 0.9), 6) AS ctx_p90, round(quantile_cont(n_chars, 0.99), 6) AS ctx_p99, max(n_chars)::DOUBLE AS ctx_max,
  round(quantile_cont(n_chars + n_words, 0.5), 6) AS total_p50, round(quantile_cont(n_chars + n_words, 0.99), 6) AS total_p99, max(n_chars + n_words)::DOUBLE AS total_max,
  {', '.join(f'round(avg((n_chars + n_words > {t})::INT) * 100, 6) AS over_{t}, CAST(sum((n_chars + n_words > {t})::INT) AS BIGINT) AS n_over_{t}' for t in (2048, 4096))} FROM (SELECT *, length(text) AS n_chars FROM {_N}) GROUP BY lang""")
def token_stats(spark, d):
    rows = word_counts(spark, d).withColumn("n_chars", F.length("text").cast("bigint"))
    s = tiers.token_stats(rows, ["lang"], "n_chars", "n_words", "n_words", "text")
    return s.withColumns({c: F.round(c, 6) for c in s.columns if c.startswith(("ctx_p", "total_p", "over_", "tokens"))})


@query(f"""WITH e AS (SELECT user_id, count(*) FILTER (NOT isnan(clock_ratio)) AS n, arg_min(clock_ratio, event_id) FILTER (NOT isnan(clock_ratio)) AS r0, arg_max(clock_ratio, event_id) FILTER (NOT isnan(clock_ratio)) AS r1, arg_min(temperature_c, event_id) AS t0, arg_max(temperature_c, event_id) AS t1 FROM {SQL_READINGS} GROUP BY user_id),
v AS (SELECT user_id, n, (r0 - r1) * 100 AS drop, t1 - t0 AS rise FROM e)
SELECT user_id, n AS n_readings, CASE WHEN n >= 2 THEN round(drop, 6) END AS clock_drop, round(rise, 6) AS heat_rise, n >= 2 AND drop > 2 AS throttled, CASE WHEN n < 2 THEN 'too few readings' WHEN drop > 2 AND rise > 5 THEN 'clock drop with heat' WHEN drop > 2 THEN 'clock drop' WHEN rise > 5 THEN 'heat only' ELSE 'stable' END AS verdict FROM v""")
def throttling(spark, d):
    return tiers.throttling(readings(spark, d), ["user_id"], "event_id").withColumns({c: F.round(c, 6) for c in ("clock_drop", "heat_rise")})


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value, 6) END AS temperature_c, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE round(1440.0::DOUBLE / 1590, 6) END AS clock_ratio FROM events""")
def telemetry(spark, d):
    e = F.col("event_id")
    line = F.when(e % 5 == 0, F.concat(F.lit("[N/A], 1440, 1590, "), e.cast("string"))).otherwise(F.concat(F.col("value").cast("string"), F.lit(", 1440 , "), F.when(e % 7 == 0, "0").otherwise("1590"), F.lit(", 98")))
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", tiers.parse_telemetry(line).alias("r"))
    return rows.select("event_id", F.round("r.temperature_c", 6).alias("temperature_c"), F.round(F.when(~F.isnan("r.clock_ratio"), F.col("r.clock_ratio")), 6).alias("clock_ratio"))


@query("""SELECT p_partkey, seq_len, n_heads * seq_len * seq_len * 2 AS layer_bytes, q + k AS total, round(q * 0.5::DOUBLE + k * 2, 2) AS nf4_bytes, (q * 0.5::DOUBLE + k * 2 + n_heads * seq_len * seq_len * 2) / 1e9 <= 14 AS fits FROM (
  SELECT *, (h * qd * 2 + h * kv * 2 + h * i * 3) * l AS q, v * h * CASE WHEN tied THEN 1 ELSE 2 END + (qd + kv * 2 + h * 2) * l + h AS k FROM (
    SELECT p_partkey, CAST(p_size + 4 AS BIGINT) AS n_heads, CAST((p_size + 4) * 128 AS BIGINT) AS h, CAST((p_size + 4) * 128 AS BIGINT) AS qd, CAST(512 AS BIGINT) AS kv, CAST((p_size + 4) * 512 AS BIGINT) AS i, CAST(28 AS BIGINT) AS l, CAST(152064 AS BIGINT) AS v, p_partkey % 2 = 0 AS tied FROM part)) CROSS JOIN (SELECT CAST(unnest([1024, 2048, 4096, 8192]) AS BIGINT) AS seq_len)""")
def memory_budget(spark, d):
    heads = (F.col("p_size") + 4).cast("bigint")
    shapes = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", heads.alias("n_heads"), F.lit(4).alias("n_kv_heads"), F.lit(128).alias("head_dim"), (heads * 128).alias("hidden_size"), (heads * 512).alias("intermediate_size"), F.lit(28).alias("n_layers"), F.lit(152064).alias("vocab_size"), (F.col("p_partkey") % 2 == 0).alias("tied_embeddings"))
    lengths = spark.createDataFrame([(1024,), (2048,), (4096,), (8192,)], "seq_len bigint")
    return tiers.memory_budget(shapes, lengths).select("p_partkey", "seq_len", "layer_bytes", "total", F.round("nf4_bytes", 2).alias("nf4_bytes"), "fits")


@query("""SELECT l_orderkey, (s // 3600) || ' giờ ' || lpad(CAST((s % 3600) // 60 AS VARCHAR), 2, '0') || ' phút' AS duration FROM (SELECT l_orderkey, CAST(round_even(sum(l_quantity) * 97.5::DOUBLE, 0) AS BIGINT) AS s FROM lineitem GROUP BY 1)""")
def durations(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg((F.sum("l_quantity") * 97.5).alias("s"))
    return rows.select("l_orderkey", T.format_duration(F.col("s")).alias("duration"))


@query(f"SELECT conv_id, turn, q + r + CASE WHEN q > 0 THEN 41 ELSE 37 END AS n_tokens FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN CAST(len({SQL_WORDS('text')}) AS BIGINT) ELSE 0 END AS q, CAST(length(text) AS BIGINT) AS r FROM conversations)")
def prompt_lengths(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    q = F.when(F.col("role") == "user", T.word_count(F.col("text"))).otherwise(F.lit(0).cast("bigint"))
    return rows.select("conv_id", "turn", tiers.prompt_tokens(F.length("text").cast("bigint"), q, F.lit(0)).alias("n_tokens"))
