"""Lookback ratios, chunk features and drift over attention weights held as arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import features, lookback, metrics, retrieval
from quillspan.plans.registry import query
from quillspan.plans.views import SQL_ATTENTION, SQL_PAIRS, SQL_RATIOS, SQL_SHARES, attention, pairs, roles, table


def ratio_rows(spark, d):
    return lookback.lookback(attention(spark, d).withColumn("layout", roles())).select("vec_id", "sample_id", "layer", "head", "query_index", "ratios.*")


@query(f"SELECT vec_id, round(cm, 6) AS context_mean, round(pm, 6) AS prompt_mean, round(sm, 6) AS self_mean, round(lookback_context, 6) AS lookback_context, round(lookback_total, 6) AS lookback_total FROM {SQL_RATIOS}")
def lookback_ratios(spark, d):
    r = ratio_rows(spark, d)
    return r.select("vec_id", *[F.round(c, 6).alias(c) for c in ("context_mean", "prompt_mean", "self_mean", "lookback_context", "lookback_total")])


@query(f"SELECT vec_id, CAST(unnest([0, 1, 2, 3]) AS INT) AS chunk, round(unnest(shares), 6) AS share FROM {SQL_SHARES}")
def lookback_per_chunk(spark, d):
    return ratio_rows(spark, d).select("vec_id", F.posexplode("per_chunk").alias("chunk", "share")).withColumn("share", F.round("share", 6))


@query(f"""WITH k AS (SELECT vec_id, i, unnest(generate_series(0, len(w) - 1)) AS k, unnest(w) AS w FROM {SQL_ATTENTION})
SELECT vec_id, round(sum(CASE WHEN k < 40 THEN w ELSE 0 END) / 40, 6) AS context_mean, round(sum(CASE WHEN k >= 48 AND k <> 49 + i THEN w ELSE 0 END) / (any_value(i) + 1), 6) AS self_mean FROM k GROUP BY vec_id""")
def lookback_long_form(spark, d):
    rows = lookback.long_form(attention(spark, d), ["vec_id", "query_index"])
    own = F.col("k") == 49 + F.col("query_index")
    return rows.groupBy("vec_id").agg(F.round(F.sum(F.when(F.col("k") < 40, F.col("w")).otherwise(0.0)) / 40, 6).alias("context_mean"), F.round(F.sum(F.when((F.col("k") >= 48) & ~own, F.col("w")).otherwise(0.0)) / (F.max("query_index") + 1), 6).alias("self_mean"))


@query(f"""WITH q AS (SELECT sample_id, layer, i, avg(list_sum(w)) AS t FROM {SQL_ATTENTION} GROUP BY ALL)
SELECT sample_id, layer, true AS finite, round(arg_max(t, i), 6) AS row_sum_mean FROM q GROUP BY ALL""")
def layer_diagnostics(spark, d):
    return lookback.layer_diagnostics(attention(spark, d)).withColumn("row_sum_mean", F.round("row_sum_mean", 6))


@query(f"SELECT s.sample_id, l.layer FROM (SELECT DISTINCT sample_id FROM {SQL_ATTENTION}) s CROSS JOIN (SELECT CAST(unnest(generate_series(0, 10)) AS INT) AS layer) l WHERE NOT EXISTS (SELECT 1 FROM {SQL_ATTENTION} a WHERE a.sample_id = s.sample_id AND a.layer = l.layer AND a.layer <> 7)")
def missing_layers(spark, d):
    rows = attention(spark, d)
    want = rows.select("sample_id").distinct().withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(10))))
    return lookback.missing_layers(lookback.select_layers(rows, exclude=(7,)), want)


_DRIFT = f"(SELECT layer, vec_id, lookback_context AS a, CASE WHEN vec_id % 101 = 0 AND layer = 3 THEN 'nan'::DOUBLE ELSE round(lookback_context, 2) END AS b FROM {SQL_RATIOS})"


def _runs(spark, d):
    r = ratio_rows(spark, d).select("vec_id", "layer", F.col("lookback_context").alias("v"))
    low = F.when((F.col("vec_id") % 101 == 0) & (F.col("layer") == 3), F.lit(float("nan"))).otherwise(F.round("v", 2))
    return r, r.withColumn("v", low)


@query(f"SELECT layer, CAST(sum(CASE WHEN isnan(b) THEN 1 ELSE 0 END) AS BIGINT) AS n_nan, round(avg(CASE WHEN NOT isnan(b) THEN abs(a - b) END), 6) AS mean_diff, round(max(CASE WHEN NOT isnan(b) THEN abs(a - b) END), 6) AS max_diff FROM {_DRIFT} GROUP BY layer")
def layer_drift(spark, d):
    a, b = _runs(spark, d)
    return lookback.layer_drift(a, b, ["vec_id"], "layer", "v").withColumns({"mean_diff": F.round("mean_diff", 6), "max_diff": F.round("max_diff", 6)})


@query(f"""WITH c AS (SELECT layer, abs(a - b) AS g FROM {_DRIFT} WHERE layer NOT IN (SELECT layer FROM {_DRIFT} WHERE isnan(b)))
SELECT round(avg(g), 6) AS mean_diff, round(quantile_cont(g, 0.99), 6) AS p99_diff, round(max(g), 6) AS max_diff FROM c""")
def global_drift(spark, d):
    a, b = _runs(spark, d)
    return lookback.global_drift(a, b, ["vec_id"], "layer", "v").select(*[F.round(c, 6).alias(c) for c in ("mean_diff", "p99_diff", "max_diff")])


@query(f"""WITH b AS (SELECT sample_id, layer FROM {_DRIFT.replace("layer, vec_id", "layer, sample_id, vec_id")} WHERE isnan(b))
SELECT coalesce((SELECT string_agg(DISTINCT layer::VARCHAR, ',') FROM b), '') AS layers, (SELECT count(DISTINCT sample_id) FROM b) AS n_samples""")
def bad_layers(spark, d):
    a, b = _runs(spark, d)
    sample = F.floor(F.col("vec_id") / 150).cast("bigint")
    rows = b.groupBy(sample.alias("sample_id")).agg(F.sort_array(F.collect_set(F.when(F.isnan("v"), F.col("layer")))).alias("nonfinite_layers"))
    return lookback.bad_layers(rows).select(F.array_join(F.col("layers").cast("array<string>"), ",").alias("layers"), "n_samples")


@query(f"""WITH n AS (SELECT vec_id, list_sort(list_transform(shares, lambda x: x / list_sum(shares))) AS p FROM {SQL_SHARES})
SELECT vec_id, round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)), 6) AS chunk_entropy, round(p[4], 6) AS chunk_max_share, round((-3 * p[1] - p[2] + p[3] + 3 * p[4]) / (4 * list_sum(p)), 6) AS chunk_gini, round(p[4] - p[3], 6) AS top1_top2_gap FROM n""")
def chunk_features(spark, d):
    r = ratio_rows(spark, d).select("vec_id", features.chunk_features(F.col("per_chunk")).alias("f")).select("vec_id", "f.*")
    return r.select("vec_id", *[F.round(c, 6).alias(c) for c in r.columns[1:]])


@query(f"""WITH n AS (SELECT sample_id, layer, vec_id, list_transform(shares, lambda x: x / list_sum(shares)) AS p FROM {SQL_SHARES}), l AS (SELECT *, lag(p) OVER (PARTITION BY sample_id, layer ORDER BY vec_id) AS q FROM n)
SELECT sample_id, layer, round(avg((abs(p[1] - q[1]) + abs(p[2] - q[2]) + abs(p[3] - q[3]) + abs(p[4] - q[4])) / 4), 6) AS chunk_drift FROM l GROUP BY ALL""")
def chunk_drift(spark, d):
    return features.chunk_drift(ratio_rows(spark, d), ["sample_id", "layer"], "vec_id", "per_chunk").withColumn("chunk_drift", F.round("chunk_drift", 6))


_RANKED = f"(SELECT vec_id, head, CAST(1 + len(list_filter(shares, lambda x: x > shares[CAST(vec_id % 4 AS INT) + 1])) AS INT) AS evidence_rank FROM {SQL_SHARES})"


def _ranked(spark, d):
    return ratio_rows(spark, d).select("vec_id", "head", features.evidence_rank(F.col("per_chunk"), (F.col("vec_id") % 4).cast("int")).alias("evidence_rank"))


@query(f"SELECT vec_id, evidence_rank FROM {_RANKED}")
def evidence_chunk_rank(spark, d):
    return _ranked(spark, d).select("vec_id", "evidence_rank")


@query(f"SELECT head, count(*) AS n, round(avg((evidence_rank <= 1)::INT), 6) AS hit_at_1, round(avg((evidence_rank <= 3)::INT), 6) AS hit_at_3, round(avg(1.0::DOUBLE / evidence_rank), 6) AS mrr, 0.25::DOUBLE AS random_floor FROM {_RANKED} GROUP BY head")
def hit_at_k_mrr(spark, d):
    m = retrieval.ranking_metrics(_ranked(spark, d).withColumn("c", F.lit(4)), "evidence_rank", "c", ["head"])
    return m.select("head", "n", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_3", "mrr", "random_floor")])


@query(f"SELECT sample_id, layer, round(avg(lookback_total), 6) AS lookback_mean, round(stddev_pop(lookback_total), 6) AS lookback_std FROM {SQL_RATIOS} GROUP BY ALL")
def lookback_stats(spark, d):
    s = features.lookback_stats(ratio_rows(spark, d), ["sample_id", "layer"], "lookback_total")
    return s.select("sample_id", "layer", F.round("lookback_mean", 6).alias("lookback_mean"), F.round("lookback_std", 6).alias("lookback_std"))


@query(f"""WITH m AS (SELECT sample_id, layer, head, CAST(avg(lookback_total) AS DOUBLE) AS v FROM {SQL_RATIOS} GROUP BY ALL)
SELECT sample_id, count(*) AS n_features, round(list_sum(list_transform(list(v ORDER BY layer, head), lambda x: round(x, 4))), 3) AS total FROM m GROUP BY sample_id""")
def feature_matrix(spark, d):
    means = features.mean_over_heads(ratio_rows(spark, d), ["sample_id", "layer", "head"], "lookback_total")
    m = lookback.assemble(means, "lookback_total")
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + F.round(x.cast("double"), 4))
    return m.select("sample_id", F.size("features").cast("bigint").alias("n_features"), F.round(total, 3).alias("total"))


@query(f"""WITH s AS (SELECT layer, head, round(avg(lookback_total), 6) AS score FROM {SQL_RATIOS} GROUP BY ALL), b AS (SELECT * FROM s ORDER BY score DESC, layer, head LIMIT 5)
SELECT b.layer, b.head, b.score, count(*) AS n_rows FROM {SQL_RATIOS} r JOIN b USING (layer, head) GROUP BY ALL""")
def top_heads(spark, d):
    r = ratio_rows(spark, d)
    best = features.top_heads(r.groupBy("layer", "head").agg(F.round(F.avg("lookback_total"), 6).alias("score")), 5)
    n = features.keep_heads(r, best).groupBy("layer", "head").agg(F.count(F.lit(1)).alias("n_rows"))
    return best.join(n, ["layer", "head"]).select("layer", "head", "score", "n_rows")


@query(f"""SELECT (SELECT vec_id FROM {SQL_RATIOS} ORDER BY abs(lookback_context - 0.5), vec_id LIMIT 1) AS nearest, (SELECT vec_id FROM {SQL_RATIOS} ORDER BY lookback_context DESC, vec_id LIMIT 1) AS largest,
  round(min(lookback_context), 6) AS least, round(avg(lookback_context), 6) AS mean, round(max(lookback_context), 6) AS most, min(lookback_context) >= 0 AND max(lookback_context) <= 1 AS in_range FROM {SQL_RATIOS}""")
def ratio_range(spark, d):
    m = metrics.spread_of(ratio_rows(spark, d), "lookback_context", 0.5, "vec_id")
    ok = (F.col("least") >= 0) & (F.col("most") <= 1)
    return m.select("nearest", "largest", *[F.round(c, 6).alias(c) for c in ("least", "mean", "most")], ok.alias("in_range"))


@query("""WITH t AS (SELECT conv_id, turn, text, string_split(text, ' ') AS p FROM conversations), s AS (SELECT conv_id, turn, p, len(text) AS n, list_transform(generate_series(1, len(p)), lambda j: coalesce(list_sum(list_transform(p[1:j - 1], lambda x: length(x) + 1)), 0)) AS a FROM t),
o AS (SELECT conv_id, turn, n, unnest(generate_series(0, len(p) - 1)) AS i, unnest(p) AS w, unnest(a) AS a FROM s)
SELECT conv_id, turn, count(*) AS n_inside, CAST(min(i) AS INT) AS first_token FROM o WHERE length(w) > 0 AND a < 40 AND a + length(w) > 10 GROUP BY ALL""")
def token_spans(spark, d):
    pieces = F.split("text", " ", -1)
    rows = table(spark, d, "conversations").select("conv_id", "turn", pieces.alias("p"), F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("s")), lambda acc, w: F.struct((acc["at"] + F.length(w) + 1).alias("at"), F.concat(acc["s"], F.array(acc["at"])).alias("s")))["s"].alias("s"))
    offsets = rows.withColumn("o", F.zip_with("s", "p", lambda s, w: F.struct(s.alias("token_start"), (s + F.length(w)).alias("token_end"))))
    inside = offsets.withColumn("t", lookback.token_span(F.col("o"), F.lit(10), F.lit(40))).where(F.size("t") > 0)
    return inside.select("conv_id", "turn", F.size("t").cast("bigint").alias("n_inside"), F.get("t", F.lit(0)).alias("first_token"))


@query(f"""SELECT conv_id, turn, (lq - 1) // 4 + 1 AS n_context, (lq + 1) // 4 AS n_prompt, (lq + 1) // 4 AS first_response, (lq + lr) // 4 - (lq + 1) // 4 AS n_queries, (h - 1) // 4 + 1 AS chunk_1, (lq - 1) // 4 - h // 4 + 1 AS chunk_2,
  CAST(list_sum(range(h // 4, (lq - 1) // 4 + 1)) AS BIGINT) AS places_2 FROM (SELECT conv_id, turn, CAST(length(question) AS BIGINT) AS lq, CAST(length(response) AS BIGINT) AS lr, CAST(length(question) // 2 AS BIGINT) AS h FROM {SQL_PAIRS}) WHERE lq > 1 AND lr > 11""")
def token_layout(spark, d):
    """Roles of tokens of four characters in question, line feed and response; the question's halves are chunks."""
    rows = pairs(spark, d).where((F.length("question") > 1) & (F.length("response") > 11))
    lq, n = F.length("question"), F.length("question") + F.length("response") + 1
    starts = F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int"))
    offsets = T.let(n, lambda n: F.transform(starts, lambda i: F.struct((i * 4).alias("token_start"), F.least(i * 4 + 4, n).alias("token_end"))))  # a length is a pass over the text
    half = F.floor(lq / 2).cast("int")
    chunk = lambda a, b: F.struct(a.alias("char_start"), b.alias("char_end"))
    roles = lookback.layout(offsets, (F.lit(0), lq), (lq + 1, n), F.array(chunk(F.lit(0), half), chunk(half, lq)))
    size = lambda c: F.size(c).cast("bigint")
    r = rows.select("conv_id", "turn", roles.alias("r"))
    second = F.get("r.chunk_tokens", F.lit(1))
    return r.select("conv_id", "turn", size("r.context").alias("n_context"), size("r.prompt").alias("n_prompt"), F.get("r.response", F.lit(0)).cast("bigint").alias("first_response"), size("r.queries").alias("n_queries"), size(F.get("r.chunk_tokens", F.lit(0))).alias("chunk_1"), size(second).alias("chunk_2"), F.aggregate(second, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("places_2"))
