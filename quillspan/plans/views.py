"""The domain's tables over the generic input tables, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.text import word_count

# White space of Python's str.isspace for RE2, and what the SQL side does with it.
WS = r"[\s\x0B\x1C-\x1F\x{85}\pZ]"
SQL_WORDS = lambda c: f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda x: x <> '')"
SQL_STRIP = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"
SQL_CONTEXT_ID = lambda c: f"substr(sha256({SQL_STRIP(f'nfc_normalize({c})')}), 1, 16)"
SQL_TIER = lambda c: f"CAST(CASE WHEN {c} <= 512 THEN 0 WHEN {c} <= 1024 THEN 1 WHEN {c} <= 2048 THEN 2 ELSE 3 END AS INT)"
SQL_TIER_LABEL = lambda c: f"CASE {c} WHEN 0 THEN '0–512' WHEN 1 THEN '513–1024' WHEN 2 THEN '1025–2048' ELSE '2049–4096' END"
SQL_BUCKET = lambda c: f"CAST(('0x' || substr(md5('42:' || {c}), 1, 8)) AS BIGINT) % 100"
SQL_SPLIT = lambda c: f"CASE WHEN {SQL_BUCKET(c)} < 80 THEN 'train' WHEN {SQL_BUCKET(c)} < 90 THEN 'dev' ELSE 'test' END"
SQL_LABEL = "CASE WHEN toxic = 1 THEN 'extrinsic' WHEN quality = 1 THEN 'no' ELSE 'intrinsic' END"
SQL_PAIRS = """(SELECT conv_id, turn, text AS question, answer AS response FROM (
  SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS answer_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND answer_role = 'assistant')"""
SQL_ATTENTION = """(SELECT *, list_transform(z, lambda x: x / s) AS w FROM (SELECT *, list_sum(z) AS s FROM (
  SELECT vec_id, CAST(vec_id // 150 AS BIGINT) AS sample_id, CAST((vec_id // 15) % 10 AS INT) AS layer, CAST(label AS INT) AS head, CAST(vec_id % 15 AS INT) AS i,
         list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))[1:50 + CAST(vec_id % 15 AS INT)] AS z FROM embeddings)))"""
SQL_RATIOS = f"""(SELECT *, cm / greatest(cm + sm, 1e-9) AS lookback_context, pm / greatest(pm + sm, 1e-9) AS lookback_total FROM (
  SELECT *, list_sum(w[1:40]) / 40 AS cm, list_sum(w[1:48]) / 48 AS pm, (list_sum(w[49:50 + i]) - w[50 + i]) / (i + 1) AS sm FROM {SQL_ATTENTION}))"""
SQL_SHARES = f"""(SELECT *, [list_sum(w[1:10]) / 10 / greatest(cm + sm, 1e-9), list_sum(w[11:20]) / 10 / greatest(cm + sm, 1e-9), list_sum(w[21:30]) / 10 / greatest(cm + sm, 1e-9), list_sum(w[31:40]) / 10 / greatest(cm + sm, 1e-9)] AS shares FROM {SQL_RATIOS})"""
SQL_TIMINGS = "(SELECT event_id, event_type AS corpus, CAST(event_id % 4096 + 1 AS BIGINT) AS n_tokens, value AS end_to_end_ms, value * 0.9 AS forward_ms, 5000 + value AS peak_vram_mb, CAST(event_id % 40 AS BIGINT) AS n_chunks, event_id % 50 = 0 AS truncated, event_id % 97 = 0 AS nonfinite FROM events)"
SQL_READINGS = "(SELECT user_id, event_id, 40 + value / 10 AS temperature_c, CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE 1.0 - value / 2000 END AS clock_ratio FROM events)"
SQL_ANNOTATED = f"""(SELECT d.doc_id, '{{0}}' || d.doc_id AS sample_id, CASE WHEN l.toxic = 1 THEN 'Not_Enough_Information' WHEN l.quality = 1 THEN 'Supports' ELSE 'Refutes' END AS label_original,
  CASE WHEN l.doc_id % 17 = 0 THEN '' WHEN l.toxic = 1 THEN 'ngoai_lai' WHEN l.quality = 1 THEN 'khong' ELSE 'noi_tai' END AS answer_a,
  CASE WHEN l.doc_id % 19 = 0 THEN 'khac' WHEN l.doc_id % 5 = 0 THEN 'khong_chac' WHEN l.toxic = 1 THEN 'ngoai_lai' WHEN l.quality = 1 THEN 'khong' ELSE 'noi_tai' END AS answer_b
  FROM documents d JOIN labels l USING (doc_id))""".replace("{0}", "doc_")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns that an assistant turn follows: ``conv_id``, ``turn``, ``question``, ``response``."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"response": F.lead("text").over(w), "_next": F.lead("role").over(w)})
    return rows.where("role = 'user' and _next = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "response")


def label_of() -> F.Column:
    return F.when(F.col("toxic") == 1, "extrinsic").when(F.col("quality") == 1, "no").otherwise("intrinsic")


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal, normalised weights of one query a row: keys 0-39 context in four chunks, 40-47 scaffold, 48-63 response."""
    i = (F.col("vec_id") % 15).cast("int")
    kept = F.transform("embedding", lambda x, k: F.when(k <= 49 + i, F.abs(x.cast("double"))).otherwise(F.lit(0.0)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 150).cast("bigint").alias("sample_id"), (F.floor(F.col("vec_id") / 15) % 10).cast("int").alias("layer"), F.col("label").cast("int").alias("head"), i.alias("query_index"), kept.alias("z"))
    scaled = F.aggregate("z", F.lit(0.0), lambda a, x: a + x, lambda total: F.transform("z", lambda x: x / total))
    return rows.withColumn("weights", scaled).drop("z")


def roles() -> F.Column:
    seq = lambda a, b: F.sequence(F.lit(a), F.lit(b))
    return F.struct(seq(0, 39).alias("context"), seq(0, 47).alias("prompt"), seq(48, 63).alias("response"), F.array(seq(0, 9), seq(10, 19), seq(20, 29), seq(30, 39)).alias("chunk_tokens"))


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("corpus"), (e % 4096 + 1).alias("n_tokens"), F.col("value").alias("end_to_end_ms"), (F.col("value") * 0.9).alias("forward_ms"), (F.col("value") + 5000).alias("peak_vram_mb"), (e % 40).alias("n_chunks"), (e % 50 == 0).alias("truncated"), (e % 97 == 0).alias("nonfinite"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(1.0 - F.col("value") / 2000)
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 10 + 40).alias("temperature_c"), ratio.alias("clock_ratio"))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with two rule-made annotators."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    truth = F.when(F.col("toxic") == 1, "Not_Enough_Information").when(F.col("quality") == 1, "Supports").otherwise("Refutes")
    said = F.when(F.col("toxic") == 1, "ngoai_lai").when(F.col("quality") == 1, "khong").otherwise("noi_tai")
    d = F.col("doc_id")
    return rows.select("doc_id", F.concat(F.lit("doc_"), d.cast("string")).alias("sample_id"), "text", "lang", truth.alias("label_original"), F.when(d % 17 == 0, "").otherwise(said).alias("answer_a"), F.when(d % 19 == 0, "khac").when(d % 5 == 0, "khong_chac").otherwise(said).alias("answer_b"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", word_count(F.col("text")).alias("n_words"))
