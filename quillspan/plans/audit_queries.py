"""Label audit, metrics, run log and detector."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions.text import ANSWER_CODES, KAPPA_BANDS, KAPPA_NONE, KAPPA_TOP
from quillspan.operators import audit, detector, metrics, runlog
from quillspan.plans.attention_queries import ratio_rows
from quillspan.plans.registry import query
from quillspan.plans.views import SQL_ANNOTATED, SQL_CONTEXT_ID, SQL_WORDS, annotated, table

_QUOTAS = {"Not_Enough_Information": 20, "Refutes": 5, "Supports": 5}
_BAND = "CASE WHEN isnan(kappa) THEN '" + KAPPA_NONE + "' " + " ".join(f"WHEN kappa < {b} THEN '{w}'" for b, w in KAPPA_BANDS) + f" ELSE '{KAPPA_TOP}' END"
_DRAWN = f"""(SELECT *, CASE WHEN label_original = 'Not_Enough_Information' THEN 'nei' ELSE 'doi_chung' END AS role, row_number() OVER (ORDER BY md5('42:shuffle:' || sample_id), sample_id) AS number FROM (
  SELECT *, row_number() OVER (PARTITION BY label_original ORDER BY md5('42:draw:' || sample_id), sample_id) AS nth FROM {SQL_ANNOTATED}) WHERE nth <= CASE label_original {' '.join(f"WHEN '{k}' THEN {n}" for k, n in _QUOTAS.items())} END)"""


def _drawn(spark, d):
    return audit.draw(annotated(spark, d), _QUOTAS, strict=False)


@query(f"SELECT number, sample_id, label_original, role FROM {_DRAWN}")
def stratified_draw(spark, d):
    return _drawn(spark, d).select("number", "sample_id", "label_original", "role")


@query(f"SELECT r.number AS stt, r.sample_id, x.text AS ngu_canh, x.lang AS phat_bieu, '' AS nhan_dinh, '' AS ghi_chu FROM {_DRAWN} r JOIN documents x USING (doc_id)")
def blind_sheet(spark, d):
    return audit.blind_sheet(_drawn(spark, d).withColumnsRenamed({"text": "context", "lang": "response"}))


def _kappa(by: str) -> str:
    key, join = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH a AS (SELECT x.*, d.lang FROM {SQL_ANNOTATED} x JOIN documents d USING (doc_id)), t AS (SELECT {key}count(*) AS n, avg((answer_a = answer_b)::INT) AS raw FROM a {group}),
e AS (SELECT {key}v, sum(x) AS x, sum(y) AS y FROM (SELECT {key}answer_a AS v, 1 AS x, 0 AS y FROM a UNION ALL SELECT {key}answer_b, 0, 1 FROM a) GROUP BY ALL), c AS (SELECT {key}sum(CAST(x AS DOUBLE) * y) AS xy, count(*) AS k FROM e {group}),
m AS (SELECT {key}n, raw, CASE WHEN k < 2 OR xy / (n * n) = 1 THEN 'nan'::DOUBLE ELSE (raw - xy / (n::DOUBLE * n)) / (1 - xy / (n::DOUBLE * n)) END AS kappa FROM t JOIN c {join})
SELECT {key}n, round(raw, 6) AS raw, round(kappa, 6) AS kappa, {_BAND} AS band FROM m"""


@query(_kappa(""))
def agreement_kappa(spark, d):
    return audit.agreement(annotated(spark, d), "answer_a", "answer_b").withColumns({"raw": F.round("raw", 6), "kappa": F.round("kappa", 6)})


@query(_kappa("lang"))
def agreement_by_language(spark, d):
    return audit.agreement(annotated(spark, d), "answer_a", "answer_b", ["lang"]).withColumns({"raw": F.round("raw", 6), "kappa": F.round("kappa", 6)})


@query(f"SELECT CAST(place AS INT) AS place, code, {', '.join(f'count(*) FILTER (answer_b = {chr(39)}{c}{chr(39)}) AS {c}' for c in ANSWER_CODES)} FROM (SELECT unnest([0, 1, 2, 3]) AS place, unnest({list(ANSWER_CODES)}) AS code) LEFT JOIN {SQL_ANNOTATED} ON answer_a = code GROUP BY ALL")
def answer_crosstab(spark, d):
    return audit.crosstab(annotated(spark, d), "answer_a", "answer_b")


@query(f"""SELECT annotator, count(*) AS n, round(avg(ok::INT), 6) AS accuracy, avg(ok::INT) < 0.7 AS warn FROM (
  SELECT unnest(['a', 'b']) AS annotator, unnest([answer_a = e, answer_b = e]) AS ok FROM (SELECT *, CASE label_original WHEN 'Supports' THEN 'khong' ELSE 'noi_tai' END AS e FROM {SQL_ANNOTATED} WHERE label_original <> 'Not_Enough_Information')) GROUP BY annotator""")
def control_accuracy(spark, d):
    return audit.control_accuracy(annotated(spark, d), ["a", "b"]).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""SELECT annotator, count(*) FILTER (v = '') AS n_blank, count(*) FILTER (v <> '' AND v NOT IN {ANSWER_CODES}) AS n_invalid, coalesce(string_agg(DISTINCT CASE WHEN v <> '' AND v NOT IN {ANSWER_CODES} THEN v END, ','), '') AS invalid
FROM (SELECT unnest(['a', 'b']) AS annotator, unnest([answer_a, answer_b]) AS v FROM {SQL_ANNOTATED}) GROUP BY annotator""")
def answer_census(spark, d):
    return audit.answer_census(annotated(spark, d), ["a", "b"])


@query(f"SELECT count(*) FILTER (answer_a = answer_b AND answer_a = 'ngoai_lai') AS n_both, count(*) AS n FROM {SQL_ANNOTATED}")
def both_extrinsic(spark, d):
    return audit.both_say(annotated(spark, d), "answer_a", "answer_b")


@query(f"""SELECT t.sample_id, a.answer_a, CASE WHEN b.doc_id % 3 = 0 THEN NULL ELSE b.answer_b END AS answer_b FROM {SQL_ANNOTATED} t LEFT JOIN {SQL_ANNOTATED} a USING (sample_id) LEFT JOIN {SQL_ANNOTATED} b USING (sample_id)""")
def annotator_join(spark, d):
    rows = annotated(spark, d)
    sheet = lambda c: rows.select("sample_id", F.concat(F.lit(" "), F.upper(F.translate(c, "_", "-"))).alias("nhan_dinh"), "doc_id")
    joined = audit.join_annotators(rows.select("sample_id"), {"a": sheet("answer_a"), "b": sheet("answer_b").where("doc_id % 3 <> 0")})
    return joined.select("sample_id", "answer_a", "answer_b")


_SAID = f"(SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'no' WHEN toxic = 1 THEN 'extrinsic' ELSE 'intrinsic' END AS truth, CASE WHEN l.doc_id % 7 = 0 THEN 'no' WHEN toxic = 1 THEN 'extrinsic' WHEN quality = 1 THEN 'no' ELSE 'intrinsic' END AS predicted, lang FROM labels l JOIN documents USING (doc_id))"


def _f1_sql(by: str) -> str:
    f1 = lambda c: f"CASE WHEN count(*) FILTER (truth = '{c}') + count(*) FILTER (predicted = '{c}') = 0 THEN 0 ELSE 2.0::DOUBLE * count(*) FILTER (truth = '{c}' AND predicted = '{c}') / (count(*) FILTER (truth = '{c}') + count(*) FILTER (predicted = '{c}')) END"
    key = f"{by}, " if by else ""
    labels = ("no", "intrinsic", "extrinsic")
    cols = ", ".join(f"round({f1(c)}, 6) AS f1_{c}" for c in labels)
    return f"SELECT {key}count(*) AS n, round(avg((truth = predicted)::INT), 6) AS accuracy, {cols}, round(({' + '.join(f1(c) for c in labels)}) / 3, 6) AS macro_f1 FROM {_SAID}" + (f" GROUP BY {by}" if by else "")


def _said(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    t, q = F.col("toxic") == 1, F.col("quality") == 1
    return rows.select("doc_id", "lang", F.when(q & ~t, "no").when(t, "extrinsic").otherwise("intrinsic").alias("truth"), F.when(F.col("doc_id") % 7 == 0, "no").when(t, "extrinsic").when(q, "no").otherwise("intrinsic").alias("predicted"))


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.startswith(("f1_", "macro", "accuracy"))})


@query(_f1_sql(""))
def classification_metrics(spark, d):
    return _rounded(metrics.classification_metrics(_said(spark, d), "truth", "predicted"))


@query(_f1_sql("lang"))
def classification_by_slice(spark, d):
    return _rounded(metrics.classification_metrics(_said(spark, d), "truth", "predicted", by=["lang"]))


@query("""WITH b AS (SELECT least(floor(c * 10), 9) AS b, count(*) AS n, avg(c) AS conf, avg(ok::INT) AS acc FROM (SELECT (event_id % 101) / 100.0::DOUBLE AS c, user_id % 3 = 0 AS ok FROM events) GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece FROM b""")
def calibration_error(spark, d):
    rows = table(spark, d, "events").select(((F.col("event_id") % 101) / 100.0).alias("c"), (F.col("user_id") % 3 == 0).alias("ok"))
    return metrics.calibration_error(rows, "c", "ok").withColumn("ece", F.round("ece", 6))


_RUNS = """(SELECT event_id, 'run' || event_id % 7 AS run_name, event_type, value, user_id FROM events)"""


def _runs(spark, d):
    """Nested run records made of events."""
    e = table(spark, d, "events")
    config = F.struct(F.struct(F.col("event_type").alias("name"), F.lit(42).alias("split_seed")).alias("dataset"))
    return e.select(F.concat(F.lit("run"), (F.col("event_id") % 7).cast("string")).alias("run_name"), F.col("event_id").alias("id"), config.alias("config"), F.struct(F.col("value").alias("macro_f1")).alias("metrics"), F.struct(F.col("user_id").alias("ms_per_sample")).alias("extra"))


@query(f"""SELECT run_name, event_id AS id, event_type AS "config.dataset.name", 42 AS "config.dataset.split_seed", value AS "metrics.macro_f1", user_id AS "extra.ms_per_sample" FROM {_RUNS}""")
def flattened_runs(spark, d):
    return runlog.flatten(_runs(spark, d))


@query(f"""SELECT event_id AS id, run_name, value AS "metrics.macro_f1", CAST(NULL AS VARCHAR) AS "metrics.ece" FROM {_RUNS} WHERE event_type = 'click' AND run_name = 'run3'""")
def filtered_runs(spark, d):
    return runlog.export_table(runlog.flatten(_runs(spark, d)), {"config.dataset.name": "click", "run_name": "run3"}, ["id", "run_name", "metrics.macro_f1", "metrics.ece"])


@query(None)
def detector_predictions(spark, d):
    rows = ratio_rows(spark, d).select("vec_id", (F.col("head") % 3).cast("string").alias("label"), F.concat(F.array("lookback_context", "lookback_total", "self_mean"), "per_chunk").alias("features"))
    model = detector.fit(rows, max_iter=20)
    return detector.predict(model, rows).select("vec_id", "label", "predicted")


_VARIETY = f"""(SELECT *, least(greatest(CAST(floor(score * 10) AS INT), 0), 9) AS bin FROM (
  SELECT d.source, CAST(('0x' || substr(md5('42:' || {SQL_CONTEXT_ID('d.text')}), 1, 8)) AS BIGINT) % 5 AS fold, l.quality = 1 AS good, len(list_distinct({SQL_WORDS('d.text')})) / greatest(len({SQL_WORDS('d.text')}), 1)::DOUBLE AS score
  FROM documents d JOIN labels l USING (doc_id)))"""


@query(f"""WITH r AS (SELECT * FROM {_VARIETY}), p AS (SELECT fold, bin, count(*) AS n, sum(good::INT) AS y FROM r WHERE good IS NOT NULL GROUP BY ALL), w AS (SELECT bin, sum(n) AS n, sum(y) AS y FROM p GROUP BY bin),
c AS (SELECT r.*, CASE WHEN w.n > p.n THEN (w.y - p.y) / (w.n - p.n)::DOUBLE END AS calibrated FROM r JOIN p USING (fold, bin) JOIN w ON w.bin = r.bin)
SELECT CAST(fold AS INT) AS fold, count(*) AS n, round(avg((score - good::INT) ** 2), 6) AS brier_score, round(avg((calibrated - good::INT) ** 2), 6) AS brier_calibrated FROM c GROUP BY fold""")
def cross_fitted_calibration(spark, d):
    """Variety of words as a score of quality, calibrated for each fold on the contexts of the others."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    words = T.words(F.col("text"))
    score = F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))
    scored = rows.select(T.context_id(F.col("text")).alias("context_id"), (F.col("quality") == 1).alias("good"), score.alias("score"))
    got = detector.brier(detector.cross_fitted_rates(scored, "context_id", "score", "good"), ["score", "calibrated"], "good", ["fold"])
    return got.withColumns({c: F.round(c, 6) for c in ("brier_score", "brier_calibrated")})
