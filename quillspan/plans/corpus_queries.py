"""The corpora's readers over raw files that are derived from documents and labels and written to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import schema
from quillspan.plans.registry import query
from quillspan.plans.text_queries import _GROUNDED, _HAS, grounded
from quillspan.plans.views import SQL_CONTEXT_ID, WS, table
from quillspan.sources import readers, sinks
from quillspan.sources.paths import scratch

_OUT = ("sample_id", "dataset", "split", "context_id", "question", "response", "label", "label_original", "evidence", "evidence_start", "evidence_end", "response_is_generated", "meta")
_KIND = "CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 0 ELSE 1 END"
_SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'dev' ELSE 'test' END"
_PLACE = "CAST(row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS INT)"
_GIVEN = f"regexp_matches(given, '[^{WS[1:-1]}]')"
# a row for each labelled document: the given evidence is a piece of it, another text or blank
_ROWS = f"""(SELECT *, {_PLACE} AS place FROM (SELECT d.doc_id, d.text, d.lang, d.source, substr(d.text, 3, 30) AS claim, {_KIND} AS kind, {_SPLIT} AS split,
  CASE d.doc_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'elsewhere ' || d.doc_id ELSE substr(d.text, 11, 24) END AS given FROM documents d JOIN labels USING (doc_id)))"""
_FOUND = f"(SELECT *, CASE WHEN {_GIVEN} THEN strpos(text, given) - 1 ELSE -1 END AS place_of FROM {_ROWS})"


def _common(dataset: str, split: str, question: str, names: tuple[str, str, str], meta: str, generated: bool, rows: str, given: bool = True) -> str:
    label = "CASE kind WHEN 0 THEN 'no' WHEN 1 THEN 'intrinsic' ELSE 'extrinsic' END"
    original = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    start, end, text = ("place_of", "CASE WHEN place_of >= 0 THEN place_of + length(given) ELSE -1 END", "CASE WHEN place_of >= 0 THEN given ELSE '' END") if given else ("-1", "-1", "''")
    return f"""SELECT '{dataset}_' || {split} || '_' || place AS sample_id, '{dataset}' AS dataset, {split} AS split, {SQL_CONTEXT_ID('text')} AS context_id, {question} AS question, claim AS response, {label} AS label,
      CASE kind {original} END AS label_original, {text} AS evidence, CAST({start} AS BIGINT) AS evidence_start, CAST({end} AS BIGINT) AS evidence_end, {str(generated).lower()} AS response_is_generated, {meta} AS meta FROM {rows}"""


def _raw(spark, d):
    """Rows in the order of doc_id, so that places in the files are those of SQL's row numbers."""
    k = F.col("doc_id") % 5
    given = F.when(k == 0, " ").when(k == 1, F.concat(F.lit("elsewhere "), F.col("doc_id").cast("string"))).otherwise(F.substring("text", 11, 24))
    ten = F.col("doc_id") % 10
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("given", given)
    rows = rows.withColumn("kind", F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)).withColumn("split", F.when(ten < 8, "train").when(ten == 8, "dev").otherwise("test"))
    return rows.withColumn("claim", F.substring("text", 3, 30)).withColumn("id", F.col("doc_id").cast("string"))


def _named(kind, names):
    return F.element_at(F.array(*map(F.lit, names)), kind + 1)


_ALL = f"(SELECT * REPLACE (CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INT) AS place) FROM {_FOUND})"
_NOISY = f"NOT {_HAS('question')} AND {_HAS('text')}"
_QUESTION = "CASE WHEN doc_id % 3 = 0 THEN 'hoi gi the' ELSE 'hỏi gì thế' END"


@query(_common("vihallu", "'train'", "question", ("no", "intrinsic", "extrinsic"), f"""'{{"prompt_has_diacritics": ' || CASE WHEN {_NOISY} THEN 'false' ELSE 'true' END || ', "prompt_type": "' || CASE WHEN {_NOISY} THEN 'noisy' ELSE 'unknown' END || '", "source_id": "' || doc_id || '"}}'""", True, f"(SELECT *, {_QUESTION} AS question FROM {_ALL})", given=False))
def corpus_vihallu(spark, d):
    raw = scratch(spark, "vihallu")
    rows = _raw(spark, d).orderBy("doc_id").select("id", F.col("text").alias("context"), F.when(F.col("doc_id") % 3 == 0, "hoi gi the").otherwise("hỏi gì thế").alias("prompt"), F.col("claim").alias("response"), _named(F.col("kind"), ("no", "intrinsic", "extrinsic")).alias("label"))
    sinks.write_csv(rows, f"{raw}/{readers.FILES['vihallu']['train']}")
    return readers.read_vihallu(spark, raw).select(*_OUT)


_META = lambda **parts: "'{" + ", ".join(f'"{k}": \' || {v} || \'' for k, v in sorted(parts.items())) + "}'"
_TEXT = lambda c: f"""'"' || {c} || '"'"""
_FLAG = f"CASE WHEN {_GIVEN} THEN 'true' ELSE 'false' END"


@query(_common("isedsc01", "'train'", "''", ("SUPPORTED", "REFUTED", "NEI"), _META(domain=_TEXT("lang"), evidence_given=_FLAG, source_id=_TEXT("doc_id")), False, _ALL))
def corpus_isedsc01(spark, d):
    raw = scratch(spark, "isedsc01")
    rows = _raw(spark, d).orderBy("doc_id").select("id", F.col("text").alias("context"), "claim", _named(F.col("kind"), ("SUPPORTED", "REFUTED", "NEI")).alias("verdict"), F.col("given").alias("evidence"), F.col("lang").alias("domain"))
    sinks.write_json_records(rows, "id", f"{raw}/{readers.FILES['isedsc01']['train']}")
    return readers.read_isedsc01(spark, raw).select(*_OUT)


@query(_common("viwikifc", "split", "''", ("Supports", "Refutes", "Not_Enough_Information"), _META(evidence_given=_FLAG, link=_TEXT("'l' || doc_id"), sentence_id=_TEXT("doc_id % 7"), source_id=_TEXT("doc_id"), title=_TEXT("source")), False, _FOUND))
def corpus_viwikifc(spark, d):
    raw = scratch(spark, "viwikifc")
    rows = _raw(spark, d).select(
        "doc_id", "split", F.col("id").alias("pairID"), F.col("given").alias("evidence"), _named(F.col("kind"), ("Supports", "Refutes", "Not_Enough_Information")).alias("gold_label"), F.concat(F.lit("l"), "id").alias("link"),
        F.col("text").alias("context"), (F.col("doc_id") % 7).cast("string").alias("sentenceID"), "claim", F.col("source").alias("title"),
    )
    for split, file in readers.FILES["viwikifc"].items():
        sinks.write_csv(rows.where(F.col("split") == split).orderBy("doc_id").drop("doc_id", "split"), f"{raw}/{file}")
    return readers.read_viwikifc(spark, raw).select(*_OUT)


# rows of Parquet files have no place of their own here: the number in the id is left out
@query("SELECT * EXCLUDE (sample_id) FROM (" + _common("vifactcheck", "split", "''", ("0", "1", "2"), _META(annotation_id=_TEXT("'a' || doc_id"), evidence_given=_FLAG, topic=_TEXT("lang"), url=_TEXT("source")), False, _FOUND) + ")")
def corpus_vifactcheck(spark, d):
    raw = scratch(spark, "vifactcheck")
    rows = _raw(spark, d).select("split", F.concat(F.lit("a"), "id").alias("annotation_id"), F.col("claim").alias("Statement"), F.col("text").alias("Context"), F.col("kind").alias("labels"), F.col("given").alias("Evidence"), F.col("lang").alias("Topic"), F.col("source").alias("Url"))
    for split, file in readers.FILES["vifactcheck"].items():
        rows.where(F.col("split") == split).drop("split").write.parquet(f"{raw}/{file}")
    return readers.read_vifactcheck(spark, raw).select(*_OUT[1:])


@query(f"SELECT sample_id, context_id, response, label, evidence_start, evidence_end, meta, dataset, split FROM ({_GROUNDED}) WHERE split = 'train'")
def stored_corpus(spark, d):
    """Grounded rows stored by dataset and split, and one split read back."""
    path = scratch(spark, "interim")
    sinks.write_corpus(grounded(spark, d), path)
    return readers.load_dataset(spark, path, "documents", "train").select("sample_id", "context_id", "response", "label", "evidence_start", "evidence_end", "meta", "dataset", "split")


@query(f"SELECT DISTINCT substr(sha256(evidence), 1, 16) AS evidence_id, evidence AS text, '' AS title, '' AS link FROM ({_GROUNDED}) WHERE evidence <> ''")
def evidence_corpus(spark, d):
    return sinks.retrieval_corpus(grounded(spark, d))


_EXPECTED = {("train", "no"): 4, ("train", "extrinsic"): 0, ("dev", "intrinsic"): 1, ("nowhere", "no"): 2}


@query(f"""WITH want(split, label, n) AS (VALUES {', '.join(f"('{s}', '{lab}', {n})" for (s, lab), n in _EXPECTED.items())}), have AS (SELECT split, label, count(*) AS n FROM ({_GROUNDED}) GROUP BY ALL)
SELECT coalesce(w.split, h.split) AS split, coalesce(w.label, h.label) AS label, coalesce(w.n, 0)::BIGINT AS expected, coalesce(h.n, 0)::BIGINT AS found FROM want w FULL JOIN have h ON w.split = h.split AND w.label = h.label WHERE coalesce(w.n, 0) <> coalesce(h.n, 0)""")
def unexpected_counts(spark, d):
    return schema.count_differences(grounded(spark, d), _EXPECTED)
