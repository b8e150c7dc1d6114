"""Samples, text scalars, profiles, chunks and prompts over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import chunking, metrics, retrieval, schema, split, tokens
from quillspan.plans.registry import query
from quillspan.plans.views import SQL_CONTEXT_ID, SQL_LABEL, SQL_PAIRS, SQL_SPLIT, SQL_STRIP, SQL_TIER, SQL_TIER_LABEL, SQL_WORDS, WS, label_of, pairs, table, word_counts

_LETTERS = T.letter_ranges(T.diacritic_letters(), r"\x{%04X}")
_HAS = lambda c: f"regexp_matches(nfc_normalize({c}), '[{_LETTERS}]')"

# Sentence pieces in SQL: split where a gap follows a sentence end, keep the gaps' lengths, add them up.
_SENTENCES = f"""(SELECT doc_id, text, list_filter(list_zip(pieces, starts), lambda p: regexp_matches(p[1], '[^\\s\\x0B\\x1C-\\x1F\\x{{85}}\\pZ]')) AS kept FROM (
  SELECT doc_id, text, pieces, list_transform(generate_series(1, len(pieces)), lambda j: CAST(coalesce(list_sum(list_transform(pieces[1:j - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(gaps[1:j - 1], lambda x: length(x))), 0) AS BIGINT)) AS starts FROM (
    SELECT doc_id, text, string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)) AS pieces, regexp_extract_all(text, '[.!?]({WS}+)', 1) AS gaps FROM documents)))"""
_PIECES = f"""(SELECT doc_id, text, CAST(unnest(generate_series(0, len(kept) - 1)) AS INT) AS idx, unnest(kept)[1] AS piece, unnest(kept)[2] AS char_start FROM {_SENTENCES} WHERE len(kept) > 0
  UNION ALL SELECT doc_id, text, 0, text, 0 FROM {_SENTENCES} WHERE len(kept) = 0)"""


def grounded(spark, d):
    """Documents and the benchmark passages they hold, in the common schema."""
    docs, bench, labels = table(spark, d, "documents"), table(spark, d, "benchmark"), table(spark, d, "labels")
    found = schema.passages_in(docs.select("doc_id", "text", "lang", "source"), bench.select("item_id", F.col("text").alias("passage")))
    rows = found.join(labels, "doc_id", "left").withColumn("context_id", T.context_id(F.col("text")))
    rows = split.group_split(rows)
    start, end = T.find_evidence(F.col("text"), F.col("passage"))
    meta = T.json_meta({"item_id": F.col("item_id").cast("string"), "lang": F.col("lang"), "source": F.col("source")})
    index = F.concat_ws("_", F.col("doc_id").cast("string"), F.col("item_id").cast("string"))
    original = F.coalesce(F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string")), F.lit(""))
    return schema.finalise(rows.select(T.sample_id(F.lit("documents"), F.col("split"), index).alias("sample_id"), F.lit("documents").alias("dataset"), "split", F.col("text").alias("context"), "context_id", F.lit("").alias("question"), F.col("passage").alias("response"), F.when(F.col("quality").isNull(), "extrinsic").otherwise(label_of()).alias("label"), F.when(original == "", "none").otherwise(original).alias("label_original"), F.col("passage").alias("evidence"), start.alias("evidence_start"), end.alias("evidence_end"), F.lit(False).alias("response_is_generated"), meta.alias("meta")))


_GROUNDED = f"""SELECT 'documents_' || split || '_' || doc_id || '_' || item_id AS sample_id, 'documents' AS dataset, split, text AS context, context_id, '' AS question, passage AS response,
  CASE WHEN quality IS NULL THEN 'extrinsic' ELSE {SQL_LABEL} END AS label, coalesce(quality || '/' || toxic, 'none') AS label_original, passage AS evidence,
  CAST(strpos(text, passage) - 1 AS BIGINT) AS evidence_start, CAST(strpos(text, passage) - 1 + length(passage) AS BIGINT) AS evidence_end, false AS response_is_generated,
  '{{"item_id": "' || item_id || '", "lang": "' || lang || '", "source": "' || source || '"}}' AS meta
FROM (SELECT *, {SQL_SPLIT("context_id")} AS split FROM (
  SELECT d.doc_id, d.text, d.lang, d.source, b.item_id, b.text AS passage, l.quality, l.toxic, {SQL_CONTEXT_ID("d.text")} AS context_id
  FROM documents d JOIN benchmark b ON contains(d.text, b.text) LEFT JOIN labels l ON l.doc_id = d.doc_id))"""


@query(_GROUNDED)
def evidence_spans(spark, d):
    return grounded(spark, d)


@query(f"""SELECT count(*) AS "rows", CAST(sum(CASE WHEN label NOT IN ('no', 'intrinsic') THEN 1 ELSE 0 END) AS BIGINT) AS unknown_label, CAST(count(*) - count(DISTINCT sample_id) AS BIGINT) AS repeated_ids,
  CAST(sum(CASE WHEN evidence_end > length(context) THEN 1 ELSE 0 END) AS BIGINT) AS spans_past_end, CAST(sum(CASE WHEN question = '' THEN 0 ELSE 1 END) AS BIGINT) AS null_question FROM ({_GROUNDED})""")
def schema_violations(spark, d):
    found = schema.violations(grounded(spark, d), datasets=("documents",), labels=("no", "intrinsic"))
    return found.select("rows", "unknown_label", "repeated_ids", "spans_past_end", "null_question")


@query(f"SELECT doc_id, {SQL_CONTEXT_ID('text')} AS context_id FROM documents")
def context_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.context_id(F.col("text")).alias("context_id"))


@query(f"SELECT doc_id, {_HAS('text')} AS has_diacritics FROM documents")
def diacritics(spark, d):
    return table(spark, d, "documents").select("doc_id", T.has_diacritics(F.col("text")).alias("has_diacritics"))


@query(f"""SELECT conv_id, turn, CASE WHEN NOT {_HAS('question')} AND {_HAS('response')} THEN 'noisy' ELSE 'unknown' END AS prompt_type,
  NOT (NOT {_HAS('question')} AND {_HAS('response')}) AS prompt_has_diacritics FROM {SQL_PAIRS}""")
def prompt_types(spark, d):
    kind = T.prompt_type(F.col("question"), F.col("response"))
    return pairs(spark, d).select("conv_id", "turn", kind.alias("prompt_type"), (kind != "noisy").alias("prompt_has_diacritics"))


@query(f"SELECT doc_id, n_words, {SQL_TIER('n_words')} AS tier, {SQL_TIER_LABEL(SQL_TIER('n_words'))} AS tier_label FROM (SELECT doc_id, CAST(len({SQL_WORDS('text')}) AS BIGINT) AS n_words FROM documents)")
def word_counts_and_tiers(spark, d):
    tier = T.tier_of(F.col("n_words"))
    return word_counts(spark, d).select("doc_id", "n_words", tier.alias("tier"), T.tier_label(tier).alias("tier_label"))


@query(f"""SELECT lang, label, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY lang), 6) AS pct FROM (
  SELECT lang, {SQL_LABEL} AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL)""")
def label_distribution(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", label_of().alias("label"))
    return metrics.distribution(rows, ["lang"], "label").withColumn("pct", F.round("pct", 6))


@query(f"""WITH s AS (SELECT * FROM ({_GROUNDED})), kv AS (
  SELECT 'item_id' AS key, json_extract_string(meta, '$.item_id') AS value FROM s UNION ALL SELECT 'lang', json_extract_string(meta, '$.lang') FROM s UNION ALL SELECT 'source', json_extract_string(meta, '$.source') FROM s)
SELECT key, value, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM s), 6) AS pct FROM kv
WHERE key IN (SELECT key FROM kv GROUP BY key HAVING count(DISTINCT value) <= 8) GROUP BY key, value""")
def meta_profile(spark, d):
    return metrics.meta_profile(grounded(spark, d), "meta").withColumn("pct", F.round("pct", 6))


@query("""SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS k, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1""")
def json_field_counts(spark, d):
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")).cast("bigint") % 7
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


@query(f"SELECT lang, count(*) AS n, count(DISTINCT {SQL_CONTEXT_ID('text')}) AS n_contexts, count(*) - count(DISTINCT {SQL_CONTEXT_ID('text')}) AS n_repeats FROM documents GROUP BY lang")
def unique_contexts(spark, d):
    rows = table(spark, d, "documents").select("lang", T.context_id(F.col("text")).alias("c"))
    sizes = rows.groupBy("lang", "c").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_contexts"), F.sum(F.col("n") - 1).alias("n_repeats"))


@query(f"SELECT {SQL_CONTEXT_ID('text')} AS context_id, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_contexts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.context_id(F.col("text")).alias("context_id"))
    return rows.groupBy("context_id").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""SELECT lang, count(*) AS n, CAST(sum(CASE WHEN found THEN 1 ELSE 0 END) AS BIGINT) AS n_located, round(avg(CASE WHEN found THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) - CAST(sum(CASE WHEN found THEN 1 ELSE 0 END) AS BIGINT) AS n_missed
FROM (SELECT d.lang, EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text)) AS found FROM documents d) GROUP BY lang""")
def evidence_rate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    held = schema.passages_in(docs, table(spark, d, "benchmark").select(F.col("text").alias("passage"))).select("doc_id").distinct().withColumn("hit", F.lit(True))
    rows = docs.select("doc_id", "lang").join(held, "doc_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_located"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("rate"), F.count_if(~F.col("hit")).alias("n_missed"))


@query(f"SELECT doc_id, idx, piece AS text, CAST(char_start AS BIGINT) AS char_start, CAST(char_start + length(piece) AS BIGINT) AS char_end FROM {_PIECES}")
def sentence_chunks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(chunking.sentences(F.col("text"))).alias("c"))
    return rows.select("doc_id", F.col("c.index").alias("idx"), "c.text", "c.char_start", "c.char_end")


@query(f"""WITH p AS (SELECT *, sum(CASE WHEN idx = 0 OR len({SQL_WORDS('piece')}) >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS g FROM {_PIECES})
SELECT doc_id, CAST(g AS INT) AS idx, CAST(min(char_start) AS BIGINT) AS char_start, CAST(max(char_start + length(piece)) AS BIGINT) AS char_end, substr(any_value(text), min(char_start) + 1, max(char_start + length(piece)) - min(char_start)) AS text FROM p GROUP BY doc_id, g""")
def merged_sentences(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(chunking.merged_sentences(F.col("text"), 5)).alias("c"))
    return rows.select("doc_id", F.col("c.index").alias("idx"), "c.text", "c.char_start", "c.char_end")


@query(f"""WITH t AS (SELECT doc_id, {SQL_WORDS('text')} AS w FROM documents),
s AS (SELECT doc_id, w, CAST(unnest(generate_series(0, len(w) - 1, 32)) AS BIGINT) AS token_start FROM t WHERE len(w) > 0)
SELECT doc_id, token_start, CAST(least(token_start + 64, len(w)) AS BIGINT) AS token_end, array_to_string(w[token_start + 1:least(token_start + 64, len(w))], ' ') AS words FROM s WHERE token_start = 0 OR token_start + 32 < len(w)""")
def token_windows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(chunking.token_windows(F.col("text"), 64)).alias("c"))
    return rows.select("doc_id", "c.token_start", "c.token_end", F.array_join(T.words(F.col("c.text")), " ").alias("words"))


@query(f"""WITH k AS (SELECT doc_id, any_value(text) AS text, count(*) AS m, list(piece ORDER BY idx) AS p, list(CAST(char_start AS BIGINT) ORDER BY idx) AS s FROM {_PIECES} GROUP BY doc_id),
n AS (SELECT *, CASE WHEN m <= 1 THEN 0 ELSE least(3, m - 1) END AS n FROM k), f AS (SELECT *, (m - n) // 2 AS f FROM n)
SELECT doc_id, CAST(m - n AS INT) AS n_left, CASE WHEN n = 0 THEN text ELSE substr(text, 1, s[f + 1]) || substr(text, s[f + n] + length(p[f + n]) + 1) END AS text FROM f""")
def drop_middle(spark, d):
    chunks = table(spark, d, "documents").select("doc_id", "text", chunking.sentences(F.col("text")).alias("c"))
    cut = chunks.select("doc_id", chunking.drop_middle(F.col("text"), F.col("c"), F.lit(3)).alias("r"))
    return cut.select("doc_id", F.size("r.chunks").alias("n_left"), "r.text")


@query(f"""WITH e AS (SELECT d.doc_id, b.item_id, CAST(strpos(d.text, b.text) - 1 AS BIGINT) AS a, CAST(strpos(d.text, b.text) - 1 + length(b.text) AS BIGINT) AS z FROM documents d JOIN benchmark b ON contains(d.text, b.text))
SELECT e.doc_id, e.item_id, min(p.idx) AS chunk_index FROM e LEFT JOIN {_PIECES} p ON p.doc_id = e.doc_id AND p.char_start < z AND p.char_start + length(p.piece) > a GROUP BY ALL""")
def evidence_chunks(spark, d):
    found = schema.passages_in(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage")))
    start, end = T.find_evidence(F.col("text"), F.col("passage"))
    rows = found.select("doc_id", "item_id", start.alias("a"), end.alias("z"), chunking.sentences(F.col("text")).alias("c"))
    return rows.select("doc_id", "item_id", chunking.locate_chunk(F.col("c"), F.col("a"), F.col("z")).alias("chunk_index"))


@query(f"""SELECT conv_id, turn, '{T.CONTEXT_HEADER}' || response || CASE WHEN regexp_matches(question, '[^\\s\\x0B\\x1C-\\x1F\\x{{85}}\\pZ]') THEN '{T.QUESTION_HEADER}' || {SQL_STRIP('question')} ELSE '' END AS user_turn FROM {SQL_PAIRS}""")
def user_turns(spark, d):
    return pairs(spark, d).select("conv_id", "turn", T.user_turn(F.col("response"), F.col("question")).alias("user_turn"))


_RENDERED = f"""('<|system|>\n{T.SYSTEM_PROMPT}\n<|user|>\n{T.CONTEXT_HEADER}' || response || '{T.QUESTION_HEADER}' || {SQL_STRIP('question')} || '\n<|assistant|>\n' || response)"""


@query(f"""SELECT conv_id, turn, CAST(length(t) AS BIGINT) AS n_chars, CAST(strpos(t, response) - 1 AS BIGINT) AS context_start, CAST(strpos(t, response) - 1 + length(response) AS BIGINT) AS context_end,
  CAST(length(t) - length(response) AS BIGINT) AS response_start, CAST(length(t) AS BIGINT) AS response_end FROM (SELECT *, {_RENDERED} AS t FROM {SQL_PAIRS} WHERE length(response) > 0 AND length({SQL_STRIP('question')}) > 0)""")
def rendered_prompts(spark, d):
    rows = pairs(spark, d).where((F.length("response") > 0) & ~T.is_blank(F.col("question")))
    p = T.render_prompt(F.col("response"), F.col("question"), F.col("response"))
    return rows.select("conv_id", "turn", p.alias("p")).select("conv_id", "turn", F.length("p.text").cast("bigint").alias("n_chars"), "p.context_start", "p.context_end", "p.response_start", "p.response_end")


@query(f"""SELECT doc_id, CASE WHEN n <= 256 THEN text ELSE substr(text, 1, k) || right(text, k) END AS clipped FROM (
  SELECT doc_id, text, n, greatest(1, CAST(floor(length(text) * (256.0::DOUBLE / n) * 0.45::DOUBLE) AS BIGINT)) AS k FROM (SELECT doc_id, text, len({SQL_WORDS('text')}) AS n FROM documents))""")
def clipped_texts(spark, d):
    return word_counts(spark, d).select("doc_id", T.clip_text(F.col("text"), F.col("n_words"), 256).alias("clipped"))


_N = lambda c: f"CAST(len({SQL_WORDS(c)}) AS BIGINT)"
_FITTED = f"""WITH RECURSIVE begun AS (
  SELECT doc_id, text, CASE WHEN len(kept) > 0 THEN list_transform(kept, lambda p: CAST(p[2] AS BIGINT)) ELSE [0::BIGINT] END AS a, CASE WHEN len(kept) > 0 THEN list_transform(kept, lambda p: CAST(p[2] + length(p[1]) AS BIGINT)) ELSE [CAST(length(text) AS BIGINT)] END AS z FROM {_SENTENCES}),
fit AS (
  SELECT doc_id, 0 AS turn, text, a, z, false AS cut FROM begun
  UNION ALL
  SELECT doc_id, turn + 1, substr(text, 1, a[mid + 1]) || substr(text, z[mid + k] + 1), list_concat(a[1:mid], list_transform(a[mid + k + 1:], lambda x: x - (z[mid + k] - a[mid + 1]))), list_concat(z[1:mid], list_transform(z[mid + k + 1:], lambda x: x - (z[mid + k] - a[mid + 1]))), true FROM (
    SELECT *, (len(a) - k) // 2 AS mid FROM (SELECT *, least(greatest(1, CAST(ceil(len(a) * (1 - 256::DOUBLE / (37 + n) + 0.05::DOUBLE)) AS BIGINT)), len(a) - 1) AS k FROM (SELECT *, {_N('text')} AS n FROM fit WHERE turn < 6) WHERE n + 37 > 256 AND len(a) > 1))),
ended AS (SELECT *, {_N('text')} AS n FROM (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY turn DESC) = 1)),
sized AS (SELECT *, greatest(1, CAST(trunc(length(text) * (256::DOUBLE / n) * 0.45::DOUBLE) AS BIGINT)) AS keep FROM ended)
SELECT doc_id, CASE WHEN n > 256 THEN substr(text, 1, keep) || right(text, keep) ELSE text END AS text, cut OR n + 37 > 256 AS truncated, CASE WHEN n + 37 > 256 THEN 1 ELSE CAST(len(a) AS INT) END AS n_chunks FROM sized"""


@query(_FITTED)
def fitted_prompts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("context"), F.lit("").alias("question"), F.lit("").alias("response"))
    return chunking.fit_to_budget(rows, 256, chunks=None).select("doc_id", "fitted.text", "fitted.truncated", F.size("fitted.char_start").alias("n_chunks"))


@query(f"""SELECT conv_id, turn, CASE WHEN len(r) = 0 THEN 0.0 ELSE round(len(list_filter(r, lambda x: list_contains(q, x))) / len(r)::DOUBLE, 6) END AS lexical_overlap, CAST(len(r) AS BIGINT) AS response_words
FROM (SELECT conv_id, turn, {SQL_WORDS('lower(response)')} AS r, {SQL_WORDS('lower(question)')} AS q FROM {SQL_PAIRS})""")
def lexical_overlap(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.round(T.lexical_overlap(F.col("response"), F.col("question")), 6).alias("lexical_overlap"), T.word_count(F.col("response")).alias("response_words"))


@query(f"SELECT doc_id, {SQL_SPLIT('context_id')} AS split FROM (SELECT doc_id, {SQL_CONTEXT_ID('text')} AS context_id FROM documents)")
def group_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.context_id(F.col("text")).alias("context_id"))
    return split.group_split(rows).select("doc_id", "split")


@query(f"""WITH s AS (SELECT {SQL_CONTEXT_ID('text')} AS c, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'dev' ELSE 'test' END AS split FROM documents),
g AS (SELECT split, c, count(*) AS n, c IN (SELECT c FROM s WHERE split = 'train') AS l FROM s WHERE split <> 'train' GROUP BY split, c)
SELECT split, count(*) AS n_groups, CAST(sum(l::INT) AS BIGINT) AS leaked_groups, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN l THEN n ELSE 0 END) AS BIGINT) AS leaked_rows FROM g GROUP BY split""")
def leakage(spark, d):
    k = F.col("doc_id") % 10
    rows = table(spark, d, "documents").select(T.context_id(F.col("text")).alias("context_id"), F.when(k < 8, "train").when(k == 8, "dev").otherwise("test").alias("split"))
    return split.leakage(rows)


@query(f"""WITH p AS (SELECT item_id, {SQL_WORDS('lower(text)')} AS w FROM benchmark), l AS (SELECT item_id, len(w) AS n FROM p), c AS (SELECT count(*) AS m, avg(n) AS a FROM l),
tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(w) AS term FROM p) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT conv_id * 1000 + turn AS query_id, unnest({SQL_WORDS('lower(question)')}) AS term FROM {SQL_PAIRS}),
s AS (SELECT query_id, item_id, round(sum(ln(1 + (m - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / a))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l USING (item_id), c GROUP BY ALL)
SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 3""")
def bm25_topk(spark, d):
    asked = pairs(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "question")
    return retrieval.bm25(asked, table(spark, d, "benchmark"), "query_id", "question", "item_id", "text").select("query_id", "item_id", "score", "rank")


@query("SELECT doc_id, CASE WHEN s IN ('', 'nan', 'none') THEN '' ELSE s END AS answer FROM (SELECT doc_id, replace(replace(lower(" + SQL_STRIP("CASE doc_id % 6 WHEN 0 THEN ' NGOAI LAI ' WHEN 1 THEN 'noi-tai' WHEN 2 THEN '  ' WHEN 3 THEN 'NaN' WHEN 4 THEN 'khác' ELSE 'khong_chac' END") + "), ' ', '_'), '-', '_') AS s FROM labels)")
def normalised_answers(spark, d):
    k = F.col("doc_id") % 6
    raw = F.when(k == 0, " NGOAI LAI ").when(k == 1, "noi-tai").when(k == 2, "  ").when(k == 3, "NaN").when(k == 4, "khác").otherwise("khong_chac")
    return table(spark, d, "labels").select("doc_id", T.normalise_answer(raw).alias("answer"))


# The text's control character as Python's json writes it.
_ESCAPE = "CASE c WHEN 8 THEN '\\b' WHEN 9 THEN '\\t' WHEN 10 THEN '\\n' WHEN 12 THEN '\\f' WHEN 13 THEN '\\r' ELSE printf('\\u%04x', c) END"


@query(f"""SELECT doc_id, '{{"id": ' || doc_id || ', "note": "' || coalesce(lang, '') || {_ESCAPE} || '\\\\u001F' || {_ESCAPE} || '", "source": ' || CASE WHEN source IS NULL THEN 'null' ELSE '"' || source || '"' END || '}}' AS meta
FROM (SELECT *, CAST(doc_id % 31 + 1 AS INT) AS c FROM documents)""")
def meta_escapes(spark, d):
    mark = F.char(F.col("doc_id") % 31 + 1)
    note = F.concat(F.coalesce("lang", F.lit("")), mark, F.lit("\\u001F"), mark)
    return table(spark, d, "documents").select("doc_id", T.json_meta({"note": note, "id": F.col("doc_id"), "source": F.col("source")}).alias("meta"))


@query(f"""SELECT doc_id, len({SQL_WORDS('given')}) > 0 AS evidence_given FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN '' WHEN 2 THEN chr(160) || chr(8195) || chr(31) WHEN 3 THEN NULL ELSE chr(11) || lang END AS given FROM documents)
WHERE given IS NOT NULL UNION ALL SELECT doc_id, false FROM documents WHERE doc_id % 5 = 3 OR (doc_id % 5 = 0 AND text IS NULL) OR (doc_id % 5 = 4 AND lang IS NULL)""")
def evidence_given(spark, d):
    k = F.col("doc_id") % 5
    given = F.when(k == 0, F.col("text")).when(k == 1, "").when(k == 2, "\xa0\u2003\x1f").when(k == 3, None).otherwise(F.concat(F.lit("\x0b"), F.col("lang")))
    return table(spark, d, "documents").select("doc_id", T.evidence_given(given).alias("evidence_given"))


@query(None)
def model_prompt_lengths(spark, d):
    """Prompts of question and answer counted by a model's tokenizer, and their tier."""
    import public_tokenizers

    n = tokens.prompt_length(F.col("response"), F.col("question"), F.col("response"), public_tokenizers.path("byte_bpe_50k.json"))
    rows = pairs(spark, d).select("conv_id", "turn", n.alias("n_tokens"))
    return rows.withColumn("tier", T.tier_of(F.col("n_tokens")))
