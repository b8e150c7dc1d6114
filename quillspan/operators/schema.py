"""The common schema of grounded samples: finishing, validation and expected-count guards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.operators.containment import PART_CHARS, pattern_hits

# Columns in their order and the closed domains.
STRINGS = ("sample_id", "dataset", "split", "context", "context_id", "question", "response", "label", "label_original", "evidence")
COLUMNS = (*STRINGS, "evidence_start", "evidence_end", "response_is_generated", "meta")
NOT_EMPTY = ("sample_id", "dataset", "split", "context", "context_id", "response", "label", "label_original", "meta")
DATASETS = ("vihallu", "isedsc01", "viwikifc", "vifactcheck")
SPLITS = ("train", "dev", "test")
LABELS = ("no", "intrinsic", "extrinsic")

SCHEMA = T.StructType([T.StructField(c, T.LongType() if c.startswith("evidence_") else T.BooleanType() if c == "response_is_generated" else T.StringType(), False) for c in COLUMNS])


def finalise(df: DataFrame) -> DataFrame:
    """Casts, null strings to empty, null flags to true, the fixed order; columns of other names go."""
    cols = []
    for field in SCHEMA:
        c = F.col(field.name).cast(field.dataType)
        if isinstance(field.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        elif isinstance(field.dataType, T.BooleanType):
            c = F.coalesce(c, F.lit(True))
        cols.append(c.alias(field.name))
    return df.select(*cols)


def violations(df: DataFrame, datasets: Sequence[str] = DATASETS, splits: Sequence[str] = SPLITS, labels: Sequence[str] = LABELS) -> DataFrame:
    """One row of counts, in the order the rules are checked; one pass, and one aggregate by id for repeats."""
    count = lambda cond: F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))
    start, end = F.col("evidence_start"), F.col("evidence_end")
    found, half = start != -1, (start != -1) != (end != -1)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in NOT_EMPTY:
        aggs += [count(F.col(c).isNull()).alias(f"null_{c}"), count(F.col(c) == "").alias(f"empty_{c}")]
    aggs += [count(F.col(c).isNull()).alias(f"null_{c}") for c in ("question", "evidence")]
    aggs += [count(~F.col(c).isin(*allowed)).alias(f"unknown_{c}") for c, allowed in (("dataset", datasets), ("split", splits), ("label", labels))]
    aggs += [count(half).alias("half_spans"), count(found & (end > F.length("context"))).alias("spans_past_end"), count(found & (start >= end)).alias("empty_spans")]
    repeats = df.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_ids"))
    return df.agg(*aggs).crossJoin(repeats)


def validate(df: DataFrame, **domains: Sequence[str]) -> None:
    """Raise on the first broken rule: columns, emptiness, nulls, domains, repeated ids, span types, spans."""
    if missing := [c for c in COLUMNS if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if extra := [c for c in df.columns if c not in COLUMNS]:
        raise ValueError(f"unknown columns: {', '.join(extra)}")
    kinds = dict(df.dtypes)
    wrong = [c for c in ("evidence_start", "evidence_end") if kinds[c] not in ("bigint", "int", "smallint", "tinyint")]
    found = violations(df.withColumns({c: F.col(c).cast("bigint") for c in wrong}) if wrong else df, **domains).first().asDict()
    if not found.pop("rows"):
        raise ValueError("no rows")
    spans = ("half_spans", "spans_past_end", "empty_spans")
    order = [k for k in found if k not in spans and k != "repeated_ids"] + ["repeated_ids"]
    for k in order:
        if found[k]:
            raise ValueError(f"{k}: {found[k]} rows")
    if wrong:
        raise ValueError(f"not an integer column: {', '.join(wrong)}")
    for k in spans:
        if found[k]:
            raise ValueError(f"{k}: {found[k]} rows")


def count_differences(df: DataFrame, expected: Mapping[tuple[str, str], int]) -> DataFrame:
    """``split``, ``label``, ``expected``, ``found`` where counts differ, on either side."""
    spark = df.sparkSession
    want = spark.createDataFrame([(s, lab, n) for (s, lab), n in expected.items()], "split string, label string, expected bigint")
    have = df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("found"))
    both = want.join(have, ["split", "label"], "full")
    return both.select("split", "label", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found")).where("expected <> found")


def check_counts(df: DataFrame, expected: Mapping[tuple[str, str], int]) -> None:
    if rows := count_differences(df, expected).orderBy("split", "label").collect():
        raise ValueError("unexpected counts: " + "; ".join(f"{r['split']}/{r['label']} {r['found']} instead of {r['expected']}" for r in rows))


def check_misses(df: DataFrame, most: int = 1) -> None:
    """Raise if more than ``most`` rows have no located evidence."""
    n = df.where("evidence_start < 0").count()
    if n > most:
        raise ValueError(f"{n} rows without located evidence, at most {most} expected")


def check_evidence_rate(df: DataFrame, low: float = 0.55, high: float = 0.65) -> None:
    """Raise if the share of located evidence is outside [low, high]."""
    rate = df.agg(F.avg((F.col("evidence_start") >= 0).cast("int"))).first()[0]
    if rate is None or not low <= rate <= high:
        raise ValueError(f"located evidence rate {rate} outside [{low}, {high}]")


def passages_in(docs: DataFrame, passages: DataFrame, doc_text: str = "text", passage_text: str = "passage", seed_words: int = 4, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows of both sides where the document holds the passage exactly (case and spaces too).

    A contained passage's inner words are whole words of the document in a row, so the first ``seed_words`` of them are a
    key both sides share: an equi-join on their hash. Passages with fewer inner words have no key; they stand in automata of
    at most ``part_chars`` characters, through which the texts stream. Only hashes of texts and keys are joined; the texts meet
    once for each pair of hashes, and the containment is verified. Rows that repeat stay repeated; null and empty passages are
    in none, and null texts hold none.
    """
    ws = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
    split = lambda c: F.array_remove(F.split(c, ws), "")
    key = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(seed_words)])
    lead = F.col(passage_text).rlike(f"^{ws}").cast("int")
    keyed = passages.where(F.length(passage_text) > 0).withColumn("_ph", F.xxhash64(passage_text)).withColumn("_w", split(F.col(passage_text))).withColumn("_lead", lead).withColumn("_inner", F.size("_w") - 2 + F.col("_lead"))
    seeds = keyed.where(F.col("_inner") >= seed_words).select(key(F.col("_w"), 1 - F.col("_lead")).alias("_key"), "_ph").distinct()
    rows = docs.select(F.xxhash64(doc_text).alias("_dh"), split(F.col(doc_text)).alias("_w")).where(F.size("_w") >= seed_words)
    spots = rows.select("_dh", "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - seed_words)).alias("_at")).select("_dh", key(F.col("_w"), F.col("_at")).alias("_key"))
    near = spots.join(seeds, "_key").select("_dh", "_ph")
    short = pattern_hits(docs, keyed.where(F.col("_inner") < seed_words), doc_text, passage_text, part_chars)
    near = near.unionByName(short.select(F.col("text_hash").alias("_dh"), F.col("pattern_hash").alias("_ph"))).distinct()
    met = near.join(passages.withColumn("_ph", F.xxhash64(passage_text)), "_ph").join(docs.withColumn("_dh", F.xxhash64(doc_text)), "_dh")
    return met.where(F.col(doc_text).contains(F.col(passage_text))).select(*docs.columns, *passages.columns)
