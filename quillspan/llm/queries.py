"""One query for each training-data operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles, toxicity
from .collocations import collocations
from .conversation_trie import prefix_trie
from .decontamination import overlaps
from .fuzzy_lines import line_report
from .packing import pack
from .pii import find_personal_data
from .quality import quality_verdicts
from .secrets import secret_scan
from .sharding import hilbert_shards
from .simhash_golay import near_duplicate_classes
from .substring_dedup import remove_repeats
from .token_counts import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = hilbert_shards(_table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op3_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), train="crc32(cast(doc_id as string)) % 4 != 2")
    scores = toxicity.toxicity_scores(docs, model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


def op6_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "matched", "compared", "at")


def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicate_classes(_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie(_table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2("repeats.kept", 256).alias("kept_sha256"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_pii_tagger": op2_pii_tagger,
    "op3_quality_forest": op3_quality_forest,
    "op4_toxicity_neighbours": op4_toxicity_neighbours,
    "op5_fuzzy_lines": op5_fuzzy_lines,
    "op6_secret_links": op6_secret_links,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_spaced_seeds": op9_spaced_seeds,
    "op10_simhash_golay": op10_simhash_golay,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLES: dict[str, str] = {"op11_conversation_trie": oracles.CONVERSATION_TRIE, "op12_substring_dedup": oracles.REPEATED_PASSAGES, "op13_phrase_collocations": oracles.COLLOCATIONS}
