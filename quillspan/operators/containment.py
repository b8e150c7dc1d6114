"""Exact containment of short patterns by multi-pattern automata.

Patterns without a word that both sides could be joined on are laid into automata of bounded size; texts stream through them
in Arrow batches. A pattern's first characters stand in the automaton, the rest is compared in place, so that an automaton's
size is bounded by the number of patterns times a constant. Patterns beyond one automaton go into further parts, each with
a pass of its own over the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_CHARS = 2_000_000  # of patterns in one automaton, at most about twice that by the hash's spread
HEAD = 48  # characters of a pattern that stand in the automaton
_HELD: dict[int, ahocorasick.Automaton] = {}  # a worker keeps the automaton of the part it runs


def build(patterns: list[tuple[int, str]], head: int = HEAD) -> ahocorasick.Automaton:
    """Values are lists of (pattern's hash, whole pattern) that begin with the key."""
    same: dict[str, list[tuple[int, str]]] = {}
    for code, pattern in patterns:
        same.setdefault(pattern[:head], []).append((code, pattern))
    automaton = ahocorasick.Automaton()
    for key, value in same.items():
        automaton.add_word(key, value)
    automaton.make_automaton()
    return automaton


def held_by(automaton: ahocorasick.Automaton, text: str, head: int = HEAD) -> set[int]:
    """Hashes of the patterns that the text holds."""
    found: set[int] = set()
    for end, value in automaton.iter(text):
        for code, pattern in value:
            if code not in found and (len(pattern) <= head or text.startswith(pattern, end + 1 - head)):
                found.add(code)
    return found


def _search(shared, head: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for batch in batches:
            if automaton is None:
                part = shared.value
                if part["id"] not in _HELD:
                    _HELD.clear()
                    _HELD[part["id"]] = build(part["patterns"], head)
                automaton = _HELD[part["id"]]
            texts, codes = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = held_by(automaton, text.as_py(), head)
                codes.extend(found)
                texts.extend([key] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), pa.array(codes, pa.int64())], ["text_hash", "pattern_hash"])

    return run


def pattern_hits(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, part_chars: int = PART_CHARS, head: int = HEAD) -> DataFrame:
    """``text_hash``, ``pattern_hash`` (both ``xxhash64``) of each text and non-empty pattern that it holds; null in neither.

    Repeated texts give repeated pairs. The driver sees one part of the patterns at a time, never more.
    """
    spark = texts.sparkSession
    own = patterns.select(F.col(pattern).alias("p")).where(F.length("p") > 0).distinct()
    size = own.agg(F.sum(F.least(F.length("p"), F.lit(head)))).first()[0] or 0
    n_parts = math.ceil(size / part_chars)
    rows = texts.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    out = spark.createDataFrame([], "text_hash bigint, pattern_hash bigint")
    for i in range(n_parts):
        code = F.xxhash64("p")
        part = own.where(F.pmod(code, F.lit(n_parts)) == i).select(code.alias("code"), "p").toArrow()
        found = list(zip(part["code"].to_pylist(), part["p"].to_pylist(), strict=True))
        if found:
            shared = spark.sparkContext.broadcast({"id": hash(tuple(sorted(c for c, _ in found))), "patterns": found})
            out = out.unionByName(rows.mapInArrow(_search(shared, head), "text_hash bigint, pattern_hash bigint"))
    return out
