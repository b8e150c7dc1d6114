"""Phrase collocations by hierarchical pair naming.

A phrase of k words is named by the ids of its first and of its last k - 1 words. Level by level the documents are streamed,
neighbouring ids that may be frequent become pairs, the pairs are counted over the whole corpus, and those that reach the
bound get a row with their id and both parents. A pair can't be more frequent than its parents, so nothing frequent is missed.
Which ids are frequent reaches the tasks as a bit filter of fixed size: where it says yes in error, pairs are counted that
then miss the bound, so results don't depend on its size. Longer phrases are looked for only where frequent word pairs stand
side by side; these runs of pair ids are written once, and a sketch of their phrases' counts spares most rare ones. The parents are the pointers by which the counts of both parts of
each cut and of longer phrases are looked up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import staged
from .grams import BitFilter, WordIds, pair_ids

LONGEST = 5
FILTER_BITS = 26  # 8 MB
_STRETCH = 1 << 20  # bytes of text that a task cuts into words at once
_FLUSH = 200_000  # distinct words that a task counts before it hands them on
_PAIRS = 1_000_000  # pairs likewise
_SKETCH_BITS, _PLACES = 22, 1 << 16  # places of the sketch, and of one of its parts
_BREAK = b"\xff"  # no byte of UTF-8: ends a piece
# exact: products of two counts pass 64 bits, 38 decimal digits hold counts up to 10 ** 17
SCORE = "cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(n as decimal(38,0)) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))"
_PAIR = "left bigint, right bigint, a bigint"
_TABLE = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def _folded(text: str) -> bytes:
    return text.encode().lower().translate(_TABLE)


def _words(folded: bytes) -> list[bytes]:
    return list(filter(None, folded.replace(_BREAK, b" \xff ").replace(b"\t", b" ").split(b" ")))


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, with a mark where a piece ends."""
    return _words(_folded(text or ""))


def _stretches(text: str) -> Iterator[bytes]:
    """A text in stretches of about ``_STRETCH`` bytes that end with a piece."""
    raw, at = _folded(text), 0
    while (cut := raw.find(_BREAK, at + _STRETCH)) >= 0:
        yield raw[at:cut]
        at = cut + 1
    yield raw[at:]


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The words of a batch's texts, of one language at a time and of about ``_STRETCH`` bytes, with a mark behind every piece."""
    found: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        for part in _stretches(text.as_py()):
            found.setdefault(lang, []).append(part)
            sizes[lang] += len(part) + 1
            if sizes[lang] > _STRETCH:
                yield lang, _words(_BREAK.join([*found.pop(lang), b""]))
                sizes[lang] = 0
    for lang, parts in found.items():
        yield lang, _words(_BREAK.join([*parts, b""]))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own.pop(_BREAK, None)
            words = list(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array([w.decode() for w in words], pa.string()), pa.array(_ids(lang, WordIds(), words).view(np.int64)), pa.array(own.values(), pa.int64())], ["lang", "word", "id", "a"])
        counts.clear()

    for batch in batches:
        for lang, words in _by_lang(batch):
            counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > _FLUSH:
                yield from flush()
    yield from flush()


def _ids(lang: str, known: WordIds, words: list[bytes]) -> np.ndarray:
    """Ids of words of one language; the memory of words is shared by all."""
    return pair_ids(np.uint64(known[lang.encode()]), known.of(words))


class _Pairs:
    """Pairs of neighbouring ids, counted in the task before they are handed on."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, *pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(pairs)
        if sum(len(x[0]) for x in self.held) > _PAIRS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            name, left, right = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held.clear()
            _, first, n = np.unique(name, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (left[first], right[first], n)], ["left", "right", "a"])


def _word_pairs(batches: Iterator[pa.RecordBatch], frequent: BitFilter) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every stretch: which neighbours may both be frequent words, and the pairs' ids, left and right parts."""
    known = WordIds()
    for batch in batches:
        for lang, words in _by_lang(batch):
            name = _ids(lang, known, words)
            good = frequent.has(name) & (name != _ids(lang, known, [_BREAK])[0])
            yield good[:-1] & good[1:], pair_ids(name[:-1], name[1:]), name[:-1], name[1:]


def _count_word_pairs(filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Pairs()
        for good, name, left, right in _word_pairs(batches, filters.value[0]):
            yield from pairs.add(name[good], left[good], right[good])
        yield from pairs.flush()

    return run


def _pair_runs(filters):
    """The ids of frequent word pairs that stand beside another, in order; 0 ends a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = filters.value
        for good, name, _, _ in _word_pairs(batches, words):
            good &= pairs.has(name)
            beside = np.concatenate(([False], good[:-1] & good[1:], [False]))
            kept = good & (beside[:-1] | beside[1:])
            after = np.concatenate(([False], kept[:-1]))
            ids = np.where(kept, name, np.uint64(0))[kept | after]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([ids.view(np.int64)], pa.list_(pa.int64()))], ["ids"])

    return run


def _phrase_pairs(batches: Iterator[pa.RecordBatch], level: int, frequent: list[BitFilter]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Neighbouring (level - 1)-word phrases of the runs, named up from the word pairs: ids, left and right parts."""
    for batch in batches:
        for ids in batch.column(0):
            name = ids.values.to_numpy(zero_copy_only=False).view(np.uint64)
            good = name != 0
            for k in range(3, level + 1):
                both, left, right = good[:-1] & good[1:], name[:-1], name[1:]
                name = pair_ids(left, right)
                good = both & frequent[k - 1].has(name) if k < level else both
            yield name[good], left[good], right[good]


def _sketch(level: int, filters, bits: int):
    """How often ids fall into each of 2 ** bits places, two places an id; counts beyond 255 stay 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << bits
        counts = np.zeros(size, np.int64)
        for name, _, _ in _phrase_pairs(batches, level, filters.value):
            for at in BitFilter.places(name, bits):
                counts += np.bincount(at.astype(np.int64), minlength=size)
        parts = np.minimum(counts, 255).astype(np.uint8).reshape(-1, _PLACES)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["part", "counts"])

    return run


def _reached(least: int):
    """Sketches, in the order of their parts, added up: a bit for each place with ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, np.zeros(_PLACES, np.int64)

        def bits() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(total >= min(least, 255), bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

        for batch in batches:
            for own, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own != part:
                    if part is not None:
                        yield bits()
                    part, total[:] = own, 0
                total += np.frombuffer(counts.as_py(), np.uint8)
        if part is not None:
            yield bits()

    return run


def _count_phrase_pairs(level: int, filters, likely):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Pairs()
        for name, left, right in _phrase_pairs(batches, level, filters.value):
            good = likely.value.has(name)
            yield from pairs.add(name[good], left[good], right[good])
        yield from pairs.flush()

    return run


@pandas_udf(T.LongType())
def _pair_id(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(pair_ids(left.to_numpy(np.int64).view(np.uint64), right.to_numpy(np.int64).view(np.uint64)).view(np.int64))


def likely_pairs(runs: DataFrame, level: int, filters, least: int) -> BitFilter:
    """Phrases of the runs that may occur ``least`` times: a sketch of fixed size counts too much, never too little."""
    parts = runs.mapInArrow(_sketch(level, filters, _SKETCH_BITS), "part int, counts binary")
    got = parts.repartition("part").sortWithinPartitions("part").mapInArrow(_reached(least), "part int, bits binary").toArrow()
    return BitFilter.of_parts(_SKETCH_BITS, dict(zip(got["part"].to_pylist(), got["bits"].to_pylist(), strict=True)), _PLACES // 8)


def bit_filter(ids: DataFrame, bits: int) -> BitFilter:
    """The set of ``id`` as bits, or-ed together on the executors; what the driver gets is bounded by ``bits``, not by the ids."""
    at = F.explode(F.array(F.col("id").bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned("id", 32).bitwiseAND(F.lit((1 << bits) - 1)))).alias("at")
    words = ids.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("value"))
    got = words.toArrow()
    return BitFilter(bits, got["word"].to_numpy(), got["value"].to_numpy().view(np.uint64))


def phrase_names(docs: DataFrame, least: int = 100, longest: int = LONGEST, text: str = "text", lang: str = "lang", filter_bits: int = FILTER_BITS) -> tuple[DataFrame, list[DataFrame]]:
    """``lang``, ``n`` (all words), and for each length a staged table of its phrases with ``a`` >= ``least`` occurrences.

    Words: ``id``, ``lang``, ``word``, ``a``; longer phrases: ``id``, ``left``, ``right``, ``a``. Ids hold the language.
    """
    rows = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    words = rows.mapInArrow(_count_words, "lang string, word string, id bigint, a bigint")
    words = staged(words.groupBy("lang", "word", "id").agg(F.sum("a").alias("a")), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    names, filters, runs = [words.where(F.col("a") >= least)], [], None
    for level in range(2, longest + 1):
        filters.append(bit_filter(names[-1], filter_bits))
        shared = docs.sparkSession.sparkContext.broadcast(list(filters))
        if level == 2:
            pairs = rows.mapInArrow(_count_word_pairs(shared), _PAIR)
        else:
            if runs is None:
                runs = staged(rows.mapInArrow(_pair_runs(shared), "ids array<bigint>"), "pair-runs")
            likely = docs.sparkSession.sparkContext.broadcast(likely_pairs(runs, level, shared, least))
            pairs = runs.mapInArrow(_count_phrase_pairs(level, shared, likely), _PAIR)
        counted = pairs.groupBy("left", "right").agg(F.sum("a").alias("a")).where(F.col("a") >= least).select(_pair_id("left", "right").alias("id"), "left", "right", "a")
        names.append(staged(counted, f"phrases-{level}"))
        shared.unpersist()
    return totals, names


def _looked_up(names: list[DataFrame]) -> list[DataFrame]:
    """Each length's phrases with their text and the counts of their beginnings and endings (by length, themselves included)."""
    a = F.col("a")
    out = [names[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", F.array(a).alias("heads"), F.array(a).alias("tails"))]
    for own in names[1:]:
        left = out[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("_p"), F.col("heads").alias("_h"))
        right = out[-1].select(F.col("id").alias("right"), "last", F.col("tails").alias("_t"))
        met = own.join(left, "left").join(right, "right")
        out.append(met.select("id", "lang", F.concat_ws(" ", "_p", "last").alias("phrase"), "last", "a", F.concat("_h", F.array(a)).alias("heads"), F.concat("_t", F.array(a)).alias("tails")))
    return out


def collocations(docs: DataFrame, least: int = 100, top: int | None = 2000, longest: int = LONGEST, cover: int = 100, text: str = "text", lang: str = "lang", filter_bits: int = FILTER_BITS) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs.
    ``score`` is the least of floor(1000 * a * n / (l * r)) over the cuts, computed in exact decimals; ties of cuts go to the
    shortest first part. Phrases inside a longer one with at least ``cover`` percent of their occurrences go; the longer one
    need not be kept itself. A phrase one word longer decides: counts only fall with length. ``top`` None keeps all ranks.

    A null language is ``und``, together with rows that say so; null and empty texts hold no words; repeated rows count each
    time; texts of any length are read whole. An empty table gives no rows; further columns aren't read. Ids are 64-bit
    hashes; two frequent words or phrases with one id would raise (the names' join keys must be unique).
    """
    totals, names = phrase_names(docs, least, longest, text, lang, filter_bits)
    for own in names:
        if own.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("two frequent phrases have one id")
    found = []
    known = _looked_up(names)
    for k in range(2, longest + 1):
        own = known[k - 1]
        if k < longest:
            longer = names[k].select(F.explode(F.array("left", "right")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("_longer"))
            own = own.join(longer, "id", "left").where(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * cover))
        found.append(own.select("lang", "phrase", "a", "heads", "tails", F.lit(k).alias("_k")))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    # the languages' totals are a row each
    rows = rows.join(totals, "lang")
    parts = F.transform(F.sequence(F.lit(1), F.col("_k") - 1), lambda i: F.struct(i.alias("i"), F.element_at("heads", i).alias("l"), F.element_at("tails", F.col("_k") - i).alias("r")))
    rows = rows.withColumn("_part", F.explode(parts)).select("lang", "phrase", "a", "n", "_part.*")
    cuts = rows.withColumn("score", F.expr(SCORE))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "i", "l", "r")).alias("_cut"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("_cut.score"), F.desc("a"), "phrase"))
    ranked = best.withColumn("rank", rank)
    kept = ranked if top is None else ranked.where(F.col("rank") <= top)
    return kept.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score"))
