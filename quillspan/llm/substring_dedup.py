"""Repeated passages by suffix automata of reference shards.

Every window of words belongs to the least of its word grams, so windows that are equal have the same gram. A run is
neighbouring windows of a text with one gram; the words it spans are its fragment. The fragments of one gram are a
shard of the reference: a task builds their suffix automaton, with the occurrences of every state, streams the fragments
through it, and the matching statistics (the longest end of each prefix that occurs once more) give the windows that repeat.
Only fragments of grams that occur twice take part. A fragment meets no other shard's automaton, so work grows with the
corpus, where broadcasting every shard to every text would grow with its square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import fresh, staged, text_or_empty, with_row_key
from .grams import WordIds, gram_hashes

WINDOW = 35
GRAM = 8
SHARD = 2000  # places of a gram that one automaton takes; grams of more are decided window by window
_CHUNK = 200_000  # words that a task looks at together
_SEEN = 100_000  # fragments whose text a task has handed on already
_OUT = 4096


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []  # at \x20 and \x09-\x0D, as bytes are


def least_gram_runs(ids: np.ndarray, lengths: list[int], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one least gram, over texts laid end to end: gram hash, text number, first window, windows, places of the gram."""
    none = np.zeros(0, np.int64)
    total = len(ids)
    if total < window:
        return none.view(np.uint64), none, none, none, none
    text = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.repeat(np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    at = np.flatnonzero(text[: total - window + 1] == text[window - 1 :])
    if not len(at):
        return none.view(np.uint64), none, none, none, none
    hashes = gram_hashes(ids, gram)
    least = np.lib.stride_tricks.sliding_window_view(hashes, window - gram + 1).argmin(axis=1)[at] + at
    moved = np.concatenate(([True], (np.diff(least) != 0) | (np.diff(at) != 1)))
    # a gram that comes again before another takes over, as in a phrase said over and over, goes on with its run
    first = np.flatnonzero(np.concatenate(([True], (np.diff(hashes[least]) != 0) | (np.diff(at) != 1))))
    ends = np.concatenate((first, [len(at)]))
    places = np.diff(np.concatenate(([0], np.cumsum(moved)))[ends])
    return hashes[least[first]], text[at[first]], (at - begin[at])[first], np.diff(ends), places


def _find_runs(window: int, gram: int):
    """Of each text with a window: key, words, and its runs as four lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds()
        keys: list[bytes] = []
        ids: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = [len(x) for x in ids]
            hashes, text, start, n, places = least_gram_runs(np.concatenate(ids) if ids else np.zeros(0, np.uint64), lengths, window, gram)
            ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(ids))))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (hashes.view(np.int64), *(x.astype(np.int32) for x in (start, n, places)))]
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lengths, pa.int64()), *lists], ["key", "words", "grams", "starts", "counts", "places"])
            keys.clear()
            ids.clear()
            yield out

        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                if len(words) >= window:
                    keys.append(key.as_py())
                    ids.append(known.of(words))
                    held += len(words)
                if held > _CHUNK:
                    yield from flush()
                    held = 0
        if keys:
            yield from flush()

    return run


def _cut_fragments(window: int):
    """The fragments of a text's runs; for the runs of very frequent grams the text's different windows with all their places.

    A fragment's words are handed on once a task, as long as it remembers that it did.
    """
    schema = pa.schema([("gram", pa.int64()), ("digest", pa.binary()), ("rid", pa.int64()), ("starts", pa.list_(pa.int32())), ("copies", pa.int64()), ("single", pa.bool_()), ("words", pa.string())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        out: list[tuple] = []
        for batch in batches:
            for text, rid, copies, runs in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2)), batch.column(3), strict=True):
                words = words_of(text.as_py())
                windows: dict[bytes, list[int]] = {}
                for r in runs.as_py():
                    start, n = r["start"], r["n"]
                    if r["hot"]:
                        for i in range(start, start + n):
                            windows.setdefault(_digest(words[i : i + window]), []).append(i)
                    else:
                        part = words[start : start + n + window - 1]
                        digest = _digest(part)
                        out.append((r["gram"], digest, rid, [start], copies, False, None if digest in seen else b" ".join(part).decode()))
                        seen.add(digest)
                out.extend((None, digest, rid, at, copies * len(at), True, None) for digest, at in windows.items())
                if len(out) >= _OUT:
                    yield batch_of(out)
                    out = []
                if len(seen) > _SEEN:
                    seen.clear()
        if out:
            yield batch_of(out)

    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


class SuffixAutomaton:
    """Of several word sequences; every state counts the ends of its strings, weighted by the sequences' copies."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state of the longest string of ``p`` followed by ``word``, made if it is part of a longer one's state."""
        nxt, link, length = self.next, self.link, self.length
        q = nxt[p][word]
        if length[q] == length[p] + 1:
            return q
        clone = self._state(length[p] + 1, link[q], dict(nxt[q]))
        link[q] = clone
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone

    def add(self, words: list[bytes], copies: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            if word in nxt[last]:
                last = self._split(last, word)
            else:
                new = self._state(length[last] + 1, 0, {})
                p = last
                while p >= 0 and word not in nxt[p]:
                    nxt[p][word] = new
                    p = link[p]
                if p >= 0:
                    link[new] = self._split(p, word)
                last = new
            self.count[last] += copies

    def repeated(self) -> list[int]:
        """For each state the length of its longest end that occurs twice."""
        link, length, count = self.link, self.length, self.count
        order = sorted(range(1, len(link)), key=length.__getitem__)
        for s in reversed(order):
            count[link[s]] += count[s]
        best = [0] * len(link)
        for s in order:
            best[s] = length[s] if count[s] > 1 else best[link[s]]
        return best

    def matching_statistics(self, words: list[bytes], best: list[int]) -> Iterator[int]:
        """For each prefix of a sequence it was built from, the length of its longest end that occurs elsewhere too."""
        s = 0
        for i, word in enumerate(words, 1):
            s = self.next[s][word]
            yield min(i, best[s])


def _ranges(flags: list[bool]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for i, yes in enumerate(flags):
        if yes and out and out[-1][1] == i:
            out[-1][1] = i + 1
        elif yes:
            out.append([i, i + 1])
    return [(a, b) for a, b in out]


def shard_repeats(parts: list[tuple[list[bytes], int]], window: int) -> list[list[tuple[int, int]]]:
    """For each fragment (words, copies) of a shard the ranges of windows, by first word, that occur at least twice in it."""
    if len(parts) == 1 and parts[0][1] > 1:
        return [[(0, len(parts[0][0]) - window + 1)]]
    automaton = SuffixAutomaton()
    for words, copies in parts:
        automaton.add(words, copies)
    best = automaton.repeated()
    return [_ranges([m >= window for m in list(automaton.matching_statistics(words, best))[window - 1 :]]) for words, _ in parts]


def _match_shards(window: int):
    """Fragments come ordered by gram and digest; a shard is at most ``SHARD`` runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rid", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
        gram, shard, out = None, {}, []

        def close() -> None:
            places = list(shard.values())
            found = shard_repeats([(words.encode().split(), copies) for words, copies, _ in places], window)
            for (_, _, where), ranges in zip(places, found, strict=True):
                out.extend((rid, start + a, start + b + window - 1) for rid, start in where for a, b in ranges)

        for batch in batches:
            for own, digest, rid, start, copies, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != gram:
                    if shard:
                        close()
                    gram, shard = own, {}
                place = shard.setdefault(digest, [None, 0, []])
                place[0] = words or place[0]
                place[1] += copies
                place[2].append((rid, start))
            if len(out) >= _OUT:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                out.clear()
        if shard:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, text: str = "text", gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """Spans of words, by text, that lie in a window of ``window`` words found twice or more in all texts.

    ``key`` (MD5 of the text, 16 bytes), ``spans`` (array of begin, end, begin, end ..., counted in words, may overlap); texts
    without a span have no row.
    """
    texts = docs.select(text_key(text_or_empty(text)).alias("key"), text_or_empty(text).alias("text"))
    found = texts.mapInArrow(_find_runs(window, gram), "key binary, words bigint, grams array<bigint>, starts array<int>, counts array<int>, places array<int>")
    each = found.groupBy("key").agg(F.first(F.struct("words", "grams", "starts", "counts", "places")).alias("_r"), F.count(F.lit(1)).alias("copies"))
    runs = staged(with_row_key(each.select("key", "copies", "_r.*"), "rid"), "runs")

    every = runs.select("rid", F.explode(F.arrays_zip("grams", "starts", "counts", "places")).alias("r")).select("rid", F.col("r.grams").alias("gram"), F.col("r.starts").alias("start"), F.col("r.counts").alias("n"), F.col("r.places").alias("places"))
    repeated = every.groupBy("gram").agg(F.sum("places").alias("_n")).where("_n > 1").select("gram", (F.col("_n") > shard).alias("hot"))
    wanted = every.join(repeated, "gram").groupBy("rid").agg(F.collect_list(F.struct("gram", "start", "n", "hot")).alias("runs"))
    wanted = runs.select("key", "rid", "copies").join(wanted, "rid")
    whole = texts.groupBy("key").agg(F.first("text").alias("text"))  # copies of a text are cut once
    cut = whole.join(wanted, "key").select("text", "rid", "copies", "runs").mapInArrow(_cut_fragments(window), "gram bigint, digest binary, rid bigint, starts array<int>, copies bigint, single boolean, words string")
    fragments = staged(cut, "fragments")

    matched = fragments.where(~F.col("single")).select("gram", "digest", "rid", F.get("starts", F.lit(0)).alias("start"), "copies", "words").repartition("gram").sortWithinPartitions("gram", "digest").mapInArrow(_match_shards(window), "rid bigint, begin bigint, end bigint")
    single = fragments.where("single").select("digest", "rid", "starts", "copies")
    twice = single.groupBy("digest").agg(F.sum("copies").alias("_n")).where("_n > 1").select("digest")
    ends = lambda more: F.flatten(F.transform("starts", lambda i: F.array(i.cast("bigint"), i.cast("bigint") + more)))
    spans = matched.select("rid", F.array("begin", "end").alias("s")).unionByName(single.join(twice, "digest").select("rid", ends(window).alias("s")))
    spans = spans.unionByName(runs.where("copies > 1").select("rid", F.array(F.lit(0).cast("bigint"), F.col("words")).alias("s")))
    by_text = spans.groupBy("rid").agg(F.flatten(F.collect_list("s")).alias("spans"))
    return runs.select("key", "rid").join(by_text, "rid").select("key", "spans")


_REPEATS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


@pandas_udf(_REPEATS)
def _without(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, at in zip(texts, spans, strict=True):
        words = words_of(text)
        if at is None:
            rows.append((len(words), 0, b" ".join(words).decode()))
            continue
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, at[::2], 1)
        np.add.at(change, at[1::2], -1)
        stays = np.cumsum(change[:-1]) == 0
        kept = [words[i] for i in np.flatnonzero(stays)]
        rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
    return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """All rows with ``repeats``, a struct of ``n_words``, ``n_removed`` and ``kept``: the words outside all repeated windows, joined by a space.

    A word goes if a window of ``window`` consecutive words of its text holds it whose sequence also starts anywhere else, in
    the same text or another; windows are judged on the input. Words are runs of other characters than space and \\t to \\r,
    unchanged. A null text is empty; texts shorter than a window keep all words; copies of a text (also repeated rows, whatever
    their ids) lose every word if they have a window. Texts of any length are read whole. An empty table gives no rows. Columns
    of any name stay; a column named ``repeats`` is replaced. Texts are equal if their MD5 are.
    """
    key, spans = fresh(docs, "_key"), fresh(docs, "_spans")
    found = repeated_spans(docs, window, text, gram, shard).select(F.col("key").alias(key), F.col("spans").alias(spans))
    met = docs.withColumn(key, text_key(text_or_empty(text))).join(found, key, "left")
    return met.withColumn("repeats", _without(text_or_empty(text), F.col(spans))).drop(key, spans)
