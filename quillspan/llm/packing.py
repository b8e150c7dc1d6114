"""Packing token sequences by cutting-stock column generation.

Documents become token ids and an end id, cut into pieces of at most ``capacity`` tokens. Pieces are counted by length in
units (a table no longer than the number of units). A linear program chooses how often to use each pattern of lengths: a
revised simplex keeps the basis, and an unbounded knapsack solved by dynamic programming over the dual prices gives the
next column until none improves. The solution is rounded down, what is left over (less than one pattern for each length)
is packed first-fit decreasing, and the pieces, ranked within their length, take the patterns' places in order.
"""

from __future__ import annotations

import itertools
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

PIECES = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, kind int, pid int, nth bigint"


def _unstable() -> str:
    """Letters and digits whose composed lower-case form ends with another kind of character, as İ and क़ do; there are none above."""
    return "".join(c for c in map(chr, range(0x20000)) if c.isalnum() and not unicodedata.normalize("NFC", c).lower()[-1].isalnum())


UNSTABLE = frozenset(_unstable())
MARKS = ".,;:!?"


# of the 256 characters of Latin-1: marks, what ends a word, and what a mark may stand behind to be a pre-token of its own
_IS_MARK, _IS_END, _IS_LETTER = (np.array([test(chr(c)) for c in range(256)]) for test in (MARKS.__contains__, " \n\t\r".__contains__, str.isalnum))


def marks_follow_letters(text: str, latin1: bytes | None = None) -> bool:
    """Whether each closing mark before white space stands behind a letter or digit, so that it is a pre-token of its own.

    ``latin1``: the text in that encoding, if it has one; other texts have only spaces as white space.
    """
    if latin1 is not None:
        c = np.frombuffer(latin1, np.uint8)
        return not (_IS_MARK[c[1:-1]] & _IS_END[c[2:]] & ~_IS_LETTER[c[:-2]]).any()
    for mark in MARKS:
        at = text.find(f"{mark} ", 1)
        while at > 0:
            before = text[at - 1]
            if not before.isalnum() or before in UNSTABLE:
                return False
            at = text.find(f"{mark} ", at + 2)
    return True


class WordEncoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes, by a tokenizer that lower-cases and drops white space.

    No pre-token holds white space, so the ids of a text are those of its space-delimited words in order; the library
    encodes each word once. A closing mark after a letter is a pre-token of its own, so a word with one is made of two known
    parts, unless composing or lower-casing leaves another character than a letter before the mark. Latin-1 texts are lower-cased first, as the tokenizer would (a text with "<|" isn't: its special strings are
    told by case). New words of letters only are encoded in one call and told apart by the mark that ends a word's last token.
    ``most`` bounds the memory of words: when the newer half is full it becomes the older half, whose words come back when
    they are met. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        own = json.loads(self.tok.to_str())
        steps, split = (own["normalizer"] or {}).get("normalizers", []), (own["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.by_word = any(x["type"] == "Lowercase" for x in steps) and split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed"
        self.most = most
        self.seen: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        suffix = own["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, encoded in one call."""
        ids = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.nonzero(self.ends[ids])[0] + 1) * 4
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            return self.library(words)
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, words: set[str]) -> None:
        if len(self.seen) > self.most // 2:
            self.seen, self.older = {"": b""}, self.seen
        seen, older = self.seen, self.older
        back = {w for w in words if w in older}
        for w in back:
            seen[w] = older[w]
        words = words - back
        marked = {w for w in words if w[-1] in MARKS and w[-2:-1].isalpha() and w[-2] not in UNSTABLE}
        parts = (words - marked).union((w[:-1] for w in marked), (w[-1] for w in marked)).difference(seen)
        letters = [w for w in parts if w.isalpha()]
        if letters:
            seen.update(zip(letters, self.joined(letters), strict=True))
        if len(letters) < len(parts):
            rest = [w for w in parts if not w.isalpha()]
            seen.update(zip(rest, self.library(rest), strict=True))
        for w in marked:
            seen[w] = seen[w[:-1]] + seen[w[-1]]

    def spaced(self, text: str) -> str:
        """``text`` with single spaces where its words part."""
        latin1 = in_latin1(text)
        if latin1 is not None and "<|" not in text:
            text = text.lower()
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if marks_follow_letters(text, latin1):
            for mark in MARKS:
                text = text.replace(f"{mark} ", f" {mark} ")
        return text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Only the distinct words of all the texts meet Python; the ids are laid out by their numbers."""
        if not self.by_word or not texts:
            return self.library(texts) if texts else []
        split = pc.split_pattern(pa.array([self.spaced(t) for t in texts], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = self.seen.get
        ids = list(map(known, words))
        if None in ids:
            self.learn({w for w, x in zip(words, ids) if x is None})
            ids = [self.seen[w] if x is None else x for w, x in zip(words, ids)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(sizes) - sizes
        each = sizes[at]
        ends = np.r_[0, np.cumsum(each)]
        flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(first[at] - ends[:-1], each) + np.arange(ends[-1])]
        cuts = ends[split.offsets.to_numpy()].tolist()
        return [flat[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]

    def __call__(self, text: str) -> bytes:
        return self.encode([text])[0]


def in_latin1(text: str) -> bytes | None:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


GROUP, GROUP_CHARACTERS = 1024, 2_000_000  # texts that are encoded together, at most


def grouped(texts: pa.Array) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t.as_py() or "")
        size += len(group[-1])
        if len(group) == GROUP or size > GROUP_CHARACTERS:
            yield group
            group, size = [], 0
    yield group


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, most: int = 800_000) -> WordEncoder:
    """Kept while the Python worker lives, so that later tasks find their words known."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = WordEncoder(path, most)
    return _ENCODERS[path, most]


def _pieces(path: str, capacity: int, unit: int, end_id: int, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pid, end = encoder(path, remembered).encode, TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        nth = np.zeros(capacity // unit + 2, np.int64)
        for rows in batches:
            out: list[list] = [[] for _ in range(8)]
            encoded = itertools.chain.from_iterable(map(encode, grouped(rows.column(1))))
            for k, ids in zip(rows.column(0).to_pylist(), encoded, strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    kind = -(-length // unit)
                    for col, x in zip(out, (k, start, length, zlib.crc32(piece), n, kind, pid, nth[kind]), strict=True):
                        col.append(x)
                    nth[kind] += 1
            types = (pa.int64(),) * 5 + (pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["id", "start", "length", "ids_crc32", "doc_tokens", "kind", "pid", "nth"])

    return run


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: ``prices[t]`` for length t (1..capacity); the value and how many of each length."""
    value, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        options = prices[1 : c + 1] + value[c - 1 :: -1][:c]
        k = int(options.argmax())
        value[c], took[c] = (options[k], k + 1) if options[k] > value[c - 1] + 1e-12 else (value[c - 1], 0)
    pattern, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        if took[c] == 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= took[c]
    return value[capacity], pattern


def solve_patterns(demand: np.ndarray, capacity: int, rounds: int = 50_000) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that cover ``demand`` (count of each length, index 0 unused), near the fewest sequences.

    It raises if the simplex isn't at its optimum after ``rounds`` columns.
    """
    types = np.nonzero(demand)[0]
    if not len(types):
        return []
    m = len(types)
    columns = np.zeros((m, m))
    np.fill_diagonal(columns, capacity // types)
    inverse = np.diag(1.0 / (capacity // types))
    needs = demand[types] * (1 + 1e-9 * np.arange(1, m + 1))  # breaks ties, so that the simplex doesn't cycle
    x = inverse @ needs
    prices = np.zeros(capacity + 1)
    for _ in range(rounds):
        prices[types] = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = best_pattern(prices, capacity)
        if value <= 1 + 1e-7:
            break
        column = pattern[types].astype(float)
        step = inverse @ column
        rows = np.nonzero(step > 1e-10)[0]
        out = rows[(x[rows] / step[rows]).argmin()]
        theta = x[out] / step[out]
        x = np.maximum(x - theta * step, 0)
        x[out] = theta
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
        columns[:, out] = column
    else:
        raise RuntimeError("the simplex didn't reach its optimum")
    found, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-x):
        pattern = np.zeros(capacity + 1, np.int64)
        pattern[types] = np.rint(columns[:, j]).astype(np.int64)
        times = int(x[j] + 1e-6)
        if times:
            found.append((pattern, times))
            left -= pattern * times
    left = np.maximum(left, 0)
    while left.any():  # at most a pattern's worth for each length is left
        pattern, room = np.zeros(capacity + 1, np.int64), capacity
        for t in range(capacity, 0, -1):
            k = min(int(left[t]), room // t)
            pattern[t] += k
            room -= k * t
        times = max(1, int((left[pattern > 0] // pattern[pattern > 0]).min()))
        found.append((pattern, times))
        left -= pattern * times
    return found


def placements(found: list[tuple[np.ndarray, int]], demand: np.ndarray) -> pd.DataFrame:
    """For each length, ranges of ranks: ``kind``, ``first`` rank, ``each`` (places in a sequence), ``sequence`` (first id)."""
    used, base, rows = np.zeros(len(demand), np.int64), 0, []
    for pattern, times in found:
        for t in np.nonzero(pattern)[0]:
            if used[t] < demand[t]:
                rows.append((int(t), int(used[t]), int(pattern[t]), base))
                used[t] += int(pattern[t]) * times
        base += times
    return pd.DataFrame(rows, columns=["kind", "first", "each", "sequence"]).sort_values(["kind", "first"], ignore_index=True)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, unit: int = 8, end_id: int = 1, remembered: int = 800_000) -> DataFrame:
    """Pieces of all documents with their places: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``tokenizer`` is a path every executor has. A null or empty text is the end id alone. Null ids and repeated rows keep
    their own pieces. Texts of any length are encoded whole and cut into pieces. An empty table gives no rows; other columns are ignored. The driver sees one count for each of ``capacity / unit`` lengths.
    A worker remembers the ids of ``remembered`` words: more take memory, fewer time, and the ids are the same.
    """
    if capacity % unit:
        raise ValueError("capacity must be a multiple of unit")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = staged(rows.mapInArrow(_pieces(tokenizer, capacity, unit, end_id, remembered), PIECES), "pieces")
    parts = pieces.groupBy("kind", "pid").agg(F.count(F.lit(1)).alias("n"))
    demand = np.zeros(capacity // unit + 1, np.int64)
    for r in parts.groupBy("kind").agg(F.sum("n").alias("n")).collect():
        demand[r["kind"]] = r["n"]
    places = placements(solve_patterns(demand, capacity // unit), demand)

    @F.pandas_udf("long")
    def sequence_of(kind: pd.Series, rank: pd.Series) -> pd.Series:
        table = places
        big = np.int64(1) << 44
        at = np.searchsorted(table["kind"].to_numpy() * big + table["first"].to_numpy(), kind.to_numpy() * big + rank.to_numpy(), side="right") - 1
        return pd.Series(table["sequence"].to_numpy()[at] + (rank.to_numpy() - table["first"].to_numpy()[at]) // table["each"].to_numpy()[at])

    bases = parts.withColumn("base", F.sum("n").over(Window.partitionBy("kind").orderBy("pid")) - F.col("n")).select("kind", "pid", "base")
    placed = pieces.join(bases, ["kind", "pid"]).withColumn("rank", F.col("base") + F.col("nth")).withColumn("sequence_id", sequence_of("kind", "rank"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("kind"), "rank")
    placed = placed.withColumn("offset", F.sum("length").over(inside) - F.col("length"))
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
