"""Token counts of whole texts; huge texts are encoded as overlapping chunks that are spliced at proven boundaries.

A splice point lies between a letter and a space that a letter follows. The byte-level pre-tokenizer never puts these two
characters into one match and its pattern looks at nothing before a match, so the tokens of a chunk that starts anywhere
before the point are, from the point on, those of the whole text, up to what the chunk's own end can change; the left
chunk's tokens before the point are final since the point lies well before that end. A point counts only if both
encodings have a token boundary there. Where the overlap has no such point it is doubled, to the whole text if need be.

Other texts are cut at the single spaces that stand between two characters that are no white space: the pre-tokenizer's
matches hold a space only as their first character or in a run of white space, so every such space begins a match, and the
count of a text is the sum of the counts of its parts. Parts are counted once and remembered.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BOUNDARY = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_WHITE = re.compile("[\\s\u180e]")
_WHITE_BUT_NEWLINE = re.compile("[\t\x0b-\x0d\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BESIDE_NEWLINE = re.compile("\n[\\s\u180e]|[\\s\u180e]\n|^\n|\n$")
_MARKS = frozenset(".,;:!?")
_MARGIN = 64  # characters at a chunk's end whose tokens what follows could change, and longest special string


def load(path: str):
    """The tokenizer of a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file, as a function: texts to token counts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return None, lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok, lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]


def count_spliced(tok, text: str, chunk: int = 16_384, overlap: int = 512) -> int:
    """Tokens of ``text``, encoded chunk by chunk; equal to ``len(tok.encode(text))``."""
    n, total, at = len(text), 0, 0
    while True:
        # the text from `at` on starts at a proven boundary (or at the text's start)
        size, lap = chunk, overlap
        while True:
            end = at + size
            left = tok.encode(text[at:end], add_special_tokens=False)
            if end >= n:
                return total + len(left)
            begin = max(at + 1, end - lap)
            right = tok.encode(text[begin : end + lap], add_special_tokens=False)
            ours = {b + at: k + 1 for k, (_, b) in enumerate(left.offsets)}
            theirs = {a + begin for a, _ in right.offsets}
            points = [m.start() for m in _BOUNDARY.finditer(text, begin + _MARGIN, end - _MARGIN)]
            point = next((p for p in reversed(points) if p in ours and p in theirs), None)
            if point is not None:
                break
            size, lap = size + lap, lap * 2
        total += ours[point]
        at = point


class PartCounter:
    """Token counts of texts by a byte-level tokenizer, summed over the parts between single spaces.

    ``most`` bounds the remembered parts; beyond, memory begins anew.
    """

    def __init__(self, tok, count, most: int = 800_000):
        self.tok, self.count, self.most = tok, count, most
        self.seen: dict[str, int] = {}

    def learn(self, parts: set[str]) -> None:
        """A closing mark after a letter is a pre-token of its own, and so is a single newline between two other characters.

        What is left of a space and letters is encoded as one text and told apart by the tokens' offsets.
        """
        seen = self.seen
        lines = {p: p.split("\n") for p in parts if "\n" in p and not _BESIDE_NEWLINE.search(p)}
        parts = parts.difference(lines).union(*lines.values(), ("\n",) if lines else ())
        marked = {p for p in parts if p[-1:] in _MARKS and p[-2:-1].isalpha()}
        parts = parts.difference(marked).union((p[:-1] for p in marked), (p[-1] for p in marked)).difference(seen)
        words = [p for p in parts if p[:1] == " " and p[1:].isalpha()]
        rest = list(parts.difference(words))
        seen.update(zip(rest, self.count(rest), strict=True))
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            starts = [0, *itertools.accumulate(map(len, some))]
            begins = [a for a, _ in self.tok.encode("".join(some), add_special_tokens=False).offsets]
            places = [bisect.bisect_left(begins, s) for s in starts]
            seen.update((w, b - a) for w, a, b in zip(some, places, places[1:]))
        seen.update([(p, seen[p[:-1]] + seen[p[-1]]) for p in marked])
        seen.update([(p, sum(map(seen.__getitem__, pieces)) + (len(pieces) - 1) * seen["\n"]) for p, pieces in lines.items()])

    def parts(self, text: str) -> list[str]:
        """Parts of any text; where white space of another kind or several spaces meet, neighbouring words stay together."""
        words = text.split(" ")
        out = [words[0]]
        for before, w in zip(words, words[1:]):
            if before and w and not _WHITE.match(before[-1]) and not _WHITE.match(w[0]):
                out.append(" " + w)
            else:
                out[-1] += " " + w
        return out

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.seen) > self.most:
            self.seen = {}
        seen, cut = self.seen, []
        for t in texts:
            if t[:1] == " " or t[-1:] == " " or "  " in t or "\n " in t or " \n" in t or _WHITE_BUT_NEWLINE.search(t):
                cut.append(self.parts(t))
            else:
                first, *others = t.split(" ")
                cut.append([first, *map(" ".__add__, others)])
        new = {p for parts in cut for p in parts if p not in seen}
        if new:
            self.learn(new)
        return [sum(map(seen.__getitem__, parts)) for parts in cut]


_LOADED: dict[str, tuple] = {}


def counter(path: str):
    """The tokenizer and its counter; kept while the Python worker lives, so that later tasks find their words known."""
    if path not in _LOADED:
        tok, count = load(path)
        _LOADED[path] = tok, PartCounter(tok, count) if tok is not None else count
    return _LOADED[path]


def _counts(path: str, huge: int, batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, count = counter(path)
        for rows in batches:
            texts = [t.as_py() or "" for t in rows.column(1)]
            long = [i for i, t in enumerate(texts) if len(t) > huge] if tok is not None else []
            found = {i: count_spliced(tok, texts[i]) for i in long}
            short = [i for i in range(len(texts)) if i not in found]
            for k in range(0, len(short), batch):
                part = short[k : k + batch]
                found.update(zip(part, count([texts[i] for i in part]), strict=True))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([found[i] for i in range(len(texts))], pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, huge: int = 65_536, batch: int = 32) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    ``tokenizer`` is the path of a vocabulary file that every executor has. Texts over ``huge`` characters are spliced.
    Null texts count as empty (0 tokens); null ids and repeated rows stay; an empty table gives no rows; other columns are
    ignored, whatever their names. Very long texts are never held as one encoding.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_counts(tokenizer, huge, batch), "id bigint, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
