"""Context chunks with exact character spans, as arrays of structs on the row (no shuffle)."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import in_slices

CHUNK = "array<struct<text:string,char_start:bigint,char_end:bigint,index:int>>"

WINDOW = "array<struct<token_start:bigint,token_end:bigint,text:string,char_start:bigint,char_end:bigint>>"


_GAP = re.compile(r"(?<=[.!?])\s+")
_TOKEN = re.compile(r"\S+")


def _struct_arrays(rows: list[list[tuple] | None], kind: pa.ListType) -> pa.Array:
    """An array of lists of structs from lists of tuples, nulls kept."""
    offsets, fields = [0], [[] for _ in kind.value_type]
    for row in rows:
        for found in row or ():
            for column, x in zip(fields, found, strict=True):
                column.append(x)
        offsets.append(len(fields[0]))
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(fields, kind.value_type, strict=True)], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array([r is None for r in rows], pa.bool_()))


_CHUNKS = pa.list_(pa.struct([("text", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("index", pa.int32())]))
_WINDOWS = pa.list_(pa.struct([("token_start", pa.int64()), ("token_end", pa.int64()), ("text", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64())]))

_FITTED = pa.struct([("text", pa.string()), ("char_start", pa.list_(pa.int64())), ("char_end", pa.list_(pa.int64())), ("truncated", pa.bool_())])


def _numbered(chunks: Column) -> Column:
    return F.transform(chunks, lambda c, i: F.struct(c["text"].alias("text"), c["char_start"].alias("char_start"), c["char_end"].alias("char_end"), i.cast("int").alias("index"))).cast(CHUNK)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Spans between white space that follows ``.``, ``!`` or ``?``; blank ones go; of a text without any, the whole."""
    ends, starts = [m.start() for m in _GAP.finditer(text)], [m.end() for m in _GAP.finditer(text)]
    found = zip([0, *starts], [*ends, len(text)], strict=True)
    return [(a, z) for a, z in found if text[a:z].strip()] or [(0, len(text))]


def sentences(text: Column) -> Column:
    """Chunks split at white space after ``.``, ``!`` or ``?``; blank pieces go; a text without any is one chunk.

    One pass over the text in Arrow batches: in SQL every start would be summed up, or every piece cut, from the text's beginning.
    """

    @F.arrow_udf(CHUNK)
    def cut(texts: pa.Array) -> pa.Array:
        return in_slices(lambda own: _struct_arrays([None if t is None else [(t[a:z], a, z, i) for i, (a, z) in enumerate(sentence_spans(t))] for t in own.to_pylist()], _CHUNKS), _CHUNKS, texts)

    return cut(text)


def merged_spans(text: str, spans: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    heads = [i for i, (a, z) in enumerate(spans) if i == 0 or len(text[a:z].split()) >= min_words]
    return [(spans[i][0], spans[j - 1][1]) for i, j in zip(heads, [*heads[1:], len(spans)], strict=True)]


def merge_short(text: Column, chunks: Column, min_words: int = 5) -> Column:
    """Chunks with fewer than ``min_words`` words join the chunk before them; the first stays. Spans cover what lies between.

    Only the chunks' spans go to Python, not their texts.
    """

    def of(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True)
        return _struct_arrays([None if t is None or s is None else [(t[a:z], a, z, n) for n, (a, z) in enumerate(merged_spans(t, list(zip(s, e, strict=True)), min_words))] for t, s, e in rows], _CHUNKS)

    @F.arrow_udf(CHUNK)
    def merged(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        return in_slices(of, _CHUNKS, texts, starts, ends)

    return merged(text, F.transform(chunks, lambda c: c["char_start"]), F.transform(chunks, lambda c: c["char_end"]))


def merged_sentences(text: Column, min_words: int = 5) -> Column:
    """``merge_short`` of ``sentences``, in one pass over the text."""

    @F.arrow_udf(CHUNK)
    def cut(texts: pa.Array) -> pa.Array:
        return in_slices(lambda own: _struct_arrays([None if t is None else [(t[a:z], a, z, n) for n, (a, z) in enumerate(merged_spans(t, sentence_spans(t), min_words))] for t in own.to_pylist()], _CHUNKS), _CHUNKS, texts)

    return cut(text)


def token_windows(text: Column, size: int, stride: int | None = None) -> Column:
    """Windows of ``size`` word tokens every ``stride`` (half the size if not given); the window that reaches the end is the last.

    Structs of ``token_start``, ``token_end`` (exclusive), the text and its span. A text without words has no window.
    """
    step = stride or max(1, size // 2)
    if not 1 <= step <= size:
        raise ValueError("stride must be from 1 to size")

    def windows(t: str) -> list[tuple]:
        spans = [m.span() for m in _TOKEN.finditer(t)]
        firsts = [i for i in range(0, len(spans), step) if i == 0 or i + size - step < len(spans)]
        ends = [min(i + size, len(spans)) for i in firsts]
        return [(i, j, t[spans[i][0] : spans[j - 1][1]], spans[i][0], spans[j - 1][1]) for i, j in zip(firsts, ends, strict=True)]

    @F.arrow_udf(WINDOW)
    def cut(texts: pa.Array) -> pa.Array:
        return in_slices(lambda own: _struct_arrays([None if t is None else windows(t) for t in own.to_pylist()], _WINDOWS), _WINDOWS, texts)

    return cut(text)


def without_middle(text: str, spans: list[tuple[int, int]], n: int) -> tuple[str, list[tuple[int, int]]]:
    """``text`` and its chunks' spans without the ``n`` chunks in the middle."""
    at = (len(spans) - n) // 2
    (a, _), (_, z) = spans[at], spans[at + n - 1]
    return text[:a] + text[z:], spans[:at] + [(x - z + a, y - z + a) for x, y in spans[at + n :]]


def drop_middle(text: Column, chunks: Column, n_drop: Column) -> Column:
    """Struct of the text and chunks without a block of ``n_drop`` chunks from the middle; at least one chunk stays."""
    size = F.size(chunks)
    n = F.when((n_drop <= 0) | (size <= 1), 0).otherwise(F.least(n_drop, size - 1))
    first = F.floor((size - n) / 2).cast("int")
    cut = F.get(chunks, first)["char_start"], F.get(chunks, first + n - 1)["char_end"]
    gap = cut[1] - cut[0]
    head = F.slice(chunks, F.lit(1), first)
    tail = F.transform(F.slice(chunks, first + n + 1, F.greatest(size - first - n, F.lit(0))), lambda c: F.struct(c["text"].alias("text"), (c["char_start"] - gap).alias("char_start"), (c["char_end"] - gap).alias("char_end"), c["index"].alias("index")))
    cut_text = F.concat(F.substring(text, F.lit(1), cut[0].cast("int")), F.substring(text, cut[1].cast("int") + 1, F.length(text)))
    return F.struct(F.when(n == 0, text).otherwise(cut_text).alias("text"), F.when(n == 0, chunks).otherwise(_numbered(F.concat(head, tail))).alias("chunks"))


def locate_chunk(chunks: Column, start: Column, end: Column) -> Column:
    """Index of the first chunk that overlaps [start, end); null if none does or nothing was located."""
    hit = F.filter(chunks, lambda c: (c["char_start"] < end) & (c["char_end"] > start))
    return F.when(start >= 0, F.get(hit, F.lit(0))["index"])


def count_words(text: str) -> int:
    return len(text.split())


def fit_to_budget(df: DataFrame, budget: int, context: str = "context", question: str = "question", response: str = "response", chunks: str | None = "chunks", overhead: int = 37, overhead_asked: int = 41, count: Callable[[str], int] = count_words, rounds: int = 6) -> DataFrame:
    """Adds ``fitted`` (text, spans, truncated): middle chunks are dropped, up to ``rounds`` times, until the prompt's tokens fit.

    Each round drops ``ceil(chunks * (excess + 0.05))`` chunks, one at least; what still doesn't fit is clipped to its head
    and tail. ``count`` gives the tokens of a text; a prompt costs its three texts and an overhead. The loop depends on the
    counter, so it runs in Arrow batches. Without ``chunks`` they are the context's ``sentences``, cut in the same pass.
    """

    def fit(text: str | None, asked: str | None, answer: str | None, spans: list[tuple[int, int]]) -> tuple[str, list[int], list[int], bool]:
        text, cut = text or "", False
        fixed = count(answer or "") + (overhead_asked + count(asked) if (asked or "").strip() else overhead)
        for _ in range(rounds):
            total = fixed + count(text)
            if total <= budget or len(spans) <= 1:
                break
            drop = min(max(1, math.ceil(len(spans) * (1 - budget / total + 0.05))), len(spans) - 1)
            text, spans = without_middle(text, spans, drop)
            cut = True
        if fixed + count(text) > budget and (own := count(text)) > budget:
            keep = max(1, int(len(text) * (budget / own) * 0.45))
            text, cut = text[:keep] + text[-keep:], True
            spans = [(0, len(text))]
        elif fixed + count(text) > budget:
            spans, cut = [(0, len(text))], True
        return text, [x for x, _ in spans], [y for _, y in spans], cut

    def of(contexts: pa.Array, questions: pa.Array, responses: pa.Array, *ends: pa.Array) -> pa.Array:
        texts = contexts.to_pylist()
        spans = [list(zip(s, e, strict=True)) for s, e in zip(*[x.to_pylist() for x in ends], strict=True)] if ends else [sentence_spans(t or "") for t in texts]
        found = list(zip(*map(fit, texts, questions.to_pylist(), responses.to_pylist(), spans), strict=True))
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(found, _FITTED, strict=True)], fields=list(_FITTED))

    @F.arrow_udf("struct<text:string,char_start:array<bigint>,char_end:array<bigint>,truncated:boolean>")
    def fitted(contexts: pa.Array, questions: pa.Array, responses: pa.Array) -> pa.Array:
        return in_slices(of, _FITTED, contexts, questions, responses)

    @F.arrow_udf("struct<text:string,char_start:array<bigint>,char_end:array<bigint>,truncated:boolean>")
    def fitted_chunks(contexts: pa.Array, questions: pa.Array, responses: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        return in_slices(of, _FITTED, contexts, questions, responses, starts, ends)

    texts = [F.col(context), F.col(question), F.col(response)]
    at = lambda field: F.transform(F.col(chunks), lambda c: c[field])
    return df.withColumn("fitted", fitted_chunks(*texts, at("char_start"), at("char_end")) if chunks else fitted(*texts))
