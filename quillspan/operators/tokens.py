"""Token counts by a model's own tokenizer, read from its vocabulary file on every executor."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.operators.tiers import prompt_tokens

BATCH = 512  # texts that the library encodes together
_HELD: dict = {}  # a worker keeps what it has read


def tokenizer(path: str):
    if path not in _HELD:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _HELD[path] = tok
    return _HELD[path]


def token_counter(path: str) -> Callable[[str], int]:
    """Counts the tokens of one text, for ``chunking.fit_to_budget``."""
    return lambda text: len(tokenizer(path).encode(text, add_special_tokens=False).ids)


def token_count(text: Column, path: str, batch: int = BATCH) -> Column:
    """Tokens of a text without special ones, in batches of ``batch``; a null text has none."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        tok, out = tokenizer(path), []
        for i in range(0, len(texts), batch):
            out += [len(e.ids) for e in tok.encode_batch_fast([t or "" for t in texts[i : i + batch].to_pylist()], add_special_tokens=False)]
        return pa.array(out, pa.int64())

    return count(text)


def prompt_length(context: Column, question: Column, response: Column, path: str) -> Column:
    """Tokens of a rendered prompt: those of its parts and of the template around them."""
    return prompt_tokens(*[token_count(c, path) for c in (context, question, response)])
