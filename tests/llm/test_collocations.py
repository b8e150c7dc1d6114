"""Phrase collocations against a count of every phrase, with the awkward cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillspan.llm.collocations import SCORE, collocations, tokens
from quillspan.llm.grams import BitFilter, pair_ids

COLUMNS = "lang rank phrase a l r n score".split()


def brute_force(rows, least, top, longest=5, cover=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = {}
    phrases = [p for p, a in f.items() if a >= least and len(p) > 2]
    for p in phrases:
        lang, words = p[0], p[1:]
        inside = lambda q: any(q[1 + i : 1 + i + len(words)] == words for i in range(len(q) - len(words)))
        if any(q[0] == lang and len(q) > len(p) and 100 * f[q] >= cover * f[p] and inside(q) for q in phrases):
            continue
        cuts = [(1000 * f[p] * n[lang] // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -f[p], " ".join(words).encode(), f[lang, *words[:k]], f[lang, *words[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r, 7, "x") for i, r in enumerate(rows)], "doc_id bigint, lang string, text string, a int, phrase string")
    return sorted(tuple(r[c] for c in COLUMNS) for r in collocations(df, **kw).collect())


def texts(rng, n):
    words = ["The", "the", "of", "new", "york", "City", "Zażółć", "a b", "x y", "\x00", "\x1c"]
    return [(rng.choice(["en", "de", None, "und"]), rng.choice([" ", "\t", "  "]).join(rng.choice(words) + rng.choice(["", "", "", ".", "\n", ",", "\x0b"]) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize(("least", "top", "bits"), [(3, 2000, 26), (5, 4, 26), (2, 10, 6)])  # with 64 bits nearly every phrase passes the filter
def test_against_all_phrases(spark, least, top, bits):
    rows = texts(random.Random(least), 60) + [(None, None), ("en", ""), ("en", " \t\n.,"), ("fr", "one two")] + [("en", "New York City. new york city")] * 9
    assert run(spark, rows, least=least, top=top, filter_bits=bits) == brute_force(rows, least, top)


def test_one_very_common_phrase_in_a_long_text(spark):
    rows = [("en", "a b " * 20_000), ("en", "b a b c " * 50)]
    assert run(spark, rows, least=40, top=50) == brute_force(rows, 40, 50)


def test_cover_and_length(spark):
    rows = [("en", "p q r s")] * 8 + [("en", "p q r")] * 2 + [("en", "q")] * 5
    for cover in (70, 80, 90, 100):
        assert run(spark, rows, least=2, top=50, cover=cover, longest=4) == brute_force(rows, 2, 50, 4, cover)


def test_empty_and_rare(spark):
    assert run(spark, [], least=2) == [] == run(spark, [("en", "one two three")], least=2)


@pytest.mark.parametrize(("a", "n", "left", "right"), [(7, 100, 9, 11), (2**40 + 1, 2**50 + 3, 2**41, 2**42), (10**14, 10**17, 10**14 + 1, 10**15), (100, 10**12, 100, 100)])
def test_products_beyond_64_bits(spark, a, n, left, right):
    df = spark.createDataFrame([(a, n, left, right)], "a bigint, n bigint, l bigint, r bigint")
    assert df.selectExpr(f"{SCORE} AS s").first().s == 1000 * a * n // (left * right)


def test_order_counts_and_filter():
    x, y = np.array([5], np.uint64), np.array([9], np.uint64)
    assert pair_ids(x, y) != pair_ids(y, x)
    full = BitFilter(10, np.arange(16), np.full(16, 2**64 - 1, np.uint64))
    assert 12345 in full and 12345 not in BitFilter(10, np.array([], np.int64), np.array([], np.uint64))


def test_tokens():
    assert [t for t in tokens("A b.C\td") if t] == [b"a", b"b", b"\xff", b"c", b"d"] and tokens(None) == []
