"""Repeated passages against a count of every window, with the awkward cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillspan.llm.substring_dedup import SuffixAutomaton, least_gram_runs, remove_repeats, shard_repeats

COLUMNS = ("doc_id", "n_words", "n_removed", "kept")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_force(texts, window):
    split = [words_of(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for k, w in enumerate(split):
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def run(spark, table, texts, **kw):
    got = remove_repeats(table(texts), **kw)
    assert set(got.columns) == {*table(texts).columns, "repeats"}
    return sorted(tuple(r) for r in got.select("doc_id", "repeats.n_words", "repeats.n_removed", "repeats.kept").collect())


def near(rng, n, vocabulary, length):
    """Texts that share passages of all lengths around the bound, at other places and with single words changed."""
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(3, length))] for _ in range(8)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = list(rng.choice(passages)) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 20))]
            if p and rng.random() < 0.3:
                p[rng.randrange(len(p))] = "changed"
            words += p
        out.append(rng.choice([" ", "\n", " \t", "\x0b", "\x0c\r"]).join(words))
    return out


@pytest.mark.parametrize(("seed", "window", "gram", "shard"), [(0, 10, 3, 2000), (1, 10, 3, 2), (2, 12, 12, 2000), (3, 12, 1, 5), (4, 35, 8, 2000), (5, 35, 8, 3)])
def test_against_all_windows(spark, table, seed, window, gram, shard):
    rng = random.Random(seed)
    vocabulary = ["a", "b"] if seed == 3 else [f"w{i}" for i in range(30)] + ["Zażółć", "😀", "\x00", "\x1c", " x"]
    texts = near(rng, 60, vocabulary, 4 * window) + [None, "", " \n", "x"]
    texts += [texts[5], texts[5], texts[7] + " tail"]
    assert run(spark, table, texts, window=window, gram=gram, shard=shard) == brute_force(texts, window)


def test_periodic_texts(spark, table):
    texts = ["a " * 9, "a " * 10, "a " * 11, "b c " * 8, "d " * 50 + "e", "only once here"]
    assert run(spark, table, texts, window=10, gram=3) == brute_force(texts, 10)


def test_one_long_text_and_many_copies(spark, table):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [long, long[30_000:32_000]] + ["copy " * 3 + passage] * 30 + [f"{i} {passage} {i * 7}" for i in range(40)]
    for shard in (5, 2000):
        assert run(spark, table, texts, shard=shard) == brute_force(texts, 35)


def test_repeated_ids_and_rows(spark):
    text = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(1, text), (1, text), (None, text + " x"), (2, None)], "doc_id bigint, text string")
    got = sorted(remove_repeats(df).select("doc_id", "repeats.n_removed", "repeats.kept").collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 40, ""), (1, 40, ""), (2, 0, ""), (None, 40, "x")]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "k", "s", "r")], "doc_id bigint, text string, _key string, _spans string, repeats string")
    row = remove_repeats(df).first()
    assert (row._key, row._spans, row.repeats.kept) == ("k", "s", "a b")


def test_empty(spark, table):
    assert run(spark, table, []) == []


@pytest.mark.parametrize("seed", range(30))
def test_automaton(seed):
    rng = random.Random(seed)
    sequences = [([rng.choice("abc") for _ in range(rng.randint(1, 25))], rng.randint(1, 2)) for _ in range(rng.randint(1, 6))]
    times = Counter()
    for words, copies in sequences:
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                times[tuple(words[i:j])] += copies
    automaton = SuffixAutomaton()
    for words, copies in sequences:
        automaton.add(words, copies)
    assert len(automaton.link) <= 2 * sum(len(w) for w, _ in sequences) + 1
    best = automaton.repeated()
    for words, _ in sequences:
        want = [max((n for n in range(1, i + 1) if times[tuple(words[i - n : i])] > 1), default=0) for i in range(1, len(words) + 1)]
        assert list(automaton.matching_statistics(words, best)) == want
    for (words, _), ranges in zip(sequences, shard_repeats(sequences, 4), strict=True):
        assert {i for a, b in ranges for i in range(a, b)} == {i for i in range(len(words) - 3) if times[tuple(words[i : i + 4])] > 1}


def test_runs_hold_every_window_once():
    rng = np.random.default_rng(0)
    lengths = [0, 5, 10, 11, 40, 3, 200]
    ids = rng.integers(0, 20, sum(lengths)).astype(np.uint64)
    gram, text, start, n, places = least_gram_runs(ids, lengths, 10, 3)
    assert all(places >= 1) and list(least_gram_runs(np.zeros(50, np.uint64), [50], 10, 3)[4]) == [41]
    held = Counter((t, s + i) for t, s, k in zip(text, start, n, strict=True) for i in range(k))
    assert held == Counter((t, s) for t, k in enumerate(lengths) for s in range(k - 9))
    # equal windows have equal grams
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    of = {}
    for g, t, s, k in zip(gram, text, start, n, strict=True):
        for i in range(s, s + k):
            of.setdefault(tuple(ids[begin[t] + i : begin[t] + i + 10]), set()).add(g)
    assert all(len(v) == 1 for v in of.values())
