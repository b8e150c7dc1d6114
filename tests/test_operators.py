import json
import math
import random
import re
import time
from datetime import datetime

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspan.functions.text import let
from quillspan.operators import audit, chunking, containment, detector, features, lookback, metrics, quantiles, retrieval, runlog, schema, split, tiers, tokens
from quillspan.plans import attention_queries


def sample(spark, **changes):
    row = {"sample_id": "s_train_0", "dataset": "vihallu", "split": "train", "context": "Một hai ba.", "context_id": "0" * 16, "question": "", "response": "hai", "label": "no", "label_original": "no", "evidence": "hai", "evidence_start": 4, "evidence_end": 7, "response_is_generated": True, "meta": "{}"} | changes
    return spark.createDataFrame([tuple(row[c] for c in schema.COLUMNS)], schema.SCHEMA)


def test_validate_accepts_a_good_row(spark):
    schema.validate(sample(spark))


@pytest.mark.parametrize("changes", [{"label": "maybe"}, {"dataset": "other"}, {"split": "all"}, {"response": ""}, {"evidence_start": 0, "evidence_end": -1}, {"evidence_end": 9999}, {"evidence_start": 7, "evidence_end": 7}])
def test_validate_rejects(spark, changes):
    with pytest.raises(ValueError):
        schema.validate(sample(spark, **changes))


def test_validate_columns_repeats_and_empty(spark):
    df = sample(spark)
    for bad in (df.drop("meta"), df.withColumn("more", F.lit(1)), df.limit(0), df.union(df), df.withColumn("evidence_start", F.lit(4.0))):
        with pytest.raises(ValueError):
            schema.validate(bad)


def test_finalise_fills_nulls(spark):
    df = schema.finalise(sample(spark).withColumn("question", F.lit(None).cast("string")).withColumn("extra", F.lit(1)))
    assert df.columns == list(schema.COLUMNS) and df.first().question == ""


def test_count_guards(spark):
    df = sample(spark)
    schema.check_counts(df, {("train", "no"): 1})
    with pytest.raises(ValueError):
        schema.check_counts(df, {("train", "no"): 2})
    lost = sample(spark, evidence="", evidence_start=-1, evidence_end=-1)
    schema.check_misses(df.union(lost))
    with pytest.raises(ValueError):
        schema.check_misses(lost.union(lost))
    with pytest.raises(ValueError):
        schema.check_evidence_rate(df)
    schema.check_evidence_rate(df.union(df).union(df).union(lost).union(lost))


def test_passages_match_plain_containment(spark):
    rng = random.Random(3)
    words = ["ab", "cd", "ef", "gh", "ij"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(40)] + [(99, None), (98, "")]
    passages = [(i, docs[i][1][k : k + n]) for i, (k, n) in enumerate([(0, 40), (3, 30), (5, 25), (2, 60), (1, 4), (7, 12)])]
    got = schema.passages_in(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(passages, "item int, passage string"))
    assert sorted((r.doc_id, r.item) for r in got.collect()) == sorted((d, p) for d, t in docs if t for p, x in passages if x in t)


def test_many_short_passages_meet_texts_in_automata(spark):
    """100,000 of them, in parts, without a nested loop in the plan."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc đ😀") for _ in range(200)) for _ in range(30)] + [None, "", "a b", "x" * 5000 + "y" * 60]
    short = sorted({"".join(rng.choice("abc đ😀") for _ in range(rng.randint(1, 9))) for _ in range(130_000)})[:99_990]
    short += ["", None, "y" * 59, "x" * 50 + "y", "x" * 60 + "z", "a b", "zz", " ", "a" * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    passages = spark.createDataFrame(list(enumerate(short)), "item int, passage string")
    got = schema.passages_in(docs, passages, part_chars=300_000)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted((r.doc_id, r.item) for r in got.collect()) == sorted((d, i) for d, t in enumerate(texts) if t for i, p in enumerate(short) if p and p in t)


def test_patterns_that_share_a_head():
    automaton = containment.build([(1, "abcd"), (2, "abce"), (3, "ab"), (4, "abc"), (5, "d")], head=3)
    assert containment.held_by(automaton, "zabceab", head=3) == {2, 3, 4} and containment.held_by(automaton, "abcd", head=3) == {1, 3, 4, 5}


def plain_sentences(text):
    out, at = [], 0
    for piece in re.split(r"(?<=[.!?])\s+", text):
        if piece.strip():
            s = text.index(piece, at)
            out.append((piece, s, s + len(piece)))
            at = s + len(piece)
    return out or [(text, 0, len(text))]


@pytest.mark.parametrize("text", ["Một. Hai!  Ba?\nBốn 3.14 xong.", " đầu. ", "", "   ", "a.b", "x.　y. "])
def test_sentences(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(chunking.sentences(F.col("t")).alias("c")).first().c
    assert [(c.text, c.char_start, c.char_end) for c in got] == plain_sentences(text) and [c["index"] for c in got] == list(range(len(got)))


def test_short_sentences_join_the_one_before(spark):
    text = "Ngắn. Câu này có năm từ. Ít từ. Một câu khác cũng đủ dài."
    df = spark.createDataFrame([(text,)], "t string").select("t", chunking.sentences(F.col("t")).alias("c"))
    got = df.select(chunking.merge_short(F.col("t"), F.col("c")).alias("m")).first().m
    assert [c.text for c in got] == ["Ngắn.", "Câu này có năm từ. Ít từ.", "Một câu khác cũng đủ dài."]
    assert all(text[c.char_start : c.char_end] == c.text for c in got)
    assert df.select(chunking.merged_sentences(F.col("t")).alias("m")).first().m == got


def test_merging_in_one_pass(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "bb", " ", ". ", "! ", "\n", "?  ", "é", "😀"]) for _ in range(rng.randint(0, 80))) for _ in range(80)] + ["", None, " . ", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.sentences(F.col("t")).alias("c"))
    for n in (1, 2, 4):
        assert df.select(chunking.merge_short(F.col("t"), F.col("c"), n).alias("a"), chunking.merged_sentences(F.col("t"), n).alias("b")).where("not (a <=> b)").count() == 0


def test_model_tokens(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [("Hà Nội là thủ đô. " * 30, "Hỏi gì?", "Đáp"), ("", "", "x"), (None, None, None), ("<|endoftext|>", " ", "😀")]
    df = spark.createDataFrame(rows, "c string, q string, r string").repartition(2)
    library = lambda t: len(tokens.tokenizer(path).encode(t or "", add_special_tokens=False).ids)
    got = df.select("c", "q", "r", tokens.token_count(F.col("c"), path, batch=2).alias("n"), tokens.prompt_length(F.col("c"), F.col("q"), F.col("r"), path).alias("p")).collect()
    for r in got:
        parts = [library(t) for t in (r.c, r.q, r.r)]
        assert (r.n, r.p) == (parts[0], sum(parts) + (41 if parts[1] else 37))
    chunks = df.where("c like 'Hà%'").select(F.col("c").alias("context"), F.col("q").alias("question"), F.col("r").alias("response"), chunking.sentences(F.col("c")).alias("chunks"))
    fitted = chunking.fit_to_budget(chunks, 120, count=tokens.token_counter(path)).first().fitted
    assert fitted.truncated and library(fitted.text) + library("Hỏi gì?") + library("Đáp") + 41 <= 120 and len(fitted.char_start) > 1


@pytest.mark.parametrize("n,windows", [(0, []), (3, [(0, 3)]), (4, [(0, 4)]), (5, [(0, 4), (2, 5)]), (8, [(0, 4), (2, 6), (4, 8)])])
def test_token_windows(spark, n, windows):
    text = "  ".join(f"w{i}" for i in range(n)) + " "
    got = spark.createDataFrame([(text,)], "t string").select(chunking.token_windows(F.col("t"), 4).alias("w")).first().w
    assert [(w.token_start, w.token_end) for w in got] == windows and all(text[w.char_start : w.char_end] == w.text for w in got)


@pytest.mark.parametrize("n,kept", [(0, 5), (2, 3), (3, 2), (99, 1)])
def test_drop_middle(spark, n, kept):
    text = "A a. B b. C c. D d. E e."
    df = spark.createDataFrame([(text,)], "t string").select("t", chunking.sentences(F.col("t")).alias("c"))
    r = df.select(chunking.drop_middle(F.col("t"), F.col("c"), F.lit(n)).alias("r")).first().r
    assert len(r.chunks) == kept and all(r.text[c.char_start : c.char_end] == c.text for c in r.chunks) and [c["index"] for c in r.chunks] == list(range(kept))


def test_fit_to_budget_cuts_sentences_in_the_same_pass(spark):
    texts = ["", "one. two.", *[". ".join(f"s{i} {'w ' * (i % 9)}x" for i in range(n)) for n in range(5, 400, 13)], "w " * 500]
    df = spark.createDataFrame([(t,) for t in texts], "context string").select("context", F.lit("").alias("question"), F.lit("").alias("response"), chunking.sentences(F.col("context")).alias("chunks"))
    apart, inside = chunking.fit_to_budget(df, 120), chunking.fit_to_budget(df, 120, chunks=None)
    assert [r.fitted for r in apart.collect()] == [r.fitted for r in inside.collect()]
    assert inside.select("fitted")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_fit_to_budget(spark):
    text = " ".join(f"Câu số {i} có vài từ." for i in range(60))
    df = spark.createDataFrame([(text, "", "r"), ("ngắn", "", "r"), ("x " * 500, "", "r")], "context string, question string, response string").withColumn("chunks", chunking.sentences(F.col("context")))
    long, short, single = (r.fitted for r in chunking.fit_to_budget(df, 120).collect())
    assert long.truncated and len(long.text.split()) + 38 <= 120 and not short.truncated and single.truncated and len(single.char_start) == 1


def weights(pairs):
    w = [0.0] * 8
    for k, x in pairs:
        w[k] = x
    return w


def ratios(spark, w, i, chunks=((0, 1), (2, 3))):
    arr = lambda xs: F.array(*map(F.lit, xs))
    df = spark.createDataFrame([(w, i)], "w array<double>, i int")
    role = F.struct(arr([0, 1, 2, 3]).alias("context"), arr([0, 1, 2, 3, 4]).alias("prompt"), arr([5, 6, 7]).alias("response"), F.array(*map(arr, chunks)).alias("chunk_tokens"))
    return lookback.lookback(df.withColumn("layout", role), "w", "i").first().ratios


@pytest.mark.parametrize("w,i,self_mean,context,total", [
    ([(k, 0.05) for k in range(4)] + [(5, 0.3)], 0, 0.3, 0.05 / 0.35, 0.04 / 0.34),
    ([(k, 0.02) for k in range(4)] + [(5, 0.1), (6, 0.2), (7, 0.5)], 1, 0.15, 0.02 / 0.17, 0.016 / 0.166),
    ([(k, 0.05) for k in range(4)] + [(4, 0.4), (5, 0.3)], 0, 0.3, 0.05 / 0.35, 0.12 / 0.42),
])
def test_lookback_worked_answers(spark, w, i, self_mean, context, total):
    r = ratios(spark, weights(w), i)
    assert math.isclose(r.self_mean, self_mean) and math.isclose(r.lookback_context, context) and math.isclose(r.lookback_total, total)


def test_per_chunk_is_a_mean_over_tokens(spark):
    r = ratios(spark, weights([(0, 0.3), (1, 0.1), (2, 0.1), (3, 0.1)]), 0, ((0,), (1, 2, 3)))
    assert math.isclose(r.per_chunk[0], 3 * r.per_chunk[1])
    zero = ratios(spark, weights([]), 0)
    assert all(math.isfinite(x) for x in [zero.self_mean, zero.lookback_total, *zero.per_chunk])


def test_prefix_sums_give_the_sums_by_position(spark):
    """Overlapping chunks, gaps, positions beyond the weights, empty chunks, nulls and weights that aren't finite."""
    rng = random.Random(4)
    rows = []
    for bad in (None, float("nan"), float("inf"), "null"):
        w = [rng.random() for _ in range(300)]
        if bad is not None:
            w[150] = None if bad == "null" else bad
        chunks = [list(range(a, a + rng.randint(0, 90))) for a in range(0, 200, 7)] + [[3, 5, 9], [], [298, 299, 300, 301], [150]]
        rows.append((w, list(range(250)), list(range(260)), list(range(260, 300)), 4, chunks))
    df = spark.createDataFrame(rows, "w array<double>, c array<int>, p array<int>, r array<int>, q int, t array<array<int>>")
    args = [F.col(x) for x in "wcprqt"]
    got = df.withColumn("s", lookback.prefix_sums("w")).select(lookback.ratios(*args).alias("a"), let(F.col("s"), lambda s: lookback.ratios(*args, s)).alias("b")).collect()
    for x in got:
        for a, b in zip([*x.a[:5], *x.a.per_chunk], [*x.b[:5], *x.b.per_chunk], strict=True):
            assert b == pytest.approx(a, nan_ok=True)


def test_long_contexts_cost_their_length(spark):
    """20,000 overlapping chunks of 20,000 tokens: 400 million positions if each chunk added up its own."""
    n = 40_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("double")).alias("w"))
    began = time.time()
    got = df.select(let(lookback.prefix_sums("w"), lambda s: F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda a: F.get(s, a + 20_000) - F.get(s, a))).alias("x")).first().x
    assert time.time() - began < 30 and got[7] == sum(range(7, 20_007)) and len(got) == 20_000


@pytest.mark.parametrize("offsets,span,tokens", [([(0, 3), (3, 7), (7, 10), (10, 14)], (3, 10), [1, 2]), ([(0, 5), (5, 10)], (4, 6), [0, 1]), ([(0, 0), (2, 2)], (0, 5), [])])
def test_token_span(spark, offsets, span, tokens):
    df = spark.createDataFrame([(offsets,)], "o array<struct<token_start:int,token_end:int>>")
    assert df.select(lookback.token_span(F.col("o"), F.lit(span[0]), F.lit(span[1])).alias("t")).first().t == tokens


def test_layout_needs_context_and_two_response_tokens(spark):
    df = spark.createDataFrame([([(0, 3), (4, 7), (8, 11), (12, 15)],)], "o array<struct<token_start:int,token_end:int>>")
    chunks = F.array(F.struct(F.lit(0).alias("char_start"), F.lit(7).alias("char_end")))
    make = lambda c, r: df.select(lookback.layout(F.col("o"), (F.lit(c[0]), F.lit(c[1])), (F.lit(r[0]), F.lit(r[1])), chunks).alias("l")).first().l
    good = make((0, 3), (8, 15))
    assert (good.context, good.prompt, good.response, good.queries, good.chunk_tokens) == ([0], [0, 1], [2, 3], [3], [[0]])
    for bad in (((3, 4), (8, 15)), ((0, 3), (12, 15))):
        with pytest.raises(Exception, match="token"):
            make(*bad)


def test_layout_of_long_texts_is_linear(spark, tmp_path):
    n = 200_000
    spark.createDataFrame([(1, 1, "user", "q" * n), (1, 2, "assistant", "r" * n)], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    began = time.time()
    got = attention_queries.token_layout(spark, str(tmp_path)).first()
    assert time.time() - began < 30 and (got.n_context, got.n_prompt, got.first_response, got.n_queries, got.chunk_1, got.chunk_2) == (50_000, 50_000, 50_000, 50_000, 25_000, 25_000)


def test_chunk_features(spark):
    df = spark.createDataFrame([([0.25] * 4,), ([1.0, 0.0, 0.0, 0.0],), ([0.0] * 4,)], "s array<double>")
    even, one, none = (r.f for r in df.select(features.chunk_features(F.col("s")).alias("f")).collect())
    assert math.isclose(even.chunk_entropy, math.log(4)) and even.chunk_gini == 0 and one.chunk_gini == 0.75 and one.top1_top2_gap == 1 and none.chunk_entropy == 0


def test_spread_keeps_both_ends(spark):
    df = spark.range(1025, 2049).select(F.lit("g").alias("g"), F.col("id").alias("n")).orderBy(F.rand(1))
    got = [r.n for r in tiers.spread(df, ["g"], ["n"], 20).orderBy("n").collect()]
    assert len(got) == 20 and got[0] == 1025 and got[-1] == 2048
    assert tiers.spread(df.limit(7), ["g"], ["n"], 20).count() == 7 and tiers.spread(df, ["g"], ["n"], 1).collect()[0].n == 1025


def test_spread_over_repeats_and_nulls(spark):
    values = [None, None, 3, 3, 3, 3, 5, 7, 7, 9, 9, 9, 9, 9, 9, 11]
    rows = [(g, v, i) for g in (None, "a") for i, v in enumerate(values)] + [("few", 1, 0), ("few", None, 1)]
    got = tiers.spread(spark.createDataFrame(rows, "g string, n int, i int").repartition(5), ["g"], ["n", "i"], 4).collect()
    places = [0, 5, 10, 15]
    assert sorted((r.g or "", r.i) for r in got) == sorted([("", i) for i in places] + [("a", i) for i in places] + [("few", 0), ("few", 1)])


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_spread_against_a_sorted_list(spark, n):
    rng = random.Random(n)
    rows = [(g, rng.choice([None, "a", "b", "zz"]), rng.choice([None, 1.5, 2.5]), i) for g, size in (("x", 3000), (None, 400), ("y", 5)) for i in range(size)]
    rng.shuffle(rows)
    got = tiers.spread(spark.createDataFrame(rows, "g string, s string, v double, i int"), ["g"], ["s", "v", "i"], n).collect()
    want = []
    for g in ("x", None, "y"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0, r[3]))
        places = range(len(own)) if len(own) <= n else {len(own) - 1 if i == n - 1 and n > 1 else round(i * (len(own) - 1) / max(n - 1, 1)) for i in range(n)}
        want += [own[p] for p in places]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_spread_of_one_repeated_value(spark):
    """All rows share the first value of the order: no task numbers more than the ranges of wanted places."""
    size = 1_000_000
    df = spark.range(size).select(F.lit("g").alias("g"), F.lit(7).alias("n"), F.col("id").alias("i"))
    got = [r.i for r in tiers.spread(df, ["g"], ["n", "i"], 20).orderBy("i").collect()]
    assert got == [round(k * (size - 1) / 19) for k in range(20)]


@pytest.mark.parametrize("by", [["g"], ["g", "h"], []])
@pytest.mark.parametrize("accuracy", [50, 50_000])
def test_exact_percentiles(spark, by, accuracy):
    """A coarse summary brackets the places widely; the values stay exact."""
    rng = random.Random(accuracy)
    draw = lambda: rng.choice([1.5, 2.0, None, rng.random() * 100, float(rng.randint(0, 5)), rng.lognormvariate(0, 9), -rng.random()])
    rows = [(g, n % 2, draw(), rng.random()) for g, size in (("a", 4000), ("b", 37), (None, 500), ("one", 1), ("same", 0)) for n in range(size)]
    rows += [("same", 1, 7.0, 7.0)] * 3000 + [("none", 0, None, 1.0), ("nothing", 0, None, None), ("two", 1, 1.0, 2.0), ("two", 1, 2.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, h int, x double, y double")
    wanted = {f"x{p * 100:.0f}": ("x", p) for p in (0.0, 0.01, 0.5, 0.9, 0.99, 1.0)} | {"y50": ("y", 0.5), "sum25": (F.col("x") + F.col("y"), 0.25)}
    groups = df.groupBy(*by).agg(*[F.percentile(F.col(c) if isinstance(c, str) else c, F.lit(p)).alias(f"{k}_want") for k, (c, p) in wanted.items()])
    for r in quantiles.join_groups(groups, quantiles.exact_percentiles(df, by, wanted, accuracy), by).collect():
        for k in wanted:
            assert r[k] == (None if r[f"{k}_want"] is None else pytest.approx(r[f"{k}_want"], rel=1e-12)), (r, k)


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert quantiles.exact_percentiles(empty, ["g"], {"m": ("x", 0.5)}).count() == 0
    assert quantiles.exact_percentiles(empty, [], {"m": ("x", 0.5)}).first().m is None


def test_projection_and_exponents_of_the_logged_runs(spark):
    counts = {"vihallu": (6461, 530, 6, 3), "isedsc01": (6188, 17770, 11931, 480), "viwikifc": (20102, 817, 0, 0), "vifactcheck": (705, 3546, 2785, 196)}
    hist = spark.createDataFrame([(c, t, n) for c, ns in counts.items() for t, n in enumerate(ns)], "corpus string, tier int, n_samples bigint")
    cost = spark.createDataFrame([(0, 0.3891), (1, 0.7786), (2, 1.4006), (3, 2.6413)], "tier int, seconds double")
    hours = {r.corpus: r.hours for r in tiers.project_cost(hist, cost).collect()}
    assert all(abs(hours[c] - h) < 0.01 for c, h in {"vihallu": 0.818, "isedsc01": 9.506, "viwikifc": 2.350, "vifactcheck": 2.070}.items())
    assert tiers.unmeasured_tiers(hist, cost.where("tier < 3")).count() == 3


@pytest.mark.parametrize("points,slope", [([(1.0, 1.0), (2.0, 4.0), (3.0, 9.0)], 2.0), ([(1.0, 3.0), (2.0, 6.0)], 1.0), ([(5.0, 5.0)], None)])
def test_scaling_exponent(spark, points, slope):
    df = spark.createDataFrame([(x, y, 0) for x, y in points] + [(9.0, 1.0, 4)], "mean_tokens double, median_ms double, n_truncated int")
    got = tiers.scaling_exponent(df, []).first().exponent
    assert math.isnan(got) if slope is None else math.isclose(got, slope)


@pytest.mark.parametrize("readings,throttled,verdict", [([(1.0, 45.0), (0.88, 78.0)], True, "clock drop with heat"), ([(0.71, 44.0), (0.71, 46.0)], False, "stable"), ([(1.0, 40.0), (1.0, 70.0)], False, "heat only"), ([(1.0, 40.0)], False, "too few readings"), ([(float("nan"), 40.0), (1.0, 41.0), (0.9, 42.0)], True, "clock drop")])
def test_throttling(spark, readings, throttled, verdict):
    df = spark.createDataFrame([("g", i, r, t) for i, (r, t) in enumerate(readings)], "g string, n int, clock_ratio double, temperature_c double")
    r = tiers.throttling(df, ["g"], "n").first()
    assert (r.throttled, r.verdict) == (throttled, verdict)


def test_telemetry(spark):
    rows = spark.createDataFrame([("62, 1440, 1590, 98",), ("[N/A], 1440, 1590, 98",), ("62, 1440",)], "l string").select(tiers.parse_telemetry(F.col("l")).alias("r")).collect()
    assert math.isclose(rows[0].r.clock_ratio, 1440 / 1590) and rows[1].r is None and rows[2].r is None


def labelled(spark, order=None):
    rows = [(f"s{i:04d}", lab, "c", "r") for i, lab in enumerate(["Not_Enough_Information", "Supports", "Refutes"] * 150)]
    random.Random(order).shuffle(rows) if order else None
    return spark.createDataFrame(rows, "sample_id string, label_original string, context string, response string")


def test_draw_is_independent_of_row_order(spark):
    a, b = ([tuple(r) for r in audit.draw(labelled(spark, o)).orderBy("number").select("sample_id", "role").collect()] for o in (None, 5))
    assert a == b and len(a) == 120 and sum(r == "nei" for _, r in a) == 100
    assert any(r == "doi_chung" for _, r in a[:60]) and any(r == "doi_chung" for _, r in a[60:])
    with pytest.raises(ValueError):
        audit.draw(labelled(spark).limit(15))
    assert "label_original" not in audit.blind_sheet(audit.draw(labelled(spark))).columns


@pytest.mark.parametrize("a,b,raw,kappa", [("xyxy", "xyxy", 1.0, 1.0), ("xxxx", "xxxx", 1.0, None), ("xxxxxxxxxy", "xxxxxxxxyx", 0.8, -1 / 9)])
def test_agreement(spark, a, b, raw, kappa):
    r = audit.agreement(spark.createDataFrame(list(zip(a, b)), "a string, b string"), "a", "b").first()
    assert math.isclose(r.raw, raw) and (math.isnan(r.kappa) if kappa is None else math.isclose(r.kappa, kappa, abs_tol=1e-9))


def test_repeated_sheet_row_raises(spark):
    truth = spark.createDataFrame([("s1",), ("s2",)], "sample_id string")
    sheet = spark.createDataFrame([("s1", " Khong ")], "sample_id string, nhan_dinh string")
    got = {r.sample_id: r.answer_x for r in audit.join_annotators(truth, {"x": sheet}).collect()}
    assert got == {"s1": "khong", "s2": None}
    with pytest.raises(Exception, match="repeated id"):
        audit.join_annotators(truth, {"x": sheet.union(sheet)}).collect()


def test_group_split_and_leakage(spark):
    df = spark.range(400).select((F.col("id") % 100).cast("string").alias("context_id"))
    done = split.group_split(df)
    split.check_no_leakage(done)
    assert {r.split for r in done.select("split").distinct().collect()} == {"train", "dev", "test"}
    with pytest.raises(ValueError):
        split.check_no_leakage(spark.createDataFrame([("a", "train"), ("a", "test")], "context_id string, split string"))


def test_bm25_prefers_the_rare_term(spark):
    passages = spark.createDataFrame([(1, "chung chung hiếm"), (2, "chung"), (3, "khác")], "p int, t string")
    got = retrieval.bm25(spark.createDataFrame([(9, "hiếm chung")], "q int, t string"), passages.withColumnRenamed("t", "pt"), "q", "t", "p", "pt").orderBy("rank").collect()
    assert [r.p for r in got] == [1, 2]


def plain_bm25(queries, passages, k, k1=1.5, b=0.75):
    bags = {p: t.lower().split() for p, t in passages}
    n, mean = len(bags), sum(map(len, bags.values())) / max(len(bags), 1)
    idf = lambda t: (lambda d: math.log(1 + (n - d + 0.5) / (d + 0.5)))(sum(t in w for w in bags.values()))
    out = []
    for q, text in queries:
        terms = set(text.lower().split())
        score = {p: round(sum(idf(t) * w.count(t) * (k1 + 1) / (w.count(t) + k1 * (1 - b + b * len(w) / mean)) for t in terms if t in w), 6) for p, w in bags.items() if terms & set(w)}
        out += [(q, p, score[p], i) for i, p in enumerate(sorted(score, key=lambda p: (-score[p], p))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "block"), [(0, 1), (1, 3), (2, 128)])
def test_bm25_against_every_pair(spark, seed, block):
    rng = random.Random(seed)
    words = ["the"] * 12 + ["of"] * 6 + [f"w{i}" for i in range(40)]
    passages = [(p, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for p in rng.sample(range(-50, 200), 80)] + [(900, ""), (901, "THE the"), (902, "the THE")]
    queries = [(q, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for q in range(60)] + [(70, "the"), (71, "absent"), (72, "the of")]
    got = retrieval.bm25(spark.createDataFrame(queries, "q int, t string"), spark.createDataFrame(passages, "p int, pt string"), "q", "t", "p", "pt", k=4, block=block)
    rows = sorted(tuple(r) for r in got.select("q", "p", "score", "rank").collect())
    want = plain_bm25(queries, passages, 4)
    assert [r[:2] + r[3:] for r in rows] == [r[:2] + r[3:] for r in want] and [r[2] for r in rows] == pytest.approx([r[2] for r in want])


def test_bm25_scores_few_blocks(spark):
    """Passages of a rare term: nearly all blocks are proven useless without being scored."""
    passages = [(p, f"the common words of passage and {'rare' + str(p // 5) if p % 100 < 10 else 'x' + str(p)}") for p in range(1000)]
    queries = [(q, f"the words of rare{20 * q}") for q in range(10)]
    index, _ = retrieval.postings(spark.createDataFrame(passages, "p int, pt string"), "p", "pt", block=8)
    asked = spark.createDataFrame([(q, t) for q, text in queries for t in text.split()], "q int, term string")
    left = retrieval.candidate_blocks(asked, index, "q", 3, 6)
    n_blocks = index.select("block").distinct().count()
    assert n_blocks > 100 and left.count() < 0.1 * len(queries) * n_blocks
    # no passage of the block that is left out has the rare term among a query's best
    assert index.groupBy("term").count().where("term = 'the'").first()["count"] == n_blocks  # the hot term is spread over all blocks


def test_bm25_of_nothing(spark):
    empty = spark.createDataFrame([], "p int, pt string")
    asked = spark.createDataFrame([(1, "a")], "q int, t string")
    assert retrieval.bm25(asked, empty, "q", "t", "p", "pt").count() == 0
    assert retrieval.bm25(asked.limit(0), spark.createDataFrame([(1, "a")], "p int, pt string"), "q", "t", "p", "pt").count() == 0


def test_metrics(spark):
    df = spark.createDataFrame([("no", "no"), ("no", "intrinsic"), ("intrinsic", "intrinsic"), ("extrinsic", "no")], "t string, p string")
    r = metrics.classification_metrics(df, "t", "p").first()
    assert r.accuracy == 0.5 and math.isclose(r.f1_no, 0.5) and math.isclose(r.f1_intrinsic, 2 / 3) and r.f1_extrinsic == 0
    ranks = retrieval.ranking_metrics(spark.createDataFrame([(1, 4), (4, 4), (None, 4)], "r int, c int"), "r", "c").first()
    assert math.isclose(ranks.hit_at_1, 1 / 3) and math.isclose(ranks.mrr, 1.25 / 3) and ranks.random_floor == 0.25


def test_meta_profile_counts_absent_keys(spark):
    df = spark.createDataFrame([('{"a":"x","f":true}',), ('{"a":"y","f":false}',), ('{"f":true}',)], "m string")
    assert sorted((r.key, r.value, r.n) for r in metrics.meta_profile(df, "m").collect()) == [("a", "", 1), ("a", "x", 1), ("a", "y", 1)]


def test_run_log(spark, tmp_path):
    path = tmp_path / "deep" / "runs.jsonl"
    with pytest.raises(ValueError):
        runlog.run_record(spark, "r", {}, {}, {"ms_per_sample": 1})
    assert not path.exists() and runlog.read_runs(spark, str(path)).columns == []
    for _ in range(2):
        runlog.append_runs(runlog.run_record(spark, "r", {"dataset": {"name": "vihallu"}}, {"macro_f1": 0.5}, {"ms_per_sample": 1, "peak_vram_mb": 2}), str(path))
    lines = [json.loads(r.value) for r in spark.read.text(str(path)).collect()]
    assert [list(x) for x in lines] == [sorted(("timestamp", "run_name", "git_commit", "config_hash", "config", "metrics", "extra"))] * 2 and lines[0]["metrics"] == {"macro_f1": 0.5}
    assert datetime.fromisoformat(lines[0]["timestamp"]).utcoffset().total_seconds() == 0


def test_head_commit(tmp_path):
    assert runlog.head_commit(tmp_path) == "unknown" or (tmp_path.parents[2] / ".git").exists()
    (tmp_path / ".git" / "refs" / "heads").mkdir(parents=True)
    (tmp_path / "a").mkdir()
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/heads/x\n")
    assert runlog.head_commit(tmp_path / "a") == "unknown"
    (tmp_path / ".git" / "packed-refs").write_text("# pack-refs\n" + "a" * 40 + " refs/heads/x\n")
    assert runlog.head_commit(tmp_path / "a") == "a" * 7
    (tmp_path / ".git" / "refs" / "heads" / "x").write_text("b" * 40 + "\n")
    assert runlog.head_commit(tmp_path / "a") == "b" * 7
    (tmp_path / ".git" / "HEAD").write_text("c" * 40 + "\n")
    assert runlog.head_commit(tmp_path) == "c" * 7


def test_runs_are_read_flat(spark, tmp_path):
    path = tmp_path / "runs.jsonl"
    for _ in range(2):
        runlog.append_runs(runlog.run_record(spark, "r", {"dataset": {"name": "vihallu"}}, {"macro_f1": 0.5}, {"ms_per_sample": 1, "peak_vram_mb": 2}, "abc"), str(path))
    runs = runlog.read_runs(spark, str(path))
    assert runs.count() == 2 and "config.dataset.name" in runs.columns
    assert runlog.export_table(runs, {"config.dataset.name": "vihallu"}, ["run_name", "metrics.ece"]).collect()[0]["metrics.ece"] is None
    assert runlog.export_table(runs, {"nowhere": 1}).count() == 0
    assert runlog.config_hash({"run_name": "a", "x": {"b": 1, "c": 2}}) == runlog.config_hash({"x": {"c": 2, "b": 1}, "run_name": "b"}) != runlog.config_hash({"x": {"c": 3, "b": 1}})


def test_drift_skips_layers_with_nan(spark):
    a = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.5), (1, 1, float("nan")), (2, 1, 0.1)], "t int, layer int, v double")
    b = spark.createDataFrame([(1, 0, 0.6), (2, 0, 0.5), (1, 1, 0.2), (2, 1, 0.9)], "t int, layer int, v double")
    r = {x.layer: x for x in lookback.layer_drift(a.withColumn("k", F.col("t") * 10 + F.col("layer")), b.withColumn("k", F.col("t") * 10 + F.col("layer")), ["k"], "layer", "v").collect()}
    assert r[1].n_nan == 1 and math.isclose(r[0].max_diff, 0.1) and math.isclose(r[1].mean_diff, 0.8)


@pytest.mark.parametrize("kind", ["logistic_regression", "linear_svc", "boosted_trees", "lightgbm"])
def test_detectors_learn_and_keep(spark, tmp_path, kind):
    rng = random.Random(3)
    rows = [([c + rng.gauss(0, 0.2), -c + rng.gauss(0, 0.2)], "abc"[c]) for c in (0, 0, 0, 1, 2) for _ in range(20)]
    df = spark.createDataFrame(rows, "features array<double>, label string")
    model = detector.fit(df, kind=kind, max_iter=10)
    got = detector.predict(model, df)
    assert got.where("predicted = label").count() >= (66 if kind == "linear_svc" else 90)
    detector.save(model, str(tmp_path / kind))
    again = detector.predict(detector.load(str(tmp_path / kind)), df)
    assert [r.predicted for r in again.collect()] == [r.predicted for r in got.collect()]


def test_unknown_detector(spark):
    with pytest.raises(ValueError):
        detector.fit(spark.createDataFrame([([0.0], "a"), ([1.0], "b")], "features array<double>, label string"), kind="forest")


def test_calibration_is_monotone_and_fits(spark):
    rng = random.Random(4)
    rows = [(s, rng.random() < s * s) for s in (rng.random() for _ in range(4000))] + [(None, True), (0.5, None)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    got = detector.calibrated(detector.fit_calibrator(df, "s", "y"), df, "s").collect()
    seen = sorted((r.s, r.calibrated) for r in got if r.s is not None)
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(seen, seen[1:])) and sum(abs(c - s * s) for s, c in seen) / len(seen) < 0.04
    assert [r.calibrated for r in got if r.s is None] == [None]


def noisy_contexts(rng, n):
    """Rows whose features are shared by their context, so that a detector can learn contexts by heart."""
    rows = []
    for c in range(n):
        truth = rng.random() < 0.5
        own = [rng.gauss(0.4 if truth else -0.4, 1)] + [rng.gauss(0, 1) for _ in range(25)]
        rows += [(f"c{c}", "bad" if truth else "good", [x + rng.gauss(0, 0.05) for x in own])] * 3
    return rows


def test_cross_fitted_scores_hold_on_new_contexts(spark):
    rng = random.Random(8)
    kinds = "context_id string, label string, features array<double>"
    train, new = spark.createDataFrame(noisy_contexts(rng, 60), kinds).cache(), spark.createDataFrame(noisy_contexts(rng, 300), kinds)
    folds = detector.out_of_fold(train, "bad", folds=3, max_iter=30)
    rows = folds.collect()
    assert len(rows) == 180 and all(len({r.fold for r in rows if r.context_id == c}) == 1 for c in {r.context_id for r in rows})
    fitted = detector.fit_calibrated(train, "bad", folds=3, max_iter=30)
    # the same isotonic map, but of scores of rows that the detector was fitted on
    seen = detector.predict(fitted.model, train).withColumn("score", F.get("proba", F.lit(fitted.model.stages[0].labels.index("bad")))).withColumn("t", F.col("label") == "bad")
    naive = detector.fit_calibrator(seen, "score", "t")
    held = detector.calibrated(naive, fitted.scores(new), "score", "naive").withColumn("t", F.col("label") == "bad")
    got = detector.brier(held, ["score", "calibrated", "naive"], "t").first()
    assert got.n == 900 and got.brier_calibrated < 0.8 * got.brier_naive and got.brier_calibrated < got.brier_score, got
    with pytest.raises(ValueError, match="no probabilities"):
        detector.out_of_fold(train, "bad", kind="linear_svc", folds=2, max_iter=2)


def test_cross_fitted_rates(spark):
    rows = [("a", 0.15, True), ("a", 0.15, False), ("b", 0.15, True), ("c", 0.15, None), (None, None, True), ("d", 0.95, True), ("e", 1.0, False), ("f", -0.1, True)]
    got = detector.cross_fitted_rates(spark.createDataFrame(rows, "g string, s double, y boolean"), "g", "s", "y", folds=1000).collect()
    by = {(r.g, r.y): r.calibrated for r in got}
    assert len(got) == 8 and by["a", True] == by["a", False] == 1.0 and by["b", True] == 0.5 and by["c", None] == pytest.approx(2 / 3)
    assert by["d", True] == 0.0 and by["e", False] == 1.0 and by["f", True] is None and by[None, True] is None


def test_calibration_bins_and_threshold(spark):
    rows = [(0.1, False)] * 6 + [(0.4, True)] * 2 + [(0.45, False)] * 3 + [(0.9, True)] * 5 + [(1.0, True)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    bins = {r.bin: (r.n, round(r.rate, 6)) for r in detector.calibrate(df, "s", "y", 2).collect()}
    assert bins == {0: (11, round(2 / 11, 6)), 1: (6, 1.0)}

    def cost(t, fp, fn):
        return sum(fp if not y and s >= t else fn if y and s < t else 0 for s, y in rows)

    for fp, fn in ((1, 1), (1, 10), (10, 1)):
        r = detector.cost_threshold(df, "s", "y", fp, fn, 20).collect()[0]
        assert r.cost == min(cost(i / 20, fp, fn) for i in range(21)) == cost(r.threshold, fp, fn)
