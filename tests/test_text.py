import hashlib
import json
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as T


def one(spark, rows, schema, **cols):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()


def test_context_id_ignores_composition_and_outer_space(spark):
    a = "Hà Nội là thủ đô."
    rows = one(spark, [(a,), (unicodedata.normalize("NFD", a),), (f" \n{a} ",)], "t string", i=T.context_id(F.col("t")))
    assert {r.i for r in rows} == {hashlib.sha256(a.encode()).hexdigest()[:16]}


def test_words_follow_unicode_space(spark):
    texts = ["a b　c", "\x1c a b ", "", "   "]
    rows = one(spark, [(t,) for t in texts], "t string", n=T.word_count(F.col("t")))
    assert [r.n for r in rows] == [len(t.split()) for t in texts]


@pytest.mark.parametrize("context,evidence,span", [("Một. Hai ba. Bốn.", "Hai ba.", (5, 12)), ("😀 ab", "ab", (2, 4)), ("Hà Nội", "Ha Noi", (-1, -1)), ("a\n\nb", "\n\n", (-1, -1)), ("a", "", (-1, -1)), ("a", None, (-1, -1)), (None, "a", (-1, -1))])
def test_find_evidence(spark, context, evidence, span):
    start, end = T.find_evidence(F.col("c"), F.col("e"))
    assert tuple(one(spark, [(context, evidence)], "c string, e string", s=start, e=end)[0]) == span


@pytest.mark.parametrize("text,has", [("đường", True), ("Straße ø æ", False), ("plain", False), ("été", True), ("x́", False), (None, False)])
def test_has_diacritics(spark, text, has):
    assert one(spark, [(text,)], "t string", h=T.has_diacritics(F.col("t")))[0].h is has


@pytest.mark.parametrize("prompt,context,kind", [("thu do", "thủ đô", "noisy"), ("ABC 1", "DEF", "unknown"), ("thủ", "đô", "unknown")])
def test_prompt_type(spark, prompt, context, kind):
    assert one(spark, [(prompt, context)], "p string, c string", k=T.prompt_type(F.col("p"), F.col("c")))[0].k == kind


@pytest.mark.parametrize("n,tier", [(1, 0), (512, 0), (513, 1), (1024, 1), (1025, 2), (2048, 2), (2049, 3), (4096, 3), (6622, 3)])
def test_tiers(spark, n, tier):
    assert one(spark, [(n,)], "n int", t=T.tier_of(F.col("n")))[0].t == tier


@pytest.mark.parametrize("seconds,text", [(0.0, "0 giờ 00 phút"), (90.0, "0 giờ 01 phút"), (3600.0, "1 giờ 00 phút"), (7380.0, "2 giờ 03 phút")])
def test_duration(spark, seconds, text):
    assert one(spark, [(seconds,)], "s double", d=T.format_duration(F.col("s")))[0].d == text


@pytest.mark.parametrize("raw,clean", [(" NGOAI LAI", "ngoai_lai"), ("noi-tai", "noi_tai"), ("NaN", ""), (None, ""), ("khac", "khac")])
def test_normalise_answer(spark, raw, clean):
    assert one(spark, [(raw,)], "a string", a=T.normalise_answer(F.col("a")))[0].a == clean


def test_kappa_bands_have_exclusive_upper_bounds(spark):
    rows = one(spark, [(float("nan"),), (-0.1,), (0.0,), (0.2,), (0.8,), (1.0,)], "k double", b=T.describe_kappa(F.col("k")))
    assert [r.b for r in rows] == [T.KAPPA_NONE, "tệ hơn ngẫu nhiên", "rất thấp", "thấp", T.KAPPA_TOP, T.KAPPA_TOP]


def test_prompt_spans(spark):
    r = one(spark, [("ctx", "", "ctx")], "c string, q string, r string", p=T.render_prompt(F.col("c"), F.col("q"), F.col("r")))[0].p
    assert r.text[r.context_start : r.context_end] == "ctx" and r.text[r.response_start : r.response_end] == "ctx"
    assert r.response_end == len(r.text) and T.QUESTION_HEADER not in r.text


def test_meta_is_sorted_and_keeps_nulls(spark):
    assert one(spark, [("é", None)], "b string, a string", m=T.json_meta({"b": F.col("b"), "a": F.col("a")}))[0].m == json.dumps({"a": None, "b": "é"}, ensure_ascii=False, sort_keys=True)


def test_clip_text_keeps_head_and_tail(spark):
    assert one(spark, [("abcdefghij" * 10, 20)], "t string, n int", c=T.clip_text(F.col("t"), F.col("n"), 10))[0].c == ("abcdefghij" * 3)[:22] + ("abcdefghij" * 10)[-22:]


def test_meta_escapes_as_json_dumps(spark):
    texts = ["".join(map(chr, range(1, 0x90))), "\\u001F", "\\\x1f", "\x1f\x1f\x0b", "\\\\u000B\\\x0e", 'a"b', "Hà Nội 😀\u2028", "", "\x7f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    for r in df.select("i", "t", T.json_meta({"b": F.col("t"), "a": F.col("i")}).alias("m")).collect():
        assert r.m == json.dumps({"a": r.i, "b": r.t}, ensure_ascii=False, sort_keys=True)


def test_composition_sends_only_what_may_change_to_python(spark):
    """Every letter behind and before another: Python's composition, whether or not the text was sent there."""
    texts = [f"e{chr(c)}́ {chr(c)}" for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000] + ["각", "각", "plain", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(T.nfc(F.col("t")).alias("n")).collect()] == [t if t is None else unicodedata.normalize("NFC", t) for t in texts]
    known = set(T.uncomposed_letters())
    safe = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and chr(c) not in known]
    assert all(unicodedata.is_normalized("NFC", f"e{c}{d}") for c, d in zip(safe, safe[1:])) and {"ế", "Đ", "漢"} <= set(safe)
    assert df.where(T.composed(F.when(F.col("t").rlike(T._uncomposed()), F.col("t"))).isNotNull() & F.col("t").isin("plain", "")).count() == 0


def test_batches_become_python_objects_in_slices():
    sizes = []
    got = T.in_slices(lambda own: sizes.append(len(own)) or own, pa.string(), pa.array([str(i) for i in range(1000)]))
    assert got.to_pylist() == [str(i) for i in range(1000)] and max(sizes) <= T.SLICE and len(T.in_slices(None, pa.string(), pa.array([], pa.string()))) == 0
