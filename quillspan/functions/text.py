"""Text expressions: Unicode-aware trimming and words, context ids, evidence spans, diacritics, prompts, tiers."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Java's class of the 29 characters that Python's str.isspace accepts.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"

# The wording of the prompt and of the answer sheet.
CONTEXT_HEADER = "Ngữ cảnh:\n"
QUESTION_HEADER = "\n\nCâu hỏi: "
SYSTEM_PROMPT = "Bạn là trợ lý trả lời câu hỏi dựa trên ngữ cảnh được cung cấp."
ANSWER_CODES = ("ngoai_lai", "noi_tai", "khong", "khong_chac")
KAPPA_BANDS = ((0.0, "tệ hơn ngẫu nhiên"), (0.20, "rất thấp"), (0.40, "thấp"), (0.60, "trung bình"), (0.80, "cao"))
KAPPA_TOP = "rất cao"
KAPPA_NONE = "không tính được (hai người dùng chung đúng một đáp án)"
TIER_BOUNDS = (512, 1024, 2048, 4096)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a variable that holds ``value``: it is computed once, where a lambda that names it would compute it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


SLICE = 256  # rows of an Arrow batch that are Python objects at once


def in_slices(of: Callable[..., pa.Array], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``of`` over slices of ``SLICE`` rows: a batch may hold tens of MB of text, several times that as Python objects."""
    parts = [of(*[c.slice(i, SLICE) for c in columns]) for i in range(0, len(columns[0]), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def uncomposed_letters() -> list[str]:
    """What composition may change or combine: combining marks, letters with another composed form, and seconds of a composed pair.

    None lies below U+0300 or, by Unicode's stability rules, above U+2FFFF. A text without any of them is composed.
    """
    found = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # vowels and finals of Hangul, composed by rule
    for c in range(0x300, 0x30000):
        letter, parts = chr(c), unicodedata.decomposition(chr(c)).split()
        if unicodedata.combining(letter) or not unicodedata.is_normalized("NFC", letter):
            found.add(c)
        if len(parts) == 2 and parts[0][0] != "<":
            found.add(int(parts[1], 16))
    return [chr(c) for c in sorted(found)]


@cache
def _uncomposed() -> str:
    """A regex for one of ``uncomposed_letters``, by blocks of letters, so that most characters are told by their block."""
    letters, blocks = uncomposed_letters(), []
    for i in range(0, len(letters), 128):
        own = letters[i : i + 128]
        blocks.append(r"[\x{%04X}-\x{%04X}&&[%s]]" % (ord(own[0]), ord(own[-1]), letter_ranges(own, r"\x{%04X}")))
    return r"[\x{0300}-\x{2FFFF}&&[" + "".join(blocks) + "]]"


@F.arrow_udf(StringType())
def composed(texts: pa.Array) -> pa.Array:
    """Unicode composition; Spark has no function for it."""
    return in_slices(lambda own: pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in own.to_pylist()], pa.string()), pa.string(), texts)


def nfc(c: Column) -> Column:
    """Unicode composition. Only texts with a letter that it may change go to Python, the rest pass as they are."""
    return F.coalesce(composed(F.when(c.rlike(_uncomposed()), c)), c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(rf"[^\s\x0B\x1C-\x1F\x85\p{{Z}}]")


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, f"{SPACE}+"), "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("bigint")


def context_id_of_nfc(composed: Column) -> Column:
    return F.substring(F.sha2(strip(composed), 256), 1, 16)


def context_id(c: Column) -> Column:
    """First 16 hex digits of SHA-256 over the composed, stripped text."""
    return context_id_of_nfc(nfc(c))


def sample_id(dataset: Column, split: Column, index: Column) -> Column:
    return F.concat_ws("_", dataset, split, index.cast("string"))


def lower_escapes(json_text: Column) -> Column:
    r"""``\u001F`` as ``\u001f`` where it is an escape, so not behind a backslash that is text itself."""
    out = json_text
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*\\u00){code:02X}", f"$1{code:02x}")
    return F.when(json_text.rlike(r"\\u00(?:0[BEF]|1[A-F])"), out).otherwise(json_text)


def json_meta(fields: dict[str, Column]) -> Column:
    """A JSON object with sorted keys, ``", "`` and ``": "`` between its parts and letters unescaped; nulls are kept, hex digits of escapes are lower-case."""
    whole = lambda k: F.to_json(F.struct(fields[k].alias("v")), {"ignoreNullFields": "false"})  # noqa: E731  {"v":...}
    parts = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ": "), F.substring(whole(k), F.lit(6), F.length(whole(k)) - 6)) for k in sorted(fields)]
    return F.concat(F.lit("{"), lower_escapes(F.concat_ws(", ", *parts)), F.lit("}"))


def find_evidence(context: Column, evidence: Column) -> tuple[Column, Column]:
    """Code point span of the first exact match; (-1, -1) if there is none or the evidence is blank."""
    at = F.when(is_blank(evidence), F.lit(0)).otherwise(F.coalesce(F.instr(context, evidence), F.lit(0)))
    start = (at - 1).cast("bigint")
    return start, F.when(start >= 0, start + F.length(evidence)).otherwise(F.lit(-1)).cast("bigint")


def diacritic_letters() -> list[str]:
    """Đ, đ, and every composed letter that decomposes to an ASCII letter with marks."""
    found = [chr(0x110), chr(0x111)]
    for c in range(0x80, 0x3000):
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and parts[0].isascii() and parts[0].isalpha():
            found.append(chr(c))
    return found


def letter_ranges(letters: list[str], form: str) -> str:
    """A regex class body of the letters' code points; ``form`` writes one, such as ``\\x{%04X}``."""
    points, out = sorted(map(ord, letters)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(form % a if a == b else f"{form % a}-{form % b}" for a, b in out)


def has_diacritics_nfc(composed: Column) -> Column:
    return F.coalesce(composed.rlike("[" + letter_ranges(diacritic_letters(), r"\x{%04X}") + "]"), F.lit(False))


def has_diacritics(c: Column) -> Column:
    return has_diacritics_nfc(nfc(c))


def prompt_type(prompt: Column, context: Column) -> Column:
    """``noisy`` if the prompt lost the diacritics its context has, else ``unknown``."""
    return F.when(~has_diacritics(prompt) & has_diacritics(context), "noisy").otherwise("unknown")


def evidence_given(evidence: Column) -> Column:
    return ~is_blank(evidence)


def normalise_answer(c: Column) -> Column:
    """An annotator's cell in canonical form; blank, ``nan`` and ``none`` become empty, unknown text passes."""
    text = F.translate(F.lower(strip(F.coalesce(c, F.lit("")))), " -", "__")
    return F.when(text.isin("", "nan", "none"), "").otherwise(text)


def describe_kappa(kappa: Column) -> Column:
    out = F.when(kappa.isNull() | F.isnan(kappa), KAPPA_NONE)
    for bound, wording in KAPPA_BANDS:
        out = out.when(kappa < bound, wording)
    return out.otherwise(KAPPA_TOP)


def tier_of(n: Column, bounds: tuple[int, ...] = TIER_BOUNDS) -> Column:
    """Index of the first bound that holds ``n``; what exceeds all is in the last tier."""
    out = F.when(n <= bounds[0], 0)
    for i, b in enumerate(bounds[1:-1], 1):
        out = out.when(n <= b, i)
    return out.otherwise(len(bounds) - 1).cast("int")


def tier_label(tier: Column, bounds: tuple[int, ...] = TIER_BOUNDS) -> Column:
    out = None
    for i, b in enumerate(bounds):
        text = f"{bounds[i - 1] + 1 if i else 0}–{b}"
        out = F.when(tier == i, text) if out is None else out.when(tier == i, text)
    return out


def format_duration(seconds: Column) -> Column:
    """``H giờ MM phút`` of the seconds rounded half to even."""
    whole = F.rint(seconds).cast("bigint")
    hours, minutes = F.floor(whole / 3600).cast("bigint"), F.floor((whole % 3600) / 60).cast("bigint")
    return F.concat(hours.cast("string"), F.lit(" giờ "), F.lpad(minutes.cast("string"), 2, "0"), F.lit(" phút"))


def user_turn(context: Column, question: Column) -> Column:
    asked = F.when(is_blank(question), "").otherwise(F.concat(F.lit(QUESTION_HEADER), strip(question)))
    return F.concat(F.lit(CONTEXT_HEADER), context, asked)


def render_prompt(context: Column, question: Column, response: Column, template: tuple[str, str, str] = ("<|system|>\n", "\n<|user|>\n", "\n<|assistant|>\n")) -> Column:
    """Struct of the rendered text and the spans of context (first match) and response (last match); a miss raises.

    ``template`` are the marks before the three messages.
    """
    text = F.concat(F.lit(template[0] + SYSTEM_PROMPT + template[1]), user_turn(context, question), F.lit(template[2]), response)
    first = F.instr(text, context) - 1
    last = F.when(F.length(response) == 0, F.length(text)).otherwise(F.length(text) - F.instr(F.reverse(text), F.reverse(response)) - F.length(response) + 1)
    last = F.when(last >= first, last).otherwise(F.raise_error(F.lit("response not found after the context")).cast("int"))
    return F.struct(text.alias("text"), first.cast("bigint").alias("context_start"), (first + F.length(context)).cast("bigint").alias("context_end"), last.cast("bigint").alias("response_start"), (last + F.length(response)).cast("bigint").alias("response_end"))


def clip_text(c: Column, n_tokens: Column, budget: int) -> Column:
    """Head and tail of a text over the token budget: each ``length * budget / tokens * 0.45`` characters, one at least."""
    keep = F.greatest(F.lit(1), F.floor(F.length(c) * (F.lit(float(budget)) / n_tokens) * 0.45).cast("int"))
    return F.when(n_tokens <= budget, c).otherwise(F.concat(F.substring(c, F.lit(1), keep), F.right(c, keep)))


def clock_ratio(now: Column, most: Column) -> Column:
    return F.when(most != 0, now / most).otherwise(F.lit(float("nan")))


def lexical_overlap(response: Column, context: Column) -> Column:
    """Share of the response's words (case folded, repeats counted) that occur in the context; 0 without words."""
    share = lambda r, c: F.when(F.size(r) == 0, F.lit(0.0)).otherwise(F.size(F.filter(r, lambda w: F.array_contains(c, w))) / F.size(r))
    return let(words(F.lower(response)), lambda r: let(F.array_distinct(words(F.lower(context))), lambda c: share(r, c)))
