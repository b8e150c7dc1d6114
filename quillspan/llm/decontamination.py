"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

Texts become lower-cased words (runs of letters and digits), hashed one by one. A mask such as 11101 slides over the words
and hashes those under its ones, so a substituted word under a zero leaves the key as it was. Keys of documents are joined
with keys of test items; every hit fixes a diagonal (the item laid on the document), and every window of the item on it that
holds a hit (``window`` words, the whole item if shorter) is compared word by word: ``similarity`` of a window's words must be
equal. Where a fifth of the words may differ, a window of 8 to 20 words keeps four neighbours or the pattern 11101, items of
7 words too, and those of 5 and 6 words one of two further masks: no window of similarity 0.8 is missed. Items of fewer words
must occur whole; items below ``least_words`` are no passages.

Equal items are one class, known by the least item id. Only keys and numbers are joined; the words of a document are hashed
again where there was a hit. Keys of the test side are broadcast only if they are few enough; otherwise both sides are
shuffled by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import let

from .common import fresh, sized, staged, text_or_empty

MASKS = ("1111", "11101")
SHORT_MASKS = ("11011", "10111")  # for items of five and six words
TINY_MASKS = ("111", "11", "1")  # for items of three, two and one
BROADCAST_KEYS = 1_000_000  # rows of three bigints: 40 MB
BROADCAST_WORDS = 4_000_000  # bigints in the items' arrays: 32 MB


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masked_keys(h: Column, at: Column, masks: tuple[str, ...]) -> Column:
    """Keys of the masks laid on the words from ``at`` on; null where a mask passes the end."""
    keys = []
    for mask in masks:
        held = [F.get(h, at + k) for k, bit in enumerate(mask) if bit == "1"]
        keys.append(F.when(at + len(mask) <= F.size(h), F.xxhash64(F.lit(mask), *held)))
    return F.array(*keys)


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """Classes of equal items: ``key_of`` (a number of the class), ``item`` (least id), ``bh`` (word hashes)."""
    hashed = benchmark.select(F.col(id_col).alias("item"), word_hashes(text_or_empty(text_col)).alias("bh")).where(F.size("bh") >= least_words)
    classes = hashed.groupBy("bh").agg(F.min("item").alias("item"))
    return staged(classes.select(F.monotonically_increasing_id().alias("key_of"), "item", "bh"), "benchmark-items")


def masks_for(items: DataFrame) -> tuple[str, ...]:
    """The masks that the items' lengths call for."""
    lengths = {r[0] for r in items.select(F.least(F.size("bh"), F.lit(7))).distinct().collect()}
    return MASKS + (SHORT_MASKS if lengths & {5, 6} else ()) + tuple(m for m in TINY_MASKS if len(m) in lengths)


def word_keys(rows: DataFrame, h: str, at: str, masks: tuple[str, ...], *kept: str) -> DataFrame:
    starts = rows.where(F.size(h) > 0).select(*kept, h, F.explode(F.sequence(F.lit(0), F.size(h) - 1)).alias(at))
    return starts.select(*kept, at, F.explode(masked_keys(F.col(h), F.col(at), masks)).alias("key")).where(F.col("key").isNotNull())


def windows_equal(h: Column, bh: Column, diagonal: Column, first: Column, last: Column, width: Column) -> Column:
    """Of the item's windows that start at ``first`` to ``last``: the greatest (equal words, - start) as an array of two."""
    equal = lambda k: F.coalesce((F.get(h, diagonal + k) == F.get(bh, k)).cast("int"), F.lit(0))
    score = lambda s: F.aggregate(F.sequence(s, s + width - 1), F.lit(0), lambda n, k: n + equal(k))
    return F.array_max(F.transform(F.sequence(first, last), lambda s: F.array(score(s), -s)))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 20, similarity: float = 0.8, least_words: int = 3) -> DataFrame:
    """Verified overlaps, one row for each document and class of items: ``id``, ``dh``, ``item``, ``matched``, ``compared``, ``at`` (first word).

    ``matched`` of ``compared`` words are equal in the best window. ``dh`` is the hash of the text; rows that repeat id and
    text are one document. Null ids are ids like any other, of documents and of items. Null and empty texts and items, and
    items below ``least_words``, have no overlaps. Texts and items of any length are searched whole.
    """
    items = benchmark_items(benchmark, item_id, item_text, least_words)
    masks = masks_for(items)
    keys = staged(word_keys(items, "bh", "j", masks, "key_of"), "benchmark-keys")
    n_keys, n_words = keys.count(), items.agg(F.coalesce(F.sum(F.size("bh")), F.lit(0))).first()[0]
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("dh"), word_hashes(text).alias("h"))
    hits = word_keys(rows, "h", "i", masks, "id", "dh").join(F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys, "key")
    diagonals = hits.groupBy("id", "dh", "key_of", (F.col("i") - F.col("j")).alias("d")).agg(F.min("j").alias("from"), F.max("j").alias("to"))
    spots = staged(diagonals, "diagonals")
    # the words again, of documents with a hit only
    ends = [F.col(c).alias(f"_{c}") for c in ("id", "dh")]
    wanted = staged(spots.select(*ends).distinct(), "hit-documents")
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    hit = texts.join(sized(wanted), F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_dh")), "left_semi")
    words = hit.select("id", F.xxhash64("text").alias("dh"), word_hashes(F.col("text")).alias("h")).dropDuplicates(["id", "dh"])
    met = spots.select(*ends, "key_of", "d", "from", "to").join(words, F.col("id").eqNullSafe(F.col("_id")) & (F.col("dh") == F.col("_dh")))
    met = met.join(F.broadcast(items) if n_words <= BROADCAST_WORDS else items, "key_of")
    # a window that holds a hit holds the mask's first word and the two after it at least, if there are as many
    met = met.select("id", "dh", "key_of", "item", "h", "bh", "d", "from", "to", F.least(F.size("bh"), F.lit(window)).alias("compared"))
    first, last = F.greatest(F.col("from") - F.col("compared") + 1, F.lit(0)), F.least(F.col("to"), F.size("bh") - F.col("compared"))
    best = let(F.col("h"), lambda h: let(F.col("bh"), lambda bh: windows_equal(h, bh, F.col("d"), F.least(first, last), last, F.col("compared"))))
    scored = met.select("id", "dh", "key_of", "item", "d", "compared", best.alias("best"))
    found = scored.select("id", "dh", "key_of", "item", "compared", F.col("best")[0].alias("matched"), (F.col("d") - F.col("best")[1]).alias("at")).where(F.col("matched") >= F.ceil(F.col("compared") * similarity - 1e-9))
    found = found.groupBy("id", "dh", "key_of").agg(F.first("item").alias("item"), F.max(F.struct("matched", "compared", (-F.col("at")).alias("at"))).alias("best"))
    return found.select("id", "dh", "item", F.col("best.matched").cast("bigint").alias("matched"), F.col("best.compared").cast("bigint").alias("compared"), F.greatest(-F.col("best.at"), F.lit(0)).cast("bigint").alias("at"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` without an overlap, all columns kept, whatever their names; rows with null and empty texts stay."""
    id_, dh = fresh(docs, "bad_id"), fresh(docs, "bad_dh")
    bad = staged(overlaps(docs, benchmark, id_col, text_col, **options).select(F.col("id").alias(id_), F.col("dh").alias(dh)).distinct(), "contaminated")
    same = docs[id_col].eqNullSafe(F.col(id_)) & (F.xxhash64(text_or_empty(docs[text_col])) == F.col(dh))
    return docs.join(sized(bad), same, "left_anti")
