"""SimHash near-duplicates of documents, linked through Golay-code fuzzy hashing.

Fingerprint: a text in which A-Z are lower-cased is cut into words ``[^\\x20\\x09-\\x0D]+`` and shingles of ``width`` words
(repeats count; fewer words give the whole sequence; no word gives fingerprint zero). Bit b of the 64 is 1 if b is set in
more than half the XXH64 hashes (seed 42).

Search: the fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the perfect binary
Golay code (23, 12, 7). At most one segment of two fingerprints that differ in three bits or fewer can hold two or more of
the differing bits, so two segments differ in one bit at most (pigeonhole). Two 23-bit words that differ in one bit share
a key if one gives the codeword it decodes to and the other the codewords its one-bit neighbours decode to: one to six
codeword indices of 12 bits. For each of the three pairs of segments a fingerprint gives a left set (near keys of the
first segment, own key of the second) and a right set (own key of the first, near keys of the second); equal 24-bit keys
are joined and the distance of the whole fingerprints is verified. Nothing within the distance is missed.

Only different fingerprints are joined; copies stay in the table of membership.

Near copies at a similarity (``keep_one_of_each``): three bits of one fingerprint can't reach five-word shingles at Jaccard
0.8, so the distinct shingles are dealt to ``GROUPS`` groups by their hash, and each group votes a fingerprint of two 23-bit
segments of its own. A segment is decoded softly: the codewords that agree best with its votes, each bit weighted by its
majority, are its two nearest indices, and a group gives three keys of 24 bits (both first indices, or one first and one
second). A changed shingle touches its own group only, so texts that differ in fewer shingles than there are groups have an
untouched group (pigeonhole); beyond that the keys are met with high probability, not with certainty. Texts that share a
key are compared by the exact Jaccard similarity of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, fresh, sized, staged, text_or_empty

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
PAIRS = ((0, 1), (0, 2), (1, 2))
GROUPS = 8
SEGMENT = 23
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, generates the (23, 12, 7) Golay code


_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def folded_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def fingerprint(text: str | None, width: int = 3) -> int:
    import xxhash

    words = folded_words(text)
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    counts, step = np.zeros(64, np.int64), 1 << 16
    for at in range(0, n, step):
        hashes = np.fromiter((digest(b" ".join(words[i : i + width]), 42) for i in range(at, min(n, at + step))), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of the shingles, ascending; fewer words give the whole sequence, no word the empty one."""
    import xxhash

    words = folded_words(text)
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)), np.uint64, n))


def group_votes(shingles: np.ndarray) -> np.ndarray:
    """(group, segment, bit) sums of +1 and -1 over each group's shingles; zeros where a group has none."""
    votes = np.zeros((GROUPS, 2 * SEGMENT), np.float64)
    for at in range(0, len(shingles), 1 << 14):
        part = shingles[at : at + (1 << 14)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : 2 * SEGMENT].astype(np.float32) * 2 - 1
        own = (part >> np.uint64(61)).astype(np.int64)[None, :] == np.arange(GROUPS)[:, None]
        votes += own.astype(np.float32) @ bits
    return votes.reshape(GROUPS, 2, SEGMENT)


def codewords() -> np.ndarray:
    """The 4096 codewords by index, as rows of +1 and -1, lowest bit first."""
    words = np.arange(4096) << 11
    words ^= syndromes(words)
    return ((words[:, None] >> np.arange(SEGMENT) & 1) * 2 - 1).astype(np.float32)


def soft_keys(votes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(row, group, 3) keys of ``votes`` (row, group, segment, bit); -1 for an empty group."""
    rows = len(votes)
    agree = votes.reshape(-1, SEGMENT).astype(np.float32) @ codes.T
    first = agree.argmax(axis=1)
    agree[np.arange(len(agree)), first] = -np.inf
    first, second = first.reshape(rows, GROUPS, 2), agree.argmax(axis=1).reshape(rows, GROUPS, 2)
    (a, b), (c, d) = (first[..., 0], first[..., 1]), (second[..., 0], second[..., 1])
    keys = np.stack([a << 12 | b, a << 12 | d, c << 12 | b], axis=2) | (np.arange(GROUPS) << 24)[None, :, None]
    return np.where((votes != 0).any(axis=(2, 3))[..., None], keys, -1)


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def error_patterns() -> np.ndarray:
    """The one error pattern of weight three or less for each of the 2048 syndromes (the code is perfect)."""
    bits = 1 << np.arange(23)
    a, b, c = np.meshgrid(np.r_[0, bits], np.r_[0, bits], np.r_[0, bits])
    errors = np.unique((a | b | c).ravel())
    table = np.zeros(2048, np.int64)
    table[syndromes(errors)] = errors
    return table


def codeword_indices(words: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """Index (the 12 leading bits) of the codeword that each 23-bit word decodes to."""
    return (words ^ errors[syndromes(words)]) >> 11


def near_indices(words: np.ndarray, bits: int, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the distinct codewords that a word and its one-bit neighbours within ``bits`` decode to."""
    flips = np.r_[0, 1 << np.arange(bits)]
    found = np.sort(codeword_indices(words[:, None] ^ flips[None, :], errors), axis=1)
    new = np.c_[np.ones(len(found), bool), found[:, 1:] != found[:, :-1]]
    return np.nonzero(new)[0], found[new]


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            # what follows the text passes through
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), *rest], ["id", "fp", *batch.schema.names[2:]])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    errors = error_patterns()
    for whole in batches:
        for start in range(0, whole.num_rows, 20_000):
            fps = whole.column(0).slice(start, 20_000).to_numpy(zero_copy_only=False)
            words = [(fps.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1) for at, bits in SEGMENTS]
            own = [codeword_indices(w, errors) for w in words]
            near = [near_indices(w, bits, errors) for w, (_, bits) in zip(words, SEGMENTS, strict=True)]
            rows, keys, sides = [], [], []
            for p, (i, j) in enumerate(PAIRS):
                (ri, ki), (rj, kj) = near[i], near[j]
                rows += [ri, rj]
                keys += [p << 24 | ki << 12 | own[j][ri], p << 24 | own[i][rj] << 12 | kj]
                sides += [np.zeros(len(ri), bool), np.ones(len(rj), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int32)), pa.array(np.concatenate(sides)), pa.array(fps[np.concatenate(rows)])], ["key", "right", "fp"])


def fingerprint_links(fingerprints: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct fingerprints (column ``fp``) at ``distance`` (3 or less) or fewer differing bits.

    A hot key is split by Spark's skew join; only verified pairs leave the join.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the scheme covers distances up to three")
    keys = staged(fingerprints.select("fp").mapInArrow(_keys, "key int, right boolean, fp bigint"), "golay-keys")
    left = keys.where(~F.col("right")).select("key", F.col("fp").alias("a"))
    right = keys.where("right").select("key", F.col("fp").alias("b"))
    close = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    met = left.join(right.hint("merge"), (left["key"] == right["key"]) & close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.distinct()


def fingerprint_classes(fps: DataFrame, distance: int) -> DataFrame:
    """``fp`` and ``root`` (a fingerprint that stands for the class) of the distinct fingerprints in ``fps``."""
    distinct = staged(fps.select("fp").distinct(), "distinct-fingerprints")
    roots = components(fingerprint_links(distinct, distance), "a", "b", "fp")
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``fp`` (bigint), ``component_id``.

    ``component_id`` is the least id in the class. Null and empty texts have fingerprint zero and link like any other. A
    null id keeps its row; a class of null ids only has a null component. Rows that repeat stay repeated. An empty table
    gives no rows; further columns are ignored; texts of any length are read whole.
    """
    fps = staged(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(width), "id bigint, fp bigint"), "fingerprints")
    classes = fingerprint_classes(fps, distance)
    # the least id of a fingerprint is found before anything is shuffled by class
    least = fps.groupBy("fp").agg(F.min("id").alias("least")).join(classes, "fp")
    least = least.select("fp", "root", "least").groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _group_keys(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = codewords()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                rows = whole.slice(at, 64)
                votes, sizes = np.zeros((rows.num_rows, GROUPS, 2, SEGMENT)), []
                for k, text in enumerate(rows.column(1)):
                    shingles = shingle_set(text.as_py(), width)
                    votes[k] = group_votes(shingles)
                    sizes.append(len(shingles))
                keys = soft_keys(votes, codes).reshape(rows.num_rows, -1)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int32()), pa.array([k[k >= 0] for k in keys], pa.list_(pa.int64()))], ["dh", "n", "keys"])

    return run


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                rows = whole.slice(at, 256)
                sets = [shingle_set(t.as_py(), width).view(np.int64) for t in rows.column(1)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets, pa.list_(pa.int64()))], ["dh", "hs"])

    return run


def _similar(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose shingles have a Jaccard similarity of ``least`` or more; only texts in a pair are read again."""
    pairs = staged(pairs.distinct(), "pairs")
    members = staged(pairs.select(F.explode(F.array("a", "b")).alias("dh")).distinct(), "members")
    sets = staged(texts.join(sized(members), "dh").select("dh", "text").dropDuplicates(["dh"]).mapInArrow(_shingle_sets(width), "dh bigint, hs array<bigint>"), "shingles")
    both = pairs.join(sets.select(F.col("dh").alias("a"), F.col("hs").alias("ha")), "a").join(sets.select(F.col("dh").alias("b"), F.col("hs").alias("hb")), "b")
    both = both.select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.size(F.array_intersect("ha", "hb")).alias("c"))
    return staged(both.where(F.col("c") >= F.lit(least) * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b"), "similar")


def near_copy_roots(texts: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """``node`` and ``root`` of the texts (``dh`` a hash of the text, ``text``) that have a near copy and aren't the root themselves.

    Each text of a key is first compared with the key's least text. What that joins needs no further comparison: then
    only texts of one key that are still in different classes meet, so a large group of copies never meets itself whole.
    """
    nodes = staged(texts.mapInArrow(_group_keys(width), "dh bigint, n int, keys array<bigint>").dropDuplicates(["dh"]), "golay-groups")
    keys = nodes.select(F.explode("keys").alias("key"), "dh", "n").distinct()
    hubs = staged(keys.groupBy("key").agg(F.min(F.struct("dh", "n")).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "hub"), "hubs")
    shared = staged(keys.join(hubs, "key"), "shared-keys")
    near = lambda x, y: F.least(x, y) >= F.lit(least) * F.greatest(x, y)  # noqa: E731  no similarity is above the ratio of the sizes
    star = shared.where((F.col("hub.dh") != F.col("dh")) & near(F.col("hub.n"), F.col("n"))).select(F.col("hub.dh").alias("a"), F.col("dh").alias("b"))
    links = _similar(star, texts, width, least)
    roots = components(links, "a", "b", "star")
    classed = staged(shared.join(roots, F.col("dh") == F.col("node"), "left").select("key", "dh", "n", F.coalesce("root", "dh").alias("root")), "classed-keys")
    open_keys = classed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    left = classed.join(open_keys, "key")
    right = left.select("key", *[F.col(c).alias(f"{c}2") for c in ("dh", "n", "root")])
    across = left.join(right, "key").where((F.col("root") < F.col("root2")) & near(F.col("n"), F.col("n2")))
    more = _similar(across.select(F.least("dh", "dh2").alias("a"), F.greatest("dh", "dh2").alias("b")), texts, width, least)
    return components(links.unionByName(more), "a", "b", "copies")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each class of near-duplicates, all columns kept, whatever their names.

    Texts link if their sets of ``width``-word shingles have a Jaccard similarity of ``least`` or more; classes are connected
    groups. The row that stays is that of the least id (null ids last) and, within it, the least text hash; of rows that repeat
    both, the first by their other columns. A class never goes without a row: an id that several texts share counts once for
    each text. Null and empty texts are one class. An empty table gives no rows; texts of any length are read whole.
    """
    texts = docs.select(_text_hash(F.col(text_col)).alias("dh"), F.col(text_col).alias("text"))
    roots = near_copy_roots(texts, width, least)
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "dh")
    rows = docs.select(F.col(id_col).alias("id"), _text_hash(F.col(text_col)).alias("dh")).groupBy("id", "dh").agg(F.count(F.lit(1)).alias("n"))
    marked = rows.join(roots, F.col("dh") == F.col("node"), "left").select(F.coalesce("root", "dh").alias("root"), "n", order.alias("me"))
    kept = marked.groupBy("root").agg(F.min("me").alias("kept"))
    id_, dh = fresh(docs, "gone_id"), fresh(docs, "gone_dh")
    judged = staged(marked.join(kept, "root").select((F.col("me") == F.col("kept")).alias("stays"), "n", F.col("me.id").alias(id_), F.col("me.dh").alias(dh)), "judged")
    same = docs[id_col].eqNullSafe(F.col(id_)) & (_text_hash(docs[text_col]) == F.col(dh))
    left = docs.join(sized(judged.where("not stays").select(id_, dh)), same, "left_anti")
    return first_of_repeated(left, sized(judged.where("stays and n > 1").select(id_, dh)), same)


def _text_hash(text) -> Column:
    return F.xxhash64(text_or_empty(text))


def first_of_repeated(docs: DataFrame, repeated: DataFrame, same: Column) -> DataFrame:
    """``docs`` with one row for each entry of ``repeated``; only rows that repeat are shuffled."""
    id_, dh = repeated.columns
    nth = fresh(docs, "nth")
    single = docs.join(repeated, same, "left_anti")
    order = Window.partitionBy(id_, dh).orderBy(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))])
    first = docs.join(repeated, same).withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return single.unionByName(first.drop(nth, id_, dh))
