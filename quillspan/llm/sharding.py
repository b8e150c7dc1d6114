"""Shards cut from a Hilbert curve over document metadata.

Each dimension is quantised at its own quantiles (a fixed number of cells), the cells' place on the Hilbert curve orders
the rows, and the ordered rows are cut into runs of equal count. Rows near on the curve are near in every dimension, so a
file's minimum and maximum of each dimension are close and readers can skip it on a filter of any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ranked, sized, staged


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of points ``cells`` (rows, dimensions), each coordinate of ``bits`` bits.

    Skilling's transform: undo the excess rotations and reflections from the highest bit on, Gray-code the result, and
    interleave the coordinates' bits.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for i in range(n):
            inverted = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0] ^= np.where(inverted, q - 1, swap)
            if i:
                x[i] ^= np.where(inverted, 0, swap)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[i] >> level & 1)
    return index


def ordinal_key(col: Column, kind: str) -> Column:
    """What stands for a value until ``with_string_ranks``: a hash of a string, else the value as a bigint; null comes first."""
    return F.when(col.isNotNull(), F.xxhash64(col)) if kind == "string" else F.coalesce(col.cast("bigint"), F.lit(-(1 << 62)))


def string_ranks(docs: DataFrame, col: str) -> DataFrame:
    """``_h`` (hash) and ``_place`` (gapless, in the order of the whole strings) of the distinct values of ``col``; null isn't one.

    The values are aggregated before they are sorted by range, so a value that most rows hold weighs no more than any other.
    """
    values = docs.where(F.col(col).isNotNull()).groupBy(F.xxhash64(F.col(col)).alias("_h")).agg(F.min(col).alias("_v"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    places, _ = ranked(values.repartitionByRange(parts, "_v").sortWithinPartitions("_v").select("_h"), "string-ranks")
    return staged(places.select("_h", F.col("_rank").cast("bigint").alias("_place")), "string-places")


def _indexer(bounds: list[list[int]], bits: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            # few distinct values spread over all cells, so that their dimension counts on the curve's upper levels too
            cells = np.stack([(np.searchsorted(np.array(b, np.int64), rows.column(n).to_numpy(zero_copy_only=False), side="right") << bits) // (len(b) + 1) for b, n in zip(bounds, names, strict=True)], axis=1)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rows.schema.names), pa.array(hilbert_index(cells, bits))], [*rows.schema.names, "_hilbert"])

    return run


def hilbert_order(df: DataFrame, dimensions: list[str], tie: list[str], bits: int = 5) -> DataFrame:
    """``df`` ordered along the curve over ``dimensions`` (bigint columns without nulls), within and across partitions; adds ``_hilbert``.

    No rows give none; rows that repeat stay. ``tie`` orders rows of one cell, so that a cell with many rows spreads over several partitions. The quantiles (at most
    2**bits - 1 values for each dimension) are all the driver sees.
    """
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(d, F.array(*map(F.lit, cuts)), 2000).alias(d) for d in dimensions]).first()
    bounds = [sorted(set(found[d] or [])) for d in dimensions]
    schema = T.StructType([*df.schema.fields, T.StructField("_hilbert", T.LongType())])
    indexed = df.mapInArrow(_indexer(bounds, bits, dimensions), schema)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["_hilbert", *tie]
    return indexed.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def hilbert_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = ("source", "lang"), bits: int = 5) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``size``, ``text_crc32``, ``shard``, ``slot``, ``hilbert``.

    The curve runs over ``dimensions`` and the size (UTF-8 bytes of the text plus 8; a null text has none). Law: counts of
    the shards differ by one at most; slots run from 0 in each shard without a gap. Strings count whole, by their place
    among the distinct values. Null dimensions sort first, null ids first within a cell; repeated rows each take a place; fewer
    rows than shards leave shards empty, no rows give none; texts of any length are only hashed and measured.
    """
    kinds = dict(docs.dtypes)
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(body).cast("bigint") + 8).alias("size"), F.crc32(body).alias("text_crc32"), *[ordinal_key(F.col(d), kinds[d]).alias(f"_d{i}") for i, d in enumerate(dimensions)])
    for i, d in enumerate(dimensions):
        if kinds[d] == "string":
            places = sized(string_ranks(docs, d))
            rows = rows.join(places, F.col(f"_d{i}") == F.col("_h"), "left").withColumn(f"_d{i}", F.coalesce("_place", F.lit(-1).cast("bigint"))).drop("_h", "_place")
    keyed = staged(rows, "shard-keys")
    ordered = hilbert_order(keyed, [*(f"_d{i}" for i in range(len(dimensions))), "size"], ["id", "text_crc32"], bits)
    places, total = ranked(ordered.select("id", "size", "text_crc32", "_hilbert"), "hilbert")
    each, more = divmod(total.first()["_total"], shards)  # the first ``more`` shards hold one row more
    wide, rank = more * (each + 1), F.col("_rank")
    shard = F.when(rank < wide, F.expr(f"_rank div {each + 1}")).otherwise(F.expr(f"{more} + (_rank - {wide}) div {max(each, 1)}"))
    placed = places.withColumn("shard", shard.cast("int"))
    start = F.col("shard") * F.lit(each).cast("bigint") + F.least(F.col("shard"), F.lit(more))
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (rank - start).cast("bigint").alias("slot"), F.col("_hilbert").alias("hilbert"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", **options) -> None:
    """``docs`` (unique ids, one may be null) as Parquet under ``path/shard=N``, each shard's rows in the order of the curve.

    No rows write no shard; columns may not be named ``shard``, ``_slot`` or ``_id``.
    """
    plan = hilbert_shards(docs, shards, id_col, **options).select(F.col(id_col).alias("_id"), "shard", F.col("slot").alias("_slot"))
    placed = docs.join(plan, docs[id_col].eqNullSafe(F.col("_id"))).drop("_id")
    placed.repartitionByRange(shards, "shard", "_slot").sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(path)
