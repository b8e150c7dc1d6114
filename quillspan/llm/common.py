"""What the training-data operators share: staged tables, exact ranks and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROW_BITS = 33  # monotonically_increasing_id keeps the row's number in a partition in the low 33 bits
BROADCAST_ROWS = 500_000  # of (bigint, bigint) rows: 16 MB
_STAGED: list[tuple[SparkSession, str, DataFrame]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where the session names none, a temporary folder is used in local mode only, whose one process is driver and executor;
    on a cluster that is an error, since executors can't see the driver's disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="quillspan-")
    sc.setCheckpointDir(own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_staged() -> None:
    for spark, path, _ in _STAGED:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the cluster's own cleaning is left
            return


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    It cuts lineage: after a lost executor only the reading tasks run again, and values such as row numbers
    that depend on how rows were dealt stay as they were first written. The folder goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/quillspan-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED.append((spark, path, out))
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more, so that their disk is free before the session ends."""
    for entry in [e for e in _STAGED if any(e[2] is t for t in tables)]:
        _delete(*entry[:2])
        _STAGED.remove(entry)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row_key(df: DataFrame, name: str = "_rid") -> DataFrame:
    return df.withColumn(name, F.monotonically_increasing_id())


def ranked(sorted_df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Exact gapless ranks ``_rank`` from 0 of rows already ordered within and across partitions.

    The rows are written once with their partition's and their own number; the counts of the partitions, one row for
    each partition and so bounded by the number of tasks, give the offsets. Returns the ranked rows and a one-row table
    ``_total``. No task ever holds more than its own partition.
    """
    mid = F.monotonically_increasing_id()
    rows = staged(sorted_df.withColumn("_pid", F.shiftright(mid, _ROW_BITS)).withColumn("_row", mid.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))), name)
    parts = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    base = parts.withColumn("_base", F.sum("_c").over(Window.orderBy("_pid")) - F.col("_c")).select("_pid", "_base")
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    return rows.join(F.broadcast(base), "_pid").withColumn("_rank", F.col("_base") + F.col("_row")).drop("_pid", "_row", "_base"), total


def components(links: DataFrame, a: str, b: str, name: str = "links") -> DataFrame:
    """Connected components of ``links`` (two bigint columns) as rows ``node``, ``root`` (the least node reachable).

    Alternating large-star and small-star rounds; every round is a join and an aggregation by node and is written to
    the shared folder, so nothing is collected and chains of any length converge in a logarithmic number of rounds.
    Neither nodes without a link nor the roots themselves are returned. No links give no rows. It raises if the rounds don't
    end, rather than return groups that aren't whole.
    """
    u, v = F.col("u"), F.col("v")
    edges = staged(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(u != v).distinct(), f"{name}-0")
    mark = None
    for turn in range(1, 200):
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), u).alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(v.alias("u"), F.col("m").alias("v")), F.struct(u.alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where(u != v).distinct()
        edges = staged(small, f"{name}-{turn}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components didn't converge")
    return edges.select(u.alias("node"), v.alias("root"))


def sized(df: DataFrame) -> DataFrame:
    """``df`` (staged, at most two bigint columns) marked for broadcast if its row count is within the bound; Spark chooses the join otherwise."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def text_or_empty(col: Column | str = "text") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(""))
