"""Records of one large text file, or of a folder of them, read by several tasks.

Spark's text source cuts a file by byte ranges at every separator, wherever that stands. A first pass folds the pieces of
each range into what they do to a reader that starts outside and to one that starts inside a quoted text; a row for each
range and start comes to the driver, which chains them. The second pass then knows how each range starts and cuts its
records; those that cross ranges are put together from their parts. No task holds more than a record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.text import SLICE

# what a reader knows between two pieces: inside a quoted text or not, and how many brackets are open
State = tuple[bool, int]
_DIGITS = 20  # of a block's first byte in its name, so that names sort as bytes do


class CsvLines:
    """Lines; one ends a record unless a quoted field is open. A quote opens a field at its start only; a doubled one is text."""

    closes = ""

    def __init__(self, separator: str = "\n") -> None:
        self.separator = separator

    def step(self, piece: str, state: State) -> State:
        at, inside = 0, state[0]
        while True:
            if inside:
                quote = piece.find('"', at)
                if quote < 0:
                    return True, 0
                if piece[quote + 1 : quote + 2] == '"':
                    at = quote + 2
                    continue
                at, inside = quote + 1, False
            elif piece[at : at + 1] == '"':
                at, inside = at + 1, True
                continue
            comma = piece.find(",", at)
            if comma < 0:
                return False, 0
            at = comma + 1

    def ends(self, state: State) -> bool:
        return not state[0]

    def clean(self, record: str) -> str:
        return record.removesuffix("\r")


class JsonEntries:
    """Pieces up to a closing brace; one ends an entry of the outermost object if that object alone stays open."""

    separator, closes = "}", "}"
    _TEXT = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
    _REST = re.compile(r'(?:[^"\\]|\\.)*"', re.S)

    def step(self, piece: str, state: State) -> State:
        inside, depth = state
        if inside:
            end = self._REST.match(piece)
            if end is None:
                return True, depth
            piece = piece[end.end() :]
        outside = self._TEXT.sub("", piece)
        inside = '"' in outside
        if inside:
            outside = outside[: outside.index('"')]
        depth += outside.count("{") + outside.count("[") - outside.count("]")
        return inside, depth if inside else depth - 1

    def ends(self, state: State) -> bool:
        return state == (False, 1)

    def clean(self, record: str) -> str:
        return record


@dataclass(frozen=True)
class Start:
    state: State
    continues: bool  # a record is open


def _fold(machine):
    """(block, starts inside, ends inside, change of depth, pieces) for both starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, bool], State] = {}
        for batch in batches:
            for block, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = piece.as_py()
                for inside in (False, True):
                    found[block, inside] = machine.step(text, found.get((block, inside), (inside, 0)))
        rows = [(block, inside, *state) for (block, inside), state in found.items()]
        kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["block", "from_inside", "inside", "depth"])

    return run


def _cut(machine, starts, open_ends: frozenset[str]):
    """Rows (block, nth, kind, ended, text): whole records, and the parts at a block's ends; ``kind`` 0 whole, 1 continues, 2 begins.

    ``open_ends``: the last blocks of files where no separator follows the last piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = starts.value
        block, state, nth, kind = None, (False, 0), 0, 0
        held: list[str] = []
        out: list[tuple[str, int, int, bool, str]] = []

        def close() -> None:
            if held:
                out.append((block, nth, 1 if kind == 1 else 2, False, machine.separator.join(held if block in open_ends else [*held, ""])))

        for batch in batches:
            for own, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own != block:
                    close()
                    start = known[own]
                    block, state, nth, held, kind = own, start.state, 0, [], 1 if start.continues else 0
                text = piece.as_py()
                held.append(text)
                state = machine.step(text, state)
                if machine.ends(state):
                    record = machine.separator.join(held) + machine.closes
                    if kind == 1 or machine.clean(record):
                        out.append((block, nth, kind, True, record))
                        nth += 1
                    held, kind = [], 0
                    if len(out) == SLICE:
                        yield _rows(out)
                        out = []
            yield _rows(out)
            out = []
        close()
        yield _rows(out)

    return run


def _rows(out: list[tuple[str, int, int, bool, str]]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["block", "nth", "kind", "ended", "text"])


def _opened(spark: SparkSession, path: str, uri: bool = False):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path) if uri else path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.open(p), fs.getFileStatus(p).getLen()


def ends_with(spark: SparkSession, uri: str, mark: str) -> bool:
    """Whether a file's last byte is ``mark``."""
    stream, size = _opened(spark, uri, uri=True)
    try:
        if size:
            stream.seek(size - 1)
        return stream.read() == ord(mark)
    finally:
        stream.close()


def first_file(spark: SparkSession, path: str) -> str:
    """The path itself, or the first file of a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(p).isDirectory():
        return path
    names = sorted(f.getPath().toString() for f in fs.listStatus(p) if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", ".")))
    return names[0] if names else path


def line_end(spark: SparkSession, path: str, most: int = 1 << 16) -> str:
    """The first line end of a file (a folder's first one), which holds for all: a line feed, a carriage return or both."""
    stream, _ = _opened(spark, first_file(spark, path))
    try:
        for _ in range(most):
            byte = stream.read()
            if byte == 13:
                return "\r\n" if stream.read() == 10 else "\r"
            if byte in (10, -1):
                break
        return "\n"
    finally:
        stream.close()


def first_of_file(block) -> Column:
    """Whether a block is the first of its file."""
    return block.endswith("|" + "0" * _DIGITS)


def records(spark: SparkSession, path: str, machine) -> tuple[DataFrame, list[State]]:
    """``block``, ``nth`` (both together in the files' order), ``ended`` and ``text`` of each record, blank ones left out.

    What follows the last end of a record in a file is a record too, not ``ended``. Also returns how each file that isn't
    empty ends. The first pass runs when this is called.
    """
    at = F.lpad(F.col("_metadata.file_block_start").cast("string"), _DIGITS, "0")
    pieces = spark.read.option("lineSep", machine.separator).text(path).select(F.concat_ws("|", "_metadata.file_path", at).alias("block"), "value")
    folded = pieces.mapInArrow(_fold(machine), "block string, from_inside boolean, inside boolean, depth bigint").collect()
    by_start = {(r.block, r.from_inside): (r.inside, r.depth) for r in folded}
    files: dict[str, list[str]] = {}
    for block in sorted({b for b, _ in by_start}):
        files.setdefault(block.rpartition("|")[0], []).append(block)
    starts: dict[str, Start] = {}
    ends, open_ends = [], set()
    for file, blocks in files.items():
        state: State = (False, 0)
        for block in blocks:
            starts[block] = Start(state, block != blocks[0] and not machine.ends(state))
            inside, depth = by_start[block, state[0]]
            state = inside, state[1] + depth
        if not ends_with(spark, file, machine.separator):
            open_ends.add(blocks[-1])
            state = state[0], state[1] + (1 if machine.closes and not state[0] else 0)  # the brace that isn't there
        ends.append(state)
    cut = pieces.mapInArrow(_cut(machine, spark.sparkContext.broadcast(starts), frozenset(open_ends)), "block string, nth bigint, kind int, ended boolean, text string")
    whole = cut.where("kind = 0").select("block", "nth", "ended", "text")
    # two parts a range at most; a begun record's parts run from its beginning up to the next one's
    parts = cut.where("kind > 0").withColumn("_record", F.sum((F.col("kind") == 2).cast("int")).over(Window.orderBy("block", "kind", "nth")))
    joined = parts.groupBy("_record").agg(F.sort_array(F.collect_list(F.struct("block", "kind", "nth", "ended", "text"))).alias("_p"))
    first = F.get("_p", F.lit(0))
    crossing = joined.select(first["block"].alias("block"), first["nth"].alias("nth"), F.exists("_p.ended", lambda e: e).alias("ended"), F.concat_ws("", F.col("_p.text")).alias("text"))
    return whole.unionByName(crossing), ends


def counted(df: DataFrame, per_row, name: str) -> DataFrame:
    """Adds ``name``: how many items (``per_row``) come before a row in the files' order; one count for each range, no global sort."""
    sums = df.groupBy("block").agg(F.sum(per_row).alias("_rows"))
    before = sums.select("block", (F.sum("_rows").over(Window.orderBy("block")) - F.col("_rows")).alias("_before"))
    inside = F.sum(per_row).over(Window.partitionBy("block").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - per_row
    return df.withColumn("_inside", inside).join(F.broadcast(before), "block").withColumn(name, (F.col("_before") + F.col("_inside")).cast("int")).drop("_before", "_inside")
