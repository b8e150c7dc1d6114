"""Where raw corpora are, looked for lazily: a named folder, the environment, the working folder, mounted folders."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# The file that marks a raw folder, the environment variable, the default and the mounts' patterns.
MARKER = "vihallu_train.csv"
ENV = "QUILLSPAN_DATA_DIR"
DEFAULT = "data/raw"
MOUNTS = ("/kaggle/input", "/kaggle/input/*", "/kaggle/input/*/*", "/kaggle/input/datasets/*/*", "/kaggle/input/*/*/*")


def matching(pattern: str) -> Iterator[Path]:
    """What an absolute pattern matches, sorted; nothing is read before it is asked for."""
    root = Path(Path(pattern).anchor)
    yield from sorted(root.glob(pattern.removeprefix(str(root))))


def raw_folders(environment: Mapping[str, str] = os.environ, default: str = DEFAULT, mounts: Sequence[str] = MOUNTS) -> Iterator[Path]:
    """Folders that may hold the corpora, the likeliest first."""
    named = filter(None, (environment.get(ENV), default))
    return chain(map(Path, named), chain.from_iterable(map(matching, mounts)))


def find_raw_dir(explicit: str | Path | None = None, marker: str = MARKER, **where) -> Path:
    """``explicit`` if it is a folder, whatever it holds; if none is named, the first of ``raw_folders`` with the marker."""
    if explicit is None:
        found = next((p for p in raw_folders(**where) if (p / marker).is_file()), None)
    else:
        found = Path(explicit) if Path(explicit).is_dir() else None
    if found is None:
        raise FileNotFoundError(f"no folder {explicit}" if explicit is not None else f"no folder with {marker}; name one by {ENV}")
    return found


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``; it goes when the program ends.

    Where the session names none, a temporary folder serves in local mode; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="quillspan-")
    path = f"{named}/quillspan-{uuid.uuid4().hex}-{name}"
    _SCRATCH.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to a shared folder and read back: what is read often isn't computed often, lost executor or not."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_scratch() -> None:
    for spark, path in _SCRATCH:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended; the cluster's own cleaning is left
            return
