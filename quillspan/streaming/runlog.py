"""The run log as a stream: new files of JSON lines in a folder become flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillspan.operators.runlog import flatten


def stream_runs(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Flat rows of every new file; repeats of a configuration are kept."""
    return flatten(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder))


def append_table(runs: DataFrame, path: str, checkpoint: str):
    """Starts writing all available rows as Parquet and returns the query."""
    flat = runs.toDF(*[c.replace(".", "__") for c in runs.columns])
    return flat.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
