"""Readers of the four corpora into the common schema, and generic scans. Row numbers follow the files' order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.text import context_id, evidence_given, find_evidence, json_meta, prompt_type, sample_id
from quillspan.operators import schema
from quillspan.sources import splits

# File names, label maps and required columns of the corpora.
FILES = {
    "vihallu": {"train": "vihallu_train.csv"},
    "isedsc01": {"train": "isedsc01_train.json"},
    "viwikifc": {s: f"viwikifc_{s}.csv" for s in schema.SPLITS},
    "vifactcheck": {s: f"vifactcheck_{s}.parquet" for s in schema.SPLITS},
}
LABEL_MAPS = {
    "vihallu": {"no": "no", "intrinsic": "intrinsic", "extrinsic": "extrinsic"},
    "isedsc01": {"SUPPORTED": "no", "REFUTED": "intrinsic", "NEI": "extrinsic"},
    "viwikifc": {"Supports": "no", "Refutes": "intrinsic", "Not_Enough_Information": "extrinsic"},
    "vifactcheck": {"0": "no", "1": "intrinsic", "2": "extrinsic"},
}
REQUIRED = {
    "vihallu": ("id", "context", "prompt", "response", "label"),
    "viwikifc": ("pairID", "evidence", "gold_label", "link", "context", "sentenceID", "claim", "title"),
    "vifactcheck": ("Statement", "Context", "labels", "Evidence", "Topic"),
}
MINIMAL = {  # corpus: context, question, response
    "vihallu": ("context", "prompt", "response"),
    "isedsc01": ("context", None, "claim"),
    "viwikifc": ("context", None, "claim"),
    "vifactcheck": ("Context", None, "Statement"),
}
# Rows of each split and label in the published corpora; the misses and the share of evidence found there.
PUBLISHED = {
    "vihallu": {"train": {"no": 2245, "intrinsic": 2448, "extrinsic": 2307}},
    "isedsc01": {"train": {"no": 12786, "intrinsic": 11000, "extrinsic": 12583}},
    "viwikifc": {
        "train": {"no": 5594, "intrinsic": 5573, "extrinsic": 5571},
        "dev": {"no": 666, "intrinsic": 694, "extrinsic": 730},
        "test": {"no": 708, "intrinsic": 706, "extrinsic": 677},
    },
    "vifactcheck": {
        "train": {"no": 1751, "intrinsic": 1658, "extrinsic": 1653},
        "dev": {"no": 256, "intrinsic": 244, "extrinsic": 223},
        "test": {"no": 508, "intrinsic": 468, "extrinsic": 471},
    },
}
EVIDENCE_MISSES = {"viwikifc": 1}
EVIDENCE_RATE = {"vifactcheck": (0.55, 0.65)}


def require_file(spark: SparkSession, path: str) -> str:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
    return path


def require_columns(df: DataFrame, names: tuple[str, ...], where: str) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"{where} lacks columns {', '.join(missing)}")
    return df


def numbered(df: DataFrame, name: str = "_index") -> DataFrame:
    """0-based row numbers in scan order: the number in the partition after the rows of those before it, one count for each."""
    mid = F.monotonically_increasing_id()  # the partition above the row's number of 33 bits
    rows = df.withColumn("_part", F.shiftright(mid, 33)).withColumn("_nth", mid.bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_nth")).cast("int")).drop("_part", "_nth", "_before")


def read_csv(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """All columns text; an empty field is an empty string and ``NA`` stays. Quoted fields may hold line breaks.

    The file, or a folder of files with a header each, is read by byte ranges. Its first line end is that of all its lines; one inside quotes reads as a line feed. ``index`` names a column for the row's number, from 0 and in the files' order.
    """
    form = {"quote": '"', "escape": '"', "multiLine": "true"}
    names = spark.read.options(**form, header=True, inferSchema=False).csv(require_file(spark, path)).columns
    end = splits.line_end(spark, path)
    rows, _ = splits.records(spark, path, splits.CsvLines(end[-1]))
    text = F.col("text") if end == "\n" else F.replace(F.regexp_replace("text", "\\r$", ""), F.lit(end), F.lit("\n"))
    kind = ", ".join(f"_c{i} string" for i in range(len(names)))
    header = splits.first_of_file(F.col("block")) & (F.col("nth") == 0)
    parsed = rows.where(~header).select("block", "nth", F.from_csv(text, kind, form).alias("_r"))
    placed = splits.counted(parsed, F.lit(1), "_place") if index else parsed
    fields = [F.coalesce(F.col(f"_r._c{i}"), F.lit("")).alias(c.lstrip("\ufeff")) for i, c in enumerate(names)]
    return placed.select(*fields, *([F.col("_place").alias(index)] if index else []))


def read_json_records(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """One top-level object of records: ``source_id``, ``_index`` in the file's order, the fields (null where JSON has null).

    The file, or a folder of them, is read by byte ranges and cut behind each record; what isn't such an object raises.
    """
    kind = T.MapType(T.StringType(), T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    rows, ends = splits.records(spark, require_file(spark, path), splits.JsonEntries())
    wrong = f"{path} is not an object of records"
    if not ends or any(inside or depth > 0 for inside, depth in ends):
        raise ValueError(wrong)
    # each part is read as an object of its own, without the brace or comma before it
    first, text = splits.first_of_file(F.col("block")) & (F.col("nth") == 0), F.col("text")
    good = F.when(first, text.rlike(r"^[\s\uFEFF]*\{(?!\s*,)")).otherwise(text.rlike(r"^\s*(,(?!\s*\})|\}\s*$)") | text.rlike(r"^\s*$"))
    entry = F.concat(F.lit("{"), F.regexp_replace(text, r"^[\s\uFEFF]*[{,]?", ""), F.when(F.col("ended"), "}").otherwise(""))
    read = F.when(~first & text.rlike(r"^\s*$"), F.from_json(F.lit("{}"), kind)).when(good, F.from_json(entry, kind))
    checked = F.when(read.isNull(), F.raise_error(F.lit(wrong)).cast(kind)).otherwise(read)
    placed = splits.counted(rows.select("block", "nth", checked.alias("m")), F.size("m"), "_before_it")
    each = placed.select("_before_it", F.posexplode("m").alias("_pos", "source_id", "r"))
    return each.select((F.col("_before_it") + F.col("_pos")).alias("_index"), "source_id", *[F.col(f"r.{f}").alias(f) for f in fields])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(require_file(spark, path)).drop("Unnamed: 0")


def mapped_label(original: Column, mapping: Mapping[str, str], row: Column) -> Column:
    """The mapped label; an unknown value raises and names its row."""
    out = F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(original, F.lit("null")), F.lit(" in row "), row.cast("string"))).cast("string")
    for k, v in mapping.items():
        out = F.when(original == k, v).otherwise(out)
    return out


def _common(df: DataFrame, dataset: str, split: str, context: Column, question: Column, response: Column, label: Column, label_original: Column, given: Column | None, meta: dict[str, Column], generated: bool) -> DataFrame:
    if given is None:
        evidence, start, end = F.lit(""), F.lit(-1).cast("bigint"), F.lit(-1).cast("bigint")
    else:
        start, end = find_evidence(context, given)
        evidence = F.when(start >= 0, given).otherwise("")
        meta = meta | {"evidence_given": evidence_given(given)}
    return schema.finalise(df.select(
        sample_id(F.lit(dataset), F.lit(split), F.col("_index")).alias("sample_id"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), context.alias("context"), context_id(context).alias("context_id"),
        question.alias("question"), response.alias("response"), label.alias("label"), label_original.alias("label_original"), evidence.alias("evidence"), start.alias("evidence_start"), end.alias("evidence_end"),
        F.lit(generated).alias("response_is_generated"), json_meta(meta).alias("meta"),
    ))


def read_vihallu(spark: SparkSession, raw_dir: str) -> DataFrame:
    name = "vihallu"
    df = require_columns(read_csv(spark, f"{raw_dir}/{FILES[name]['train']}", "_index"), REQUIRED[name], name)
    kind = prompt_type(F.col("prompt"), F.col("context"))
    meta = {"source_id": F.col("id"), "prompt_type": kind, "prompt_has_diacritics": kind != "noisy"}
    return _common(df, name, "train", F.col("context"), F.col("prompt"), F.col("response"), mapped_label(F.col("label"), LABEL_MAPS[name], F.col("_index")), F.col("label"), None, meta, True)


def read_isedsc01(spark: SparkSession, raw_dir: str) -> DataFrame:
    name = "isedsc01"
    df = read_json_records(spark, f"{raw_dir}/{FILES[name]['train']}", ("context", "claim", "verdict", "evidence", "domain"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    meta = {"source_id": F.col("source_id"), "domain": blank("domain")}
    return _common(df, name, "train", blank("context"), F.lit(""), blank("claim"), mapped_label(F.col("verdict"), LABEL_MAPS[name], F.col("_index")), F.col("verdict"), blank("evidence"), meta, False)


def read_viwikifc(spark: SparkSession, raw_dir: str) -> DataFrame:
    name, parts = "viwikifc", []
    for split, file in FILES[name].items():
        df = require_columns(read_csv(spark, f"{raw_dir}/{file}", "_index"), REQUIRED[name], file)
        meta = {"source_id": F.col("pairID"), "title": F.col("title"), "link": F.col("link"), "sentence_id": F.col("sentenceID")}
        parts.append(_common(df, name, split, F.col("context"), F.lit(""), F.col("claim"), mapped_label(F.col("gold_label"), LABEL_MAPS[name], F.col("_index")), F.col("gold_label"), F.col("evidence"), meta, False))
    return union_all(parts)


def read_vifactcheck(spark: SparkSession, raw_dir: str) -> DataFrame:
    name, parts = "vifactcheck", []
    for split, file in FILES[name].items():
        df = numbered(require_columns(read_parquet(spark, f"{raw_dir}/{file}"), REQUIRED[name], file))
        text = lambda c, df=df: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
        original = F.col("labels").cast("string")
        meta = {"annotation_id": text("annotation_id"), "topic": text("Topic"), "url": text("Url")}
        parts.append(_common(df, name, split, text("Context"), F.lit(""), text("Statement"), mapped_label(original, LABEL_MAPS[name], F.col("_index")), original, text("Evidence"), meta, False))
    return union_all(parts)


READERS = {"vihallu": read_vihallu, "isedsc01": read_isedsc01, "viwikifc": read_viwikifc, "vifactcheck": read_vifactcheck}


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_published(df: DataFrame, dataset: str) -> None:
    """Raise if a corpus isn't the published one: its counts by split and label, and how much evidence is found in it."""
    schema.check_counts(df, {(split, label): n for split, labels in PUBLISHED[dataset].items() for label, n in labels.items()})
    if dataset in EVIDENCE_MISSES:
        schema.check_misses(df, EVIDENCE_MISSES[dataset])
    if dataset in EVIDENCE_RATE:
        schema.check_evidence_rate(df, *EVIDENCE_RATE[dataset])


def normalise(spark: SparkSession, dataset: str, raw_dir: str, published: bool = True) -> DataFrame:
    """A corpus in the common schema, validated; it must be the published one to the row unless ``published`` is false."""
    df = READERS[dataset](spark, raw_dir)
    schema.validate(df)
    if published:
        check_published(df, dataset)
    return df


def read_minimal(spark: SparkSession, raw_dir: str, dataset: str) -> DataFrame:
    """``context``, ``question``, ``response`` of a corpus's training file, by its suffix."""
    context, question, response = MINIMAL[dataset]
    path = f"{raw_dir}/{FILES[dataset]['train']}"
    if path.endswith(".json"):
        df = read_json_records(spark, path, tuple(c for c in (context, question, response) if c))
    else:
        df = read_csv(spark, path) if path.endswith(".csv") else read_parquet(spark, path)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    return df.select(text(context).alias("context"), text(question).alias("question"), text(response).alias("response"))


def load_dataset(spark: SparkSession, interim_dir: str, dataset: str, split: str) -> DataFrame:
    return spark.read.parquet(interim_dir).where((F.col("dataset") == dataset) & (F.col("split") == split))
