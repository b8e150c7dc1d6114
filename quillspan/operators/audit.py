"""A reproducible label audit: stratified draw, blind sheet, agreement, cross-table and controls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import ANSWER_CODES, describe_kappa, normalise_answer

SEED = 42
# Quotas of the draw, roles, and the answers that controls should get.
QUOTAS = {"Not_Enough_Information": 100, "Refutes": 10, "Supports": 10}
AUDITED = "Not_Enough_Information"
ROLES = ("nei", "doi_chung")
CONTROL_ANSWER = {"Supports": "khong", "Refutes": "noi_tai"}


def draw_key(seed: int, salt: str, sample: str = "sample_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:{salt}:"), F.col(sample)).cast("binary"))


def draw(df: DataFrame, quotas: dict[str, int] = QUOTAS, audited: str = AUDITED, seed: int = SEED, label: str = "label_original", sample: str = "sample_id", strict: bool = True) -> DataFrame:
    """Quota rows of each label in the order of a seeded hash of the id, whatever the rows' order; adds ``role`` and ``number``.

    ``number`` (from 1) shuffles all roles together by another hash. With ``strict`` a label with too few rows raises.
    """
    wanted = df.where(F.col(label).isin(*quotas))
    if strict:
        have = {r[0]: r[1] for r in wanted.groupBy(label).count().collect()}
        if short := {k: have.get(k, 0) for k, n in quotas.items() if have.get(k, 0) < n}:
            raise ValueError(f"too few rows to draw from: {short}")
    # a limit in order keeps no more than the quota of any task, where a ranked window would sort a label's rows in one
    drawn = [wanted.where(F.col(label) == name).orderBy(draw_key(seed, "draw", sample), sample).limit(n) for name, n in quotas.items()]
    drawn = reduce(DataFrame.unionByName, drawn)
    role = F.when(F.col(label) == audited, ROLES[0]).otherwise(ROLES[1])
    return drawn.withColumn("role", role).withColumn("number", F.row_number().over(Window.orderBy(draw_key(seed, "shuffle", sample), sample)).cast("bigint"))


def blind_sheet(drawn: DataFrame) -> DataFrame:
    """What an annotator sees: number, id, texts and two blank columns, no label."""
    return drawn.select(F.col("number").alias("stt"), "sample_id", F.col("context").alias("ngu_canh"), F.col("response").alias("phat_bieu"), F.lit("").alias("nhan_dinh"), F.lit("").alias("ghi_chu"))


def join_annotators(truth: DataFrame, sheets: dict[str, DataFrame], sample: str = "sample_id", answer: str = "nhan_dinh") -> DataFrame:
    """Truth with a normalised answer column ``answer_<name>`` for each sheet (left joins by id); a repeated id in a sheet raises."""
    out = truth
    for name, sheet in sheets.items():
        repeats = F.raise_error(F.concat(F.lit(f"repeated id in sheet {name}: "), F.col(sample)))
        one = sheet.groupBy(sample).agg(F.count(F.lit(1)).alias("_n"), F.first(answer).alias("_a"))
        own = one.select(sample, F.when(F.col("_n") == 1, normalise_answer(F.col("_a"))).otherwise(repeats.cast("string")).alias(f"answer_{name}"))
        out = out.join(own, sample, "left")
    return out


def agreement(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """``n``, ``raw`` agreement, Cohen's ``kappa`` (NaN with fewer than two distinct answers), its ``band``."""
    by = by or []
    rows = df.select(*by, F.col(a).alias("_a"), F.col(b).alias("_b"))
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("int")).alias("raw"))
    ends = rows.select(*by, F.explode(F.array(F.struct(F.col("_a").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col("_b").alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("e"))
    shares = ends.groupBy(*by, F.col("e.v").alias("v")).agg(F.sum("e.x").alias("x"), F.sum("e.y").alias("y"))
    chance = shares.groupBy(*by).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("_xy"), F.count(F.lit(1)).alias("_labels"))
    met = total.join(chance, by) if by else total.crossJoin(chance)
    pe = F.col("_xy") / (F.col("n").cast("double") * F.col("n"))
    kappa = F.when((F.col("_labels") < 2) | (pe == 1), F.lit(float("nan"))).otherwise((F.col("raw") - pe) / F.nullif(1 - pe, F.lit(0.0)))
    return met.select(*by, "n", "raw", kappa.alias("kappa")).withColumn("band", describe_kappa(F.col("kappa")))


def crosstab(df: DataFrame, a: str, b: str, codes: tuple[str, ...] = ANSWER_CODES) -> DataFrame:
    """Counts over a fixed list of codes for rows and columns, zeros included, in the list's order (``place``)."""
    frame = df.sparkSession.createDataFrame(list(enumerate(codes)), "place int, code string")
    counts = df.groupBy(F.col(a).alias("code")).pivot(b, list(codes)).count()
    return F.broadcast(frame).join(counts, "code", "left").na.fill(0, list(codes)).select("place", "code", *codes)


def control_accuracy(df: DataFrame, annotators: list[str], label: str = "label_original", expected: dict[str, str] = CONTROL_ANSWER, warn_below: float = 0.7) -> DataFrame:
    """For each annotator the share of control rows answered as expected, and whether it is below the bound."""
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])[F.col(label)]
    rows = df.where(F.col(label).isin(*expected)).select(F.explode(F.array(*[F.struct(F.lit(n).alias("annotator"), (F.col(f"answer_{n}") == want).alias("ok")) for n in annotators])).alias("e"))
    return rows.groupBy("e.annotator").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col("e.ok"), F.lit(False)).cast("int")).alias("accuracy")).withColumn("warn", F.col("accuracy") < warn_below)


def answer_census(df: DataFrame, annotators: list[str], codes: tuple[str, ...] = ANSWER_CODES) -> DataFrame:
    """For each annotator: blank answers, invalid answers, and the distinct invalid texts sorted."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("annotator"), F.coalesce(F.col(f"answer_{n}"), F.lit("")).alias("v")) for n in annotators])).alias("e")).select("e.annotator", "e.v")
    bad = (F.col("v") != "") & ~F.col("v").isin(*codes)
    return rows.groupBy("annotator").agg(F.sum((F.col("v") == "").cast("bigint")).alias("n_blank"), F.sum(bad.cast("bigint")).alias("n_invalid"), F.array_join(F.sort_array(F.collect_set(F.when(bad, F.col("v")))), ",").alias("invalid"))


def both_say(df: DataFrame, a: str, b: str, code: str = "ngoai_lai") -> DataFrame:
    both = (F.col(a) == F.col(b)) & (F.col(a) == code)
    return df.agg(F.sum(both.cast("bigint")).alias("n_both"), F.count(F.lit(1)).alias("n"))
