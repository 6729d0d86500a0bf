"""Normalising raw multiple-choice records, with a side output of exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions.text import strip
from fidelis.operators.guard import guard
from fidelis.operators.identity import ids_digest

FORBIDDEN = ("generator", "generator_id", "chosen_answer", "rationale", "label")


def exclusion_reason() -> Column:
    """The first defect of a raw record, in the fixed order; null for a good one."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    question, choices, gold = F.col("question"), F.col("choices"), F.col("correct_choice_idx")
    return (
        F.when(blank(F.col("question_id")), "missing question_id").when(blank(F.col("image_id")), "missing image_id")
        .when(strip(F.coalesce(question, F.lit(""))) == "", "empty question")
        .when(choices.isNull() | (F.size(choices) < 2), "malformed choices (need >=2 options)")
        .when(F.exists(choices, lambda o: strip(F.coalesce(o, F.lit(""))) == ""), "empty option text")
        .when(gold.isNull() | (gold < 0) | (gold >= F.size(choices)), "gold index missing or out of range")
    )


def normalize(raw: DataFrame, dataset: str) -> DataFrame:
    """Every raw record once, with `reason` null for the good ones; one scan serves both outputs."""
    return raw.select(
        F.lit(dataset).alias("dataset"), F.coalesce(F.nullif(F.col("question_id").cast("string"), F.lit("")), F.lit("<missing question_id>")).alias("record_id"),
        F.concat(F.lit("coco/"), F.col("image_id").cast("string")).alias("image_ref"), strip(F.col("question")).alias("question"),
        F.col("choices").alias("options"), F.col("correct_choice_idx").alias("gold_answer_idx"), exclusion_reason().alias("reason"),
    )


def records(normalized: DataFrame) -> DataFrame:
    return normalized.where("reason is null").drop("reason")


def exclusions(normalized: DataFrame) -> DataFrame:
    return normalized.where("reason is not null").select("dataset", F.col("record_id").alias("raw_record_id"), "reason")


def no_forbidden_columns(df: DataFrame, names: tuple[str, ...] = FORBIDDEN) -> list[str]:
    return sorted(set(df.columns) & set(names))


def verify_pool(pool: DataFrame, key: str, n: int, digest: str) -> DataFrame:
    """The one-row digest of a pool, failing the run where it is not the registered one."""
    return guard(ids_digest(pool, key), (F.col("n") == n) & (F.col("digest") == digest), "pool differs from its manifest")


def image_path(image_ref: Column, root: str) -> Column:
    """Place of an image file: the reference's last part, padded with zeros to 12 digits."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.lpad(F.substring_index(image_ref, "/", -1), 12, "0"), F.lit(".jpg"))
