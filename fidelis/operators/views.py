"""Separated release views and the checks on the boundaries between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a predictor must never see, and the splits whose labels may be.
FORBIDDEN = (
    "label", "reason_code", "state", "behavioural_state", "generator_id", "margins", "provenance", "sealed_provenance",
    "interventional_provenance", "correct", "correctness", "answer_correct", "correct_real",
)
OPEN_SPLITS = ("train", "validation")
PREDICTOR = ("instance_id", "split", "image", "question", "options", "chosen_answer", "rationale")
HIDDEN, AUDIT = ("instance_id", "label", "reason_code", "split"), ("state", "generator_id", "margins", "sealed_provenance")
# The obligations that no check of tables can verify, by the clause that asks for them.
ATTESTED = {"N12.2": "withheld artifacts can't be derived from what is visible", "N12.5": "the predictor view is a strict projection", "N13.2": "the hidden view is kept apart"}


def _complete(entries: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns, all of them; a view that lacks one must not be released."""
    if lacking := [c for c in columns if c not in entries.columns]:
        raise ValueError(f"the view lacks {lacking}")
    return entries.select(*columns)


def predictor_view(entries: DataFrame) -> DataFrame:
    return _complete(entries, PREDICTOR)


def hidden_view(entries: DataFrame) -> DataFrame:
    return _complete(entries, HIDDEN)


def severed(instance: Column, salt: str) -> Column:
    """An id that can't be joined back without the salt."""
    return F.sha2(F.concat_ws("|", F.lit(salt), instance.cast("string")), 256)


def audit_view(entries: DataFrame, salt: str) -> DataFrame:
    return _complete(entries, ("instance_id", *AUDIT)).select(severed(F.col("instance_id"), salt).alias("audit_id"), *AUDIT)


def _verdict(bad: DataFrame, name: str, key: str) -> DataFrame:
    """One row: the check's name, whether it passed, how many violations, and the least violating ids."""
    return bad.agg(F.count("*").alias("violations"), F.min(F.col(key).cast("string")).alias("first_violation")).select(
        F.lit(name).alias("check"), (F.col("violations") == 0).alias("passed"), "violations", "first_violation",
    )


def check_exclusions(predictor: DataFrame) -> DataFrame:
    """No forbidden name as a column, or as a key of a row's `extra` map, which keeps ragged rows apart."""
    named = [c for c in predictor.columns if c in FORBIDDEN]
    bad = F.lit(False)
    for c in named:
        bad = bad | F.col(c).isNotNull()
    if "extra" in predictor.columns:
        bad = bad | (F.size(F.array_intersect(F.coalesce(F.map_keys("extra"), F.array().cast("array<string>")), F.array(*map(F.lit, FORBIDDEN)))) > 0)
    return _verdict(predictor.where(bad), "predictor_view_exclusions", "instance_id")


def ragged_keys(rows: DataFrame, props: str) -> DataFrame:
    """The rows with the distinct keys of a JSON object as a sorted array, and those of them that are forbidden; null for what is no object."""
    keys = F.array_sort(F.array_distinct(F.map_keys(F.from_json(props, "map<string,string>"))))
    return rows.withColumn("keys", keys).withColumn("forbidden", F.array_sort(F.array_intersect("keys", F.array(*map(F.lit, FORBIDDEN)))))


def check_ragged(rows: DataFrame, props: str, key: str) -> DataFrame:
    """No forbidden name among the keys of a JSON object, for rows of any shape."""
    return _verdict(ragged_keys(rows, props).where(F.size("forbidden") > 0), "ragged_exclusions", key)


def _labels_with_split(labels: DataFrame, predictor: DataFrame) -> DataFrame:
    return labels.select("instance_id").join(predictor.select("instance_id", "split"), "instance_id", "left")


def check_label_join(labels: DataFrame, predictor: DataFrame) -> DataFrame:
    """Every visible label belongs to a train instance; an unknown instance counts against."""
    bad = _labels_with_split(labels, predictor).where(~F.col("split").eqNullSafe(F.lit("train")))
    return _verdict(bad, "train_label_join_restriction", "instance_id")


def check_split_isolation(labels: DataFrame, predictor: DataFrame) -> DataFrame:
    bad = _labels_with_split(labels, predictor).where(~F.coalesce("split", F.lit("")).isin(*OPEN_SPLITS))
    return _verdict(bad, "split_isolation", "instance_id")


def check_audit(audit: DataFrame, predictor: DataFrame) -> DataFrame:
    bad = audit.join(predictor.select(F.col("instance_id").alias("audit_id")), "audit_id", "left_semi")
    return _verdict(bad, "audit_non_joinability", "audit_id")


def boundary_report(views: dict[str, DataFrame]) -> DataFrame:
    """All four checks; a missing view is an error. Attested obligations are never among the verified ones."""
    missing = {"predictor_view", "train_labels", "hidden_view", "audit_view"} - set(views)
    if missing:
        raise ValueError(f"views missing: {sorted(missing)}")
    predictor, labels = views["predictor_view"], views["train_labels"]
    return (
        check_exclusions(predictor).unionAll(check_label_join(labels, predictor)).unionAll(check_split_isolation(labels, predictor))
        .unionAll(check_audit(views["audit_view"], predictor))
    )


def whole_report(views: dict[str, DataFrame], attested: DataFrame, version: str) -> DataFrame:
    """The four verified checks and, beside them, the obligations that people attest, each with who did for this corpus version.

    attested: (obligation, attested_by, corpus_version). An obligation passes only by such a record; one of another
    version, or without a name, is none. Of several the least name stands. What is no obligation is left out.
    """
    spark = attested.sparkSession
    asked = spark.createDataFrame(list(ATTESTED), "string").withColumnRenamed("value", "check")
    given = attested.where((F.col("corpus_version") == version) & (F.length(F.trim("attested_by")) > 0)).groupBy(F.col("obligation").alias("check")).agg(F.min("attested_by").alias("attested_by"))
    none = F.lit(None)
    obligations = asked.join(given, "check", "left").select(F.lit("attested").alias("kind"), "check", F.col("attested_by").isNotNull().alias("passed"), none.cast("long").alias("violations"), none.cast("string").alias("first_violation"), "attested_by")
    verified = boundary_report(views).select(F.lit("verified").alias("kind"), "check", "passed", "violations", "first_violation", none.cast("string").alias("attested_by"))
    return verified.unionAll(obligations)
