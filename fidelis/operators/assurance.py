"""Deterministic release checks, the release-blocking criteria that rest on them, and the release manifest."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.operators import merkle

# The blocking criteria and what each rests on; the manifest's fields.
CRITERIA = {
    "BL1": ("LF3",), "BL2": ("traceability",), "BL3": ("DF1", "DF2", "DF3"), "BL4": ("conformance",), "BL5": ("label_stability",),
    "BL6": ("hard_core_collapse",), "BL7": ("boundary",), "BL8": ("manifest",), "BL9": ("analysis_plan",),
}
MANIFEST = ("corpus_version", "entries", "spec_versions", "origins", "splits", "selectors", "rederivation", "views")
REDERIVATION = ("spec_versions", "generators", "source_revisions", "intervention_profile", "extraction_contract", "selectors", "stack", "deterministic_scope", "acceptance")
LICENCES = ("model_license", "output_license", "redistribution", "training_use")
#: The least share of a class that a split must have of either.
LEAST_CLASS = 0.05


def violations(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def legal_label() -> Column:
    """Whether state, label and reason_code are a row of the label table."""
    legal = (
        ((F.col("state") == "S1") & (F.col("label") == "unfaithful") & (F.col("reason_code") == "D1"))
        | ((F.col("state") == "S2") & (F.col("label") == "unfaithful") & (F.col("reason_code") == "D2"))
        | ((F.col("state") == "S3") & (F.col("label") == "faithful") & F.col("reason_code").isNull())
    )
    return F.coalesce(legal, F.lit(False))


def standard_checks(entries: DataFrame) -> list[DataFrame]:
    """Of entries (instance, label, state, reason_code, split, scene): identity, label table, splits, scenes."""
    divided = entries.where(F.col("split").isin("train", "validation")).groupBy("scene").agg(F.countDistinct("split").alias("n")).where("n > 1")
    return [
        violations("one_entry_per_instance", entries.groupBy("instance").count().where("count > 1")),
        violations("label_table", entries.where(~legal_label())),
        violations("split_present", entries.where("split is null")),
        violations("scene_in_one_split", divided),
    ]


def shared_scenes(entries: DataFrame) -> DataFrame:
    """DF1: scenes in several splits, the split by generator aside, whose scenes may be those of others."""
    return entries.where("split <> 'ood-model'").groupBy("scene").agg(F.countDistinct("split").alias("n")).where("n > 1")


def shared_origins(entries: DataFrame, column: str, held: str) -> DataFrame:
    """DF2 and DF3: values of a held-out split's dataset or generator that other splits have too."""
    by = entries.where(f"{column} is not null").groupBy(column).agg(F.max((F.col("split") == held).cast("int")).alias("inside"), F.max((F.col("split") != held).cast("int")).alias("outside"))
    return by.where("inside = 1 and outside = 1")


def lopsided_splits(entries: DataFrame, least: float = LEAST_CLASS) -> DataFrame:
    """DF4: splits in which a class has less than the least share."""
    faithful = F.avg((F.col("label") == "faithful").cast("double"))
    return entries.where("split is not null").groupBy("split").agg(faithful.alias("share")).where((F.col("share") < least) | (F.col("share") > 1 - least))


def broken_precedence(entries: DataFrame) -> DataFrame:
    """LF2: entries off the label table, or in S2 or S3 although the readings that decide first made them S1."""
    late = F.coalesce(F.col("state").isin("S2", "S3") & (F.col("flip_count") < F.col("k")), F.lit(False))
    return entries.where(~legal_label() | late)


def unreconstructed(entries: DataFrame) -> DataFrame:
    """LF3: entries whose state doesn't follow from their sealed provenance (flip_count, k, drift, theta)."""
    again = F.when(F.col("flip_count") < F.col("k"), "S1").when((F.col("flip_count") >= F.col("k")) & (F.col("drift") >= F.col("theta")), "S3").when((F.col("flip_count") >= F.col("k")) & (F.col("drift") < F.col("theta")), "S2")
    return entries.where(~again.eqNullSafe(F.col("state")) | F.col("state").isNull())


def unresolved(candidates: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """LF4: candidates without an outcome, outcomes without a candidate, and keys with several."""
    n = outcomes.groupBy(key).agg(F.count("*").alias("n"))
    return candidates.select(key, F.lit(1).alias("c")).join(n, key, "full_outer").where("n is null or c is null or n > 1")


def corpus_checks(entries: DataFrame, candidates: DataFrame, outcomes: DataFrame, key: str) -> list[DataFrame]:
    """DF1 to DF4 and LF2 to LF4, one row each."""
    return [
        violations("DF1", shared_scenes(entries)), violations("DF2", shared_origins(entries, "dataset", "ood-dataset")), violations("DF3", shared_origins(entries, "generator", "ood-model")),
        violations("DF4", lopsided_splits(entries)), violations("LF2", broken_precedence(entries)), violations("LF3", unreconstructed(entries)), violations("LF4", unresolved(candidates, outcomes, key)),
    ]


def untraceable(entries: DataFrame) -> DataFrame:
    """Entries without a source record, a generator or the versions that give them meaning."""
    return entries.where("source is null or generator is null or spec_versions is null or size(spec_versions) = 0")


def unstable(first: DataFrame, again: DataFrame, key: str, column: str, tolerance: float) -> DataFrame:
    """One row if labels that are derived again differ for more than the tolerated share of keys, none else. A missing key differs."""
    a, b = first.select(key, F.col(column).alias("a")), again.select(key, F.col(column).alias("b"))
    share = a.join(b, key, "left").agg(F.avg((~F.col("a").eqNullSafe(F.col("b"))).cast("double")).alias("flips"))
    return share.where(F.col("flips") > tolerance)


def nonconformant(judged: DataFrame) -> DataFrame:
    """BL4: runs of evaluate.conformance that break a rule; a run that couldn't be judged counts."""
    return judged.where(~F.coalesce("conformant", F.lit(False)))


def easy_core(pairs: DataFrame, scores: DataFrame, key: str, score: str, most: float) -> DataFrame:
    """BL6: one row with share and n if a score tells the positives of the hard core's (negative, positive) pairs from their negatives too well.

    The share is that of pairs whose positive scores higher, ties counting a half; pairs with a missing score are left
    out, and without any other pair the core isn't shown to be hard, which counts as a violation too.
    """
    of = lambda side: scores.select(F.col(key).alias(side), F.col(score).alias(f"__{side}"))
    both = pairs.join(of("negative"), "negative").join(of("positive"), "positive")
    won = F.when(F.col("__positive") > F.col("__negative"), 1.0).when(F.col("__positive") == F.col("__negative"), 0.5).when(F.col("__positive") < F.col("__negative"), 0.0)
    return both.agg(F.avg(won).alias("share"), F.count(won).alias("n")).where(F.col("share").isNull() | (F.col("share") > most))


def breaches(report: DataFrame) -> DataFrame:
    """BL7: the rows of views.boundary_report, or of views.whole_report, that did not pass; an obligation that nobody attested did not."""
    return report.where(~F.coalesce("passed", F.lit(False)))


def manifest_differences(recorded: DataFrame, again: DataFrame, by: list[str]) -> DataFrame:
    """BL8: groups whose entry_digests, as recorded and as made again, differ or are on one side only."""
    a, b = recorded.alias("a"), again.alias("b")
    same = reduce(Column.__and__, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by))
    held = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in by]
    return a.join(b, same, "full_outer").where(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select(*held, F.col("a.digest").alias("recorded"), F.col("b.digest").alias("found"))


def release_report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, checks).withColumn("passed", F.col("violations") == 0)


def releasable(report: DataFrame) -> DataFrame:
    return report.agg(F.bool_and("passed").alias("releasable"), F.sum("violations").alias("violations"))


def blocking(checks: DataFrame, criteria: dict[str, tuple[str, ...]] = CRITERIA) -> DataFrame:
    """Each criterion with the violations of the checks it rests on, those of them that are missing, and whether it is cleared.

    checks: (check, violations). A check that nobody made clears nothing.
    """
    spark = checks.sparkSession
    rests = spark.createDataFrame([(b, c) for b, cs in criteria.items() for c in cs], "criterion string, check string")
    made = checks.groupBy("check").agg(F.sum("violations").alias("violations"))
    both = rests.join(made, "check", "left").groupBy("criterion").agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"), F.count_if(F.col("violations").isNull()).alias("missing"))
    return both.withColumn("cleared", (F.col("violations") == 0) & (F.col("missing") == 0))


def release(checks: DataFrame) -> DataFrame:
    """Whether every blocking criterion is cleared, and those that are not; one row."""
    left = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("cleared"), F.col("criterion")))), ",")
    return blocking(checks).agg(F.bool_and("cleared").alias("releasable"), left.alias("blocked_by"))


def set_digest(*parts: Column) -> tuple[Column, Column]:
    """Two aggregates that are the same for the same set of rows in any order: the xor and the sum of halves of row digests."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("~")) for p in parts)), 256)
    number = lambda at, n: F.conv(F.substring(row, at, n), 16, 10).cast("long")
    return F.bit_xor(number(1, 15)), F.sum(number(16, 8))


def entry_digests(entries: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """n and an order-free digest of the entries, for each of `by`."""
    x, s = set_digest(*(F.col(c) for c in columns))
    return entries.groupBy(*by).agg(F.count("*").alias("n"), F.concat_ws(":", F.count("*").cast("string"), x.cast("string"), s.cast("string")).alias("digest"))


def release_manifest(entries: DataFrame, routed: DataFrame, declared: dict, columns: list[str]) -> dict:
    """The release manifest as one record: what is counted here, and what must be declared for it. A missing field is refused.

    entries: instance, split, label, generator, dataset and the other columns of the digest; routed: instance, e_code.
    Beside the order-free digest, entries has the root and depth of their Merkle tree, against which a holder of one entry can prove it
    (merkle.proof) and two releases can be compared. declared: corpus_version, spec_versions, origins (each generator and dataset with LICENCES), selectors,
    rederivation (REDERIVATION) and views.
    """
    if lacking := [f for f in MANIFEST if f not in declared and f not in ("entries", "splits")]:
        raise ValueError(f"the manifest lacks {lacking}")
    if lacking := [f for f in REDERIVATION if f not in declared["rederivation"]]:
        raise ValueError(f"re-derivation lacks {lacking}")
    names = {f"{c}:{r[0]}" for c in ("generator", "dataset") for r in entries.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().collect()}
    if lacking := sorted(n for n in names if not set(LICENCES) <= set(declared["origins"].get(n, {}))):
        raise ValueError(f"licences lack for {lacking}")
    whole = entry_digests(entries, [], columns).first()
    codes = {r["e_code"]: r["n"] for r in routed.groupBy("e_code").agg(F.count("*").alias("n")).collect()}
    splits = [r.asDict() for r in entry_digests(entries, ["split", "label"], columns).orderBy("split", "label").collect()]
    depth = merkle.depth_of(whole["n"])
    root = merkle.root(merkle.tree(merkle.leaves(entries, "instance", [c for c in columns if c != "instance"]), depth))
    return {**declared, "entries": {"n": whole["n"], "digest": whole["digest"], "root": root, "depth": depth, "routed": codes}, "splits": splits}


def manifest_row(entries: DataFrame, routed: DataFrame, declared: dict, columns: list[str]) -> DataFrame:
    """release_manifest as a row (corpus_version, manifest), for readers.write_manifest."""
    found = release_manifest(entries, routed, declared, columns)
    return entries.sparkSession.createDataFrame([(found["corpus_version"], json.dumps(found, sort_keys=True))], "corpus_version string, manifest string")
