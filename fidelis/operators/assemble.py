"""Corpus assembly: splits, quarantine, balancing, matching and the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions.stats import hash_uniform
from fidelis.operators.assurance import set_digest
from fidelis.operators.guard import guard
from fidelis.operators.ranges import ranked_by_digest

ENTRY = ("instance", "chosen_answer", "rationale", "label", "state", "split", "source", "generator")


def assemble(labelled: DataFrame, required: tuple[str, ...] = ENTRY) -> DataFrame:
    """Corpus entries; an incomplete one stops the run, it is not routed aside."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return guard(labelled, ok, "incomplete corpus entry")


def scene_split(scene: Column, train: float = 0.7, validation: float = 0.15) -> Column:
    """train, validation or iid-test by a digest of the scene, so that a scene is never divided."""
    u = hash_uniform(F.lit("split"), scene)
    return F.when(u < train, "train").when(u < train + validation, "validation").otherwise("iid-test")


def assign_splits(entries: DataFrame, families: list[str], datasets: list[str], qtypes: list[str]) -> DataFrame:
    """One split for each entry: held-out generator, held-out dataset, held-out question type, else by scene.

    A scene that holds a held-out question type anywhere leaves train and validation as a whole.
    """
    closed = entries.where(F.col("qtype").isin(*qtypes)).select("scene").distinct().withColumn("__closed", F.lit(True))
    split = (
        F.when(F.col("generator").isin(*families), "ood-model").when(F.col("dataset").isin(*datasets), "ood-dataset")
        .when(F.col("qtype").isin(*qtypes), "ood-qtype").when(F.col("__closed"), "iid-test").otherwise(scene_split(F.col("scene")))
    )
    return entries.join(closed, "scene", "left").withColumn("split", split).select(*entries.columns, "split")


def balance(entries: DataFrame, splits: tuple[str, ...] = ("train", "validation"), key: str = "instance") -> DataFrame:
    """The given splits cut down to equal classes, choosing by digest of the key; the other splits as they are.

    Classes are the labels of all entries: a split that lacks one can't be balanced and is left without entries.
    """
    classes = entries.where("label is not null").select("label").distinct().agg(F.count("*").alias("__classes"))
    sizes = entries.where(F.col("split").isin(*splits)).groupBy("split", "label").agg(F.count("*").alias("n"))
    least = sizes.groupBy("split").agg(F.min("n").alias("quota"), F.count("label").alias("__held")).crossJoin(F.broadcast(classes))
    least = least.select("split", F.when(F.col("__held") < F.col("__classes"), 0).otherwise(F.col("quota")).alias("quota"))
    ranked = ranked_by_digest(entries, ["split", "label"], key, "__rank").join(F.broadcast(least), "split", "left")
    return ranked.where(F.col("quota").isNull() | (F.col("__rank") <= F.col("quota"))).drop("__rank", "quota")


def quarantine(entries: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Entries whose record no calibration has touched."""
    return entries.join(touched.select(key).distinct(), key, "left_anti")


def matched_pairs(entries: DataFrame, stratum: list[str], label: str, key: str, salt: str = "") -> DataFrame:
    """Negatives and positives paired within strata by rank; rank by digest of the salt and the key. What has no partner is left.

    Another salt gives another pairing at random, as a control sample with the same strata.
    """
    ranked = ranked_by_digest(entries.select(*stratum, label, key), [*stratum, label], key, "rank", salt)
    of = lambda value: F.max(F.when(F.col(label) == value, F.col(key)))
    return ranked.groupBy(*stratum, "rank").agg(of(0).alias("negative"), of(1).alias("positive")).where("negative is not null and positive is not null")


def totality(candidates: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Candidates without an outcome, outcomes without a candidate, and keys with several outcomes; one row."""
    n = outcomes.groupBy(key).agg(F.count("*").alias("n"))
    both = candidates.select(key, F.lit(1).alias("c")).join(n, key, "full_outer")
    return both.agg(
        F.count_if(F.col("n").isNull()).alias("unresolved"), F.count_if(F.col("c").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(F.col("c").isNotNull() & (F.col("n") == 1)).alias("resolved"),
    )


def disjointness(entries: DataFrame, column: str) -> DataFrame:
    """Pairs of splits, and how many values of the column they share."""
    seen = entries.select("split", column).distinct()
    a, b = seen.withColumnRenamed("split", "split_a"), seen.withColumnRenamed("split", "split_b")
    return a.join(b, column).where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


def control_sample(entries: DataFrame, stratum: list[str], label: str, key: str, share: float, salt: str = "control") -> DataFrame:
    """Pairs as matched_pairs has them, drawn at random: of each stratum's, the first by a salted digest, at least the share of them."""
    pairs = matched_pairs(entries, stratum, label, key, salt)
    most = pairs.groupBy(*stratum).agg(F.max("rank").alias("__most"))
    kept = pairs.withColumn("__s", F.struct(*stratum)).join(most.withColumn("__s", F.struct(*stratum)).select("__s", "__most"), "__s")
    return kept.where(F.col("rank") <= F.ceil(F.col("__most") * share)).drop("__s", "__most")


def manifest(entries: DataFrame, columns: list[str]) -> DataFrame:
    """Counts and an order-free digest of each split and class, with all subtotals."""
    x, s = set_digest(*(F.col(c) for c in columns))
    digest = F.concat_ws(":", F.count("*").cast("string"), x.cast("string"), s.cast("string"))
    return entries.rollup("split", "label").agg(F.count("*").alias("n"), F.countDistinct("generator").alias("generators"), F.countDistinct("scene").alias("scenes"), digest.alias("digest"))
