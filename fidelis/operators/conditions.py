"""Readings folded to one verdict per subject, and the branch table that gives each subject one outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions.stats import baseline_held
from fidelis.operators.guard import guard

K_GRID, DESTRUCTIVE, HFLIP = (2, 3), 4, 5


def fold_readings(readings: DataFrame, key: str = "instance", *also: Column) -> DataFrame:
    """One row per subject of long readings (key, regime, scores, baseline).

    Regimes 1 to DESTRUCTIVE should move the answer; HFLIP should not. One pass: counts and sums are partial
    before the shuffle. flip_count is null while a destructive regime is absent or null. A regime that is there twice for
    a subject stops the run, as it would stand for one that is missing. also: further aggregates.
    """
    held = baseline_held(F.col("scores"), F.col("baseline"))
    destructive = F.col("regime") <= DESTRUCTIVE
    known = F.col("regime").between(1, HFLIP)
    sums = readings.groupBy(key).agg(
        F.count_if(known).alias("__readings"),
        F.bit_or(F.when(known, F.expr("shiftleft(1, cast(regime as int))"))).alias("__regimes"),
        F.count_if(destructive).alias("n_destructive"),
        F.count_if(destructive & held.isNull()).alias("n_null"),
        F.count_if(destructive & ~held).alias("n_flips"),
        F.max(F.when(F.col("regime") == HFLIP, held)).alias("hflip_held"),
        *also,
    )
    once = guard(sums, F.col("__readings") == F.coalesce(F.bit_count("__regimes"), F.lit(0)), "a regime was read twice for a subject").drop("__readings", "__regimes")
    return once.withColumn("flip_count", F.when((F.col("n_destructive") >= DESTRUCTIVE) & (F.col("n_null") == 0), F.col("n_flips")))


def condition_a(flip_count: Column, k: int) -> Column:
    if k not in K_GRID:
        raise ValueError(f"k must be one of {K_GRID}")
    return F.when(flip_count.isNull(), "INDETERMINATE").when(flip_count >= k, "TRUE").otherwise("FALSE")


def condition_b(df: DataFrame, drift: str, theta: str, name: str = "tracks") -> DataFrame:
    """Whether the drift reaches theta; an infinite or missing drift, or a theta of 0 or less, stops the run."""
    finite = F.col(drift).isNotNull() & ~F.isnan(drift) & (F.abs(drift) < float("inf"))
    return guard(df, finite & (F.col(theta) > 0), "drift must be finite and theta positive").withColumn(name, F.col(drift) >= F.col(theta))


def resolve(e_code: Column, verdict_a: Column, locatable: Column, controls_hold: Column, tracks: Column) -> Column:
    """S1, S2, S3 or E1 to E6: text gates, then readings, then for A false the answer side's controls, for A true
    place, controls and tracking, in that order. Correctness of the answer plays no part."""
    return (
        F.when(e_code.isNotNull(), e_code).when(verdict_a == "INDETERMINATE", "E4")
        .when(verdict_a == "FALSE", F.when(controls_hold, "S1").otherwise("E6"))
        .when(~F.coalesce(locatable, F.lit(False)), "E5").when(~controls_hold, "E6").when(tracks, "S3").otherwise("S2")
    )


def label_of(resolution: Column) -> Column:
    return F.when(resolution.isin("S1", "S2"), "unfaithful").when(resolution == "S3", "faithful")


def reason_of(resolution: Column) -> Column:
    return F.when(resolution == "S1", "D1").when(resolution == "S2", "D2")


def legal_seal() -> Column:
    """Whether a sealed row (resolution parts state, label, reason_code, e_code, spec_versions) is one of the legal ones."""
    state, label, reason, code = (F.col(c) for c in ("state", "label", "reason_code", "e_code"))
    routed = code.isin("E1", "E2", "E3", "E4", "E5", "E6") & state.isNull() & label.isNull() & reason.isNull()
    row = lambda s, y, r: (state == s) & (label == y) & reason.eqNullSafe(F.lit(r))
    labelled = code.isNull() & (row("S1", "unfaithful", "D1") | row("S2", "unfaithful", "D2") | row("S3", "faithful", None))
    return F.coalesce((routed | labelled) & (F.size("spec_versions") > 0), F.lit(False))
