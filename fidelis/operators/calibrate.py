"""Thresholds from control distributions; exact quantiles throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions.stats import binomial_tail
from fidelis.operators.evaluate import auroc
from fidelis.operators.guard import guard
from fidelis.operators.quantiles import quantiles, quantiles_of

# The registered rules.
LEAST_SAMPLE, LEAST_IQR, LEAST_TARGETED, MOST_CONTROL, SPURIOUS = 250, 0.05, 0.25, 0.10, 0.05


def fold(pos: Column) -> Column:
    return F.when(pos % 2 == 0, "calibration").otherwise("verification")


def median_iqr(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median and interquartile range of each group."""
    found = quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    return found.select(*by, "median", (F.col("q3") - F.col("q1")).alias("iqr"))


def theta_midpoint(drifts: DataFrame, least: int = LEAST_SAMPLE) -> DataFrame:
    """One row: theta between the medians of targeted and control drift, the viability evidence and the verdict."""
    found = quantiles_of(drifts, {"mt": ("targeted", 0.5), "mc": ("control", 0.5), "q1": ("targeted", 0.25), "q3": ("targeted", 0.75)})
    medians = drifts.agg(F.count("*").alias("n")).crossJoin(F.broadcast(found)).withColumn("targeted_iqr", F.col("q3") - F.col("q1"))
    medians = guard(medians, F.col("n") >= least, "too few pairs to calibrate").withColumn("theta", (F.col("mt") + F.col("mc")) / 2)
    shares = drifts.crossJoin(F.broadcast(medians.select("theta"))).agg(
        F.avg((F.col("targeted") >= F.col("theta")).cast("double")).alias("targeted_share"), F.avg((F.col("control") >= F.col("theta")).cast("double")).alias("control_share"),
    )
    viable = (F.col("theta") > 0) & (F.col("targeted_iqr") >= LEAST_IQR) & (F.col("targeted_share") >= LEAST_TARGETED) & (F.col("control_share") <= MOST_CONTROL)
    return medians.crossJoin(shares).withColumn("viable", viable).select("n", "theta", "targeted_iqr", "targeted_share", "control_share", "viable")


def theta_p90(drifts: DataFrame, control: str = "control") -> DataFrame:
    return quantiles(drifts, control, {"theta": 0.9}).select("theta")


def saliency_floor(drops: DataFrame, drop: str = "max_drop") -> DataFrame:
    return quantiles(drops, drop, {"floor": 0.1}).select("floor")


def choose_k_agreement(agreement: DataFrame, grid: tuple[int, ...] = (2, 3)) -> DataFrame:
    """The k of largest agreement, the larger on ties; k and agreement must cover the grid and nothing else."""
    picked = agreement.agg(F.max_by("k", F.struct("agreement", "k")).alias("k"), F.array_sort(F.collect_set("k")).alias("seen"))
    return guard(picked, F.col("seen") == F.array(*(F.lit(k).cast("long") for k in sorted(grid))), "agreement must cover the grid").select("k")


def choose_k_binomial(noise: DataFrame, p: str = "p_noise", grid: tuple[int, ...] = (2, 3), n: int = 4, most: float = SPURIOUS) -> DataFrame:
    """The smallest k whose chance of k or more of n spurious flips is small enough; null if none is."""
    k = F.coalesce(*(F.when(binomial_tail(n, k, F.col(p)) <= most, F.lit(k).cast("long")) for k in sorted(grid)))
    return noise.withColumn("k", k)


# Drift instruments from the one of least risk to that of most, and how near AUROCs tie.
INSTRUMENTS, NEAR = ("jaccard-content", "embed-cosine", "nli-bidir", "bertscore-baseline"), 0.01


def choose_instrument(drifts: DataFrame, instruments: tuple[str, ...] = INSTRUMENTS, near: float = NEAR) -> DataFrame:
    """The instrument, of drifts (instrument, targeted, control), of largest AUROC of targeted against control drift.

    Only those whose median paired difference is positive can be chosen; of those nearer than `near` to the best of
    these, the one of least risk. One row for each instrument: auroc, delta, chosen.
    """
    long = drifts.select("instrument", F.explode(F.array(F.struct(F.col("targeted").alias("s"), F.lit(1).alias("t")), F.struct(F.col("control").alias("s"), F.lit(0).alias("t")))).alias("x")).select("instrument", "x.*")
    delta = quantiles(drifts, F.col("targeted") - F.col("control"), {"delta": 0.5}, ["instrument"]).select("instrument", "delta")
    found = auroc(long, "s", "t", ["instrument"]).select("instrument", "auroc").join(delta, "instrument")
    risk = F.array_position(F.array(*map(F.lit, instruments)), F.col("instrument"))
    able = found.where("delta > 0").select("instrument", "auroc", risk.alias("risk")).where("risk > 0")
    best = able.crossJoin(F.broadcast(able.agg(F.max("auroc").alias("most")))).where(F.col("auroc") >= F.col("most") - near).agg(F.min_by("instrument", "risk").alias("winner"))
    return found.crossJoin(F.broadcast(best)).select("instrument", "auroc", "delta", F.coalesce(F.col("instrument") == F.col("winner"), F.lit(False)).alias("chosen"))
