"""Matching of two classes by the nearest score, without replacement and within a caliper, over ranges of any size."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.operators.ranges import Ranged
from fidelis.sources.scratch import Scratch

ORDER = ("__score", "__key")


def _balanced(df: DataFrame, stratum: list[str], caliper: float) -> DataFrame:
    """df with the chain that a row is in, the level that it crosses and whether it opens that level.

    A chain is a run of rows of which neighbours lie within the caliper. In a chain each positive is a step up and each
    negative one down; crossings of a level alternate, so that a row either opens its level, away from the start, or
    closes it, back to it.
    """
    held = Ranged(df, stratum, [F.col(c) for c in ORDER])
    here = Window.partitionBy(*held.OWN).orderBy(*ORDER)
    far = held.totals(held.rows, {"score": ("max", F.col("__score"))}).select(*held.OWN, "__f_score")
    stepped = held.rows.join(far, list(held.OWN)).withColumn("__last", F.coalesce(F.lag("__score").over(here), F.col("__f_score"))).drop("__f_score")
    stepped = stepped.withColumn("__first", F.col("__last").isNull() | (F.col("__score") - F.col("__last") > caliper)).drop("__last")
    step = F.when(F.col("__up"), 1).otherwise(-1)
    summed = held.scratch.write(held.carried(stepped, {"__chain": ("sum", F.col("__first").cast("long")), "__sum": ("sum", step.cast("long"))}), "summed")
    began = F.when(F.col("__first"), F.struct("__chain", (F.col("__sum") - step).alias("base")))
    based = held.carried(summed, {"__began": ("max", began)})
    after = F.col("__sum") - F.col("__began.base")
    level = F.least(after, after - step)
    return based.select(*df.columns, "__chain", level.alias("__level"), ((level >= 0) == F.col("__up")).alias("__opens"))


def _round(df: DataFrame, stratum: list[str], caliper: float) -> DataFrame:
    """(stratum, opener, closer), structs of score, key and class: each closing row with the row that opened its level, if within the caliper."""
    placed = _balanced(df, stratum, caliper)
    held = Ranged(placed, [*stratum, "__chain", "__level"], [F.col(c) for c in ORDER])
    me = F.struct(F.col("__score"), F.col("__key"), F.col("__up"))
    met = held.carried(held.rows, {"__opener": ("max", F.when(F.col("__opens"), me))})
    near = ~F.col("__opens") & (F.col("__score") - F.col("__opener.__score") <= caliper)
    return met.where(near).select(*stratum, "__opener", me.alias("__closer"))


def nearest_pairs(entries: DataFrame, stratum: list[str], label: str, key: str, score: str, caliper: float) -> DataFrame:
    """(stratum, negative, positive, distance): rows of label 0 and 1 paired by score within strata, each row at most once.

    Within a chain of near scores the crossings of levels are paired, which in a chain of as many negatives as positives
    makes the sum of distances the least. Pairs beyond the caliper are undone, and what has no partner is matched again, until a
    round adds none: the first change of class in a chain is always a pair of neighbours, so rounds end, and then no negative
    and positive that are left lie within the caliper of each other. Rounds work on what is left, which soon is little.

    Nulls in score, label or key, NaN scores and other labels take no part; a null in the stratum is a stratum. Keys are unique within a
    stratum. Ties of score are in the order of keys. A stratum, a chain or a level of any size is many ranges' work.
    """
    if caliper < 0:
        raise ValueError("the caliper is a distance")
    usable = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(key).isNotNull() & F.col(label).isin(0, 1)
    left = entries.where(usable).select(*stratum, F.col(key).alias("__key"), F.col(score).cast("double").alias("__score"), (F.col(label) == 1).alias("__up"))
    scratch, found = Scratch(entries.sparkSession, "matching"), []
    while True:
        pairs = scratch.write(_round(left, stratum, caliper), f"pairs_{len(found)}")
        found.append(pairs)
        if not pairs.said["n"]:
            break
        gone = pairs.select(*stratum, F.explode(F.array("__opener.__key", "__closer.__key")).alias("__key"))
        # Strata may be null, so they meet as structs.
        of = lambda df: df.withColumn("__at", F.struct(*stratum, "__key"))
        left = scratch.write(of(left).join(of(gone).select("__at"), "__at", "left_anti").drop("__at"), f"left_{len(found)}")
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    is_up = F.col("__closer.__up")
    ends = [F.when(is_up == flip, F.col("__closer.__key")).otherwise(F.col("__opener.__key")).alias(name) for name, flip in (("negative", False), ("positive", True))]
    return every.select(*stratum, *ends, (F.col("__closer.__score") - F.col("__opener.__score")).alias("distance"))


def selector(stratum: list[str], label: str, key: str, score: str, caliper: float) -> Column:
    """What a manifest records of a matched subset: the rule and its parameters, from which membership can be made again."""
    rule = {"rule": "nearest-score, without replacement", "stratum": stratum, "label": label, "key": key, "score": score, "caliper": caliper}
    return F.lit(json.dumps(rule, sort_keys=True))


def matched_membership(entries: DataFrame, pairs: DataFrame, stratum: list[str], key: str) -> DataFrame:
    """The entries that are in a pair; balanced, as each pair has one of either class."""
    of = lambda df, k: df.withColumn("__at", F.struct(*stratum, k))
    both = pairs.select(*stratum, F.explode(F.array("negative", "positive")).alias("__key"))
    return of(entries, key).join(of(both, F.col("__key").alias(key)).select("__at"), "__at", "left_semi").drop("__at")
