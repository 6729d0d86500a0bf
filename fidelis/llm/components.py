"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import Scratch


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """One star round over links (u, v), u > v: each node's neighbours move to the least of them and itself.

    Minima are partially aggregated before the shuffle. They meet the links by a key of another name and value,
    so that both sides of the join are shuffled for it alone and a hub's share can be split.
    """
    ends = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else links
    least = ends.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
    key = F.col("u").bitwiseXOR(F.lit(1)).alias("k")
    moved = ends.select(key, "u", "v").join(least.select(key, "m"), "k")
    if larger:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the least reachable node.

    Each round is written to the shared folder, which cuts the lineage. Rounds grow with the logarithm of
    the longest chain. Self-links and repeated links are harmless; an empty table gives an empty result.
    """
    marks = {"x": F.bit_xor(F.xxhash64("u", "v")), "s": F.sum(F.xxhash64("v", "u") % 1_000_003)}
    now = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", **marks)
    while now.said["n"]:
        old, now = now, scratch.write(_stars(_stars(now, True), False), "stars", **marks)
        scratch.drop(old)
        if now.said == old.said:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
