"""Pairs of overlapping boxes of two tables, by grid buckets of several sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of the finest cells; each coarser level's are STEP times as wide.
CELL, STEP = 32, 4
BOX = ("top", "left", "bottom", "right")


def _level(cell: int) -> Column:
    """The finest level of whose cells a box spans at most two each way."""
    extent = F.greatest(F.col("bottom") - F.col("top"), F.col("right") - F.col("left")).cast("double")
    return F.greatest(F.lit(0), F.ceil(F.round(F.log(extent / cell) / math.log(STEP), 9))).cast("int")


def overlap_join(a: DataFrame, b: DataFrame, key: str, on: list[str], cell: int = CELL) -> DataFrame:
    """(on, key_a, key_b, area) of every box of a and box of b that share a place: same `on`, common area above 0.

    Boxes are half open, in whole numbers: (top, left, bottom, right). A box lies in at most four cells of its own level; it is
    laid out on coarser levels too, of those that occur, so that a pair meets on the coarser one's level and a large box is never
    cut into many cells. Only the cell that holds the upper left corner of what both share counts, so no pair
    comes twice. The join is on equal cells: no product of the tables, and a crowded cell is split like any hot key. It is sorted
    on both sides, never broadcast: Spark would go by the size of the files, which doesn't tell how many cells are laid out.

    Empty boxes, boxes with a null and rows with a null in `on` overlap nothing; repeated rows give repeated pairs.
    """
    sound = lambda df: df.select(*on, key, *(F.col(c).cast("long").alias(c) for c in BOX)).where("bottom > top and right > left").withColumn("__level", _level(cell))
    a, b = sound(a), sound(b)
    # A level for each power of STEP, so a few tens at most.
    levels = sorted(r[0] for r in a.select("__level").union(b.select("__level")).distinct().collect())

    def laid(df: DataFrame, side: str) -> DataFrame:
        known = F.array(*(F.lit(x) for x in levels)) if levels else F.array().cast("array<int>")
        wide = df.withColumn("__at", F.explode(F.filter(known, lambda x: x >= F.col("__level"))))
        size = F.pow(F.lit(float(STEP)), F.col("__at")).cast("long") * cell
        wide = wide.withColumn("__size", size)
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / F.col("__size")), F.floor((F.col(hi) - 1) / F.col("__size"))))
        wide = wide.withColumn("__row", span("top", "bottom")).withColumn("__column", span("left", "right"))
        own = (F.col("__at") == F.col("__level")).alias(f"__own_{side}")
        return wide.select(*on, "__at", "__row", "__column", "__size", own, F.col(key).alias(f"{key}_{side}"), *(F.col(c).alias(f"__{c}_{side}") for c in BOX))

    met = laid(a, "a").join(laid(b, "b").drop("__size").hint("merge"), [*on, "__at", "__row", "__column"])
    top, left = F.greatest("__top_a", "__top_b"), F.greatest("__left_a", "__left_b")
    height, width = F.least("__bottom_a", "__bottom_b") - top, F.least("__right_a", "__right_b") - left
    here = (F.floor(top / F.col("__size")) == F.col("__row")) & (F.floor(left / F.col("__size")) == F.col("__column"))
    found = met.where((F.col("__own_a") | F.col("__own_b")) & (height > 0) & (width > 0) & here)
    return found.select(*on, f"{key}_a", f"{key}_b", (height * width).alias("area"))
