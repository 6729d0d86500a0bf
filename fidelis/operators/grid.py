"""Boxes on an 8x8 grid: cells, evidence regions, control boxes and control tiles. All in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDE, SHARE, TILE, LEAST_COVER = 8, 0.5, 16, 0.25


def cell_box(row: Column, col: Column, height: Column, width: Column) -> Column:
    edge = lambda i, n: F.floor(i * n / SIDE).cast("long")
    return F.struct(edge(row, height).alias("top"), edge(col, width).alias("left"), edge(row + 1, height).alias("bottom"), edge(col + 1, width).alias("right"))


def sweep(images: DataFrame) -> DataFrame:
    """A row for each image and grid cell."""
    cells = images.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SIDE * SIDE - 1).cast("long"))))
    return cells.withColumn("row", F.floor(F.col("cell") / SIDE)).withColumn("col", F.col("cell") % SIDE)


def localize(drops: DataFrame, key: str, floor: float) -> DataFrame:
    """The evidence box of each image with a drop of at least the floor, from long (key, row, col, drop, height, width).

    It bounds the cells of at least SHARE of the largest drop. Images below the floor are missing.
    """
    most = drops.withColumn("max_drop", F.max("drop").over(Window.partitionBy(key)))
    box = cell_box(F.col("row"), F.col("col"), F.col("height"), F.col("width"))
    kept = most.where((F.col("max_drop") >= floor) & (F.col("drop") >= SHARE * F.col("max_drop"))).withColumn("b", box)
    return kept.groupBy(key).agg(F.min("b.top").alias("top"), F.min("b.left").alias("left"), F.max("b.bottom").alias("bottom"), F.max("b.right").alias("right"), F.max("max_drop").alias("max_drop"), F.count("*").alias("n_cells"))


def control_box(top: Column, left: Column, bottom: Column, right: Column, height: Column, width: Column) -> Column:
    """The farthest box of the evidence box's size that lies wholly above, below, left or right of it, at the image's
    edge; the first of these on ties; null where none has room."""
    h, w = bottom - top, right - left
    at_col, at_row = F.greatest(F.lit(0), F.least(left, width - w)), F.greatest(F.lit(0), F.least(top, height - h))
    places = ((top >= h, F.lit(0), at_col), (height - bottom >= h, height - h, at_col), (left >= w, at_row, F.lit(0)), (width - right >= w, at_row, width - w))
    sq = lambda x: x * x
    ranked = [
        F.when(ok, F.struct((sq(r - top) + sq(c - left)).cast("long").alias("d"), F.lit(-i).alias("o"), r.cast("long").alias("top"), c.cast("long").alias("left"), (r + h).cast("long").alias("bottom"), (c + w).cast("long").alias("right")))
        for i, (ok, r, c) in enumerate(places)
    ]
    best = F.array_max(F.array(*ranked))
    return F.when(best.isNotNull(), F.struct(best["top"].alias("top"), best["left"].alias("left"), best["bottom"].alias("bottom"), best["right"].alias("right")))


def control_patches(boxes: DataFrame) -> DataFrame:
    """Each image with its control tiles, from (top, left, bottom, right, height, width).

    Tiles are free grid squares in reading order, as many as the evidence area asks for. That is the first
    ceil(area / tile area) of the free ones, so no running sum over exploded tiles is needed.
    """
    steps = lambda n: F.when(n >= TILE, F.sequence(F.lit(0).cast("long"), n.cast("long") - TILE, F.lit(TILE).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tile = lambda r, c: F.struct(r.alias("top"), c.alias("left"), (r + TILE).alias("bottom"), (c + TILE).alias("right"))
    every = F.flatten(F.transform(steps(F.col("height")), lambda r: F.transform(steps(F.col("width")), lambda c: tile(r, c))))
    free = F.filter(every, lambda t: (t["bottom"] <= F.col("top")) | (t["top"] >= F.col("bottom")) | (t["right"] <= F.col("left")) | (t["left"] >= F.col("right")))
    area = (F.col("bottom") - F.col("top")) * (F.col("right") - F.col("left"))
    wanted = F.ceil(area / (TILE * TILE)).cast("int")
    out = boxes.withColumn("patches", F.slice(free, F.lit(1), wanted)).withColumn("covered", F.size("patches").cast("long") * TILE * TILE)
    return out.withColumn("coverage", F.bround(F.col("covered") / area, 4)).withColumn("applicable", F.col("covered") >= LEAST_COVER * area)


def common_span(before: Column, after: Column) -> Column:
    """(start, end) of what `after` has that `before` lacks: between their common prefix and common suffix."""
    limit = F.least(F.size(before), F.size(after))

    def run(a: Column, b: Column, most: Column) -> Column:
        same = F.zip_with(F.slice(a, F.lit(1), most), F.slice(b, F.lit(1), most), lambda x, y: x == y)
        first = F.array_position(same, F.lit(False))
        return F.when(first == 0, most).otherwise((first - 1).cast("int"))

    prefix = run(before, after, limit)
    suffix = run(F.reverse(before), F.reverse(after), F.greatest(limit - prefix, F.lit(0)))
    return F.struct(prefix.cast("long").alias("start"), (F.size(after) - suffix).cast("long").alias("end"))


def refine_span(ids: Column, start: Column, end: Column, reply: Column, decode) -> Column:
    """The shortest sub-span whose decoded text, stripped, is the reply, with the number of such spans.

    decode: a function from an array column to a string column. A count other than 1 is for the caller to refuse.
    """
    spans = F.flatten(F.transform(F.sequence(start, end - 1), lambda s: F.transform(F.sequence(s + 1, end), lambda e: F.struct((e - s).alias("len"), s.alias("s"), e.alias("e")))))
    hits = F.filter(spans, lambda x: F.trim(decode(F.slice(ids, x["s"].cast("int") + 1, x["len"].cast("int")))) == reply)
    best = F.array_min(hits)
    return F.struct(best["s"].alias("start"), best["e"].alias("end"), F.size(F.filter(hits, lambda x: x["len"] == best["len"])).cast("long").alias("n"))
