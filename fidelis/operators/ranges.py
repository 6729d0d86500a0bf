"""Running sums, maxima and minima over a global order, and ranks within groups, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.sources.scratch import Scratch

#: Hexadecimal digits of a digest that deal a group's rows out: 4096 shares.
DIGITS = 3


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its column over all rows before, in the given order.

    Rows are ranged by the order and written once, with the number of their range, as two reads of a sampled
    ranging need not agree. A window sums each range by itself; the ranges' totals, one row for each, give the rest.
    Rows of equal order are taken in any order.
    """
    values = {f"__v_{n}": c.cast("long") for n, c in sums.items()}
    ranged = df.withColumns(values).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = Scratch(df.sparkSession, "ranges").write(ranged, "ranged")
    totals = ranged.groupBy("__part").agg(*(F.sum(v).alias(f"__t_{v}") for v in values))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__part", *(F.coalesce(F.sum(f"__t_{v}").over(earlier), F.lit(0)).alias(f"__b_{v}") for v in values))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({f"__w_{v}": F.coalesce(F.sum(v).over(own), F.lit(0)) for v in values}).join(F.broadcast(before), "__part")
    out = out.withColumns({n: F.col(f"__b___v_{n}") + F.col(f"__w___v_{n}") for n in sums})
    return out.select(*df.columns, *sums)


def ranked_by_digest(df: DataFrame, group: list[str], key: str, name: str, salt: str = "") -> DataFrame:
    """df with the 1-based rank of each row within its group, by digest of the salt and the key, and then the key.

    A group is dealt out by its digests' first digits, which are in order and of even size, so one that holds most
    rows is many tasks; a share's rank is its own plus the sizes of the group's earlier shares.
    """
    # A struct is never null itself, so the join's keys are those that the rows are already dealt out by.
    own = ["__group", "__share"]
    digest = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    keyed = df.withColumns({"__group": F.struct(*group), "__digest": digest, "__share": F.coalesce(F.substring(digest, 1, DIGITS), F.lit(""))})
    ranked = keyed.withColumn("__nth", F.row_number().over(Window.partitionBy(*own).orderBy("__digest", key)))
    sizes = ranked.groupBy(*own).agg(F.max("__nth").alias("__n"))
    earlier = Window.partitionBy("__group").orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*own, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return ranked.join(sizes, own).withColumn(name, (F.col("__before") + F.col("__nth")).cast("long")).select(*df.columns, name)


_FOLDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


class Ranged:
    """A table in ranges of an order within groups, written once, over which values are carried from range to range.

    A group of any size lies in many ranges, each one task's; what ranges tell each other is a row for each range and group.
    `rows` has the columns of the table and three of its own, which `carried` needs and `plain` takes off.
    """

    OWN = ("__part", "__by")

    def __init__(self, df: DataFrame, by: list[str], order: list[Column], **sums: Column):
        self.by, self.order, self.columns = by, order, df.columns
        keyed = df.withColumn("__by", F.struct(*by) if by else F.struct(F.lit(0).alias("all")))
        ranged = keyed.repartitionByRange(F.col("__by"), *order).withColumn("__part", F.spark_partition_id())
        self.scratch = Scratch(df.sparkSession, "ranges")
        self.rows = self.scratch.write(ranged, "ranged", **sums)
        self.said = self.rows.said

    def totals(self, rows: DataFrame, values: dict[str, tuple[str, Column]], later: bool = False) -> DataFrame:
        """For each range and group its values (`__t_`), and those of the group's earlier (or later) ranges (`__f_`)."""
        sums = rows.groupBy(*self.OWN).agg(*(_FOLDS[k][0](c).alias(f"__t_{n}") for n, (k, c) in values.items()))
        others = Window.partitionBy("__by").orderBy(F.desc("__part") if later else F.col("__part")).rowsBetween(Window.unboundedPreceding, -1)
        return sums.select("*", *(_FOLDS[k][0](f"__t_{n}").over(others).alias(f"__f_{n}") for n, (k, _) in values.items()))

    def carried(self, rows: DataFrame, values: dict[str, tuple[str, Column]], later: bool = False) -> DataFrame:
        """rows with, for each name, the sum, max or min over the group's rows up to this one, or from it on; null where there is none."""
        held = rows.withColumns({f"__v_{n}": c for n, (_, c) in values.items()})
        named = {n: (k, F.col(f"__v_{n}")) for n, (k, _) in values.items()}
        far = self.totals(held, named, later).select(*self.OWN, *(f"__f_{n}" for n in values))
        flip = lambda c: c.desc() if later else c
        own = Window.partitionBy(*self.OWN).orderBy(*map(flip, self.order)).rowsBetween(Window.unboundedPreceding, 0)
        near = held.withColumns({f"__w_{n}": _FOLDS[k][0](f"__v_{n}").over(own) for n, (k, _) in values.items()})
        both = near.join(far, list(self.OWN))
        return both.select(*rows.columns, *(_FOLDS[k][1](F.col(f"__w_{n}"), F.col(f"__f_{n}")).alias(n) for n, (k, _) in values.items()))

    def of_groups(self, rows: DataFrame, values: dict[str, Column]) -> DataFrame:
        """rows with sums over their whole group."""
        totals = rows.groupBy("__by").agg(*(F.sum(c).alias(n) for n, c in values.items()))
        return rows.join(totals, "__by")
