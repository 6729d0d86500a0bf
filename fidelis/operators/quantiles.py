"""Exact quantiles and the resampled interval of a median, by selection of ranks over ranges of values."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.operators.ranges import Ranged


class Selection:
    """The values of a column, counted by (group, value) and laid out in ranges; ranks are looked up in the ranges that hold them.

    Nulls are no values. Values are taken as doubles; NaN is larger than any other.
    """

    def __init__(self, df: DataFrame, value: str | Column, by: list[str] | None = None):
        self.by = by or []
        v = (F.col(value) if isinstance(value, str) else value).cast("double")
        counts = df.select(*self.by, v.alias("__x")).groupBy(*self.by, "__x").agg(F.count("__x").alias("__n"))
        self.ranged = Ranged(counts, self.by, [F.col("__x")], all=F.coalesce(F.sum("__n"), F.lit(0)))
        #: Of all groups together.
        self.n = self.ranged.said["all"]

    def ranks(self, wanted: Callable[[Column], Column]) -> DataFrame:
        """(group, n, rank, value) for 0-based ranks; wanted gives an array of them from a group's number of values, n.

        A group without values, or of which nothing is wanted, has one row of null rank. Each other one has such a row too.
        """
        held = self.ranged
        totals = held.totals(held.rows, {"n": ("sum", F.col("__n"))})
        n = totals.groupBy("__by").agg(F.sum("__t_n").alias("n"))
        placed = totals.select(*held.OWN, F.coalesce("__f_n", F.lit(0)).alias("__before"), F.col("__t_n").alias("__own")).join(n, "__by")
        inside = F.filter(F.array_distinct(wanted(F.col("n"))), lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__own")))
        placed = held.scratch.write(placed.withColumn("__wanted", inside), "placed")
        hit = placed.where(F.size("__wanted") > 0)
        # Ranges are as many as shuffle partitions, so their numbers may be listed; only theirs are read again.
        numbers = [r[0] for r in hit.select("__part").distinct().collect()]
        up_to = Window.partitionBy(*held.OWN).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
        rows = held.rows.where(F.col("__part").isin(numbers) if numbers else F.lit(False)).withColumn("__to", F.sum("__n").over(up_to))
        own = rows.join(hit.select(*held.OWN, "__wanted", "__before", "n"), list(held.OWN)).withColumn("__end", F.col("__before") + F.col("__to"))
        found = own.select("__by", "n", F.col("__x").alias("value"), F.explode(F.filter("__wanted", lambda r: (r >= F.col("__end") - F.col("__n")) & (r < F.col("__end")))).alias("rank"))
        groups = n.select("__by", "n").withColumns({"value": F.lit(None).cast("double"), "rank": F.lit(None).cast("long")})
        every = found.select("__by", "n", "value", F.col("rank").cast("long").alias("rank")).unionAll(groups.select("__by", "n", "value", "rank"))
        return every.select(*(F.col(f"__by.{c}").alias(c) for c in self.by), "n", "rank", "value")

    def quantiles(self, wanted: dict[str, float]) -> DataFrame:
        """(group, n, and a column for each wanted quantile), linear between neighbouring ranks; null for a group without values.

        One row without groups, as an aggregate gives, on an empty table too.
        """
        at = lambda q, n: F.lit(float(q)) * (n - 1)
        low, high = (lambda q, n: F.floor(at(q, n))), (lambda q, n: F.ceil(at(q, n)))
        ranks = self.ranks(lambda n: F.array(*(f(q, n) for q in wanted.values() for f in (low, high))))
        n = F.col("n")
        pick = lambda f, q: F.max(F.when(F.col("rank") == f(q, n), F.col("value")))
        ends = [c.alias(f"__{side}_{k}") for k, q in wanted.items() for side, c in (("l", pick(low, q)), ("h", pick(high, q)))]
        found = ranks.groupBy(*self.by).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *ends)
        between = lambda k, q: F.when(F.col(f"__l_{k}") == F.col(f"__h_{k}"), F.col(f"__l_{k}")).otherwise((high(q, n) - at(q, n)) * F.col(f"__l_{k}") + (at(q, n) - low(q, n)) * F.col(f"__h_{k}"))
        return found.select(*self.by, "n", *(between(k, q).alias(k) for k, q in wanted.items()))


def quantiles(df: DataFrame, value: str | Column, wanted: dict[str, float], by: list[str] | None = None) -> DataFrame:
    return Selection(df, value, by).quantiles(wanted)


def quantiles_of(df: DataFrame, wanted: dict[str, tuple[str, float]], by: list[str] | None = None) -> DataFrame:
    """Quantiles of several columns at once, name: (column, share); one row for each group. Each column's nulls are its own."""
    by, columns = by or [], sorted({c for c, _ in wanted.values()})
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("__column"), F.col(c).cast("double").alias("__value")) for c in columns))).alias("__c")).select(*by, "__c.*")
    shares = sorted({q for _, q in wanted.values()})
    found = quantiles(long, "__value", {f"q{i}": q for i, q in enumerate(shares)}, [*by, "__column"])
    of = lambda c, q: F.max(F.when(F.col("__column") == c, F.col(f"q{shares.index(q)}")))
    return found.groupBy(*by).agg(*(of(c, q).alias(k) for k, (c, q) in wanted.items()))


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, out, m = 1e-300, 1.0, 0.0, 1.0, 0
    while True:
        k = m // 2
        if m == 0:
            term = 1.0
        elif m % 2 == 0:
            term = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            term = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 + term * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + term / c
        c = c if abs(c) > tiny else tiny
        out *= c * d
        m += 1
        if abs(1 - c * d) < 1e-13 and m > 3:
            return front * (out - 1)


def at_least(n: int, p: float, m: int) -> float:
    """The chance of m or more of n draws of chance p each."""
    return 1.0 if m <= 0 else 0.0 if m > n else _beta_tail(m, n - m + 1, p)


def resampled_rank(n: int, m: int, share: float) -> int:
    """The least 1-based rank k of n values such that a resample's m-th smallest value is at most the k-th with a chance of `share` or more."""
    low, high = 1, n
    while low < high:
        k = (low + high) // 2
        if at_least(n, k / n, m) >= share:
            high = k
        else:
            low = k + 1
    return low


def median_interval(df: DataFrame, value: str | Column, level: float = 0.95) -> DataFrame:
    """One row: n, median, low and high of the bootstrap's percentile interval of the median, without drawing.

    The m-th smallest of n values drawn from n with replacement is at most the k-th smallest of these if m or more draws
    fall among the first k: a binomial tail, which depends on ranks alone. The wanted ranks are found by bisection and
    their values by selection. Of an even number, both middle values' bounds are averaged. Nulls are no values; without any, all is null.
    """
    held = Selection(df, value)
    n = held.n
    if not n:
        return df.sparkSession.createDataFrame([(0, None, None, None)], "n long, median double, low double, high double")
    middle = [(n + 1) // 2] if n % 2 else [n // 2, n // 2 + 1]
    wanted = {"median": middle, "low": [resampled_rank(n, m, (1 - level) / 2) for m in middle], "high": [resampled_rank(n, m, (1 + level) / 2) for m in middle]}
    ranks = held.ranks(lambda _: F.array(*(F.lit(k - 1).cast("long") for ks in wanted.values() for k in ks)))
    of = lambda k: F.max(F.when(F.col("rank") == k - 1, F.col("value")))
    return ranks.agg(F.max("n").alias("n"), *((sum(map(of, ks[1:]), of(ks[0])) / len(ks)).alias(name) for name, ks in wanted.items()))
