"""Descriptive tables beside the verdicts, and traces between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions import text
from fidelis.operators.quantiles import median_interval, quantiles


def baseline_index(answer: Column, options: Column) -> Column:
    """0-based place of the answer among the options, blanks and letter case aside; -1 if it is none of them."""
    return (F.array_position(F.transform(options, text.folded), text.folded(answer)) - 1).cast("long")


def packed_readings(readings: DataFrame, key: str = "instance") -> DataFrame:
    """Long readings (key, regime, scores) as one map of regimes for each subject; a regime that is there twice stops the run."""
    return readings.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("regime", "scores"))).alias("readings"))


def unpacked_readings(packed: DataFrame, key: str = "instance") -> DataFrame:
    return packed.select(key, F.explode("readings").alias("regime", "scores"))


def drift_by(drifts: DataFrame, group: Column, name: str, drift: str = "targeted") -> DataFrame:
    """n, mean and median of the drift for each group, as for answers that flip and answers that persist."""
    rows = drifts.select(F.struct(group.alias(name)).alias("__group"), F.col(drift).alias("__drift"))
    sums = rows.groupBy("__group").agg(F.count("*").alias("n"), F.round(F.avg("__drift"), 6).alias("mean_drift"))
    median = quantiles(rows, "__drift", {"median": 0.5}, ["__group"]).select("__group", F.round("median", 6).alias("median_drift"))
    return sums.join(median, "__group").select("__group.*", "n", "mean_drift", "median_drift")


def paired_delta(drifts: DataFrame) -> DataFrame:
    """Median of targeted less control drift within records, and whether it is positive."""
    return quantiles(drifts, F.col("targeted") - F.col("control"), {"delta": 0.5}).select("delta", (F.col("delta") > 0).alias("positive"))


def paired_delta_interval(drifts: DataFrame, level: float = 0.95) -> DataFrame:
    """The registered paired gate: n, median of targeted less control drift within records, its bootstrap interval, and whether that lies above 0."""
    found = median_interval(drifts, F.col("targeted") - F.col("control"), level)
    return found.select("n", F.col("median").alias("delta"), "low", "high", (F.col("low") > 0).alias("positive"))


def length_robust_drift(before: Column, after: Column) -> Column:
    """Word drift of two texts cut to the shorter one's number of tokens."""
    words = lambda c: F.regexp_extract_all(c, F.lit(f"[^{text.SPACE}]+"), F.lit(0))
    least = F.least(F.size(words(before)), F.size(words(after)))
    cut = lambda c: F.array_join(F.slice(words(c), F.lit(1), least), " ")
    return text.jaccard_drift(cut(before), cut(after))


def mentions_dropped(before: Column, after: Column, n: int = 3) -> Column:
    """Whether `after` mentions none of the n content words of `before` that come first in the alphabet."""
    return F.size(F.array_intersect(F.slice(F.array_sort(text.content_words(before)), 1, n), text.content_words(after))) == 0


def agreement(first: DataFrame, second: DataFrame, key: str, column: str) -> DataFrame:
    """How many keys two tables share and the share of them with the same value, as for outcomes that are derived again."""
    a, b = first.select(key, F.col(column).alias("a")), second.select(key, F.col(column).alias("b"))
    return a.join(b, key).agg(F.count("*").alias("n"), F.avg(F.col("a").eqNullSafe(F.col("b")).cast("double")).alias("agreement"))


def trace(sources: DataFrame, entries: DataFrame, key: str, entry: str, also: dict[str, Column]) -> DataFrame:
    """Every source with its number of entries, sources without any included, and further aggregates of the entries."""
    held = entries.groupBy(key).agg(F.count(entry).alias("entries"), *(c.alias(n) for n, c in also.items()))
    return sources.select(key).join(held, key, "left").fillna(0, ["entries", *also])


def grid_equality(rows: DataFrame, column: str, registered: list) -> DataFrame:
    """How many values lie outside a registered grid, and how many of the grid don't occur; one row."""
    seen = rows.select(column).distinct()
    want = rows.sparkSession.createDataFrame([(x,) for x in registered], f"{column} {dict(rows.dtypes)[column]}")
    return seen.subtract(want).agg(F.count("*").alias("beyond")).crossJoin(want.subtract(seen).agg(F.count("*").alias("unmet")))


def origins(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables counted by where they come from; tables without rows are not among them."""
    return reduce(DataFrame.unionAll, (df.select(F.lit(name).alias("origin")) for name, df in tables.items())).groupBy("origin").agg(F.count("*").alias("n"))


def partition_check(candidates: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Sizes of the parts, keys in more than one of them (both), and candidates in none (lost); one row."""
    named = reduce(DataFrame.unionAll, (df.select(key, F.lit(n).alias("part")) for n, df in parts.items()))
    held = named.groupBy(key).agg(F.countDistinct("part").alias("k"), *(F.count_if(F.col("part") == n).alias(n) for n in parts))
    both = candidates.select(key, F.lit(True).alias("there")).join(held, key, "full_outer")
    return both.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in parts), F.count_if(F.col("k") > 1).alias("both"), F.count_if(F.col("k").isNull()).alias("lost"))


def contamination(texts: DataFrame, key: str, benchmark: DataFrame, words: int = 8, most: int = 2_000_000) -> DataFrame:
    """For each key, how many distinct runs of so many words (between single blanks) it shares with a benchmark's texts; keys without any are missing.

    Runs become two 64-bit hashes as soon as they are exploded. The benchmark's are counted, and broadcast if there are
    at most `most` (16 bytes each); then texts meet them where they are read, and only what is shared is shuffled.
    Beyond that the join is shuffled.
    """

    def runs(df: DataFrame, *keep: str) -> DataFrame:
        # The words are bound by a lambda of their own, else each run would split the text again.
        split = F.filter(F.array(F.split("text", " ")), lambda w: F.size(w) >= words)
        every = F.transform(split, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - words + 1), lambda i: F.array_join(F.slice(w, i, F.lit(words)), " ")))
        exploded = df.select(*keep, F.explode(F.flatten(every)).alias("run"))
        return exploded.select(*keep, F.xxhash64("run").alias("a"), F.xxhash64(F.lit(7), "run").alias("b"))

    held = runs(benchmark).distinct()
    held = F.broadcast(held) if held.count() <= most else held
    return runs(texts, key).join(held, ["a", "b"], "left_semi").groupBy(key).agg(F.countDistinct("a", "b").alias("shared"))
