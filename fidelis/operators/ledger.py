"""The keyed append log: resume by anti-join, missing payloads counted, duplicates refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fidelis.operators.guard import guard
from fidelis.sources.scratch import exists


def output_key(instance: Column) -> Column:
    return F.concat(instance.cast("string"), F.lit("::output_tuple"))


def instance_of(key: Column) -> Column:
    return F.regexp_replace(key, "::(output_tuple|pilot_obs)$", "")


def uncommitted(candidates: DataFrame, committed: DataFrame, key: str) -> DataFrame:
    return candidates.join(committed.select(key), key, "left_anti")


def with_payloads(candidates: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """All candidates with their payloads and `present`; a missing one is null and not dropped."""
    return candidates.join(payloads.withColumn("present", F.lit(True)), key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def no_duplicates(log: DataFrame, key: str) -> DataFrame:
    """Keys with their number of commits, failing the run at a second commit."""
    return guard(log.groupBy(key).agg(F.count("*").alias("commits")), F.col("commits") == 1, "a key was committed twice")


def duplicates(log: DataFrame, key: str) -> DataFrame:
    """Keys that were committed more than once, with their number of commits."""
    return log.groupBy(key).agg(F.count("*").alias("commits")).where("commits > 1")


def conflicts(rows: DataFrame, held: DataFrame | None, key: str) -> DataFrame:
    """Keys of rows that have more than one payload, among the rows or against the log held; null payloads are equal."""
    every = rows if held is None else rows.unionByName(held.join(rows.select(key).distinct(), key, "left_semi"))
    payload = F.sha2(F.to_json(F.struct(*(c for c in rows.columns if c != key)), {"ignoreNullFields": "false"}), 256)
    return every.groupBy(key).agg(F.min(payload).alias("a"), F.max(payload).alias("b")).where("a <> b").select(key)


def commit(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not in the log at path; how many. Running it again appends none.

    Equal rows of a key are one row, a retry. Rows of a key that differ, from each other or from the log's, stop the run
    before anything is written: a committed payload is neither replaced nor hidden. A row without a key is refused too.
    """
    spark = rows.sparkSession
    held = spark.read.schema(rows.schema).parquet(path) if exists(spark, path) else None
    wrong = [r[0] for r in conflicts(rows, held, key).limit(3).collect()] + rows.where(F.col(key).isNull()).select(key).limit(1).collect()
    if wrong:
        raise ValueError(f"second commits of a key with another payload, or rows without a key: {wrong}")
    fresh = rows.dropDuplicates([key])
    fresh = uncommitted(fresh, held, key) if held is not None else fresh
    seen = Observation()
    fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def determinism(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """How many keys two runs share, and how many of these agree in all columns, nulls being equal."""
    a = first.select(key, F.struct(*columns).alias("a"))
    b = second.select(key, F.struct(*columns).alias("b"))
    return a.join(b, key).agg(F.count("*").alias("comparable"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("identical"))
