"""Canonical keys, digests, positions and derangements."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.operators.guard import guard
from fidelis.operators.ranges import running
from fidelis.sources.scratch import shared_dir


def source_key(dataset: Column, record: Column) -> Column:
    """Canonical JSON of a source record's identity; no separator can make two identities meet."""
    return F.to_json(F.struct(dataset.alias("dataset"), record.alias("record_id")))


def generator_key(components: Column) -> Column:
    """Canonical JSON of a name-value map, by name."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(components))))


def canonical_json(answer: Column, rationale: Column) -> Column:
    """Compact JSON with explicit nulls; control characters escaped in lower-case hexadecimal."""
    raw = F.to_json(F.struct(answer.alias("chosen_answer"), rationale.alias("rationale")), {"ignoreNullFields": "false"})
    for hexed in "ABCDEF":
        for high in "01":
            raw = F.replace(raw, F.lit(f"\\u00{high}{hexed}"), F.lit(f"\\u00{high}{hexed.lower()}"))
    return raw


def baseline_digest(answer: Column, rationale: Column) -> Column:
    return F.sha2(canonical_json(answer, rationale), 256)


def digest_holds(answer: str, rationale: str, digest: str) -> Column:
    return F.coalesce(baseline_digest(F.col(answer), F.col(rationale)) == F.col(digest), F.lit(False))


def verify_digest(df: DataFrame, answer: str, rationale: str, digest: str) -> DataFrame:
    return guard(df, baseline_digest(F.col(answer), F.col(rationale)) == F.col(digest), "baseline digest mismatch")


def assign_position(df: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """Dense 0-based positions by key; equal keys are numbered in any order among themselves."""
    return running(df, [F.col(key)], {name: F.lit(1)})


def derangement(positioned: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Each row's partner: the next one in order, the first one after the last; a table of one row has none."""
    n = positioned.agg(F.count("*").alias("n"))
    partner = positioned.select(F.col(pos).alias("__p"), F.col(key).alias("partner"))
    rows = positioned.crossJoin(F.broadcast(n)).withColumn("__p", (F.col(pos) + 1) % F.col("n"))
    return rows.where("n > 1").join(partner, "__p").drop("__p", "n")


def ids_digest(df: DataFrame, key: str) -> DataFrame:
    """SHA-256 of all ids in order, one a line, with their number; one row.

    Ids are sorted in ranges, by many tasks, and checkpointed in that order. The digest of a sequence is a fold by its
    nature: one task reads the sorted ranges one after another and holds a batch at a time; it sorts nothing, and stops
    if an id comes before the last one.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, digest, last = 0, hashlib.sha256(), b""
        for batch in batches:
            for x in batch.column(0).to_pylist():
                own = x.encode("utf-8", "surrogatepass")
                if own < last:
                    raise ValueError("ranges were read out of order")
                digest.update(b"\n" + own if n else own)
                n, last = n + 1, own
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], ["n", "digest"])

    ids = df.select(F.col(key).cast("string").alias("id")).where("id is not null").orderBy("id").checkpoint()
    return ids.coalesce(1).mapInArrow(run, "n long, digest string")
