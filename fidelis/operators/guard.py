"""Conformance halts that survive column pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guard(df: DataFrame, ok: Column, said: str) -> DataFrame:
    """df, failing the run if any row is not ok (null counts as not ok). A filter is never pruned; a column may be."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(said)).cast("boolean")))
