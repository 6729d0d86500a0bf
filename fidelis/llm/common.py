"""What the operators of this subpackage share: table access, batch helpers and counted broadcasts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.sources.scratch import Scratch, exists

__all__ = ["BROADCAST_IDS", "Scratch", "exists", "free_names", "sized", "slices", "table", "text_chunks"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> None:
    """An error where df already has a column of one of these names."""
    if held := sorted({c.lower() for c in df.columns} & {n.lower() for n in names}):
        raise ValueError(f"columns {held} are added here, but the table has them already")


#: Bytes of a batch that are taken up at once. Spark itself ends an Arrow batch at spark.sql.execution.arrow.maxBytesPerBatch.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of at most so many rows and, of more than one row, about so many bytes."""
    for batch in batches:
        start, n = 0, batch.num_rows
        while start < n:
            part = batch.slice(start, rows)
            while part.num_rows > 1 and part.nbytes > most:
                part = part.slice(0, max(1, min(part.num_rows - 1, int(part.num_rows * most / part.nbytes))))
            yield part
            start += part.num_rows
        # What is held of the last batch goes back before the next one comes.
        batch = part = None
        pa.default_memory_pool().release_unused()


#: A side of at most so many rows of one long column each (16 MB) may be broadcast after counting it.
BROADCAST_IDS = 1_000_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df as the small side of a join: broadcast if its counted rows allow, else left to a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def text_chunks(texts: list, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Index ranges of texts of about `most` characters each, so that per-byte arrays stay small; a longer text is alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n + 1
    if start < len(texts):
        yield start, len(texts)
