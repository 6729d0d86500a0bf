"""Idempotent commits and sealing logs as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from fidelis.operators.ledger import commit


def commit_stream(rows: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append each key once, whatever is repeated within a batch, between batches or by a retried batch."""
    return rows.writeStream.foreachBatch(lambda df, _: commit(df, path, key) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_commits(rows: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark, for logs too large to anti-join."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sealed_log(rows: DataFrame) -> DataFrame:
    """Of (instance, seq, kind, payload), whether each entry came before the seal; a later one, or a second seal, is rejected.

    Entries of a key are judged in the order of seq within a micro-batch, and micro-batches one after another.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames, state: GroupState):
        sealed = state.get[0] if state.exists else False
        # A group comes in several frames, in no order: all of a micro-batch's entries of one key are put in order first.
        frame = pd.concat(list(frames)).sort_values("seq", kind="stable")
        seal = (frame["kind"] == "seal").cumsum().shift(fill_value=0) > 0
        yield frame.assign(accepted=~(seal | sealed))[["instance", "seq", "kind", "accepted"]]
        state.update((sealed or bool((frame["kind"] == "seal").any()),))

    return rows.select("instance", "seq", "kind").groupBy("instance").applyInPandasWithState(run, "instance string, seq long, kind string, accepted boolean", "sealed boolean", "append", GroupStateTimeout.NoTimeout)


def sealed_log_batch(rows: DataFrame) -> DataFrame:
    """The same in batch: an entry is accepted if no seal has a smaller seq."""
    seals = rows.where(F.col("kind") == "seal").groupBy("instance").agg(F.min("seq").alias("sealed_at"))
    joined = rows.select("instance", "seq", "kind").join(seals, "instance", "left")
    return joined.select("instance", "seq", "kind", F.coalesce(F.col("seq") <= F.col("sealed_at"), F.lit(True)).alias("accepted"))


def judged_log(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """sealed_log of a stream, appended to a table; all that is there now, then it ends."""
    return sealed_log(rows).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
