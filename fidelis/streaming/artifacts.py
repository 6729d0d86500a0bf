"""Artifacts that accrete entries until they are sealed: keyed list state, and its batch twin.

Entries are (instance, seq, kind, payload). Kinds are `observation`, `determination` and `seal`, any other or null being
an entry like the second; a seal's payload is its resolution. A seal of E1 is refused over an observation, as such an
artifact has none. The first seal that isn't refused seals the artifact: it and what came before it are `sealed`, what
comes later is `rejected`, and the seals that it overtook are `refused`. An entry without seq has no place and is
rejected. Entries of one seq come together; a repeated row is an entry of its own. Null is an instance too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

ENTRY = ("instance", "seq", "kind", "payload")
VERDICTS = "instance string, seq long, kind string, payload string, status string"
# Entries handed to the state store in one call.
CHUNK = 1000
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _is_e1(payload: str | None) -> bool:
    return payload == "E1"


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class Accretion(StatefulProcessor):
    """Entries of an instance stay in list state until its seal, which emits all of them; later ones are emitted as rejected.

    No batch of a key is held in memory: rows go to the state in chunks, the smallest seals and observation are enough
    to tell which seal counts, and the artifact is read from the state while it is emitted.
    """

    def init(self, handle) -> None:
        self.entries = handle.getListState("entries", "seq long, kind string, payload string, turn long")
        self.phase = handle.getValueState("phase", "turn long, observed boolean, sealed boolean")

    def _now(self) -> tuple[int, bool, bool]:
        return tuple(self.phase.get()) if self.phase.exists() else (0, False, False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        turn, observed, sealed = self._now()
        e1 = other = seen = None
        rows = iter(rows)
        while chunk := list(islice(rows, CHUNK)):
            late = chunk if sealed else [r for r in chunk if r.seq is None]
            yield from (Row(instance=key[0], seq=r.seq, kind=r.kind, payload=r.payload, status="rejected") for r in late)
            kept = [] if sealed else [r for r in chunk if r.seq is not None]
            for r in kept:
                if r.kind == "observation":
                    seen = _least(seen, r.seq)
                elif r.kind == "seal" and _is_e1(r.payload):
                    e1 = _least(e1, r.seq)
                elif r.kind == "seal":
                    other = _least(other, r.seq)
            if kept:
                self.entries.appendList([(r.seq, r.kind, r.payload, turn) for r in kept])
        if sealed:
            return
        # The least seal of E1 precedes every observation, or no seal of E1 does.
        clear = e1 is not None and not observed and (seen is None or e1 < seen)
        at = _least(e1 if clear else None, other)
        if at is not None:
            for seq, kind, payload, told in self.entries.get():
                before = told < turn or seq <= at
                overtaken = before and kind == "seal" and (told < turn or seq < at)
                yield Row(instance=key[0], seq=seq, kind=kind, payload=payload, status="refused" if overtaken else "sealed" if before else "rejected")
            self.entries.clear()
        self.phase.update((turn + 1, observed or seen is not None, at is not None))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """An earlier log's entry of the instance: `open` ones are taken over, any other tells that it is sealed."""
        turn, observed, sealed = self._now()
        if initialState.status != "open":
            self.phase.update((1, observed, True))
            self.entries.clear()
        elif not sealed and initialState.seq is not None:
            self.entries.appendValue((initialState.seq, initialState.kind, initialState.payload, 0))
            self.phase.update((1, observed or initialState.kind == "observation", False))

    def close(self) -> None:
        pass


def sealed_artifacts(rows: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Of a stream of entries, each one once with its status, when it is known; entries of what isn't sealed stay in the state.

    earlier: entries with their status, as `statuses` gives them, from which the first micro-batch goes on. Order is that
    of seq within a micro-batch; micro-batches come one after another. It needs the state provider that `seal_stream` sets.
    """
    start = earlier.where("status = 'open' or status = 'sealed'").select(*ENTRY, "status").groupBy("instance") if earlier is not None else None
    return rows.select(*ENTRY).groupBy("instance").transformWithState(Accretion(), VERDICTS, "append", "none", start)


def seal_stream(rows: DataFrame, path: str, checkpoint: str, earlier: DataFrame | None = None) -> StreamingQuery:
    """sealed_artifacts appended to a table; all that is there now, then it ends. The session's own state provider is kept."""
    spark = rows.sparkSession
    held = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return sealed_artifacts(rows, earlier).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, held) if held else spark.conf.unset(PROVIDER)


def _first(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("seq")))


def statuses(rows: DataFrame) -> DataFrame:
    """The same of a table, in one batch; entries of what isn't sealed are `open`."""
    seal, e1 = F.col("kind") == "seal", F.col("payload").eqNullSafe("E1")
    firsts = rows.groupBy(F.col("instance").alias("__instance")).agg(_first(seal & e1).alias("__e1"), _first(seal & ~e1).alias("__other"), _first(F.col("kind") == "observation").alias("__seen"))
    clear = F.when(F.col("__seen").isNull() | (F.col("__e1") < F.col("__seen")), F.col("__e1"))
    firsts = firsts.select("__instance", F.least(clear, "__other").alias("__at"))
    overtaken = F.coalesce(seal, F.lit(False)) & (F.col("seq") < F.col("__at"))
    status = F.when(F.col("seq").isNull() | (F.col("seq") > F.col("__at")), "rejected").when(F.col("__at").isNull(), "open").when(overtaken, "refused").otherwise("sealed")
    return rows.join(firsts, F.col("instance").eqNullSafe(F.col("__instance")), "left").select(*rows.columns, status.alias("status"))
