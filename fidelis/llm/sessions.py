"""Sessions of late events as a log of versions, folded by higher-order functions in the JVM.

Events arrive in batches, not in order of time. After each batch a key's events so far form sessions: neighbours in time
at most `gap` apart share one. A session that holds an event of the batch is a new version and retracts the standing
sessions it contains. The log has every version, with the version that retracted it.

Batch structs, each with its events in order, are collected and sorted; one fold goes over them with the standing
sessions as its state, filters those that a batch touches, and appends what it retracts to the log, which is exploded.

A key may hold most rows, so what is folded is not a key but a stretch of its time. It is cut where neighbours lie
further apart than the gap, as no session crosses there; and where all that is earlier in time arrived in earlier batches
than all that is later. There the earlier part stands as one session whose sums are known, and the later stretch
starts from it. The cuts are found by sums and maxima carried over buckets of time (`scanned`), of which no
task holds more than a bucket's rows. A stretch ends wherever no late event bridges it; delays of a few batches bound it.

Defined results: rows without a key, time or batch are no events; a null value adds nothing; repeated events count each,
as rows of one cell (key, time, batch) that are summed before anything else; other columns are not looked at; an empty table
gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.llm.common import Scratch

GAP = 600
#: Bits of time within a bucket, of buckets within a wider one, and so on; the last ones are a key's few.
BITS = (16, 12)
LOG = ("user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s")
_FOLDS = {
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
}


def scanned(df: DataFrame, key: str, at: str, before: dict[str, tuple[str, Column]], after: dict[str, tuple[str, Column]], bits: tuple[int, ...] = BITS) -> DataFrame:
    """df, of one row for each key and time, with aggregates (max, min or sum) over the key's earlier and over its later rows.

    A window sees a bucket of time; what buckets carry to each other is found in the same way over one row for each.
    """
    every = before | after
    held = df.withColumns({f"__{n}": c for n, (_, c) in every.items()})
    own = [key]
    if bits:
        held, own = held.withColumn("__bucket", F.shiftright(F.col(at), bits[0])), [key, "__bucket"]
    past = Window.partitionBy(*own).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    coming = Window.partitionBy(*own).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    near = held.withColumns({n: _FOLDS[k][0](f"__{n}").over(past if n in before else coming) for n, (k, _) in every.items()})
    if not bits:
        return near.select(*df.columns, *every)
    sums = held.groupBy(*own).agg(*(_FOLDS[k][0](f"__{n}").alias(f"__{n}") for n, (k, _) in every.items())).withColumnRenamed("__bucket", "__at")
    inner = lambda part: {n: (k, F.col(f"__{n}")) for n, (k, _) in part.items()}
    far = scanned(sums, key, "__at", inner(before), inner(after), bits[1:])
    far = far.select(key, F.col("__at").alias("__bucket"), *(F.col(n).alias(f"__far_{n}") for n in every))
    both = near.join(far, own)
    return both.select(*df.columns, *(_FOLDS[k][1](F.col(n), F.col(f"__far_{n}")).alias(n) for n, (k, _) in every.items()))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _session(s: Column, **more: Column) -> Column:
    names = ("start", "end", "n", "h", "batch", "n_new", "n_retracted")
    return F.struct(*(more.get(c, s[c]).cast("long").alias(c) for c in names))


def _joined(parts: Column, gap: int) -> Column:
    """Neighbouring parts (start, end, n, h, n_new, n_old), sorted by start, summed up wherever they are at most gap apart."""

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        near = F.coalesce(x["start"] - last["end"] <= gap, F.lit(False))
        both = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), (last["n"] + x["n"]).alias("n"),
            (last["h"] + x["h"]).alias("h"), (last["n_new"] + x["n_new"]).alias("n_new"), (last["n_old"] + x["n_old"]).alias("n_old"),
        )
        return F.when(near, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(x)))

    none = F.array().cast("array<struct<start:bigint,end:bigint,n:bigint,h:bigint,n_new:bigint,n_old:bigint>>")
    return F.aggregate(parts, none, add)


_SESSIONS = "array<struct<start:bigint,end:bigint,n:bigint,h:bigint,batch:bigint,n_new:bigint,n_retracted:bigint>>"
_LOGGED = "array<struct<start:bigint,end:bigint,n:bigint,h:bigint,batch:bigint,n_new:bigint,n_retracted:bigint,by_batch:bigint,by_start:bigint>>"


def _step(state: Column, batch: Column, gap: int) -> Column:
    """The state (standing, log) after a batch (batch, events)."""
    part = lambda s, new, old: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["n"].alias("n"), s["h"].alias("h"), new.cast("long").alias("n_new"), F.lit(old).cast("long").alias("n_old"))
    parts = F.array_sort(F.concat(F.transform(state["standing"], lambda s: part(s, F.lit(0), 1)), F.transform(batch["events"], lambda e: part(e, e["n"], 0))))
    touched = F.filter(_joined(parts, gap), lambda v: v["n_new"] > 0)
    holds = lambda v, s: (v["start"] <= s["start"]) & (s["end"] <= v["end"])

    def after(new: Column) -> Column:
        over = lambda s: F.exists(new, lambda v: holds(v, s))
        gone = F.transform(
            F.filter(state["standing"], over),
            lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "n", "h", "batch", "n_new", "n_retracted")), batch["batch"].alias("by_batch"), F.get(F.filter(new, lambda v: holds(v, s)), F.lit(0))["start"].alias("by_start")),
        )
        kept = F.filter(state["standing"], lambda s: ~over(s))
        fresh = F.transform(new, lambda v: _session(v, batch=batch["batch"], n_retracted=v["n_old"]))
        return F.struct(F.array_sort(F.concat(kept, fresh)).cast(_SESSIONS).alias("standing"), F.concat(state["log"], gone).cast(_LOGGED).alias("log"))

    return _bound(touched, after)


def folded(batches: Column, first: Column, gap: int) -> Column:
    """The log of a stretch: its sorted batches, folded from the sessions that stand at its start."""
    start = F.struct(first.cast(_SESSIONS).alias("standing"), F.array().cast(_LOGGED).alias("log"))
    final = lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "n", "h", "batch", "n_new", "n_retracted")), F.lit(None).cast("long").alias("by_batch"), F.lit(None).cast("long").alias("by_start"))
    return F.aggregate(batches, start, lambda s, b: _step(s, b, gap), lambda s: F.concat(s["log"], F.transform(s["standing"], final)))


def stretches(events: DataFrame, key: str, at: str, batch: str, value: str, gap: int, bits: tuple[int, ...] = BITS) -> DataFrame:
    """Cells (key, stretch, batch, at, n, h) with the stretch they belong to, by its first time, and `carry`, the session that stands there.

    carry (start, end, n, h) is given at a stretch's first time only, and null where none stands; its batch is the last
    one of the stretch before, which `next` leads to.
    """
    whole = events.select(F.col(key).alias("key"), F.col(at).cast("long").alias("at"), F.col(batch).cast("long").alias("batch"), F.col(value).cast("long").alias("h"))
    cells = whole.where("key is not null and at is not null and batch is not null").groupBy("key", "at", "batch").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("h"))
    points = cells.groupBy("key", "at").agg(F.sort_array(F.collect_list(F.struct("batch", "n", "h"))).alias("cells"), F.min("batch").alias("lo"), F.max("batch").alias("hi"), F.sum("n").alias("n"), F.sum("h").alias("h"))
    # Each is read several times by what follows, so it is written; what is written is a row of numbers for each point of time.
    scratch = Scratch(events.sparkSession, "sessions")
    points = scratch.write(points, "points")
    seen = scanned(
        points, "key", "at",
        {"last": ("max", F.col("at")), "hi_before": ("max", F.col("hi")), "n_before": ("sum", F.col("n")), "h_before": ("sum", F.col("h"))},
        {"lo_after": ("min", F.col("lo"))}, bits,
    )
    apart = F.col("last").isNull() | (F.col("at") - F.col("last") > gap)
    cut = apart | (F.col("hi_before") < F.least("lo", "lo_after"))
    seen = scratch.write(seen.withColumns({"apart": apart, "cut": cut}), "seen")
    scratch.drop(points)
    opened = F.when(F.col("apart"), F.struct("at", "n_before", "h_before"))
    found = scanned(seen, "key", "at", {"stretch": ("max", F.when(F.col("cut"), F.col("at"))), "island": ("max", opened)}, {"next": ("min", F.when(F.col("cut"), F.col("at")))}, bits)
    since = lambda c: (F.col(f"{c}_before") - F.col(f"island.{c}_before")).alias(c)
    carry = F.when(F.col("cut") & ~F.col("apart"), F.struct(F.col("island.at").alias("start"), F.col("last").alias("end"), since("n"), since("h")))
    out = scratch.write(found.select("key", F.when(F.col("cut"), F.col("at")).otherwise(F.col("stretch")).alias("stretch"), "at", "cells", "hi", "next", carry.alias("carry")), "stretches")
    scratch.drop(seen)
    return out


def session_versions(events: DataFrame, key: str = "user", at: str = "seconds", batch: str = "batch", value: str = "h", gap: int = GAP, bits: tuple[int, ...] = BITS) -> DataFrame:
    """The version log of the key's sessions, with the columns of LOG; h_sum sums the values of all events of a version."""
    found = stretches(events, key, at, batch, value, gap, bits)
    each = found.select("key", "stretch", "at", F.explode("cells").alias("c")).groupBy("key", "stretch", F.col("c.batch").alias("batch"))
    event = F.struct(F.col("at").alias("start"), F.col("at").alias("end"), F.col("c.n").alias("n"), F.col("c.h").alias("h"))
    batches = each.agg(F.sort_array(F.collect_list(event)).alias("events"))
    # What a stretch starts from: the session that stands at its cut, whose version is of the stretch before's last batch.
    led = found.groupBy("key", F.col("next").alias("stretch")).agg(F.max("hi").alias("led")).where("stretch is not null")
    starts = found.where("carry is not null").select("key", "stretch", "carry").unionByName(led, allowMissingColumns=True)
    sides = batches.select("key", "stretch", F.struct("batch", "events").alias("b")).unionByName(starts, allowMissingColumns=True)
    whole = sides.groupBy("key", "stretch").agg(F.sort_array(F.collect_list("b")).alias("batches"), F.max("carry").alias("carry"), F.max("led").alias("led"))
    zero = F.lit(0)
    stands = F.when(F.col("carry").isNotNull(), F.array(_session(F.col("carry"), batch=F.col("led"), n_new=zero, n_retracted=zero))).otherwise(F.array().cast(_SESSIONS))
    log = whole.select("key", F.inline(folded(F.col("batches"), stands, gap)))
    # A carried session is known twice, by the stretch that made it and by the one that retracted it.
    made = lambda c: F.max(c)
    one = log.groupBy("key", "batch", "start").agg(*(made(c).alias(c) for c in ("end", "n", "n_new", "n_retracted", "h", "by_batch", "by_start")))
    names = ("key", "batch", "start", "end", "n", "n_new", "n_retracted", "h", "by_batch", "by_start")
    return one.select(*(F.col(a).alias(key if a == "key" else b) for a, b in zip(names, LOG, strict=True)))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Turns as events (user, seconds, batch, h): users share conversations, digests scatter times and delays."""
    c, h = F.crc32(F.col("conv_id").cast("string")), F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    rows = conversations.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), c.alias("c"), h.alias("h"))
    rows = rows.select(
        (2 * F.shiftright("conv_id", 3) + F.col("c") % 2).alias("user"),
        (F.shiftright("c", 1) % 7200 + 300 * F.col("turn") + F.col("h") % 600).alias("seconds"), F.expr("h div 600").alias("g"), "h",
    )
    late = F.when(F.col("g") % 5 == 0, F.col("g") % 4).otherwise(0)
    return rows.select("user", "seconds", (F.expr("(seconds - pmod(seconds, 900)) div 900") + late).alias("batch"), "h")
