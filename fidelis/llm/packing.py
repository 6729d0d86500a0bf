"""Best-fit packing planned over a length histogram.

Documents become pieces of at most `capacity` tokens. The driver sees only how many pieces there are of each
length (at most `capacity` numbers), runs best-fit decreasing over these counts, and gets slots as runs of
ranks: a run says which sequences, from which offset, take the pieces of a length whose ranks it spans. Each
piece then finds its slot by a join on length and rank within length.

A piece's rank is its number among its length's pieces that one task has cut, written with it, plus how many the tasks
before cut; so no piece is shuffled or sorted for its rank, and a length that many pieces have is no single task's.

Defined results: a null or empty text is the end token alone; repeated rows are packed once for each row; extra
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidelis.llm.common import Scratch, sized, slices
from fidelis.llm.tokenizers import byte_bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, share long, nth long"


def _cut(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, seen, share = byte_bpe(path).ids, Counter(), TaskContext.get().partitionId()
    for part in slices(batches):
        rows: list[tuple] = []
        for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            ids = np.append(encode(text) if text else np.empty(0, np.uint32), np.uint32(end_id)).astype("<u4")
            first = len(ids) % capacity or capacity
            edges = [0, *range(first, len(ids) + 1, capacity)]
            for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                raw = ids[a:b].tobytes()
                rows.append((doc, i, a, b - a, zlib.crc32(raw), raw if with_ids else None, share, seen[b - a]))
                seen[b - a] += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "share", "nth"])


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row for each piece; all but a document's first are full. share and nth hold within one run, so the rows are to be written before they are packed."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return base.mapInArrow(lambda it: _cut(it, tokenizer, end_id, capacity, with_ids), PIECES)


def plan_slots(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: (length, first rank, end rank, first sequence, pieces each, offset) and the number of sequences.

    Sequences with the same room left are runs of numbers. A step fills one run, with as many pieces each as
    fit, or uses up one length; so there are a few thousand steps whatever the counts are.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []
    used = 0

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            if not open_runs[room]:
                insort(rooms, room)
            open_runs[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_runs[room].pop()
                if not open_runs[room]:
                    rooms.pop(at)
            else:
                room, first, n = capacity, used, -(-left // (capacity // length))
                used += n
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, capacity - room))
                keep(room - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left and left < each:
                slots.append((length, rank, rank + left, first, left, capacity - room))
                keep(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            keep(room, first, n)
    return slots, used


def pack(cut: DataFrame, scratch: Scratch, capacity: int = 1024) -> DataFrame:
    """sequence_id and offset for each row of cut (length, share, nth, ...), a written table."""
    spark = cut.sparkSession
    shares = scratch.write(cut.groupBy("length", "share").agg(F.count("*").alias("n")), "shares")
    histogram = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan_slots(histogram, capacity)
    earlier = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    before = shares.select("length", "share", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(sized(before, 3 * shares.said["n"]), ["length", "share"]).withColumn("rank", F.col("before") + F.col("nth"))
    plan = spark.createDataFrame(slots, "of_length long, lo long, hi long, seq_from long, per long, base long")
    slot = F.col("rank") - F.col("lo")
    placed = (
        ranked.join(F.broadcast(plan), (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .withColumn("sequence_id", F.expr("seq_from + (rank - lo) div per"))
        .withColumn("offset", F.col("base") + (slot % F.col("per")) * F.col("length"))
    )
    return placed.select(*(c for c in cut.columns if c not in ("share", "nth")), "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces of docs with their places: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.write(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    packed = pack(cut, scratch, capacity)
    return packed if with_ids else packed.drop("ids")
