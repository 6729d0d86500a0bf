"""HyperMinHash near-duplicate components.

Each document's set of word shingles is hashed once; the hash's high bits choose one of REGISTERS buckets
and the least remixed hash of a bucket is kept as its leading-zero count plus MANTISSA bits. Bands of
compressed registers give buckets of candidates, a collision-corrected estimate sifts pairs of a bucket, and
what is left is confirmed on the full shingle sets.

Groups of copies never become all their pairs. Equal sets are one class from the start. Within a bucket, a
first round confirms only a spanning forest of the plausible pairs, by blocks of BLOCK members; a second
round holds every plausible pair whose ends are still in different components against the full sets, inside
cells whose members in such a pair get theirs, and hands on only links that join components. Buckets of any size go
through both rounds.

A bucket's cells are its largest component's blocks, each with the other members, and pairs of blocks of these. Where
that would make more than FAN rows a member, as in a large bucket of look-alikes that no link joins, its members go
another way, all such buckets' members together and once each: two sets at the threshold share one of the rarest shingles
of either, so many of them as a set of that size can lose to one of that size and still be similar enough (a prefix filter, exact at
the threshold). Members that have a rare shingle and a class of sizes in common are a group, and groups are held like buckets, by pairs
of blocks whatever their size. A member has rows in proportion to its own set, not to the others; a shingle that many
unlinked members have is no rare one of theirs unless they lack shingles of their own, and then they are links. No
pair that shares a bucket is lost; the one loss is that of a pair that shares no band at all.

Defined results: a null or empty text, or one without words, has n_shingles 0 and is its own component;
repeated rows come back once for each row; extra columns of the input are ignored; an empty table gives none.
doc_id is the key: rows that share it are in one component, whatever their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidelis.llm.common import Scratch, sized, slices, text_chunks
from fidelis.llm.components import components
from fidelis.llm.hashing import U, mix, shingle_sets
from fidelis.operators.ranges import running

BANDS, ROWS, MANTISSA = 40, 5, 10
REGISTERS = BANDS * ROWS
EMPTY = np.uint16(0xFFFF)
#: Rows a member that pairs of blocks may make before a bucket's members meet by rare shingles.
FAN = 40
#: Classes of set sizes for that, each so many times the last.
WIDER = 1.05
#: Members of a bucket that are compared at once, and about so many shingle hashes of theirs.
BLOCK, BLOCK_HASHES = 256, 1 << 21
#: For register i, the order in which it looks for a filled bucket when its own is empty.
_PROBES = np.stack([np.concatenate(([i], np.random.Generator(np.random.PCG64(i)).permutation(REGISTERS))) for i in range(REGISTERS)])

SKETCH = "doc_id long, n long, d1 long, d2 long, registers binary"


def compress(least: np.ndarray) -> np.ndarray:
    """uint64 minima as 16 bits: 6 of leading-zero count, 10 of the bits after the leading one."""
    bits = (least >> U(11)).astype(np.float64).view(np.uint64)
    zeros = np.where(bits == 0, U(53), U(52) - ((bits >> U(52)) - U(1023)))
    return ((zeros << U(MANTISSA)) | ((bits >> U(52 - MANTISSA)) & U((1 << MANTISSA) - 1))).astype(np.uint16)


def registers(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of REGISTERS compressed registers for each set; empty buckets borrow from filled ones.

    Shingles are sorted within a set, so the buckets, taken from the high bits, are runs.
    """
    out = np.full((len(counts), REGISTERS), EMPTY)
    if not len(shingles):
        return out
    bucket = ((shingles >> U(32)) * U(REGISTERS) >> U(32)).astype(np.int64)
    key = np.repeat(np.arange(len(counts)), counts) * REGISTERS + bucket
    runs = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    out.reshape(-1)[key[runs]] = compress(np.minimum.reduceat(mix(shingles, 11), runs))
    own = out.copy()
    doc, at = np.nonzero((own == EMPTY) & (counts > 0)[:, None])
    for probe in range(1, REGISTERS + 1):
        if not len(doc):
            break
        found = own[doc, _PROBES[at, probe]]
        out[doc, at] = found
        left = found == EMPTY
        doc, at = doc[left], at[left]
    return out


def estimate(match: np.ndarray) -> np.ndarray:
    """Jaccard from the number of equal registers, less the share that different minima meet by chance.

    Two independent minima have equal leading-zero counts with a chance of a third, and then equal mantissas
    with a chance of 2 ** -MANTISSA.
    """
    chance = 2.0**-MANTISSA / 3
    return (match / REGISTERS - chance) / (1 - chance)


def sift(n: np.ndarray, threshold: float) -> np.ndarray:
    """The least estimate that a pair may have, five standard errors below the threshold; n: the smaller set's size."""
    filled = REGISTERS * -np.expm1(-n / REGISTERS)
    return threshold - 5 * np.sqrt(threshold * (1 - threshold) / np.maximum(filled, 1))


def _sketches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in text_chunks(texts):
            shingles, counts = shingle_sets(texts[a:b], k)
            regs = registers(shingles, counts)
            ends = np.cumsum(counts)
            sums = [np.concatenate(([U(0)], np.cumsum(mix(shingles, salt), dtype=np.uint64))) for salt in (21, 22)]
            d1, d2 = ((s[ends] - s[ends - counts]).view(np.int64) for s in sums)
            yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(counts), pa.array(d1), pa.array(d2), pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "n", "d1", "d2", "registers"])


def _band_keys(regs: np.ndarray) -> np.ndarray:
    """A key for each band of each row of registers."""
    regs = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), regs.shape[:2])
    for j in range(ROWS):
        key = mix(key ^ (regs[:, :, j] << U(16)), 31 + j)
    return key


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1000):
        key = _band_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16))
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], ["band", "rid"])


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, n, shingle) of rows (rid, n, shingles)."""
    for part in slices(batches, 200):
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(2)]
        rows = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
        yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(np.concatenate(sets))], ["rid", "n", "shingle"])


def rare_groups(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(band, rid, own, class): groups of members (rid, n) such that any two at the threshold have one in common.

    Shingles are ranked within a set from the rarest on, over all members, ties by value; those of one member only come first and
    group nobody. Sets of sizes x and y reach the threshold with ceil(th * (x + y) / (100 + th)) common shingles, th in hundredths, so the
    first x less that number plus one of the one and of the other meet. y is taken from its class of sizes, at its least.
    """
    th = round(threshold * 100)
    each = members.select("rid", "n").join(sets, "rid").select("rid", "n", "shingles").mapInArrow(_each_shingle, "rid long, n long, shingle long")
    shared = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    own = Window.partitionBy("rid")
    ranked = each.join(shared, "shingle").withColumn("nth", F.row_number().over(own.orderBy("f", "shingle")) + F.col("n") - F.count(F.lit(1)).over(own))
    size = lambda n: F.floor(F.log(n.cast("double")) / math.log(WIDER)).cast("long")
    n, c = F.col("n"), F.col("class")
    least, most = F.expr(f"(n * {th} + 99) div 100"), F.expr(f"n * 100 div {th}")
    placed = ranked.where(F.col("nth") <= n - least + 1).select("rid", "n", "shingle", "nth", size(n).alias("own"), least.alias("least"), F.explode(F.sequence(size(least), size(most))).alias("class"))
    partner = F.greatest(F.floor(F.pow(F.lit(WIDER), c)), F.col("least"))
    placed = placed.withColumn("sum", n + partner).where(n - F.expr(f"(sum * {th} + {99 + th}) div {100 + th}") + 1 >= F.col("nth"))
    return placed.select(F.xxhash64("shingle", F.least("own", "class"), F.greatest("own", "class")).alias("band"), "rid", "own", "class")


def _met(groups: DataFrame) -> DataFrame:
    """Those groups in which both classes of sizes are there; of those with the same members, one."""
    both = groups.groupBy("band").agg(F.min("own").alias("a"), F.max("own").alias("b"), F.max(F.col("own") == F.col("class")).alias("same")).where("same or a < b")
    kept = groups.join(both.select("band"), "band").select("band", "rid")
    return kept.join(_buckets(kept).select("band"), "band")


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _common(p: np.ndarray, q: np.ndarray) -> int:
    both = np.concatenate((p, q))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _alike(p: np.ndarray, q: np.ndarray, threshold: float) -> bool:
    """Whether the Jaccard similarity of two sets reaches the threshold, given in hundredths, in whole numbers."""
    common = _common(p, q)
    return 100 * common >= round(threshold * 100) * (len(p) + len(q) - common)


def _plausible(n: np.ndarray, comp: np.ndarray, side: np.ndarray, rid: np.ndarray, regs: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """Pairs of a cell's members in different components that the registers don't rule out, likeliest first."""
    many = []
    for i in range(len(n) - 1):
        js = np.arange(i + 1, len(n))
        js = js[(comp[js] != comp[i]) & ~((side[js] == 1) & (side[i] == 1)) & (rid[js] != rid[i])]
        js = js[np.minimum(n[js], n[i]) >= threshold * np.maximum(n[js], n[i])]
        if len(js):
            likely = estimate((regs[js] == regs[i]).sum(axis=1))
            ok = likely >= sift(np.minimum(n[js], n[i]), threshold)
            many.append((likely[ok], np.full(int(ok.sum()), i), js[ok]))
    if not many:
        return [], []
    likely, a, b = (np.concatenate([m[x] for m in many]) for x in range(3))
    order = np.argsort(-likely, kind="stable")
    return a[order].tolist(), b[order].tolist()


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple] | None]:
    """The rows of each cell of more than one row, which come one after another; None after each part of a batch."""
    held: list[tuple] = []
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                if len(held) > 1:
                    yield held
                held = []
            held.append(row)
        yield None
    if len(held) > 1:
        yield held


def _cell(held: list[tuple]) -> tuple[np.ndarray, ...]:
    """rid, n, component, side and registers of a cell's rows."""
    return *(np.array([h[i] for h in held]) for i in (1, 2, 3, 4)), np.frombuffer(b"".join(h[5] for h in held), np.uint16).reshape(len(held), REGISTERS)


def _pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """A spanning forest, over components, of each cell's plausible pairs.

    Rows: cell, rid, n, component, side, registers and, in the second round, shingles. With shingles a pair is
    confirmed on the full sets before it joins the forest, so what comes out are links and the forest spans all
    links of the cell; without them it is likeliest first. Pairs with side 1 at both ends don't count.
    """
    found: list[tuple[int, int]] = []

    def out() -> pa.RecordBatch:
        ends = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    for held in _by_cell(batches):
        if held is None:
            yield out()
            continue
        rid, n, comp, side, regs = _cell(held)
        first: dict[int, int] = {}
        parent = [first.setdefault(c, i) for i, c in enumerate(comp.tolist())]
        for a, b in zip(*_plausible(n, comp, side, rid, regs, threshold), strict=True):
            p, q = _find(parent, a), _find(parent, b)
            if p != q and (len(held[a]) == 6 or _alike(np.frombuffer(held[a][6], np.uint64), np.frombuffer(held[b][6], np.uint64), threshold)):
                parent[p] = q
                found.append((rid[a], rid[b]))
    yield out()


def _hopeful(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Those rows of each cell that are in a plausible pair."""
    for held in _by_cell(batches):
        if held is None:
            continue
        rid, n, comp, side, regs = _cell(held)
        ends = sorted(set().union(*_plausible(n, comp, side, rid, regs, threshold)))
        if ends:
            rows = [held[i] for i in ends]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["cell", "rid", "n", "component", "side", "registers"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = batch.column(1).to_pylist()
        for a, b in text_chunks(texts):
            shingles, counts = shingle_sets(texts[a:b], k)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([shingles[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)], pa.binary())], ["rid", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Those pairs (a, b, set_a, set_b) whose full sets are alike."""
    for batch in slices(batches):
        sets = zip(batch.column(2), batch.column(3), strict=True)
        keep = [_alike(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair), threshold) for pair in sets]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    ends = [sets.select(F.col("rid").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab"]
    joined = pairs.join(ends[0], "a").join(ends[1], "b")
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(lambda it: _confirm(it, threshold), "a long, b long")


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict[str, int]]:
    """docs with a number __node for each (doc_id, text), in the order of doc_id and null for a null one, and counts.

    The counts are of ids that occur in more than one row, n, and with more than one text, several. Without the
    latter doc_id is the number.
    """
    digest = F.coalesce(F.md5("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("__digest")).where("doc_id is not null")
    ids = base.groupBy("doc_id").agg(F.count("*").alias("n"), (F.min("__digest") != F.max("__digest")).alias("differ")).where("n > 1")
    said = scratch.write(ids, "repeats", several=F.expr("count_if(differ)")).said
    if not said["several"]:
        return docs.withColumn("__node", F.col("doc_id").cast("long")), said
    nodes = scratch.write(running(base.distinct(), [F.col("doc_id"), F.col("__digest")], {"__node": F.lit(1)}), "nodes")
    ends = nodes.select(F.col("doc_id").alias("__doc"), "__digest", "__node")
    joined = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__digest": digest}).join(ends, ["__doc", "__digest"], "left")
    return joined.select(*docs.columns, "__node"), said


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text, ...).

    Where ids occur with several texts, each text is a node of its own and the nodes of an id are linked afterwards.
    """
    scratch = Scratch(docs.sparkSession, "nodes")
    base, said = numbered(docs.select("doc_id", "text"), scratch)
    if not said["several"]:
        return of_nodes(docs, k, threshold)
    found = of_nodes(base.select(F.col("__node").alias("doc_id"), "text"), k, threshold)
    found = scratch.write(found.select(F.col("doc_id").alias("node"), "n_shingles", F.col("component_id").alias("root")), "found")
    # Nodes are in the order of doc_id, so the least of a component is one of its least doc_id.
    ids = scratch.write(base.where("__node is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__node").alias("node")).distinct(), "ids")
    least = ids.groupBy("doc_id").agg(F.min("node").alias("b"))
    same_id = ids.join(least, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")
    alike = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    comps = components(alike.unionAll(same_id), scratch)
    named = found.join(ids, "node", "left").withColumn("at", F.coalesce("root", "node")).join(comps.withColumnRenamed("node", "at"), "at", "left")
    named = named.withColumn("at", F.coalesce("component", "at")).select("doc_id", "n_shingles", "at")
    roots = ids.select(F.col("node").alias("at"), F.col("doc_id").alias("component_id"))
    return named.join(roots, "at", "left").select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def of_nodes(docs: DataFrame, k: int = 5, threshold: float = 0.75) -> DataFrame:
    """near_duplicates of documents whose ids have one text each."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = scratch.write(base.mapInArrow(lambda it: _sketches(it, k), SKETCH), "sketch")
    classes = scratch.write(
        sketch.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rid"), F.first("registers").alias("registers")),
        "classes",
    )
    bands = classes.select("rid", "registers").mapInArrow(_bands, "band long, rid long")
    members = scratch.write(bands.join(_buckets(bands), "band").join(classes.select("rid", "n", "registers"), "rid"), "members")
    ids = scratch.write(members.select("rid").distinct(), "ids")
    if ids.said["n"]:
        found = base.join(sized(ids.withColumnRenamed("rid", "doc_id"), ids.said["n"]), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        sets = scratch.write(found.mapInArrow(lambda it: _sets(it, k), "rid long, shingles binary"), "sets")
        # Round one: a spanning forest of each bucket's plausible pairs, by blocks.
        salt = F.pmod(F.xxhash64("rid", "band"), F.ceil(F.col("size") / BLOCK))
        cells = members.select(F.xxhash64("band", salt).alias("cell"), "rid", "n", F.col("rid").alias("component"), F.lit(0).alias("side"), "registers")
        pairs = scratch.write(_in_cells(cells, threshold), "pairs")
        links = scratch.write(_verify(pairs, sets, threshold), "links")
        # Round two: what links there still are between components, confirmed inside the cells.
        comps = components(links, scratch)
        placed = members.join(comps.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
        cells = _dealt(_cells(placed, sets, threshold, scratch)).mapInArrow(lambda it: _hopeful(it, threshold), "cell long, rid long, n long, component long, side int, registers binary")
        cells = scratch.write(cells, "hopeful")
        more = scratch.write(_in_cells(cells.join(sets, "rid").select(*cells.columns, "shingles"), threshold), "more")
        if more.said["n"]:
            comps = components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more), scratch)
        scratch.drop(sets, pairs, links, cells, more)
    else:
        comps = spark.createDataFrame([], "node long, component long")
    scratch.drop(members, ids)
    classed = classes.select("d1", "d2", "n", "rid").join(comps.withColumnRenamed("node", "rid"), "rid", "left").select("d1", "d2", "n", F.coalesce("component", "rid").alias("root"))
    return (
        sketch.select("doc_id", "n", "d1", "d2").join(classed, ["d1", "d2", "n"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _dealt(cells: DataFrame) -> DataFrame:
    return cells.repartition("cell").sortWithinPartitions("cell", "rid")


def _in_cells(cells: DataFrame, threshold: float) -> DataFrame:
    return _dealt(cells).mapInArrow(lambda it: _pairs(it, threshold), "a long, b long").distinct()


def _buckets(bands: DataFrame) -> DataFrame:
    """Bands of more than one row; of those with the same members, one."""
    marks = bands.groupBy("band").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.sum(F.xxhash64("rid") % 1_000_003).alias("s"))
    return marks.where("size > 1").groupBy("size", "x", "s").agg(F.min("band").alias("band")).select("band", "size")


def _cells(placed: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch, whole: bool = False) -> DataFrame:
    """Cells for every pair of a bucket's members in different components that may be similar enough.

    The bucket's largest component goes to blocks, each member to one; the others meet each of those blocks
    and, block by block, one another. A bucket of one component has no cell; members of one that would make too many rows meet
    by rare_groups, which are taken whole.
    """
    by = placed.groupBy("band", "component").agg(F.count("*").alias("c"), F.sum("n").alias("h"))
    main = F.max_by(F.struct("component", "c", "h"), F.struct("c", "component")).alias("main")
    shape = by.groupBy("band").agg(main, F.sum("c").alias("c"), F.sum("h").alias("h"), F.count("*").alias("k")).where("k > 1")
    blocks = lambda c, h: F.ceil(F.greatest(c / BLOCK, h / BLOCK_HASHES))
    rest = F.col("c") - F.col("main.c")
    shape = shape.withColumns({"blocks_main": blocks(F.col("main.c"), F.col("main.h")), "blocks_rest": blocks(rest, F.col("h") - F.col("main.h"))})
    shape = shape.withColumn("refine", F.lit(not whole) & (F.col("main.c") + rest * (F.col("blocks_main") + F.col("blocks_rest")) > FAN * F.col("c")))
    shape = scratch.write(shape.select("band", F.col("main.component").alias("largest"), "blocks_main", "blocks_rest", "refine"), "shape", refined=F.count_if("refine"))
    rows = placed.join(sized(shape, shape.said["n"]), "band")
    in_main = F.col("component") == F.col("largest")
    own = F.pmod(F.xxhash64("rid", "band"), F.when(in_main, F.col("blocks_main")).otherwise(F.col("blocks_rest")))
    at = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    zero = F.lit(0).cast("long")
    with_main = F.transform(F.sequence(zero, F.col("blocks_main") - 1), lambda i: at("m", i, zero, 1))
    with_rest = F.transform(F.sequence(zero, F.col("blocks_rest") - 1), lambda i: at("r", F.least(i, own), F.greatest(i, own), 0))
    cells = rows.where("not refine").withColumn("at", F.explode(F.when(in_main, F.array(at("m", own, zero, 0))).otherwise(F.concat(with_main, with_rest))))
    cells = cells.select(F.xxhash64("band", "at.kind", "at.i", "at.j").alias("cell"), "rid", "n", "component", "at.side", "registers")
    if not shape.said["refined"]:
        return cells
    large = scratch.write(rows.where("refine").select("rid", "n", "component", "registers").dropDuplicates(["rid"]), "large")
    groups = scratch.write(rare_groups(large, sets, threshold), "groups")
    met = scratch.write(_met(groups).join(large, "rid"), "met")
    scratch.drop(groups)
    return cells.unionByName(_cells(met, sets, threshold, scratch, whole=True))
