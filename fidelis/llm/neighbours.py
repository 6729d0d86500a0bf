"""Approximate nearest neighbours: low-dimensional stable projections, kd-trees, and a chi-square stopping test.

Inner products are searched as distances. Vectors are dealt to bands by norm, half an octave each, and divided by the
largest norm R of their band; one more component brings them to length 1, a query is scaled to length 1 with 0 there, and the squared distance
is 2 - 2 <q, v> / (R |q|). A single vector of large norm so stretches only its own band. Vectors are projected on M
Gaussian directions; a projected squared distance is the true one times a chi-square variable of M degrees.

A kd-tree over the projections of a bounded sample (SAMPLE) cuts each band into cells of about SHARD vectors; every
vector is then dealt to its cell, and a cell that got more than twice that is split by a digest of the id. A search has two
rounds. In the first a query goes to the cells that promise most until they hold enough vectors, and comes back
with its k-th best product. In the second it goes to the other cells, with that product, but only to those whose box of
projections is so near that a better vector in it would, with probability CONFIDENCE, have projected as near. Within
a cell the same test is made leaf by leaf, nearest first, with the k-th best so far, and exact products are taken of what
opened leaves hold. So on vectors with structure a query meets few cells, however many there are; on vectors without any,
where all distances are alike, the test excludes next to nothing and every query meets every cell.

Equal vectors beyond the k + 1 of smallest ids can be in no result and are left out of the index; all are queries if asked.

Defined results: vectors that are null, all zero, of another size than most, or hold null or non-finite
components take no part; vec_id is the key, and one row of those that share it counts; other columns are ignored;
an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.llm.common import Scratch, sized, slices

M, SHARD, LEAF, CONFIDENCE = 8, 16384, 256, 0.97
#: Vectors of the tree's sample, in expectation; bytes of a shard's vectors; queries that are searched together.
SAMPLE, SHARD_BYTES, BLOCK = 65_536, 64 << 20, 512
RESULT = "query_id long, rank int, vec_id long, score double"
PLACED = "cell int, vec_id long, vector array<double>, spot array<double>"
ASKED = "cell int, part int, vec_id long, vector array<double>, kth double"
FOUND = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, degrees: int) -> float:
    """The p-quantile of the chi-square distribution with an even number of degrees, by bisection."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - tail(mid) < p else (low, mid)
    return high


def directions(dims: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).standard_normal((dims + 1, M))


def wide(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.empty((0, 1))


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Norms, by way of the largest component, so that no square overflows or vanishes."""
    most = np.abs(vectors).max(axis=1)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(axis=1))


def spots(vectors: np.ndarray, radius: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Projections of vectors, divided by the radius, that one more component has brought to length 1."""
    unit = vectors / radius[:, None]
    lift = np.sqrt(np.maximum(0.0, 1.0 - (unit**2).sum(axis=1)))
    return unit @ axes[:-1] + lift[:, None] * axes[-1]


def away(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) from boxes (columns)."""
    out = np.zeros((len(points), len(low)))
    for i in range(points.shape[1]):
        out += np.maximum(0.0, np.maximum(low[:, i] - points[:, i, None], points[:, i, None] - high[:, i])) ** 2
    return out


class Tree:
    """A kd-tree over each band's sample: where a band's root is, and nodes (axis, cut, left, right), a cell where axis is -1."""

    def __init__(self, bands: np.ndarray, points: np.ndarray, sizes: dict[int, int], shard: int):
        self.roots, self.nodes, self.cells = {}, [], []
        for band, n in sorted(sizes.items()):
            self.roots[band] = self._grow(band, points[bands == band], max(1, round(n / shard)))

    def _grow(self, band: int, points: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        if leaves == 1 or len(points) < 2:
            self.nodes.append((-1, 0.0, len(self.cells), -1))
            self.cells.append(band)
            return at
        axis = int(np.ptp(points, axis=0).argmax())
        few = leaves // 2
        cut = float(np.quantile(points[:, axis], few / leaves))
        self.nodes.append(None)
        below = points[:, axis] < cut
        self.nodes[at] = (axis, cut, self._grow(band, points[below], few), self._grow(band, points[~below], leaves - few))
        return at

    def place(self, bands: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Each point's cell."""
        out = np.empty(len(points), np.int32)
        todo = [(root, np.flatnonzero(bands == band)) for band, root in self.roots.items()]
        while todo:
            node, rows = todo.pop()
            axis, cut, left, right = self.nodes[node]
            if axis < 0:
                out[rows] = left
            elif len(rows):
                below = points[rows, axis] < cut
                todo += [(left, rows[below]), (right, rows[~below])]
        return out


class Cells:
    """Boxes, radii, sizes and numbers of parts of the cells that hold something."""

    def __init__(self, rows: list, tree: Tree, radii: dict[int, float], shard: int):
        self.number = np.array([r["cell"] for r in rows])
        self.size = np.array([r["n"] for r in rows])
        self.low, self.high = (np.array([[r[f"{f}{i}"] for i in range(M)] for r in rows]) for f in ("low", "high"))
        self.radius = np.array([radii[tree.cells[c]] for c in self.number])
        self.parts = np.where(self.size > 2 * shard, -(-self.size // shard), 1)

    def reach(self, queries: np.ndarray, axes: np.ndarray) -> np.ndarray:
        """Squared projected distances of the queries from the cells."""
        return away((queries / lengths(queries)[:, None]) @ axes[:-1], self.low, self.high)

    def first(self, reach: np.ndarray, enough: int) -> np.ndarray:
        """Which cells a query goes to first: those of the largest product to expect until they hold enough vectors."""
        hope = self.radius * (1 - reach / (2 * M))
        order = np.argsort(-hope, axis=1, kind="stable")
        held = np.cumsum(self.size[order], axis=1) - self.size[order]
        out = np.empty(reach.shape, bool)
        np.put_along_axis(out, order, held < enough, axis=1)
        return out


def _place(batches: Iterator[pa.RecordBatch], tree: Tree | None, radii: dict[int, float], dims: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, vector, band) with their spot and, given a tree, their cell; without one the cell is the band."""
    axes = directions(dims)
    for part in slices(batches, 4096):
        bands = part.column(2).to_numpy().astype(np.int64)
        at = spots(wide(part.column(1)), np.array([radii[x] for x in bands.tolist()]), axes)
        cell = tree.place(bands, at) if tree else bands
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * M, pa.int32()), pa.array(at.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), part.column(0), part.column(1), listed], ["cell", "vec_id", "vector", "spot"])


def _ask(batches: Iterator[pa.RecordBatch], cells: Cells, dims: int, enough: int, quantile: float) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, vector, kth) for each part of each cell to search: without kth the first ones, else the others in reach."""
    axes = directions(dims)
    for part in slices(batches, max(1, min(4096, (1 << 22) // len(cells.number)))):
        if not part.num_rows:
            continue
        queries = wide(part.column(1))
        kth, known = part.column(2).to_numpy(zero_copy_only=False).astype(float), ~np.asarray(part.column(2).is_null())
        reach = cells.reach(queries, axes)
        go = cells.first(reach, enough)
        if known.any():
            # The squared distance of a vector with the k-th best product.
            far = 2 - 2 * np.where(known, kth, -np.inf)[:, None] / lengths(queries)[:, None] / cells.radius
            go = ~go & (reach <= np.maximum(far, 0) * quantile)
        row, cell = np.nonzero(go)
        n = cells.parts[cell]
        row, cell = np.repeat(row, n), np.repeat(cell, n)
        each = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        for a in range(0, len(row), 4096):
            take = pa.array(row[a : a + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(cells.number[cell[a : a + 4096]].astype(np.int32)), pa.array(each[a : a + 4096].astype(np.int32)), *(part.column(i).take(take) for i in range(3))], ["cell", "part", "vec_id", "vector", "kth"])


class Shard:
    """Vectors of a shard in leaf order, with their ids, and the boxes of the leaves' projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, radius: float, k: int):
        leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            part = todo.pop()
            if len(part) <= LEAF:
                leaves.append(part)
                continue
            axis = int(np.ptp(points[part], axis=0).argmax())
            half = len(part) // 2
            part = part[np.argpartition(points[part, axis], half)]
            todo += [part[:half], part[half:]]
        self.low, self.high = (np.array([f(points[x], axis=0) for x in leaves]) for f in (np.min, np.max))
        self.ids, self.vectors, self.radius, self.k = [ids[x] for x in leaves], [vectors[x] for x in leaves], radius, k

    def search(self, asked: np.ndarray, queries: np.ndarray, kth: np.ndarray, axes: np.ndarray, quantile: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query, id and score of the nearest k found of each query, not below its kth (-inf: none yet).

        Each query opens leaves by growing distance, the nearest one first and then twice as many at a time, until
        the next is out of reach. The queries that open a leaf together share one matrix product.
        """
        length = lengths(queries)
        far = away((queries / length[:, None]) @ axes[:-1], self.low, self.high)
        order = np.argsort(far, axis=1, kind="stable")
        who, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        slack = 1e-9 * self.radius * length
        kth, live, at, step = kth.copy(), np.arange(len(queries)), 0, 1
        while at < order.shape[1] and len(live):
            opened = order[live, at : at + step]
            bound = np.maximum(0.0, 2 - 2 * kth[live] / length[live] / self.radius) * quantile
            ok = np.take_along_axis(far[live], opened, axis=1) <= bound[:, None]
            row, col = np.nonzero(ok)
            by = np.argsort(opened[row, col], kind="stable")
            rows, leaf = live[row[by]], opened[row, col][by]
            edges = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1], [True]))) if len(leaf) else []
            new: list[tuple] = [(who, ids, scores)]
            for a, b in zip(edges, edges[1:], strict=False):
                one, mine = leaf[a], rows[a:b]
                near = queries[mine] @ self.vectors[one].T
                q, v = np.nonzero(near >= (kth[mine] - slack[mine])[:, None])
                # What is not far below the k-th is taken again row by row, so that equal vectors have equal scores.
                got = (self.vectors[one][v] * queries[mine[q]]).sum(axis=1)
                other = self.ids[one][v] != asked[mine[q]]
                new.append((mine[q[other]], self.ids[one][v[other]], got[other]))
            who, ids, scores = (np.concatenate(x) for x in zip(*new, strict=True))
            best = np.lexsort((ids, -scores, who))
            who, ids, scores = who[best], ids[best], scores[best]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            last = rank == self.k - 1
            kth[who[last]] = np.maximum(kth[who[last]], scores[last])
            keep = rank < self.k
            who, ids, scores = who[keep], ids[keep], scores[keep]
            live, at, step = live[ok[:, -1]], at + step, step * 2
        return who, ids, scores


def _search(batches: Iterator[pa.RecordBatch], radii: dict[int, float], dims: int, k: int, quantile: float) -> Iterator[pa.RecordBatch]:
    """Rows (cell, part, asks, vec_id, vector, spot, kth): a shard's vectors, then its queries; shards one after another."""
    axes, now, held, shard = directions(dims), None, [], None
    for batch in slices(batches, BLOCK):
        keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)]).astype(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True]))) if len(keys) else []
        for a, b in zip(edges, edges[1:], strict=False):
            part, place = batch.slice(a, b - a), tuple(keys[a, :2])
            if place != now:
                now, held, shard = place, [], None
            ids, vectors = part.column(3).to_numpy(), wide(part.column(4))
            if not keys[a, 2]:
                held.append((ids, vectors, wide(part.column(5))))
            elif held or shard:
                if not shard:
                    shard = Shard(*(np.concatenate(x) for x in zip(*held, strict=True)), radii[int(place[0])], k)
                    held = []
                kth = np.where(np.asarray(part.column(6).is_null()), -np.inf, part.column(6).to_numpy(zero_copy_only=False).astype(float))
                who, found, scores = shard.search(ids, vectors, kth, axes, quantile)
                yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(found), pa.array(scores)], ["query_id", "vec_id", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, in double precision; of several vectors of one vec_id the least, entry by entry."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(F.forall("vector", real) & F.exists("vector", lambda x: x != 0), F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest(vectors: DataFrame, asks: Column, k: int = 20, confidence: float = CONFIDENCE, sent: list | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest inner products found for each row with `asks`; sent takes the number of rows dealt in each round."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "neighbours")
    largest = F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    rows = usable(vectors).withColumn("dims", F.size("vector")).withColumn("most", largest)
    # The norm by way of the largest component, so that no square overflows or vanishes.
    norm = F.col("most") * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most"))))
    rows = scratch.write(rows.withColumn("norm", norm).withColumn("band", F.round(2 * F.log2("norm")).cast("int")).select("vec_id", "vector", "dims", "band", "norm"), "rows")
    sizes = rows.groupBy("dims", "band").agg(F.count("*").alias("n"), F.max("norm").alias("radius")).collect()
    if not sizes:
        return spark.createDataFrame([], RESULT)
    by_dims: dict[int, int] = {}
    for r in sizes:
        by_dims[r["dims"]] = by_dims.get(r["dims"], 0) + r["n"]
    dims = min(by_dims, key=lambda x: (-by_dims[x], x))
    n, bands = by_dims[dims], {r["band"]: r["n"] for r in sizes if r["dims"] == dims}
    radii = {r["band"]: r["radius"] for r in sizes if r["dims"] == dims}
    shard, quantile = max(1, min(SHARD, SHARD_BYTES // (8 * dims))), chi_square_quantile(confidence, M)
    rows = rows.where(F.col("dims") == dims)

    copy = F.row_number().over(Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("vec_id"))
    held = rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("vec_id", "vector", "band")
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SAMPLE))) == 0) if max(bands.values()) > 1.5 * shard else rows.where("false")
    sample = some.select("vec_id", "vector", "band").mapInArrow(lambda it: _place(it, None, radii, dims), PLACED).select("cell", "spot").toArrow()
    tree = Tree(sample.column(0).to_numpy(), wide(sample.column(1).combine_chunks()).reshape(-1, M), bands, shard)
    placed = scratch.write(held.mapInArrow(lambda it: _place(it, tree, radii, dims), PLACED), "placed")
    edges = [f(F.get("spot", F.lit(i))).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(M)]
    cells = Cells(placed.groupBy("cell").agg(F.count("*").alias("n"), *edges).orderBy("cell").collect(), tree, radii, shard)
    of_cell = dict(zip(cells.number.tolist(), cells.radius.tolist(), strict=True))

    several = [(c, p) for c, p in zip(cells.number.tolist(), cells.parts.tolist(), strict=True) if p > 1]
    parted = placed.join(sized(spark.createDataFrame(several, "cell int, parts long"), len(several)), "cell", "left") if several else placed.withColumn("parts", F.lit(1))
    dealt = parted.select("cell", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(False).alias("asks"), "vec_id", "vector", "spot", F.lit(None).cast("double").alias("kth"))

    def search(queries: DataFrame, name: str) -> DataFrame:
        asked = scratch.write(queries.mapInArrow(lambda it: _ask(it, cells, dims, k + 1, quantile), ASKED), f"asked-{name}")
        if sent is not None:
            sent.append(placed.said["n"] + asked.said["n"])
        asked = asked.select("cell", "part", F.lit(True).alias("asks"), "vec_id", "vector", F.lit(None).cast("array<double>").alias("spot"), "kth")
        both = dealt.unionAll(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "asks", "vec_id")
        return both.mapInArrow(lambda it: _search(it, of_cell, dims, k, quantile), FOUND)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    queries = rows.where(asks).select("vec_id", "vector")
    first = search(queries.withColumn("kth", F.lit(None).cast("double")), "first").withColumn("rank", rank).where(F.col("rank") <= k)
    first = scratch.write(first, "found")
    if len(cells.number) > 1:
        kth = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("kth"))
        later = queries.join(kth, "vec_id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
        first = first.drop("rank").unionAll(search(later, "later")).withColumn("rank", rank).where(F.col("rank") <= k)
    return first.select("query_id", "rank", "vec_id", "score")
