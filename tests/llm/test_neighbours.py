import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.llm import neighbours


def brute(rows, asks, k):
    good = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in (i for i in good if asks(i)):
        best = sorted((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def found(df, asks, k=20, **more):
    out = {}
    for r in neighbours.nearest(df, asks, k, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("shard", [16384, 150])
def test_recall_on_the_corpus(spark, monkeypatch, shard):
    monkeypatch.setattr(neighbours, "SHARD", shard)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got, want = found(df, F.col("vec_id") % 20 == 0), brute([(r.vec_id, r.embedding) for r in df.collect()], lambda i: i % 20 == 0, 20)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    for q in got:
        exact = dict(want[q])
        assert all(abs(s - exact[i]) < 1e-12 for i, s in got[q] if i in exact)


def test_copies_tie_to_smaller_ids_and_odd_rows_take_no_part(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(40)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for i in range(200)]
    rows += [(500, None), (501, [0.0] * 6), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (505, [1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, shard string")
    want = brute([r for r in rows if r[0] != 505], lambda i: i % 20 == 0, 20)
    got = found(df, F.col("vec_id") % 20 == 0, confidence=0.999999999)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert found(df, F.col("vec_id") == 0) == {0: [(1, 0.5)]}
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0


def test_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 1e-3


def surface(n, seed):
    """n vectors near a surface of two dimensions in 24, of norms near 1."""
    rng = np.random.Generator(np.random.PCG64(seed))
    flat = rng.uniform(-1, 1, (n, 2))
    bent = np.column_stack([np.sin(flat @ np.array([a, b]) * 2) for a in (1, 2, 3) for b in range(-4, 4)]) + 0.01 * rng.standard_normal((n, 24))
    return bent / np.linalg.norm(bent, axis=1)[:, None] * rng.uniform(0.999, 1.001, (n, 1))


def test_rows_sent_grow_with_the_rows_where_vectors_have_structure(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 250)
    monkeypatch.setattr(neighbours, "LEAF", 64)
    sums = []
    for n in (3000, 12000):
        v = surface(n, 1)
        df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
        sent = []
        got = found(df, F.col("vec_id") % 20 == 0, sent=sent)
        want = brute(list(enumerate(v.tolist())), lambda i: i % 20 == 0, 20)
        assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)
        sums.append(sum(sent))
    assert sums[1] <= 5 * sums[0]


@pytest.mark.parametrize("shard", [16384, 60])
def test_norms_of_all_sizes(spark, monkeypatch, shard):
    monkeypatch.setattr(neighbours, "SHARD", shard)
    rng = np.random.Generator(np.random.PCG64(8))
    v = rng.standard_normal((400, 5)) * 10.0 ** rng.integers(-3, 4, (400, 1))
    v[7] *= 1e6
    rows = list(enumerate(v.tolist())) + [(900, [1e-300] * 5), (920, [1e300, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(df, F.col("vec_id") % 20 == 0), brute(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)


def test_a_cell_that_got_too_much_is_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 50)
    monkeypatch.setattr(neighbours, "SAMPLE", 1)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got, want = found(df, F.col("vec_id") % 20 == 0), brute([(r.vec_id, r.embedding) for r in df.collect()], lambda i: i % 20 == 0, 20)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)


def test_the_least_of_several_vectors_of_an_id_takes_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 5.0]), (1, [2.0, -5.0]), (1, [3.0, 0.0]), (1, None), (2, [1.5, 0.0])]
    for own in (rows, rows[::-1]):
        df = spark.createDataFrame(own, "vec_id long, embedding array<double>")
        assert [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 2.0), (0, 2, 2, 1.5)]
