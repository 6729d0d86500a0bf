import numpy as np
import pytest

from fidelis.llm import whitening
from fidelis.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain(vectors):
    """n, deviations, variances, components and the trace of distinct whole vectors, by numpy's eigenvectors."""
    x = [tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array(fit, float) - np.array(sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, deviations, e[::-1], v[:, ::-1], e.sum(), np.array(x, float) - np.array(sums) / n


def check(rows, ids, vectors, most=16):
    n, deviations, e, v, trace, centred = plain(vectors)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    k = len(next(iter(got.values())))
    assert k == min(most, int((e > 1e-8 * e[0]).sum()))
    w = np.array([[got[i][c + 1].whitened for c in range(k)] for i in ids])
    want = centred @ v[:, :k] / np.sqrt(e[:k])
    want = want * np.sign((w * want).sum(axis=0))
    assert np.allclose(w, want, atol=1e-6)
    assert [got[i][1].deviation for i in ids] == deviations and {r.n for r in rows} == {n}
    assert np.allclose([got[ids[0]][c + 1].explained for c in range(k)], e[:k] / trace, rtol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-8


def test_query_equals_numpy(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    rows = QUERIES["op13_whitening"](spark, SF).collect()
    assert len(rows) == 16 * len(df)
    check(rows, [r.vec_id for r in df], [r.embedding for r in df])


def rows_of(spark, rows, kind="float", **how):
    return whitening.whiten(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3), **how).collect()


def test_repeats_count_once_in_the_fit(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(40, 5)).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(100 + i, vectors[3]) for i in range(60)]
    check(rows_of(spark, rows, "double"), [i for i, _ in rows], [v for _, v in rows])


def test_few_rows_and_flat_directions(spark):
    two = [(1, [0.0, 1.0, 2.0]), (2, [1.0, 1.0, 2.0]), (3, [5.0, 1.0, 2.0])]
    check(rows_of(spark, two), [1, 2, 3], [v for _, v in two])
    assert rows_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []


def test_rows_that_are_dropped(spark):
    rng = np.random.default_rng(1)
    good = [(i, v) for i, v in enumerate(rng.normal(size=(12, 3)).tolist())] + [(None, [0.25, 0.5, 0.75])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [float("nan"), 1.0, 1.0]), (53, [float("inf"), 1.0, 1.0]), (54, []), (55, [1.0]), (56, [1e300, 0.0, 0.0]), (57, [-float("inf"), 0.0, 0.0])]
    check(rows_of(spark, good + bad, "double"), [i for i, _ in good], [v for _, v in good])
    assert rows_of(spark, bad[:5]) == [] and rows_of(spark, []) == []


def test_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)], 1, 2.0, 3) for i in range(9)], "vec_id long, embedding array<float>, n long, x double, component int")
    assert whitening.whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and whitening.whiten(df).count() == 18


def test_deviations_beyond_64_bits(spark):
    far = [(i, [float(i) * 1e12, 1.0]) for i in range(5)]
    got = rows_of(spark, far, "double")
    n, deviations, *_ = plain([v for _, v in far])
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 1 << 63 else None for (i, _), d in zip(far, deviations, strict=True)}


@pytest.mark.parametrize("columns", [130])
def test_many_columns(spark, columns):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, columns)) * np.linspace(4, 0.1, columns)).tolist()
    check(rows_of(spark, list(enumerate(vectors)), "double"), list(range(300)), vectors)
