import pytest
from pyspark.sql import functions as F

from fidelis.operators import assemble, evaluate


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "s double, t int")


@pytest.mark.parametrize(("pairs", "want"), [
    ([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)], 1.0), ([(0.9, 0), (0.1, 1)], 0.0), ([(0.5, 0), (0.5, 1), (0.5, 1)], 0.5), ([(0.5, 1)], None), ([(None, 0), (0.1, 1)], None), ([(1.0, 0), (1.0, 1), (2.0, 1), (0.0, 0)], 0.875),
])
def test_auroc(spark, pairs, want):
    got = evaluate.auroc(scored(spark, pairs), "s", "t").first()
    assert got.auroc == want


def test_macro_f1_and_operating_point(spark):
    df = scored(spark, [(0.1, 0), (0.4, 1), (0.35, 0), (0.8, 1)])
    row = evaluate.operating_point(df, "s", "t").first()
    assert (row.threshold, row.macro_f1) == (0.4, 1.0)
    assert evaluate.operating_point(scored(spark, [(0.2, 1), (0.7, 1)]), "s", "t").first().threshold == 0.2
    assert df.agg(evaluate.macro_f1(F.col("t"), F.lit(1))).first()[0] == pytest.approx((2 / 3 + 0) / 2)


def test_kappa(spark):
    df = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15 + [(None, 1)], "a int, b int")
    row = evaluate.kappa(df, "a", "b").first()
    assert row.n == 50 and row.kappa == pytest.approx(0.4) and row.low < 0.4 < row.high
    assert evaluate.kappa(df.where("a is null"), "a", "b").first().kappa is None


def test_adjustments(spark):
    ps = [0.01, 0.04, 0.03, 0.03, 0.5]
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "f string, k int, p double")
    order = sorted(range(5), key=lambda i: (ps[i], i))
    holm, bh, top = {}, {}, 0.0
    for r, i in enumerate(order):
        top = max(top, min(1.0, ps[i] * (5 - r)))
        holm[i] = top
    low = 1.0
    for r in range(4, -1, -1):
        low = min(low, ps[order[r]] * 5 / (r + 1))
        bh[order[r]] = low
    assert {r.k: pytest.approx(r.adjusted) for r in evaluate.holm(df, "p", ["f"], "k").collect()} == holm
    assert {r.k: pytest.approx(r.adjusted) for r in evaluate.benjamini_hochberg(df, "p", ["f"], "k").collect()} == bh


def test_coverage(spark):
    truth = spark.createDataFrame([(1,), (2,)], "i long")
    said = lambda rows: tuple(evaluate.coverage(spark.createDataFrame([(r,) for r in rows], "i long"), truth, "i").first())
    assert said([1, 2]) == (0, 0, 0, True) and said([1]) == (1, 0, 0, False) and said([1, 1, 3]) == (1, 1, 1, False)


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 4 == 0).cast("double").alias("v"), (F.col("id") % 2).alias("s"))
    row = evaluate.bootstrap(df, "id", "v", ["s"], 300).first()
    assert row.low < 0.25 < row.high and row.high - row.low < 0.1 and row.replicates == 300


def test_splits_never_divide_a_scene(spark):
    rows = [(i, i % 5, ["x", "y"][i % 2], f"q{i % 7}", f"s{i % 40}", "faithful" if i % 3 else "unfaithful") for i in range(400)]
    df = spark.createDataFrame(rows, "instance long, generator long, dataset string, qtype string, scene string, label string")
    out = assemble.assign_splits(df, [4], [], ["q6"]).cache()
    iid = out.where("split in ('train', 'validation', 'iid-test')")
    assert iid.groupBy("scene").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    closed = out.where("qtype = 'q6'").select("scene")
    assert out.where("split in ('train', 'validation')").join(closed, "scene", "left_semi").count() == 0
    sizes = {(r.split, r.label): r["count"] for r in assemble.balance(out).groupBy("split", "label").count().collect()}
    assert sizes.get(("train", "faithful")) == sizes.get(("train", "unfaithful"))
    with pytest.raises(Exception, match="incomplete"):
        assemble.assemble(out.withColumn("label", F.lit(None).cast("string")), ("label",)).count()
    assert tuple(assemble.totality(df, df.unionAll(df.limit(1)).where("instance <> 5"), "instance").first()[:2]) == (1, 0)


def test_kappa_of_pairs_has_the_interval_of_one_pair(spark):
    rows = [(i, r, v) for i, (a, b) in enumerate([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15) for r, v in (("p", a), ("q", b))] + [(99, "p", 1), (98, "q", None)]
    got = evaluate.kappa_pairs(spark.createDataFrame(rows, "i long, r string, v int"), "i", "r", "v").collect()
    pair = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15, "a int, b int")
    one = evaluate.kappa(pair, "a", "b").first()
    assert len(got) == 1 and got[0].n == 50
    assert all(got[0][c] == pytest.approx(one[c]) for c in ("kappa", "low", "high"))
    same = spark.createDataFrame([(i, r, 1) for i in range(4) for r in "pq"], "i long, r string, v int")
    assert evaluate.kappa_pairs(same, "i", "r", "v").first().low is None
