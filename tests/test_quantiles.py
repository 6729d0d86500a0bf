import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.operators import calibrate, descriptives, evaluate, ledger, quantiles


@pytest.fixture(autouse=True)
def ranges_of_any_size(spark):
    """Small ranges aren't put together, so that values are carried."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantiles_equal_numpys_in_every_group(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice((rng.random(), round(rng.random(), 1), -3.0))) for g, n in (("a", 1), ("b", 2), ("c", 301), ("d", 2000), (None, 7)) for _ in range(n)] + [("c", None), ("e", None)]
    got = quantiles.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", {"lo": 0.0, "q": 0.1, "mid": 0.5, "hi": 0.9, "top": 1.0}, ["g"]).collect()
    assert len(got) == 6
    for r in got:
        own = [v for g, v in rows if g == r.g and v is not None]
        assert r.n == len(own)
        for name, q in (("lo", 0), ("q", 0.1), ("mid", 0.5), ("hi", 0.9), ("top", 1)):
            assert r[name] == (pytest.approx(float(np.quantile(own, q)), abs=1e-12) if own else None)


def test_only_the_ranges_of_the_ranks_are_read_and_nothing_is_buffered(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    held = quantiles.Selection(df, "v")
    found = held.quantiles({"m": 0.5})
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert "percentile" not in plan and "collect_" not in plan and "in(__part" in plan.replace(" ", "") or "__part#" in plan
    assert found.first().m == float(np.median([i * 7919 % 20_011 for i in range(20_000)]))


def test_no_values(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert [tuple(r) for r in quantiles.quantiles(none, "v", {"m": 0.5}).collect()] == [(0, None)]
    assert quantiles.quantiles(none, "v", {"m": 0.5}, ["g"]).count() == 0
    assert tuple(quantiles.median_interval(none, "v").first()) == (0, None, None, None)
    assert calibrate.theta_p90(spark.createDataFrame([(None,)], "control double")).first().theta is None


def test_columns_of_their_own_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (4.0, 7.0)], "a double, b double")
    assert tuple(quantiles.quantiles_of(df, {"x": ("a", 0.5), "y": ("b", 0.5)}).first()) == (2.0, 6.0)


@pytest.mark.parametrize(("n", "p", "m"), [(1, 0.3, 1), (7, 0.5, 4), (50, 0.02, 3), (400, 0.45, 200), (5000, 0.51, 2500)])
def test_binomial_tail(n, p, m):
    plain = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(m, n + 1))
    assert quantiles.at_least(n, p, m) == pytest.approx(plain, rel=1e-9)


@pytest.mark.parametrize("n", [1, 2, 9, 60, 401])
def test_median_interval_equals_plain_resamples(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=n), 2)
    got = quantiles.median_interval(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double"), "v").first()
    drawn = np.sort(np.median(rng.choice(x, (10_000, n)), axis=1))
    assert (got.n, got.median) == (n, pytest.approx(float(np.median(x))))
    # Within what 10,000 draws leave open of the two bounds.
    assert drawn[180] <= got.low <= drawn[320] and drawn[9680] <= got.high <= drawn[9820]


def test_paired_gate_says_positive_only_above_0(spark):
    rows = lambda d: spark.createDataFrame([(i, 0.5 + d, 0.5 + 0.1 * (i % 3 - 1)) for i in range(90)], "i long, targeted double, control double")
    assert descriptives.paired_delta_interval(rows(0.2)).first().positive and not descriptives.paired_delta_interval(rows(0.0)).first().positive


def test_resampled_auroc_equals_plain_draws(spark):
    rng = np.random.default_rng(0)
    pos, neg = np.round(rng.normal(0.6, 1, 80), 1), np.round(rng.normal(0, 1, 120), 1)
    rows = [(float(v), 1) for v in pos] + [(float(v), 0) for v in neg] + [(None, 1), (0.5, None), (0.4, 7)]
    df = spark.createDataFrame(rows, "s double, t int")
    got = evaluate.resampled_auroc(df.repartition(3), "s", "t", replicates=4000).first()
    area = lambda a, b: float(((a[:, None] > b) + (a[:, None] == b) / 2).mean())
    drawn = np.sort([area(rng.choice(pos, 80), rng.choice(neg, 120)) for _ in range(4000)])
    assert (got.n_pos, got.n_neg, got.replicates, got.auroc) == (80, 120, 4000, pytest.approx(area(pos, neg)))
    assert drawn[60] <= got.low <= drawn[140] and drawn[3860] <= got.high <= drawn[3940]
    again = evaluate.resampled_auroc(df.repartition(7), "s", "t", replicates=4000).first()
    assert (again.low, again.high) == pytest.approx((got.low, got.high), abs=0.02)


def test_resampled_auroc_of_one_class_and_of_one_score(spark):
    df = spark.createDataFrame([(0.5, 1), (0.7, 1)], "s double, t int")
    assert tuple(evaluate.effect_gate(df, "s", "t").first()) == (None, None, None, 2, 0, 0, None)
    tied = spark.createDataFrame([(0.5, 1), (0.5, 0)], "s double, t int")
    assert tuple(evaluate.effect_gate(tied, "s", "t", replicates=700).first()) == (0.5, 0.5, 0.5, 1, 1, 700, False)


def plain_adjusted(ps, step, up):
    held = sorted((p, k) for k, p in ps if p is not None)
    m, out, best = len(held), {k: None for k, p in ps if p is None}, None
    ranked = [(k, min(1.0, step(p, i + 1, m))) for i, (p, k) in enumerate(held)]
    for k, s in ranked if up else reversed(ranked):
        best = s if best is None else (max if up else min)(best, s)
        out[k] = best
    return out


def test_missing_p_values_are_no_tests(spark):
    df = spark.createDataFrame([("f", 1, 0.01), ("f", 2, None), ("f", 3, 0.02)], "f string, k int, p double")
    assert {r.k: r.adjusted for r in evaluate.holm(df, "p", ["f"], "k").collect()} == {1: 0.02, 2: None, 3: 0.02}
    assert {r.k: r.adjusted for r in evaluate.benjamini_hochberg(df, "p", ["f"], "k").collect()} == {1: 0.02, 2: None, 3: 0.02}


def test_a_family_of_all_rows_is_many_tasks(spark):
    rng = random.Random(2)
    ps = [(k, rng.choice((None, rng.random() ** 4, 0.25))) for k in range(600)]
    df = spark.createDataFrame([("all", k, p) for k, p in ps] + [("other", -1, 0.5), (None, -2, 0.5)], "f string, k int, p double")
    for name, step, up in ((evaluate.holm, lambda p, i, m: p * (m - i + 1), True), (evaluate.benjamini_hochberg, lambda p, i, m: p * m / i, False)):
        got = {r.k: r.adjusted for r in name(df, "p", ["f"], "k").collect()}
        want = plain_adjusted(ps, step, up) | {-1: 0.5, -2: 0.5}
        assert got.keys() == want.keys() and all(a == b or math.isclose(a, b) for k in want for a, b in [(got[k], want[k])])
    from fidelis.operators.ranges import Ranged

    assert Ranged(df.where("f = 'all'"), ["f"], [F.col("p"), F.col("k")]).rows.select("__part").distinct().count() >= 3


def test_rows_without_a_score_are_no_threshold(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (None, 1), (0.9, 0), (0.5, 1)], "s double, t int")
    row = evaluate.operating_point(df, "s", "t").first()
    assert (row.threshold, round(row.macro_f1, 3), row.unscored) == (0.5, 0.333, 3)
    assert evaluate.operating_point(df.where("s is null"), "s", "t").count() == 0


def test_conflicting_commits_are_refused(spark, tmp_path):
    path = str(tmp_path / "log")
    make = lambda rows: spark.createDataFrame(rows, "k string, v string")
    with pytest.raises(ValueError, match="k1"):
        ledger.commit(make([("k1", "A"), ("k1", "B"), ("k2", "C")]), path, "k")
    assert ledger.commit(make([("k1", "A"), ("k1", "A"), ("k2", None)]), path, "k") == 2
    assert ledger.commit(make([("k1", "A"), ("k2", None), ("k3", "x")]), path, "k") == 1
    for bad in ([("k1", "B")], [("k2", "y")], [(None, "z")]):
        with pytest.raises(ValueError, match="second commits"):
            ledger.commit(make(bad), path, "k")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v").collect()) == [("k1", "A"), ("k2", None), ("k3", "x")]
