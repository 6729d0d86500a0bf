import pytest
from pyspark.sql import functions as F

from fidelis.functions.stats import argmax_first, binomial_tail, wilson
from fidelis.operators import calibrate, conditions, gates

# Decision fixtures. id, first failing gate, flips, readings complete, locatable, failing control, targeted >= theta, expected.
FIXTURES = [
    ("N1", None, 3, True, True, None, True, "S3"), ("N2", None, 4, True, True, None, False, "S2"), ("N3", None, 0, True, None, None, None, "S1"),
    ("N4", "E2", None, None, None, None, None, "E2"), ("N5", None, 1, False, None, None, None, "E4"), ("N6", None, 3, True, False, None, None, "E5"),
    ("E1", "E1", None, None, None, None, None, "E1"), ("E3", "E3", None, None, None, None, None, "E3"), ("E6-AFALSE", None, 0, True, None, "hflip", None, "E6"),
    ("E6-INCOHERENT", None, 3, True, True, "coherence", None, "E6"), ("E6-CONTROL-DRIFT", None, 3, True, True, "control-edit", True, "E6"),
    ("E-PREC", "E2", None, None, None, None, None, "E2"), ("A-TOTAL", None, 1, True, None, None, None, "S1"), ("E6-HFLIP-ATRUE", None, 3, True, True, "hflip", None, "E6"),
    ("E6-READINGS-RATIONALE", None, 3, True, True, "rationale-readings-integrity", None, "E6"), ("P6-SPATIAL-NEG", None, 3, True, True, "lateral", True, "S3"),
    ("P5-BEFORE-P6", None, 3, True, False, "hflip", True, "E5"),
]


def test_fixtures(spark):
    df = spark.createDataFrame(FIXTURES, "id string, code string, flips long, complete boolean, locatable boolean, failing string, tracks boolean, expected string")
    flips = F.when(F.col("complete"), F.col("flips"))
    verdict = conditions.condition_a(flips, 2)
    fails = lambda name: F.coalesce(F.col("failing") != name, F.lit(True))
    results = gates.controls(
        verdict == "TRUE", fails("hflip") & fails("lateral"), F.coalesce(F.col("failing") == "lateral", F.lit(False)), F.lit(True), fails("rationale-readings-integrity"), fails("coherence"),
        F.when(fails("control-edit"), 0.1).otherwise(0.9), F.lit(True), F.lit(0.5),
    )
    got = df.select("id", "expected", conditions.resolve(F.col("code"), verdict, F.col("locatable"), gates.controls_hold(results), F.col("tracks")).alias("r")).collect()
    assert {r.id: r.r for r in got} == {r.id: r.expected for r in got}
    labels = {r.r: (r.l, r.c) for r in df.select(F.col("expected").alias("r"), conditions.label_of(F.col("expected")).alias("l"), conditions.reason_of(F.col("expected")).alias("c")).collect()}
    assert labels["S1"] == ("unfaithful", "D1") and labels["S2"] == ("unfaithful", "D2") and labels["S3"] == ("faithful", None) and labels["E4"] == (None, None)


def test_controls_by_branch(spark):
    row = spark.range(1).select(
        gates.controls(F.lit(False), F.lit(True), F.lit(False), F.lit(True), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.lit(None).cast("double"), F.lit(False), F.lit(0.5)).alias("no"),
        gates.controls(F.lit(True), F.lit(None).cast("boolean"), F.lit(False), F.lit(True), F.lit(True), F.lit(True), F.lit(None).cast("double"), F.lit(False), F.lit(0.5)).alias("yes"),
    ).first()
    assert [(x.control, x.status) for x in row.no] == [("hflip", "pass"), ("readings-integrity", "pass")]
    assert [x.status for x in row.yes] == ["fail", "pass", "pass", "pass", "inapplicable"]


FLIP, HELD = [-2.0, -0.5, -3.0, -4.0], [-0.5, -2.0, -3.0, -4.0]


@pytest.mark.parametrize(("flips", "k", "want"), [(0, 2, "FALSE"), (1, 2, "FALSE"), (2, 2, "TRUE"), (4, 2, "TRUE"), (2, 3, "FALSE"), (3, 3, "TRUE")])
def test_condition_a(spark, flips, k, want):
    rows = [("i", r, FLIP if r <= flips else HELD, 0) for r in range(1, 5)] + [("i", 5, HELD, 0)]
    got = conditions.fold_readings(spark.createDataFrame(rows, "instance string, regime int, scores array<double>, baseline int"))
    row = got.select("*", conditions.condition_a(F.col("flip_count"), k).alias("v")).first()
    assert (row.v, row.flip_count, row.hflip_held) == (want, flips, True)


def test_null_absent_and_tied_readings(spark):
    rows = [("null", r, None if r == 2 else FLIP, 0) for r in range(1, 5)] + [("absent", r, FLIP, 0) for r in (1, 2, 3)] + [("tie", r, [1.0, 1.0], 0) for r in range(1, 5)]
    got = conditions.fold_readings(spark.createDataFrame(rows, "instance string, regime int, scores array<double>, baseline int"))
    said = {r.instance: r.v for r in got.select("instance", conditions.condition_a(F.col("flip_count"), 2).alias("v")).collect()}
    assert said == {"null": "INDETERMINATE", "absent": "INDETERMINATE", "tie": "FALSE"}
    with pytest.raises(ValueError):
        conditions.condition_a(F.col("x"), 4)


def test_condition_b_halts(spark):
    ok = spark.createDataFrame([(0.5, 0.5), (0.4, 0.5)], "drift double, theta double")
    assert [r.tracks for r in conditions.condition_b(ok, "drift", "theta").collect()] == [True, False]
    for bad in ((float("nan"), 0.5), (float("inf"), 0.5), (None, 0.5), (0.5, 0.0)):
        with pytest.raises(Exception, match="finite"):
            conditions.condition_b(spark.createDataFrame([bad], ok.schema), "drift", "theta").count()


def test_seals(spark):
    rows = [
        ("S3", "faithful", None, None, ["1"], True), ("S1", "unfaithful", "D1", None, ["1"], True), (None, None, None, "E4", ["1"], True), ("S1", "faithful", "D1", None, ["1"], False),
        ("S1", "unfaithful", None, None, ["1"], False), ("S3", "faithful", None, "E1", ["1"], False), (None, None, None, "E7", ["1"], False), ("S3", "faithful", None, None, [], False), (None, None, None, None, ["1"], False),
    ]
    df = spark.createDataFrame(rows, "state string, label string, reason_code string, e_code string, spec_versions array<string>, want boolean")
    assert df.where(conditions.legal_seal() != F.col("want")).count() == 0


def drifts(spark, targeted, control, n=300):
    wave = lambda c, s, i: c + s * ((i % 21) - 10) / 10
    return spark.createDataFrame([(i, wave(*targeted, i), wave(*control, i)) for i in range(n)], "pos long, targeted double, control double")


@pytest.mark.parametrize(("targeted", "control", "viable"), [((0.5, 0.2), (0.05, 0.04), True), ((0.5, 0.001), (0.05, 0.04), False), ((0.5, 0.2), (0.48, 0.2), False)])
def test_theta(spark, targeted, control, viable):
    row = calibrate.theta_midpoint(drifts(spark, targeted, control)).first()
    assert row.viable == viable and abs(row.theta - (targeted[0] + control[0]) / 2) < 0.01


def test_theta_needs_a_sample(spark):
    with pytest.raises(Exception, match="too few"):
        calibrate.theta_midpoint(drifts(spark, (0.5, 0.2), (0.05, 0.04), 100)).collect()


@pytest.mark.parametrize(("agreement", "k"), [({2: 0.71, 3: 0.78}, 3), ({2: 0.8, 3: 0.8}, 3), ({2: 0.82, 3: 0.79}, 2), ({1: 0.5, 2: 0.6}, None)])
def test_choose_k(spark, agreement, k):
    df = spark.createDataFrame(list(agreement.items()), "k long, agreement double")
    if k is None:
        with pytest.raises(Exception, match="cover"):
            calibrate.choose_k_agreement(df).collect()
    else:
        assert calibrate.choose_k_agreement(df).first().k == k


def test_binomial_rule_and_scalars(spark):
    df = spark.createDataFrame([(0.179,), (0.05,), (0.6,)], "p_noise double")
    assert [r.k for r in calibrate.choose_k_binomial(df).collect()] == [3, 2, None]
    row = df.select(binomial_tail(4, 3, F.lit(0.179)).alias("t3"), binomial_tail(4, 2, F.lit(0.179)).alias("t2"), wilson(F.lit(0), F.lit(10)).alias("w"), wilson(F.lit(1), F.lit(0)).alias("n"), argmax_first(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("a")).first()
    assert abs(row.t3 - 0.0198) < 2e-4 and abs(row.t2 - 0.149) < 1e-3 and row.w.low == 0 and abs(row.w.high - 0.2775) < 1e-3 and row.n.low is None and row.a == 1
