import pytest

from fidelis.operators import assurance, views


def test_each_feed_sees_its_violation_and_spares_what_is_fine(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "negative long, positive long")
    scores = lambda *s: spark.createDataFrame(list(enumerate(s, 1)), "instance long, score double")
    core = lambda *s: [tuple(r) for r in assurance.easy_core(pairs, scores(*s), "instance", "score", 0.6).collect()]
    assert core(0.1, 0.9, 0.2, 0.1, 0.5, 0.5) == [] and core(0.1, 0.9, 0.2, 0.8, 0.5, 0.5) == [(2.5 / 3, 3)]
    # A missing score leaves its pair out; without a pair nothing shows that the core is hard.
    assert core(0.1, None, 0.2, 0.1, 0.5, 0.5) == [] and core(None, None, None, None, None, None) == [(None, 0)]
    judged = spark.createDataFrame([(1, True), (2, False), (3, None)], "run int, conformant boolean")
    assert {r.run for r in assurance.nonconformant(judged).collect()} == {2, 3}


def test_manifest_differences_by_group(spark):
    rows = [(1, "a", "x"), (2, "a", None), (3, None, "y"), (4, "b", "z")]
    digests = lambda r: assurance.entry_digests(spark.createDataFrame(r, "id int, split string, v string"), ["split"], ["id", "v"])
    differ = lambda again: {r.split: (r.recorded is None, r.found is None) for r in assurance.manifest_differences(digests(rows), digests(again), ["split"]).collect()}
    assert differ(rows[::-1]) == {} and differ(rows[:3]) == {"b": (False, True)}
    assert differ([*rows[:2], (3, None, "Y"), *rows[3:], (5, "c", "n")]) == {None: (False, False), "c": (True, False)}
    assert differ([*rows, rows[0]]) == {"a": (False, False)}


def test_obligations_pass_only_by_a_record_of_this_version(spark):
    given = {
        "predictor_view": spark.createDataFrame([("1", "train")], "instance_id string, split string"), "train_labels": spark.createDataFrame([("1", "faithful")], "instance_id string, label string"),
        "hidden_view": spark.createDataFrame([("1",)], "instance_id string"), "audit_view": spark.createDataFrame([("h",)], "audit_id string"),
    }
    schema = "obligation string, attested_by string, corpus_version string"
    report = lambda *records: views.whole_report(given, spark.createDataFrame(list(records), schema), "v2")
    found = {r.check: (r.kind, r.passed, r.attested_by) for r in report(("N12.2", "b", "v2"), ("N12.2", "a", "v2"), ("N12.5", "a", "v1"), ("N13.2", None, "v2"), ("other", "a", "v2")).collect()}
    assert len(found) == 7 and sum(k == "verified" and ok for k, ok, _ in found.values()) == 4
    assert [found[c] for c in views.ATTESTED] == [("attested", True, "a"), ("attested", False, None), ("attested", False, None)]
    assert assurance.breaches(report()).count() == 3 and assurance.breaches(report(*((o, "a", "v2") for o in views.ATTESTED))).count() == 0
    with pytest.raises(ValueError, match="audit_view"):
        views.whole_report({k: v for k, v in given.items() if k != "audit_view"}, spark.createDataFrame([], schema), "v2")
