"""Run guards, gate artifacts, adapters, resampling, conformance, release criteria and the manifest."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.operators import assemble, assurance, descriptives, evaluate, identity, images, ranges, run, views
from fidelis.sources import scratch
from fidelis.streaming import ledger_stream as streams


def test_adapters_are_built_when_asked_for():
    held, made = run.Adapters(), []
    held.register("a", lambda **kw: made.append(kw) or "model")
    assert made == [] and held.build("a", root="x") == "model" and made == [{"root": "x"}]
    with pytest.raises(ValueError, match="no adapter 'b'"):
        held.build("b")
    with pytest.raises(ValueError, match="already"):
        held.register("a", dict)


def test_a_run_starts_only_with_its_gate(spark, tmp_path):
    outputs = spark.createDataFrame([("x",)] * 19 + [(None,)], "answer string")
    gate = run.calibration_gate(outputs, F.col("answer"), F.lit("x"))
    path, shard = str(tmp_path / "gate.json"), spark.range(3)
    with pytest.raises(run.RunRefused, match="no gate artifact"):
        run.admit(shard, "g1-bf16", path)
    run.write_gate(gate, "g1-bf16", path)
    held = json.loads(open(path, encoding="utf-8").read())
    assert (held["n"], held["parseability"], held["agreement"], held["passed"], held["identity"]) == (20, 0.95, 1.0, True, "g1-bf16")
    assert run.admit(shard, "g1-bf16", path).count() == 3
    with pytest.raises(run.RunRefused, match="another identity"):
        run.admit(shard, "g2-bf16", path)
    with pytest.raises(run.RunRefused, match="quantized"):
        run.admit(shard, "g1-int8", path)
    run.write_gate(run.calibration_gate(outputs, F.col("answer"), F.lit("y")), "g1-bf16", path)
    with pytest.raises(run.RunRefused, match="failed gate"):
        run.admit(shard, "g1-bf16", path)
    lines = [run.log_line(spark, str(tmp_path / "log"), "gate-g1", f"line {i}") for i in range(3)]
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).orderBy("value").collect()] == sorted(lines)


def test_an_empty_gate_has_not_passed(spark):
    row = run.calibration_gate(spark.createDataFrame([], "answer string"), F.col("answer"), F.lit("x")).first()
    assert (row.n, row.passed) == (0, False)


def test_resampling_has_the_spread_of_plain_draws(spark):
    rng = np.random.default_rng(4)
    truth, a, b = rng.integers(0, 2, 300), rng.integers(0, 2, 300), rng.integers(0, 2, 300)
    stratum = np.arange(300) % 3
    rows = [(int(s), int(t), int(x), int(y)) for s, t, x, y in zip(stratum, truth, np.where(rng.random(300) < 0.7, truth, a), b, strict=True)]
    df = spark.createDataFrame(rows, "s int, truth int, a int, b int")
    cells = evaluate.resample_cells([r[1:] for r in rows])
    gain = np.array([(t == x) - (t == y) for t, x, y in cells])
    got = evaluate.resample(df, ["s"], ["truth", "a", "b"], lambda n: n @ gain / n.sum(axis=1), 4000).first()
    each = np.array([(t == x) - (t == y) for _, t, x, y in rows], float)
    means = [np.mean([each[i] for s in range(3) for i in rng.choice(np.flatnonzero(stratum == s), 100)]) for _ in range(4000)]
    assert got.value == pytest.approx(each.mean()) and got.replicates == 4000
    assert got.low == pytest.approx(np.quantile(means, 0.025), abs=0.015) and got.high == pytest.approx(np.quantile(means, 0.975), abs=0.015)
    assert evaluate.resample(df.where("false"), ["s"], ["truth"], lambda n: n[:, 0]).first().replicates == 0


def test_resampling_refuses_more_counts_than_it_holds(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "MOST_CELLS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        evaluate.resample(spark.range(9), [], ["id"], lambda n: n[:, 0])


def test_block_bootstrap_and_large_sample_intervals_agree(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(t), int(t if rng.random() < 0.8 else 1 - t), float(t + rng.standard_normal()), "s") for i, t in enumerate(rng.integers(0, 2, 2000))]
    df = spark.createDataFrame(rows, "key int, truth int, pred int, score double, split string")
    ci = evaluate.bootstrap(df.withColumn("hit", (F.col("truth") == F.col("pred")).cast("double")), "key", "hit", ["split"], 2000).first()
    card = {r.metric: r for r in evaluate.metric_table(df, "truth", "pred", "score", "v1", 20).collect()}
    assert ci.low == pytest.approx(card["accuracy"].low, abs=0.008) and ci.high == pytest.approx(card["accuracy"].high, abs=0.008)
    cells = evaluate.resample_cells([(0, 0), (0, 1), (1, 0), (1, 1)])

    def macro(n):
        tn, fp, fn, tp = (n[:, cells.index(c)] for c in ((0, 0), (0, 1), (1, 0), (1, 1)))
        return (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2

    drawn = evaluate.resample(df, ["split"], ["truth", "pred"], macro, 4000).first()
    assert drawn.value == pytest.approx(card["macro_f1"].value) and drawn.low == pytest.approx(card["macro_f1"].low, abs=0.006) and drawn.high == pytest.approx(card["macro_f1"].high, abs=0.006)
    assert card["auroc"].low < card["auroc"].value < card["auroc"].high and all(r.corpus_version == "v1" and r.n == 2000 for r in card.values())


def test_effect_gate_needs_its_lower_bound(spark):
    rows = [((i % 2) * 0.6 + (i % 7) / 7, i % 2) for i in range(400)]
    row = evaluate.effect_gate(spark.createDataFrame(rows, "s double, t int"), "s", "t").first()
    assert row.viable and row.auroc > row.low >= 0.71
    weak = evaluate.effect_gate(spark.createDataFrame([(s if i % 3 else 1 - s, t) for i, (s, t) in enumerate(rows)], "s double, t int"), "s", "t").first()
    assert not weak.viable


def test_a_missing_check_blocks_a_release(spark):
    names = sorted({c for cs in assurance.CRITERIA.values() for c in cs})
    made = lambda xs: spark.createDataFrame(xs, "check string, violations long")
    assert tuple(assurance.release(made([(c, 0) for c in names])).first()) == (True, "")
    assert tuple(assurance.release(made([(c, 0) for c in names if c != "analysis_plan"])).first()) == (False, "BL9")
    assert tuple(assurance.release(made([(c, int(c in ("DF2", "LF3"))) for c in names])).first()) == (False, "BL1,BL3")


def test_instability_counts_beyond_its_tolerance(spark):
    a = spark.createDataFrame([(i, "x") for i in range(10)], "k int, v string")
    b = a.withColumn("v", F.when(F.col("k") < 2, "y").otherwise(F.col("v")))
    assert assurance.unstable(a, b, "k", "v", 0.2).count() == 0 and assurance.unstable(a, b, "k", "v", 0.1).count() == 1
    assert assurance.unstable(a, b.where("k > 5"), "k", "v", 0.5).count() == 1


DECLARED = {
    "corpus_version": "v1", "spec_versions": ["1.0"], "selectors": {}, "views": {}, "rederivation": dict.fromkeys(assurance.REDERIVATION, "x"),
    "origins": {f"{k}:{v}": dict.fromkeys(assurance.LICENCES, "y") for k, v in (("generator", "g"), ("dataset", "d"))},
}


def test_the_manifest_counts_and_refuses_what_lacks(spark):
    entries = spark.createDataFrame([(1, "train", "faithful", "g", "d"), (2, "train", "unfaithful", "g", "d"), (3, "iid-test", "faithful", "g", "d")], "instance int, split string, label string, generator string, dataset string")
    routed = spark.createDataFrame([(7, "E1"), (8, "E4"), (9, "E4")], "instance int, e_code string")
    made = assurance.release_manifest(entries, routed, DECLARED, ["instance", "label"])
    assert made["entries"]["n"] == 3 and made["entries"]["routed"] == {"E1": 1, "E4": 2} and [s["n"] for s in made["splits"]] == [1, 1, 1]
    again = assurance.release_manifest(entries.orderBy(F.desc("instance")).repartition(3), routed, DECLARED, ["instance", "label"])
    assert again == made and assurance.release_manifest(entries.where("instance < 3"), routed, DECLARED, ["instance", "label"])["entries"]["digest"] != made["entries"]["digest"]
    assert json.loads(assurance.manifest_row(entries, routed, DECLARED, ["instance"]).first().manifest)["corpus_version"] == "v1"
    for lacking in ({k: v for k, v in DECLARED.items() if k != "views"}, DECLARED | {"rederivation": {}}, DECLARED | {"origins": {"generator:g": {}}}):
        with pytest.raises(ValueError, match="lack"):
            assurance.release_manifest(entries, routed, lacking, ["instance"])


def test_views_are_complete_or_refused(spark):
    df = spark.createDataFrame([(1, "train", "img", "q", "a|b", "a", "r")], ", ".join(f"{c} {'int' if c == 'instance_id' else 'string'}" for c in views.PREDICTOR))
    assert views.predictor_view(df).columns == list(views.PREDICTOR)
    for c in views.PREDICTOR:
        with pytest.raises(ValueError, match=c):
            views.predictor_view(df.drop(c))


def test_a_sealed_group_of_many_chunks_equals_the_batch_twin(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        rng = np.random.default_rng(6)
        for turn in range(2):
            rows = [("k", int(s) + 4000 * turn, "seal" if s == 2500 and turn else "append") for s in rng.permutation(4000)] + [("j", turn, "append")]
            spark.createDataFrame(rows, "instance string, seq long, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("instance string, seq long, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streams.judged_log(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got, want = spark.read.parquet(str(tmp_path / "out")), streams.sealed_log_batch(spark.read.parquet(str(tmp_path / "in")))
    assert got.count() == 8002 and got.exceptAll(want.select(got.columns)).count() == 0


def test_ranks_by_digest_of_a_group_that_holds_nearly_all(spark):
    import hashlib

    rows = [("a", i) for i in range(500)] + [("b", 1), (None, 2), (None, 3)]
    got = {(r.g, r.k): r["rank"] for r in ranges.ranked_by_digest(spark.createDataFrame(rows, "g string, k int"), ["g"], "k", "rank", "salt").collect()}
    for g in ("a", "b", None):
        own = sorted((hashlib.md5(f"salt{k}".encode()).hexdigest(), k) for x, k in rows if x == g)
        assert [got[g, k] for _, k in own] == list(range(1, len(own) + 1))


def test_the_digest_of_ids_is_that_of_their_lines(spark):
    import hashlib

    ids = [5, 40, 300, 2]
    row = identity.ids_digest(spark.createDataFrame([(i,) for i in ids], "k int").repartition(3), "k").first()
    assert (row.n, row.digest) == (4, hashlib.sha256("\n".join(sorted(map(str, ids))).encode()).hexdigest())
    assert tuple(identity.ids_digest(spark.range(0), "id").first()) == (0, hashlib.sha256().hexdigest())


def test_contamination_counts_distinct_runs(spark):
    said = "a b c d e f g h i j"
    texts = spark.createDataFrame([(1, f"x {said}"), (2, f"{said} {said}"), (3, "a b c"), (4, None)], "id int, text string")
    for most in (10, 0):
        got = {r.id: r.shared for r in descriptives.contamination(texts, "id", spark.createDataFrame([(said,), (None,)], "text string"), most=most).collect()}
        assert got == {1: 3, 2: 3}


def test_a_sweep_blackens_one_cell_at_a_time(spark):
    image = np.arange(8 * 16 * 3, dtype=np.uint8).reshape(8, 16, 3) | 1
    df = spark.createDataFrame([(1, 8, 16, bytearray(image.tobytes()))], "instance long, height int, width int, pixels binary")
    rows = images.sweep_cells(df).collect()
    assert sorted(r.cell for r in rows) == list(range(64))
    for r in rows:
        black = (np.frombuffer(bytes(r.pixels), np.uint8).reshape(8, 16, 3) == 0).all(axis=2)
        assert black.sum() == 2 and black[r.cell // 8, r.cell % 8 * 2]


def test_control_pairs_keep_their_strata(spark):
    df = spark.createDataFrame([(i, i % 2, f"s{i % 3}") for i in range(60)], "k int, t int, s string")
    pairs = assemble.control_sample(df, ["s"], "t", "k", 0.5).collect()
    assert len(pairs) == 15 and all(f"s{p.negative % 3}" == p.s == f"s{p.positive % 3}" and p.negative % 2 == 0 and p.positive % 2 == 1 for p in pairs)


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())


def test_token_matching_drift_is_that_of_greedy_matches(spark):
    from fidelis.functions import drift

    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((3, 5)), rng.standard_normal((4, 5))
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    cos = unit(a) @ unit(b).T
    p, r = cos.max(axis=0).mean(), cos.max(axis=1).mean()
    df = spark.createDataFrame([(a.tolist(), b.tolist(), []), (a.tolist(), a.tolist(), [])], "a array<array<double>>, b array<array<double>>, none array<array<double>>")
    rows = df.select(drift.token_matching_drift(F.col("a"), F.col("b")).alias("d"), drift.token_matching_drift(F.col("a"), F.col("none")).alias("e")).collect()
    assert rows[0].d == pytest.approx(1 - 2 * p * r / (p + r)) and rows[1].d == pytest.approx(0.0) and rows[0].e is None


def test_a_missing_scorer_package_is_told():
    from fidelis.functions import drift

    with pytest.raises(RuntimeError, match="bert_score"):
        drift.bertscore_model("roberta-large")()
