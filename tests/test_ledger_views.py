import hashlib
import json

import pytest
from pyspark.sql import functions as F

from fidelis.operators import assurance, identity, ingest, ledger, views
from fidelis.sources import readers
from fidelis.streaming import ledger_stream


def test_digests_are_of_canonical_json(spark):
    rows = [("a", "b"), (None, "x"), ("é /", "q\x1f\x0b\"\\\n"), ("\x7f", None), ("", "")]
    df = spark.createDataFrame(rows, "a string, r string")
    got = [r[0] for r in df.select(identity.baseline_digest(F.col("a"), F.col("r"))).collect()]
    want = [hashlib.sha256(json.dumps({"chosen_answer": a, "rationale": r}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for a, r in rows]
    assert got == want
    held = df.withColumn("d", identity.baseline_digest(F.col("a"), F.col("r")))
    assert identity.verify_digest(held, "a", "r", "d").count() == 5
    with pytest.raises(Exception, match="mismatch"):
        identity.verify_digest(held.withColumn("r", F.lit("changed")), "a", "r", "d").count()


def test_keys_do_not_meet(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "d string, r string")
    assert df.select(identity.source_key(F.col("d"), F.col("r"))).distinct().count() == 2
    maps = spark.range(1).select(identity.generator_key(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))), identity.generator_key(F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("1")))).first()
    assert maps[0] == maps[1] == '{"a":"2","b":"1"}'


@pytest.mark.parametrize("n", [0, 1, 2, 57])
def test_positions_and_derangement(spark, n):
    ids = [f"{i * 37 % 101:03d}" for i in range(n)]
    df = identity.assign_position(spark.createDataFrame([(i,) for i in ids], "id string").repartition(3), "id")
    assert sorted((r.id, r.pos) for r in df.collect()) == [(x, i) for i, x in enumerate(sorted(ids))]
    got = {r.id: r.partner for r in identity.derangement(df, "id").collect()}
    order = sorted(ids)
    assert got == ({x: order[(i + 1) % n] for i, x in enumerate(order)} if n > 1 else {})


def test_pool_verification(spark):
    df = spark.createDataFrame([("b",), ("a",)], "id string")
    digest = hashlib.sha256(b"a\nb").hexdigest()
    assert ingest.verify_pool(df, "id", 2, digest).count() == 1
    with pytest.raises(Exception, match="manifest"):
        ingest.verify_pool(df, "id", 3, digest).count()


BASE = {"question_id": "q1", "image_id": "7", "question": " What? ", "choices": ["a", "b"], "correct_choice_idx": 1, "rationales": ["r"]}


@pytest.mark.parametrize(("change", "reason"), [
    ({}, None), ({"question_id": ""}, "missing question_id"), ({"image_id": None}, "missing image_id"), ({"question": " 　"}, "empty question"), ({"choices": ["only"]}, "malformed choices (need >=2 options)"),
    ({"choices": None}, "malformed choices (need >=2 options)"), ({"choices": ["a", " "]}, "empty option text"), ({"correct_choice_idx": 9}, "gold index missing or out of range"),
    ({"correct_choice_idx": None}, "gold index missing or out of range"), ({"correct_choice_idx": -1}, "gold index missing or out of range"), ({"question_id": "", "question": ""}, "missing question_id"),
])
def test_ingestion(spark, tmp_path, change, reason):
    (tmp_path / "a.json").write_text(json.dumps([BASE | change]))
    (tmp_path / "b.json").write_text(json.dumps([]))
    out = ingest.normalize(readers.raw_records(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]), "pool")
    bad, good = ingest.exclusions(out).collect(), ingest.records(out).collect()
    assert [r.reason for r in bad] == ([reason] if reason else [])
    if not reason:
        assert (good[0].question, good[0].image_ref, good[0].record_id) == ("What?", "coco/7", "q1")
    elif reason == "missing question_id":
        assert bad[0].raw_record_id == "<missing question_id>"


def test_log_scan(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    line = lambda k: json.dumps({"key": k, "payload": "p"})
    path.write_text(line("a") + "\n" + line("b") + "\n" + '{"key": "c", "pay')
    assert [r.key for r in readers.json_lines(spark, str(path)).orderBy("line_no").collect()] == ["a", "b"]
    many = [f"k{i:05d}" for i in range(3000)]
    path.write_text("".join(line(k) + "\n" for k in many) + line("torn"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    assert [(r.line_no, r.key) for r in readers.json_lines(spark, str(path)).orderBy("line_no").collect()] == list(enumerate(many))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    path.write_text("")
    assert readers.json_lines(spark, str(path)).count() == 0
    path.write_text(line("a") + "\n" + "garbage\n" + line("b") + "\n")
    with pytest.raises(Exception, match="corrupt"):
        readers.json_lines(spark, str(path)).collect()


def test_commits_are_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    path = str(tmp_path / "log")
    assert ledger.commit(df, path, "k") == 2 and ledger.commit(df, path, "k") == 0
    # The log holds (2, "b"): a second payload of 2 halts, and 3 isn't committed beside it.
    with pytest.raises(ValueError, match="second commits"):
        ledger.commit(df.selectExpr("k + 1 as k", "v"), path, "k")
    assert spark.read.parquet(path).count() == 2
    assert ledger.commit(df.where("k = 2").unionAll(df.where("k = 2").selectExpr("k + 1", "v")), path, "k") == 1
    assert ledger.no_duplicates(spark.read.parquet(path), "k").count() == 3
    with pytest.raises(Exception, match="twice"):
        ledger.no_duplicates(df, "k").count()


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "append"), ("a", 2, "seal"), ("a", 3, "append"), ("a", 4, "seal"), ("b", 1, "append")], "instance string, seq long, kind string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ledger_stream.sealed_log(stream).writeStream.format("memory").queryName("sealed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("sealed")) == key(ledger_stream.sealed_log_batch(rows)) and spark.table("sealed").where("not accepted").count() == 2
    # Two payloads of "a" in a batch halt the stream before anything is written; one of each key is committed once in two runs.
    with pytest.raises(Exception, match="second commits"):
        ledger_stream.commit_stream(stream.where("seq < 3"), str(tmp_path / "out"), "instance", str(tmp_path / "0")).awaitTermination()
    assert not (tmp_path / "out").exists()
    for run in ("1", "2"):
        ledger_stream.commit_stream(stream.where("seq < 2"), str(tmp_path / "out"), "instance", str(tmp_path / run)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_registry_configuration_shard(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# c\n\n i cannot \nn/a\n")
    assert readers.registry(spark, str(tmp_path / "r.txt")) == ("i cannot", "n/a")
    (tmp_path / "e.txt").write_text("# none\n")
    with pytest.raises(ValueError, match="no pattern"):
        readers.registry(spark, str(tmp_path / "e.txt"))
    (tmp_path / "c.json").write_text(json.dumps({"k_grid": [2, 3]}))
    assert readers.configuration(spark, str(tmp_path / "c.json"), ("k_grid",))["k_grid"] == [2, 3]
    with pytest.raises(ValueError, match="missing"):
        readers.configuration(spark, str(tmp_path / "c.json"))
    (tmp_path / "000000000042.jpg").write_bytes(b"x")
    assert readers.image_files(spark, str(tmp_path / "*.jpg")).first().record_id == "42"
    pool = spark.range(10).select("id", F.col("id").alias("pos"))
    assert [r.id for r in readers.shard(pool, 2, 4).collect()] == [2, 3]
    readers.write_manifest(pool.agg(F.count("*").alias("n")), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().n == 10
    assert ingest.no_forbidden_columns(pool.withColumn("label", F.lit(1))) == ["label"]
    assert spark.range(1).select(ingest.image_path(F.lit("coco/42"), "/d/")).first()[0] == "/d/000000000042.jpg"


LEAKS = [
    ("conformant", {}, set()), ("label", {"extra2": {"label": "x"}}, {"predictor_view_exclusions"}), ("generator", {"extra1": {"generator_id": "g"}}, {"predictor_view_exclusions"}),
    ("margins", {"extra1": {"margins": "m"}}, {"predictor_view_exclusions"}), ("vallabel", {"labels": ["i-001", "i-002"]}, {"train_label_join_restriction"}),
    ("audit", {"audit": ["a-77", "i-002"]}, {"audit_non_joinability"}), ("splitmix", {"split2": "ood-model", "labels": ["i-001", "i-002"]}, {"train_label_join_restriction", "split_isolation"}),
    ("unknown", {"labels": ["i-001", "i-9"]}, {"train_label_join_restriction", "split_isolation"}),
]


@pytest.mark.parametrize(("name", "m", "failing"), LEAKS)
def test_boundaries(spark, name, m, failing):
    predictor = spark.createDataFrame([("i-001", "train", m.get("extra1", {})), ("i-002", m.get("split2", "validation"), m.get("extra2", {}))], "instance_id string, split string, extra map<string,string>")
    labels = spark.createDataFrame([(i, "faithful") for i in m.get("labels", ["i-001"])], "instance_id string, label string")
    audit = spark.createDataFrame([(i,) for i in m.get("audit", ["a-77", "a-78"])], "audit_id string")
    report = views.boundary_report({"predictor_view": predictor, "train_labels": labels, "hidden_view": labels, "audit_view": audit})
    assert {r.check for r in report.where("not passed").collect()} == failing and report.count() == 4
    assert not set(views.ATTESTED) & {r.check for r in report.collect()}


def test_a_missing_view_halts_and_a_column_is_seen(spark):
    with pytest.raises(ValueError, match="audit_view"):
        views.boundary_report({"predictor_view": None, "train_labels": None, "hidden_view": None})
    df = spark.createDataFrame([("i", "train", "x")], "instance_id string, split string, label string")
    assert views.check_exclusions(df).first().violations == 1


def test_forbidden_keys_of_every_event_are_seen(spark, tmp_path):
    import duckdb
    from parity import duck_rows, spark_rows

    from fidelis.plans.catalog import ORACLE_SQL, QUERIES

    props = ['{"k": 1}', '{"label": null, "k": {"margins": 1}}', '{"margins": 1, "a": 2, "correct": true}', "[1]", "x", None, "{}", '{"a": 1, "a": 2}', '{"labels": 1}']
    spark.createDataFrame(list(enumerate(props, 1)), "event_id long, props string").write.parquet(str(tmp_path / "in"))
    (tmp_path / "events.parquet").symlink_to(tmp_path / "in")
    rows = {r.event_id: (r.keys, r.forbidden) for r in QUERIES["ragged_view_rows"](spark, str(tmp_path)).collect()}
    assert rows[1] == ("k", "") and rows[2] == ("k,label", "label") and rows[3] == ("a,correct,margins", "correct,margins") and rows[9] == ("labels", "")
    assert rows[4] == rows[5] == rows[6] == (None, None) and rows[7] == ("", "") and rows[8] == ("a", "")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/in/*.parquet'")
    assert spark_rows(QUERIES["ragged_view_rows"](spark, str(tmp_path))) == duck_rows(con, ORACLE_SQL["ragged_view_rows"])


def test_assurance(spark):
    rows = [(1, "faithful", "S3", None, "train", "a"), (1, "faithful", "S3", None, "validation", "a"), (2, "faithful", "S1", "D1", None, "b")]
    report = assurance.release_report(assurance.standard_checks(spark.createDataFrame(rows, "instance long, label string, state string, reason_code string, split string, scene string")))
    assert {r.check: r.violations for r in report.collect()} == {"one_entry_per_instance": 1, "label_table": 1, "split_present": 1, "scene_in_one_split": 1}
    assert not assurance.releasable(report).first().releasable
