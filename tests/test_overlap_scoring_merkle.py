import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fidelis.functions import logits
from fidelis.operators import assemble, conditions, identity, merkle, overlap, scoring
from fidelis.plans import catalog

BOX = "image long, k long, top long, left long, bottom long, right long"


def boxes(spark, rows):
    return spark.createDataFrame(rows, BOX)


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_equal_the_nested_loop(spark, seed):
    rng = random.Random(seed)

    def some(n):
        for k in range(n):
            t, x, size = rng.randrange(-300, 300), rng.randrange(-300, 300), rng.choice((1, 7, 32, 33, 64, 500, 5000))
            yield (rng.randrange(2), k, t, x, t + rng.randrange(1, size + 1), x + rng.randrange(1, size + 1))

    a, b = list(some(70)), list(some(70))
    got = sorted((r.image, r.k_a, r.k_b, r.area) for r in overlap.overlap_join(boxes(spark, a), boxes(spark, b), "k", ["image"], cell=rng.choice((8, 32))).collect())
    want = []
    for i, k, t, x, u, y in a:
        for j, m, t2, x2, u2, y2 in b:
            h, w = min(u, u2) - max(t, t2), min(y, y2) - max(x, x2)
            if i == j and h > 0 and w > 0:
                want.append((i, k, m, h * w))
    assert got == sorted(want) and len(want) > 100


def test_boxes_that_overlap_nothing(spark):
    a = boxes(spark, [(1, 1, 0, 0, 10, 10), (1, 2, 5, 5, 5, 9), (1, 3, None, 0, 9, 9), (None, 4, 0, 0, 9, 9), (1, 5, 10, 0, 20, 10)])
    got = overlap.overlap_join(a, a, "k", ["image"]).collect()
    assert {(r.k_a, r.k_b) for r in got} == {(1, 1), (5, 5)}
    assert overlap.overlap_join(a.where("false"), a, "k", ["image"]).count() == 0


def test_overlaps_are_an_equal_join(spark):
    a = boxes(spark, [(1, i, i, i, i + 9, i + 9) for i in range(50)])
    plan = overlap.overlap_join(a, a, "k", ["image"])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_boxes_of_small_files_are_not_broadcast(spark):
    plan = catalog.QUERIES["overlapping_boxes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_log_sums_are_stable(spark):
    rows = [([1000.0, 1000.0],), ([-1000.0, -1001.0],), ([0.0],), ([],), ([1.0, None],), ([float("nan"), 1.0],), ([float("-inf"), 2.0],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x array<double>").select(logits.log_sum_exp(F.col("x"))).collect()]
    want = [1000 + math.log(2), -1000 + math.log(1 + math.exp(-1)), 0.0, None, None, None, 2.0, None]
    assert all(a == b or a == pytest.approx(b, rel=1e-14) for a, b in zip(got, want, strict=True))
    soft = spark.createDataFrame([([1.0, 2.0, 4.0],)], "x array<float>").select(logits.log_softmax(F.col("x")).alias("y"), logits.log_probability(F.col("x"), F.lit(1)).alias("p"), logits.log_probability(F.col("x"), F.lit(3)).alias("q")).first()
    assert sum(map(math.exp, soft.y)) == pytest.approx(1) and soft.p == soft.y[1] and soft.q is None


def sequence(spark, ids, prompt, reply):
    return spark.createDataFrame([("a", ids, prompt, reply)], "k string, ids array<int>, prompt_len int, reply_ids array<int>")


def test_reply_scores_sum_the_replys_tokens(spark):
    steps = spark.createDataFrame([("a", p, [float(p), 1.0, 0.0]) for p in range(5)], "k string, pos int, logits array<double>")
    got = scoring.reply_scores(sequence(spark, [2, 0, 1, 1, 0], 2, [1, 1, 0]), steps, ["k"]).first()
    lp = lambda p, t: [float(p), 1.0, 0.0][t] - math.log(sum(math.exp(x) for x in (p, 1, 0)))
    assert got.n_tokens == 3 and got.score == pytest.approx(lp(1, 1) + lp(2, 1) + lp(3, 0))
    assert tuple(scoring.reply_scores(sequence(spark, [2, 0], 2, []), steps, ["k"]).first()) == ("a", 0, 0.0)


@pytest.mark.parametrize(("ids", "prompt", "reply", "drop"), [([2, 0, 1, 1], 1, [1, 1], None), ([2, 0, 1, 1], 2, [1, 1, 0], None), ([2, 0, 1, 1], 2, [1, 1], 1), ([2, 0, 9], 2, [9], None), ([1], 0, [1], None)])
def test_a_shifted_or_missing_span_stops(spark, ids, prompt, reply, drop):
    steps = spark.createDataFrame([("a", p, [float(p), 1.0, 0.0]) for p in range(5) if p != drop], "k string, pos int, logits array<double>")
    with pytest.raises(Exception, match="reply token"):
        scoring.reply_scores(sequence(spark, ids, prompt, reply), steps, ["k"]).collect()


def test_choices(spark):
    df = spark.createDataFrame([("a", 0, -2.0), ("a", 1, -1.0), ("a", 2, -1.0), ("b", 0, -3.0)], "k string, option int, score double")
    assert {r.k: (r.choice, r.margin) for r in scoring.choices(df, ["k"], "option").collect()} == {"a": (1, 0.0), "b": (0, None)}


def release(spark, rows):
    return merkle.leaves(spark.createDataFrame(rows, "k long, v string"), "k", ["v"])


def plain_root(rows, depth):
    leaf = {hashlib.sha256(str(k).encode()).hexdigest(): hashlib.sha256(("leaf:" + ('{"k":%d,"v":%s}' % (k, "null" if v is None else f'"{v}"'))).encode()).hexdigest() for k, v in rows}

    def node(prefix):
        if len(prefix) == depth:
            parts = sorted((p, d) for p, d in leaf.items() if p.startswith(prefix))
        else:
            parts = [(prefix + c, d) for c in "0123456789abcdef" if (d := node(prefix + c))]
        return hashlib.sha256(("node:" + "".join(a + b for a, b in parts)).encode()).hexdigest() if parts else None

    return node("")


def test_root_and_proofs(spark):
    rows = [(k, None if k % 7 == 0 else f"v{k}") for k in range(300)]
    leaves = release(spark, rows).cache()
    nodes = merkle.tree(leaves, merkle.depth_of(300, 4))
    root = merkle.root(nodes)
    assert root == plain_root(rows, 2) == merkle.root(merkle.tree(release(spark, rows[::-1]).repartition(5), 2))
    leaf = {r.key: r.leaf for r in leaves.collect()}
    for k in ("0", "17", "299"):
        given = merkle.proof(nodes, leaves, k)
        assert merkle.verify(k, leaf[k], given, root)
        assert not merkle.verify(k, leaf["5"], given, root) and not merkle.verify("5", leaf["5"], given, root)
        given[0][0] = (given[0][0][0], "0" * 64)
        assert not merkle.verify(k, leaf[k], given, root)


def test_any_change_moves_the_root(spark):
    rows = [(k, f"v{k}") for k in range(60)]
    roots = {merkle.root(merkle.tree(release(spark, r), 1)) for r in (rows, rows[:-1], rows[:-1] + [(59, None)], rows[:-1] + [(59, "w")], [(k + 1, v) for k, v in rows])}
    assert len(roots) == 5 and merkle.root(merkle.tree(release(spark, []), 1)) is None
    for bad in ([(1, "a"), (1, "a")], [(None, "a")]):
        with pytest.raises(Exception, match="null or repeated"):
            release(spark, bad).collect()


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_differences(spark, depth):
    a = [(k, f"v{k}") for k in range(200)]
    b = [(k, "new" if k == 5 else v) for k, v in a if k != 9] + [(999, "x")]
    of = [release(spark, r) for r in (a, b)]
    nodes = [merkle.tree(x, depth) for x in of]
    found = lambda i, j: {(r.key, r.kind) for r in merkle.difference(nodes[i], of[i], nodes[j], of[j]).collect()}
    assert found(0, 1) == {("5", "changed"), ("9", "removed"), ("999", "added")} and found(0, 0) == set()
    with pytest.raises(ValueError, match="different depths"):
        merkle.difference(nodes[0], of[0], merkle.tree(of[1], depth + 1), of[1])


def test_ordered_digest_is_that_of_sorted_lines(spark):
    rng = random.Random(5)
    ids = [rng.choice(("a", "é", "\U0001f600", "z")) * rng.randrange(1, 4) + str(rng.randrange(10**6)) for _ in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = identity.ids_digest(spark.createDataFrame([(x,) for x in [*ids, None]], "id string").repartition(6), "id").first()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (got.n, got.digest) == (4000, hashlib.sha256(b"\n".join(sorted(x.encode() for x in ids))).hexdigest())
    assert tuple(identity.ids_digest(spark.createDataFrame([], "id string"), "id").first()) == (0, hashlib.sha256(b"").hexdigest())


def test_a_split_of_one_class_is_left_without_entries(spark):
    rows = [("train", i, "faithful") for i in range(6)] + [("validation", 10 + i, "faithful" if i % 2 else "unfaithful") for i in range(5)] + [("iid-test", 20, "faithful")]
    got = assemble.balance(spark.createDataFrame(rows, "split string, instance long, label string")).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"validation": 4, "iid-test": 1}


def test_a_regime_read_twice_stops(spark):
    rows = lambda regimes: spark.createDataFrame([(1, r, [1.0, 0.0], 0) for r in regimes], "instance long, regime long, scores array<double>, baseline long")
    assert conditions.fold_readings(rows([1, 2, 3, 5])).first().flip_count is None and conditions.fold_readings(rows([1, 2, 3, 4])).first().flip_count == 0
    with pytest.raises(Exception, match="read twice"):
        conditions.fold_readings(rows([1, 1, 2, 3])).collect()


@pytest.mark.parametrize("ids", [range(38), range(37), [0, 2, 3, 16, 17, 20, 21, 21, 23, 36]])
@pytest.mark.parametrize("name", ["reply_scores", "reply_choices"])
def test_vectors_that_end_amid_a_sequence_are_scored_as_far_as_they_go(spark, tmp_path, ids, name):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 38")
    spark.createDataFrame([(i,) for i in ids], "vec_id long").join(vectors, "vec_id").select(*vectors.columns).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(catalog.ORACLE_SQL[name]).fetchall()
    got = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) == len(want) > 0
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:-1] == b[:-1] and (a[-1] == b[-1] or a[-1] == pytest.approx(b[-1], abs=2e-6))


@pytest.mark.parametrize("change", ["NULL", "slice(embedding, 1, 8)", "slice(embedding, 1, 0)", "transform(embedding, (x, i) -> if(i = 3, NULL, x))", "transform(embedding, x -> float(NULL))",
                                    "transform(embedding, (x, i) -> if(i = 3, float('NaN'), x))", "transform(embedding, (x, i) -> if(i = 3, float('inf'), x))"])
@pytest.mark.parametrize("name", ["reply_scores", "reply_choices"])
def test_a_vector_that_is_not_whole_stops_no_other(spark, tmp_path, change, name):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 64")
    vectors.withColumn("embedding", F.expr(f"CASE WHEN vec_id = 5 OR vec_id BETWEEN 16 AND 19 OR vec_id >= 48 THEN {change} ELSE embedding END")).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(catalog.ORACLE_SQL[name]).fetchall(), key=lambda r: r[:2])
    got = sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()), key=lambda r: r[:2])
    assert [r[:-1] for r in got] == [r[:-1] for r in want] and len(got) > 3
    for (*_, a), (*_, b) in zip(got, want, strict=True):
        assert a == b or a == pytest.approx(b, abs=2e-6, nan_ok=True)


@pytest.mark.parametrize(("drop", "token"), [(2, 1), (None, -1)])
def test_known_logits_still_need_a_row_for_each_token(spark, drop, token):
    steps = spark.createDataFrame([("a", p, None if p == 1 else [float(p), 1.0]) for p in range(5) if p != drop], "k string, pos int, logits array<double>")
    assert scoring.reply_scores(sequence(spark, [0, 0, 1], 2, [1]), steps, ["k"], known_only=True).first().score is None
    with pytest.raises(Exception, match="reply token"):
        scoring.reply_scores(sequence(spark, [0, 0, 1, token], 2, [1, token]), steps, ["k"], known_only=True).collect()
