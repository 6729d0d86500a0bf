import json
import random

import pytest
from pyspark.sql import functions as F

from fidelis.operators import matching

ROWS = "g string, k long, y long, s double"
ARGS = (["g"], "y", "k", "s")


def plain(rows, caliper):
    """The same rule, read row by row: a stack of one class for each chain, pairs beyond the caliper undone, again on what is left."""
    left, pairs = sorted((r for r in rows if r[3] is not None), key=lambda r: (r[0] or "", r[0] is None, r[3], r[1])), set()
    while True:
        stack, new, last = [], [], None
        for r in left:
            if last is None or last[0] != r[0] or r[3] - last[3] > caliper:
                stack = []
            last = r
            if stack and stack[-1][2] != r[2]:
                o = stack.pop()
                if r[3] - o[3] <= caliper:
                    new.append((o, r))
            else:
                stack.append(r)
        if not new:
            return pairs
        gone = {(r[0], r[1]) for p in new for r in p}
        left = [r for r in left if (r[0], r[1]) not in gone]
        pairs |= {(a[0], a[1], b[1], round(abs(a[3] - b[3]), 6)) for a, b in ((p if p[0][2] == 0 else p[::-1]) for p in new)}


def made(spark, rows, caliper):
    got = matching.nearest_pairs(spark.createDataFrame(rows, ROWS), *ARGS, caliper).collect()
    return {(r.g, r.negative, r.positive, round(r.distance, 6)) for r in got}, len(got)


@pytest.mark.parametrize("seed", range(3))
def test_pairs_are_the_plain_ones_and_none_is_missed(spark, seed):
    rng = random.Random(seed)
    share, spread = rng.choice((0.2, 0.5, 0.7)), rng.choice((60, 400))
    rows = [(rng.choice(("a", "a", "b", None)), i, int(rng.random() < share), float(rng.randrange(spread))) for i in range(400)]
    got, n = made(spark, rows, 3.0)
    assert got == plain(rows, 3.0) and n == len(got) > 50
    assert all(d <= 3 for *_, d in got)
    used = [(g, k) for g, a, b, _ in got for k in (a, b)]
    assert len(used) == len(set(used))
    left = [r for r in rows if (r[0], r[1]) not in set(used)]
    assert not [1 for a in left for b in left if a[0] == b[0] and a[2] < b[2] and abs(a[3] - b[3]) <= 3]


def test_a_far_pair_is_undone_and_its_rows_are_matched_again(spark):
    # Nested: 1 opens, 2-3 and 4-5 are neighbours, 6 closes 1 at a distance beyond the caliper; then 6 meets 7.
    rows = [("a", 1, 1, 0.0), ("a", 2, 1, 1.0), ("a", 3, 0, 2.0), ("a", 4, 1, 3.0), ("a", 5, 0, 4.0), ("a", 6, 0, 5.0), ("a", 7, 1, 6.0)]
    got, _ = made(spark, rows, 2.0)
    assert got == plain(rows, 2.0) == {("a", 3, 2, 1.0), ("a", 5, 4, 1.0), ("a", 6, 7, 1.0)}


def test_whole_chains_have_the_least_sum_of_distances(spark):
    rng = random.Random(5)
    scores = [rng.randrange(1000) for _ in range(60)]
    rows = [("a", i, i % 2, float(s)) for i, s in enumerate(scores)]
    got, n = made(spark, rows, 1000.0)
    assert n == 30 and sum(d for *_, d in got) == sum(abs(a - b) for a, b in zip(sorted(scores[::2]), sorted(scores[1::2]), strict=True))


def test_rows_that_take_no_part(spark):
    rows = [("a", 1, 0, None), ("a", 2, 1, 1.0), ("a", None, 0, 1.0), ("a", 3, None, 1.0), ("a", 4, 2, 1.0), ("a", 5, 0, float("nan")), (None, 6, 0, 1.0), (None, 7, 1, 1.0), ("b", 8, 0, 1.0)]
    assert made(spark, rows, 5.0) == ({(None, 6, 7, 0.0)}, 1)
    assert made(spark, [], 1.0) == (set(), 0)
    assert made(spark, rows, 0.0) == ({(None, 6, 7, 0.0)}, 1)
    with pytest.raises(ValueError, match="distance"):
        made(spark, rows, -1.0)


def test_one_stratum_is_many_tasks_and_membership_is_balanced(spark):
    rows = [(None, i, i % 2, float(i // 3)) for i in range(3000)]
    entries = spark.createDataFrame(rows, ROWS).withColumn("more", F.lit(1))
    pairs = matching.nearest_pairs(entries, *ARGS, 5.0)
    kept = matching.matched_membership(entries, pairs, ["g"], "k")
    assert kept.columns == entries.columns and {r["y"]: r["count"] for r in kept.groupBy("y").count().collect()} == {0: 1500, 1: 1500}
    placed = matching._balanced(entries.select("g", F.col("k").alias("__key"), F.col("s").alias("__score"), (F.col("y") == 1).alias("__up")), ["g"], 5.0)
    try:  # small ranges would be put together
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        held = matching.Ranged(placed, ["g", "__chain", "__level"], [F.col("__score"), F.col("__key")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert held.rows.select("__part").distinct().count() > 1 and placed.select("__level").distinct().count() == 1


def test_a_selector_is_recorded(spark):
    said = json.loads(spark.range(1).select(matching.selector(*ARGS, 0.5).alias("s")).first().s)
    assert said["caliper"] == 0.5 and said["stratum"] == ["g"] and said["score"] == "s"
