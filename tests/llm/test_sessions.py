import random
import zlib

import pytest

from fidelis.llm import sessions
from fidelis.llm.queries import QUERIES


def plain(events, gap=sessions.GAP):
    """The log by going over batches and sorting all events so far, for each key."""
    out = []
    for user in {e[0] for e in events}:
        own = [e[1:] for e in events if e[0] == user]
        standing = []
        for b in sorted({e[1] for e in own}):
            runs = []
            for s, eb, h in sorted(e for e in own if e[1] <= b):
                if not runs or s - runs[-1][-1][0] > gap:
                    runs.append([])
                runs[-1].append((s, eb, h))
            for run in runs:
                if new := sum(eb == b for _, eb, _ in run):
                    lo, hi = run[0][0], run[-1][0]
                    old = [v for v in standing if v[3] is None and lo <= v[0] and v[1] <= hi]
                    for v in old:
                        v[3:5] = b, lo
                    standing.append([lo, hi, b, None, None, len(run), new, len(old), sum(h for *_, h in run)])
        out += [(user, b, lo, hi, n, new, gone, h, rb, rs) for lo, hi, b, rb, rs, n, new, gone, h in standing]
    return sorted(out, key=str)


def log_of(spark, events, **how):
    df = spark.createDataFrame(events, "user long, seconds long, batch long, h long").repartition(3)
    got = sessions.session_versions(df, **how)
    assert tuple(got.columns) == sessions.LOG
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_log_equals_the_plain_one(spark, seed):
    rng = random.Random(seed)
    events = []
    for user in range(6):
        t = rng.randrange(-2000, 2000)
        for _ in range(rng.choice((1, 3, 40, 90))):
            t += rng.choice((0, 5, 300, 599, 600, 601, 900))
            events.append((user, t, t // 900 + (rng.randrange(4) if rng.random() < rng.choice((0, 0.3, 1)) else 0), rng.randrange(1 << 32)))
    events += rng.sample(events, len(events) // 5)
    assert log_of(spark, events, bits=(9, 2, 1)) == plain(events)


def test_any_delay(spark):
    rng = random.Random(9)
    events = [(1, rng.randrange(20_000), rng.randrange(12), 1) for _ in range(120)] + [(2, s, 0, 2) for s in range(0, 6000, 600)]
    assert log_of(spark, events) == plain(events)


def test_a_long_chain_is_cut_where_nothing_is_late(spark):
    rng = random.Random(3)
    events = [(7, 300 * i, 300 * i // 900 + (1 if rng.random() < 0.1 else 0), 1) for i in range(1500)]
    df = spark.createDataFrame(events, "user long, seconds long, batch long, h long")
    rows = sessions.stretches(df, "user", "seconds", "batch", "h", sessions.GAP).groupBy("stretch").count().collect()
    assert len(rows) > 100 and max(r["count"] for r in rows) < 100
    assert log_of(spark, events) == plain(events)


def test_scan_equals_plain_sums(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [(k, t, rng.randrange(100)) for k in (1, 2) for t in rng.sample(range(-5000, 5000), 60)]
    df = spark.createDataFrame(rows, "k long, t long, v long")
    got = sessions.scanned(df, "k", "t", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, {"l": ("min", F.col("v"))}, (6, 2)).collect()
    for r in got:
        before, after = [v for k, t, v in rows if k == r.k and t < r.t], [v for k, t, v in rows if k == r.k and t > r.t]
        assert (r.s or 0, r.m, r.l) == (sum(before), max(before, default=None), min(after, default=None))


def test_odd_rows_and_none(spark):
    events = [(None, 1, 1, 1), (1, None, 1, 1), (1, 1, None, 1), (1, 5, 0, None), (1, 5, 0, None), (1, 6, 0, 4)]
    assert log_of(spark, events) == [(1, 0, 5, 6, 3, 3, 0, 4, None, None)]
    assert log_of(spark, []) == []
    wide = spark.createDataFrame([(1, 5, 0, 2, 9, "x")], "user long, seconds long, batch long, h long, key long, cells string")
    assert sessions.session_versions(wide).count() == 1


def test_events_of_turns(spark):
    turns = [(c, t, "user", "x") for c in (0, 7, 8, -3, 1 << 40) for t in (0, 3, None)] + [(None, 1, "user", "x")]
    got = sessions.conversation_events(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for conv, turn, *_ in turns:
        if conv is not None and turn is not None:
            c, h = zlib.crc32(str(conv).encode()), zlib.crc32(f"{conv}:{turn}".encode())
            s, g = c // 2 % 7200 + 300 * turn + h % 600, h // 600
            want.append((2 * (conv // 8) + c % 2, s, s // 900 + (g % 4 if g % 5 == 0 else 0), h))
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_python_and_nothing_single(spark):
    plan = QUERIES["op12_session_merging"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan


def test_query_equals_the_plain_log(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    events = [tuple(r) for r in sessions.conversation_events(turns).select("user", "seconds", "batch", "h").collect()]
    assert sorted(map(tuple, QUERIES["op12_session_merging"](spark, "/root/testdata/sf0.01").collect()), key=str) == plain(events)
