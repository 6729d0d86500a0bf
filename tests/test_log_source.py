import json

import pytest

from fidelis.sources import log_source as L


def text(rows):
    return "".join(json.dumps({"key": k, "payload": p}) + "\n" for k, p in rows)


def pairs(df):
    return sorted((r.key, r.payload) for r in df.collect())


def test_ranges_of_any_size_read_each_whole_line_once(tmp_path):
    rows = [(f"k{i}", "é" * (i * 7 % 300)) for i in range(200)] + [("long", "x" * 200_000)] + [("z", None), ("o", '{"a":1}')]
    body = text(rows[:-1]) + '{"key": "o", "payload": {"a": 1}}\n' + '{"key": "torn", "pay'
    (tmp_path / "log.jsonl").write_text(body)
    where = str(tmp_path / "log.jsonl")
    starts = [i for i in range(len(body.encode())) if i == 0 or body.encode()[i - 1:i] == b"\n"]
    for split in (1009, 4096, 65536, 1 << 20):
        reader = L.LogReader(where, split)
        got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [(r["key"], r["payload"]) for r in got] == rows and [r["at"] for r in got] == starts[:-1]
    for bad in ('{"key": 1}\n', "nonsense\n", '{"payload": "x"}\n', "[]\n"):
        (tmp_path / "bad.jsonl").write_text(text([("a", "1")]) + bad + text([("b", "2")]))
        reader = L.LogReader(str(tmp_path / "bad.jsonl"), 1 << 20)
        with pytest.raises(ValueError, match="line at byte"):
            [list(reader.read(p)) for p in reader.partitions()]
    (tmp_path / "torn.jsonl").write_text("no newline")
    assert [p.end for p in L.LogReader(str(tmp_path / "torn.jsonl"), 10).partitions()] == [0]


def test_commits_are_whole_and_once(spark, tmp_path):
    where = str(tmp_path / "log")
    df = spark.createDataFrame([("a", "1"), ("b", None), ("a", "1")], "key string, payload string")
    assert L.read_log(spark, where).count() == 0
    L.commit_log(df, where)
    L.commit_log(df, where)
    assert pairs(L.read_log(spark, where)) == [("a", "1"), ("b", None)]
    for bad in ([("a", "2")], [("c", "1"), ("c", "2")], [(None, "1"), ("d", "1")]):
        with pytest.raises(ValueError, match="second commits"):
            L.commit_log(spark.createDataFrame(bad, "key string, payload string"), where)
    # A file that no commit names, as a lost attempt leaves it, is not read, and a failed write leaves nothing.
    (tmp_path / "log" / "stray.jsonl").write_text(text([("s", "1")]))
    n = len(list((tmp_path / "log").iterdir()))
    failing = spark.createDataFrame([("e", "1"), (None, "1")], "key string, payload string").repartition(2)
    with pytest.raises(Exception, match="without a key"):
        failing.write.format("keyed_log").mode("append").save(where)
    with pytest.raises(Exception, match="only appended"):
        df.write.format("keyed_log").mode("overwrite").save(where)
    assert pairs(L.read_log(spark, where)) == [("a", "1"), ("b", None)] and len(list((tmp_path / "log").iterdir())) == n


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()
    run = lambda: L.stream_log(spark, str(log), 64).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    (log / "one.jsonl").write_text(text([("a", "1"), ("b", "2")]) + '{"key": "c", ')
    run()
    assert pairs(spark.read.parquet(out)) == [("a", "1"), ("b", "2")]
    with (log / "one.jsonl").open("a") as f:
        f.write('"payload": "3"}\n')
    (log / "two.jsonl").write_text(text([("d", "4")]))
    run()
    assert pairs(spark.read.parquet(out)) == [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")]
    (log / "two.jsonl").unlink()
    with pytest.raises(Exception, match="only grows"):
        run()
