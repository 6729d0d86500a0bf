import random

from fidelis.streaming import artifacts

SCHEMA = "instance string, seq long, kind string, payload string"
KINDS = [("observation", "o"), ("determination", None), (None, "d"), ("seal", "E1"), ("seal", "S2"), ("seal", None)]


def plain(batches, sealed=()):
    """Entry by entry, in the order of seq within a batch, those of one seq together; what is left open too."""
    out, open_, done = [], {}, set(sealed)
    for batch in batches:
        placed = [r for r in batch if r[1] is not None]
        out += [(*r, "rejected") for r in batch if r[1] is None]
        for instance in {r[0] for r in placed}:
            mine = [r for r in placed if r[0] == instance]
            held = open_.setdefault(instance, [])
            for seq in sorted({r[1] for r in mine}):
                same = [r for r in mine if r[1] == seq]
                if instance in done:
                    out += [(*r, "rejected") for r in same]
                    continue
                observed = any(r[2] == "observation" for r in held + same)
                fine = [r for r in same if r[2] == "seal" and (r[3] != "E1" or not observed)]
                if fine:
                    out += [(*r, "refused" if r[2] == "seal" else "sealed") for r in held] + [(*r, "sealed") for r in same]
                    held.clear()
                    done.add(instance)
                else:
                    held += same
    return out, [r for rows in open_.values() for r in rows]


def rows_of(seed, n, low):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", "c", "d", "e", None]), low + rng.randrange(40) if rng.random() > 0.05 else None, *rng.choice(KINDS[:3] * 6 + KINDS[3:])) for _ in range(n)]


def order(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_the_batch_twin_equals_entry_by_entry(spark):
    for seed in range(3):
        rows = rows_of(seed, 60, 0)
        want, left = plain([rows])
        assert order(artifacts.statuses(spark.createDataFrame(rows, SCHEMA)).collect()) == order(want + [(*r, "open") for r in left])
    assert artifacts.statuses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_stream_goes_on_from_an_earlier_log_and_from_its_checkpoint(spark, tmp_path):
    earlier = [("a", 0, "seal", "S2", "sealed"), ("b", 0, "observation", "o", "open"), ("c", 0, "seal", "E1", "refused")]
    batches = [rows_of(7, 40, 1), rows_of(8, 60, 20), [("z", 1, "seal", "E1")] + [("y", i, "observation", str(i)) for i in range(2500)] + [("y", 3000, "seal", "E1"), ("y", 3001, "seal", "S1"), ("y", 3002, "observation", "late")]]
    held = spark.conf.get(artifacts.PROVIDER, None)
    start = spark.createDataFrame(earlier, SCHEMA + ", status string")
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        artifacts.seal_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), start).awaitTermination()
    assert spark.conf.get(artifacts.PROVIDER, None) == held
    want, _ = plain([[r[:4] for r in earlier if r[4] == "open"], *batches], sealed={"a"})
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert order(got) == order(want)
    count = lambda s: sum(r.instance == "y" and r.status == s for r in got)
    assert (count("sealed"), count("refused"), count("rejected")) == (2501, 1, 1)
