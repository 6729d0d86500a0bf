import hashlib

import numpy as np
import pytest
from odd_texts import ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fidelis.llm import mixing
from fidelis.llm.tokenizers import public_path


def test_raking_meets_all_margins():
    rng = np.random.Generator(np.random.PCG64(4))
    codes = np.array([(a, b, c) for a in range(4) for b in range(3) for c in range(2)])
    mass = rng.integers(1, 1000, len(codes)).astype(float)
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25]), np.array([0.6, 0.4])]
    w, off = mixing.rake(mass, codes, targets)
    assert off < 1e-9
    for i, t in enumerate(targets):
        assert np.allclose(np.bincount(codes[:, i], mass * w) / (mass * w).sum(), t, atol=1e-8)


def test_expected_tokens_are_the_share():
    mass, w = np.array([10.0, 200.0, 0.0, 50.0]), np.array([9.0, 0.2, 1.0, 1.0])
    p = mixing.probabilities(mass, w, 0.5)
    assert abs((mass * p).sum() - 130) < 1e-6 and p.max() <= 1 and p[2] <= 1


def test_corpus_matches_a_plain_version(corpus):
    check_plain(mixing.mixture(corpus).collect(), corpus, "n_words")
    assert {r.doc_id for r in mixing.mix(corpus).collect()} == {r.doc_id for r in mixing.mixture(corpus).collect() if r.sampled}


def test_token_sizes_match_a_plain_version(corpus):
    rows = mixing.mixture(corpus, public_path("byte_bpe_50k.json")).collect()
    library = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in corpus.collect()}
    assert all(r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids) for r in rows)
    check_plain(rows, corpus, "n_tokens")
    assert {r.doc_id for r in mixing.mix(corpus, public_path("byte_bpe_50k.json")).collect()} == {r.doc_id for r in rows if r.sampled}


def check_plain(rows, corpus, size):
    """Raking by plain Python over all rounds, the factor by the sums, and the sample by the digests."""
    texts = {r.doc_id: r.text for r in corpus.collect()}
    assert len(rows) == len(texts)
    cells = {}
    for r in rows:
        assert size != "n_words" or r.n_words == len((texts[r.doc_id] or "").encode().split())
        cells.setdefault((r.source, r.lang, r.topic), []).append(r)
    keys = sorted(cells)
    mass = {k: float(sum(r[size] for r in cells[k])) for k in keys}
    total = sum(mass.values())
    weight = dict.fromkeys(keys, 1.0)
    goals = []
    for i in range(3):
        shares = {}
        for k in keys:
            shares[k[i]] = shares.get(k[i], 0) + mass[k]
        lifted = {v: s**mixing.TEMPERATURE for v, s in shares.items()}
        goals.append({v: s / sum(lifted.values()) * total for v, s in lifted.items()})
    for _ in range(500):
        for i, goal in enumerate(goals):
            now = {}
            for k in keys:
                now[k[i]] = now.get(k[i], 0) + mass[k] * weight[k]
            for k in keys:
                weight[k] *= goal[k[i]] / now[k[i]]
    for k in keys:
        for r in cells[k]:
            assert abs(r.weight - weight[k]) < 1e-5 * weight[k]
            u = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:12], 16) / 16**12
            assert r.sampled == (u < r.prob)
    assert abs(sum(r.prob * r[size] for r in rows) - total / 2) < 1e-3 * total


def test_odd_rows_and_none(docs_of):
    df = docs_of(ODD, langs=[None, *["en"] * (len(ODD) - 1)])
    assert mixing.mixture(df).count() == len(ODD) and mixing.mix(df).columns == df.columns
    assert mixing.mixture(df.where("false")).count() == 0 and mixing.mixture(docs_of([None, ""])).count() == 2
    assert mixing.mix(df.where("false"), public_path("piece_bpe_32k.model")).count() == 0
    with pytest.raises(ValueError, match="__mix"):
        mixing.mix(df.withColumnRenamed("n", "__mix_n"))


@pytest.mark.parametrize("targets", [None, {"lang": {"en": 0.3, "fr": 0.7, "xx": 9.0}}, {"source": {"none": 1.0}}])
def test_many_cells_are_raked_in_spark_with_the_same_result(spark, corpus, docs_of, monkeypatch, targets):
    monkeypatch.setattr(mixing, "CLOSE", 1e-7)
    for f, at in ((mixing.rake, (mixing.ROUNDS, 1e-7)), (mixing.rake_cells, (mixing.ROUNDS, 1e-7))):
        monkeypatch.setattr(f, "__defaults__", at)
    small = corpus.withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3)).select("doc_id", "source", "lang", F.concat(F.lit("t"), (F.col("doc_id") + F.col("n_chars")) % 2).alias("topic"), F.col("n_chars").alias("n_tokens"))
    small = small.unionAll(spark.createDataFrame([(-1, "empty", None, "t0", 0), (-2, "s0", "en", None, None)], small.schema))
    want = {r.doc_id: r for r in mixing.calibrate(small, targets).collect()}
    monkeypatch.setattr(mixing, "MAX_CELLS", 1)
    got = {r.doc_id: r for r in mixing.calibrate(small, targets).collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        assert r.weight == pytest.approx(want[k].weight, rel=1e-5) and r.prob == pytest.approx(want[k].prob, rel=1e-5)


def test_margins_that_contradict_each_other_are_told(docs_of):
    df = docs_of(["a b c d"] * 4, langs=["en", "en", "fr", "fr"]).selectExpr("doc_id", "if(lang = 'en', 'x', 'y') as source", "lang", "topic", "4L as n_tokens")
    with pytest.warns(UserWarning, match="contradict"):
        mixing.calibrate(df, {"lang": {"en": 0.2, "fr": 0.8}, "source": {"x": 0.5, "y": 0.5}})


def test_given_targets_steer(docs_of):
    df = docs_of(["a b c d e f"] * 60, langs=["en", "fr"] * 30).selectExpr("doc_id", "source", "lang", "topic", "6L as n_tokens")
    rows = mixing.calibrate(df, {"lang": {"en": 0.2, "fr": 0.8}}, share=0.3).collect()
    sums = {x: sum(r.prob * r.n_tokens for r in rows if r.lang == x) for x in ("en", "fr")}
    assert abs(sums["fr"] / sum(sums.values()) - 0.8) < 1e-6
