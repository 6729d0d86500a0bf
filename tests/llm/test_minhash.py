import collections
import random
import re

import numpy as np
import pytest
from odd_texts import ODD

from fidelis.llm import minhash
from fidelis.llm.hashing import shingle_sets


def sets_of(texts):
    out = {}
    for k, x in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        out[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(texts):
    sets = sets_of(texts)
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = collections.defaultdict(list)
    for k, s in sets.items():
        for g in s:
            by[g].append(k)
    common = collections.Counter((a, b) for ks in by.values() for i, b in enumerate(ks) for a in ks[:i])
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {k: (len(s), find(k), find(k) == k) for k, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}


def test_corpus_matches_brute_force(corpus):
    assert got(corpus) == brute({r.doc_id: r.text for r in corpus.collect()})


def test_variants_near_the_threshold_match_brute_force(docs_of):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for i in range(500):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    assert got(docs_of(texts)) == brute(dict(enumerate(texts)))


def test_odd_rows(docs_of):
    assert got(docs_of(ODD)) == brute(dict(enumerate(ODD)))


def test_no_rows_and_only_empty_rows(docs_of):
    assert got(docs_of(["a"]).where("false")) == {}
    assert got(docs_of([None, ""])) == {0: (0, 0, True), 1: (0, 1, True)}


def test_repeated_rows_come_back(docs_of):
    df = docs_of(["a b c d e f"] * 3, [4, 4, 9])
    rows = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert rows == [(4, 4, True), (4, 4, True), (9, 4, False)]


def test_registers_are_zero_counts_and_mantissas():
    x = np.array([1 << 63, (1 << 63) | (0b11 << 61), 1 << 40, 0], np.uint64)
    assert minhash.compress(x).tolist() == [0, 0b11 << 8, 23 << 10, 53 << 10]


def test_estimate_follows_similarity():
    rng = random.Random(1)
    words = [str(rng.random()) for _ in range(3000)]
    a, b = " ".join(words[:2500]), " ".join(words[500:])
    s, n = shingle_sets([a, b])
    regs = minhash.registers(s, n)
    true = len(np.intersect1d(s[: n[0]], s[n[0] :])) / len(np.union1d(s[: n[0]], s[n[0] :]))
    assert abs(minhash.estimate((regs[0] == regs[1]).sum()) - true) < 0.12


def test_shuffled_sides_give_the_same(docs_of, monkeypatch):
    monkeypatch.setattr("fidelis.llm.common.BROADCAST_IDS", 0)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(40)] + ODD
    assert got(docs_of(texts)) == brute(dict(enumerate(texts)))


def test_texts_that_share_an_id_keep_their_copies_together(docs_of):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = minhash.near_duplicates(docs_of([a, b, b, b, c, a, c, "", b, a], [1, 1, 7, 9, 8, 12, 10, 8, None, 1])).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.n_shingles, r.kept) for r in rows) == sorted(
        [(1, 1, 3, True)] * 3 + [(7, 1, 3, False), (9, 1, 3, False), (8, 8, 3, True), (12, 1, 3, False), (10, 8, 3, False), (8, 8, 0, True), (0, 1, 3, False)]
    )
    rows = minhash.near_duplicates(docs_of([c, a, b, b, c], [3, 5, 5, 7, 5])).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(3, 3), (5, 3), (7, 3)}


def test_hashing_by_windows_does_not_show(monkeypatch):
    from fidelis.llm import hashing

    texts = ["a b " * 500, "w" * 900 + " x " + "y" * 50, None, "", "end", "é" * 200 + "\n" + "of a " * 90]
    words, n = hashing.word_hashes(texts)
    for size in (1, 7, 64, 300):
        monkeypatch.setattr(hashing, "WINDOW", size)
        got, m = hashing.word_hashes(texts)
        assert (got == words).all() and (n == m).all()


def look_alikes(n, changed, seed=3):
    """Texts of a common one with `changed` words of each replaced, five words apart: alike in many bands, but linked only if few are replaced."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(2, 120, 5), changed if isinstance(changed, int) else rng.choice(changed)):
            words[at] = f"x{i}-{at}"
        texts.append(" ".join(words))
    return texts


def test_rows_of_cells_grow_with_the_members_in_many_buckets(docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "FAN", 4)
    written = {}
    own = minhash.Scratch.write

    def counted(self, df, name, **sums):
        out = own(self, df, name, **sums)
        written[name] = max(written.get(name, 0), out.said["n"])
        return out

    monkeypatch.setattr(minhash.Scratch, "write", counted)
    held = []
    for n in (150, 600):
        written.clear()
        texts = look_alikes(n, 4)
        sets, counts = shingle_sets(texts)
        keys = minhash._band_keys(minhash.registers(sets, counts))
        _, sizes = np.unique(keys, return_counts=True)
        assert (sizes > 4 * minhash.BLOCK * minhash.FAN // 2).sum() >= 13
        assert all(r.kept for r in minhash.near_duplicates(docs_of(texts)).collect())
        assert written["large"] > 0.9 * n and written["met"] <= 4 * n
        held.append(sum(v for k, v in written.items() if k in ("met", "groups", "hopeful", "more")))
    assert held[1] <= 5 * held[0] + 600


@pytest.mark.parametrize("changed", [(1, 2, 3, 4), (2, 3)])
def test_large_buckets_lose_no_link(docs_of, monkeypatch, changed):
    monkeypatch.setattr(minhash, "BLOCK", 2)
    monkeypatch.setattr(minhash, "FAN", 2)
    texts = look_alikes(150, changed, seed=11)
    assert got(docs_of(texts)) == brute(dict(enumerate(texts)))


@pytest.mark.parametrize("seed", range(3))
def test_any_two_at_the_threshold_have_a_rare_group_in_common(spark, seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    pools = [rng.integers(0, 1 << 62, 400).astype(np.uint64) for _ in range(4)]
    sets = []
    for i in range(160):
        pool, n = pools[i % 4], int(rng.choice((3, 8, 40, 44, 50, 57, 60)))
        core = pool[: max(1, n - int(rng.integers(0, 1 + n // 6)))]
        sets.append(np.unique(np.concatenate((core, rng.choice(pool, n // 20), rng.integers(0, 1 << 62, n // 14).astype(np.uint64)))))
    # Pairs of exactly 75 hundredths: 3 of 4, 6 of 8, 60 of 80.
    for k in (1, 2, 20):
        common = rng.integers(0, 1 << 62, 3 * k).astype(np.uint64)
        sets += [np.unique(common), np.unique(np.concatenate((common, rng.integers(0, 1 << 62, k).astype(np.uint64))))]
    members = spark.createDataFrame([(i, len(x)) for i, x in enumerate(sets)], "rid long, n long")
    held = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "rid long, shingles binary")
    groups = {}
    for r in minhash.rare_groups(members, held, 0.75).collect():
        groups.setdefault(r.rid, set()).add(r.band)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if minhash._alike(sets[i], sets[j], 0.75)]
    assert len(links) > 100 and all(groups.get(i, set()) & groups.get(j, set()) for i, j in links)
    pairs = {(i, j) for i in groups for j in groups if j < i and groups[i] & groups[j]}
    assert len(pairs) < 0.5 * len(sets) * (len(sets) - 1) / 2
