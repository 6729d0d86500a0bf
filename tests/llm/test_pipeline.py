import collections
import hashlib
import itertools
import re
import zlib

import corpus_pipeline
import numpy as np
import test_minhash
import test_packing
import test_secrets
from odd_texts import ODD

from fidelis.llm import language, minhash, mixing, packing, secrets
from fidelis.llm.tokenizers import public_path


def test_stages_follow_one_another(spark, tmp_path, corpus):
    docs, before = corpus, {r.doc_id: r for r in corpus.collect()}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
        if name != "packing":
            assert out.columns == columns
        if name == "language_id":
            rejected = {r.doc_id for r in language.predict(docs.select("doc_id", "text"), language.learn(docs)).where("lang_pred = 'und'").collect()}
            assert ids == set(before) - rejected
        elif name == "near_dedup":
            assert ids == {r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()}
        elif name == "secret_scan":
            assert ids == set(before) and secrets.scan(out).where("n_assign + n_access + n_hex > 0").count() == 0
        elif name == "mixing":
            assert ids == {r.doc_id for r in mixing.mixture(docs, public_path("byte_bpe_50k.json")).where("sampled").collect()}
        else:
            plain = packing.pack_documents(docs, public_path("byte_bpe_50k.json"))
            cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
            assert out.select(cols).exceptAll(plain.select(cols)).count() == 0 and ids == set(before)
        docs, before = out, {r.doc_id: r for r in out.collect()}


def plain_topic(text):
    if re.search(r"( \| [^|\n]*){3}", text):
        return "table"
    if re.search(r"licen[sc]e|copyright", text, re.IGNORECASE):
        return "licence"
    if re.search(r"[{};=][ \t\n\x0b\f\r]*\n|\b(def|class|return|import)\b", text, re.ASCII):
        return "code"
    return "short" if len(text) < 1000 else "prose"


def plain_run(rows):
    """The ids of the pieces that the pipeline must give, by (doc_id, piece), from plain Python and the tokenizers library."""
    rows = [r for r in rows if re.search(r"[^\W\d_]", r.text or "")]
    assert all(r.lang for r in rows)
    kept = test_minhash.brute({r.doc_id: r.text for r in rows})
    texts = {}
    for r in rows:
        if kept[r.doc_id][2]:
            pieces, at = [], 0
            for s, _, e in test_secrets.every(r.text):
                if s >= at:
                    pieces += [r.text[at:s], secrets.MASK]
                at = max(at, e)
            texts[r.doc_id] = "".join(pieces) + r.text[at:]
    ids = {d: test_packing.LIBRARY.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    cell = {r.doc_id: (r.source or "unknown", r.lang, plain_topic(texts[r.doc_id])) for r in rows if r.doc_id in texts}
    mass = collections.Counter()
    for d, c in cell.items():
        mass[c] += len(ids[d])
    weight, total = dict.fromkeys(mass, 1.0), sum(mass.values())
    for step in range(3 * mixing.ROUNDS):
        i = step % 3
        before, now = collections.Counter(), collections.Counter()
        for c, m in mass.items():
            before[c[i]] += m
            now[c[i]] += m * weight[c]
        lifted = {v: m**mixing.TEMPERATURE for v, m in before.items()}
        weight = {c: w * lifted[c[i]] / sum(lifted.values()) * total / now[c[i]] for c, w in weight.items()}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(m * min(1, mid * weight[c]) for c, m in mass.items()) < mixing.SHARE * total else (low, mid)
    out = {}
    for d, c in cell.items():
        if int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:12], 16) / 16**12 < min(1, high * weight[c]):
            own = [*ids[d], 2]
            first = len(own) % 1024 or 1024
            for piece, (a, b) in enumerate(itertools.pairwise([0, *range(first, len(own) + 1, 1024)])):
                out[d, piece] = own[a:b]
    return out


def test_run_matches_a_plain_version(spark, corpus):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    want = plain_run(corpus.collect())
    assert {(r.doc_id, r.piece): np.frombuffer(bytes(r.ids), "<u4").tolist() for r in rows} == want and len(rows) == len(want)
    places = {}
    for r in rows:
        assert r.length == len(want[r.doc_id, r.piece]) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [0, *itertools.accumulate(n for _, n in sorted(own))][:-1] and sum(n for _, n in own) <= 1024
    assert len(places) <= -(-sum(r.length for r in rows) // 1024) + 2


def test_odd_rows_pass_each_stage(spark, docs_of):
    for _, stage in corpus_pipeline.STAGES:
        for df in (docs_of(ODD), docs_of(ODD).where("false")):
            out = stage(spark, df, "")
            assert out.count() <= len(ODD) * 1000 and out.columns


def test_one_of_repeated_rows_stays(spark, docs_of):
    out = corpus_pipeline.drop_near_duplicates(spark, docs_of(["a b c d e f g", "a b c d e f g", "x y"], [1, 1, 2]), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_documents_without_an_id_stay_beside_repeated_rows(spark, docs_of):
    for more in ([], [1]):
        texts, ids = ["a b c d e f g", "one", "two", None, *["a b c d e f g"] * len(more)], [1, None, None, None, *more]
        out = corpus_pipeline.drop_near_duplicates(spark, docs_of(texts, ids), "")
        assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, ""), (0, "one"), (0, "two"), (1, "a b c d e f g")]


def test_texts_that_share_an_id_are_several_documents(spark, docs_of):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    out = corpus_pipeline.drop_near_duplicates(spark, docs_of([a, b, a, c, b, c, b, None, None], [3, 5, 5, 5, 7, 4, 5, 5, None]), "")
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, ""), (3, a), (4, c), (5, ""), (5, b)]


def test_the_order_of_repeated_rows_does_not_show(spark):
    text = "a b c d e f g"
    rows = [(1, text, "fr", "s2", 3), (1, text, "en", None, 3), (1, text, "en", "s1", 3), (2, "h i", None, None, None)]
    got = set()
    for order in itertools.permutations(rows):
        df = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
        got.add(tuple(sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, df, "").collect()))))
    assert len(got) == 1 and "lang='en', source='s1'" in min(got)[0]
