import math
import zlib
from collections import Counter

import pytest
from odd_texts import ODD
from pyspark.sql import functions as F

from fidelis.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert language.identify(docs).exceptAll(language.identify(other)).count() == 0


def test_a_mixture_gets_both_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs)
    pick = {r.lang: r.text for r in docs.where("n_chars between 2000 and 4000").select("lang", "text").collect()}
    (_, _, mixed), (_, score, alone) = model.predict([pick["fr"] + "\n" + pick["de"], pick["en"]])
    assert {x.split(":")[0] for x in mixed.split(",")} == {"fr", "de"} and alone.split(":")[0] == "en" and "," not in alone and score > 0.9


def test_odd_rows_and_none(docs_of):
    texts = [*ODD, "1234 !?", "²³"]
    rows = {r.doc_id: r for r in language.identify(docs_of(texts, langs=["en", "fr", None, "en", "fr", "en", "fr", "en", "en", "en", None])).collect()}
    assert {i for i, r in rows.items() if r.lang_pred == "und"} == {0, 1, 2, 9, 10} and rows[0].score == 0
    assert language.identify(docs_of(["a"]).where("false")).count() == 0
    assert [r.lang_pred for r in language.identify(docs_of(["abc", "b"], langs=[None, None])).collect()] == ["und"] * 2


def plain_model(rows):
    """Trigram counts of each language by plain Python: (counts, total) with add-SMOOTH over BINS."""
    counts = {}
    for lang, text in rows:
        body = plain_bytes(text)
        counts.setdefault(lang, Counter()).update(plain_bin(body[i : i + 3]) for i in range(len(body) - 2))
    return {k: (c, sum(c.values()) + language.SMOOTH * language.BINS) for k, c in sorted(counts.items())}


def plain_bytes(text):
    keep = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
    return b"  " + keep + b"  "


def plain_bin(three):
    code = three[0] << 16 | three[1] << 8 | three[2]
    return (code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language.BITS)


def plain_em(like, share):
    for _ in range(language.ROUNDS):
        got = [[a * s for a, s in zip(w, share, strict=True)] for w in like]
        got = [[x / max(sum(w), 1e-300) for x in w] for w in got]
        share = [sum(w[i] for w in got) / len(got) for i in range(len(share))]
    return share


def plain_predict(model, text):
    """Language, score and set by the docstring's rule: proportions by expectation-maximisation, languages added in order while the gain pays."""
    names = list(model)
    body = plain_bytes(text)
    words, at = [], 0
    while at < len(body):
        if body[at] == 32:
            at += 1
            continue
        end = body.index(32, at)
        words.append(body[at - 1 : end + 1])
        at = end
    logs = [[sum(math.log((model[n][0][plain_bin(w[i : i + 3])] + language.SMOOTH) / model[n][1]) for i in range(len(w) - 2)) for n in names] for w in words]
    tops = [max(w) for w in logs]
    like = [[math.exp(x - t) for x in w] for w, t in zip(logs, tops, strict=True)]
    full = plain_em(like, [1 / len(names)] * len(names))
    alone = [sum(w[i] for w in logs) for i in range(len(names))]
    best = alone.index(max(alone))
    order = sorted(range(len(names)), key=lambda i: -(2 if i == best else full[i]))
    chosen, share, fit = [best], full, alone[best]
    for i in order[1:]:
        if full[i] < language.FAINT:
            break
        start = [full[j] + 1e-9 if j in (*chosen, i) else 0.0 for j in range(len(names))]
        got = plain_em(like, [x / sum(start) for x in start])
        now = sum(math.log(max(sum(a * s for a, s in zip(w, got, strict=True)), 1e-300)) + t for w, t in zip(like, tops, strict=True))
        if now - fit <= language.PENALTY * math.log1p(len(words)):
            break
        chosen, share, fit = [*chosen, i], got, now
    top = max(chosen, key=lambda i: share[i])
    return names[top], share[top], {names[i] for i in chosen}


def test_predictions_match_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 4000")
    rows = [(r.lang, r.text) for r in docs.where("lang is not null and text is not null").collect()]
    model, plain = language.learn(docs), plain_model(rows)
    assert model.languages == list(plain)
    texts = [t for _, t in rows[:40]] + [rows[i][1][:600] + "\n" + rows[i + 7][1][:900] for i in range(25)] + ["a", "x1y 22 z"]
    for text, (lang, score, chosen) in zip(texts, model.predict(texts), strict=True):
        want = plain_predict(plain, text)
        assert (lang, {x.split(":")[0] for x in chosen.split(",")}) == (want[0], want[2]) and score == pytest.approx(want[1], abs=1e-4)


def test_a_model_has_the_most_common_languages_and_no_more(docs_of):
    df = docs_of([f"word number {i}" for i in range(40)], langs=["en"] * 10 + ["fr"] * 9 + [f"dirty{i}" for i in range(21)])
    assert language.learn(df, 2).languages == ["en", "fr"] and language.learn(df, 3).languages == ["dirty0", "en", "fr"]


def test_pieces_do_not_show(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.learn(docs)
    texts = [r.text for r in docs.orderBy(F.desc("n_chars")).limit(5).collect()] + [None, "", "x" * 3000 + " the y"]
    whole = model.predict(texts)
    monkeypatch.setattr(language, "PIECE", 100)
    for a, b in zip(whole, model.predict(texts), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-6)


def test_columns_that_are_added_must_be_free(docs_of):
    with pytest.raises(ValueError, match="lang_pred"):
        language.predict(docs_of(["a"]).withColumnRenamed("topic", "lang_pred"), language.LanguageModel([], None))
