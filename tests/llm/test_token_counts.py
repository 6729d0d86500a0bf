import pytest
import sentencepiece
from odd_texts import ODD

from fidelis.llm import token_counts
from fidelis.llm.tokenizers import library, normal_form, public_path, version

PATH = public_path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)


def want(texts, limit=4096):
    n = [len(MODEL.encode(t or "")) for t in texts]
    return sorted((i, len((t or "").encode()), x, x > limit) for i, (t, x) in enumerate(zip(texts, n, strict=True)))


TEXTS = [*ODD, "<s> special </s>", "<unk>"]


def test_counts_are_the_librarys(docs_of):
    assert sorted(map(tuple, token_counts.token_counts(docs_of(TEXTS), PATH).collect())) == want(TEXTS)


def test_only_distinct_misses_are_encoded_and_appended(docs_of, spark, tmp_path):
    cache = str(tmp_path / "cache")
    token_counts.token_counts(docs_of(["a b", "a b", "c", None]), PATH, cache=cache).collect()
    assert spark.read.parquet(cache).count() == 3
    spark.read.parquet(cache).selectExpr("content", "'other' as version", "99L as n_tokens").write.mode("append").parquet(cache)
    got = token_counts.token_counts(docs_of(["a b", "new one", ""]), PATH, limit=1, cache=cache).collect()
    assert sorted(map(tuple, got)) == want(["a b", "new one", ""], 1)
    assert spark.read.parquet(cache).where(f"version = '{version(PATH)}'").count() == 4


def test_repeated_rows_and_ids_and_none(docs_of):
    got = sorted(map(tuple, token_counts.token_counts(docs_of(["x y", "x y", "z", "z"], [1, 1, 1, 2]), PATH).collect()))
    n = {t: len(MODEL.encode(t)) for t in ("x y", "z")}
    assert got == sorted([(1, 3, n["x y"], False)] * 2 + [(1, 1, n["z"], False), (2, 1, n["z"], False)])
    assert token_counts.token_counts(docs_of(["a"]).where("false"), PATH).count() == 0


def test_what_is_no_cache_is_refused(docs_of, spark, tmp_path):
    path = str(tmp_path / "other")
    spark.range(3).write.parquet(path)
    with pytest.raises(ValueError, match="no cache"):
        token_counts.token_counts(docs_of(["a"]), PATH, cache=path)


def test_equal_forms_have_equal_tokens():
    form = normal_form(PATH)
    pool = [*TEXTS, *(f"{a}x{b}y{c}" for a in ("", " ", "\u2581", "\u00a0") for b in (" ", "  ", "\u2581", "\u3000", "\t") for c in ("", " ", "\u2581"))]
    of = {}
    for t in pool:
        of.setdefault(form([t or ""])[0], set()).add(tuple(MODEL.encode(t or "")))
    assert all(len(tokens) == 1 for tokens in of.values()) and len(of) < len({t or "" for t in pool})


def test_texts_of_one_form_are_encoded_once(docs_of, spark, tmp_path):
    texts, cache = ["a b", "a\u2581b", "a  b", "A b"], str(tmp_path / "cache")
    got = token_counts.token_counts(docs_of(texts), PATH, cache=cache)
    assert sorted(map(tuple, got.collect())) == want(texts)
    assert spark.read.parquet(cache).count() == 3


def test_a_json_file_s_texts_are_their_own_form(docs_of):
    path = public_path("byte_bpe_50k.json")
    assert normal_form(path)(["A ", "a"]) == ["A ", "a"]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs_of(TEXTS), path).collect()}
    assert got == {i: len(library(path).encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
