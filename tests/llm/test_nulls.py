"""Rows with nulls in every column, through every query's operator and every stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from fidelis.llm import chat, language, media, minhash, mixing, neighbours, packing, secrets, substrings, token_counts
from fidelis.llm.tokenizers import public_path

OPERATORS = {
    "op1": minhash.near_duplicates,
    "op2": lambda df: packing.pack_documents(df, public_path("byte_bpe_50k.json")),
    "op3": secrets.scan,
    "op4": media.media_columns,
    "op7": language.identify,
    "op9": lambda df: token_counts.token_counts(df, public_path("piece_bpe_32k.model")),
    "op10": mixing.mixture,
}


@pytest.fixture(scope="module")
def holes(spark):
    text = "a line of more than six words is here"
    rows = [(None, None, None, None, None), (None, text, "en", "s", 3), (1, text, None, None, None), (2, None, "fr", "t", 0), (None, text, None, None, None), (3, text + " and more", "en", None, 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(holes, name):
    got = OPERATORS[name](holes).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "None", "None", "None"]


def test_substrings_keep_a_row_with_an_id(holes):
    assert {(r.doc_id, r.first_doc_id) for r in substrings.repeated_units(holes, run=6).collect()} == {(None, 1)}


def test_stages(spark, holes):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, holes, "").count() <= 6


def test_conversations_and_vectors(spark):
    turns = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "x"), (1, None, "assistant", "y")], "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.n_turns) for r in chat.read_back(chat.format_chats(turns)).collect()} == {(None, 2), (1, 1)}
    vectors = spark.createDataFrame([(None, [1.0]), (0, None), (20, [2.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest(vectors, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 3, 2.0)]
