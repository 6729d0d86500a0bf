"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

The result is a corpus to train from: the token ids of each piece with its place in a sequence.

Defined results of every stage: an empty table gives none; null or empty texts and nulls in any column don't stop it; columns
beside those of documents are kept by all stages but the last; names that start with `__lang`, `__node`, `__secret` or
`__mix` are used inside and refused in the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.llm import language, minhash, mixing, packing, secrets
from fidelis.llm.common import Scratch, free_names, sized, table
from fidelis.llm.tokenizers import public_path

#: The tokenizer that mixing counts with and packing writes.
TOKENIZER = "byte_bpe_50k.json"


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those that are rejected (`und`) go, a missing lang becomes the predicted one.

    Rejected are null texts, texts without a letter, and all if no row has both a lang and a text. Repeated rows are
    judged alike; a row needs no doc_id.
    """
    names = ("__lang_pred", "__lang_score", "__lang_set")
    named = language.predict(docs, language.learn(docs), names)
    return named.where(F.col(names[0]) != language.UNKNOWN).withColumn("lang", F.coalesce("lang", names[0])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest doc_id, once.

    A document is a doc_id with its text: rows that share both are one, the first of them by its columns as JSON with nulls, and
    rows that share a doc_id but not the text are several. Rows without a doc_id all stay, as do texts without words.
    """
    free_names(docs, "__node", "__doc", "__digest")
    scratch = Scratch(spark, "near-dedup")
    rows, said = minhash.numbered(docs, scratch)
    found = minhash.of_nodes(rows.select(F.col("__node").alias("doc_id"), "text"))
    decided = found.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"))
    gone = scratch.write(decided.where("not kept and doc_id is not null").select(F.col("doc_id").alias("__node")), "gone")
    left = rows.join(sized(gone, gone.said["n"]), "__node", "left_anti")
    if said["n"]:
        own = F.to_json(F.struct(*(c for c in docs.columns if c != "text")), {"ignoreNullFields": "false"})
        one = left.where("__node is not null").groupBy("__node").agg(F.min_by(F.struct(*docs.columns), own).alias("__doc"))
        left = one.select("__doc.*").unionByName(left.where("__node is null").select(*docs.columns))
    return left.select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every secret masked and n_chars counted again; a null text stays null."""
    return secrets.redact(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows sampled by calibrated probabilities, raked by tokens.

    A digest of the doc_id decides, so repeated rows share their fate and so do all rows of a cell without a doc_id; null
    categories are one category.
    """
    return mixing.mix(docs, public_path(TOKENIZER))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining rows, each with its token ids (unsigned, little-endian, 4 bytes each) and its place in a sequence.

    A null or empty text is the end token alone; repeated rows are packed once for each row.
    """
    return packing.pack_documents(docs, public_path(TOKENIZER), with_ids=True)


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, sketches and tokenizers are beyond SQL; tests/llm hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs
