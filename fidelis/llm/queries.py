"""The queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.llm import chat, language, media, minhash, mixing, neighbours, packing, quality, secrets, sessions, substrings, token_counts, whitening
from fidelis.llm.common import table
from fidelis.llm.oracles import ORACLE_SQL
from fidelis.llm.tokenizers import public_path


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents")).drop("media")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_units(table(spark, sf_dir, "documents"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"), run=substrings.RUN)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_chats(turns), ordered=True)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"))


def _rounded(mixed: DataFrame) -> DataFrame:
    return mixed.withColumn("weight", F.round("weight", 6)).withColumn("prob", F.round("prob", 6))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in words, which SQL can count too."""
    return _rounded(mixing.mixture(table(spark, sf_dir, "documents")))


def op10_token_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on sizes in tokens, as the pipeline has it."""
    return _rounded(mixing.mixture(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json")))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_session_merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_versions(sessions.conversation_events(table(spark, sf_dir, "conversations")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_best_fit_packing, op3_secret_scan, op4_media_columns, op5_nearest_neighbours,
        op6_substring_dedup, op6_repeated_passages, op7_language_id, op8_chat_format, op9_token_counts, op10_mixing, op10_token_mixing,
        op11_quality_rules, op12_session_merging, op13_whitening,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
