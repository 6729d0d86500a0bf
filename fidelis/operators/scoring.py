"""Scores of replies from a model's logits: log-probabilities summed over the reply's tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.functions.logits import log_probability, log_probability_of_known
from fidelis.operators.guard import guard


def reply_scores(sequences: DataFrame, logits: DataFrame, key: list[str], known_only: bool = False) -> DataFrame:
    """(key, n_tokens, score): the sum of the log-probabilities of a reply's tokens, for each sequence.

    sequences: key, ids (all tokens), prompt_len and reply_ids; logits: key, pos, logits, where those at a position
    predict the next token. The reply must stand at the prompt's end, ids[prompt_len : prompt_len + n], and every one of its
    positions must have logits, once and with room for its token: else the run stops, as a shifted span scores another text.
    Only the reply's positions are joined. An empty reply scores 0.
    known_only: a position's row of logits may be null, short or hold nulls; it counts as a token and adds what is known of it, and a reply
    of which nothing is known scores null. The row itself must still be there, once, and no token be negative.
    """
    n = F.size("reply_ids")
    aligned = guard(sequences.select(*key, "ids", "prompt_len", "reply_ids"), (F.col("prompt_len") > 0) & (F.slice("ids", F.col("prompt_len").cast("int") + 1, n) == F.col("reply_ids")), "reply tokens are not at the prompt's end")
    first = F.col("prompt_len").cast("long") - 1
    steps = aligned.select(*key, n.alias("n_tokens"), F.posexplode_outer("reply_ids").alias("__i", "__token"), first.alias("__first"))
    steps = steps.withColumn("pos", F.col("__first") + F.coalesce("__i", F.lit(0)))
    held = logits.select(*key, F.col("pos").cast("long").alias("pos"), "logits", F.lit(True).alias("__held"))
    lp = (log_probability_of_known if known_only else log_probability)(F.col("logits"), F.col("__token"))
    scored = steps.join(held, [*key, "pos"], "left").withColumn("__lp", lp)
    seen = F.count(F.when(F.col("__held") & (F.col("__token") >= 0), True) if known_only else "__lp")
    sums = scored.groupBy(*key).agg(F.first("n_tokens").cast("long").alias("n_tokens"), seen.alias("__seen"), F.count("__token").alias("__asked"), F.sum("__lp").alias("score"))
    whole = guard(sums, (F.col("__seen") == F.col("n_tokens")) & (F.col("__asked") == F.col("n_tokens")), "a reply token has no logits, or more than one row of them")
    whole = whole.withColumn("score", F.coalesce("score", F.when(F.col("n_tokens") == 0, 0.0)))
    return whole.select(*key, "n_tokens", "score")


def choices(scores: DataFrame, key: list[str], option: str) -> DataFrame:
    """The option of the largest score for each key, the first option on ties, with the margin over the next one, null for a single option."""
    ranked = scores.groupBy(*key).agg(F.max_by(option, F.struct("score", (-F.col(option)).alias("o"))).alias("choice"), F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2).alias("top"))
    return ranked.select(*key, "choice", (F.get("top", F.lit(0)) - F.get("top", F.lit(1))).alias("margin"))
