"""Drift instruments beside word overlap: of embeddings, of token embeddings, and of entailment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fidelis.functions.stats import cosine


def embedding_drift(before: Column, after: Column) -> Column:
    """One less the cosine of two embeddings."""
    return 1 - cosine(before, after)


def token_matching_drift(before: Column, after: Column) -> Column:
    """One less the F1 of greedily matched token embeddings (arrays of vectors): each token counts by the token of the
    other text that is most like it. Null for a text without tokens."""
    best = lambda xs, ys: F.aggregate(F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: cosine(x, y)))), F.lit(0.0), lambda acc, x: acc + x) / F.size(xs)
    precision, recall = best(after, before), best(before, after)
    f1 = F.try_divide(2 * precision * recall, precision + recall)
    return F.when((F.size(before) > 0) & (F.size(after) > 0), 1 - f1)


def entailment_drift(forth: Column, back: Column) -> Column:
    """One less the mean of the chances that each text entails the other."""
    return 1 - (forth + back) / 2


def bertscore_model(model_type: str, lang: str = "en"):
    """A factory for images.call_model: frames (key, baseline, counterfactual) to (key, drift) by the bert_score package, which the caller's executors must have."""

    def make():
        try:
            from bert_score import BERTScorer
        except ImportError as e:
            raise RuntimeError("the bert_score package isn't installed; token_matching_drift takes embeddings of any other model") from e
        scorer = BERTScorer(model_type=model_type, lang=lang, idf=False, rescale_with_baseline=False)

        def run(frame):
            f1 = scorer.score(frame["counterfactual"].tolist(), frame["baseline"].tolist())[2]
            return frame[["key"]].assign(drift=[1.0 - float(x) for x in f1])

        return run

    return make
