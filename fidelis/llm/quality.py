"""A sparse ensemble of rules that scores texts for quality.

Every text becomes STATISTICS, shares and means of its words and of windows of WINDOW words, so that junk within a good text
shows; none but the number of words itself moves with a text's length alone. Boosted trees are grown on the labelled rows; each path from a root is a rule, a conjunction of bounds on
statistics; lasso logistic regression weighs the rules and leaves most of them out; what is left is compiled into one
Spark column expression, which scores all rows. Trees and regression are fitted by Spark on the statistics alone.

The fit takes at most about `most` labelled rows, a documented bound: where there are more, those whose digest lies below the
share that gives as many. Everything else covers all rows.

Defined results: a null text is the empty text, whose statistics are 0 and whose score is the model's for them; a text is
read whole, in pieces; equal texts have equal scores; repeated rows are scored again; a label row teaches once for each
document row of its id, labels other than 0 and 1 and rows without one teach nothing. With no labelled rows, or
rows of one class, there are no rules, and the score of all is the share of good ones, (good + 1) / (all + 2). An empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import Scratch, free_names, slices
from fidelis.llm.hashing import WINDOW as PIECE
from fidelis.llm.hashing import _windows, word_hashes
from fidelis.llm.language import held_out

#: Words of a window; windows follow one another from the first word on, the last one may be shorter.
WINDOW = 24
#: Labelled rows that the fit takes at most; trees and their depth; weight of the lasso; the score that predicts 1.
MOST, TREES, DEPTH, LASSO, GOOD = 200_000, 12, 3, 0.0005, 0.7
STATISTICS = (
    "log_words", "mean_length", "long_words", "short_words", "letters", "capitals", "digits", "symbols", "marks", "bangs", "lines",
    "symbol_words", "capital_words", "bare_words", "repeated_words", "fresh_words", "top_word",
    "window_symbols", "window_capitals", "window_bare", "window_repeated", "window_bangs", "window_distinct",
)
# Classes of bytes: letters (bytes of other scripts among them), capitals, digits, marks of prose, exclamation marks, other signs.
_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_SMALL = np.array([97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_MARK = np.isin(np.arange(256), [ord(c) for c in ".,;:'\"?()-"])
_BANG = np.arange(256) == ord("!")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SIGN = ~(_LETTER | _DIGIT | _MARK | _BANG | _SPACE) & (np.arange(256) > 32)


class _Words(NamedTuple):
    """Of each word its number of bytes, letters, capitals, small letters, digits, marks, bangs and signs, and whether a line starts with it."""

    size: np.ndarray
    letters: np.ndarray
    capitals: np.ndarray
    small: np.ndarray
    digits: np.ndarray
    marks: np.ndarray
    bangs: np.ndarray
    signs: np.ndarray
    opens: np.ndarray


def _words(text: str) -> _Words:
    """The words of a text; what is held for each byte is held for a window of them only."""
    buf = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    space = _SPACE[buf]
    edges = _windows(space) if len(buf) > PIECE else [0, len(buf)]
    parts = []
    for a, b in zip(edges, edges[1:], strict=False):
        own, blank = buf[a:b], space[a:b]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
        starts, ends = edge[0::2], edge[1::2]
        if not len(starts):
            continue
        # Sums over a word end at the next word's start; the blanks in between belong to no class.
        count = lambda c: np.add.reduceat(c[own].astype(np.int32), starts)  # noqa: B023, E731
        lines = np.add.reduceat(np.concatenate(([0], (own == 10).astype(np.int32))), np.concatenate(([0], starts[:-1] + 1))) if len(starts) > 1 else np.array([int((own[: starts[0]] == 10).sum())])
        parts.append((ends - starts, *map(count, (_LETTER, _CAPITAL, _SMALL, _DIGIT, _MARK, _BANG, _SIGN)), lines > 0))
    return _Words(*(np.concatenate(c) for c in zip(*parts, strict=True))) if parts else _Words(*(np.zeros(0, np.int64) for _ in range(9)))


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of a text, in their order."""
    w = _words(text or "")
    n = len(w.size)
    if not n:
        return [0.0] * len(STATISTICS)
    hashes, _ = word_hashes([text])
    total, letters = float(w.size.sum()), max(1.0, float(w.letters.sum()))
    sign, bang, bare = w.signs > 0, w.bangs > 0, w.letters == 0
    capital = (w.capitals > 1) & (w.small == 0)
    again = np.concatenate(([False], hashes[1:] == hashes[:-1]))
    _, counts = np.unique(hashes, return_counts=True)
    at = np.arange(0, n, WINDOW)
    sizes = np.diff(np.append(at, n))
    # A last window of few words says little, so it counts as if it were a whole one.
    most = lambda flags: float((np.add.reduceat(flags.astype(np.int32), at) / np.maximum(sizes, min(n, WINDOW))).max())
    order = np.lexsort((hashes, np.arange(n) // WINDOW))
    window, sorted_hashes = (np.arange(n) // WINDOW)[order], hashes[order]
    new = np.concatenate(([True], (sorted_hashes[1:] != sorted_hashes[:-1]) | (window[1:] != window[:-1])))
    distinct = np.add.reduceat(new.astype(np.int32), at) / sizes
    return [
        float(np.log1p(n)), total / n, float((w.size > 12).mean()), float((w.size <= 2).mean()), w.letters.sum() / total, w.capitals.sum() / letters, w.digits.sum() / total, w.signs.sum() / total,
        w.marks.sum() / total, w.bangs.sum() / total, w.opens.sum() / n,
        float(sign.mean()), float(capital.mean()), float(bare.mean()), float(again.mean()), float(new.mean()), counts.max() / n,
        most(sign), most(capital), most(bare), most(again), most(bang), float(distinct[sizes >= min(n, WINDOW)].min()),
    ]


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep and the STATISTICS of every row's text."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{s} double" for s in STATISTICS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.array([statistics(t.as_py()) for t in batch.column(len(keep))], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], [*keep, *STATISTICS])

    return docs.select(*keep, "text").mapInArrow(run, schema)


#: A rule: for each statistic it looks at, its name, the value it must exceed (None: none) and the one it must not.
Rule = tuple[tuple[str, float | None, float | None], ...]
_LINE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def paths(tree: str, names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """The rules of all nodes below a tree's root, by its printed form; bounds on one statistic are merged."""
    out, held = [], []
    for line in tree.splitlines():
        if not (m := _LINE.match(line)):
            continue
        depth = len(m[1])
        held = [h for h in held if h[0] < depth]
        held.append((depth, names[int(m[3])], m[4], float(m[5])))
        bounds: dict[str, list] = {}
        for _, name, op, value in held:
            b = bounds.setdefault(name, [None, None])
            if op == ">":
                b[0] = value if b[0] is None else max(b[0], value)
            else:
                b[1] = value if b[1] is None else min(b[1], value)
        out.append(tuple((k, *bounds[k]) for k in sorted(bounds)))
    return out


def holds(rule: Rule) -> Column:
    """Whether a rule holds, as a column."""
    parts = [p for name, low, high in rule for p in ((F.col(name) > low) if low is not None else None, (F.col(name) <= high) if high is not None else None) if p is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


class Ensemble(NamedTuple):
    """An intercept and weighted rules."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The compiled expression over the STATISTICS."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def learn(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Ensemble:
    """An ensemble from rows with STATISTICS and `label`, 0 or 1."""
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < good < n:
        return Ensemble(float(np.log((good + 1) / (n - good + 1))), ())
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="__stats").transform(rows.withColumn("label", F.col("label").cast("double")))
    grown = GBTClassifier(featuresCol="__stats", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, subsamplingRate=1.0, seed=1).fit(vectors)
    rules = sorted({r for t in grown.trees for r in paths(t.toDebugString)}, key=str)
    if not rules:
        return Ensemble(float(np.log((good + 1) / (n - good + 1))), ())
    ruled = vectors.select("label", *(holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    ruled = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="__rules").transform(ruled)
    fit = LogisticRegression(featuresCol="__rules", labelCol="label", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(ruled.select("label", "__rules"))
    return Ensemble(float(fit.intercept), tuple((r, float(w)) for r, w in zip(rules, fit.coefficients.toArray(), strict=True) if w))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", most: int = MOST, good: float = GOOD) -> DataFrame:
    """A row for each document: key, held_out, score, predicted, and the STATISTICS.

    Rows that are held out teach nothing, and neither label nor key is looked at by a score.
    """
    free_names(docs.select(key), "held_out", "score", "predicted", *STATISTICS)
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.write(measured(docs, key).withColumn("held_out", held_out(F.col(key))), "measured")
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key), F.col(label).cast("int").alias("label"))
    taught = scratch.write(rows.where(~F.col("held_out")).join(known, key).select(key, "label", *STATISTICS), "taught")
    if taught.said["n"] > most:
        taught = taught.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(most / taught.said["n"] * (1 << 20)))
    model = learn(taught.repartition(8))
    scratch.drop(taught)
    found = rows.select(key, "held_out", model.score().alias("score"), *STATISTICS)
    return found.select(key, "held_out", "score", (F.col("score") >= good).cast("int").alias("predicted"), *STATISTICS)
