"""Mixing to target weights by iterative proportional fitting.

Sizes are summed by cells of source, language and topic, where a text's size is its number of tokens if a tokenizer is
given, and else of words between blanks. Cells are raked until their sums meet the targets of all three margins, by the
driver where there are at most MAX_CELLS of them and in Spark, by the same steps, where there are more. A document's
inclusion probability is its cell's raked weight times one factor, at most 1, with the factor set so that the
expected size is the asked share; it is taken if a digest of its id falls below that.

Margins that contradict each other (a value of one occurs with one value of another only) can't all be met; rake
returns by how much they are missed, and calibrate warns above WARN.

Texts are read once: what is known of a row is written beside it. Without given targets, a margin's targets are its
shares to the power TEMPERATURE, which lifts rare values. Defined results: null or missing categories are the category
`unknown`; a null text has size 0 and its document, like all of a cell of size 0, the cell's probability; repeated rows
share their fate; an empty table gives none. Other columns are kept by `mix`; names that start with `__mix` are used
inside and refused in the input.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.llm.common import Scratch, slices
from fidelis.llm.tokenizers import sizes

MARGINS = ("source", "lang", "topic")
MAX_CELLS, TEMPERATURE, SHARE, SEED = 100_000, 0.7, 0.5, "mix-1"
ROUNDS, CLOSE, WARN = 500, 1e-10, 1e-6
UNKNOWN = "unknown"
_NAMES = [f"__mix_{m}" for m in MARGINS]


def topic(text: Column) -> Column:
    """A coarse topic of a text by its form: table, code, list, or prose by length."""
    body = F.coalesce(text, F.lit(""))
    return (
        F.when(body.rlike(r"( \| [^|\n]*){3}"), "table").when(body.rlike(r"(?i)licen[sc]e|copyright"), "licence")
        .when(body.rlike(r"[{};=]\s*\n|\b(def|class|return|import)\b"), "code").when(F.length(body) < 1000, "short").otherwise("prose")
    )


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id's digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def rake(mass: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> tuple[np.ndarray, float]:
    """Weights of cells whose weighted mass has the target shares in every margin, and the largest factor by which a sum was still off, less 1.

    mass: size of each cell; codes: each cell's category in each margin, by column. Targets of categories
    without mass are spread over the others; a margin without any target that has mass is levelled.
    """
    weight, total, off = np.ones(len(mass)), mass.sum(), 0.0
    if not total:
        return weight, off
    goals = []
    for i, t in enumerate(targets):
        alive = np.bincount(codes[:, i], mass, len(t)) > 0
        t = np.where(alive, t, 0.0) if t[alive].sum() > 0 else alive.astype(float)
        goals.append(t / t.sum() * total)
    for _ in range(rounds):
        off = 0.0
        for i, goal in enumerate(goals):
            now = np.bincount(codes[:, i], mass * weight, len(goal))
            step = np.divide(goal, now, out=np.ones(len(goal)), where=now > 0)
            off = max(off, float(np.abs(step[now > 0] - 1).max()))
            weight *= step[codes[:, i]]
        if off < close:
            break
    return weight, off


def probabilities(mass: np.ndarray, weight: np.ndarray, share: float) -> np.ndarray:
    """min(1, factor * weight) with the factor that makes the expected mass the asked share of all."""
    alive = (mass > 0) & (weight > 0)
    if not alive.any() or share >= 1:
        return np.ones(len(mass))
    order = np.argsort(-weight, kind="stable")
    m, w = mass[order], weight[order]
    # With the first k cells at 1, the others must carry what is left of the share.
    full, rest = np.cumsum(m) - m, np.cumsum((m * w)[::-1])[::-1]
    factor = (share * mass.sum() - full) / np.where(rest > 0, rest, np.inf)
    return np.minimum(1, factor[np.flatnonzero((factor * w <= 1) & (rest > 0))[0]] * weight)


def rake_cells(cells: DataFrame, scratch: Scratch, targets: dict[str, dict[str, float]], temperature: float, rounds: int = ROUNDS, close: float = CLOSE) -> tuple[DataFrame, float]:
    """rake, in Spark: cells (categories, mass) with their weight, and how far they were off."""
    spark, now, off = cells.sparkSession, cells.withColumn("weight", F.lit(1.0)), 0.0
    total = cells.agg(F.sum("mass").alias("t")).first()["t"] or 0.0
    if not total:
        return now, off
    goals = []
    for margin, name in zip(MARGINS, _NAMES, strict=True):
        sums = cells.groupBy(name).agg(F.sum("mass").alias("mass"))
        if margin in targets:
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[margin].items()], f"{name} string, goal double")
            sums = sums.join(given, name, "left").withColumn("goal", F.when(F.col("mass") > 0, F.coalesce("goal", F.lit(0.0))).otherwise(F.lit(0.0)))
        else:
            sums = sums.withColumn("goal", F.when(F.col("mass") > 0, F.pow("mass", F.lit(temperature))).otherwise(F.lit(0.0)))
        sums = scratch.write(sums, f"sums{name}", goal=F.sum("goal"))
        if not sums.said["goal"]:
            sums = scratch.write(sums.withColumn("goal", (F.col("mass") > 0).cast("double")), f"sums{name}", goal=F.sum("goal"))
        goals.append((name, sums.select(name, (F.col("goal") / sums.said["goal"] * total).alias("goal"))))
    now = scratch.write(now, "weights")
    for _ in range(rounds):
        off = 0.0
        for name, goal in goals:
            held = now.groupBy(name).agg(F.sum(F.col("mass") * F.col("weight")).alias("now")).join(goal, name)
            step = held.select(name, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).alias("step"))
            moved = now.join(step, name).withColumn("weight", F.col("weight") * F.coalesce("step", F.lit(1.0)))
            old, moved = now, scratch.write(moved, "weights", off=F.max(F.abs(F.col("step") - 1)))
            off = max(off, moved.said["off"] or 0.0)
            now = moved.select(*cells.columns, "weight")
            now.scratch_path = moved.scratch_path
            scratch.drop(old)
        if off < close:
            break
    return now, off


def cell_probabilities(cells: DataFrame, share: float) -> DataFrame:
    """probabilities, in Spark, of cells (mass, weight). The factor grows with every cell that it lifts to 1 and stops when there is none left."""
    alive = cells.where("mass > 0 and weight > 0")
    said = alive.agg(F.sum("mass").alias("m"), F.sum(F.col("mass") * F.col("weight")).alias("w")).first()
    total = cells.agg(F.sum("mass").alias("m")).first()["m"]
    if not said["m"] or share >= 1:
        return cells.withColumn("prob", F.lit(1.0))
    factor, last = share * total / said["w"], None
    while factor != last:
        high = F.col("weight") * factor > 1
        r = alive.agg(F.sum(F.when(high, F.col("mass"))).alias("full"), F.sum(F.when(~high, F.col("mass") * F.col("weight"))).alias("rest")).first()
        factor, last = (max(factor, (share * total - (r["full"] or 0.0)) / r["rest"]) if r["rest"] else factor), factor
    return cells.withColumn("prob", F.least(F.lit(1.0), F.col("weight") * factor))


def _plan(cells: DataFrame, scratch: Scratch, targets: dict[str, dict[str, float]], share: float, temperature: float) -> tuple[DataFrame, float]:
    """Categories, weight and prob of each cell, and how far the margins are off; cells is written and counted."""
    if cells.said["n"] > MAX_CELLS:
        raked, off = rake_cells(cells, scratch, targets, temperature)
        return cell_probabilities(raked, share).select(*_NAMES, "weight", "prob"), off
    rows = cells.orderBy(*_NAMES).toPandas()
    mass = rows["mass"].to_numpy(dtype=float)
    codes, goals = np.empty((len(rows), len(MARGINS)), np.int64), []
    for i, (m, name) in enumerate(zip(MARGINS, _NAMES, strict=True)):
        values, codes[:, i] = np.unique(rows[name].to_numpy(dtype=str), return_inverse=True)
        shares = np.bincount(codes[:, i], mass, len(values))
        goals.append(np.array([targets[m].get(v, 0.0) for v in values]) if m in targets else shares**temperature * (shares > 0))
    weight, off = rake(mass, codes, goals) if len(rows) else (mass, 0.0)
    prob = probabilities(mass, weight, share) if len(rows) else mass
    out = [(*map(str, r), float(w), float(p)) for r, w, p in zip(rows[_NAMES].itertuples(index=False), weight, prob, strict=True)]
    return F.broadcast(cells.sparkSession.createDataFrame(out, ", ".join(f"{n} string" for n in _NAMES) + ", weight double, prob double")), off


def _keyed(docs: DataFrame, topics: Column, size: Column) -> DataFrame:
    """docs with its categories and size."""
    if held := [c for c in docs.columns if c.lower().startswith("__mix")]:
        raise ValueError(f"columns {held} are used inside")
    at = {"source": F.col("source"), "lang": F.col("lang"), "topic": topics}
    return docs.select("*", *(F.coalesce(at[m].cast("string"), F.lit(UNKNOWN)).alias(n) for m, n in zip(MARGINS, _NAMES, strict=True)), size.alias("__mix_size"))


def _calibrated(keyed: DataFrame, scratch: Scratch, targets: dict[str, dict[str, float]] | None, share: float, temperature: float) -> DataFrame:
    """Written keyed rows with weight and prob as __mix_weight and __mix_prob."""
    cells = keyed.groupBy(*_NAMES).agg(F.coalesce(F.sum("__mix_size"), F.lit(0)).cast("double").alias("mass"))
    plan, off = _plan(scratch.write(cells, "cells"), scratch, targets or {}, share, temperature)
    if off > WARN:
        warnings.warn(f"margins of {MARGINS} are missed by a factor of up to {1 + off:.6g}: they contradict each other", stacklevel=3)
    return keyed.join(plan.withColumnsRenamed({"weight": "__mix_weight", "prob": "__mix_prob"}), _NAMES)


def calibrate(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE, temperature: float = TEMPERATURE, size: str = "n_tokens") -> DataFrame:
    """docs (source, lang, topic, doc_id and a size) with weight, prob and sampled."""
    scratch = Scratch(docs.sparkSession, "mixing")
    keyed = scratch.write(_keyed(docs, F.col("topic"), F.col(size)), "rows")
    found = _calibrated(keyed, scratch, targets, share, temperature)
    return found.select(*docs.columns, F.col("__mix_weight").alias("weight"), F.col("__mix_prob").alias("prob"), (uniform(F.col("doc_id")) < F.col("__mix_prob")).alias("sampled"))


def _count(batches: Iterator[pa.RecordBatch], path: str, at: int) -> Iterator[pa.RecordBatch]:
    count = sizes(path)
    for batch in slices(batches):
        n = count(batch.column(at).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, "__size"])


def _sized(docs: DataFrame, tokenizer: str | None) -> tuple[DataFrame, Column]:
    """docs and its texts' sizes."""
    if tokenizer is None:
        return docs, n_words(F.col("text"))
    schema, at = T.StructType([*docs.schema.fields, T.StructField("__size", T.LongType())]), docs.columns.index("text")
    return docs.mapInArrow(lambda it: _count(it, tokenizer, at), schema), F.col("__size")


def mixture(docs: DataFrame, tokenizer: str | None = None, **how) -> DataFrame:
    """doc_id, source, lang, topic, n_words or, with a tokenizer, n_tokens, weight, prob and sampled for each row of docs."""
    name = "n_words" if tokenizer is None else "n_tokens"
    rows, size = _sized(docs.select("doc_id", "source", "lang", "text"), tokenizer)
    return calibrate(rows.select("doc_id", "source", "lang", topic(F.col("text")).alias("topic"), size.alias(name)), size=name, **how)


def mix(docs: DataFrame, tokenizer: str | None = None, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE, temperature: float = TEMPERATURE) -> DataFrame:
    """The sampled rows of docs, with its columns."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows, size = _sized(docs, tokenizer)
    keyed = scratch.write(_keyed(rows, topic(F.col("text")), size), "rows")
    found = _calibrated(keyed, scratch, targets, share, temperature)
    return found.where(uniform(F.col("doc_id")) < F.col("__mix_prob")).select(*docs.columns)
