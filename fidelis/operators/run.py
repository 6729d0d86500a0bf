"""Running a model over a shard: adapters by name, the quality gate and its artifact, and the guards before a run."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.functions.stats import argmax_first
from fidelis.functions.text import MARKER, folded, lstrip
from fidelis.sources.scratch import path_of

# The gate's floors and slice, and the part of an identity that is refused.
LEAST_PARSED, LEAST_AGREEMENT, GATE_SLICE, REFUSED = 0.90, 0.60, 50, "int8"


class RunRefused(RuntimeError):
    """A run that must not start."""


class Adapters:
    """Models by name; a factory is called, with its imports, only when its model is asked for."""

    def __init__(self) -> None:
        self._factories: dict[str, Callable[..., object]] = {}

    def register(self, name: str, factory: Callable[..., object]) -> None:
        if name in self._factories:
            raise ValueError(f"adapter {name!r} is registered already")
        self._factories[name] = factory

    def names(self) -> list[str]:
        return sorted(self._factories)

    def build(self, name: str, **options) -> object:
        if name not in self._factories:
            raise ValueError(f"no adapter {name!r}; there are {self.names()}")
        return self._factories[name](**options)


def calibration_gate(outputs: DataFrame, answer: Column, expected: Column, by: list[str] | None = None) -> DataFrame:
    """n, parseability, agreement among the parsed, and passed, of outputs; by: one row for each group."""
    parsed, agreed = F.count_if(answer.isNotNull()), F.count_if(answer == expected)
    sums = outputs.groupBy(*(by or [])).agg(F.count("*").alias("n"), parsed.alias("parsed"), agreed.alias("agreed"))
    share, agreement = F.try_divide("parsed", "n"), F.coalesce(F.try_divide("agreed", "parsed"), F.lit(0.0))
    passed = F.coalesce((share >= LEAST_PARSED) & (agreement >= LEAST_AGREEMENT), F.lit(False))
    return sums.select(*(by or []), "n", share.alias("parseability"), agreement.alias("agreement"), passed.alias("passed"))


def _option(options: Column, at: Column) -> Column:
    """The option at a 0-based place; null where there is none."""
    return F.when(at >= 0, F.get(options, at.cast("int")))


def _agrees(scores: str) -> Column:
    """Whether the first option of the largest score is the parsed answer, without case and surrounding white space."""
    return folded(_option(F.col("options"), argmax_first(F.col(scores)))) == folded(F.col("answer"))


def _of_parsed(agreed: Column) -> Column:
    """A share of the parsed outputs to 3 digits, 0 if none was parsed."""
    return F.round(F.count_if(F.col("answer").isNotNull() & agreed) / F.greatest(F.lit(1), F.count_if(F.col("answer").isNotNull())), 3)


def _gold_correct() -> Column:
    return F.count_if(F.col("answer") == _option(F.col("options"), F.col("gold")))


def _mean(seconds: str) -> Column:
    """A sum over all outputs divided by their number, to 1 digit; a missing time adds nothing, and no outputs give 0."""
    return F.round(F.coalesce(F.sum(F.col(seconds).cast("double")), F.lit(0.0)) / F.greatest(F.lit(1), F.count("*")), 1)


def extraction_quality(outputs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How well outputs (raw, answer, rationale, options, scores, gold, t_generate, t_score) can be read, in one aggregate.

    gold is the right option's 0-based place; scores are the options' scores, whose first largest one is held against the
    answer. Null, empty and too short scores agree with nothing, a null gold or answer is not correct, and an empty
    rationale is none. by: one row for each group; without it no outputs give one row of zeros.
    """
    opened = F.coalesce(lstrip(F.col("raw")).startswith("<think>"), F.lit(False))
    return outputs.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count("answer").alias("parsed"), F.count_if(F.length("rationale") > 0).alias("with_rationale"), F.count_if(opened).alias("opened"),
        F.count_if(opened & ~F.col("raw").contains("</think>")).alias("unclosed"), F.count_if(F.col("raw").contains(MARKER)).alias("marker_compliance"),
        _of_parsed(_agrees("scores")).alias("agreement"), _gold_correct().alias("gold_correct"), _mean("t_generate").alias("mean_t_generate"), _mean("t_score").alias("mean_t_score"),
    )


def scorer_diagnostic(outputs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of outputs (answer, options, letter_scores, text_scores, gold), which of two scorers agrees with the answers given.

    letter_scores are those of the options' letters, text_scores those of their texts, each read as extraction_quality
    reads scores; better is the scorer of more agreements, null where they are equal.
    """
    letter, whole = _of_parsed(_agrees("letter_scores")), _of_parsed(_agrees("text_scores"))
    found = outputs.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count("answer").alias("parsed"), letter.alias("letter_agreement"), whole.alias("text_agreement"), _gold_correct().alias("gold_correct"))
    return found.withColumn("better", F.when(F.col("letter_agreement") > F.col("text_agreement"), "letter").when(F.col("letter_agreement") < F.col("text_agreement"), "text"))


def _write(spark: SparkSession, path: str, text: str, overwrite: bool) -> None:
    where, system = path_of(spark, path)
    stream = system.create(where, overwrite)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_gate(gate: DataFrame, identity: str, path: str) -> dict:
    """The gate's one row with the identity it certifies, as a JSON file; what was written."""
    found = gate.first().asDict() | {"identity": identity}
    _write(gate.sparkSession, path, json.dumps(found, indent=2, sort_keys=True) + "\n", True)
    return found


def read_gate(spark: SparkSession, path: str) -> dict | None:
    where, system = path_of(spark, path)
    return json.loads(spark.read.text(path, wholetext=True).first().value) if system.exists(where) else None


def log_line(spark: SparkSession, folder: str, tag: str, message: str) -> str:
    """Adds a line to a run's log, a folder of files in the order of time, as shared stores can't append; the line."""
    now = datetime.now(timezone.utc)
    line = f"{now:%Y-%m-%d %H:%M:%S} [{tag}] {message}"
    _write(spark, f"{folder.rstrip('/')}/{now:%Y%m%dT%H%M%S.%f}.log", line + "\n", False)
    return line


def admit(shard: DataFrame, identity: str, gate_path: str) -> DataFrame:
    """shard, if its run may start: an identity that isn't quantized, and a gate artifact that passed and certifies it."""
    gate = read_gate(shard.sparkSession, gate_path)
    if REFUSED in identity:
        raise RunRefused(f"quantized identity refused: {identity}")
    if gate is None:
        raise RunRefused(f"no gate artifact at {gate_path}")
    if not gate["passed"]:
        raise RunRefused("the gate artifact records a failed gate")
    if gate["identity"] != identity:
        raise RunRefused("the gate artifact certifies another identity")
    return shard


def refusals(runs: DataFrame, gates: DataFrame) -> DataFrame:
    """runs (generator, identity, ...) with the reason for which admit would refuse each, null for none; gates: (generator, identity, passed)."""
    held = gates.select("generator", F.col("identity").alias("__certified"), F.col("passed").alias("__passed"), F.lit(True).alias("__there"))
    reason = (
        F.when(F.col("identity").contains(REFUSED), "quantized identity").when(F.col("__there").isNull(), "no gate artifact")
        .when(~F.coalesce("__passed", F.lit(False)), "failed gate").when(~F.col("identity").eqNullSafe(F.col("__certified")), "other identity")
    )
    return runs.join(held, "generator", "left").select(*runs.columns, reason.alias("refused"))
