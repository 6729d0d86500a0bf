"""Log-probabilities from arrays of logits, stable for any size of logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _with(value: Column, use) -> Column:
    """use(value), the value computed once; a column that a function of array elements names is computed anew for each of them."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def log_sum_exp(logits: Column) -> Column:
    """log(sum(exp(x))), taken from the largest on; null for an empty array and one with a null or NaN, infinite if the largest is."""

    def run(x: Column, most: Column) -> Column:
        bad = F.exists(x, lambda v: v.isNull() | F.isnan(v))
        total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - most))
        return F.when(~bad & (F.size(x) > 0), F.when(F.abs(most) == float("inf"), most).otherwise(most + F.log(total)))

    return _with(logits.cast("array<double>"), lambda x: _with(F.array_max(x), lambda most: run(x, most)))


def log_softmax(logits: Column) -> Column:
    """The log-probabilities of all places; null where log_sum_exp is null or infinite."""
    x = logits.cast("array<double>")
    return _with(log_sum_exp(logits), lambda z: F.when(F.abs(z) < float("inf"), F.transform(x, lambda v: v - z)))


def log_probability(logits: Column, token: Column) -> Column:
    """The log-probability of one place, from 0; null out of range and where log_sum_exp is null or infinite."""
    own = F.get(logits.cast("array<double>"), token.cast("int"))
    return _with(log_sum_exp(logits), lambda z: F.when(F.abs(z) < float("inf"), own - z))


def log_probability_of_known(logits: Column, token: Column) -> Column:
    """As log_probability, but over the entries that are not null, as SQL's aggregates take them; NaN with a NaN entry or an infinite largest one, null where no entry or the token's own is known."""
    x = logits.cast("array<double>")
    own = F.get(x, token.cast("int"))

    def run(x: Column, most: Column) -> Column:
        return own - most - F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - most)))

    return _with(F.filter(x, lambda v: v.isNotNull()), lambda x: _with(F.array_max(x), lambda most: run(x, most)))
