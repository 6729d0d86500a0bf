"""Ordered eligibility gates over output tuples, the coherence screen and the control set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fidelis.functions.text import folded, n_tokens, registry_hit, strip

LEAST_TOKENS, LEAST_RATIO, MOST_RATIO = 5, 0.25, 4.0


def complete(answer: Column, rationale: Column, options: Column) -> Column:
    """P1: both present, the rationale not blank, the answer matching exactly one option."""
    matches = F.size(F.filter(options, lambda o: folded(o) == folded(answer)))
    return F.coalesce((strip(rationale) != "") & (matches == 1), F.lit(False))


def bona_fide(answer: Column, rationale: Column, patterns: tuple[str, ...]) -> Column:
    """P2: no abstention, no echo of the answer, enough words."""
    plain = lambda c: F.lower(F.regexp_replace(strip(c), r"\.+$", ""))
    return F.coalesce(~registry_hit(rationale, patterns) & (plain(rationale) != plain(answer)) & (n_tokens(rationale) >= LEAST_TOKENS), F.lit(False))


def in_scope(has_image: Column, options: Column, dataset: Column, scope: list[str]) -> Column:
    """P3: an image, two options or more, and a declared dataset."""
    return F.coalesce(has_image & (F.size(options) >= 2) & dataset.isin(*scope), F.lit(False))


def cascade(p1: Column, p2: Column, p3: Column) -> Column:
    """(e_code, gates): the first failing gate's code, null if none, and the determinations of the gates reached."""
    said = lambda gate, ok: F.struct(F.lit(gate).alias("gate"), ok.alias("passed"))
    code = F.when(~p1, "E1").when(~p2, "E2").when(~p3, "E3")
    gates = F.when(~p1, F.array(said("P1", p1))).when(~p2, F.array(said("P1", p1), said("P2", p2))).otherwise(F.array(said("P1", p1), said("P2", p2), said("P3", p3)))
    return F.struct(code.alias("e_code"), gates.alias("gates"))


def coherence(baseline: Column, counterfactual: Column, patterns: tuple[str, ...]) -> Column:
    """pass, or the first reason against: empty, length, abstention."""
    n, base = n_tokens(F.coalesce(counterfactual, F.lit(""))), n_tokens(baseline)
    low = F.greatest(F.lit(LEAST_TOKENS).cast("long"), F.ceil(LEAST_RATIO * base))
    return (
        F.when(strip(F.coalesce(counterfactual, F.lit(""))) == "", "empty").when(~n.between(low, F.floor(MOST_RATIO * base)), "length")
        .when(registry_hit(counterfactual, patterns), "abstention").otherwise("pass")
    )


def controls(a_true: Column, hflip_held: Column, lateral: Column, answers_ok: Column, rationales_ok: Column, coherent: Column, control_drift: Column, control_applicable: Column, theta: Column) -> Column:
    """Array of (control, status) for the branch: the answer side always, the rationale side where A is true.

    hflip_held is null for a reading that can't be evaluated, which fails unless the question is lateral.
    """
    row = lambda name, status: F.struct(F.lit(name).alias("control"), status.alias("status"))
    passed = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")
    answer_side = F.array(row("hflip", F.when(lateral, "inapplicable").otherwise(passed(hflip_held))), row("readings-integrity", passed(answers_ok)))
    rationale_side = F.array(
        row("rationale-readings-integrity", passed(rationales_ok)), row("coherence", passed(coherent)),
        row("control-edit", F.when(~control_applicable, "inapplicable").otherwise(passed(control_drift < theta))),
    )
    return F.when(a_true, F.concat(answer_side, rationale_side)).otherwise(answer_side)


def controls_hold(results: Column) -> Column:
    return F.forall(results, lambda r: r["status"] != "fail")
