import pytest
from pyspark.sql import functions as F

from fidelis.functions import text
from fidelis.operators import gates

OPTIONS = ["cigarette", "cigar", "pipe", "pen"]
# Replies, and what is to be extracted from them.
CASES = [
    ("A. cigarette\nRationale: he is smoking.", "cigarette", "he is smoking."),
    ("b)\nRationale: looks like a cigar.", "cigar", "looks like a cigar."),
    ("B: cigar\nRationale: colon.", "cigar", "colon."),
    ("c\nRationale: bare.", "pipe", "bare."),
    (" D \n", "pen", None),
    ("cigarette.\nRationale: smoke.", "cigarette", "smoke."),
    ("Pen\nRationale: x", "pen", "x"),
    ("A cigarette is visible.\nRationale: smoke.", None, "smoke."),
    ("The answer is B.\nRationale: cigar.", None, "cigar."),
    ("E. something\nRationale: out.", None, "out."),
    ("A. cigarette\nNo marker.", "cigarette", None),
    ("A. x Rationale: same line.", "cigarette", "same line."),
    ("Ａ. fullwidth\nRationale: u.", None, "u."),
    ("AB. option\nRationale: t.", None, "t."),
    ("A. cigarette or B. cigar\nRationale: first.", "cigarette", "first."),
    ("pipe...\nRationale:  \n", "pipe", None),
    (" 　A. x\nRationale: y\u0085", "cigarette", "y"),
    ("", None, None),
]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_answers_and_rationales(spark):
    options = F.array(*map(F.lit, OPTIONS))
    texts = [c[0] for c in CASES]
    assert column(spark, texts, lambda c: text.extract_answer(c, options)) == [c[1] for c in CASES]
    assert column(spark, texts, text.extract_rationale) == [c[2] for c in CASES]


def test_an_option_text_must_be_unique(spark):
    assert column(spark, ["same"], lambda c: text.extract_answer(c, F.array(F.lit("same"), F.lit("Same ")))) == [None]


def test_think_blocks(spark):
    cases = {
        " <think>a</think>\nA. x": "A. x", "<think>never closed": None, "plain <think>x</think>": "plain <think>x</think>",
        "<|begin_of_box|>A.<|end_of_box|> x\nRationale: <answer>kept</answer>": "A. x\nRationale: <answer>kept</answer>",
        "<think>one</think><think>two</think>B": "<think>two</think>B",
    }
    assert column(spark, list(cases), text.strip_think) == list(cases.values())


@pytest.mark.parametrize("value", ["  x  ", " a b ", "\x1c\x1fx", "", "   ", "a\n", "\nq​"])
def test_strip_and_tokens_are_pythons(spark, value):
    assert column(spark, [value], text.strip) == [value.strip()]
    assert column(spark, [value], text.n_tokens) == [len(value.split())]


def test_prompt(spark):
    got = column(spark, ["Q?"], lambda c: text.render_prompt(c, F.array(F.lit("x"), F.lit("y"))))[0]
    assert got.startswith("Question: Q?\nA. x\nB. y\n\nAnswer with") and got.endswith('after "Rationale:".')


def test_jaccard(spark):
    df = spark.createDataFrame([("the cat sat", "a cat ran"), ("the", "a"), ("x", "x")], "a string, b string")
    assert [round(r[0], 6) for r in df.select(text.jaccard_drift(F.col("a"), F.col("b"))).collect()] == [round(2 / 3, 6), 0.0, 0.0]


GOOD = ("umbrella", "It is raining so people carry an umbrella.", ["umbrella", "hat"], True, "pool")


@pytest.mark.parametrize(("row", "code", "reached"), [
    (GOOD, None, "P1P2P3"),
    (("umbrella", None, *GOOD[2:]), "E1", "P1"), ((None, *GOOD[1:]), "E1", "P1"), (("umbrella", " 　 ", *GOOD[2:]), "E1", "P1"),
    (("umbrella", GOOD[1], ["Umbrella", "umbrella "], True, "pool"), "E1", "P1"),
    (("umbrella", "I cannot say what this picture is.", *GOOD[2:]), "E2", "P1P2"), (("umbrella", "too few words", *GOOD[2:]), "E2", "P1P2"),
    (("umbrella", " Umbrella. ", *GOOD[2:]), "E2", "P1P2"), (("umbrella", "As an AI I don't know what is in there.", ["umbrella", "hat"], False, "pool"), "E2", "P1P2"),
    ((*GOOD[:3], False, "pool"), "E3", "P1P2P3"), ((*GOOD[:4], "other"), "E3", "P1P2P3"), (("hat", *GOOD[1:]), None, "P1P2P3"),
])
def test_gates(spark, row, code, reached):
    df = spark.createDataFrame([row], "answer string, rationale string, options array<string>, image boolean, dataset string")
    a, r, o = F.col("answer"), F.col("rationale"), F.col("options")
    gate = gates.cascade(gates.complete(a, r, o), gates.bona_fide(a, r, text.ABSTENTIONS), gates.in_scope(F.col("image"), o, F.col("dataset"), ["pool"]))
    got = df.select(gate.alias("g")).first().g
    assert (got.e_code, "".join(x.gate for x in got.gates)) == (code, reached)


def test_coherence(spark):
    base = "one two three four five six seven eight nine ten " * 4
    cases = {"": "empty", "xx xx xx": "length", "w " * 9: "length", "w " * 10: "pass", "w " * 161: "length", "w " * 160: "pass", "i cannot " + "w " * 20: "abstention"}
    assert column(spark, list(cases), lambda c: gates.coherence(F.lit(base), c, text.ABSTENTIONS)) == list(cases.values())
