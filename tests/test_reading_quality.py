from fidelis.operators import run

SCHEMA = "raw string, answer string, rationale string, options array<string>, scores array<double>, gold long, t_generate double, t_score double"
OPTIONS = ["cat", "Dog ", "cow"]
ROWS = [
    ("A\nRationale: fur", "cat", "fur", OPTIONS, [2.0, 2.0, 1.0], 0, 1.0, 0.5),  # the first of two largest
    ("  <think>hm</think>B", "dog", "", OPTIONS, [0.0, 3.0, 1.0], 1, 2.0, None),  # agrees but for case and blanks; gold is compared as it is
    ("<think>never", None, None, OPTIONS, [0.0, 0.0, 9.0], 2, 3.0, 0.5),
    ("C", "cow", None, OPTIONS, None, None, None, 0.5),
    ("C Rationale:", "cow", None, OPTIONS, [], 7, 0.0, 0.5),
    (None, "cow", "r", OPTIONS, [1.0, 2.0, 3.0], -1, 0.0, 0.5),
]


def plain(rows):
    parsed = [r for r in rows if r[1] is not None]
    best = lambda r: r[3][max(range(len(r[4])), key=lambda i: r[4][i])].strip().lower() if r[4] else None
    opened = [r for r in rows if r[0] and r[0].lstrip().startswith("<think>")]
    return {
        "n": len(rows), "parsed": len(parsed), "with_rationale": sum(bool(r[2]) for r in rows), "opened": len(opened), "unclosed": sum("</think>" not in r[0] for r in opened),
        "marker_compliance": sum("Rationale:" in (r[0] or "") for r in rows), "agreement": round(sum(best(r) == r[1].strip().lower() for r in parsed) / max(1, len(parsed)), 3),
        "gold_correct": sum(r[5] is not None and 0 <= r[5] < len(r[3]) and r[1] == r[3][r[5]] for r in parsed),
        "mean_t_generate": round(sum(r[6] or 0 for r in rows) / max(1, len(rows)), 1), "mean_t_score": round(sum(r[7] or 0 for r in rows) / max(1, len(rows)), 1),
    }


def test_extraction_quality_equals_the_plain_version(spark):
    for rows in (ROWS, ROWS[2:3], []):
        df = spark.createDataFrame(rows, SCHEMA)
        assert run.extraction_quality(df).first().asDict() == plain(rows)
    grouped = run.extraction_quality(spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "t_score is null as g"), ["g"]).collect()
    assert {r.g: r.n for r in grouped} == {True: 1, False: 5}


def test_the_scorer_that_agrees_more(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "scores as letter_scores", "transform(options, x -> if(lower(trim(x)) = answer, 1D, 0D)) as text_scores")
    got = run.scorer_diagnostic(df).first()
    assert (got.n, got.parsed, got.letter_agreement, got.text_agreement, got.gold_correct, got.better) == (6, 5, plain(ROWS)["agreement"], 1.0, 1, "text")
    assert run.scorer_diagnostic(df.withColumn("text_scores", df.letter_scores)).first().better is None
    assert tuple(run.scorer_diagnostic(df.limit(0)).first()) == (0, 0, 0.0, 0.0, 0, None)
