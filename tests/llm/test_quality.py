import math
import zlib

import pytest
from odd_texts import ODD
from pyspark.sql import functions as F

from fidelis.llm import quality
from fidelis.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def scored(spark, tables):
    return QUERIES["op11_quality_rules"](spark, SF).cache()


def test_held_out_accuracy(tables, scored):
    docs, labels = tables
    rows = scored.collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    out = scored.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in out) >= 0.95 * len(out)
    good, bad = [r.score for r in out if r.quality], [r.score for r in out if not r.quality]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) >= 0.97 * len(good) * len(bad)


def test_held_out_labels_and_other_columns_teach_nothing(tables, scored):
    docs, labels = tables
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    moved = docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    assert quality.score(moved, other).exceptAll(scored).count() == 0


def plain_paths(node):
    """Every node below the root, as bounds by statistic, from the tree itself."""
    out = []

    def walk(node, bounds):
        if bounds:
            out.append(tuple((k, *bounds[k]) for k in sorted(bounds)))
        if node.subtreeDepth() == 0:
            return
        name, at = quality.STATISTICS[node.split().featureIndex()], node.split().threshold()
        low, high = bounds.get(name, (None, None))
        walk(node.leftChild(), bounds | {name: (low, at if high is None else min(high, at))})
        walk(node.rightChild(), bounds | {name: (at if low is None else max(low, at), high)})

    walk(node, {})
    return out


def test_rules_are_a_trees_paths(spark, tables):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    docs, labels = tables
    rows = quality.measured(docs, "doc_id").join(labels, "doc_id").withColumn("label", F.col("quality").cast("double"))
    tree = DecisionTreeClassifier(featuresCol="v", maxDepth=4).fit(VectorAssembler(inputCols=list(quality.STATISTICS), outputCol="v").transform(rows))
    assert sorted(map(str, quality.paths(tree.toDebugString))) == sorted(map(str, plain_paths(tree._call_java("rootNode"))))


def test_compiled_score_is_the_sum_of_rules(spark):
    model = quality.Ensemble(-0.5, (((("letters", 0.5, None), ("marks", None, 0.25)), 2.0), ((("bangs", 0.1, 0.2),), -3.0)))
    rows = [(0.6, 0.2, 0.15), (0.5, 0.2, 0.1), (0.9, 0.25, 0.2), (0.4, 0.9, 0.3)]
    got = spark.createDataFrame(rows, "letters double, marks double, bangs double").select("*", model.score().alias("s")).collect()
    for r in got:
        z = -0.5 + 2 * (r.letters > 0.5 and r.marks <= 0.25) - 3 * (0.1 < r.bangs <= 0.2)
        assert math.isclose(r.s, 1 / (1 + math.exp(-z)))


def plain_statistics(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    raw = [w.encode() for w in words]
    is_letter = lambda b: b >= 128 or chr(b).isalpha()
    sign = lambda b: 32 < b < 128 and not chr(b).isalnum() and chr(b) not in ".,;:'\"?()-!"
    total, letters = sum(map(len, raw)), sum(is_letter(b) for w in raw for b in w)
    capital = [sum(65 <= b <= 90 for b in w) > 1 and not any(97 <= b <= 122 for b in w) for w in raw]
    folded = [w.lower() for w in words]
    runs = [range(i, min(i + quality.WINDOW, n)) for i in range(0, n, quality.WINDOW)]
    fresh = [len({folded[i] for i in r}) for r in runs]
    return {
        "log_words": math.log1p(n), "mean_length": total / n, "letters": letters / total, "signs": sum(sign(b) for w in raw for b in w) / total, "capital_words": sum(capital) / n,
        "repeated_words": sum(a == b for a, b in zip(folded, folded[1:], strict=False)) / n, "fresh_words": sum(fresh) / n, "top_word": max(folded.count(w) for w in set(folded)) / n,
        "window_capitals": max(sum(capital[i] for i in r) / max(len(r), min(n, quality.WINDOW)) for r in runs), "lines": sum(1 for line in (text or "").split("\n")[1:] if line.strip()) / n,
        "symbol_words": sum(any(map(sign, w)) for w in raw) / n, "window_distinct": min(f / len(r) for f, r in zip(fresh, runs, strict=True) if len(r) >= min(n, quality.WINDOW)),
    }


@pytest.mark.parametrize("piece", [1 << 18, 300])
def test_statistics_equal_plain_ones(tables, monkeypatch, piece):
    from fidelis.llm import hashing

    monkeypatch.setattr(hashing, "WINDOW", piece)
    monkeypatch.setattr(quality, "PIECE", piece)
    docs, _ = tables
    texts = [r.text for r in docs.select("text").limit(60).collect()] + ["one", "a  b\n\nc", "\n\nAB AB ab !! ##", "x" * 2000 + " y"]
    for text in texts:
        got = dict(zip(quality.STATISTICS, quality.statistics(text), strict=True))
        got["signs"] = got["symbols"]
        for name, want in plain_statistics(text).items():
            assert math.isclose(got[name], want, abs_tol=1e-12), (name, text[:80])


def test_odd_rows_and_none(spark, docs_of, tables):
    docs, labels = tables
    odd = docs_of([*ODD, "word ## " * 200_000]).drop("score")
    both = odd.select("doc_id", "text").withColumn("doc_id", -1 - F.col("doc_id")).unionByName(docs.select("doc_id", "text"))
    rows = {-1 - r.doc_id: r for r in quality.score(both, labels).where("doc_id < 0").collect()}
    assert len(rows) == len(ODD) + 1 and rows[0].score == rows[1].score == rows[2].score and rows[6].score == rows[7].score and rows[len(ODD)].predicted == 0
    with pytest.raises(ValueError, match="score"):
        quality.score(docs_of(["a"]).select(F.col("doc_id").alias("score"), "text"), labels, key="score")
    assert quality.score(docs_of(["a"]).where("false"), labels).count() == 0
    none = labels.where("false")
    assert {r.score for r in quality.score(docs_of(["a", None], ids=[1, None]), none).collect()} == {0.5}


def test_one_class_and_repeated_rows(spark, docs_of):
    labels = spark.createDataFrame([(i, 1) for i in range(8)] + [(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    rows = quality.score(docs_of(["good text", "good text", *["text"] * 6]), labels).collect()
    taught = sum(not r.held_out for r in rows)
    assert len(rows) == 8 and {round(r.score, 9) for r in rows} == {round((taught + 1) / (taught + 2), 9)}


def test_the_bound_takes_a_share(tables, monkeypatch):
    docs, labels = tables
    seen = []
    own = quality.learn
    monkeypatch.setattr(quality, "learn", lambda rows: seen.append(rows.count()) or own(rows))
    quality.score(docs, labels, most=100)
    quality.score(docs, labels)
    assert 50 < seen[0] < 160 < seen[1]
