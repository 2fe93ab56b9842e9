import math
import os
import zlib

import numpy as np
import pytest
import regex
from leafledger.llm import rules
from leafledger.llm.queries import QUERIES
from pyspark.sql import functions as F


def plain_statistics(text):
    text = text or ""
    words = [w for w in regex.split(r"[ \t\n\x0b\f\r]+", text) if w]
    size, some = max(len(text), 1), max(len(words), 1)

    def share(pattern):
        return sum(map(len, regex.findall(pattern, text))) / size

    echoes = sum(a == b for a, b in zip(words, words[1:]))
    return (
        len(text), len(words), (len(text) - len(words)) / some, len(words) / (1 + text.count("\n")), share(r"\p{L}"), share(r"\p{Lu}"),
        share(r"\p{Nd}"), share(r"\."), share(r"[,;:]"), share(r"[!?]"), share(r"\|"), share(r"[#$%&*+/<=>@\[\\\]^_`{}~]"),
        len(set(words)) / some, echoes / some,
    )


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def larger(sf_dir):
    """A table with enough labels to judge by, where it is there."""
    other = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    return other if os.path.isdir(other) else sf_dir


def test_statistics_equal_plain_python(make):
    texts = ["The THE the the  the.\nNo no, [a|b] #5 é É 中文!?", " lead\ttail ", "", None, "one", "a a a b b a", "x" * 5000 + " " + "y " * 3000, "a\x85b c d"]
    docs = make(list(enumerate(texts)))
    for row in rules.with_statistics(docs).collect():
        assert tuple(row.statistics.asDict()) == rules.STATISTICS
        assert tuple(row.statistics) == pytest.approx(plain_statistics(texts[row.doc_id]), abs=1e-12), texts[row.doc_id]


def test_rules_are_paths_and_most_have_no_weight():
    rng = np.random.default_rng(1)
    values = rng.random((1200, len(rules.STATISTICS)))
    labels = ((values[:, 3] > 0.5) & (values[:, 7] <= 0.4) | (values[:, 1] > 0.9)).astype(int)
    model = rules.fit(values[:900], labels[:900])
    assert 2 <= len(model.rules) < rules.TREES * (2 ** (rules.DEPTH + 1) - 2) / 3
    assert all(1 <= len({c.statistic for c in rule}) <= rules.DEPTH and weight for rule, weight in model.rules)
    score = 1 / (1 + np.exp(-model.bias - rules._holds([r for r, _ in model.rules], values) @ [w for _, w in model.rules]))
    assert ((score[900:] > 0.5) == labels[900:]).mean() > 0.95


def test_lasso_meets_its_conditions():
    """At the minimum the gradient is within the penalty, and equals it where a weight is not zero."""
    rng = np.random.default_rng(2)
    z = (rng.random((300, 20)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * z[:, 0] + 3 * z[:, 1] + 0.3))).astype(float)
    weights, bias = rules._lasso(z, y, 0.02, np.zeros(20), 0.0)
    for _ in range(30):
        weights, bias = rules._lasso(z, y, 0.02, weights, bias)
    gradient = z.T @ (1 / (1 + np.exp(-z @ weights - bias)) - y) / 300
    assert 2 <= (weights != 0).sum() < 15
    assert np.abs(gradient).max() <= 0.02 + 1e-4
    assert gradient[weights != 0] == pytest.approx(-0.02 * np.sign(weights[weights != 0]), abs=1e-4)


def test_sql_of_a_model_equals_its_sum(make):
    one = frozenset({rules.Condition(0, True, 3.5), rules.Condition(12, False, 0.75)})
    two = frozenset({rules.Condition(5, True, 0.1)})
    model = rules.Model(0.25, ((one, -1.5), (two, 0.5)))
    texts = ["a a a", "abc", "A bc", "a a A", None, ""]
    for row in rules.with_score(make(list(enumerate(texts))), model).collect():
        values = plain_statistics(texts[row.doc_id])
        odds = 0.25 - 1.5 * (values[0] > 3.5 and values[12] <= 0.75) + 0.5 * (values[5] > 0.1)
        assert row.score == pytest.approx(1 / (1 + math.exp(-odds)))


def test_held_out_accuracy(spark, larger):
    scored = QUERIES["op12_quality_rules"](spark, larger).toPandas()
    labels = spark.read.parquet(f"{larger}/labels.parquet").select("doc_id", "quality").toPandas()
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    assert len(scored) == docs.count()
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.7) == scored.predicted).all()
    assert (scored.held_out == scored.doc_id.map(held)).all()
    both = scored[scored.held_out].merge(labels, on="doc_id")
    good, bad = both[both.quality == 1].score.values, both[both.quality == 0].score.values
    assert len(bad) >= 3
    assert (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean() > 0.9
    assert (both.predicted == both.quality).mean() > 0.9


def test_held_out_labels_and_other_columns_decide_nothing(spark, larger):
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    turned = labels.withColumn("quality", F.when(rules.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    model = rules.train(docs, labels)
    assert model.rules and rules.train(docs, turned) == model
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert rules.train(other, labels.withColumn("toxic", F.lit(1))) == model


def test_few_or_no_labels(spark, make):
    docs = make([(i, f"text {i}") for i in range(6)])
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in rules.score_quality(docs, empty).collect()} == {0.5}
    alike = spark.createDataFrame([(i, 1, 0) for i in range(6)] + [(1, None, 0), (None, 0, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    n = sum(not held(i) for i in range(6))
    assert {round(r.score, 9) for r in rules.score_quality(docs, alike).collect()} == {round((n + 1) / (n + 2), 9)}
    assert rules.score_quality(make([]), alike).collect() == []


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i % 8, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = rules.score_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r.score)
    assert by_id[1] == by_id[2] and by_id[5][0] == by_id[5][1] == by_id[6][0]
    assert [r.held_out for r in rows if r.doc_id is None] == [False, False]
    kept = rules.with_score(odd, rules.Model(0.0, ()))
    assert kept.columns == [*odd.columns, "score_"]


def test_no_statistic_is_computed_twice(spark, sf_dir):
    model = rules.Model(0.0, tuple((frozenset({rules.Condition(i, True, 0.5)}), 1.0) for i in range(14)) * 3)
    plan = rules.with_score(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
