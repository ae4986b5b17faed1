"""keep_one moves the texts that its filter doesn't clear, and no others; whatever the filter's size, the same rows stay."""

import random

import pytest

from rangeweave.llm import ngram_join
from rangeweave.llm.common import materialize

from test_llm_operators import brute_components, words


def shuffled_texts(df) -> int:
    """Rows with a text that the exchanges of df's plan wrote, once it has run."""

    def nodes(plan):
        inner = {"AdaptiveSparkPlan": "executedPlan", "ResultQueryStage": "plan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan"}.get(plan.nodeName())
        if inner:
            yield from nodes(getattr(plan, inner)())
            return
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    found = [x for x in nodes(df._jdf.queryExecution().executedPlan()) if x.nodeName() == "Exchange" and "text#" in x.output().toString()]
    return sum(x.metrics().apply("shuffleRecordsWritten").value() for x in found)


@pytest.fixture
def no_broadcast(spark):
    """As on tables too large for a broadcast of the rows that go."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def some_texts() -> list[str]:
    r = random.Random(31)
    texts = [words(r, 60, 50_000) for _ in range(400)]
    return texts + texts[:20] + [f"{t} more" for t in texts[20:40]]


def test_only_few_texts_are_shuffled(spark, no_broadcast):
    texts = some_texts()
    _, comp = brute_components(texts)
    docs = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test-docs")
    out = ngram_join.keep_one(docs).select("doc_id", "text")
    assert sorted(map(tuple, out.collect())) == sorted((i, texts[i]) for i in set(comp))
    assert 40 <= shuffled_texts(out) <= 60


@pytest.mark.parametrize("most", [1, 2, 1 << 18])
def test_any_size_of_filter(spark, no_broadcast, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "MARK_WORDS", most)
    t = some_texts()
    rows = list(enumerate(t)) + [(None, t[50]), (None, t[51]), (60, t[60]), (61, t[62]), (None, t[399][:-40]), (None, ""), (None, ""), (7, None), (7, None)]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "text").collect()
    _, comp = brute_components([x[1] or "" for x in rows])
    group = {}
    for i, c in enumerate(comp):
        group.setdefault(c, []).append(rows[i])
    # None sorts behind every id; of the rows of one component the smallest id stays
    assert sorted(x[0] if x[0] is not None else 10**6 for x in map(tuple, got)) == sorted(min(x[0] if x[0] is not None else 10**6 for x in g) for g in group.values())


def test_split_loses_nothing(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 7 > 0 THEN id END AS i", "xxhash64(id) AS k", "'x' AS word", "id AS bits")
    named = rows.where("bits % 10 = 0").selectExpr("i AS gone_i", "k AS gone_k")
    near, clear = ngram_join.split(rows, "i", "k", named, "gone_i", "gone_k", named.count())
    a, b = [{x.bits for x in part.collect()} for part in (near, clear)]
    assert a | b == set(range(5000)) and not a & b and near.columns == rows.columns
    assert a >= set(range(0, 5000, 10)) and len(a) < 800
