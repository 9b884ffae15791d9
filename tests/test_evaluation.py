"""Closed-form values of the metrics."""

import math

import pytest

from loomsearch.operators import evaluation as ev
from loomsearch.operators import features


@pytest.fixture(scope="module")
def tables(spark):
    queries = spark.createDataFrame([("q1", "conceptual"), ("q2", "path"), ("q3", "path")], "query_id string, query_shape string")
    ranked = spark.createDataFrame([("q1", p, i) for i, p in enumerate("abcd", 1)] + [("q2", "x", 1)], "query_id string, path string, rank int")
    judged = spark.createDataFrame([("q1", "a", True), ("q1", "c", True), ("q1", "z", True), ("q2", "y", True), ("q3", "a", False)], "query_id string, path string, relevant boolean")
    return queries, ranked, judged


def test_per_query(tables):
    got = {r["query_id"]: r.asDict() for r in ev.per_query(*tables, 3).collect()}
    dcg, ideal = 1 + 1 / math.log2(4), 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert [got["q1"][m] for m in ev.METRICS] == pytest.approx([2 / 3, 2 / 3, (1 + 2 / 3) / 3, 1.0, dcg / ideal])
    assert all(got[q][m] == 0 for q in ("q2", "q3") for m in ev.METRICS)
    assert all(r[m] == 0 for r in ev.per_query(*tables, 0).collect() for m in ev.METRICS)


def test_means_and_slices(tables):
    each = ev.per_query(*tables, 3)
    assert ev.aggregate(each).first()["recall_at_k"] == pytest.approx(2 / 9)
    by = {r["query_shape"]: r for r in ev.slices(each, tables[0]).collect()}
    assert (by["conceptual"]["family"], by["path"]["queries"], by["path"]["recall_at_k"]) == ("many_relevant_documents", 2, 0.0)
    assert ev.aggregate(each.limit(0)).first()["recall_at_k"] == 0.0


def test_groundedness_and_tokens(spark, tables):
    queries, ranked, _ = tables
    rows = [("q1", "a", True, 1, 2, "aé"), ("q1", "b", False, 1, 1, "bb"), ("q1", "z", True, 3, 4, "zz"), ("q3", "a", False, 1, 1, "x")]
    evidence = spark.createDataFrame(rows, "query_id string, path string, relevant boolean, start_line int, end_line int, snippet string")
    got = {r["query_id"]: r for r in ev.groundedness(queries, ranked, evidence, 3).collect()}
    assert got["q1"][1:] == (2, 2, 1, 1, 2, 0.5, 0.5, 0.5) and got["q2"][1:] == (0, 0, 0, 0, 0, 0.0, 0.0, 0.0)
    total = ev.total_groundedness(ev.groundedness(queries, ranked, evidence, 3)).first()
    assert (total["expected_evidence"], total["highlight_recall"]) == (2, 0.5)
    sizes = spark.createDataFrame([("a", 10), ("b", 5), ("c", 6)], "path string, bytes bigint")
    tokens = {r["query_id"]: r for r in ev.token_efficiency(queries, ranked, evidence, sizes, 2).collect()}
    assert tokens["q1"][1:] == (15, 3, 0.2, 4, 1) and tokens["q2"]["density"] == 0.0
    assert ev.total_token_efficiency(ev.token_efficiency(queries, ranked, evidence, sizes, 2)).first()["returned_bytes"] == 15
    assert len(ev.report(queries, ranked, tables[2], evidence, sizes, 2)) == 7


def test_delta_and_gate(spark, tables):
    each = ev.per_query(*tables, 3)
    same = ev.report_delta(each, each)
    assert same.where("delta <> 0").count() == 0 and same.count() == 15
    ev.gate(same)
    worse = ev.report_delta(each, ev.per_query(tables[0], tables[1].where("rank > 1"), tables[2], 3))
    with pytest.raises(ev.RegressionError, match="q1"):
        ev.gate(worse)
    ev.gate(worse, 1.0)
    assert ev.regressions(worse).where("metric = 'precision_at_k'").count() == 0


def test_preferences(spark):
    judged = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 2), ("r", "d", 1)], "query_id string, path string, relevance int")
    got = sorted((r["preferred_doc"], r["dispreferred_doc"]) for r in features.pairwise_preferences(judged).collect())
    assert got == [("a", "b"), ("a", "c")]
