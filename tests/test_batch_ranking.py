"""First documents of many queries by blocks, against the join of all postings."""

import random

import pytest
from loomsearch.operators import batch_ranking, index, query, ranking
from loomsearch.plans import judged
from pyspark.sql import functions as F


@pytest.mark.parametrize("score", [ranking.bm25, ranking.tfidf])
def test_first_documents_of_blocks(spark, monkeypatch, score):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 120))) for _ in range(400)]
    texts += texts[:60] + ["", None]  # ties
    docs = spark.createDataFrame([(7 * i % 997, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    queries = [(f"q{i}", " ".join(rng.choices(words, k=rng.randint(1, 20)))) for i in range(40)] + [("none", "unseen"), ("void", "")]
    terms = query.query_terms(spark.createDataFrame(queries, "query_id string, query string"))
    posts, lengths = index.query_postings(docs, "doc_id", terms)
    want = ranking.top_k(score(terms, posts, ranking.Stats(lengths)).withColumn("score", F.round("score", 6)), 5).select("query_id", "rank", "doc_id", "score")
    want = sorted(map(tuple, want.collect()))
    for documents, held in ((1 << 15, 1 << 21), (50, 100)):
        monkeypatch.setattr(batch_ranking, "DOCUMENTS", documents)
        monkeypatch.setattr(batch_ranking, "TERMS", held)
        found = batch_ranking.Packed(docs, "doc_id", terms).first(5, score)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == want


def test_halves_round_up():
    assert list(batch_ranking.rounded(batch_ranking.np.array([0.0000005, 2.5000005, 1.25]))) == [1, 2500001, 1250000]


def test_documents_that_hold_an_item(spark, tmp_path):
    items = [(1, "one two three four"), (2, "x"), (3, "é"), (4, None), (5, "two three")]
    texts = ["zero\none two three fourth", "no\n\nx here", "café", None, "", "two three one two three four"]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = judged._held(spark, str(tmp_path))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(d, str(q), 1 + t[: t.find(i)].count("\n")) for d, t in enumerate(texts) for q, i in items if t is not None and i is not None and i in t]
    assert sorted(map(tuple, got.select("doc_id", "query_id", "start_line").collect())) == sorted(want)
