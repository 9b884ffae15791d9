"""Index statistics and scorers on small postings."""

import math

import pytest
from pyspark.sql import functions as F

from loomsearch.functions import text
from loomsearch.operators import explain, feedback, fields, index, postings_codec, query, ranking
from loomsearch.plans import registry


def corpus(spark, docs):
    """Postings and statistics of `{id: {term: frequency}}`."""
    posts = spark.createDataFrame([(d, t, n) for d, ts in docs.items() for t, n in ts.items()], "doc_id string, term string, tf bigint")
    lengths = spark.createDataFrame([(d, sum(ts.values())) for d, ts in docs.items()], "doc_id string, length bigint")
    return posts, ranking.Stats(lengths)


def scores(df):
    return {r["doc_id"]: r["score"] for r in df.collect()}


def test_bm25_prefers_frequent_and_rare_terms(spark):
    posts, stats = corpus(spark, {"high": {"rust": 10, "other": 1}, "low": {"rust": 1, "other": 1}})
    got = scores(ranking.bm25(query.terms_from_weights(spark, {"rust": 1}), posts, stats))
    assert got["high"] > got["low"]
    posts, stats = corpus(spark, {"a": {"rare": 1, "common": 1}, "b": {"common": 1}, "c": {"common": 1}})
    got = scores(ranking.bm25(query.terms_from_weights(spark, {"rare": 1, "common": 1, "gone": 0}), posts, stats))
    assert got["a"] > got["b"] == got["c"]


def test_cosine_value(spark):
    posts, stats = corpus(spark, {"a": {"rare": 1, "common": 1}, "b": {"common": 1}})
    norms = index.doc_norms(posts, stats.lengths, "doc_id")
    got = scores(ranking.cosine(query.terms_from_weights(spark, {"rare": 1.0}), posts, stats, norms))
    r, c = math.log(3 / 1.5), math.log(3 / 2.5)
    assert got == {"a": pytest.approx(r / math.hypot(r, c))}


def test_tfidf_prefers_density(spark):
    posts, stats = corpus(spark, {"dense": {"rust": 5, "other": 1}, "sparse": {"rust": 1, "other": 10}})
    got = scores(ranking.tfidf(query.terms_from_weights(spark, {"rust": 1}), posts, stats))
    assert got["dense"] > got["sparse"]


@pytest.mark.parametrize("mu", [1500.0, None])
def test_query_likelihood(spark, mu):
    docs = {"rare": {"rare": 3, "common": 1}, "common": {"common": 6}, "missing": {"other": 4}}
    posts, stats = corpus(spark, docs)
    vocabulary = posts.agg(F.count_distinct("term").alias("vocabulary"))
    for term in ("rare", "common"):
        got = scores(ranking.query_likelihood(query.terms_from_weights(spark, {term: 1.0, "unseen": 1.0}), posts, stats, vocabulary, mu=mu))
        assert max(got, key=got.get) == term and len(got) == 3
    total, cf = 14, 3
    p, q = cf / total, 1 / (total + 3 + 1)
    one = scores(ranking.query_likelihood(query.terms_from_weights(spark, {"rare": 1.0, "unseen": 1.0}), posts, stats, vocabulary, mu=mu))["rare"]
    smooth = (lambda tf, pc: (tf + mu * pc) / (4 + mu)) if mu else (lambda tf, pc: 0.8 * tf / 4 + 0.2 * pc)
    assert one == pytest.approx(math.log(smooth(3, p)) + math.log(smooth(0, q)))


def test_weights_turn_the_order(spark):
    posts, stats = corpus(spark, {"rust": {"rust": 5, "code": 1}, "code": {"rust": 1, "code": 5}})
    for a, b, first in ((4, 1, "rust"), (1, 4, "code")):
        best = ranking.top_k(ranking.bm25(query.terms_from_weights(spark, {"rust": a, "code": b}), posts, stats), 1)
        assert best.first()["doc_id"] == first


def test_corpus_statistics(spark):
    posts, stats = corpus(spark, {"a": {"shared": 2, "only_a": 1}, "b": {"shared": 1, "only_b": 4}})
    assert index.corpus_stats(posts, stats.lengths, "doc_id").select("n_docs", "total_tokens", "vocabulary", "hapax", "avg_length").first() == (2, 8, 3, 1, 4.0)
    posts, stats = corpus(spark, {"a": {"shared": 2, "alpha": 3, "zeta": 1}, "b": {"shared": 2, "beta": 3}})
    assert [tuple(r) for r in index.top_terms(posts, "doc_id", 3).select("term", "cf", "df").collect()] == [("shared", 4, 2), ("alpha", 3, 1), ("beta", 3, 1)]
    empty, none = corpus(spark, {})[0:2]
    assert index.corpus_stats(empty, none.lengths, "doc_id").first()["avg_length"] == 0.0


def positions(spark, docs):
    rows = [(d, "content", p, t) for d, body in docs.items() for p, t in enumerate(body.split())]
    return spark.createDataFrame(rows, "doc_id string, field string, pos int, term string")


def slow_span(body, terms):
    w = body.split()
    spans = [j - i for i in range(len(w)) for j in range(i, len(w)) if terms <= set(w[i : j + 1])]
    return min(spans, default=None)


def test_cover_spans_equal_brute_force(spark):
    import random

    r = random.Random(3)
    docs = {str(i): " ".join(r.choice("abcdef") for _ in range(r.randrange(1, 25))) for i in range(60)}
    for terms in ("ab", "abc", "f"):
        got = {x["doc_id"]: x["span"] for x in ranking.cover_spans(positions(spark, docs), query.terms_from_weights(spark, dict.fromkeys(terms, 1.0))).collect()}
        assert got == {d: s for d, b in docs.items() if (s := slow_span(b, set(terms))) is not None}


def test_many_terms_have_a_span(spark):
    words = [f"w{i}" for i in range(50)]
    got = ranking.cover_spans(positions(spark, {"x": " ".join(words)}), query.terms_from_weights(spark, dict.fromkeys(words, 1.0)))
    assert got.first()["span"] == 49


def test_phrases_and_proximity(spark):
    q = query.queries_of(spark, ['"mean average precision"'])
    pos = positions(spark, {"phrase": "mean average precision", "split": "mean average fn precision", "twice": "mean average precision mean average precision"})
    got = {r["doc_id"]: r["phrase_count"] for r in ranking.phrase_counts(pos, query.phrases(q)).collect()}
    assert got == {"phrase": 1, "twice": 2}
    terms = query.terms_from_weights(spark, dict.fromkeys(["alpha", "beta", "gamma"], 1.0))
    near = ranking.proximity_bonus(positions(spark, {"near": "alpha beta gamma", "far": "alpha f f f f f f beta gamma"}), terms, 4, 10.0)
    assert [(r["doc_id"], r["bonus"]) for r in near.collect()] == [("near", 10.0 * 3 / 4)]
    assert ranking.proximity_bonus(pos, query.terms_from_weights(spark, {"mean": 1.0})).count() == 0


def file_fields(spark, files):
    docs = spark.createDataFrame(list(files.items()), "path string, content string").withColumn("doc_id", F.col("path"))
    return docs, fields.field_tokens(fields.base_fields(docs, "doc_id", "path", "content"))


def bm25f(spark, files, text_):
    docs, tokens = file_fields(spark, files)
    q = query.queries_of(spark, [text_])
    by_field, lengths = index.query_field_postings(tokens, query.query_terms(q))
    n = docs.agg(F.count("*").alias("n"))
    return scores(ranking.bm25f(query.query_terms(q), q.select("query_id", query.intent(F.col("query")).alias("intent")), by_field, lengths, index.field_averages(lengths, n), n))


def test_bm25f_puts_names_first(spark):
    got = bm25f(spark, {"src/inverted_index.rs": "fn unrelated() {}", "src/generic.rs": "inverted index inverted index inverted index"}, "inverted index")
    assert got["src/inverted_index.rs"] > got["src/generic.rs"]


def test_positions_advance_over_compounds(spark):
    body = "// alpha beta gamma\nfn alpha_beta_gamma() {}"
    toks = spark.createDataFrame([("d", "content", body)], "doc_id string, field string, t string").select("doc_id", "field", text.code_tokens(F.col("t")).alias("tokens"))
    got = {r["term"]: r["positions"] for r in index.positional_postings(toks).collect()}
    assert got["alpha"] == [0, 6] and got["alpha_beta_gamma"] == [4]


def test_feedback(spark):
    docs, tokens = file_fields(spark, {"src/auth_repository.rs": "auth", "src/other.rs": "nothing"})
    terms = query.query_terms(query.queries_of(spark, ["auth"]))
    seeds = spark.createDataFrame([("q1", "src/auth_repository.rs")], "query_id string, doc_id string")
    found = feedback.feedback_terms(seeds, index.field_frequencies(tokens), terms)
    rows = {r["term"]: r for r in found.collect()}
    assert "repository" in rows and "auth" not in rows and all(0 < r["weight"] <= 0.45 for r in rows.values())
    wide = {r["term"]: (r["weight"], r["provenance"]) for r in feedback.expanded(terms, found).collect()}
    assert wide["auth"] == (1.0, "original") and wide["repository"][1] == "feedback"


def test_explanation_adds_up(spark):
    posts, stats = corpus(spark, {"a": {"x": 2, "y": 1}, "b": {"y": 3}})
    terms = query.terms_from_weights(spark, {"x": 1.0, "y": 2.0})
    parts = explain.bm25_terms(terms, posts, stats)
    total = {r[0]: r[1] for r in parts.groupBy("doc_id").agg(F.sum("contribution")).collect()}
    assert total == pytest.approx(scores(ranking.bm25(terms, posts, stats)))
    assert {r["contribution"] for r in explain.matched_terms(terms, posts, stats).collect()} == {0.0}


def test_names_of_scorers():
    assert ranking.NAMES["proximity"] == "bm25_proximity" and set(ranking.NAMES.values()) <= set(registry.QUERIES)


def test_posting_codec():
    posts = [(0, 2, [0, 6]), (5, 1, [3]), (300, 1, []), (70_000, 3, [1, 2, 1_000_000])]
    data = postings_codec.encode_postings(posts)
    assert postings_codec.decode_postings(data) == posts
    table = postings_codec.skip_table(data, 2)
    assert [d for d, _ in table] == [0, 300] and postings_codec.decode_number(data, table[1][1])[0] == 295
    for bad in ([(3, 1, []), (3, 1, [])], [(1, 2, [4, 4])]):
        with pytest.raises(ValueError):
            postings_codec.encode_postings(bad)
    for broken in (b"\x80", b"\xff\xff\xff\xff\xff\x01"):
        with pytest.raises(ValueError):
            postings_codec.decode_number(broken)


def test_list_intersection():
    a, b = list(range(0, 1000, 3)), [300, 600, 601, 999, 5000]
    plain, skipping = postings_codec.intersect_lists(a, b), postings_codec.intersect_lists(a, b, skips=True)
    assert plain[0] == skipping[0] == sorted(set(a) & set(b))
    assert skipping[1] < plain[1] or skipping[2] < plain[2]


@pytest.mark.parametrize("mu", [1500.0, None])
def test_first_documents_of_query_likelihood(spark, mu):
    docs = {f"d{i:02d}": {"common": 1 + i % 5, "other": 1 + i % 3, **({"rare": 2} if i % 9 == 0 else {})} for i in range(40)}
    posts, stats = corpus(spark, docs)
    vocabulary = posts.agg(F.count_distinct("term").alias("vocabulary"))
    terms = query.terms_from_weights(spark, {"rare": 1.0, "unseen": 1.0})
    full, few = (ranking.top_k(ranking.query_likelihood(terms, posts, stats, vocabulary, mu=mu, k=k).withColumn("score", F.round("score", 9)), 12).orderBy("rank").collect() for k in (None, 12))
    assert [(r["doc_id"], r["score"]) for r in full] == [(r["doc_id"], r["score"]) for r in few]


def test_many_query_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha betaGamma alpha"), (2, ""), (3, None), (4, "gamma delta_x")], "doc_id int, text string")
    terms = query.terms_from_weights(spark, {"alpha": 1.0, "gamma": 1.0})
    sets = []
    for most in (10, 1):
        monkeypatch.setattr(index, "few_terms", lambda t, most=most, f=index.few_terms: f(t, most))
        posts, lengths = index.query_postings(docs, "doc_id", terms)
        tokens = docs.select("doc_id", F.lit("content").alias("field"), text.code_tokens(F.col("text")).alias("tokens"))
        by, sizes = index.query_field_postings(tokens, terms)
        sets.append([sorted(map(tuple, x.collect())) for x in (posts, lengths, by, sizes)])
    assert sets[0] == sets[1] and sets[0][0] == [(1, "alpha", 2), (1, "gamma", 1), (4, "gamma", 1)] and len(sets[0][1]) == 4


def test_compressed_postings(spark):
    rows = [("a", 3, 2, [0, 6]), ("a", 70_000, 1, [4]), ("b", 5, 1, [1])]
    posts = spark.createDataFrame(rows, "term string, doc bigint, tf bigint, positions array<int>")
    got = {(r["term"], r["part"]): postings_codec.decode_postings(bytes(r["postings"])) for r in postings_codec.compressed(posts).collect()}
    assert got == {("a", 0): [(3, 2, [0, 6])], ("a", 1): [(70_000, 1, [4])], ("b", 0): [(5, 1, [1])]}
    assert postings_codec.position_gaps(posts).where("doc = 3").first()["gaps"] == [0, 6]


def test_any_analyser_will_do(spark):
    docs = spark.createDataFrame([(1, "A-b c")], "doc_id int, text string")
    assert index.token_arrays(docs, "doc_id", "text", lambda c: F.split(c, " ")).first()["tokens"] == ["A-b", "c"]
    by_field = spark.createDataFrame([("x", 1, "content", 2), ("x", 1, "path", 1)], "term string, doc_id int, field string, tf int")
    assert index.assembled_postings(by_field).first()["field_tf"] == {"content": 2, "path": 1}
