"""Passes over whole texts in Python, against the columns that do the same."""

import random

from loomsearch.functions import analysis, stop_words, text
from loomsearch.operators import fields, index, query
from loomsearch.operators import regex_search as rx
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lexemes():
    rng = random.Random(3)
    return ["".join(rng.choices("abRSt19_-", k=rng.randint(1, 9))) for _ in range(3000)] + ["running", "the", "HTTPServer", "get_user-Name2", "_", "-", "__", "a_-"]


def test_analysers_agree(spark):
    words = lexemes()
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, text string")
    code = df.select("i", text.identifier_stream(F.col("text")).alias("x"))
    assert [list(analysis.identifier_stream(w)) for w in words] == [r["x"] for r in code.orderBy("i").collect()]
    prose = index.with_prose_tokens(df, F.col("text"), "x").orderBy("i").collect()
    of = analysis.prose_stream(stop_words.ENGLISH)
    assert [list(of(w)) for w in words] == [r["x"] for r in prose]


def test_kept_lexemes_are_bounded():
    kept = analysis.Kept(str.lower, 3)
    assert [kept[w] for w in ("A", "B", "C", "D", "A")] == ["a", "b", "c", "d", "a"] and len(kept) == 2


def test_postings_without_shuffle(spark):
    docs = spark.createDataFrame([(1, "alpha betaGamma alpha"), (2, ""), (3, None), (4, "gamma beta gamma beta")], "doc_id int, text string")
    made = [index.postings(docs, "doc_id"), index.prose_postings(docs, "doc_id"), index.ngram_postings(docs, "doc_id", 2)]
    assert not any("Exchange" in plan(df) for df in made)
    again = docs.unionByName(docs)
    for once, twice in zip(made, (index.postings(again, "doc_id"), index.prose_postings(again, "doc_id"), index.ngram_postings(again, "doc_id", 2))):
        assert sorted((a, b, 2 * n) for a, b, n in once.collect()) == sorted(map(tuple, twice.collect()))
    assert (4, "gamma beta", 2) in set(map(tuple, made[2].collect()))


def test_norms_of_texts(spark, monkeypatch):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefghij", weights=range(1, 11), k=rng.randint(0, 9)))) for i in range(60)] + [(60, None)], "doc_id int, text string")
    rounded = lambda df: sorted((r[0], round(r[1], 9)) for r in df.collect())
    for df in (docs, docs.unionByName(docs.limit(5))):
        want = rounded(index.doc_norms(index.postings(df, "doc_id"), index.doc_lengths(df, "doc_id"), "doc_id"))
        for most in (1, 4, 100):
            monkeypatch.setattr(index, "FREQUENT", most)
            assert rounded(index.text_norms(df, "doc_id")) == want
        some = docs.where("doc_id < 7")
        assert rounded(index.text_norms(df, "doc_id", only=some)) == [r for r in want if r[0] < 7]


def test_gram_counts_and_masks(spark, monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choices("abcé😀\n", k=rng.randint(0, 40))) for _ in range(50)] + ["", "a", None, "aaaa", "x" * 300]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body string").repartition(3)
    monkeypatch.setattr(rx, "CHARACTERS", 100)
    found = {r["kind"]: (r["grams"], r["postings"]) for r in rx.gram_counts(docs, "body").collect()}
    sparse = [(g, i) for i, t in enumerate(texts) for g in rx.sparse_ngrams(t or "")]
    classic = [(g, i) for i, t in enumerate(texts) for g in {(t or "")[k : k + 3] for k in range(len(t or "") - 2)}]
    assert found == {k: (len({g for g, _ in x}), len(x)) for k, x in (("classic", classic), ("sparse", sparse))}
    assert sorted(map(tuple, rx.sparse_postings(docs, "id", "body").collect())) == sorted(sparse)
    some = sorted({g for g, _ in sparse})[::5]
    few = rx.sparse_postings(docs, "id", "body", some)
    assert "Python" not in plan(few) and "InArrow" not in plan(few)
    assert sorted(map(tuple, few.collect())) == sorted((g, i) for g, i in sparse if g in some)
    grams = sorted({g for g, _ in classic})[::4]
    masks = rx.trigram_masks(docs, "id", "body", grams)
    assert "Exchange hashpartitioning" not in plan(masks) and "posexplode" not in plan(masks)
    every = rx.trigram_masks(docs, "id", "body").where(F.col("gram").isin(*grams))
    assert sorted(map(tuple, masks.collect())) == sorted(map(tuple, every.collect()))


def test_postings_of_base_fields(spark):
    rng = random.Random(13)
    rows = [(i, rng.choice(["src/mainApp.rs", "a/b/READ_ME", "x.tar.gz", "", "https://m.example.net/en/25#top"]), " ".join(rng.sample(lexemes(), 30))) for i in range(40)]
    docs = spark.createDataFrame([*rows, (40, None, None), (41, "a b/c.d\n", "  "), (42, "p/q.py", "plain words")], "id int, path string, body string")
    terms = query.query_terms(spark.createDataFrame([("q1", "main app rs example ab r s 1 plain")], "query_id string, query string"))
    made = fields.query_base_postings(docs, "id", "path", "body", terms)
    want = index.query_field_postings(fields.field_tokens(fields.base_fields(docs, "id", "path", "body")), terms)
    assert "regexp_extract_all" in plan(want[0]) and "regexp_extract_all" not in plan(made[0])
    for a, b in zip(made, want):
        assert sorted(map(tuple, a.select(*sorted(a.columns)).collect())) == sorted(map(tuple, b.select(*sorted(b.columns)).collect()))
