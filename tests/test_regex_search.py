"""Pattern planning and search."""

import random
import re

import pytest

from loomsearch.operators import regex_search as rx

DOCS = ["abc.def xyz", "abcd needle", "needle needle\nneedles", "nothing", "", "MAX_FILE_SIZE = 1", "ünïcode needle é"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)] + [(99, None)], "id bigint, body string").persist()


@pytest.mark.parametrize(
    "pattern, planned",
    [
        (r"abc\.def", rx.And((".de", "abc", "bc.", "c.d", "def"))),
        ("ab[c]def", rx.And(("abc", "bcd", "cde", "def"))),
        ("abc[xyz]def", rx.And(("abc", "def"))),
        ("(?i)abc", rx.All()),
        ("ab+cde", rx.And(("cde",))),
        ("abc|def", rx.Or((rx.And(("abc",)), rx.And(("def",))))),
        ("abc|d", rx.All()),
        ("(abc)?xyz", rx.And(("xyz",))),
        (r"\x41bc", rx.And(("Abc",))),
        ("a.c", rx.All()),
    ],
)
def test_plans(pattern, planned):
    assert rx.plan(pattern) == planned


@pytest.mark.parametrize("pattern", ["(", r"(a)\1", "(?=a)b", "(?<!a)b"])
def test_rejected(pattern):
    with pytest.raises(ValueError):
        rx.plan(pattern)


def test_plans_never_ask_too_much():
    r = random.Random(5)
    atoms = ["a", "b", "c", "ab", "bc", "[ab]", "[c]", ".", "(ab)", "(a|b)", "a+", "b*", "c?", "a{2}", r"\.", "^", "$"]
    for _ in range(400):
        pattern = "".join(r.choice(atoms) for _ in range(r.randrange(1, 7))) + ("|" + "".join(r.choice(atoms) for _ in range(3)) if r.random() < 0.3 else "")
        try:
            planned = rx.plan(pattern)
        except ValueError:
            continue
        fits = lambda p, s: isinstance(p, rx.All) or (all(t in s for t in p.trigrams) if isinstance(p, rx.And) else any(fits(b, s) for b in p.branches))  # noqa: B023, E731
        for _ in range(30):
            s = "".join(r.choice("abc.") for _ in range(r.randrange(0, 12)))
            assert not re.search(pattern, s) or fits(planned, s)


def test_search_equals_full_scan(spark, docs):
    posts = rx.trigram_postings(docs, "id", "body")
    for pattern in ("needle", "needles?", r"[a-z]+\.d", "(?i)max", "abc|needle"):
        want = sorted((i, len(d[: m.start()].encode()), len(d[: m.end()].encode()), m.group()) for i, d in enumerate(DOCS) for m in re.finditer(pattern, d))
        for p in (None, posts, rx.plan_postings(docs, "id", "body", rx.plan(pattern))):
            got = rx.search_regex(docs, "id", "body", pattern, p).select("doc_id", "byte_start", "byte_end", "matched_text")
            assert sorted(map(tuple, got.collect())) == want


def test_literals(spark, docs):
    posts = rx.trigram_postings(docs, "id", "body")
    got = sorted(map(tuple, rx.search_literal(docs, "id", "body", "needle", posts).collect()))
    assert got[1:4] == [(2, 0, 6, 1, 1, "needle"), (2, 7, 13, 1, 1, "needle"), (2, 14, 20, 2, 2, "needle")]
    assert rx.search_literal(docs, "id", "body", "").count() == 0
    assert rx.search_literal(docs, "id", "body", "é", posts).count() == 1


def test_line_range_counts_breaks_before_the_end():
    assert rx.line_range(b"a\nb\n", 2, 4) == (2, 3) and rx.line_range(b"a\nb", 2, 2) == (2, 2)


def test_selection(spark, docs):
    posts, ids = rx.trigram_postings(docs, "id", "body"), docs.selectExpr("id AS doc_id")
    missing = rx.select(rx.literal_plan("needlz"), posts, ids)
    assert (missing.candidates.count(), missing.full_scan) == (0, False)
    full = rx.select(rx.literal_plan("ab"), posts, ids)
    assert full.full_scan and full.candidates.count() == len(DOCS) + 1
    some = rx.select(rx.literal_plan("abc.def"), posts, ids)
    assert {r[0] for r in some.candidates.collect()} == {0} and len(some.trigrams) <= rx.MOST_TRIGRAMS
    assert some.diagnostics().first()["candidate_count"] == 1


def test_masks_and_sparse_grams_hold_all_matches(spark, docs):
    ids = docs.selectExpr("id AS doc_id")
    for literal in ("needle", "abcd", "MAX_FILE_SIZE"):
        want = {i for i, d in enumerate(DOCS) if literal in d}
        masked = {r[0] for r in rx.masked_candidates(rx.trigram_masks(docs, "id", "body"), ids, literal).collect()}
        thin = {r[0] for r in rx.sparse_candidates(rx.sparse_postings(docs, "id", "body"), ids, literal).collect()}
        assert want <= masked and want <= thin and len(masked) < len(DOCS)
    assert rx.sparse_covering("MAX_FILE_SIZE") == ["E_S", "ILE", "MAX", "SIZ", "X_FI", "ZE"]


def test_sparse_grams_by_definition():
    r = random.Random(2)
    for _ in range(60):
        s = "".join(r.choice("abcdef_X") for _ in range(r.randrange(0, 25)))
        w = rx.pair_weights(s)
        want = {s[i : j + 2] for i in range(len(w)) for j in range(i, len(w)) if all(x < min(w[i], w[j]) for x in w[i + 1 : j])}
        assert set(rx.sparse_ngrams(s)) == want and set(rx.sparse_covering(s)) <= want


def test_refresh(spark, docs):
    posts = rx.trigram_postings(docs, "id", "body")
    changed = spark.createDataFrame([(3, "now a needle"), (50, "fresh")], "id bigint, body string")
    removed = spark.createDataFrame([(0, None)], "id bigint, body string")
    after = docs.where("id not in (0, 3)").unionByName(changed)
    got = rx.refresh(posts, changed, removed, "id", "body")
    assert sorted(map(tuple, got.select("gram", "doc_id").collect())) == sorted(map(tuple, rx.trigram_postings(after, "id", "body").select("gram", "doc_id").collect()))
