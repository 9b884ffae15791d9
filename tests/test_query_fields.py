"""Query understanding, fields and static quality."""

import pytest
from pyspark.sql import functions as F

from loomsearch.operators import fields, quality, query

INTENTS = {
    "cargo.toml settings": "config", "a=b": "config", "key:value": "config", "src/main.rs": "path", "../up": "path", "lib.rs": "path", 'say "exact words"': "error_message",
    "thread panic in worker": "error_message", "why does f() give nil for this input": "error_message", "parse_query": "identifier", "parseQuery": "identifier", "parser": "natural_language",
    "how does ranking work": "natural_language", "": "natural_language",
}


def test_intents(spark):
    df = spark.createDataFrame(list(INTENTS.items()), "q string, want string")
    assert df.where(query.intent(F.col("q")) != F.col("want")).collect() == []


def test_terms_phrases_and_expansion(spark):
    q = query.queries_of(spark, ['auth auth db "mean average" "one"', "src/auth.rs"])
    terms = query.query_terms(q)
    got = {(r["query_id"], r["term"]): (r["frequency"], r["weight"]) for r in terms.collect()}
    assert got["q1", "auth"] == (2, 2.0) and got["q1", "mean"] == (1, 1.0)
    assert [tuple(r) for r in query.phrases(q).orderBy("offset").collect()] == [("q1", 0, 2, 0, "mean"), ("q1", 0, 2, 1, "average")]
    wide = {(r["query_id"], r["term"]): (r["weight"], r["provenance"]) for r in query.expanded_terms(q, terms).collect()}
    assert wide["q1", "authorization"] == (0.35, "controlled_expansion") and ("q2", "authorization") not in wide


def test_merge_keeps_provenance(spark):
    terms = query.terms_from_weights(spark, {"a": 1.0, "z": -1.0})
    added = spark.createDataFrame([("q1", "a", 0.5, "feedback"), ("q1", "b", 0.2, "feedback")], "query_id string, term string, weight double, provenance string")
    assert sorted((r["term"], r["frequency"], r["weight"], r["provenance"]) for r in query.merge_terms(terms, added).collect()) == [("a", 1, 1.5, "original"), ("b", 1, 0.2, "feedback")]


def test_base_fields(spark):
    df = spark.createDataFrame([(1, "src/query-id.py", "plain camelCase x1"), (2, "noext", None)], "id bigint, p string, c string")
    got = {(r["doc_id"], r["field"]): r["text"] for r in fields.base_fields(df, "id", "p", "c").collect()}
    assert got == {(1, "filename"): "query-id.py", (1, "path"): "src/query-id.py", (1, "extension"): "py", (1, "content"): "plain camelCase x1", (1, "identifiers"): "camelCase x1", (2, "filename"): "noext", (2, "path"): "noext"}


def test_heuristics():
    code = 'a = 1 // slashes\nb # hash // more\n/* over\nlines */ c\nd /* open\nend'
    assert fields.heuristic_comments(code) == ["/ slashes", " hash // more", " over\nlines ", " open\nend\n"]
    assert fields.heuristic_strings("x = \"a\\\"b\" + 'c' + `d` + \"open") == ['a"b', "c", "d"]


def by_field(kind, content):
    out = {}
    for f, t, a, b in fields.syntax_captures(kind, content):
        assert content.encode()[a:b].decode() == t
        out.setdefault(f, []).append(t)
    return out


def test_syntax():
    assert by_field("python", 'import os\n# é note\nclass A:\n    def f(self):\n        return "s"\n') == {"imports": ["import os"], "comments": ["# é note"], "symbols": ["A", "f"], "string_literals": ['"s"']}
    assert by_field("rust", 'use a::b;\n// c fn no() {}\nstruct S;\nimpl S { fn go() { let x = "é"; } }') == {"imports": ["use a::b;"], "comments": ["// c fn no() {}"], "symbols": ["S", "S", "go"], "string_literals": ['"é"']}
    assert by_field("go", 'package a\nimport "fmt"\nfunc (r *T) Run() {}\ntype T struct{}')["symbols"] == ["Run", "T"]
    assert by_field("javascript", "import x from 'y';\nfunction f() {}\nclass C {\n  m() {}\n}")["symbols"] == ["f", "C", "m"]
    assert by_field("typescript", "interface I {}\ntype T = string;\nenum E {A}")["symbols"] == ["I", "T", "E"]
    md = by_field("markdown", "---\ntitle: x\n---\n# Head\n```py\ncode\n```\n")
    assert md == {"frontmatter": ["title: x"], "symbols": ["Head"], "string_literals": ["```py\ncode\n```"]}
    assert fields.syntax_captures("python", "def (") is None and fields.syntax_captures("toml", "a = 1") is None
    with pytest.raises(ValueError):
        fields.compile_syntax("toml")


def test_parsed_fields_fall_back(spark):
    df = spark.createDataFrame([(1, "a.py", "def ("), (2, "b.toml", "# note"), (3, "c.py", None)], "id bigint, p string, c string")
    got = [(r["doc_id"], r["field"], r["text"]) for r in fields.parsed_fields(df, "id", "p", "c").collect()]
    assert got == [(2, "comments", " note")]


QUALITY = {
    "src/lib.rs": ("pub mod a;\nuse b;", {"entry_point": True, "public_entry_point": True, "reference_count": 2, "file_depth": 1}, 0.28 + 0.12 + 0.10 + 0.03),
    "vendor/generated/client.rs": ("x", {"vendor": True, "generated": True, "file_depth": 2}, -0.45 - 0.55 + 0.04),
    "README.md": ("hi", {"readme": True, "config_or_manifest": True}, 0.22 + 0.20 + 0.10),
    "a/b/c/d/e/f/tests/test_x.py": ("import os", {"test": True, "file_depth": 7}, -0.08 - 0.08 + 0.015),
}


def test_quality(spark):
    df = spark.createDataFrame([(p, c) for p, (c, *_) in QUALITY.items()], "path string, content string")
    for r in quality.with_quality(df, "path", "content").collect():
        _, wanted, prior = QUALITY[r["path"]]
        assert {k: r[k] for k in wanted} == wanted and r["static_prior"] == pytest.approx(prior)
