"""Tokeniser, stemmer and small string functions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomsearch.functions import stop_words, text
from loomsearch.functions.stemmer import stem


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


STREAMS = {
    "HTTPSConnection": ["httpsconnection", "https", "connection"],
    "camelCase": ["camelcase", "camel", "case"],
    "doc_reader": ["doc_reader", "docreader", "doc", "reader"],
    "parse2Json": ["parse2json", "parse", "2", "json"],
    "BM25Score": ["bm25score", "bm", "25", "score"],
    "query-id": ["query-id", "queryid", "query", "id"],
    "plain": ["plain"],
    "ABC": ["abc"],
    "__": ["__", "_"],
    "x__": ["x__", "x_", "x", "_"],
    "a_": ["a_", "a"],
}


def test_identifier_streams(spark):
    assert column(spark, list(STREAMS), text.identifier_stream) == list(STREAMS.values())


def slow_parts(s):
    """Cuts between neighbours, one at a time."""
    body = re.sub("[_-]+$", "", s)
    out, part = [], ""
    for i, c in enumerate(body):
        b, n = body[i - 1 : i], body[i + 1 : i + 2]
        cut = b and (b.islower() and c.isupper() or b.isupper() and c.isupper() and n.islower() or b.isalpha() and c.isdigit() or b.isdigit() and c.isalpha())
        if c in "_-" or cut:
            out.append(part)
            part = ""
        part += "" if c in "_-" else c
    return [p.lower() for p in [*out, part] if p] + ([s[-1]] if re.search("[_-]{2,}$|^[_-]$", s) else [])


def test_parts_of_random_lexemes(spark):
    import random

    r = random.Random(1)
    lexemes = ["".join(r.choice("abABC12_-") for _ in range(r.randrange(1, 9))) for _ in range(3000)]
    assert column(spark, lexemes, text.identifier_parts) == [slow_parts(s) for s in lexemes]


def test_code_and_prose_tokens(spark):
    code = column(spark, ["the running parser", "é été x", None, ""], text.code_tokens)
    assert code == [["the", "running", "parser"], ["t", "x"], [], []]
    prose = lambda c: F.flatten(text.prose_pieces(c, stop_words.ENGLISH))
    (got,) = column(spark, ["the runningParser over"], prose)
    assert [(r["term"], r["stem"]) for r in got] == [("runningparser", False), ("runningparser", False), ("running", True), ("parser", True)]


def test_word_ngrams(spark):
    grams = lambda n: lambda c: text.word_ngrams(text.code_tokens(c), n)
    assert column(spark, ["the quick brown fox", "one", None], grams(2)) == [["the quick", "quick brown", "brown fox"], [], []]
    with pytest.raises(ValueError):
        text.word_ngrams(F.col("x"), 0)


@pytest.mark.parametrize("word, root", [("running", "run"), ("jumps", "jump"), ("lazy", "lazi"), ("parser", "parser"), ("generalizations", "general"), ("hopping", "hop"), ("caresses", "caress"), ("agreed", "agre"), ("relational", "relat"), ("happy", "happi"), ("cats", "cat"), ("a", "a")])
def test_stems(word, root):
    assert stem(word) == root


@settings(max_examples=200, deadline=None)
@given(st.text("abcdefgilnorstuy'", min_size=0, max_size=14))
def test_stemmer_takes_any_word(word):
    assert len(stem(word)) <= len(word) + 1


def test_paths(spark):
    paths = ["src/a.rs", "Makefile", "x/.gitignore", "b.test.TS", "c.tsx", "noext", "a/Cargo.toml"]
    assert column(spark, paths, text.file_name)[0] == "a.rs"
    assert column(spark, paths, text.extension) == ["rs", "", "", "TS", "tsx", "", "toml"]
    assert column(spark, paths, text.file_type) == ["rust", "shell", "unknown", "unknown", "typescript", "unknown", "toml"]


def test_trigrams_keep_supplementary_characters(spark):
    grams = lambda c: text.trigrams(F.filter(F.split(c, ""), lambda x: x != ""))
    assert column(spark, ["a😀bc", "ab", ""], grams) == [["a😀b", "😀bc"], [], []]


def test_small_functions(spark):
    row = spark.range(1).select(
        text.estimated_tokens(F.lit(9)).alias("a"), text.safe_ratio(F.lit(1), F.lit(0)).alias("b"), text.human_bytes(F.lit(1536)).alias("c"), text.query_display(F.array(F.lit("b"), F.lit("a"))).alias("d"),
        text.contains_normalized(F.lit("src/Query.rs"), F.lit(" query ")).alias("e"), text.contains_normalized(F.lit("x"), F.lit(" ")).alias("f"), text.line_at(F.lit("a\nb\nc"), F.lit(4)).alias("g"),
    ).first()
    assert tuple(row) == (3, 0.0, "1.5 KiB", "a b", 1.0, 0.0, 3)
