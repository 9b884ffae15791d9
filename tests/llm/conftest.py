import pytest

CLASHES = ["set", "group", "block", "bucket", "template", "rank", "_id", "grams", "line_no", "tokens", "tmp", "log_ratio", "url_key"]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from `(doc_id, text)` rows, with the columns of the table and others whose names may clash."""

    def make(rows):
        full = [(i, t, "en", None, len(t) if t is not None else None, *["x"] * len(CLASHES)) for i, t in rows]
        extra = "".join(f", `{c}` string" for c in CLASHES)
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint" + extra)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and blank texts, repeated rows, an id with two texts, and a long text."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    return [(None, "a text without id"), (901, None), (902, ""), (903, " \n\t "), (904, "one"), (904, "one"), (905, "first text of an id"), (905, "another text of it"), (906, long), (None, None)]
