"""Positions and identifier parts of whole documents, against brute force."""

import re

from loomsearch.plans import lexical


def stream(lexeme):
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", lexeme)]
    return list(dict.fromkeys([lexeme.lower(), "".join(parts), *parts]))


def test_whole_documents(spark, tmp_path):
    rows = [(1, "getUserName calls get_user_name2, not HTTPServer.\nThe end of getUserName"), (2, "plain words only"), (3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    parts, places = [], {}
    for d, t in rows:
        at = 0
        for n, lexeme in enumerate(re.findall("[A-Za-z0-9_-]+", t or "")):
            for i, token in enumerate(stream(lexeme)):
                parts.append((d, n, lexeme, i, token))
                places.setdefault((token, d), []).append(at)
                at += 1
    assert sorted(map(tuple, lexical.QUERIES["ident_split"](spark, str(tmp_path)).collect())) == sorted(parts)
    got = sorted(map(tuple, lexical.QUERIES["positional_postings"](spark, str(tmp_path)).collect()))
    assert got == sorted((t, d, len(p), " ".join(map(str, p))) for (t, d), p in places.items())
