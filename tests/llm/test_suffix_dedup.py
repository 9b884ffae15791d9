import random

import numpy as np
import pytest

from loomsearch.llm import suffix_dedup
from tests.llm.test_decontam import WORD


def brute(rows, length):
    wins, words = {}, {}
    for d, t in rows:
        if d is not None and t is not None:
            w = tuple(WORD.findall(t.lower()))
            words.setdefault((d, w), None)
            for i in range(len(w) - length + 1):
                wins.setdefault(w[i : i + length], set()).add(d)
    out = set()
    for d, w in words:
        hit = [i for i in range(len(w) - length + 1) if len(wins[w[i : i + length]]) > 1]
        k = 0
        while k < len(hit):
            e = k
            while e + 1 < len(hit) and hit[e + 1] <= hit[e] + length:
                e += 1
            out.add((d, hit[k], hit[e] + length))
            k = e + 1
    return sorted(out)


def some_rows(seed, length):
    r = random.Random(seed)
    vocabulary = ["a", "b", "c", "d", "é"]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    shared = [some(r.randrange(length - 2, 3 * length)) for _ in range(8)] + [["a"] * (2 * length)]
    return [(i, " ".join(w for _ in range(r.randrange(1, 4)) for w in r.choice([some(r.randrange(1, 20)), r.choice(shared)]))) for i in range(60)]


@pytest.mark.parametrize("length, k", [(12, 5), (6, 6), (9, 1)])
def test_equals_brute_force(docs_of, odd_rows, length, k):
    rows = some_rows(length, length) + odd_rows + [(1000, odd_rows[8][1])]
    got = sorted(tuple(r) for r in suffix_dedup.repeated_spans(docs_of(rows), length, k).collect())
    assert got == brute(rows, length) and len(got) > 30


def test_small_groups_of_contexts(docs_of):
    rows = some_rows(9, 8)
    got = sorted(tuple(r) for r in suffix_dedup.repeated_spans(docs_of(rows), 8, 4, most=40).collect())
    assert got == brute(rows, 8)


def test_suffix_order(tmp_path, monkeypatch):
    """The file holds all suffixes in order, with common prefixes, whatever the size of its parts."""
    monkeypatch.setattr(suffix_dedup, "STEP", 7)
    r = np.random.default_rng(1)
    contexts = r.integers(1, 4, (20, 15)).astype(np.uint32)
    sizes = r.integers(1, 16, 20)
    files = suffix_dedup.Files(f"file://{tmp_path}")
    suffix_dedup.build(contexts, sizes, 5, files)
    got = np.concatenate(list(files.read()))
    suffixes = [tuple(contexts[x["context"], x["column"] : sizes[x["context"]]].tolist()) for x in got]
    assert suffixes == sorted(suffixes) and len(suffixes) == sizes.sum()
    for a, b, x in zip(suffixes, suffixes[1:], got[1:]):
        common = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        assert x["lcp"] == min(common, 5)
    files.close()


def test_empty_and_bad_sizes(docs_of):
    assert suffix_dedup.repeated_spans(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(docs_of([]), 200, 10)
