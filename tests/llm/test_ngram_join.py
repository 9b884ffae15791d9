import random
import re
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomsearch.llm import _pairs, ngram_join


def gram_set(text, n=3):
    w = re.findall("[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_sets(rows):
    by_set = {}
    for i, text in rows:
        if i is not None and gram_set(text):
            by_set.setdefault(gram_set(text), set()).add(i)
    return by_set


def brute(rows, t=0.6):
    by_set = brute_sets(rows)
    sets = list(by_set)
    lead = list(range(len(sets)))
    near = [{} for _ in sets]
    for i, a in enumerate(sets):
        for k, b in enumerate(sets):
            j = len(a & b) / len(a | b)
            if i != k and j >= t - 1e-9:
                near[i][k] = round(j, 6)
                low, high = sorted([lead[i], lead[k]])
                lead = [low if x == high else x for x in lead]
    out = []
    for i, s in enumerate(sets):
        own = by_set[s]
        if len(own) > 1 or near[i]:
            first = min(min(by_set[sets[k]]) for k in range(len(sets)) if lead[k] == lead[i])
            links = len(own) - 1 + sum(len(by_set[sets[k]]) for k in near[i])
            out += [(d, first, len(own) - 1, links, 1.0 if len(own) > 1 else max(near[i].values())) for d in own]
    return sorted(out)


def some_rows(seed=3):
    r = random.Random(seed)
    base = [" ".join(f"t{r.randrange(400)}" for _ in range(r.randrange(1, 90))) for _ in range(40)]
    rows = []
    for i in range(160):
        words = r.choice(base).split()
        for _ in range(r.randrange(0, 8)):
            words[r.randrange(len(words))] = f"t{r.randrange(400)}"
        rows.append((i, " ".join(words)))
    return rows


def found(df):
    return sorted((r["doc_id"], r["class_id"], r["copies"], r["links"], r["nearest"]) for r in df.collect())


@pytest.mark.parametrize("t", [0.6, 1.0])
def test_equals_brute_force(docs_of, odd_rows, t):
    rows = some_rows() + odd_rows
    assert found(ngram_join.jaccard_join(docs_of(rows), t)) == brute(rows, t)


def test_parts_of_large_components(docs_of, monkeypatch):
    rows = some_rows(5)
    monkeypatch.setattr(ngram_join, "PART_SETS", 3)
    assert found(ngram_join.jaccard_join(docs_of(rows))) == brute(rows)


def test_small_filter_lets_more_pass(docs_of, monkeypatch):
    rows = some_rows(6)
    plain = ngram_join.wanted_filter
    monkeypatch.setattr(ngram_join, "wanted_filter", lambda w: plain(w, most=10))
    assert found(ngram_join.jaccard_join(docs_of(rows))) == brute(rows)


def test_empty_table(docs_of):
    assert found(ngram_join.jaccard_join(docs_of([]))) == []
    assert ngram_join.drop_near_duplicates(docs_of([])).count() == 0


def test_bad_threshold(docs_of):
    with pytest.raises(ValueError):
        ngram_join.jaccard_join(docs_of([]), 0)


def test_one_document_of_each_group_stays(docs_of, odd_rows):
    rows = some_rows(7) + odd_rows
    lost = {d for d, first, *_ in brute(rows) if d != first}
    kept = ngram_join.drop_near_duplicates(docs_of(rows))
    expected = [(i, t) for i, t in rows if i not in lost]
    assert lost
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in kept.collect()])) == sorted(map(str, expected))
    assert kept.columns == docs_of([]).columns


def test_many_buckets(docs_of, monkeypatch):
    rows = some_rows(8)
    monkeypatch.setattr(ngram_join, "TOKENS", 200)
    assert found(ngram_join.jaccard_join(docs_of(rows))) == brute(rows)


def test_texts_of_over_a_million_grams(docs_of):
    r = random.Random(9)
    words = [f"{r.randrange(1 << 40):x}" for _ in range(1_100_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:700_000])), (3, " ".join(words[:500_000])), (4, "of other words")]
    got = found(ngram_join.jaccard_join(docs_of(rows)))
    assert [(d, c, n, k) for d, c, n, k, _ in got] == [(1, 1, 0, 1), (2, 1, 0, 2), (3, 1, 0, 1)]
    assert [x[4] for x in got] == [0.636363, 0.714285, 0.714285]


def test_components_by_rounds_and_at_once(spark):
    r = random.Random(1)
    edges = spark.createDataFrame([(r.randrange(300), r.randrange(300)) for _ in range(220)], "a bigint, b bigint")
    nodes = spark.range(300).withColumnRenamed("id", "node")
    both = [sorted(map(tuple, ngram_join.components(edges, nodes, m).collect())) for m in (0, 1 << 22)]
    assert both[0] == both[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=80))
def test_packed_pairs_round_trip(items):
    pairs = {(min(a, b), max(a, b)): n for a, b, n in items if a != b}
    if pairs:
        a, b = map(np.array, zip(*sorted(pairs)))
        n = np.array([pairs[p] for p in sorted(pairs)])
        keys = np.arange(41) * 7919
        k, z, x, y, c, p = _pairs.unpack_pairs(_pairs.pack_pairs(keys, keys % 17, a, b, n, n % 2))
        assert (z == k % 17).all()
        assert (k[x] == keys[a]).all() and (k[y] == keys[b]).all() and (c == n).all() and (p == n % 2).all()


def test_packed_tokens_round_trip():
    packer = _pairs.Packer([0, 1, 2], placed=True)
    r = np.random.default_rng(3)
    given_ = {i: r.integers(0, 1 << 63, r.integers(1, 60)).astype(np.uint64) for i in range(40)}
    for k, t in given_.items():
        packer.add(k, t, k * 5)
    seen = set()
    for batch in packer.flush():
        keys, sizes, own, tok, places = _pairs._unpack(batch.column(1)[0].as_py(), True)
        assert (sizes == keys * 5).all()
        seen |= {(int(keys[o]), int(t), int(p)) for o, t, p in zip(own, tok, places)}
    assert seen == {(k, int(x) & (1 << 40) - 1, i) for k, t in given_.items() for i, x in enumerate(t)}


def test_clusters_linked_beforehand(docs_of, odd_rows, monkeypatch):
    """Labels of all clusters, and of some groups of them only, spare pairs and change no result."""
    rows = some_rows(8) + odd_rows
    monkeypatch.setattr(ngram_join, "LARGE", 2)
    for most in (1 << 22, 30):
        monkeypatch.setattr(ngram_join, "LABELLED", most)
        assert found(ngram_join.jaccard_join(docs_of(rows))) == brute(rows)


def test_memory_of_a_large_cluster():
    """5,000 keys share two tokens: 12.5 million pairs aren't held at once, and with one label not made."""
    packer = _pairs.Packer([0], placed=True)
    for key in range(5_000):
        packer.add(key, np.arange(2, dtype=np.uint64), 2)
    batches = list(packer.flush())

    class Labels:
        value = np.arange(5_000), np.zeros(5_000, np.int64)

    always = lambda x, y, i, j: np.ones(len(x), bool)
    assert not list(_pairs._count([0], 0.6, always, Labels)(iter(batches)))
    tracemalloc.start()
    pairs = [len(_pairs.unpack_pairs(b.column(1)[0].as_py())[2]) for b in _pairs._count([0], 0.6, always, None)(iter(batches))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(pairs) >= 5_000 * 4_999 // 2
    assert peak < 600e6
