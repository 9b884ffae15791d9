import random
import time

import numpy as np
import pytest

from loomsearch.llm import _pairs
from loomsearch.llm import fingerprint as fp


def slow_signature(data, block, most):
    """One byte at a time, chunk by chunk."""
    out, start = [], 0
    for i in range(len(data)):
        last = [data[j] if j >= 0 else 0 for j in range(i - 6, i + 1)]
        total, weighted, shifted = sum(last), sum(c * (k + 1) for k, c in enumerate(last)), 0
        for k, c in enumerate(last):
            shifted ^= c << (5 * (6 - k)) & 0xFFFFFFFF
        if ((total + weighted + shifted) & 0xFFFFFFFF) % block == block - 1 and len(out) < most - 1:
            out.append(data[start : i + 1])
            start = i + 1
    return out + ([data[start:]] if start < len(data) else [])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute(rows, least=50):
    by = {}
    for i, t in rows:
        if i is not None and t and (f := fp.fingerprint(t)):
            f = (f[0], fp.squeezed(f[1]), fp.squeezed(f[2]))
            by.setdefault((*f, t if len(f[1]) < fp.GRAM else None), set()).add(i)

    def score(a, b):
        grams = {a[i : i + fp.GRAM] for i in range(len(a) - fp.GRAM + 1)}
        if not any(b[i : i + fp.GRAM] in grams for i in range(len(b) - fp.GRAM + 1)):
            return -1
        return int(100 * (1 - distance(a, b) / max(len(a), len(b))) + 1e-9)

    keys = list(by)
    lead = list(range(len(keys)))
    near = [{} for _ in keys]
    for i, x in enumerate(keys):
        for k, y in enumerate(keys[:i]):
            sides = [(bx, sx, by_, sy) for bx, sx in ((x[0], x[1]), (2 * x[0], x[2])) for by_, sy in ((y[0], y[1]), (2 * y[0], y[2])) if bx == by_]
            best = max([score(sx, sy) for _, sx, _, sy in sides], default=-1)
            if best >= least:
                near[i][k] = near[k][i] = best
                low, high = sorted([lead[i], lead[k]])
                lead = [low if z == high else z for z in lead]
    out = []
    for i, x in enumerate(keys):
        own = by[x]
        if len(own) > 1 or near[i]:
            first = min(min(by[keys[k]]) for k in range(len(keys)) if lead[k] == lead[i])
            links = len(own) - 1 + sum(len(by[keys[k]]) for k in near[i])
            out += [(d, first, len(own) - 1, links, 100 if len(own) > 1 else max(near[i].values())) for d in own]
    return sorted(out)


def found(df):
    return sorted((x["doc_id"], x["class_id"], x["copies"], x["links"], x["best"]) for x in df.collect())


def test_chunks_are_those_of_the_slow_scan():
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh .,") for _ in range(3000))
    block, sig, sig2 = fp.fingerprint(text)
    assert len(sig) == len(slow_signature(text.encode(), block, fp.LONG))
    assert len(sig2) == len(slow_signature(text.encode(), 2 * block, fp.SHORT))


def test_an_edit_moves_few_chunks():
    r = random.Random(5)
    text = "".join(r.choice("abcdefgh .,") for _ in range(4000))
    edited = text[:2000] + "X" + text[2000:]
    a, b = fp.fingerprint(text), fp.fingerprint(edited)
    assert a[0] == b[0] and distance(a[1], b[1]) <= 3


def test_matches_equal_brute_force(docs_of, odd_rows):
    r = random.Random(6)
    base = ["".join(r.choice("abcdefgh .,\n") for _ in range(r.choice([200, 900, 3000]))) for _ in range(12)]
    rows = []
    for i in range(70):
        t = r.choice(base)
        for _ in range(r.randrange(0, 4)):
            at = r.randrange(len(t))
            t = t[:at] + r.choice(["", "Z", "some words"]) + t[at + r.randrange(0, 30) :]
        rows.append((i, t))
    rows += odd_rows + [rows[0]]
    got = found(fp.matches(docs_of(rows)))
    assert got == brute(rows) and len(got) > 20


def test_copies_with_short_signatures_are_together(docs_of):
    repeated = "the same words again " * 800
    assert len(fp.squeezed(fp.fingerprint(repeated)[1])) < fp.GRAM
    rows = [(1, "hello"), (2, "hello"), (3, "hellp"), (4, repeated), (5, repeated), (6, repeated + "x"), (7, "a"), (8, "b"), (9, "a"), (9, "a"), (10, ""), (11, "")]
    assert found(fp.matches(docs_of(rows))) == [(d, c, 1, 1, 100) for d, c in ((1, 1), (2, 1), (4, 4), (5, 4), (7, 7), (9, 7))]


def test_empty(docs_of):
    assert fp.fingerprint("") is None
    assert fp.matches(docs_of([])).count() == 0


def test_distances_equal_the_slow_ones_in_time():
    r = random.Random(4)
    a = ["".join(r.choice("ABc+") for _ in range(r.choice([1, 7, 30, 63, 64]))) for _ in range(200)]
    b = ["".join(c if r.random() < 0.8 else r.choice(["", "A", "cB"]) for c in x)[:64] or "B" for x in a]
    x, y = np.array(a, "S64"), np.array(b, "S64")
    assert fp.distances(x, y).tolist() == [distance(*p) for p in zip(a, b)]
    start = time.thread_time()
    fp.scores(np.tile(x, 250), np.tile(y, 250), 50)
    assert time.thread_time() - start < 15


@pytest.mark.parametrize("tile", [3, 2048])
def test_pairs_by_tiles(spark, monkeypatch, tile):
    rng = random.Random(17)
    base = ["".join(rng.choices("abcdefgh ", k=900)) for _ in range(4)]
    texts = [b[:at] + "".join(rng.choices("xyz", k=rng.randint(1, 30))) + b[at:] for b in base for at in rng.sample(range(900), 6)] + base
    prints = [fp.fingerprint(t) for t in texts]
    columns = np.array([p[0] for p in prints]), *(np.array([fp.squeezed(p[i]) for p in prints], "S64") for i in (1, 2))
    grams = [fp._gram_tokens(b, s.decode()) | fp._gram_tokens(2 * b, t.decode()) for b, s, t in zip(*(c.tolist() for c in columns))]
    want = {(i, j) for i in range(len(texts)) for j in range(i) if grams[i] & grams[j]}
    assert {(max(p), min(p)) for p in zip(*(x.tolist() for x in fp.candidates(*columns, None)))} == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole = sorted(map(tuple, fp.matches(docs).collect()))
    monkeypatch.setattr(fp, "TILE", tile)
    monkeypatch.setattr(_pairs, "sharing_pairs", None)  # no pair is shuffled
    assert sorted(map(tuple, fp.matches(docs).collect())) == whole and max(r[3] for r in whole) >= 6
