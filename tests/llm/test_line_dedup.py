import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from loomsearch.llm import _bloom, line_dedup


def masked(line):
    return " ".join(line_dedup.WILD if re.search("[0-9]", w) else w for w in re.split("[ \\t\\n\\x0b\\f\\r]+", line) if w)


def brute(rows, min_docs=10, similarity=0.9, lead=2):
    """The tree of templates without blocks: every template of a leaf is compared."""
    where = defaultdict(list)
    for d, text in rows:
        if d is not None and text is not None:
            for n, line in enumerate(text.split("\n")):
                if m := masked(line):
                    where[m].append((d, n))
    leaves = defaultdict(list)
    for m in sorted(where, key=lambda x: x.encode()):
        t = m.split(" ")
        leaves[len(t), *t[:lead]].append(m)
    out = set()
    for lines in leaves.values():
        templates = []
        for m in lines:
            tokens = m.split(" ")
            need = -int(-len(tokens) * similarity // 1)
            if len(tokens) >= lead + 2:
                need = min(need, len(tokens) - 1)
            for tpl in templates:
                if sum(a == b for a, b in zip(tpl[0], tokens)) >= need:
                    tpl[0] = [a if a == b else line_dedup.WILD for a, b in zip(tpl[0], tokens)]
                    tpl[1].append(m)
                    break
            else:
                templates.append([tokens, [m]])
        for tokens, own in templates:
            hits = [h for m in own for h in where[m]]
            docs = {d for d, _ in hits}
            if len(docs) >= min_docs:
                out |= {(d, n, " ".join(tokens), len(docs)) for d, n in hits if d != min(docs)}
    return sorted(out)


def some_rows(seed=1):
    r = random.Random(seed)
    words = [f"w{c}" for c in "abcdefghijklmnop"]
    shared = ["Copyright 2019 all rights reserved by the owner of this fine page", "Page 3 of 10", "Subscribe to our letter now and never miss a thing again " + " ".join(words)]
    rows = []
    for i in range(40):
        lines = [" ".join(r.choice(words) for _ in range(r.randrange(1, 14))) for _ in range(4)]
        for s in shared:
            if r.random() < 0.6:
                w = s.replace("2019", str(r.randrange(1990, 2030))).replace("3", str(r.randrange(99))).split()
                if len(w) > 12:
                    w[r.randrange(3, len(w))] = r.choice(["x", "y", "z"])
                lines.insert(r.randrange(4), r.choice(["  ", ""]) + " ".join(w))
        rows.append((i, "\n".join(lines)))
    return rows + [(100, "same line of one\n" * 30)]


def test_equals_brute_force(docs_of, odd_rows):
    rows = some_rows() + odd_rows
    got = sorted({tuple(r) for r in line_dedup.dropped_lines(docs_of(rows)).collect()})
    assert got == brute(rows) and len(got) > 40


def test_documents_lose_their_lines(docs_of, odd_rows):
    rows = some_rows(2) + odd_rows + [(200, "Page 7 of 10"), (201, None)]
    gone = {(d, n) for d, n, *_ in brute(rows)}
    expected = []
    for d, t in rows:
        if t is not None and d is not None and any((d, n) in gone for n in range(t.count("\n") + 1)):
            t = "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone)
            if not t.strip():
                continue
        expected.append((d, t))
    out = line_dedup.drop_recurring(docs_of(rows))
    got = out.collect()
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in got])) == sorted(map(str, expected))
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
    assert out.columns == docs_of([]).columns and (200, "Page 7 of 10") not in expected


def test_short_templates_with_a_name(docs_of):
    names = [f"N{c}" for c in "abcdefghijklmno"]
    rows = [(i, f"Posted by {n} in News\nShared by {n} today\nby {n} now") for i, n in enumerate(names)]
    got = {tuple(r) for r in line_dedup.dropped_lines(docs_of(rows)).collect()}
    assert got == {(i, 1, "Shared by <*> today", 15) for i in range(1, 15)} | {(i, 0, "Posted by <*> in News", 15) for i in range(1, 15)}


def test_at_least_one_place_after_the_leading_ones_agrees():
    assert [line_dedup.needed(n, 0.9, 2) for n in (1, 3, 4, 5, 9, 10, 19, 20, 21)] == [1, 3, 3, 4, 8, 9, 18, 18, 19]
    assert line_dedup.needed(5, 1.0, 2) == 5 and line_dedup.needed(10, 0.5, 2) == 5


def test_blocks_find_all_that_a_full_comparison_finds():
    r = random.Random(8)
    for n in (4, 5, 9, 12, 20, 23):
        leaf, slow = line_dedup.Leaf(n, 0.9, 2), []
        base = [["a", "b", *(r.choice("xyz") for _ in range(n - 2))] for _ in range(4)]
        for _ in range(400):
            tokens = list(r.choice(base))
            for _ in range(r.randrange(4)):
                tokens[r.randrange(2, n)] = r.choice([line_dedup.WILD, "p", "q"])
            at = next((i for i, t in enumerate(slow) if sum(x == y for x, y in zip(t, tokens)) >= leaf.need), len(slow))
            slow[at:at + 1] = [[x if x == y else line_dedup.WILD for x, y in zip(slow[at], tokens)] if at < len(slow) else tokens]
            assert leaf.add(tokens) == at
        assert leaf.templates == slow


def test_empty(docs_of):
    assert line_dedup.dropped_lines(docs_of([])).count() == 0
    assert line_dedup.drop_recurring(docs_of([])).count() == 0


def test_lines_are_split_as_the_slow_version_does():
    r = random.Random(9)
    texts = ["".join(r.choice("ab1é \t\n\r\x0b\u00a0<*>") for _ in range(r.randrange(0, 60))) for _ in range(300)] + ["", "\n\n", "x"]
    names = {}
    for most in (1, 50, 1 << 19):
        got = []
        for own in line_dedup.lines(pa.array(texts), 2, most):
            for i in range(len(own.row)):
                got.append((int(own.row[i]), int(own.number[i]), own.masked(i)))
                assert names.setdefault(own.masked(i), own.hashes[i]) == own.hashes[i]
                t = own.masked(i).split(" ")
                assert names.setdefault((len(t), *t[:2]), own.leaf[i]) == own.leaf[i]
        assert got == [(d, n, masked(x)) for d, t in enumerate(texts) for n, x in enumerate(t.split("\n")) if masked(x)]
    assert len({int(h) for h in names.values()}) == len(names)


def test_one_leaf_with_most_lines(docs_of, monkeypatch):
    """Small buffers, and a leaf that holds nearly all lines."""
    monkeypatch.setattr(line_dedup, "DISTINCT", 5)
    r = random.Random(10)
    rows = [(i, "\n".join(f"at once {r.choice('abc')} {r.choice('xy')} {r.choice('pqrs')} went" for _ in range(5))) for i in range(120)]
    got = sorted({tuple(x) for x in line_dedup.dropped_lines(docs_of(rows)).collect()})
    assert got == brute(rows) and len(got) > 100


def test_filters_hold_all_keys(spark):
    keys = [r_ * 7919 - 50_000 for r_ in range(3000)]
    held = _bloom.build(spark.createDataFrame([(k,) for k in keys], "k bigint"))
    others = np.arange(1 << 40, (1 << 40) + 100_000)
    assert _bloom.passes(held, np.array(keys)).all() and _bloom.passes(held, others).mean() < 0.1
    assert not _bloom.passes(_bloom.build(spark.createDataFrame([], "k bigint")), others).any()
