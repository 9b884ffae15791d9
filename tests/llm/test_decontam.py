import random
import re

from loomsearch.llm import decontam

WORD = re.compile("[0-9a-z_\x80-\U0010ffff]+")


def brute(docs, items, n=13):
    out = []
    for d, text in docs:
        if d is None or not text:
            continue
        spans = [m.span() for m in WORD.finditer(text.lower())]
        words = [text.lower()[a:b] for a, b in spans]
        for i, item in items:
            w = WORD.findall((item or "").lower())
            if i is None or not w:
                continue
            size = min(n, len(w))
            wins = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
            hit = set()
            for k in range(len(words) - size + 1):
                if tuple(words[k : k + size]) in wins:
                    hit |= set(range(k, k + size))
            for k in sorted(hit):
                if k - 1 not in hit:
                    e = k
                    while e + 1 in hit:
                        e += 1
                    out.append((d, i, spans[k][0], spans[e][1], e - k + 1))
    return sorted(out)


def test_equals_brute_force(spark, docs_of, odd_rows):
    r = random.Random(2)
    vocabulary = ["Alpha", "beta", "été", "x_1", "gamma", "DELTA", "Ω"] + [f"v{i}" for i in range(60)]
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, some(r.randrange(3, 40))) for i in range(30)] + [(30, None), (31, ""), (None, some(20)), (32, some(8)), (33, "été v7"), (34, "GAMMA"), (35, "gamma " * 30)]
    docs = []
    for i in range(60):
        parts = [some(r.randrange(0, 30))]
        if i % 3 == 0:
            w = (r.choice(items[:30])[1]).split()
            cut = w[r.randrange(0, 3) :]
            parts.append((", " if i % 2 else "\n").join(cut).upper())
        docs.append((i, " ".join([*parts, some(r.randrange(0, 9))])))
    rows = docs + odd_rows + [docs[0]]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(map(tuple, decontam.contaminated_spans(docs_of(rows), bench).collect()))
    assert got == brute(rows, items) and len(got) > 15
    split = sorted(map(tuple, decontam.contaminated_spans(docs_of(rows), bench, most_bytes=200).collect()))
    assert split == got
    kept = decontam.drop_contaminated(docs_of(rows), bench)
    bad = {g[0] for g in got if g[4] >= 5}
    assert {g[4] for g in got} >= {1, 13}
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(str(d) for d, _ in rows if d not in bad)


def test_empty_tables(spark, docs_of, odd_rows):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contaminated_spans(docs_of(odd_rows), none).count() == 0
    assert decontam.drop_contaminated(docs_of(odd_rows), none).count() == len(odd_rows)
    assert decontam.contaminated_spans(docs_of([]), none).count() == 0


def test_letters_that_grow_in_lower_case():
    text = "xx İ one two three four yy"
    ((_, a, b, n),) = decontam.Index([(1, "i̇ one two three four")], 13).find(text)
    assert (text[a:b], n) == ("İ one two three four", 5)


def test_every_window_is_found():
    r = random.Random(5)
    for n in (1, 2, 3, 6, 13):
        for _ in range(60):
            some = lambda k: " ".join(r.choice("ab") for _ in range(k))
            items = [(i, some(r.randrange(1, 30))) for i in range(3)]
            text = some(r.randrange(0, 60))
            assert [(1, *h) for h in decontam.Index(items, n).find(text)] == brute([(1, text)], items, n)
