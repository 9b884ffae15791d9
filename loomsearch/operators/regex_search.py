"""Literal and regular-expression search: a pattern is planned into required trigrams, candidates are found by their
postings and then verified. Patterns are of Python's dialect, without lookaround and backreferences."""

from __future__ import annotations

import re
import re._constants as C
import re._parser as sre
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsearch.functions import text
from loomsearch.llm import _words
from loomsearch.operators import index

MOST_TRIGRAMS = 8
MATCH = "byte_start bigint, byte_end bigint, line_start bigint, line_end bigint, matched_text string"


@dataclass(frozen=True)
class All:
    """Every document is a candidate."""


@dataclass(frozen=True)
class And:
    trigrams: tuple[str, ...]


@dataclass(frozen=True)
class Or:
    branches: tuple


def literal_trigrams(literal: str) -> list[str]:
    return [literal[i : i + 3] for i in range(len(literal) - 2)]


def _reject(parsed) -> None:
    for op, av in parsed:
        if op in (C.ASSERT, C.ASSERT_NOT, C.GROUPREF, C.GROUPREF_EXISTS):
            raise ValueError("lookaround and backreferences aren't supported")
        stack = [av]
        while stack:
            x = stack.pop()
            if isinstance(x, sre.SubPattern):
                _reject(x)
            elif isinstance(x, (tuple, list)):
                stack += x


def checked(pattern: str) -> re.Pattern:
    """The compiled pattern; an invalid one, or one outside the dialect, is an error."""
    try:
        _reject(sre.parse(pattern))
        return re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid pattern: {e}") from e


def _branches(pattern: str) -> list[str]:
    """Parts of a pattern between the `|` outside of groups and classes."""
    out, start, depth, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            j = i + 1 + (pattern[i + 1 : i + 2] == "^")
            j += pattern[j : j + 1] == "]"
            while j < len(pattern) and pattern[j] != "]":
                j += 2 if pattern[j] == "\\" else 1
            i = j
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def _required(pattern: str) -> list[str]:
    runs, run = [], ""
    for op, av in sre.parse(pattern):
        if op is C.LITERAL:
            run += chr(av)
            continue
        if op is C.IN and len(av) == 1 and av[0][0] is C.LITERAL:
            run += chr(av[0][1])
            continue
        runs.append(run)
        run = ""
    runs.append(run)
    return sorted({t for r in runs for t in literal_trigrams(r)})


def plan(pattern: str) -> All | And | Or:
    """Trigrams that every match must have. Patterns with inline flags need the whole corpus.

    A quantified atom, a group, a class of several characters and an anchor end a run of literal characters, so a plan
    never asks for more than a match has.
    """
    checked(pattern)
    if re.search(r"\(\?[aiLmsux-]+[:)]", pattern):
        return All()
    parts = _branches(pattern)
    plans = []
    for p in parts:
        found = _required(p)
        plans.append(And(tuple(found)) if found else All())
    if len(plans) == 1:
        return plans[0]
    return All() if any(isinstance(p, All) for p in plans) else Or(tuple(plans))


def literal_plan(literal: str) -> All | And:
    found = tuple(literal_trigrams(literal))
    return And(found) if found else All()


def trigram_postings(docs: DataFrame, key: str, content: str) -> DataFrame:
    """`(gram, doc_id)`, distinct within each document, so nothing is shuffled.

    One pass of a look-ahead over the text gives all windows; texts with characters beyond the basic plane, which a
    matcher steps through by halves, are cut into characters first.
    """
    body = F.coalesce(F.col(content), F.lit(""))
    windows = F.regexp_extract_all(body, F.lit("(?s)(?=(...))"), F.lit(1))
    slow = text.trigrams(F.filter(F.split(body, ""), lambda c: c != ""))
    grams = F.when(body.rlike(r"[\x{10000}-\x{10FFFF}]"), slow).otherwise(windows)
    return docs.select(F.col(key).alias("doc_id"), F.explode(F.array_distinct(grams)).alias("gram"))


def plan_trigrams(planned: All | And | Or) -> list[str]:
    """All trigrams that a plan may ask for."""
    if isinstance(planned, Or):
        return sorted({t for p in planned.branches for t in plan_trigrams(p)})
    return sorted(set(planned.trigrams)) if isinstance(planned, And) else []


def plan_postings(docs: DataFrame, key: str, content: str, planned: All | And | Or) -> DataFrame:
    """`(gram, doc_id)` of the trigrams of one plan, where no trigram table was written: a scan with `contains`."""
    grams = F.array(*map(F.lit, plan_trigrams(planned))).cast("array<string>")
    held = docs.select(F.col(key).alias("doc_id"), F.coalesce(content, F.lit("")).alias("_body"))
    return held.select("doc_id", F.explode(F.filter(grams, lambda g: F.contains("_body", g))).alias("gram"))


@dataclass
class Selection:
    """Candidates `(doc_id)` of a plan and how they were found."""

    candidates: DataFrame
    corpus: int
    trigrams: tuple[str, ...]
    full_scan: bool

    def diagnostics(self) -> DataFrame:
        spark: SparkSession = self.candidates.sparkSession
        one = self.candidates.agg(F.count("*").alias("candidate_count"))
        return one.select(F.lit(self.corpus).alias("full_corpus_count"), "candidate_count", F.lit(",".join(self.trigrams)).alias("selected_trigrams"), F.lit(self.full_scan).alias("fell_back"))


def select(planned: All | And | Or, posts: DataFrame, ids: DataFrame, corpus: int | None = None) -> Selection:
    """Rarest trigrams first, at most eight, while their postings together are fewer than the documents.

    One small aggregate brings the posting lengths of the plan's trigrams to the driver.
    """
    corpus = ids.count() if corpus is None else corpus
    if isinstance(planned, Or):
        parts = [select(p, posts, ids, corpus) for p in planned.branches]
        union = parts[0].candidates
        for p in parts[1:]:
            union = union.unionByName(p.candidates)
        return Selection(union.distinct(), corpus, tuple(t for p in parts for t in p.trigrams), any(p.full_scan for p in parts))
    wanted = planned.trigrams if isinstance(planned, And) else ()
    sizes = {r["gram"]: r["n"] for r in posts.where(F.col("gram").isin(*set(wanted))).groupBy("gram").agg(F.count("*").alias("n")).collect()} if wanted else {}
    for t in wanted:
        if t not in sizes:
            return Selection(ids.limit(0), corpus, (t,), False)
    chosen, work = [], 0
    for size, t in sorted((sizes[t], t) for t in wanted):
        if len(chosen) >= MOST_TRIGRAMS or work + size >= corpus:
            break
        work += size
        chosen.append(t)
    if not chosen:
        return Selection(ids, corpus, (), True)
    distinct = sorted(set(chosen))
    hits = posts.where(F.col("gram").isin(*distinct)).groupBy("doc_id").agg(F.count_distinct("gram").alias("k"))
    return Selection(hits.where(F.col("k") == len(distinct)).select("doc_id"), corpus, tuple(chosen), False)


def required(planned: All | And | Or, body: Column) -> Column | None:
    """A condition in the JVM that every text with a match fulfils; None if the plan asks for nothing."""
    if isinstance(planned, And):
        return reduce(lambda a, b: a & b, [F.contains(body, F.lit(t)) for t in sorted(set(planned.trigrams))[:MOST_TRIGRAMS]])
    if isinstance(planned, Or):
        return reduce(lambda a, b: a | b, [required(p, body) for p in planned.branches])
    return None


def line_range(data: bytes, start: int, end: int, line: int = 1, since: int = 0) -> tuple[int, int]:
    """Lines, from 1, of a byte range, counted on from byte `since` in `line`; the end counts breaks before the exclusive end."""
    first = line + data.count(b"\n", since, start)
    return first, first if start == end else first + data.count(b"\n", start, end)


def verified(docs: DataFrame, key: str, content: str, pattern: str, literal: bool = False) -> DataFrame:
    """`(doc_id, byte_start, byte_end, line_start, line_end, matched_text)` of all leftmost matches without overlap.

    Lines count from 1; the last is that of the byte before the end. A JVM filter, of the literal or of trigrams that
    the pattern needs, keeps most of what doesn't match from reaching Python.
    """
    compiled = re.compile(re.escape(pattern)) if literal else checked(pattern)
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(content).alias("body")).where("body is not null")
    needs = F.contains("body", F.lit(pattern)) if literal else required(plan(pattern), F.col("body"))
    if needs is not None:
        source = source.where(needs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for doc, body in zip(df["doc_id"], df["body"]):
                data, at, done, line = None, 0, 0, 1
                for m in compiled.finditer(body):
                    if data is None:
                        data = body.encode()
                    start = at + len(body[done : m.start()].encode())
                    end = start + len(m.group().encode())
                    first, last = line_range(data, start, end, line, at)
                    out.append((doc, start, end, first, last, m.group()))
                    at, done, line = start, m.start(), first
            yield pd.DataFrame(out, columns=["doc_id", "byte_start", "byte_end", "line_start", "line_end", "matched_text"])

    return source.mapInPandas(run, f"doc_id bigint, {MATCH}")


def search_literal(docs: DataFrame, key: str, content: str, literal: str, posts: DataFrame | None = None) -> DataFrame:
    """Verified matches of a literal among its candidates; an empty literal matches nothing."""
    if not literal:
        return verified(docs.limit(0), key, content, "x", literal=True)
    if posts is not None:
        chosen = select(literal_plan(literal), posts, docs.select(F.col(key).alias("doc_id")))
        docs = docs.join(chosen.candidates.withColumnRenamed("doc_id", "_c"), F.col(key) == F.col("_c"), "left_semi")
    return verified(docs, key, content, literal, literal=True)


def search_regex(docs: DataFrame, key: str, content: str, pattern: str, posts: DataFrame | None = None) -> DataFrame:
    """Verified matches of a pattern, over its candidates where postings are given, over the corpus else."""
    planned = plan(pattern)
    if posts is not None and not isinstance(planned, All):
        chosen = select(planned, posts, docs.select(F.col(key).alias("doc_id")))
        docs = docs.join(chosen.candidates.withColumnRenamed("doc_id", "_c"), F.col(key) == F.col("_c"), "left_semi")
    return verified(docs, key, content, pattern)


POSITION_BUCKETS, NEXT_BUCKETS = 8, 128


def trigram_masks(docs: DataFrame, key: str, content: str, grams: list[str] | None = None) -> DataFrame:
    """`(gram, doc_id, places, next_low, next_high)`: bits of position mod 8 and of the next character mod 128.

    With `grams` only their rows are made, each text being searched for them, without a shuffle.
    """
    if grams is not None:
        return _masks_of(docs, key, content, sorted(set(grams)))
    chars = docs.select(F.col(key).alias("doc_id"), F.filter(F.split(F.coalesce(content, F.lit("")), ""), lambda c: c != "").alias("chars"))
    at = F.posexplode(text.trigrams(F.col("chars"))).alias("pos", "gram")
    each = chars.select("doc_id", "chars", at).select("doc_id", "gram", "pos", F.get("chars", F.col("pos") + 3).alias("next"))
    code = F.pmod(F.expr("ascii(next)"), F.lit(NEXT_BUCKETS))
    bit = lambda cond, shift: F.when(F.col("next").isNotNull() & cond, F.call_function("shiftleft", F.lit(1).cast("bigint"), shift.cast("int"))).otherwise(F.lit(0).cast("bigint"))
    return each.groupBy("gram", "doc_id").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("pos") % POSITION_BUCKETS).cast("int"))).alias("places"),
        F.bit_or(bit(code < 64, code)).alias("next_low"),
        F.bit_or(bit(code >= 64, code - 64)).alias("next_high"),
    )


def _masks_of(docs: DataFrame, key: str, content: str, grams: list[str]) -> DataFrame:
    def made():
        def of(body: str) -> list[list]:
            rows = []
            for g in grams:
                at, places, low, high = body.find(g), 0, 0, 0
                while at >= 0:
                    places |= 1 << at % POSITION_BUCKETS
                    if (after := at + len(g)) < len(body):
                        code = ord(body[after]) % NEXT_BUCKETS
                        low, high = (low | 1 << code, high) if code < 64 else (low, high | 1 << code - 64)
                    at = body.find(g, at + 1)
                if places:
                    rows.append((g, places, *(x - (1 << 64) if x >> 63 else x for x in (low, high))))
            return [list(c) for c in zip(*rows)] or [[], [], [], []]

        return of

    fields = T.StructType([T.StructField(n, k) for n, k in (("gram", T.StringType()), ("places", T.IntegerType()), ("next_low", T.LongType()), ("next_high", T.LongType()))])
    source = docs.select(F.col(key).alias("doc_id"), F.col(content).alias("body"))
    some = source.where(reduce(lambda a, b: a | b, [F.contains("body", F.lit(g)) for g in grams], F.lit(False)))
    found = index.exploded(some, "doc_id", "body", fields, made).select("gram", "doc_id", "places", "next_low", "next_high")
    if index.repeats(source, "doc_id"):
        found = found.groupBy("gram", "doc_id").agg(*(F.bit_or(c).alias(c) for c in ("places", "next_low", "next_high")))
    return found


def masked_candidates(masks: DataFrame, candidates: DataFrame, literal: str) -> DataFrame:
    """Candidates whose masks allow the literal at some position mod 8; short literals leave them as they are."""
    if len(literal) < 4:
        return candidates
    grams = literal_trigrams(literal)
    spark = candidates.sparkSession
    rows = [(b, g, (b + i) % POSITION_BUCKETS, ord(literal[i + 3]) % NEXT_BUCKETS if i + 3 < len(literal) else -1) for b in range(POSITION_BUCKETS) for i, g in enumerate(grams)]
    needs = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, start int, gram string, place int, next int")
    held = masks.join(candidates, "doc_id", "left_semi").join(F.broadcast(needs), "gram")
    word = F.when(F.col("next") < 64, F.call_function("shiftright", "next_low", F.col("next"))).otherwise(F.call_function("shiftright", "next_high", F.col("next") - 64))
    good = (F.call_function("shiftright", "places", F.col("place")).bitwiseAND(1) == 1) & ((F.col("next") < 0) | (word.bitwiseAND(1) == 1))
    by_start = held.groupBy("doc_id", "start").agg(F.bool_and(good).alias("ok"))
    return by_start.where("ok").select("doc_id").distinct()


def _mix_char(h: int, c: str) -> int:
    h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
    return h ^ (h >> 16)


def pair_weights(s: str) -> list[int]:
    return [_mix_char(_mix_char(0x811C9DC5, a), b) for a, b in zip(s, s[1:])]


def sparse_ngrams(s: str) -> list[str]:
    """Substrings whose two edge pairs outweigh every pair between them.

    From each start the largest weight inside is carried along; no longer substring fits once it reaches the edge.
    """
    w, found = pair_weights(s), set()
    for i in range(len(w)):
        inside = -1
        for j in range(i, len(w)):
            if j <= i + 1 or min(w[i], w[j]) > inside:
                found.add(s[i : j + 2])
            if j > i:
                inside = max(inside, w[j])
                if inside >= w[i]:
                    if j == i + 1 <= len(w):
                        continue
                    break
    return sorted(found)


def sparse_covering(s: str) -> list[str]:
    """The longest such substring from the left, again and again; neighbours share a character."""
    w, found, i = pair_weights(s), set(), 0
    while i < len(w):
        j = next((j for j in range(len(w) - 1, i, -1) if j <= i + 1 or min(w[i], w[j]) > max(w[i + 1 : j])), i)
        found.add(s[i : j + 2])
        i = j + 1
    return sorted(found)


def sparse_postings(docs: DataFrame, key: str, content: str, grams: list[str] | None = None) -> DataFrame:
    """`(gram, doc_id)` of sparse n-grams, sent as they are found.

    With `grams`, which are sparse n-grams, only theirs: whether a substring is one depends on nothing round it, so a
    text that contains it has it.
    """
    if grams is not None:
        held = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(content, F.lit("")).alias("body"))
        sought = F.array(*map(F.lit, grams)).cast("array<string>")
        return held.select(F.explode(F.filter(sought, lambda g: F.contains("body", g))).alias("gram"), "doc_id")
    keyed = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(content).alias("body"))
    fields = T.StructType([T.StructField("gram", T.StringType())])
    return index.exploded(keyed, "doc_id", "body", fields, lambda: lambda body: [sparse_ngrams(body)]).select("gram", "doc_id")


_WALL, _BETWEEN = np.int64(1 << 32), np.uint32(0x110000)
CHARACTERS, CODES = 1 << 20, 1 << 23  # of texts whose grams are found at once, and of grams that a worker holds


def _sparse_places(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the sparse n-grams of texts, each of which ends with `_BETWEEN`."""
    with np.errstate(over="ignore"):
        h = np.full(len(chars) - 1, 0x811C9DC5, np.uint32)
        for c in (chars[:-1], chars[1:]):
            h = (h ^ c) * np.uint32(0x01000193)
            h ^= h >> np.uint32(16)
    w = np.where((chars[:-1] == _BETWEEN) | (chars[1:] == _BETWEEN), _WALL, h.astype(np.int64))
    pairs = np.flatnonzero(w < _WALL)
    threes = np.flatnonzero((w[:-1] < _WALL) & (w[1:] < _WALL))
    starts, lengths = [pairs, threes], [np.full(len(pairs), 2), np.full(len(threes), 3)]
    at = np.flatnonzero((w[:-1] < _WALL) & (w[1:] < w[:-1]))
    edge, inside, ahead = w[at], w[at + 1], 2
    while len(at):
        following = w[at + ahead]
        hit = at[(following > inside) & (following < _WALL)]
        starts.append(hit)
        lengths.append(np.full(len(hit), ahead + 2))
        inside = np.maximum(inside, following)
        on = inside < edge
        at, edge, inside, ahead = at[on], edge[on], inside[on], ahead + 1
    return np.concatenate(starts), np.concatenate(lengths)


def _grams_of(texts: list[np.ndarray]) -> Iterator[tuple[str, np.ndarray, int]]:
    """For classic and sparse grams: distinct codes, and how many postings the texts have.

    The code of a classic gram is its three characters, mixed so that no two are the same; that of a sparse n-gram is
    a hash of 64 bits.
    """
    chars = np.concatenate([x for t in texts for x in (t, [_BETWEEN])]).astype(np.uint32)
    own = _words.mix(np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t) + 1 for t in texts]) + np.uint64(1))
    wide = chars.astype(np.uint64)
    three = (wide[:-2] << np.uint64(42)) | (wide[1:-1] << np.uint64(21)) | wide[2:]
    at = np.flatnonzero((chars[:-2] != _BETWEEN) & (chars[1:-1] != _BETWEEN) & (chars[2:] != _BETWEEN))
    codes = _words.mix(three[at])
    yield "classic", _words.distinct(codes), len(_words.distinct(codes ^ own[at]))
    starts, lengths = _sparse_places(chars)
    up, down = _words._powers(len(chars) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_words.mix(wide + np.uint64(1)) * up[: len(chars)])])
    codes = _words.mix((sums[starts + lengths] - sums[starts]) * down[starts] + lengths.astype(np.uint64))
    yield "sparse", _words.distinct(codes), len(_words.distinct(codes ^ own[starts]))


SLICES = 1 << 10  # of the codes by their first bits; a task counts one at a time
_CODES = "kind string, slice int, codes binary, postings bigint"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of each slice's distinct codes, and one of each kind's postings."""
    codes: dict[str, list[np.ndarray]] = {"classic": [], "sparse": []}
    postings = dict.fromkeys(codes, 0)
    texts, held = [], 0

    def rows(kind: str) -> pa.RecordBatch:
        found = _words.distinct(np.concatenate(codes[kind]))
        edges = np.append(np.searchsorted(found, np.arange(SLICES, dtype=np.uint64) << np.uint64(54)), len(found))
        codes[kind] = []
        full = np.flatnonzero(np.diff(edges))
        parts = [found[edges[i] : edges[i + 1]].tobytes() for i in full]
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(full)), pa.array(full, pa.int32()), pa.array(parts, pa.binary()), pa.array([0] * len(full), pa.int64())], ["kind", "slice", "codes", "postings"])

    def settle() -> Iterator[pa.RecordBatch]:
        for kind, found, n in _grams_of(texts):
            codes[kind].append(found)
            postings[kind] += n
            if sum(map(len, codes[kind])) >= CODES:
                codes[kind] = [_words.distinct(np.concatenate(codes[kind]))]
                if len(codes[kind][0]) >= CODES // 2:
                    yield rows(kind)

    for b in batches:
        for x in b.column(0):
            texts.append(np.frombuffer((x.as_py() or "").encode("utf-32-le"), np.uint32))
            held += len(texts[-1])
            if held >= CHARACTERS:
                yield from settle()
                texts, held = [], 0
    if texts:
        yield from settle()
    for kind in codes:
        if codes[kind]:
            yield rows(kind)
        yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([postings[kind]], pa.int64())], ["kind", "slice", "codes", "postings"])


def _count_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`(kind, grams, postings)` of each slice; rows come by kind and slice."""
    for (kind, _), rows in groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[:2]):
        parts, postings = [], 0
        for _, _, codes, n in rows:
            parts.append(np.frombuffer(codes, np.uint64))
            postings += n
        yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([len(_words.distinct(np.concatenate(parts)))], pa.int64()), pa.array([postings], pa.int64())], ["kind", "grams", "postings"])


def gram_counts(docs: DataFrame, content: str) -> DataFrame:
    """`(kind, grams, postings)` of classic and sparse grams; only each task's distinct codes are shuffled, packed."""
    packed = docs.select(F.col(content).alias("body")).mapInArrow(_gather, _CODES)
    counted = packed.repartition("kind", "slice").sortWithinPartitions("kind", "slice").mapInArrow(_count_slices, "kind string, grams bigint, postings bigint")
    return counted.groupBy("kind").agg(F.sum("grams").alias("grams"), F.sum("postings").alias("postings"))


def sparse_candidates(sparse: DataFrame, ids: DataFrame, literal: str) -> DataFrame:
    """Documents that have every sparse n-gram of the literal's cover; all of them for a literal of one character."""
    cover = sparse_covering(literal)
    if not cover:
        return ids
    hits = sparse.where(F.col("gram").isin(*cover)).groupBy("doc_id").agg(F.count_distinct("gram").alias("k"))
    return hits.where(F.col("k") == len(cover)).select("doc_id")


def sparse_comparison(docs: DataFrame, key: str, content: str, literal: str) -> DataFrame:
    """One row that compares classic and sparse candidates of a literal."""
    ids = docs.select(F.col(key).cast("bigint").alias("doc_id"))
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(content, F.lit("")).alias("body"))
    planned = literal_plan(literal)
    classic = select(planned, plan_postings(source, "doc_id", "body", planned), ids).candidates
    thin = sparse_candidates(sparse_postings(source, "doc_id", "body", sparse_covering(literal)), ids, literal)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(ids, "documents").crossJoin(one(classic, "classic_candidates")).crossJoin(one(thin, "sparse_candidates")).crossJoin(one(classic.intersect(thin), "both"))
    of = lambda kind, column: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(column))), F.lit(0)).cast("bigint").alias(f"{kind}_{column}")
    return out.crossJoin(gram_counts(source, "body").agg(*(of(kind, c) for kind in ("classic", "sparse") for c in ("grams", "postings"))))


def refresh(posts: DataFrame, changed: DataFrame, removed: DataFrame, key: str, content: str) -> DataFrame:
    """Postings without changed and removed documents, and with the changed ones as they are now."""
    gone = changed.select(F.col(key).alias("doc_id")).unionByName(removed.select(F.col(key).alias("doc_id"))).distinct()
    return posts.join(gone, "doc_id", "left_anti").unionByName(trigram_postings(changed, key, content))
