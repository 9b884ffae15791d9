"""URL filter lists applied by a sort-merge range join over reversed-host keys.

A URL's key is its host labels in reverse order, each followed by a comma, then `)` and path with query:
`https://www.Shop.example.com:443/a?b#c` becomes `com,example,shop,)/a?b`. A rule `example.com` covers the key
prefix `com,example,` (the host and all below it), a rule `shop.example.com/a` the prefix `com,example,shop,)/a`.
Every prefix is the interval of keys that begin with it, and intervals of two rules are nested or disjoint. Pages
and rules are cut at the same key boundaries, sorted, and swept once with a stack of the rules that are active.
"""

from __future__ import annotations

import csv
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsearch.llm import _pairs

_OUT = pa.schema([("page_id", pa.int64()), ("url_key", pa.string()), ("rule_id", pa.int64()), ("action", pa.string()), ("depth", pa.int64())])
_TOP = "\U0010ffff"


def url_key(url: Column) -> Column:
    """Canonical key of a URL column; null stays null."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#[\s\S]*$", "")
    authority = F.regexp_extract(rest, r"^[^/?]*", 0)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", ""))
    host = F.regexp_replace(host, r"^www\.", "")
    tail = F.substr(rest, F.length(authority) + 1)
    path = F.when(tail == "", "/").when(tail.startswith("?"), F.concat(F.lit("/"), tail)).otherwise(tail)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(",)"), path)


def rule_prefix(pattern: Column) -> Column:
    """Key prefix of a rule pattern: a host covers its subdomains too, a host with a path only itself."""
    key = url_key(pattern)
    return F.when(F.trim(pattern).rlike("^([A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]+$"), F.regexp_extract(key, r"^[^)]*", 0)).otherwise(key)


def _boundaries(keys: DataFrame, parts: int) -> list[str]:
    """Keys that cut the pages into `parts` ranges of about equal size, from a hash sample of some thousand keys."""
    if parts < 2:
        return []
    total = keys.count()
    every = max(1, total // (parts * 200))
    found = sorted(r[0] for r in keys.where(F.pmod(F.xxhash64("url_key"), F.lit(every)) == 0).groupBy("url_key").count().select("url_key").collect())
    if not found:
        return []
    return sorted({found[len(found) * i // parts] for i in range(1, parts)})


def _place_pages(bounds: list[str], numbers: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(1).to_pylist()
            pid = [numbers[0 if k is None else bisect_right(bounds, k)] for k in keys]
            n = b.num_rows
            yield pa.record_batch([pa.array(pid, pa.int32()), b.column(1), pa.array([1] * n, pa.int32()), b.column(0), pa.nulls(n, pa.string())], names=["pid", "key", "kind", "id", "action"])

    return run


def _place_rules(bounds: list[str], numbers: list[int]):
    """A rule goes to every range that its interval meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(numbers[p], r["key"], 0, r["rule_id"], r["action"]) for r in b.to_pylist() for p in range(bisect_right(bounds, r["key"]), bisect_left(bounds, r["key"] + _TOP) + 1)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string()))], names=["pid", "key", "kind", "id", "action"])

    return run


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, stack, active = None, [], 0  # stack: (prefix, rule id, action, rules with this prefix)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for pid, key, kind, ident, action in zip(*(c.to_pylist() for c in b.columns)):
                if pid != here:
                    here, stack, active = pid, [], 0
                if key is None:
                    row = (ident, None, None, default, 0)
                else:
                    while stack and not key.startswith(stack[-1][0]):
                        active -= stack.pop()[3]
                    if kind == 0:
                        active += 1
                        if stack and stack[-1][0] == key:
                            p, r, a, n = stack[-1]
                            stack[-1] = (p, r, a, n + 1)
                        else:
                            stack.append((key, ident, action, 1))
                        continue
                    row = (ident, key, stack[-1][1], default if stack[-1][2] is None else stack[-1][2], active) if stack else (ident, key, None, default, 0)
                for o, v in zip(out, row):
                    o.append(v)
            yield pa.record_batch([pa.array(o, f.type) for o, f in zip(out, _OUT)], schema=_OUT)

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", partitions: int | None = None) -> DataFrame:
    """`(page_id, url_key, rule_id, action, depth)`, one row for each page row.

    The longest rule that covers the page decides; among rules with the same prefix the smallest rule_id. depth counts
    all rules that cover it. Pages without a rule, and null URLs, get a null rule_id, the default action and depth 0.
    Rules with a null or blank pattern or a null id are left out; repeated rules count each; a null action is the default. Page rows with equal ids
    or a null id are kept. Columns of other names are ignored.
    """
    spark = pages.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pages.select(F.col(id_col).cast("bigint").alias("page_id"), url_key(F.col(url_col)).alias("url_key"))
    bounds = _boundaries(keyed.select("url_key").where("url_key is not null"), parts)
    rule_keys = rules.select(F.col("rule_id").cast("bigint").alias("rule_id"), rule_prefix(F.col("pattern")).alias("key"), F.col("action").cast("string").alias("action"), "pattern").where("rule_id is not null and trim(pattern) <> ''").drop("pattern")
    numbers = _pairs.buckets(spark, parts)  # each range is a task of its own
    kinds = "pid int, key string, kind int, id bigint, action string"
    both = keyed.mapInArrow(_place_pages(bounds, numbers), kinds).unionByName(rule_keys.mapInArrow(_place_rules(bounds, numbers), kinds))
    swept = both.repartition(parts, "pid").sortWithinPartitions("pid", "key", "kind", "id")
    return swept.mapInArrow(_sweep(default), "page_id bigint, url_key string, rule_id bigint, action string, depth bigint")


_LISTS = Path(__file__).with_name("url_lists.csv")


def _listed(path: Path | str) -> list[tuple[int, str, str, str]]:
    with open(path, newline="", encoding="utf-8") as f:
        return [(int(r["rule_id"]), r["pattern"], r["action"], r["category"]) for r in csv.DictReader(f)]


def listed_rules(spark, path: Path | str = _LISTS) -> DataFrame:
    """`(rule_id, pattern, action, category)` of a CSV file with these columns; the file of this package by default."""
    rows = _listed(path)
    return spark.createDataFrame(rows, "rule_id bigint, pattern string, action string, category string")


_SQL_KEY = r"""
  (SELECT array_to_string(list_reverse(string_split(host, '.')), ',') || ',)' || CASE WHEN tail = '' THEN '/' WHEN starts_with(tail, '?') THEN '/' || tail ELSE tail END
   FROM (SELECT regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')), '^www\.', '') AS host, substr(rest, length(authority) + 1) AS tail
   FROM (SELECT rest, regexp_extract(rest, '^[^/?]*', 0) AS authority FROM (SELECT regexp_replace(regexp_replace(trim({0}), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#[\s\S]*$', '') AS rest))))"""

ORACLE = f"""
WITH rules(rule_id, pattern, action) AS (VALUES {", ".join(f"({i}, '{p}', '{a}')" for i, p, a, _ in _listed(_LISTS))}),
prefixes AS (SELECT rule_id, action, CASE WHEN contains(pattern, '/') THEN k ELSE regexp_extract(k, '^[^)]*', 0) END AS prefix FROM (SELECT *, {_SQL_KEY.format("pattern")} AS k FROM rules)),
keyed AS (SELECT row_number() OVER () AS n, page_id, {_SQL_KEY.format("url")} AS url_key FROM pages),
hit AS (SELECT n, count(*) AS depth, first(rule_id ORDER BY length(prefix) DESC, rule_id) AS rule_id, first(action ORDER BY length(prefix) DESC, rule_id) AS action FROM keyed JOIN prefixes ON starts_with(url_key, prefix) GROUP BY n)
SELECT page_id, url_key, rule_id, coalesce(action, 'allow') AS action, coalesce(depth, 0) AS depth FROM keyed LEFT JOIN hit USING (n)
"""
