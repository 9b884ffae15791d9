"""DuckDB text for the analyser, from which the reference SQL of the queries is put together."""

from __future__ import annotations

_S = "s"


def parts_sql(s: str = _S) -> str:
    """List of the identifier parts of a lexeme."""
    cut = f"regexp_replace({s}, '^(.*?)(?:[_-]*)$', '\\1')"
    for pattern in ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        cut = f"regexp_replace({cut}, '{pattern}', '\\1 \\2', 'g')"
    return f"(list_filter(string_split_regex(lower({cut}), '[ _-]+'), lambda x: x <> '') || CASE WHEN regexp_matches({s}, '[_-]{{2,}}$') OR regexp_matches({s}, '^[_-]$') THEN [right({s}, 1)] ELSE [] END)"


def tokens_cte(table: str = "documents", key: str = "doc_id", text: str = "text", name: str = "tokens") -> str:
    """CTEs that end in `name(key, pos, term)`, the stream of the code analyser."""
    return f"""
{name}_lex AS (SELECT {key}, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT {key}, regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9_-]+') AS l FROM {table})),
{name}_parts AS (SELECT {key}, i, s, {parts_sql()} AS p FROM {name}_lex),
{name}_all AS (SELECT {key}, i, [lower(s), array_to_string(p, '')] || p AS l FROM {name}_parts),
{name}_stream AS (SELECT {key}, i, list_filter(l, lambda x, k: list_position(l, x) = k) AS l FROM {name}_all),
{name}_flat AS (SELECT {key}, i, unnest(l) AS term, generate_subscripts(l, 1) AS j FROM {name}_stream),
{name} AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i, j) - 1 AS pos, term FROM {name}_flat)"""
