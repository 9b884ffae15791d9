"""Tokenisation and small string functions as Spark columns; everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LEXEME = "[A-Za-z0-9_-]+"
_PLAIN = "^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)$"  # lexemes with a single part and no separator

FILE_TYPES = {
    "rust": ["rs"], "python": ["py"], "javascript": ["js", "jsx", "mjs", "cjs"], "typescript": ["ts", "tsx", "mts", "cts"], "go": ["go"],
    "markdown": ["md", "markdown"], "toml": ["toml"], "yaml": ["yaml", "yml"], "json": ["json", "jsonc"], "shell": ["sh", "bash", "zsh", "fish"],
}
SPECIAL_FILES = {"toml": ["Cargo.toml", "pyproject.toml"], "shell": ["Dockerfile", "Makefile", "Justfile", "justfile"]}
CODE_TYPES = ("rust", "python", "javascript", "typescript", "go", "shell")


def lexemes(text: Column) -> Column:
    """Maximal runs of ASCII letters, digits, `_` and `-`."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LEXEME), F.lit(0))


def identifier_parts(lexeme: Column) -> Column:
    """Lower-case parts of a lexeme: cut at separators, case changes, acronym ends and between letters and digits.

    A lexeme that ends in two or more separators, or is one separator, has that character as a last part.
    """
    s = F.regexp_replace(lexeme, r"[_-]+$", "")
    for pattern in (r"([a-z])([A-Z])", r"([A-Z])([A-Z][a-z])", r"([A-Za-z])([0-9])", r"([0-9])([A-Za-z])"):
        s = F.regexp_replace(s, pattern, "$1 $2")
    parts = F.filter(F.split(F.lower(s), r"[ _-]+"), lambda x: x != "")
    tail = F.when(lexeme.rlike(r"[_-]{2,}$") | lexeme.rlike(r"^[_-]$"), F.array(F.right(lexeme, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(parts, tail)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, where `use` names it several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def identifier_stream(lexeme: Column) -> Column:
    """The lexeme, its parts joined, and its parts, each once."""
    full = _once(identifier_parts(lexeme), lambda parts: F.array_distinct(F.concat(F.array(F.lower(lexeme), F.array_join(parts, "")), parts)))
    return F.when(lexeme.rlike(_PLAIN), F.array(F.lower(lexeme))).otherwise(full)


def code_tokens(text: Column) -> Column:
    """Token stream of the code analyser, in order; a token's position is its index."""
    return F.flatten(F.transform(lexemes(text), identifier_stream))


def prose_pieces(text: Column, stop_words: list[str]) -> Column:
    """By lexeme, structs `(term, stem)`: surface forms of identifiers (stem false) and parts that aren't stop words (stem true)."""
    stops = F.array(*map(F.lit, stop_words)) if stop_words else F.array().cast("array<string>")

    def of(lexeme: Column) -> Column:
        plain = F.array(F.lower(lexeme))
        return _once(F.when(lexeme.rlike(_PLAIN), plain).otherwise(identifier_parts(lexeme)), lambda parts: pieces(lexeme, parts))

    def pieces(lexeme: Column, parts: Column) -> Column:
        kept = F.filter(parts, lambda p: ~F.array_contains(stops, p))
        surface = F.when((F.size(parts) > 1) | lexeme.rlike("[_-]"), F.array(F.lower(lexeme), F.array_join(parts, ""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.transform(surface, lambda t: F.struct(t.alias("term"), F.lit(False).alias("stem"))), F.transform(kept, lambda t: F.struct(t.alias("term"), F.lit(True).alias("stem"))))

    return F.transform(lexemes(text), of)


def marked_pieces(text: Column, stop_words: list[str]) -> Column:
    """`prose_pieces` as strings, marked `~` where they are to be stemmed and `=` where not; null texts stay null."""
    marked = F.transform(prose_pieces(text, stop_words), lambda ps: F.transform(ps, lambda p: F.concat(F.when(p["stem"], "~").otherwise("="), p["term"])))
    return F.when(text.isNotNull(), marked)


def word_ngrams(tokens: Column, n: int) -> Column:
    """Windows of `n` tokens joined by spaces; none where there are fewer."""
    if n < 1:
        raise ValueError("n is at least 1")
    if n == 1:
        return tokens
    at = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1)))
    grams = F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; empty where there is none or it leads the name."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def file_type(path: Column) -> Column:
    """Special file names first, then the extension; `unknown` else. Both count case."""
    name, ext = file_name(path), extension(path)
    out = F.lit("unknown")
    for source, table in ((ext, FILE_TYPES), (name, SPECIAL_FILES)):
        for kind, values in table.items():
            out = F.when(source.isin(*values), kind).otherwise(out)
    return out


def uses_code_analyzer(kind: Column, field: Column) -> Column:
    """Content is code for source files only; comments and frontmatter are prose; all other fields are code."""
    return F.when(field == "content", kind.isin(*CODE_TYPES)).otherwise(~field.isin("comments", "frontmatter"))


def line_at(text: Column, char: Column) -> Column:
    """1-based line number of a 0-based character position."""
    before = F.substring(text, F.lit(1), char)
    return F.lit(1) + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def trigrams(chars: Column) -> Column:
    """Overlapping windows of three characters over `split(text, '')`, which the caller projects once."""
    at = F.sequence(F.lit(1), F.greatest(F.size(chars) - 2, F.lit(1)))
    grams = F.transform(at, lambda i: F.concat(F.element_at(chars, i), F.element_at(chars, i + 1), F.element_at(chars, i + 2)))
    return F.when(F.size(chars) >= 3, grams).otherwise(F.array().cast("array<string>"))


def contains_normalized(haystack: Column, needle: Column) -> Column:
    """1.0 if the trimmed lower-case needle is in the haystack; 0.0 for a blank needle."""
    n = F.lower(F.trim(needle))
    return F.when((n != "") & F.contains(F.lower(haystack), n), 1.0).otherwise(0.0)


def estimated_tokens(n_bytes: Column) -> Column:
    return F.ceil(n_bytes / 4)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def human_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1 << 20, F.format_string("%.1f KiB", n / 1024))
        .when(n < 1 << 30, F.format_string("%.1f MiB", n / (1 << 20)))
        .otherwise(F.format_string("%.1f GiB", n / (1 << 30)))
    )


def query_display(terms: Column) -> Column:
    return F.array_join(F.array_sort(terms), " ")
