"""Fields of a document: name, path, extension, content, identifiers, and those extracted from its syntax."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsearch.functions import analysis, text
from loomsearch.operators import index

FIELDS = ["filename", "path", "extension", "content", "identifiers", "symbols", "imports", "comments", "string_literals", "frontmatter"]
EXPORTABLE = ["symbols", "imports", "comments", "string_literals", "frontmatter"]


_SHAPED = re.compile("(?=.*[_-])|(?=.*[a-z])(?=.*[A-Z])|(?=.*[A-Za-z])(?=.*[0-9])").match


def identifier_lexemes(content: Column) -> Column:
    """Lexemes with a separator, mixed case, or both letters and digits."""
    shaped = lambda s: s.rlike("[_-]") | (s.rlike("[a-z]") & s.rlike("[A-Z]")) | (s.rlike("[A-Za-z]") & s.rlike("[0-9]"))
    return F.filter(text.lexemes(content), shaped)


def base_fields(docs: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """`(doc_id, path, field, text)` of the five fields that need no parser; blank ones are left out."""
    p, c = F.col(path), F.col(content)
    named = F.array(
        F.struct(F.lit("filename").alias("field"), text.file_name(p).alias("text")),
        F.struct(F.lit("path").alias("field"), p.alias("text")),
        F.struct(F.lit("extension").alias("field"), text.extension(p).alias("text")),
        F.struct(F.lit("content").alias("field"), c.alias("text")),
        F.struct(F.lit("identifiers").alias("field"), F.array_join(identifier_lexemes(c), " ").alias("text")),
    )
    each = docs.select(F.col(key).alias("doc_id"), p.alias("path"), F.explode(named).alias("f")).select("doc_id", "path", "f.field", "f.text")
    return each.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)


def field_tokens(fields: DataFrame) -> DataFrame:
    """`(doc_id, path, field, tokens)` with the code analyser."""
    return fields.select("doc_id", "path", "field", text.code_tokens(F.col("text")).alias("tokens"))


def query_base_postings(docs: DataFrame, key: str, path: str, content: str, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`index.query_field_postings` of the tokens of `base_fields`: one pass over each text for content and identifiers.

    Tokens are only counted, and those of the terms of `terms(term)` kept.
    """
    wanted = index.few_terms(terms)
    if wanted is None:
        return index.query_field_postings(field_tokens(base_fields(docs, key, path, content)), terms)
    sought = frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(lexeme: str) -> tuple[int, tuple[str, ...], bool]:
            tokens = analysis.identifier_stream(lexeme)
            return len(tokens), tuple(t for t in tokens if t in sought), bool(_SHAPED(lexeme))

        kept = analysis.Kept(of)

        def counted(lexemes: Counter, only_shaped: bool) -> tuple[int, list[dict]]:
            length, hits = 0, {}
            for lexeme, n in lexemes.items():
                size, found, shaped = kept[lexeme]
                if shaped or not only_shaped:
                    length += n * size
                    for t in found:
                        hits[t] = hits.get(t, 0) + n
            return length, [{"term": t, "tf": n} for t, n in hits.items()]

        for b in batches:
            own, rows = [], []
            for i, named in enumerate(zip(*b.columns[1:])):
                lexemes = [Counter(analysis.lexemes(x.as_py() or "")) for x in named]
                for field, found, only_shaped in zip(FIELDS, [*lexemes, lexemes[3]], [False] * 4 + [True]):
                    length, hits = counted(found, only_shaped)
                    if length:
                        own.append(i)
                        rows.append((field, length, hits))
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), *columns], ["doc_id", "field", "length", "hits"])

    p = F.col(path)
    named = docs.select(F.col(key).alias("doc_id"), text.file_name(p).alias("name"), p.alias("path"), text.extension(p).alias("extension"), F.col(content).alias("content"))
    schema = T.StructType([named.schema["doc_id"], *T._parse_datatype_string("field string, length bigint, hits array<struct<term: string, tf: bigint>>")])
    view = named.mapInArrow(run, schema).persist()
    posts = view.select("doc_id", "field", F.explode("hits").alias("h")).groupBy(F.col("h.term").alias("term"), "doc_id", "field").agg(F.sum("h.tf").alias("tf"))
    return posts, view.select("doc_id", "field", "length")


def heuristic_comments(content: str) -> list[str]:
    """Text behind the earliest of `//`, `#` and `/*` in a line; behind a line marker one character is skipped."""
    found: list[str] = []
    block: list[str] | None = None
    for line in content.splitlines():
        at = 0
        while at <= len(line):
            if block is not None:
                end = line.find("*/", at)
                if end < 0:
                    block.append(line[at:] + "\n")
                    break
                found.append("".join(block) + line[at:end])
                block, at = None, end + 2
                continue
            m = re.compile(r"/\*|//|#").search(line, at)
            if not m:
                break
            if m.group() == "/*":
                block, at = [], m.end()
                if line.find("*/", at) < 0:
                    block.append(line[at:] + "\n")
                    break
            else:
                found.append(line[m.start() + 1 :])
                break
    if block:
        found.append("".join(block))
    return found


def heuristic_strings(content: str) -> list[str]:
    """Literals in double, single or back quotes with backslash escapes; an open one at the end is dropped."""
    found, at = [], 0
    while (m := re.compile("[\"'`]").search(content, at)) and (whole := _LITERAL.match(content, m.start())):
        found.append(re.sub(r"\\([\s\S])", r"\1", whole[2]))
        at = whole.end()
    return found


_LITERAL = re.compile(r"([\"'`])((?:(?!\1)[^\\]|\\[\s\S])*)\1")
_Capture = tuple[str, str, int, int]

_COMMON = {
    "string_literals": r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'",
    "comments": r"//[^\n]*|/\*[\s\S]*?\*/",
}
_SYNTAX = {
    "rust": {
        "symbols": r"\b(?:fn|struct|enum|trait)\s+([A-Za-z_]\w*)|\bimpl\b(?:\s*<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)",
        "imports": r"^\s*(?:pub\s+)?use\s+[^;]+;",
        "comments": _COMMON["comments"],
        "string_literals": r"r#*\"[\s\S]*?\"#*|\"(?:[^\"\\]|\\[\s\S])*\"",
    },
    "javascript": {
        "symbols": r"\b(?:function\*?|class)\s+([A-Za-z_$][\w$]*)|^\s+(?:async\s+|static\s+)*(?!(?:if|for|while|switch|catch|return|function)\b)([A-Za-z_$][\w$]*)\s*\([^)\n]*\)\s*\{",
        "imports": r"^\s*import\s+[^;\n]+;?",
        "comments": _COMMON["comments"],
        "string_literals": _COMMON["string_literals"] + r"|`(?:[^`\\]|\\[\s\S])*`",
    },
    "go": {
        "symbols": r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)|^\s*type\s+([A-Za-z_]\w*)",
        "imports": r"^\s*import\s+(?:\([^)]*\)|[^\n]+)",
        "comments": _COMMON["comments"],
        "string_literals": r"\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`",
    },
    "markdown": {"symbols": r"^#{1,6}[ \t]+([^\n]+)", "string_literals": r"^(?:```|~~~)[^\n]*\n[\s\S]*?^(?:```|~~~)[ \t]*$"},
}
_SYNTAX["typescript"] = _SYNTAX["javascript"] | {"symbols": _SYNTAX["javascript"]["symbols"] + r"|\b(?:interface|enum)\s+([A-Za-z_$][\w$]*)|\btype\s+([A-Za-z_$][\w$]*)\s*="}


def compile_syntax(kind: str) -> dict[str, re.Pattern]:
    """Compiled capture patterns of a file type; an unknown type is an error."""
    if kind == "python":
        return {}
    if kind not in _SYNTAX:
        raise ValueError(f"no syntax captures for {kind}")
    return {field: re.compile(p, re.M) for field, p in _SYNTAX[kind].items()}


def _python_captures(content: str) -> list[_Capture]:
    tree = ast.parse(content)
    starts = [0]
    for line in content.splitlines(keepends=True):
        starts.append(starts[-1] + len(line.encode()))
    found: list[_Capture] = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            head = content.encode()[starts[node.lineno - 1] :]
            at = starts[node.lineno - 1] + head.find(node.name.encode(), node.col_offset)
            found.append(("symbols", node.name, at, at + len(node.name.encode())))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            a, b = starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset
            found.append(("imports", content.encode()[a:b].decode(), a, b))
    for tok in tokenize.generate_tokens(io.StringIO(content).readline):
        if tok.type in (tokenize.COMMENT, tokenize.STRING):
            line = content.splitlines(keepends=True)
            a = starts[tok.start[0] - 1] + len(line[tok.start[0] - 1][: tok.start[1]].encode())
            found.append(("comments" if tok.type == tokenize.COMMENT else "string_literals", tok.string, a, a + len(tok.string.encode())))
    return found


def syntax_captures(kind: str, content: str) -> list[_Capture] | None:
    """`(field, text, start byte, end byte)` in order of position; None where the type has no captures or doesn't parse.

    Python is parsed; other languages are approximated by patterns, in which comments and strings hide what is in them.
    """
    if kind == "python":
        try:
            found = _python_captures(content)
        except (SyntaxError, ValueError, tokenize.TokenError):
            return None
    elif kind in _SYNTAX:
        patterns = compile_syntax(kind)
        order = [f for f in ("comments", "string_literals", "imports", "symbols") if f in patterns]
        found, hidden = [], []
        quoted = re.compile("|".join(f"(?P<{f}>{re.sub(r'\((?!\?)', '(?:', patterns[f].pattern)})" for f in order[:2] if f in ("comments", "string_literals")), re.M)
        for m in quoted.finditer(content):
            found.append((m.lastgroup, m.group(), m.start(), m.end()))
            hidden.append(m.span())
        for field in ("imports", "symbols"):
            for m in patterns[field].finditer(content) if field in patterns else ():
                g = next((i for i in range(1, (m.lastindex or 0) + 1) if m.group(i)), 0)
                a, b = m.span(g)
                if not any(x <= a < y for x, y in hidden):
                    found.append((field, content[a:b], a, b))
        byte = lambda i: len(content[:i].encode())
        found = [(f, t.strip(), byte(a) + len(t[: len(t) - len(t.lstrip())].encode()), byte(a) + len(t.rstrip().encode())) for f, t, a, b in found if t.strip()]
    else:
        return None
    if kind == "markdown" and (m := re.match(r"---\n([\s\S]*?)\n---", content)):
        found.append(("frontmatter", m[1].strip(), m.start(1), m.end(1)))
    return sorted(found, key=lambda f: (f[2], f[3], f[0]))


def captured(kind: str, body: str) -> list[tuple]:
    """`(field, text, start, end)` by syntax; by heuristics, without places, where a type has no captures or doesn't parse."""
    found = syntax_captures(kind, body)
    if found is None:
        found = [("comments", t, None, None) for t in heuristic_comments(body)] + [("string_literals", t, None, None) for t in heuristic_strings(body)]
    return found


def parsed_fields(docs: DataFrame, key: str, path: str, content: str, heuristics_only: bool = False) -> DataFrame:
    """`(doc_id, field, n, text, start, end)`: syntax captures, or comments and strings by heuristics without spans."""
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), (F.lit("") if heuristics_only else text.file_type(F.col(path))).alias("kind"), F.coalesce(content, F.lit("")).alias("content"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for doc, kind, body in zip(df["doc_id"], df["kind"], df["content"]):
                out += [(doc, f, n, t, a, b) for n, (f, t, a, b) in enumerate(captured(kind, body))]
            made = pd.DataFrame(out, columns=["doc_id", "field", "n", "text", "start", "end"])
            yield made.astype({"start": "Int64", "end": "Int64"})

    return source.mapInPandas(run, "doc_id bigint, field string, n int, text string, start bigint, end bigint")


def extracted_fields(docs: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """`(doc_id, path, field, text)` of the fields that a parser or the heuristics find; texts of one field are joined by line breaks.

    Only exportable features count, blank ones are left out. A document's features never leave its task.
    """
    source = docs.select(F.col(key).alias("doc_id"), F.col(path).alias("path"), text.file_type(F.col(path)).alias("kind"), F.coalesce(content, F.lit("")).alias("content"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for doc, where, kind, body in zip(df["doc_id"], df["path"], df["kind"], df["content"]):
                by: dict[str, list[str]] = {}
                for field, found, *_ in captured(kind, body):
                    if field in EXPORTABLE and found.strip():
                        by.setdefault(field, []).append(found)
                out += [(doc, where, field, "\n".join(found)) for field, found in by.items()]
            yield pd.DataFrame(out, columns=["doc_id", "path", "field", "text"])

    return source.mapInPandas(run, f"doc_id {docs.schema[key].dataType.simpleString()}, path string, field string, text string")


def all_fields(docs: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """`(doc_id, path, field, text)` of all ten fields; blank ones are left out."""
    return base_fields(docs, key, path, content).unionByName(extracted_fields(docs, key, path, content))


def analyzed_fields(fields: DataFrame) -> DataFrame:
    """`(doc_id, path, field, tokens)`, each field with the analyser of its file's type: code or prose."""
    code = text.uses_code_analyzer(text.file_type(F.col("path")), F.col("field"))
    marked = index.with_prose_tokens(fields.select("doc_id", "path", "field", "text", code.alias("_code")), F.when(~F.col("_code"), F.col("text")), "_prose")
    return marked.select("doc_id", "path", "field", F.when(F.col("_code"), text.code_tokens(F.col("text"))).otherwise(F.col("_prose")).alias("tokens"))
