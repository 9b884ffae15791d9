"""Secrets found by lexing assignments.

The lexer reads source and configuration syntax into tokens (names, string literals, operators) and forms pairs of a
target name and a literal: `a = "x"`, `a: str = "x"`, `a := "x"`, `"a": "x"`, `a["b"] = "x"`, `a => "x"`, `f(a="x")`,
`A=x` of environment files and `a: x` of configuration files. Constants that a document assigned before are put in
for their names, and `+` or neighbouring literals are joined. The literal is scored by how sensitive its name is and
by its own look; placeholders count nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsearch.llm import _shared

_OUT = pa.schema([("doc_id", pa.int64()), ("name", pa.string()), ("literal", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

_PARTS = {
    '"': r"""(?:(?<![A-Za-z0-9_])[rRbBuUfF]{1,2})?\"(?:[^\"\\\n]|\\.)*\"""",
    "'": r"""(?<!\w)(?:[rRbBuUfF]{1,2})?'(?:[^'\\\n]|\\.)*'(?!\w)""",
}


@cache
def _lexer(closed: str) -> re.Pattern:
    """The tokens' pattern; strings are looked for with the quotes of `closed` only."""
    quoted = "|".join(_PARTS[q] for q in closed) + "|" * bool(closed)
    return re.compile(
        r"""(?P<string>(?<![A-Za-z0-9_])[rRbBuUfF]{0,2}(?:\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3})|"""
        + quoted
        + r"""(?<!\w)`[^`\n]*`)
    |(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:(?:\.|-|::)[A-Za-z_$][A-Za-z0-9_$]*)*)
    |(?P<op>:=|=>|==|!=|<=|>=|[-+*/|&]=|=|:|\+)
    |(?P<punct>[\[\](){},;])
    |(?P<line>\n)
    |(?P<other>[^\s\"'`=:+\[\](){},;]+|.)""",
        re.X,
    )


_OPEN = re.compile(r"'(?:[^'\\\n]|\\.)*")


def tokens(text: str) -> Iterator[re.Match]:
    """All tokens in order. A quote that isn't closed in its line hides none behind it.

    Neither is any later quote of its kind in that line, as each follows a backslash, so they are not tried again.
    """
    pos, dead = 0, {'"': -1, "'": -1}
    while pos < len(text):
        closed = "".join(q for q in dead if pos >= dead[q])
        until = min((dead[q] for q in dead if pos < dead[q]), default=len(text))
        again = None
        for m in _lexer(closed).finditer(text, pos):
            if m.start() >= until:
                again = m.start()
                break
            yield m
            quote = m.group()
            if m.lastgroup == "other" and quote in dead and quote in closed and (quote == '"' or not text.startswith("'", _OPEN.match(text, m.start()).end())):
                line = text.find("\n", m.start())
                dead[quote], again = len(text) if line < 0 else line, m.end()
                break
        if again is None:
            return
        pos = again


_BARE = re.compile(r"[ \t]*([^\s\"'`;,(){}\[\]<>]+)")
_ENDS = re.compile(r"[ \t]*(?:[ \t]#[^\n]*)?\r?(?:\n|$)")
_TELLING = 0.9
_CONSTANTS = 4  # constants put in for names have so many times the text's characters together at most
_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "api_key": 1.0,
    "private_key": 1.0, "access_key": 1.0, "secret_key": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "authorization": 0.8,
    "auth": 0.7, "signing_key": 1.0, "encryption_key": 1.0, "client_secret": 1.0, "connection_string": 0.8, "dsn": 0.7, "webhook": 0.6,
    "session": 0.5, "cookie": 0.5, "key": 0.5, "salt": 0.5, "pin": 0.5,
}
_PREFIX = re.compile(r"(AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-|sk_(live|test)_|eyJ[A-Za-z0-9_-]{10,500}\.|-----BEGIN ")
_PUBLIC = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE)")
_PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|your.*|change.?me.*|example.*|dummy.*|todo|none|null|true|false|test|placeholder.*|insert.*)$")


def name_weight(name: str) -> float:
    """Sensitivity of the most telling part, or pair of parts, of a name."""
    plain = re.sub(r"([a-z0-9])([A-Z])|([A-Z])([A-Z][a-z])", lambda m: f"{m[1] or m[3]}_{m[2] or m[4]}", name)
    parts = [p for p in re.split(r"[^A-Za-z0-9]+", plain.lower().replace("_", " ")) if p]
    whole = [*parts, *(f"{a}_{b}" for a, b in zip(parts, parts[1:])), *(a + b for a, b in zip(parts, parts[1:]))]
    return max((_WEIGHTS.get(p, _WEIGHTS.get(p.rstrip("s"), 0.0)) for p in whole), default=0.0)


def literal_weight(value: str, prose: bool = False) -> float:
    """0 for placeholders and, unless `prose`, for prose and under six characters; up to 1 for long strings of many different letters and digits."""
    if not value or len(value) < 6 and not prose or _PLACEHOLDER.match(value):
        return 0.0
    spaced = value.count(" ") > 2
    if _PREFIX.search(value) and not (spaced and _PUBLIC.search(value)):
        return 1.0
    if spaced and not prose:
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.1 + 0.5 * min(1.0, entropy / 3.5) + 0.2 * min(1.0, n / 20) + 0.1 * (kinds - 1))


class Words:
    """How often words stand in a text; counted once, when first asked for."""

    def __init__(self, text: str):
        self.text, self.counts = text, None

    def repeats(self, value: str) -> bool:
        if self.counts is None:
            self.counts = Counter(re.findall(r"\w+", self.text))
        parts = re.findall(r"\w+", value)
        if any(self.counts[p] < 2 for p in parts):
            return False
        return parts == [value] or len(re.findall(rf"(?<!\w){re.escape(value)}(?!\w)", self.text)) > 1


def _is_plain(text: str, name: str, sign: str, m: re.Match, words: Words) -> bool:
    """Whether a bare value without a digit is that of a setting: under a telling name, to the end of its line, and no code.

    With a space before `=`, as in code, a dotted word, or one that stands in the text more than once, is a reference.
    """
    if name_weight(name) < _TELLING or not _ENDS.match(text, m.end(1)):
        return False
    code = sign == "=" and text[m.start() - 2 : m.start() - 1].isspace()
    return not (code and (re.fullmatch(r"\w+(\.\w+)+", m[1]) or words.repeats(m[1])))


def score(name: str, value: str) -> float:
    weight = name_weight(name)
    look = literal_weight(value, weight >= _TELLING)
    return round(0.6 * weight + 0.4 * look, 6) if weight and look else round(0.7 * look, 6) if _PREFIX.search(value) else 0.0


def _value(raw: str) -> str:
    body = raw.lstrip("rRbBuUfF")
    quote = body[:3] if body[:3] in ('"""', "'''") else body[:1]
    inner = body[len(quote) : len(body) - len(quote)]
    return inner if raw[0] in "rR" or quote == "`" else re.sub(r"\\([\s\S])", r"\1", inner)


def pairs(text: str) -> Iterator[tuple[str, str, int, int]]:
    """`(name, literal, start, end)` of every assignment, [start, end) being the characters of its right side.

    Names stand for their constants as long as these have four times the text's characters together at most, which
    only texts that double constants line by line exceed; from there on, names end a literal.
    """
    toks = [(m.lastgroup, m.group(), m.start(), m.end()) for m in tokens(text) if not (m.lastgroup == "other" and m.group().isspace())]
    known: dict[str, str] = {}
    words = Words(text)
    budget = _CONSTANTS * len(text) + 4096
    n = len(toks)
    i = 0
    while i < n:
        kind, raw, start, _ = toks[i]
        if kind not in ("name", "string"):
            i += 1
            continue
        name, j = raw if kind == "name" else _value(raw), i + 1
        if kind == "string" and not re.fullmatch(r"[\w.$ -]+", name):
            i += 1
            continue
        if kind == "name" and j + 2 < n and toks[j][1] == "[" and toks[j + 1][0] == "string" and toks[j + 2][1] == "]":
            kind, name, j = "item", _value(toks[j + 1][1]), j + 3
        if j + 2 < n and toks[j][1] == ":" and toks[j + 1][0] == "name" and toks[j + 2][1] == "=":
            j += 2  # a type between name and sign
        if j >= n or toks[j][0] != "op" or toks[j][1] not in ("=", ":=", ":", "=>"):
            i += 1
            continue
        sign, at = toks[j], j + 1
        while at < n and toks[at][0] == "punct" and toks[at][1] == "(":
            at += 1
        parts, first, last, k = [], None, 0, at
        while k < n:
            t = toks[k]
            if t[0] == "string":
                parts.append(_value(t[1]))
            elif t[0] == "name" and t[1] in known and len(known[t[1]]) <= budget and not (k + 1 < n and toks[k + 1][1] in ("(", "=", ":")):
                parts.append(known[t[1]])
                budget -= len(known[t[1]])
            else:
                break
            first = t[2] if first is None else first
            last, k = t[3], k + 1
            if k < n and toks[k][1] == "+":
                k += 1
            elif not (k < n and toks[k][0] == "string"):
                break
        value = "".join(parts)
        if first is None:
            m = _BARE.match(text, sign[3]) if sign[1] in ("=", ":") else None
            if m and m.end(1) < len(text) and text[m.end(1)] == "(":
                m = None
            if m:
                word = m[1].rstrip(".!?")
                known_form = re.search("[0-9]", word) or _is_plain(text, name, sign[1], m, words)
                if len(word) >= (6 if name_weight(name) >= _TELLING else 8) and known_form and re.search("[A-Za-z]", word) and not word.startswith(("//", "$")):
                    value, first, last = word, m.start(1), m.start(1) + len(word)
        if first is None:
            i = j + 1
            continue
        if kind == "name":
            known[name] = value
        yield name, value, first, last
        i = j + 1
        if k < n and k + 1 < n and toks[k - 1][0] == "string" and k - 1 > j and toks[k][1] in ("=", ":", "=>"):
            i = k - 1  # the literal is itself a name, as in a line of settings
        elif k > j + 1:
            i = k


def find(text: str, least: float = 0.6) -> list[tuple[str, str, int, int, float]]:
    found = [(name, value, s, e, score(name, value)) for name, value, s, e in pairs(text)]
    return [f for f in found if f[4] >= least]


def _scan(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for hit in find(t, least)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 6, _OUT)], schema=_OUT)

    return run


def secrets(docs: DataFrame, least: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, name, literal, start, end, score)`: assignments whose score is `least` or more.

    A narrow scan without shuffle, in time linear in the text; texts without `=` and `:` hold no assignment and never
    reach Python. A quoted literal of any length counts under a telling name (weight 0.9 or more), one of six
    characters or more under others; a value without quotes counts from six and eight characters on, if it holds a
    letter. Rows with a null id or text, and empty texts, give nothing; equal rows give equal results; other columns
    are ignored; an empty table gives no rows.
    """
    texts = _shared.narrow(docs, id_col, text_col).where(F.col("text").contains("=") | F.col("text").contains(":"))
    return texts.mapInArrow(_scan(least), "doc_id bigint, name string, literal string, start bigint, end bigint, score double")
