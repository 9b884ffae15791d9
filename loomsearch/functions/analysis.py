"""The analysers of `text` in Python, for passes over whole texts.

A lexeme's tokens are kept in each worker, as most lexemes come again and again; the columns of `text` analyse each anew.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from loomsearch.functions.stemmer import stem

lexemes = re.compile("[A-Za-z0-9_-]+").findall
_PLAIN = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+").fullmatch
_CUTS = [re.compile(p) for p in (r"([a-z])([A-Z])", r"([A-Z])([A-Z][a-z])", r"([A-Za-z])([0-9])", r"([0-9])([A-Za-z])")]
_SEPARATORS = re.compile("[ _-]+")
KEPT, LONG = 1 << 18, 64  # lexemes that a worker keeps, and the most characters of one


class Kept(dict):
    """What `of` gives for each lexeme; emptied when it is full, so that memory is bounded."""

    def __init__(self, of: Callable, most: int = KEPT):
        self.of, self.most = of, most

    def __missing__(self, lexeme: str):
        value = self.of(lexeme)
        if len(lexeme) <= LONG:
            if len(self) >= self.most:
                self.clear()
            self[lexeme] = value
        return value


def identifier_parts(lexeme: str) -> list[str]:
    s = lexeme.rstrip("_-")
    for cut in _CUTS:
        s = cut.sub(r"\1 \2", s)
    tail = [lexeme[-1]] if lexeme in ("_", "-") or (len(lexeme) > 1 and lexeme[-1] in "_-" and lexeme[-2] in "_-") else []
    return [p for p in _SEPARATORS.split(s.lower()) if p] + tail


def identifier_stream(lexeme: str) -> tuple[str, ...]:
    """The lexeme, its parts joined, and its parts, each once."""
    if _PLAIN(lexeme):
        return (lexeme.lower(),)
    parts = identifier_parts(lexeme)
    return tuple(dict.fromkeys([lexeme.lower(), "".join(parts), *parts]))


def prose_stream(stops: list[str]) -> Callable[[str], tuple[str, ...]]:
    """By lexeme: surface forms of identifiers, then stems of the parts that aren't stop words, each once."""
    dropped = frozenset(stops)

    def of(lexeme: str) -> tuple[str, ...]:
        parts = [lexeme.lower()] if _PLAIN(lexeme) else identifier_parts(lexeme)
        surface = [lexeme.lower(), "".join(parts)] if len(parts) > 1 or "_" in lexeme or "-" in lexeme else []
        return tuple(dict.fromkeys([*surface, *(stem(p) for p in parts if p not in dropped)]))

    return of


def frequencies(text: str, kept: Kept) -> dict[str, int]:
    """Terms of a text with their counts."""
    found: dict[str, int] = {}
    for lexeme, n in Counter(lexemes(text)).items():
        for t in kept[lexeme]:
            found[t] = found.get(t, 0) + n
    return found


def stream(text: str, kept: Kept) -> list[str]:
    """Terms of a text in order."""
    return [t for lexeme in lexemes(text) for t in kept[lexeme]]
