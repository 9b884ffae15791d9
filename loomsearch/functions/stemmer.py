"""The English stemmer of M. F. Porter's second algorithm, from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_V = "[aeiouy]"
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    for prefix in ("gener", "commun", "arsen"):
        if word.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        m = _REGION.search(word)
        r1 = m.end() if m else len(word)
    m = _REGION.search(word, r1)
    return r1, m.end() if m else len(word)


def _short_syllable_end(word: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.search(r"^[aeiouy][^aeiouy]$", word))


@lru_cache(100_000)
def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters, and words with other than a-z and ', stay as they are."""
    if len(word) <= 2 or not re.fullmatch("[a-z']+", word):
        return word
    word = word.removeprefix("'")
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    word = re.sub("^y", "Y", word)
    word = re.sub(f"({_V})y", r"\1Y", word)
    r1, r2 = _regions(word)

    # possessives
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith(("us", "ss")):
        pass
    elif word.endswith("s") and re.search(_V, word[:-2]):
        word = word[:-1]
    if word in _KEPT:
        return word
    # past and progressive forms
    if word.endswith(("eedly", "eed")):
        end = "eedly" if word.endswith("eedly") else "eed"
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if word.endswith(end):
                base = word[: -len(end)]
                if re.search(_V, base):
                    word = base
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif word.endswith(_DOUBLES):
                        word = word[:-1]
                    elif _short_syllable_end(word) and r1 >= len(word):
                        word += "e"
                break
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    for end, new in _STEP2:
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                if end == "ogi":
                    word = word[:-1] if word[-4:-3] == "l" else word
                elif end == "li":
                    word = word[:-2] if word[-3:-2] in tuple("cdeghkmnrt") else word
                else:
                    word = word[: -len(end)] + new
            break
    for end, new in _STEP3:
        if word.endswith(end):
            if len(word) - len(end) >= (r2 if end == "ative" else r1):
                word = word[: -len(end)] + new
            break
    for end in _STEP4:
        if word.endswith(end):
            if len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
                word = word[: -len(end)]
            break
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_syllable_end(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stemmed_stream(lexemes: list[list[str]]) -> list[str]:
    """Terms of the pieces of each lexeme, those marked `~` stemmed and those marked `=` not, each once in its lexeme."""
    return [t for pieces in lexemes for t in dict.fromkeys(stem(p[1:]) if p[0] == "~" else p[1:] for p in pieces)]
