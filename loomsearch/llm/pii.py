"""Personal data found by anchor expansion.

An Aho-Corasick automaton finds anchors in the lower-cased text: at-signs, schemes, and identifier cues (digits, `+`,
`iban`, `www.`). A deterministic parser for the anchor expands to both sides and validates the boundaries: e-mail
addresses, web addresses, IPv4 addresses, phone numbers, social security numbers, payment cards (Luhn) and IBANs
(mod 97). Anchors are taken from left to right; one inside an accepted span is skipped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from loomsearch.llm import _shared

ANCHORS = {"@": "email", "://": "url", "www.": "www", "+": "phone", "iban": "iban", **{d: "digit" for d in "0123456789"}}
_OUT = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
_ASCII = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_LOCAL = _ASCII | frozenset("._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+")
_REST = re.compile(r"[^\s\"'<>`{}|\\^]+")
_STOP = re.compile("[/?#]")
_IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_SSN = re.compile(r"(\d{3})-(\d{2})-(\d{4})")
_INTL = re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}")
_LOCAL_PHONE = re.compile(r"\(\d{3}\) ?\d{3}[ .-]\d{4}")
_CARD = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5}")
_IBAN = re.compile(r"[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]){11,30}")

Found = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digit(text: str, i: int) -> bool:
    return 0 <= i < len(text) and text[i] in "0123456789"


def _free(text: str, start: int, end: int) -> bool:
    """No letter, digit, `_` or `@` next to the span, nor a point, hyphen or comma that joins it to a digit."""
    left, right = text[start - 1 : start], text[end : end + 1]
    if left and (left.isalnum() or left in "_@") or right and (right.isalnum() or right in "_@"):
        return False
    return not (left and left in ".-" and _digit(text, start - 2)) and not (right and right in ".-" and _digit(text, end + 1))


def _email(text: str, at: int) -> Found | None:
    low = at
    while low and at - low < 65 and text[low - 1] in _LOCAL:
        low -= 1
    if at - low > 64:  # a longer run is no local part
        return None
    local = text[low:at]
    cut = local.rfind("..")
    if cut >= 0:
        low += cut + 2
    while low < at and text[low] in ".-%+":
        low += 1
    if low == at or text[at - 1] == ".":
        return None
    m = _DOMAIN.match(text, at + 1, at + 400)
    if not m or m.end() - m.start() > 253:
        return None
    host = m.group()
    while "." in host and not (host.rpartition(".")[2].isalpha() and len(host.rpartition(".")[2]) > 1):
        host = host.rpartition(".")[0]
    if "." not in host:
        return None
    return "email", low, at + 1 + len(host)


_TRIMMED = ".,;:!?)]*"
_AUTHORITY = 1000  # characters; a user name may be before the host


def _trim(text: str, start: int, end: int) -> int:
    """The end without closing marks; a bracket that was opened behind `start` stays."""
    opened = closed = -1
    while end > start and text[end - 1] in _TRIMMED:
        if text[end - 1] == ")":
            if opened < 0:
                opened, closed = text.count("(", start, end), text.count(")", start, end)
            if opened >= closed:
                break
            closed -= 1
        end -= 1
    return end


def _host_ok(authority: str) -> bool:
    host = authority.rpartition("@")[2].partition(":")[0].rstrip(".")
    if _IP.fullmatch(host):
        return all(int(x) < 256 for x in host.split("."))
    return bool(_DOMAIN.fullmatch(host)) or host == "localhost"


class Runs:
    """The run of address characters round a place; all anchors in one run share the scan for its end."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.marks = text, 0, 0, 0

    def address(self, at: int) -> int:
        """The end of an address whose authority begins at `at`, or -1."""
        text = self.text
        if not self.start <= at < self.end:
            m = _REST.match(text, at)
            if not m:
                return -1
            self.start, self.end = at, m.end()
            self.marks = m.end()  # from here on the run has closing marks only
            while self.marks > at and text[self.marks - 1] in _TRIMMED:
                self.marks -= 1
        m = _STOP.search(text, at, min(self.end, at + _AUTHORITY))
        if not m and self.marks - at > _AUTHORITY:
            return -1
        stop = m.start() if m else self.end
        if not _host_ok(text[at : min(stop, self.marks)]):
            return -1
        end = _trim(text, at, self.end)
        return end if self.marks > stop or _host_ok(text[at : min(stop, end)]) else -1


def _url(text: str, at: int, runs: Runs) -> Found | None:
    low = at
    while low and at - low < 20 and (text[low - 1] in _ASCII or text[low - 1] in "+.-"):
        low -= 1
    while low < at and not (text[low] in _ASCII and text[low].isalpha()):
        low += 1
    if low == at or text[low - 1 : low].isalnum():
        return None
    end = runs.address(at + 3)
    return ("url", low, end) if end >= 0 else None


def _www(text: str, at: int, runs: Runs) -> Found | None:
    if at and (text[at - 1].isalnum() or text[at - 1] in "/.@_-"):
        return None
    end = runs.address(at)
    return ("url", at, end) if end >= 0 else None


def _phone(text: str, at: int) -> Found | None:
    m = _INTL.match(text, at)
    if m and 8 <= sum(c in "0123456789" for c in m.group()) <= 15 and not text[at - 1 : at].isalnum() and _free(text, at + 1, m.end()):
        return "phone", at, m.end()
    return None


def _iban_at(text: str, at: int) -> Found | None:
    m = _IBAN.match(text, at)
    if not m or at and (text[at - 1].isalnum() or text[at - 1] == "_"):
        return None
    end = m.end()
    while end - at >= 15:  # the longest valid cut, as words may follow
        plain = text[at:end].replace(" ", "").upper()
        if 15 <= len(plain) <= 34 and _free(text, at, end) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return "iban", at, end
        end -= 1
    return None


def _iban_cue(text: str, at: int) -> Found | None:
    low = at + 4
    while low < len(text) and low < at + 8 and text[low] in " :#=":
        low += 1
    return _iban_at(text, low)


def _digits(text: str, at: int) -> Found | None:
    """At the first digit of a run: an IPv4 address, SSN, card, bracketed phone number or IBAN."""
    if _digit(text, at - 1):
        return None
    m = _IP.match(text, at)
    if m and all(int(x) < 256 for x in m.group().split(".")) and _free(text, at, m.end()):
        return "ipv4", at, m.end()
    m = _SSN.match(text, at)
    if m and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000" and _free(text, at, m.end()):
        return "ssn", at, m.end()
    m = _CARD.match(text, at)
    if m and _free(text, at, m.end()):
        plain = re.sub(r"\D", "", m.group())
        if 13 <= len(plain) <= 19 and luhn(plain) and len(set(plain)) > 1:
            return "card", at, m.end()
    if at and text[at - 1] == "(":
        m = _LOCAL_PHONE.match(text, at - 1)
        if m and not text[at - 2 : at - 1].isalnum() and _free(text, at, m.end()):
            return "phone", at - 1, m.end()
    if at > 1 and text[at - 2 : at].isalpha() and text[at - 2 : at].isascii():
        return _iban_at(text, at - 2)
    return None


PARSERS: dict[str, Callable[[str, int], Found | None]] = {"email": _email, "phone": _phone, "iban": _iban_cue, "digit": _digits}
ADDRESSES: dict[str, Callable[[str, int, Runs], Found | None]] = {"url": _url, "www": _www}


def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word, kind in ANCHORS.items():
        made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


_anchors = _automaton()


def find(text: str) -> list[Found]:
    """`(kind, start, end)` in order of position, without overlaps."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if c.isascii() else c for c in text)
    out: list[Found] = []
    done = run = 0
    runs = Runs(text)
    for last, (kind, size) in _anchors.iter(low):
        at = last - size + 1
        if kind == "digit":
            fresh, run = at != run, at + 1  # one attempt for each run of digits
            if not fresh:
                continue
        if at < done:
            continue
        hit = PARSERS[kind](text, at) if kind in PARSERS else ADDRESSES[kind](text, at, runs)
        if hit and hit[1] >= done:
            out.append(hit)
            done = hit[2]
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(d, kind, s, e, t[s:e]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for kind, s, e in find(t)]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 5, _OUT)], schema=_OUT)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, kind, start, end, value)`: character spans [start, end) with personal data, none overlapping.

    Kinds: email, url, ipv4, phone, ssn, card, iban. By their standards, an e-mail's local part has 64 characters at
    most and a host name 253; longer ones are none. A narrow scan without shuffle, in time linear in the text. Rows
    with a null id or text, and empty texts, give nothing; equal rows give equal spans; other columns are ignored; an
    empty table gives no rows.
    """
    return _shared.narrow(docs, id_col, text_col).mapInArrow(_scan, "doc_id bigint, kind string, start bigint, end bigint, value string")


def redact(text: str) -> str:
    """`text` with each span replaced by its kind in angle brackets."""
    out, last = [], 0
    for kind, s, e in find(text):
        out += [text[last:s], f"<{kind.upper()}>"]
        last = e
    return "".join(out) + text[last:]
