"""Personal data and secrets against slow versions, and texts made to take long."""

import math
import random
import re
import time
from collections import Counter

import pytest

from loomsearch.llm import pii, secret_scan


def checksum(plain):
    total = 0
    for i, c in enumerate(plain[::-1]):
        d = int(c) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10


def kind_of(word):
    """The kind of a whole word by standards, without anchors and expansion; None if it is no personal data."""
    label = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
    host = rf"(?:{label}\.)+[A-Za-z]{{2,63}}"
    if re.fullmatch(rf"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{{0,62}}[A-Za-z0-9_%+-])?@{host}", word) and ".." not in word:
        return "email"
    labels = rf"{label}(?:\.{label})+"
    if re.fullmatch(rf"(?:https?|ftp)://{labels}(?:/[A-Za-z0-9/_=-]*)?", word) or re.fullmatch(rf"www\.{labels}(?:/[a-z0-9]*)?", word):
        return "url"
    if re.fullmatch(r"\d+(?:\.\d+){3}", word) and all(len(x) < 4 and int(x) < 256 for x in word.split(".")):
        return "ipv4"
    if (m := re.fullmatch(r"(\d{3})-(\d\d)-(\d{4})", word)) and m[1] not in ("000", "666") and int(m[1]) < 900 and int(m[2]) and int(m[3]):
        return "ssn"
    if re.fullmatch(r"\d{13,19}", word) and len(set(word)) > 1 and checksum(word) == 0:
        return "card"
    if re.fullmatch(r"[A-Z]{2}\d\d[A-Z0-9]{11,30}", word) and int("".join(str(int(c, 36)) for c in word[4:] + word[:4])) % 97 == 1:
        return "iban"
    return None


def some_word(r):
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda n: "".join(r.choice("abcxyz019") for _ in range(n))
    host = lambda: ".".join([name(r.randrange(1, 6)) for _ in range(r.randrange(1, 3))] + [r.choice(["com", "org", "de"])])
    made = r.randrange(9)
    if made == 0:
        return name(r.choice([1, 5, 64, 65, 90])) + "@" + host()
    if made == 1:
        return r.choice(["https", "ftp"]) + "://" + host() + r.choice(["", "/", "/a/b=1"])
    if made == 2:
        return "www." + host()
    if made == 3:
        return ".".join(str(r.choice([0, 7, 255, 256, 300])) for _ in range(4))
    if made == 4:
        return "-".join([r.choice(["000", "666", "123", "900"]), r.choice(["00", "45"]), r.choice(["0000", "6789"])])
    if made == 5:
        body = digits(r.choice([12, 15, 18]))
        return body + r.choice([str((10 - checksum(body + "0")) % 10), digits(1)])
    if made == 6:
        land, rest = r.choice(["DE", "GB"]), digits(18)
        good = 98 - int("".join(str(int(c, 36)) for c in rest + land) + "00") % 97
        return f"{land}{r.choice([good, good, 50]):02d}{rest}"
    return name(r.randrange(1, 9))


def test_personal_data_equals_the_slow_version():
    r, seen = random.Random(3), set()
    for _ in range(1500):
        words = [some_word(r) for _ in range(r.randrange(1, 8))]
        text, at, expected = "", 0, []
        for w in words:
            text += r.choice([" ", "\n", " (", " <"])
            if kind := kind_of(w):
                expected.append((kind, len(text), len(text) + len(w)))
                seen.add(kind)
            text += w + r.choice([" ", "\n", ", ", " é"])
        assert pii.find(text) == expected, text
    assert seen == {"email", "url", "ipv4", "ssn", "card", "iban"}


SENSITIVE = {"password": 1.0, "api_key": 1.0, "token": 1.0, "salt": 0.5, "title": 0.0, "colour": 0.0}


def slow_score(name, value):
    n = len(value)
    telling = SENSITIVE[name] >= 0.9
    if n < 6 and not telling or value == "null" or set(value) == {"x"} or value.count(" ") > 2 and not telling:
        return 0.0
    entropy = sum(-k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = any(c.islower() for c in value) + any(c.isupper() for c in value) + any(c.isdigit() for c in value) + any(not c.isalnum() for c in value)
    look = min(1.0, 0.1 + 0.5 * min(1.0, entropy / 3.5) + 0.2 * min(1.0, n / 20) + 0.1 * (kinds - 1))
    return round(0.6 * SENSITIVE[name] + 0.4 * look, 6) if SENSITIVE[name] and look else 0.0


def test_secrets_equal_the_slow_version():
    r, found = random.Random(4), 0
    for _ in range(800):
        lines, constants, expected, at = [], {}, [], 0
        for i in range(r.randrange(1, 9)):
            name = r.choice(list(SENSITIVE))
            value = r.choice(["null", "xxxxxxxx", "a b c d e f", "".join(r.choice("aZ09_kq") for _ in range(r.randrange(1, 24)))])
            style = r.randrange(6)
            head, tail = [(f"{name} = ", ""), (f"{name}: str = ", ""), (f'{{"{name}": ', "}"), (f'cfg["{name}"] = ', ""), (f"f({name}=", ")"), (f"{name} := ", ";")][style]
            right, whole = f'"{value}"', value
            if constants and r.random() < 0.3:
                known = r.choice(list(constants))
                right, whole = f'{known} + "{value}"', constants[known] + value
            elif r.random() < 0.2:
                right = f"'{value}'"
            if r.random() < 0.2:
                lines.append(r.choice(["don't mind this", 'an open " quote = here', "# note", 'x = "never closed']))
                at += len(lines[-1]) + 1
            if (s := slow_score(name, whole)) >= 0.6:
                expected.append((name, whole, at + len(head), at + len(head) + len(right), s))
            if style in (0, 1, 4, 5):
                constants[name] = whole
            lines.append(head + right + tail)
            at += len(lines[-1]) + 1
        assert secret_scan.find("\n".join(lines)) == expected, lines
        found += len(expected)
    assert found > 500


N = 1_000_000
HOSTILE = {
    "schemes": "a://" * (N // 4), "open schemes": "a://b.co(" * (N // 9), "closing": "http://ex.org/" + ")" * N, "mixed": "http://ex.org/(" + ").," * (N // 3), "signs": "@" * N, "labels": "a@" + "b." * (N // 2) + "c1", "digits in labels": "a@b.com" + ".1" * (N // 2),
    "local part": "x" * N + "@ex.org", "many local parts": ("x" * 60 + "@") * (N // 61), "digits": "1" * N, "dots": "1." * (N // 2), "iban": "iban" * (N // 4), "codes": "AB12" * (N // 4), "plus": "+1" * (N // 2), "www": "(www." * (N // 5),
    "escaped quotes": 'x = "' + '\\"' * (N // 2), "escaped single": "x = '" + "\\'" * (N // 2), "quotes": '"' * N, "three quotes": '"""' + "a" * N, "doubling": 'a = "abcdef12"\n' + "a = a + a\n" * (N // 10), "two names": 'a = "abcdef12"\n' + "b = a + a\na = b + b\n" * (N // 20),
    "settings": "".join(f"password = word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x{chr(97 + i // 676 % 26)}\n" for i in range(N // 18)), "web tokens": 'x = "' + "eyJ" * (N // 3) + '"', "brackets": "a = " + "(" * N, "equals": "=" * N, "names": "a-" * (N // 2), "backticks": "`a" * (N // 2),
}


@pytest.mark.parametrize("case", HOSTILE)
def test_hostile_texts_take_linear_time(case):
    text = HOSTILE[case]
    for find in (pii.find, secret_scan.find):
        began = time.process_time()
        find(text)
        assert time.process_time() - began < 5, find


def test_lengths_of_addresses():
    assert pii.find("a" * 64 + "@example.com") and not pii.find("a" * 65 + "@example.com")
    long = ".".join(["b" * 60] * 5)
    assert not pii.find(f"a@{long}.com")


def test_secrets_of_any_length():
    key = "k" * 200
    assert secret_scan.find(f'"{key}_password": "abcd"')[0][1] == "abcd"
    assert secret_scan.find('password = "ab1"') and not secret_scan.find('salt = "ab1"')
