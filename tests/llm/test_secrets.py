import hashlib
import random
import string
from collections import Counter
from math import log2

import pytest

from psephos.llm import secrets

from . import helpers

NAMES = ["password", "passwd", "secret", "token", "apikey", "api_key"]
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")


def brute_base(text):
    """Spans by stepping through the text character by character."""
    out = []
    at = 0
    while at < len(text):  # assign
        end = None
        for name in NAMES:
            piece = text[at : at + len(name)]
            if piece.isascii() and piece.lower() == name:
                i = at + len(name)
                i += text[i : i + 1] in ('"', "'")
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] not in (":", "="):
                    break
                i += 1
                while text[i : i + 1] == " ":
                    i += 1
                i += text[i : i + 1] in ('"', "'")
                start = i
                while i < len(text) and text[i] in VALUE:
                    i += 1
                if i > start:
                    end = i
                    if i - start >= 6:
                        out.append((at, "assign", i))
                break
        at = end or at + 1
    for kind, first, chars, least in (("access", "AKIA", string.ascii_uppercase + string.digits, 20), ("hex", "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            i = at + len(first)
            while text.startswith(first, at) and i < len(text) and text[i] in chars:
                i += 1
            if text.startswith(first, at) and i > at + len(first):
                if i - at >= least:
                    out.append((at, kind, i))
                at = i
            else:
                at += 1
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[1])))


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def random_text(rng):
    pieces = ["token", "TOKEN", "Passwd", "api_key", "apikey", "secret", '"', "'", " ", "  ", "=", ": ", "\n", "AKIA", "AKIAAKIA", "é", "ſecret", "toKen", "==", "a.b/c+d", "x" * 5]
    pieces += ["".join(rng.choices("0123456789abcdef", k=rng.choice([3, 10, 23, 24, 40]))), "".join(rng.choices(string.ascii_uppercase + string.digits, k=16)), "".join(rng.choices(string.ascii_letters, k=6))]
    return "".join(rng.choices(pieces, k=rng.randrange(1, 14)))


def test_base_equals_brute_force():
    rng = random.Random(1)
    hits = 0
    for _ in range(6000):
        text = random_text(rng)
        base, every = secrets.find(text)
        assert secrets.written(base) == written(brute_base(text)), text
        assert set(base) <= set(every)
        hits += len(base)
    assert hits > 1000


def test_entropy_equals_that_of_each_window():
    rng = random.Random(2)
    for n, size in ((20, 20), (45, 20), (7, 3), (5, 6)):
        run = "".join(rng.choices("abcdABCD0123", k=n))
        got = list(secrets.windows(run, size))
        assert [a for a, _ in got] == list(range(max(0, n - size + 1)))
        for at, bits in got:
            counts = Counter(run[at : at + size]).values()
            assert abs(bits + sum(c / size * log2(c / size) for c in counts)) < 1e-9


KEY = "q7ZtR2mX9vLpK4sWb8Hd"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (f"use {KEY} here", [KEY]),
        (f"({KEY}{KEY})", [KEY + KEY]),
        ("key A1B2C3D4E5F60718293A4B5C6D7E8F90", ["A1B2C3D4E5F60718293A4B5C6D7E8F90"]),
        ("das Donaudampfschifffahrtsgesellschaftskapitän", []),
        ("internationalization/localization-frameworks", []),
        ("CamelCaseIdentifierOfSomeLength", []),
        ("4111111111111111 and 00491234567890123456", []),
        ("550e8400-e29b-41d4-a716-446655440000", []),
        (f"sha256-{KEY}{KEY}", []),
        (f"commit: {KEY}", []),
        (f"https://x.example/{KEY}", []),
        ("EXAMPLEkey" + KEY, []),
        ("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaA1", []),
    ],
)
def test_entropy_spans_and_allow_list(text, found):
    assert [text[a:b] for a, k, b in secrets.find(text)[1] if k == 3] == found


def test_entropy_spans_give_way_to_fixed_patterns():
    text = f"token={KEY}"
    assert secrets.find(text) == ([(0, 0, len(text))], [(0, 0, len(text))])


def test_edge_rows(spark):
    texts = [*helpers.EDGE_TEXTS, f"é😀 token = {KEY}", "0123456789abcdef" * 2, "AKIA" + "Z9" * 8, helpers.LONG + f"password: {KEY}"]
    df, rows = helpers.docs(spark, texts)
    got = {(r.doc_id, r.spans, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secrets.scan(df).collect()}
    want = set()
    for i, t in rows:
        spans = brute_base(t or "")
        count = Counter(k for _, k, _ in spans)
        want.add((i, written(spans), hashlib.sha256(written(spans).encode()).hexdigest(), count["assign"], count["access"], count["hex"]))
    assert got == want and secrets.scan(df).count() == len(rows)


def test_empty(spark):
    assert secrets.scan(helpers.empty(spark)).count() == 0
