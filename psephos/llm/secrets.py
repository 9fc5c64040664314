"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings.

Candidates are long runs of the characters keys are written in. A window slides
over each run of a character class within a candidate; its Shannon entropy
follows from the counts of its characters, which change by one character in and
one out at each step. Windows at or above the class's threshold join into spans.
Allow-listed candidates (words, numbers, published digests, placeholders) give
no span, and neither do spans that meet one of the fixed patterns.
"""

from __future__ import annotations

import hashlib
import re
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The patterns, with the least length of what must be long.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Without one of these a text has no assignment.
NAMES = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}", re.A)
#: Character classes: the run, its window and the least entropy of a window, in bits a character.
CLASSES = (
    (re.compile(r"[0-9a-f]{20,}|[0-9A-F]{20,}"), 20, 3.0),
    (re.compile(r"[A-Za-z0-9+/_=-]{20,}", re.A), 20, 3.7),
)
#: A window's characters must be of so many of: lower case, upper case, digits.
MIXED = 2
#: Candidates that are no secrets: words and names, numbers, UUIDs, published digests, placeholders.
ALLOWED = (
    re.compile(r"[A-Z]?[a-z]+(?:[/_=+-]+[A-Z]?[a-z]+)*|[A-Z]+(?:[/_=+-]+[A-Z]+)*|[A-Z]?[a-z]+(?:[A-Z][a-z]+)+"),
    re.compile(r"[0-9/_=+-]+"),
    re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),
    re.compile(r"(?:sha(?:1|224|256|384|512)|md5)[-_=].*", re.I),
    re.compile(r".*(?:EXAMPLE|example|placeholder|x{8}|X{8}|0123456789|abcdefgh|ABCDEFGH).*"),
    re.compile(r"(?:[a-z]+[/_=+-])*[a-z]+[0-9]{0,4}"),
)
#: What stands before an allowed candidate: a digest's or commit's name, a link.
ALLOWED_BEFORE = re.compile(r"(?:sha(?:1|224|256|384|512)|md5|commit|digest|checksum|integrity)\W{1,3}$|://\S*$", re.I)


def windows(run: str, size: int):
    """(start, entropy in bits a character) of each window of ``size`` characters."""
    part = [0.0, *(c * log2(c) for c in range(1, size + 1))]
    counts: dict[str, int] = {}
    total = 0.0  # of count * log2(count)
    for i, c in enumerate(run):
        if i >= size:
            gone = run[i - size]
            n = counts[gone]
            counts[gone] = n - 1
            total += part[n - 1] - part[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += part[n + 1] - part[n]
        if i >= size - 1:
            yield i - size + 1, log2(size) - total / size


def mixed(s: str) -> bool:
    return any(map(str.islower, s)) + any(map(str.isupper, s)) + any(map(str.isdigit, s)) >= MIXED


def high_entropy(text: str, allowed=ALLOWED, before=ALLOWED_BEFORE) -> list[tuple[int, int]]:
    """Spans of windows at or above their class's entropy, joined where they overlap or touch."""
    found: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        word = m[0]
        if any(a.fullmatch(word.strip("/_=+-")) for a in allowed) or before.search(text, max(0, m.start() - 200), m.start()):
            continue
        for runs, size, least in CLASSES:
            for r in runs.finditer(word):
                for at, bits in windows(r[0], size):
                    if bits >= least and mixed(r[0][at : at + size]):
                        start = m.start() + r.start() + at
                        found.append((start, start + size))
    out: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns, leftmost and without overlap in each kind."""
    out = []
    low = text.lower()
    if any(name in low for name in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if longest(text) >= LEAST_HEX:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    return out


def longest(text: str) -> int:
    """The length of the longest run without white space."""
    return max(map(len, text.split()), default=0)


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, by start, then kind."""
    base = sorted(base_spans(text))
    more = high_entropy(text) if longest(text) >= 20 else []
    return base, sorted(base + [(a, 3, b) for a, b in more if not any(s < b and a < e for s, _, e in base)])


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans`` of every whole text, a row for each row.

    Spans are ``kind:start:end`` in code points, the end exclusive, comma-joined;
    ``base_sha256`` is the digest of those of the fixed patterns. Null and empty
    texts have none (and the empty string's digest); texts of any length are
    read whole; a null id stays; repeated rows give a row each; other columns
    are not read. An empty table gives no rows.
    """

    def run(batches):
        import pyarrow as pa

        names = [id_col, "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"]
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, every = find(text or "")
                count = [sum(k == kind for _, k, _ in every) for kind in range(4)]
                rows.append((*count, hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, types, strict=True)]], names=names)

    own = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = own.schema[0].dataType.simpleString()
    return own.mapInArrow(run, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string")
