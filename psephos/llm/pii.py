"""Surrogates for personal data and secrets.

Detected entities get keyed replacements of their own type and format. A
surrogate is a keyed permutation of the entity within its format (a Feistel
network over the digits and letters, each kept in its class, case and script),
so one entity has one surrogate in all documents and two entities of a format
never share one. The words of a name go by one keyed cycle: listed given names
within the list of their gender and script, all other words within their
pattern of vowels and consonants, past listed ones. A cycle has no fixed point
and is one-to-one, so names never collide and none stays as it is; a name in
capitals is the name itself, in capitals. Entities of different kinds are
checked against each other in each document.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import frugal, slices

#: Common given names by (script, gender).
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Carmen Claire Elena Emma Heidi Ingrid Isabel Julia Laura Linda Lucia Maria Marie Martha Mary Nina Olivia Paula Petra Rosa Sarah Sofia Susan Teresa Ursula Jennifer Elizabeth Patricia Jessica Karen Lisa Nancy Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Shirley Brenda Pamela Nicole Samantha Katherine Christine Helen Rachel Carolyn Janet Catherine Hannah Sabine Monika Brigitte Gisela Renate Helga Karin Katharina Susanne Nathalie Isabelle Sylvie Sophie Camille Chloé Hélène Françoise Monique Jacqueline Pilar Dolores Josefa Francisca Cristina Lucía Marta Beatriz".split(),
    ("latin", "m"): "Adam Andreas Anton Carlos Charles Daniel David Diego Edward Felix Frank Georg Hans Henri Jack James John Jorge Juan Karl Louis Luis Mark Martin Michael Oscar Paul Peter Robert Stefan Thomas William Joseph Christopher Matthew Anthony Donald Steven Andrew Kenneth Joshua Kevin Brian George Timothy Ronald Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Dennis Jerry Tyler Aaron Henry Klaus Jürgen Wolfgang Günter Dieter Uwe Heinz Helmut Manfred Matthias Tobias Sebastian Florian Pierre Philippe Jacques Nicolas François Laurent Olivier Antoine Guillaume José Antonio Manuel Francisco Javier Miguel Fernando Rafael Alejandro Pablo Sergio".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Сергей".split(),
}
#: Titles that precede a name, by gender.
TITLES = {"m": "Mr Mister Herr Monsieur Señor Sr г-н".split(), "f": "Mrs Ms Miss Frau Madame Mademoiselle Señora Sra г-жа".split(), "": "Dr Prof Professor".split()}

#: Classes of characters that a surrogate keeps, each with its members.
CLASSES = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7),
    "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7),
    "".join(map(chr, range(0x3B1, 0x3CA))),
    "".join(map(chr, range(0x430, 0x450))),
    "".join(map(chr, range(0x410, 0x430))),
    "".join(c for c in map(chr, range(0x100, 0x180)) if c.islower()),
    "".join(c for c in map(chr, range(0x100, 0x180)) if c.isupper()),
    "άέήίόύώ",
    "".join(chr(c) for c in range(0x391, 0x3AA) if c != 0x3A2),
    "".join(map(chr, range(0x450, 0x460))),
    "".join(map(chr, range(0x400, 0x410))),
]
HEX = ["0123456789abcdef", "0123456789ABCDEF"]
#: For names: vowels and consonants apart, so that words stay pronounceable.
SPOKEN = ["aeiou", "AEIOU", "bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ", *CLASSES[3:]]
#: Surrogates a Python worker remembers, and tries after a collision between kinds.
REMEMBERED, TRIES = 1 << 16, 100


def _ranges(chars: list[int]) -> str:
    """The code points as ranges of a regular expression's class."""
    starts = [c for c, before in zip(chars, [-2, *chars[:-1]], strict=True) if before != c - 1]
    ends = [c for c, after in zip(chars, [*chars[1:], -2], strict=True) if after != c + 1]
    return "".join(f"{chr(x)}-{chr(y)}" for x, y in zip(starts, ends, strict=True))


_UPPER = _ranges([c for c in range(0x41, 0x2000) if chr(c).isupper()])
_NAME = rf"(?:[{_UPPER}]['’])?[{_UPPER}][^\W\d_]+(?:['’-][{_UPPER}][^\W\d_]+)*"
_cases = lambda names: sorted({x for n in names for x in (n, n.upper())}, key=lambda n: (-len(n), n))
_TITLE = "|".join(map(re.escape, _cases(t for group in TITLES.values() for t in group)))
_GIVEN = "|".join(_cases(n for names in GIVEN.values() for n in names))

#: Kinds in order of precedence where matches overlap.
PATTERNS = {
    "secret": r"""(?i:\b(?:api[_-]?key|access[_-]?key|secret[_-]?key|secret|token|password|passwd|pwd))\s*[=:]\s*["']?(?P<secret>[^\s"'<>]{8,})|\b(?P<key>AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}|(?<![0-9a-fA-F])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9a-fA-F]))\b""",
    "email": r"(?P<email>[\w+%-]+(?:\.[\w+%-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})",
    "iban": r"\b(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b",
    "ip": r"(?<![\d.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d))(?!\.?\d)",
    "ip6": r"(?<![\w:.])(?P<ip6>(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?![\w:])",
    "card": r"(?<![\d-])(?P<card>\d{4}(?P<gap>[ -]?)\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{13,19}|3\d{3}[ -]\d{6}[ -]\d{5})(?![\d-])",
    "ssn": r"(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])",
    "phone": r"(?<![\w+])(?P<phone>\+\d{1,3}(?:(?:[ .-]|[#*$%&!|]{1,3} | \| )?\(?\d{1,4}\)?){2,5}|\(\d{3}\)(?: |[#*$%&!|]{1,3} | \| )?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|(?!\d{1,2}(?P<dot>[./-])\d{1,2}(?P=dot)\d{4}(?!\d))\(?0\d{1,5}\)?(?:[ ./-]{1,3}\d{2,8}){1,5}|0[1-9]\d{8,9}|[679]\d\d(?:(?: \d{3}){2}|(?: \d\d){3}))(?!\d)",
    "person": rf"(?:\b(?P<title>{_TITLE})\.? (?P<titled>{_NAME}(?: {_NAME}){{0,2}})|\b(?P<person>(?:{_GIVEN}) {_NAME}))\b",
}


def permute(key: bytes, tweak: str, value: str, classes: list[str] = CLASSES, cycle: bool = False) -> str:
    """``value`` with its characters permuted by the key within their classes.

    For one tweak and one pattern of classes this is a bijection: a Feistel
    network whose halves are numbers in the mixed radix of their classes. With
    ``cycle`` it is one cycle through all values of the pattern: the value that
    the network takes to the next number.
    """
    cls, at = [], []
    for i, c in enumerate(value):
        k = next((a for a in classes if c in a), None)
        if k is not None:
            cls.append(k)
            at.append(i)
    if not at:
        return value
    mark = list(value)
    for i, k in zip(at, cls, strict=True):
        mark[i] = f"\0{classes.index(k)}"
    tag = f"{tweak}\1{''.join(mark)}\1".encode("utf-8", "surrogatepass")
    digits = [k.index(value[i]) for i, k in zip(at, cls, strict=True)]
    radix = [len(k) for k in cls]
    cut = len(digits) // 2

    def number(lo, hi):
        n = 0
        for d, r in zip(digits[lo:hi], radix[lo:hi], strict=True):
            n = n * r + d
        return n

    def size(lo, hi):
        n = 1
        for r in radix[lo:hi]:
            n *= r
        return n

    left, right, m, n = number(0, cut), number(cut, len(digits)), size(0, cut), size(cut, len(digits))

    def add(turn: int, other: int) -> int:
        h = hashlib.blake2b(tag + f"{turn}\1{other}".encode(), key=key, digest_size=64).digest()
        return int.from_bytes(h * (1 + (m * n).bit_length() // 448), "big")

    for turn in range(10):
        if turn % 2 == 0:
            left = (left + add(turn, right)) % m
        else:
            right = (right + add(turn, left)) % n
    if cycle:
        left, right = divmod((left * n + right + 1) % (m * n), n)
        for turn in reversed(range(10)):
            if turn % 2 == 0:
                left = (left - add(turn, right)) % m
            else:
                right = (right - add(turn, left)) % n
    out = list(value)
    for lo, hi, x in ((0, cut, left), (cut, len(digits), right)):
        for j in range(hi - 1, lo - 1, -1):
            x, d = divmod(x, radix[j])
            out[at[j]] = cls[j][d]
    return "".join(out)


def folded(word: str) -> str:
    """A word in capitals as it is written otherwise, if capitals undo that; else the word."""
    if len(word) > 1 and word.isupper():
        plain = re.sub(r"[^\W\d_]+", lambda m: m[0][0] + m[0][1:].lower(), word)
        if len(plain) == len(word) and plain.upper() == word:
            return plain
    return word


def name_surrogate(key: bytes, word: str, given: dict[str, str]) -> str:
    """The surrogate of one word of a name; listed ones in ``given`` stay among themselves."""
    plain = folded(word)
    new = given.get(plain)
    if new is None:
        new = permute(key, "name", plain, SPOKEN, cycle=True)
        while new in given:  # ends, as the cycle comes back to the unlisted word itself
            new = permute(key, "name", new, SPOKEN, cycle=True)
    return new if plain == word else new.upper()


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    return -sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def is_ip6(value: str) -> bool:
    """Whether it is an address, and no name with ``::`` in program text."""
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return any(c.isdigit() for c in value) and sum(map(bool, value.split(":"))) > 1


def order(key: bytes, names: list[str]) -> dict[str, str]:
    """A keyed cycle through the names: none stays as it is."""
    ring = sorted(names, key=lambda n: hashlib.blake2b(n.encode(), key=key).digest())
    return dict(zip(ring, ring[1:] + ring[:1], strict=True))


def surrogate(key: bytes, kind: str, value: str, given: dict[str, str], again: int = 0) -> str:
    """The replacement of an entity; ``again`` counts the tries after it met one of another kind."""
    tweak = f"{kind}\1{again}"
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels, _, top = domain.rpartition(".")
        return f"{permute(key, f'{tweak}\1{domain}', local)}@{permute(key, 'domain', labels)}.{top}"
    if kind == "ip" and ":" in value:
        return permute(key, tweak, value, [HEX[1]]) if value == value.upper() else permute(key, tweak, value.lower(), [HEX[0]])
    if kind == "ip":
        bytes_ = [chr(0x4E00 + int(b)) for b in value.split(".")]
        return ".".join(str(ord(c) - 0x4E00) for c in permute(key, tweak, "".join(bytes_), ["".join(map(chr, range(0x4E00, 0x4F00)))]))
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        new = permute(key, tweak, digits[:-1])
        valid = luhn(digits[:-1]) == int(digits[-1])
        # an invalid number stays invalid by the same distance, so that numbers stay distinct
        new += str((luhn(new) + (0 if valid else int(digits[-1]) - luhn(digits[:-1]))) % 10)
        fill = iter(new)
        return re.sub(r"\d", lambda _: next(fill), value)
    if kind == "phone" and (m := re.match(r"\+\d{1,3}(?=\D)|\(?0", value)):
        return m[0] + permute(key, f"{tweak}\1{m[0]}", value[m.end() :])
    if kind in ("iban", "key") and (m := re.match(r"[A-Z]{2}(?=\d)|AKIA|gh[pousr]_", value)):
        return m[0] + permute(key, f"{tweak}\1{m[0]}", value[m.end() :])
    if kind in ("secret", "key"):
        for alphabet in HEX:
            if len(value) >= 16 and set(value) <= set(alphabet):
                return permute(key, tweak, value, [alphabet])
        return permute(key, tweak, value)
    if kind == "person":
        return " ".join(name_surrogate(key, w, given) for w in value.split(" "))
    return permute(key, tweak, value)


def replacer(key: bytes):
    """``replace(text) -> (new text, [(kind, start, length, surrogate)])``."""
    find = re.compile("|".join(PATTERNS.values())).finditer
    # cheap tests without which no pattern can match
    hint = re.compile(rf"[@\d=:]|\b(?:{_TITLE})\b|\b(?:{_GIVEN})\b").search
    given = {a: b for names in GIVEN.values() for a, b in order(key, names).items()}
    new_of = lru_cache(REMEMBERED)(lambda kind, value: surrogate(key, kind, value, given))

    def replace(text: str) -> tuple[str, list[tuple[str, int, int, str]]]:
        if not hint(text):
            return text, []
        hits = []
        for m in find(text):
            group = next(g for g in ("secret", "key", "email", "iban", "ip", "ip6", "card", "ssn", "phone", "titled", "person") if m[g])
            kind, value = {"titled": "person", "ip6": "ip"}.get(group, group), m[group]
            if group == "ip6" and not is_ip6(value):
                continue
            n = sum(c.isdigit() for c in value)
            if kind == "phone" and not 9 <= n <= 15 or kind == "card" and n != 16 and luhn(re.sub(r"\D", "", value)[:-1]) != int(value[-1]):
                continue
            hits.append((kind, m.start(group), value))
        if not hits:
            return text, []
        used, new = {}, {}
        # Within a kind no two entities meet; another kind's surrogate is avoided. Names come first and never change.
        for kind, v in sorted({(k, v) for k, _, v in hits}, key=lambda e: (e[0] != "person", e)):
            s = new_of(kind, v)
            for again in range(1, TRIES):
                if used.get(s, kind) == kind:
                    break
                s = surrogate(key, kind, v, given, again)
            used[s] = kind
            new[kind, v] = s
        out, at, spans = [], 0, []
        for kind, start, v in hits:
            out += [text[at:start], new[kind, v]]
            at = start + len(v)
            spans.append((kind, start, len(v), new[kind, v]))
        return "".join([*out, text[at:]]), spans

    return replace


def replace_entities(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with the entities in ``text_col`` replaced; adds ``n_entities`` and ``entities``.

    ``entities`` lists (kind, start and length in the old text, surrogate), in
    order. Null texts stay null with no entities; empty ones stay empty; texts of
    any length are read whole; rows, repeated ones too, and other columns are kept
    as they are (columns of the two added names are replaced); an empty table
    stays empty. One key gives one surrogate per entity in all documents, but for
    the rare entity whose surrogate another kind has taken in the document.
    """
    from pyspark.sql.types import ArrayType, IntegerType, StringType

    fields = [f for f in docs.schema.fields if f.name not in ("n_entities", "entities")]
    entity = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("length", IntegerType()), StructField("surrogate", StringType())])
    schema = StructType([*fields, StructField("n_entities", LongType()), StructField("entities", ArrayType(entity))])

    def run(batches):
        import pyarrow as pa

        replace = replacer(key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("surrogate", pa.string())]))
        for b in slices(batches):
            at = b.schema.get_field_index(text_col)
            done = [(None, []) if t is None else replace(t) for t in b.column(at).to_pylist()]
            spans = [[dict(zip(("kind", "start", "length", "surrogate"), x, strict=True)) for x in s] for _, s in done]
            cols = [pa.array([t for t, _ in done], b.schema.field(at).type) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind)], names=[*b.schema.names, "n_entities", "entities"])

    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(frugal(run), schema)
