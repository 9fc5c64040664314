"""Token counts by the whole-token shortcut.

The vocabulary's word-final strings are proved once, on the driver: a string
is a whole token if the merges, run over its characters, leave that one token.
A pre-token found among them counts as one; only the rest is merged. Counts of
space-separated units are remembered, as most units of a text are known ones.
"""

from __future__ import annotations

import json
import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NEVER, WHITE, merge_ranked

END = "</w>"
#: Words and units whose count a Python worker remembers; it starts anew beyond that.
CACHE = 500_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


def load(path: str) -> dict:
    """The tokenizer file's parts that counting needs; its size bounds what is sent to the executors."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
    return {
        "known": {},
        "words": {},
        "ranks": ranks,
        "whole": whole_tokens(model["vocab"], ranks),
        "special": [t["content"] for t in spec["added_tokens"]],
        "pattern": spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
    }


def whole_tokens(vocab, ranks) -> set[str]:
    """The word-final vocabulary strings, without their mark, that the merges leave as one token."""
    out = set()
    for s in vocab:
        if s.endswith(END) and len(s) > len(END):
            w = s[: -len(END)]
            if len(merge_word(w, ranks)) == 1:
                out.add(w)
    return out


def merge_word(letters: str, ranks) -> list[str]:
    return merge_ranked([*letters[:-1], letters[-1] + END], lambda a, b: ranks.get((a, b), NEVER))


def counter(parts: dict):
    """A function from a text to its number of tokens.

    A space always ends a pre-token and is no part of one, so the text is
    counted unit by unit between spaces.
    """
    ranks, whole, special, known = parts["ranks"], parts["whole"], parts["special"], parts["known"]
    words = parts["words"]
    letters = byte_letters()
    split = regex.compile(parts["pattern"].replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}]")).findall
    marks = regex.compile("|".join(map(regex.escape, special))) if special else None

    def of_word(w: str) -> int:
        n = words.get(w)
        if n is None:
            w2 = "".join([letters[b] for b in w.encode("utf-8", "surrogatepass")])
            n = 1 if w2 in whole else len(merge_word(w2, ranks))
            if len(words) >= CACHE:
                words.clear()
            if len(w) < 100:
                words[w] = n
        return n

    def lower(s: str) -> str:
        # character by character: no rule for a sigma at the end of a word
        return "".join(map(str.lower, s)) if "Σ" in s else s.lower()

    def of_unit(unit: str) -> int:
        n, pieces = 0, [unit]
        if marks is not None and any(s in unit for s in special):
            pieces = marks.split(unit)
            n = len(pieces) - 1
        for piece in pieces:
            n += sum(map(of_word, split(lower(unicodedata.normalize("NFC", piece)))))
        if len(known) >= CACHE:
            known.clear()
        if len(unit) < 100:
            known[unit] = n
        return n

    def of_text(text: str | None) -> int:
        n = 0
        for unit in text.split(" ") if text else ():
            k = known.get(unit)
            n += of_unit(unit) if k is None else k
        return n

    return of_text


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every whole text, a row for each row.

    ``path`` is a tokenizer file with a byte-level BPE with word ends, read on the
    driver. Null and empty texts have 0 bytes and tokens; repeated ids and rows
    are counted each; other columns are not read. Special strings inside a text
    count as one token each, as is the library's default.
    """
    parts = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        count = counter(parts.value)
        for b in batches:
            texts = b.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n_tokens = pa.array([count(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, n_tokens], names=[id_col, "n_bytes", "n_tokens"])

    ids = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = ids.schema[0].dataType.simpleString()
    out = ids.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
