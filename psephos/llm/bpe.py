"""Byte-level BPE: encoding by ranked merges over distinct words, decoding by joining pieces.

``encode_words`` is the fold as Spark higher-order functions with a literal rank
map. Bringing its result back to each occurrence needs a join of all word
occurrences, so whole texts go through ``encode_texts``: the same fold, in
Arrow batches, over the distinct words a task meets; those new in a slice of
rows are folded together (README has the figures).
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import NEVER, WHITE, Memory, frugal, let, merge_ranked, slices

#: Units whose encoding a Python worker remembers while it works on a partition.
CACHE = 300_000
#: Distinct units of texts that are looked through, and folded if new, at once.
GROUP = 30_000
#: Bytes of a word that may be folded over ids; longer ones go by a heap.
SHORT = 60
#: Slots of the literal rank map.
SLOTS = 1 << 16
#: More than any rank.
IDS = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank; the file's size bounds what is sent to the executors."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def load(path: str) -> tuple[dict[bytes, int], dict[int, int]]:
    """What the executors get: the ranks of tokens and of pairs of tokens."""
    ranks = load_ranks(path)
    return ranks, pair_ranks(ranks)


def pack(ranks: dict[bytes, int], pairs: dict[int, int]) -> tuple:
    """The two maps as bytes and arrays, which are small to keep."""
    import numpy as np

    numbers = (map(len, ranks), ranks.values(), pairs, pairs.values())
    return b"".join(ranks), *(np.fromiter(x, np.int64) for x in numbers)


def unpack(packed: tuple) -> tuple[dict[bytes, int], dict[int, int]]:
    tokens, lens, ids, pairs, joined = packed
    ends = lens.cumsum().tolist()
    ranks = {tokens[a:b]: r for a, b, r in zip([0, *ends], ends, ids.tolist())}
    return ranks, dict(zip(pairs.tolist(), joined.tolist(), strict=True))


def splitter(pattern: str):
    """``findall`` of the pattern with ``\\s`` as the Unicode property White_Space."""
    p = pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    return regex.compile(p).findall


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of what two tokens join to, by ``first id * IDS + second id``."""
    out = {}
    for whole, rank in ranks.items():
        for i in range(1, len(whole)):
            a, b = ranks.get(whole[:i]), ranks.get(whole[i:])
            if a is not None and b is not None:
                out[a * IDS + b] = rank
    return out


def fold_word(word: bytes, ranks: dict[bytes, int], pairs: dict[int, int] | None = None) -> list[int]:
    """The ids of one word.

    With ``pairs`` a short word is folded over ids, as a token's rank is its id.
    """
    if word in ranks:
        return [ranks[word]]
    get = ranks.get
    if pairs is None or len(word) > SHORT:
        return [ranks[p] for p in merge_ranked([word[i : i + 1] for i in range(len(word))], lambda a, b: get(a + b, NEVER))]
    ids = [get(word[i : i + 1]) for i in range(len(word))]
    joins = pairs.get
    open_ = [joins(a * IDS + b, NEVER) for a, b in zip(ids, ids[1:])]
    while open_ and (best := min(open_)) != NEVER:
        at = open_.index(best)
        ids[at] = best
        del ids[at + 1], open_[at]
        if at:
            open_[at - 1] = joins(ids[at - 1] * IDS + best, NEVER)
        if at < len(open_):
            open_[at] = joins(best * IDS + ids[at + 1], NEVER)
    return ids


def folder(ranks: dict[bytes, int], pairs: dict[int, int]):
    """``fold(words) -> ids of each``, as the bytes of an int array; ``fold_word`` for many short words at once.

    Words of as many parts are rows of one table. At each width every row joins
    its lowest pair, the leftmost on ties, and so is one part shorter; a row
    without a pair is done. Each word has at least two bytes.
    """
    import numpy as np

    of_byte = np.fromiter((ranks[bytes([i])] for i in range(256)), np.int32)
    keys = np.fromiter(pairs, np.int64)
    order = keys.argsort()
    keys = np.append(keys[order], np.int64(NEVER))  # a last one, so that every search ends at a key
    joined = np.append(np.fromiter(pairs.values(), np.int32)[order], np.int32(IDS))

    def join(a, b):
        pair = a.astype(np.int64) * IDS + b
        at = keys.searchsorted(pair)
        return np.where(keys[at] == pair, joined[at], np.int32(IDS))

    of_bytes = join(of_byte[:, None], of_byte[None, :])

    def fold(words: list[bytes]) -> list[bytes]:
        out, by_width = [b""] * len(words), {}
        for i, w in enumerate(words):
            by_width.setdefault(len(w), []).append(i)

        def done(who, ids):
            data, step = ids.tobytes(), 4 * ids.shape[1]
            for k, i in enumerate(who.tolist()):
                out[i] = data[k * step : (k + 1) * step]

        most = max(by_width, default=0)
        who, ids, open_ = np.empty(0, np.int64), np.empty((0, most), np.int32), np.empty((0, max(0, most - 1)), np.int32)
        for width in range(most, 1, -1):
            if fresh := by_width.get(width):
                raw = np.frombuffer(b"".join([words[i] for i in fresh]), np.uint8).reshape(-1, width)
                who = np.concatenate([who, np.array(fresh)])
                ids = np.concatenate([ids, of_byte[raw]])
                open_ = np.concatenate([open_, of_bytes[raw[:, :-1], raw[:, 1:]]])
            at = open_.argmin(1)
            best = open_[np.arange(len(at)), at]
            if len(ends := np.flatnonzero(best == IDS)):
                done(who[ends], ids[ends])
                on = np.flatnonzero(best != IDS)
                who, ids, open_, at, best = who[on], ids[on], open_[on], at[on], best[on]
            rows = np.arange(len(who))
            ids[rows, at] = best
            stay = np.ones(ids.shape, bool)
            stay[rows, at + 1] = False
            ids = ids[stay].reshape(len(rows), width - 1)
            stay = np.ones(open_.shape, bool)
            stay[rows, at] = False
            open_ = open_[stay].reshape(len(rows), width - 2)
            r = np.flatnonzero(at > 0)
            open_[r, at[r] - 1] = join(ids[r, at[r] - 1], best[r])
            r = np.flatnonzero(at < width - 2)
            open_[r, at[r]] = join(best[r], ids[r, at[r] + 1])
        done(who, ids)
        return out

    return fold


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids array<int>, decoded binary`` of every whole text, a row for each row.

    ``path`` is a rank file, read on the driver; ``pattern`` splits a text into
    words that are merged separately; no special tokens. ``decoded`` joins the
    byte pieces of the ids again. Null and empty texts give no ids and empty
    bytes; texts of any length are encoded whole; repeated rows and ids give a
    row each, a null id too; other columns are not read; an empty table gives no
    rows.
    """
    return _encode(docs, path, pattern, id_col, text_col, "ids array<int>, decoded binary", lambda ids, out: (ids.tolist(), out))


def digest_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_texts``, with digests in place of ids and bytes: ``id, n_tokens, ids_sha256, decoded_sha256``.

    A row for each row, null and repeated ids too; a null or empty text, of no
    tokens, has the empty string's digests; texts of any length are coded whole;
    other columns are not read; an empty table gives no rows.
    """
    sha, names = hashlib.sha256, []

    def digest(ids, out):
        if not names:
            names.extend(map(str, range(max(1 << 16, 1 + max(ids, default=0)))))
        return len(ids), sha(",".join([names[i] for i in ids]).encode()).hexdigest(), sha(out).hexdigest()

    return _encode(docs, path, pattern, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest)


def code_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text", memory: int = 100_000) -> DataFrame:
    """``docs`` with ``ids`` and ``n_tokens`` added, its text encoded and decoded again.

    Other columns stay as they are; columns of the two added names are replaced.
    A null text stays null, with no ids; an empty one stays empty. A Python
    worker remembers up to ``memory`` units, which changes its speed and space
    alone: whole rows pass here, after other stages, so it is less than ``CACHE``.
    For the same reason the maps it codes by last for a partition only: what
    Spark keeps in the worker between stages is the packed form.
    """
    fields = [f for f in docs.schema.fields if f.name not in ("ids", "n_tokens")]
    schema = StructType([*fields, StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())])
    state = docs.sparkSession.sparkContext.broadcast(pack(*load(path)))

    def run(batches):
        import pyarrow as pa

        ranks, pairs = unpack(state.value)
        _, encode_all, decode = coders(ranks, pattern, pairs, memory)
        for b in slices(batches):
            at = b.schema.get_field_index(text_col)
            ids, texts = [], []
            for t, i in encode_all(b.column(at).to_pylist()):
                ids.append(i)
                texts.append(None if t is None else decode(i).decode())
            cols = [pa.array(texts, b.schema.field(at).type) if k == at else c for k, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*cols, list_array(ids), pa.array(map(len, ids), pa.int64())], names=[*b.schema.names, "ids", "n_tokens"])

    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(frugal(run), schema)


def list_array(ids: list[array]):
    """The id arrays as one Arrow list array, without a Python object for each id."""
    import numpy as np
    import pyarrow as pa

    offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    flat = np.frombuffer(b"".join(ids), np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def coder(ranks: dict[bytes, int], pattern: str, pairs: dict[int, int] | None = None, memory: int = CACHE):
    """``encode(text) -> array of ids`` and ``decode(ids) -> bytes``."""
    encode, _, decode = coders(ranks, pattern, pairs, memory)
    return encode, decode


def coders(ranks: dict[bytes, int], pattern: str, pairs: dict[int, int] | None = None, memory: int = CACHE):
    """``encode`` and ``decode`` as ``coder`` has them, between them ``encode_all(texts) -> each text and its ids``.

    A space and the run after it split alike in any text, unless white space
    stands before the space. So texts are taken unit by unit, cut before each
    space; a text with such a place, or a space at its end, is split whole.
    ``encode_all`` first folds the new units of some texts together, then
    encodes these texts, whose units are remembered then.
    """
    find = splitter(pattern)
    units = Memory(memory)
    known, recall = units.get, units.put
    together = folder(ranks, pairs) if pairs is not None and all(bytes([i]) in ranks for i in range(256)) else None

    def fold(w: str) -> bytes:
        return array("i", fold_word(w.encode("utf-8", "surrogatepass"), ranks, pairs)).tobytes()

    def by_word(text: str) -> bytes:
        """Word by word; the words are remembered as units are."""
        ids = []
        for w in find(text):
            got = known(w)
            if got is None:
                got = fold(w)
                if len(w) < 100:
                    recall(w, got)
            ids.append(got)
        return b"".join(ids)

    def of_unit(unit: str) -> bytes:
        if unit.isalpha() or unit[1:].isalpha() and unit[0] == " ":  # most likely one word, remembered as the unit
            words = find(unit)
            if len(words) == 1:
                return fold(unit)
        return by_word(unit)

    def of_text(text: str) -> bytes:
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return by_word(text)
        young = units.young.get
        ids = [young(" " + u) for u in rest]
        if None in ids:
            for i, u in enumerate(rest):
                if ids[i] is None:
                    got = known(" " + u)
                    if got is None:
                        if not u or u[-1].isspace():
                            return by_word(text)
                        got = of_unit(" " + u)
                        if len(u) < 100:
                            recall(" " + u, got)
                    ids[i] = got
        return by_word(first) + b"".join(ids)

    def encode(text: str | None) -> array:
        ids = array("i")
        if text:
            ids.frombytes(of_text(text))
        return ids

    def learn(seen: set[str]):
        """Remembers the units of these runs after a space that are new, their words folded together."""
        young, old = units.young, units.old
        runs = (" " + u for u in seen if u and len(u) < 100 and not u[-1].isspace())
        split = {u: find(u) for u in runs if u not in young and u not in old}
        folded, apart, short, raw = {}, [], [], []
        for w in {w for words in split.values() for w in words}:
            if (got := known(w)) is not None:
                folded[w] = got
            elif (b := w.encode("utf-8", "surrogatepass")) in ranks or len(b) > SHORT:
                apart.append(w)
            else:
                short.append(w)
                raw.append(b)
        for w, got in (*zip(short, together(raw), strict=True), *zip(apart, map(fold, apart), strict=True)):
            folded[w] = got
            recall(w, got)
        for u, words in split.items():
            if words != [u]:
                recall(u, b"".join([folded[w] for w in words]))

    def encode_all(texts):
        group, seen = [], set()
        for t in texts:
            group.append(t)
            if t and together:
                seen.update(t.split(" ")[1:])
                if len(seen) > min(GROUP, units.half):
                    learn(seen)
                    yield from zip(group, map(encode, group))
                    group, seen = [], set()
        if seen:
            learn(seen)
        yield from zip(group, map(encode, group))

    piece = [b""] * (1 + max(ranks.values(), default=0))
    for b, r in ranks.items():
        piece[r] = b
    return encode, encode_all, lambda ids: b"".join(map(piece.__getitem__, ids))


def _encode(docs, path, pattern, id_col, text_col, columns, result):
    state = docs.sparkSession.sparkContext.broadcast(load(path))
    names = [id_col, *(c.split()[0] for c in columns.split(", "))]
    kinds = {"array<int>": "int32", "binary": "binary", "bigint": "int64", "string": "string"}
    types = [kinds[c.split()[1]] for c in columns.split(", ")]

    def run(batches):
        import pyarrow as pa

        _, encode_all, decode = coders(state.value[0], pattern, state.value[1])
        of = {"int32": pa.list_(pa.int32()), "binary": pa.binary(), "int64": pa.int64(), "string": pa.string()}
        for b in slices(batches):
            rows = [result(ids, decode(ids)) for _, ids in encode_all(b.column(1).to_pylist())]
            cols = [pa.array(c, of[k]) for c, k in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], of[k]) for k in types]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)

    ids = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return ids.mapInArrow(run, f"`{id_col}` {ids.schema[0].dataType.simpleString()}, {columns}")


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The rank file as a literal: an array of slots by hash, each the text ``,hex:rank,hex:rank,``.

    Indexing an array costs the same at any length, while a map literal is
    searched from its start for each lookup.
    """
    slots: list[list[str]] = [[] for _ in range(SLOTS)]
    for b, r in ranks.items():
        h = b.hex().upper()
        slots[zlib.crc32(h.encode()) % SLOTS].append(f"{h}:{r}")
    return F.split(F.lit("\n".join("," + ",".join(s) + "," for s in slots)), "\n")  # folded into a constant by the planner


def encode_words(words: DataFrame, ranks: dict[bytes, int], col: str = "word") -> DataFrame:
    """``word`` (distinct strings) with ``ids``, by higher-order functions only.

    Each word's bytes become an array of hex parts; ``aggregate`` folds at most
    (parts - 1) merges over it, each joining the leftmost pair of lowest rank.
    """
    slots = rank_map(ranks)

    def rank(h: Column) -> Column:
        slot = F.get(slots, (F.crc32(h.cast("binary")) % SLOTS).cast("int"))
        after = F.call_function("substring_index", slot, F.concat(F.lit(","), h, F.lit(":")), F.lit(-1))
        return F.when(after != slot, F.substring_index(after, ",", 1).cast("int"))

    def step(parts: Column, _) -> Column:
        def joined(best: Column) -> Column:
            at = best["at"]
            return F.when(best["rank"].isNull(), parts).otherwise(
                F.concat(F.slice(parts, F.lit(1), at - 1), F.array(F.concat(F.get(parts, at - 1), F.get(parts, at))), F.slice(parts, at + 2, F.size(parts)))
            )

        pairs = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
            lambda i: F.struct(rank(F.concat(F.get(parts, i - 1), F.get(parts, i))).alias("rank"), i.alias("at")),
        )
        return F.when(F.size(parts) < 2, parts).otherwise(let(F.array_min(F.filter(pairs, lambda p: p["rank"].isNotNull())), joined))

    hexed = F.hex(F.encode(F.col(col), "UTF-8"))
    parts = F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda i: F.substring(hexed, i, F.lit(2)))
    folded = F.aggregate(F.sequence(F.lit(1), (F.length(hexed) / 2).cast("int")), parts, step)
    whole = F.when(rank(hexed).isNotNull(), F.array(hexed)).otherwise(folded)
    return words.select(F.col(col), F.transform(whole, rank).alias("ids"))
