"""LM scoring with a causal self-attention model.

Each word gets two classes from its subword ids: those of the longest
vocabulary pieces that begin and end it. A one-head attention model over the
classes of the words before predicts the next word's first class, and the
word's share of its class comes from corpus counts:

    p(word | before) = p(class | before) * (c + 1) / (N_class + V_class + 1)

Documents are dealt into blocks by hash, as many as the texts' size asks for,
so that neither a block nor its result depends on the cluster's settings. Pass
one, in each block: the words' training counts, and a model trained on all
training windows of the block from one common start; counts are then summed by
share of the hash range, models averaged by their tokens. Pass two brings each
block the corpus counts of its own words, and scores its documents: windows of
CONTEXT + STRIDE words overlap so that each word is scored once, with at least
CONTEXT words before it where the text has them. Nothing but the model and
per-class sums, whose sizes are fixed, passes through the driver.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import cut, scratch

CLASSES, TAILS, WIDTH = 64, 64, 12
CONTEXT, STRIDE = 16, 16
#: Windows of a training step, and windows scored at once.
BATCH, RATE = 128, 0.01
#: Bytes of text of a block, and of a share of the words.
BLOCK_BYTES = 3 << 20
#: The end of a text is a word of its own with its own class.
END_HASH, END_CLASS, START = np.uint64(0), CLASSES - 1, CLASSES


# -- words ---------------------------------------------------------------


def classes_of(word: bytes, ranks: dict[bytes, int], longest: int) -> tuple[int, int]:
    """Classes of the first and the last subword id of a word."""
    get = ranks.get
    first = last = get(word)
    if first is None:
        lens = range(min(len(word) - 1, longest), 0, -1)
        for k in lens:
            if (first := get(word[:k])) is not None:
                break
        for k in lens:
            if (last := get(word[-k:])) is not None:
                break
    return first * 40503 % 65536 % (CLASSES - 1), last * 40503 % 65536 % TAILS


class Words:
    """The distinct words of a block, numbered as they come; 0 is the end of a text."""

    def __init__(self):
        self.number = defaultdict(itertools.count().__next__)
        self.number[b""]  # asking for a word numbers it

    def add(self, text: str | None) -> np.ndarray:
        """The numbers of a text's tokens, the end included."""
        w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        w.append(b"")
        return np.fromiter(map(self.number.__getitem__, w), np.int32, len(w))

    def hashes(self) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        h = np.fromiter(map(xxh3_64_intdigest, self.number), np.uint64, len(self.number))
        h = np.maximum(h, np.uint64(1))
        h[0] = END_HASH
        return h


# -- model ---------------------------------------------------------------

SHAPES = {"emb": (CLASSES + 1, WIDTH), "tail": (TAILS + 1, WIDTH), "pos": (CONTEXT + STRIDE, WIDTH), "q": (WIDTH, WIDTH), "kv": (WIDTH, 2 * WIDTH), "out": (2 * WIDTH, CLASSES), "bias": (CLASSES,)}
ENDS = dict(zip(SHAPES, itertools.accumulate(map(math.prod, SHAPES.values())), strict=True))
SIZE = max(ENDS.values())


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Named views of one flat parameter array."""
    out, at = {}, 0
    for name, end in ENDS.items():
        out[name] = flat[at:end].reshape(SHAPES[name])
        at = end
    return out


def start_model() -> np.ndarray:
    rng = np.random.default_rng(7)
    flat = rng.normal(0, 0.3, SIZE).astype(np.float32)
    p = unpack(flat)
    p["bias"][:], p["out"][:] = 0, p["out"] * 0.1
    return flat


def windows(first: np.ndarray, last: np.ndarray, lens: np.ndarray):
    """Token positions of each window's targets, and what it sees.

    Texts are laid end to end. A window has STRIDE targets; its inputs are the
    tokens before each target and CONTEXT more, START where the text begins.
    Returns (target positions or -1, input classes, input tails, inputs in use).
    """
    begin = np.cumsum(lens) - lens
    per = -(-lens // STRIDE)
    text = np.repeat(np.arange(len(lens)), per)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * STRIDE
    off = at[:, None] + np.arange(STRIDE)
    target = np.where(off < lens[text][:, None], off + begin[text][:, None], -1)
    seen = at[:, None] + np.arange(-CONTEXT, STRIDE) - 1
    use = (seen >= -1) & (seen < lens[text][:, None])
    pos = np.where(seen >= 0, np.minimum(seen, lens[text][:, None] - 1) + begin[text][:, None], 0)
    inside = use & (seen >= 0)
    return target, np.where(inside, first[pos], np.uint8(START)), np.where(inside, last[pos], np.uint8(TAILS)), use


_CAUSAL = (np.arange(CONTEXT + STRIDE)[None, :] <= np.arange(CONTEXT, CONTEXT + STRIDE)[:, None]).astype(np.float32)
_SCALE = np.float32(WIDTH**-0.5)


def times(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``a @ w`` as one product of all rows, not one for each window."""
    return (a.reshape(-1, a.shape[-1]) @ w).reshape(*a.shape[:-1], w.shape[1])


def row_sums(a: np.ndarray) -> np.ndarray:
    return times(a, np.ones((a.shape[-1], 1), np.float32))


def weights(p: dict, x1, x2, use):
    """Weights of the classes of each window's targets, their sums, and what the backward pass needs.

    Exponents are kept below an overflow instead of shifted by their largest.
    """
    x = p["emb"].take(x1, 0)
    x += p["tail"].take(x2, 0)
    x += p["pos"]
    xq = x[:, CONTEXT:]
    kv = times(x, p["kv"])
    k, v = kv[:, :, :WIDTH], kv[:, :, WIDTH:]
    q = times(xq, p["q"])
    s = (q * _SCALE) @ k.transpose(0, 2, 1)
    np.exp(np.minimum(s, 60, out=s), out=s)
    s *= _CAUSAL
    if not use.all():
        s *= use[:, None, :]
    s /= row_sums(s)
    hx = np.concatenate([s @ v, xq], 2)
    z = times(hx, p["out"])
    z += p["bias"]
    np.exp(np.minimum(z, 60, out=z), out=z)
    return z, row_sums(z), (x, xq, q, k, v, s, hx)


def forward(p: dict, x1, x2, use):
    """Probabilities of the classes of each window's targets, and what the backward pass needs."""
    z, total, own = weights(p, x1, x2, use)
    z /= total
    return z, own


def gradient(p: dict, x1, x2, use, goal, mask) -> np.ndarray:
    """Gradient of the mean cross-entropy of the masked-in targets, flat."""
    d, (x, xq, q, k, v, s, hx) = forward(p, x1, x2, use)
    flat = np.zeros(SIZE, np.float32)
    g = unpack(flat)
    w, t = np.nonzero(mask)
    d[w, t, goal[w, t]] -= 1
    d *= mask[:, :, None] / np.float32(max(1, len(w)))
    flat2 = lambda a: a.reshape(-1, a.shape[-1])
    rows = flat2(d)
    g["bias"][:] = rows.sum(0)
    g["out"][:] = flat2(hx).T @ rows
    dhx = (rows @ p["out"].T).reshape(hx.shape)
    dh = dhx[:, :, :WIDTH]
    ds = dh @ v.transpose(0, 2, 1)
    ds -= row_sums(ds * s)
    ds *= s
    ds *= _SCALE
    back = ds.transpose(0, 2, 1)
    dq = ds @ k
    dkv = np.concatenate([back @ q, s.transpose(0, 2, 1) @ dh], 2)
    g["q"][:] = flat2(xq).T @ flat2(dq)
    g["kv"][:] = flat2(x).T @ flat2(dkv)
    dx = times(dkv, p["kv"].T)
    dx[:, CONTEXT:] += dhx[:, :, WIDTH:] + times(dq, p["q"].T)
    g["pos"][:] = dx.sum(0)
    for name, at in (("emb", x1), ("tail", x2)):
        # sums per class: rows sorted by class, added up run by run
        order = np.argsort(at.ravel(), kind="stable")
        size = np.bincount(at.ravel())
        own = np.flatnonzero(size)
        g[name][own] = np.add.reduceat(flat2(dx).take(order, 0), (np.cumsum(size) - size)[own])
    return flat


def train(first: np.ndarray, last: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The model after one Adam pass over all windows of the texts, in a fixed random order."""
    flat = start_model()
    p = unpack(flat)
    p["bias"][:] = np.log((np.bincount(first, minlength=CLASSES) + 1) / (len(first) + CLASSES))
    target, x1, x2, use = windows(first, last, lens)
    order = np.random.default_rng(11).permutation(len(target))
    target, x1, x2, use = (a[order] for a in (target, x1, x2, use))
    goal, mask = first[target], target >= 0
    m, v = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32)
    steps = -(-len(order) // BATCH)
    for step, at in enumerate(range(0, len(order), BATCH), 1):
        i = slice(at, at + BATCH)
        g = gradient(p, x1[i], x2[i], use[i], goal[i], mask[i])
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        rate = RATE * (1 - 0.9 * step / steps) * min(1.0, step / 10)
        flat -= np.float32(rate) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return flat


def class_logs(flat: np.ndarray, first: np.ndarray, last: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """log10 p(class | before) of each token, scored once."""
    p = unpack(flat)
    target, x1, x2, use = windows(first, last, lens)
    out = np.empty(len(first))
    for at in range(0, len(target), BATCH):
        t = target[at : at + BATCH]
        z, total, _ = weights(p, x1[at : at + BATCH], x2[at : at + BATCH], use[at : at + BATCH])
        w, j = np.nonzero(t >= 0)
        own = t[w, j]
        out[own] = np.log10(np.maximum(z[w, j, first[own]] / total[w, j, 0], 1e-30))
    return out


# -- Spark ---------------------------------------------------------------


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.

    Tokens are the words of the A-Z lower-cased text and one end. A row is held
    out from learning if crc32 of its id as text leaves 2 modulo 7; a null id is
    learned from. ``base_score`` is the add-one unigram log10 probability,
    ``score`` the model's. ``path``: a public rank file, for subword ids. Null
    and empty texts are one token, the end; texts of any length are scored
    whole; repeated rows count and are scored each; other columns are not read.
    An empty table gives no rows. The result does not depend on the number of
    shuffle partitions. Rows equal in id and text share a block.
    """
    spark = docs.sparkSession
    ranks = load_ranks(path)
    state = spark.sparkContext.broadcast((ranks, max(map(len, ranks))))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one value
    parts = int(size) // BLOCK_BYTES + 1
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int")
    own = own.select("id", "text", held.alias("held"), block.alias("block"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        ranks, longest = state.value
        words = Words()
        seqs = [words.add(text) for text in pdf["text"]]
        learned = ~pdf["held"].to_numpy(bool)
        lens = np.array([len(x) for x in seqs])
        at = np.concatenate(seqs)[np.repeat(learned, lens)]
        own = words.hashes()
        count = np.bincount(at, minlength=len(own)).astype(np.int64)
        pair = np.empty((len(own), 2), np.uint8)
        pair[0] = END_CLASS, 0
        for k, w in enumerate(words.number):
            if k:
                pair[k] = classes_of(w, ranks, longest)
        model = train(pair[at, 0], pair[at, 1], lens[learned]) if len(at) else start_model()
        share = (own % np.uint64(parts)).astype(np.int32)
        order = np.argsort(share, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(share[order]) != 0])
        rows = [(int(share[o[0]]), own[o].tobytes(), count[o].tobytes(), pair[o].tobytes(), None) for o in np.split(order, cuts[1:])]
        rows.append((None, None, None, None, model.astype(np.float32).tobytes()))
        out = pd.DataFrame(rows, columns=["share", "hash", "count", "pair", "model"])
        out["share"] = out["share"].astype("Int32")
        out["block"], out["weight"] = int(pdf["block"].iloc[0]), float(len(at))
        return out[["block", "share", "hash", "count", "pair", "model", "weight"]]

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(x, np.uint64) for x in pdf["hash"]]
        lens = np.array([len(x) for x in own])
        words, first, at = np.unique(np.concatenate(own), return_index=True, return_inverse=True)
        count = np.bincount(at, np.concatenate([np.frombuffer(x, np.int64) for x in pdf["count"]])).astype(np.int64)
        cls = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 2)[:, 0] for x in pdf["pair"]])[first]
        n, v = np.bincount(cls, count, CLASSES), np.bincount(cls, count > 0, CLASSES)
        back = np.split(count[at], np.cumsum(lens)[:-1])
        out = pd.DataFrame({"block": pdf["block"], "hash": pdf["hash"], "pair": pdf["pair"], "count": [x.tobytes() for x in back]})
        sums = pd.DataFrame({"block": [-1], "hash": [None], "pair": [np.r_[n, v].astype(np.float64).tobytes()], "count": [None]})
        return pd.concat([out, sums])

    with scratch() as kept:
        learned = cut(own.groupBy("block").applyInPandas(learn, "block int, share int, hash binary, count binary, pair binary, model binary, weight double"))
        model = average(learned.where("model is not null").select("model", "weight"))
        counts = learned.where("model is null").select("block", "share", "hash", "count", "pair")
        counted = cut(counts.groupBy("share").applyInPandas(total, "block int, hash binary, pair binary, count binary"))
        kept.append(counted)
    by_class = sum_vectors(counted.where("block = -1").select("pair"), 2 * CLASSES)
    n_class, v_class = by_class[:CLASSES], by_class[CLASSES:]
    n_all, v_all = n_class.sum(), v_class.sum()
    kind = docs.schema[id_col].dataType.simpleString()

    def rate(key, pdf: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        own = np.concatenate([np.frombuffer(x, np.uint64) for x in words["hash"]])
        count = np.concatenate([np.frombuffer(x, np.int64) for x in words["count"]])
        pair = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 2) for x in words["pair"]])
        order = np.argsort(own)
        own, count, pair = own[order], count[order], pair[order]
        found = Words()
        seqs = [found.add(t) for t in pdf["text"]]
        lens = np.array([len(x) for x in seqs])
        place = np.searchsorted(own, found.hashes())
        count, pair, at = count[place], pair[place], np.concatenate(seqs)
        c, cls = count[at], pair[at, 0]
        base = np.log10((count + 1) / (n_all + v_all + 1))[at]
        inside = np.log10((count + 1) / (n_class[pair[:, 0]] + v_class[pair[:, 0]] + 1))[at]
        full = class_logs(model, cls, pair[at, 1], lens) + inside
        text = np.repeat(np.arange(len(lens)), lens)
        per = lambda x: np.bincount(text, x, len(lens))
        return pd.DataFrame(
            {id_col: pdf["id"], "held_out": pdf["held"], "n_tokens": lens.astype(np.int64), "n_known": per(c > 0).astype(np.int64), "train_tokens": np.int64(n_all), "base_score": per(base), "score": per(full)}
        )

    words = counted.where("block >= 0")
    return own.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(
        rate, f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )


def sum_vectors(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of binary float64 vectors of one size, added up in tasks first."""

    def add(batches):
        import pyarrow as pa

        total = np.zeros(size)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "x"])

    sums = rows.mapInArrow(add, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # size rows
    out = np.zeros(size)
    for i, x in sums:
        out[i] = x
    return out


def average(models: DataFrame) -> np.ndarray:
    """The mean of the blocks' models (binary float32), weighted by their training tokens."""

    def weighted(batches):
        import pyarrow as pa

        for b in batches:
            out = [np.append(np.frombuffer(m.as_buffer(), np.float32).astype(np.float64), 1.0) * max(w, 1e-9) for m, w in zip(b.column(0), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in out], pa.binary())], names=["x"])

    total = sum_vectors(models.mapInArrow(weighted, "x binary"), SIZE + 1)
    return (total[:-1] / total[-1]).astype(np.float32) if total[-1] else start_model()
