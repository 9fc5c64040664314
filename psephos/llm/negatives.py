"""Hard-negative mining by exact integer products of tiles.

Vectors are packed into blocks: those of the anchors, and those of all rows.
Each pair of blocks is a tile, whose inner products come from one Strassen
multiplication in int64, sizes made even by zero padding; all additions are
integer, so products are exact. Of a tile only heaps go on: per anchor the best
rows of its label, and, once these are known, per anchor and positive the best
rows of other labels in the window of scores that the positive sets. Heaps of
tiles merge, in groups of bounded size, round by round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, cut, scratch

#: Rows of an anchor block, and of a block of all rows.
ANCHORS, ROWS = 1024, 4096
#: Blocks of rows that one task lays against an anchor block, and heaps that one task merges.
STRIPE, MERGED = 64, 64
#: Matrices with a side of this or less are multiplied directly.
DIRECT = 24
#: Columns of a tile whose scores go into the heaps at once.
COLUMNS = 512
#: Neither a score nor an id: an empty place in a heap. A null id counts as the largest.
NO_SCORE, NO_ID = -(1 << 63), (1 << 63) - 1
EXACT = 1 << 53

# -- products --------------------------------------------------------------


def _size(a: np.ndarray) -> int:
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in int64; by way of doubles where no sum can leave their exact range."""
    if _size(a) * _size(b) * max(1, a.shape[1]) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def padded(a: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if a.shape == (rows, columns):
        return a
    out = np.zeros((rows, columns), np.int64)
    out[: a.shape[0], : a.shape[1]] = a
    return out


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of int64 matrices by seven half-size products, down to DIRECT.

    Sums wrap modulo 2**64, so a result that fits int64 is exact whatever the
    sums on the way.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= DIRECT:
        return product(a, b)
    hm, hk, hn = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    a, b = padded(a, 2 * hm, 2 * hk), padded(b, 2 * hk, 2 * hn)
    a11, a12, a21, a22 = a[:hm, :hk], a[:hm, hk:], a[hm:, :hk], a[hm:, hk:]
    b11, b12, b21, b22 = b[:hk, :hn], b[:hk, hn:], b[hk:, :hn], b[hk:, hn:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * hm, 2 * hn), np.int64)
    out[:hm, :hn] = p1 + p4 - p5 + p7
    out[:hm, hn:] = p3 + p5
    out[hm:, :hn] = p2 + p4
    out[hm:, hn:] = p1 - p2 + p3 + p6
    return out[:m, :n]


# -- heaps -----------------------------------------------------------------


def empty_heap(rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids, best first, of ``rows`` heaps of ``k`` places."""
    return np.full((rows, k), NO_SCORE, np.int64), np.full((rows, k), NO_ID, np.int64)


def push(heap, row: np.ndarray, score: np.ndarray, vec: np.ndarray):
    """The heaps with (score, id) pairs added to their rows: higher scores, then smaller ids, stay."""
    rows, k = heap[0].shape
    r = np.r_[np.repeat(np.arange(rows), k), row]
    s, i = np.r_[heap[0].ravel(), score], np.r_[heap[1].ravel(), vec]
    order = np.lexsort((i, ~s, r))  # ~s descends as s ascends
    start = np.searchsorted(r[order], np.arange(rows))
    rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
    kept = order[rank < k]
    return s[kept].reshape(rows, k), i[kept].reshape(rows, k)


def merge(a, b):
    rows, k = b[0].shape
    return push(a, np.repeat(np.arange(rows), k), b[0].ravel(), b[1].ravel())


def push_tile(heap, scores: np.ndarray, vec: np.ndarray, fits):
    """The heaps with a tile's scores added where ``fits(scores, columns)``; only those that beat a heap's last are sorted."""
    for lo in range(0, scores.shape[1], COLUMNS):
        part, i = scores[:, lo : lo + COLUMNS], vec[lo : lo + COLUMNS]
        last, last_id = heap[0][:, -1:], heap[1][:, -1:]
        r, c = np.nonzero(((part > last) | ((part == last) & (i < last_id))) & fits(part, slice(lo, lo + COLUMNS)))
        if len(r):
            heap = push(heap, r, part[r, c], i[c])
    return heap


def windows(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that ``low`` and ``high`` percent of the positive's allow; none where there is no positive."""
    q, r = np.divmod(positive, 100)
    none = positive == NO_SCORE
    return np.where(none, 1, low * q - (-low * r) // 100), np.where(none, 0, high * q + (high * r) // 100)


# -- blocks ----------------------------------------------------------------


def pack(ids, labels, vectors) -> tuple:
    """(rows, width, kind, ids, labels, vectors) of Arrow arrays, components made floor(256 * x); shorter vectors are padded with 0."""
    lens = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(256 * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(lens.max(initial=0))
    out = np.zeros((len(lens), width), np.int64)
    out[np.arange(width) < lens[:, None]] = flat
    kind = next(k for k in ("int16", "int32", "int64") if np.iinfo(k).max >= _size(out))
    as_long = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
    return len(lens), width, kind, as_long(ids), as_long(labels), out.astype(kind).tobytes()


BLOCK = "n int, width int, kind string, ids binary, labels binary, vectors binary"


def unpack(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c: row[prefix + c]
    vectors = np.frombuffer(get("vectors"), get("kind")).reshape(get("n"), get("width"))
    return np.frombuffer(get("ids"), np.int64), np.frombuffer(get("labels"), np.int64), vectors.astype(np.int64)


def block_batch(rows: list[tuple], names: list[str]):
    import pyarrow as pa

    kinds = {"block": pa.int64(), "n": pa.int32(), "width": pa.int32(), "kind": pa.string()}
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.binary())) for c, k in zip(columns, names, strict=True)], names=names)


def usable(rows: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """``id, label, vec`` of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    own = rows.where(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).where(~F.exists(vec_col, bad))
    label = F.col(label_col).cast("bigint")
    return own.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec"),
    )


# -- Spark -----------------------------------------------------------------


def mine(
    rows: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    anchor_every: int = 100,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors among ``rows``.

    Anchors are the rows whose id ``anchor_every`` divides; their positives are
    the best other rows of their label, their negatives, for each positive, the
    best rows of other labels with ``low`` to ``high`` percent of its score.
    Scores are inner products of floor(256 * x), in int64; ties go by smaller
    id. Rows with a null label, a null vector, or a null or non-finite component
    take no part. A null id takes part, is never an anchor and comes last in
    ties. Shorter vectors are padded with 0, an empty one has scores of 0.
    Repeated rows are rows of their own, as anchors and as partners. Other
    columns are not read. Empty tables, and those without anchors, give no rows.
    """
    spark = rows.sparkSession
    own = usable(rows, id_col, label_col, vec_col)
    anchors = own.where((F.col("id") != NO_ID) & (F.col("id") % anchor_every == 0))
    with arrow_bytes(spark, "8m"), scratch() as kept:  # all that needs Python runs in here
        of_rows = cut(row_blocks(own))
        of_anchors = cut(anchor_blocks(anchors))
        n_blocks = of_rows.count()
        stripes = -(-n_blocks // STRIPE)
        stripe = F.pmod(F.xxhash64("ids", "vectors", F.monotonically_increasing_id()), F.lit(max(1, stripes)))
        of_rows = cut(of_rows.withColumn("stripe", stripe))
        best = cut(heaps(of_rows, of_anchors, stripes, positives + 1, None))
        mine_ = cut(own_positives(of_anchors, best, positives))
        found = cut(heaps(of_rows, mine_, stripes, negatives, (low, high)))
        out = cut(listed(mine_, found, positives, negatives))
        kept.append(out)
        return out


def row_blocks(own: DataFrame) -> DataFrame:
    """Blocks of up to ROWS rows, packed where they are read."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                yield block_batch([pack(*part.columns)], ["n", "width", "kind", "ids", "labels", "vectors"])

    return own.mapInArrow(run, BLOCK)


def anchor_blocks(anchors: DataFrame) -> DataFrame:
    """Blocks of about ANCHORS anchors, numbered; dealt by row, so that repeated anchors spread."""
    dealt = cut(anchors)
    count = dealt.count()
    key = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-count // ANCHORS) or 1))

    def run(key, table):
        import pyarrow as pa

        b = table.combine_chunks().to_batches()[0]
        return pa.Table.from_batches([block_batch([(b.column(0)[0].as_py(), *pack(*b.columns[1:]))], ["block", "n", "width", "kind", "ids", "labels", "vectors"])])

    return dealt.select(key.alias("block"), "id", "label", "vec").groupBy("block").applyInArrow(run, f"block bigint, {BLOCK}")


def heaps(of_rows: DataFrame, of_anchors: DataFrame, stripes: int, k: int, share: tuple[int, int] | None) -> DataFrame:
    """``block, scores, found`` (binary): each anchor's best ``k`` rows of its label, or, with ``share``, of others for each positive.

    A tile is a row of the join: an anchor block, sent to each stripe, and a
    block of rows, sent to each anchor block. The tiles of a stripe lie together
    and share their heaps.
    """
    blocks = [r[0] for r in of_anchors.agg(F.max("block")).collect()]  # one value
    if blocks[0] is None or not stripes:
        return of_anchors.sparkSession.createDataFrame([], "block bigint, scores binary, found binary")
    right = of_rows.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(blocks[0]))).alias("block"), *[F.col(c).alias(f"r_{c}") for c in ("n", "width", "kind", "ids", "labels", "vectors")])
    left = of_anchors.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(stripes - 1).cast("bigint"))))
    tiles = left.join(right, ["block", "stripe"])

    def run(batches):
        now, heap = None, None
        for b in batches:
            for at in range(b.num_rows):
                row = {c: b.column(i)[at].as_py() for i, c in enumerate(b.schema.names)}
                if (row["block"], row["stripe"]) != now:
                    if heap is not None:
                        yield heap_batch(*now, heap)
                    now, heap = (row["block"], row["stripe"]), None
                _, labels, a = unpack(row)
                ids, others, v = unpack(row, "r_")
                width = max(a.shape[1], v.shape[1])
                scores = strassen(padded(a, len(a), width), padded(v, len(v), width).T)
                if share is None:
                    heap = heap or [empty_heap(len(a), k)]
                    heap = [push_tile(heap[0], scores, ids, lambda s, c: labels[:, None] == others[c])]
                else:
                    positive = np.frombuffer(row["positive"], np.int64).reshape(len(a), -1)
                    least, most = windows(positive, *share)
                    heap = heap or [empty_heap(len(a), k) for _ in range(positive.shape[1])]
                    for j in range(positive.shape[1]):
                        fits = lambda s, c, j=j: (labels[:, None] != others[c]) & (s >= least[:, j : j + 1]) & (s <= most[:, j : j + 1])
                        heap[j] = push_tile(heap[j], scores, ids, fits)
        if heap is not None:
            yield heap_batch(*now, heap)

    out = tiles.mapInArrow(run, "block bigint, stripe bigint, scores binary, found binary")
    while True:
        stripes = -(-stripes // MERGED)
        out = out.withColumn("stripe", F.floor(F.col("stripe") / MERGED)).groupBy("block", "stripe").applyInArrow(lambda t: merged(t, k), "block bigint, stripe bigint, scores binary, found binary")
        if stripes <= 1:
            return out.drop("stripe")
        out = cut(out)


def heap_batch(block: int, stripe: int, heap: list):
    """One row: the heaps of an anchor block, one beneath the other."""
    import pyarrow as pa

    scores, found = (np.concatenate([h[i] for h in heap]).tobytes() for i in range(2))
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([stripe], pa.int64()), pa.array([scores], pa.binary()), pa.array([found], pa.binary())], names=["block", "stripe", "scores", "found"]
    )


def merged(table, k: int):
    import pyarrow as pa

    heap = None
    for s, i in zip(table.column("scores"), table.column("found"), strict=True):
        one = tuple(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, k) for x in (s, i))
        heap = one if heap is None else merge(heap, one)
    return pa.Table.from_batches([heap_batch(table.column("block")[0].as_py(), table.column("stripe")[0].as_py(), [heap])])


def own_positives(of_anchors: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """The anchor blocks with the ids (``who``) and scores (``positive``) of each anchor's ``k`` positives.

    The heaps hold one row more, as each anchor meets itself: one entry with its
    own id and score goes, or else the last.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            who, positive = [], []
            for at in range(b.num_rows):
                row = {c: b.column(i)[at].as_py() for i, c in enumerate(b.schema.names)}
                ids, _, a = unpack(row)
                scores, found = (np.frombuffer(row[c], np.int64).reshape(len(ids), k + 1) for c in ("scores", "found"))
                self_ = (found == ids[:, None]) & (scores == (a * a).sum(1)[:, None])
                gone = np.where(self_.any(1), self_.argmax(1), k)
                keep = np.arange(k + 1) != gone[:, None]
                who.append(found[keep].tobytes())
                positive.append(scores[keep].tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(who, pa.binary()), pa.array(positive, pa.binary())], names=[*b.schema.names[:-2], "who", "positive"])

    return of_anchors.join(best, "block").mapInArrow(run, f"block bigint, {BLOCK}, who binary, positive binary")


def listed(of_anchors: DataFrame, found: DataFrame, positives: int, negatives: int) -> DataFrame:
    """The heaps as rows."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(b.num_rows):
                ids, who, positive, scores, got = (np.frombuffer(b.column(i)[at].as_buffer(), np.int64) for i in range(5))
                who, positive = (np.repeat(x.reshape(len(ids), positives).T.ravel(), negatives) for x in (who, positive))
                anchor, rank = np.tile(np.repeat(ids, negatives), positives), np.tile(np.arange(1, negatives + 1, dtype=np.int32), positives * len(ids))
                use = scores != NO_SCORE
                name = lambda x: pa.array(x[use], mask=x[use] == NO_ID)
                columns = [pa.array(anchor[use]), name(who), pa.array(rank[use]), name(got), pa.array(positive[use]), pa.array(scores[use])]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    both = of_anchors.join(found, "block").select("ids", "who", "positive", "scores", "found")
    return both.mapInArrow(run, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
