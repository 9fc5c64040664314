"""N-gram Jaccard join by a token-group matrix.

Exact: two documents link when their shingle sets have the asked similarity,
and no link between different sets is lost.

1. Documents with equal sets form one class; only classes go on.
2. Similar classes are partitioned into groups: classes that agree in most of
   eight min-hashes with a leader are verified against it, and linked ones form
   groups. Any partition gives right results; a good one leaves little to do.
3. The matrix holds each group's tokens. Tokens are ordered by hash, very
   frequent ones last; a class queries with its first tokens, as many as must
   hold MEET percent of any set it links with, and finds the groups whose first
   tokens hold that many of them. A class whose first tokens reach very frequent
   ones takes only as many as must hold one, and finds the groups that hold one.
4. Of those, only groups whose token union covers enough of the query are
   opened: members of fitting size and parity sketch are verified exactly.
   Groups that link merge.

Token lists travel as binary blocks, one for each batch and share of the hash
range, not as rows. The number of shares grows with the tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_bytes, cut, frugal, scratch, slices

SEEDS = 8
#: Min-hashes of which a class and its leader must share to be verified.
AGREE = 4
#: A token counted in more documents than this counts as very frequent,
#: if it is among the MOST_FREQUENT: that bounds what is sent to the executors
#: (8 bytes each). The choice changes the order of tokens, never the result.
FREQUENT, MOST_FREQUENT = 10, 500_000
SKETCH = 512
#: Percent of a set's size that it must share, among the first tokens, with what it links with.
MEET = 4
#: Bits of the sketch of ids by which texts are read again, and ids up to which it is used.
ID_BITS, ID_MOST = 1 << 23, 1 << 20
#: Rows that a Python worker holds or hands over at once.
ROWS = 100_000
#: Bytes of token blocks that one share of the hash range should hold.
SHARE_BYTES = 32 << 20
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_SEEDS = np.arange(1, SEEDS + 1, dtype=np.uint64) * _C1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z lower-cased.

    A text of fewer words is one shingle, its whole sequence.
    """
    from xxhash import xxh3_64_intdigest

    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, w), np.uint64, len(w))
    m = max(1, len(w) - size + 1)
    used = min(size, len(w))
    acc = np.full(m, used, np.uint64)
    for j in range(used):
        acc = mix(acc * _C1 + h[j : j + m])
    return np.unique(acc)


def meet(n):
    """Tokens that two linked sets, the smaller of size n, must share among their first tokens."""
    return n * MEET // 100 + 1


def probe_length(n, percent: int, share=meet):
    """First tokens of a set of n that hold ``share(n)`` tokens of any set it links with."""
    return np.minimum(n, n - (percent * n + 99) // 100 + share(n))


def index_length(n, percent: int, share=meet):
    """The same for sets it links with that are not smaller."""
    return np.minimum(n, n - (2 * percent * n + 99 + percent) // (100 + percent) + share(n))


def one(n):
    return 1


def _describe(tokens: np.ndarray):
    """(class key, min-hashes, parity sketch) of a set."""
    seeds = [int(mix(tokens ^ s).min().astype(np.int64)) for s in _SEEDS]
    odd = np.packbits((np.bincount((tokens >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1).astype(np.uint8))
    return _key(tokens), seeds, odd.view(np.int64).tolist()


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: each node of ``edges`` (a, b) with the smallest node it reaches.

    Each round takes the smallest label among the neighbours, then the label's
    own label, so chains shorten by half or more.
    """
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a")).where("node <> to").distinct())
    label = cut(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("label")))
    while True:
        near = both.join(label.select(F.col("node").alias("to"), F.col("label").alias("l")), "to").groupBy("node").agg(F.min("l").alias("l"))
        new = label.join(near, "node").select("node", F.least("label", "l").alias("label"), F.col("label").alias("old"))
        up = label.select(F.col("node").alias("label"), F.col("label").alias("l"))
        new = cut(new.join(up, "label", "left").select("node", F.least("label", F.coalesce("l", "label")).alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        label = new.select("node", "label")
        if not changed:
            return label


def counted_shares(text_bytes: int, least: int, percent: int) -> int:
    """Shares of the hash range for the token counts of so many bytes of text: about SHARE_BYTES each.

    A word has some six bytes; of its tokens a set counts the first, 12 bytes each.
    """
    return max(12, least, int(text_bytes / 6 * 1.5 * (100 - percent + MEET) / 100 * 12) // SHARE_BYTES + 1)


class _Join:
    """One run of the join over (id, text)."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.spark, self.docs, self.size, self.percent = docs.sparkSession, docs, size, percent

    def describe(self) -> tuple[DataFrame, DataFrame]:
        """(id, n, key, seeds, odd) per row; blocks (share, tokens, counts) of tokens.

        Counted are the first tokens by hash of each set, and of the others
        those that come twice among a few thousand texts.
        """
        size, percent = self.size, self.percent
        # at most a token for each two bytes or so; less is counted
        letters = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one value
        shares = counted_shares(letters, int(self.spark.conf.get("spark.sql.shuffle.partitions")), percent)

        def run(batches):
            import pyarrow as pa

            names = ["id", "n", "key", "seeds", "odd", "share", "tokens", "counts"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary()]
            for b in slices(batches, 2000):
                rows, first, rest, seen = [], [], [], set()
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    t = shingle_set(text, size)
                    if not len(t):
                        rows.append((i, 0, None, None, None, None, None, None))
                        continue
                    rows.append((i, len(t), *_describe(t), None, None, None))
                    if rows[-1][2] not in seen:
                        seen.add(rows[-1][2])
                        cut_at = 3 * probe_length(len(t), percent) // 2 + 8
                        first.append(t[:cut_at])
                        rest.append(t[cut_at:])
                if first:
                    tokens, counts = np.unique(np.concatenate(first), return_counts=True)
                    later, often = np.unique(np.concatenate(rest), return_counts=True)
                    tokens, counts = np.r_[tokens, later[often > 1]], np.r_[counts, often[often > 1]]
                    share = (tokens % np.uint64(shares)).astype(np.int32)
                    order = np.argsort(share, kind="stable")
                    tokens, counts, share = tokens[order], counts[order].astype(np.int32), share[order]
                    at = np.flatnonzero(np.r_[True, share[1:] != share[:-1]])
                    for lo, hi in zip(at, [*at[1:], len(share)], strict=True):
                        rows.append((None, None, None, None, None, int(share[lo]), tokens[lo:hi].tobytes(), counts[lo:hi].tobytes()))
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], k) for k in types]
                yield pa.RecordBatch.from_arrays(cols, names=names)

        schema = "id bigint, n bigint, key bigint, seeds array<bigint>, odd array<bigint>, share int, tokens binary, counts binary"
        out = cut(self.docs.mapInArrow(frugal(run), schema))
        return out.where("share is null").select("id", "n", "key", "seeds", "odd"), out.where("share is not null").select("share", "tokens", "counts")

    def frequent(self, blocks: DataFrame) -> np.ndarray:
        """The most frequent of the counted tokens, sorted; at most MOST_FREQUENT."""

        def run(key, parts):
            import pandas as pd

            tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in parts["tokens"]])
            counts = np.concatenate([np.frombuffer(x, np.int32) for x in parts["counts"]])
            one, back = np.unique(tokens, return_inverse=True)
            total = np.bincount(back, counts).astype(np.int64)
            keep = total > FREQUENT
            return pd.DataFrame({"token": one[keep].astype(np.int64), "df": total[keep]})

        top = blocks.groupBy("share").applyInPandas(run, "token bigint, df bigint").orderBy(F.desc("df"), "token").limit(MOST_FREQUENT)
        return np.sort(np.array([r[0] for r in top.select("token").collect()], np.int64).astype(np.uint64))

    def sets(self, reps: DataFrame) -> DataFrame:
        """``rep, tokens`` (binary) of the documents whose id is in ``reps`` (rep), and perhaps some others.

        Up to ID_MOST ids, a bitmap of their hashes picks the texts where they
        are read, without a shuffle; beyond that, a semi-join does.
        """
        size = self.size

        def run(batches):
            import pyarrow as pa

            for b in slices(batches):
                tokens = [shingle_set(t, size).tobytes() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.binary())], names=["rep", "tokens"])

        ids = cut(reps.select(F.col("rep").alias("id")).distinct())
        if ids.count() > ID_MOST:
            return self.docs.join(ids, "id", "left_semi").mapInArrow(frugal(run), "rep bigint, tokens binary")
        bit = F.pmod(F.xxhash64("id"), F.lit(ID_BITS))
        # bitmaps count from 1
        maps = ids.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
        bits = np.zeros(ID_BITS // 8, np.uint8)
        for bucket, part in maps.collect():  # ID_BITS in all
            at = (bucket - 1) * len(part)
            bits[at : at + len(part)] = np.frombuffer(bytes(part), np.uint8)
        longs = F.split(F.lit(",".join(map(str, bits.view("<i8")))), ",").cast("array<bigint>")  # folded into a constant by the planner
        word = F.get(longs, F.shiftright(bit, 6).cast("int"))
        return self.docs.where(F.call_function("getbit", word, (bit % 64).cast("int")) == 1).mapInArrow(frugal(run), "rep bigint, tokens binary")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of class representatives that link."""
        percent = self.percent
        pairs = cut(pairs)
        sets = cut(self.sets(pairs.select(F.explode(F.array("a", "b")).alias("rep"))))

        def run(batches):
            import pyarrow as pa

            for b in slices(batches):
                keep = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    same = np.intersect1d(x, y, assume_unique=True).size
                    keep.append(100 * same >= percent * (len(x) + len(y) - same))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(frugal(run), "a bigint, b bigint")

    def fits(self, a: str, b: str):
        """Sizes that can link, and a parity sketch that allows it: each differing bit is a differing token."""
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        differ = sum((F.bit_count(F.col(f"{a}.odd")[i].bitwiseXOR(F.col(f"{b}.odd")[i])) for i in range(SKETCH // 64)), F.lit(0))
        near = 100 * F.least(n, m) >= self.percent * F.greatest(n, m)
        return near & ((100 + self.percent) * differ <= (100 - self.percent) * (n + m))

    def leaders(self, classes: DataFrame) -> DataFrame:
        """Pairs (a, b) of a class and a leader with which it shares a min-hash and probably links."""
        seeds = classes.select("rep", F.posexplode("seeds").alias("seed", "hash"))
        size = seeds.groupBy("seed", "hash").agg(F.count("*").alias("size")).where("size > 1")
        # of near copies, the one all others are copies of shares the most min-hashes
        central = seeds.join(size, ["seed", "hash"]).groupBy("rep").agg(F.sum("size").alias("shares"))
        me = F.struct(F.col("shares"), (-F.col("rep")).alias("first"), F.col("rep"), F.col("n"), F.col("seeds"), F.col("odd"))
        seeds = cut(classes.join(central, "rep").select(me.alias("c"))).select("c", F.posexplode("c.seeds").alias("seed", "hash"))
        leader = seeds.groupBy("seed", "hash").agg(F.max(F.struct("c.shares", "c.first", "c.rep")).alias("l"), F.count("*").alias("size"))
        leader = leader.where("size > 1").select("seed", "hash", F.col("l.rep").alias("rep")).join(classes, "rep").select("seed", "hash", F.struct("rep", "n", "seeds", "odd").alias("l"))
        agree = F.aggregate(F.zip_with("c.seeds", "l.seeds", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        pairs = seeds.join(leader, ["seed", "hash"]).where((F.col("c.rep") != F.col("l.rep")) & (agree >= AGREE) & self.fits("c", "l"))
        return pairs.select(F.col("c.rep").alias("a"), F.col("l.rep").alias("b")).distinct()

    def queries(self, classes: DataFrame, frequent: np.ndarray) -> DataFrame:
        """Distinct (q, g): classes and the other groups whose matrix rows hold enough of their first tokens.

        Of a class whose first tokens are none of them very frequent, no such
        token of a group matters; so the two ways below lose no link.
        """
        size, percent = self.size, self.percent
        sent = self.spark.sparkContext.broadcast(frequent)

        def first(batches):
            import pyarrow as pa

            hot = sent.value
            for b in slices(batches):
                keys, n_rare, out = [], [], []
                for text in b.column(1).to_pylist():
                    t = shingle_set(text, size)
                    if len(t):
                        keys.append(_key(t))
                        is_hot = hot[np.minimum(np.searchsorted(hot, t), len(hot) - 1)] == t if len(hot) else np.zeros(len(t), bool)
                        rare = t[~is_hot]
                        most = probe_length(len(t), percent)
                        if len(rare) < most:  # all the rare ones, then frequent ones as far as one must be met
                            rare = np.r_[rare, t[is_hot][: max(0, probe_length(len(t), percent, one) - len(rare))]]
                        out.append(rare[:most].tobytes())
                        n_rare.append(int(len(t) - is_hot.sum()))
                    else:
                        keys.append(None)
                        out.append(None)
                        n_rare.append(None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array(n_rare, pa.int64()), pa.array(out, pa.binary())], names=["id", "key", "rare", "first"])

        tokens = self.docs.mapInArrow(frugal(first), "id bigint, key bigint, rare bigint, first binary").where("key is not null")
        own = tokens.join(classes.select("key", F.col("rep").alias("id"), "n", "g"), ["key", "id"]).select(F.col("id").alias("rep"), "n", "g", "rare", "first")
        total = classes.agg(F.sum("n")).first()[0] or 0  # one value
        shares = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), int(total * (100 - percent) / 100 * 32) // SHARE_BYTES + 1)

        def spread(batches):
            import pyarrow as pa

            for b in batches:
                if not b.num_rows:
                    continue
                lists = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(4)]
                lens = np.array([len(x) for x in lists])
                rep, n, g, rare = (np.repeat(b.column(i).to_numpy(zero_copy_only=False), lens) for i in range(4))
                rank = np.concatenate([np.arange(k) for k in lens])
                tok = np.concatenate(lists)
                index = rank < np.where(rank < rare, index_length(n, percent), index_length(n, percent, one))
                n = np.where(rare < probe_length(n, percent), -n, n)  # negative: one token is enough
                share = (tok % np.uint64(shares)).astype(np.int64)
                order = np.argsort(share, kind="stable")
                share = share[order]
                at = np.flatnonzero(np.r_[True, share[1:] != share[:-1]])
                ends = [*at[1:], len(share)]
                cut_up = lambda v: [v[order[lo:hi]].tobytes() for lo, hi in zip(at, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(share[at].astype(np.int32)), *[pa.array(cut_up(v), pa.binary()) for v in (tok, rep, g, n.astype(np.int32), index)]],
                    names=["share", "tok", "rep", "g", "n", "idx"],
                )

        blocks = own.mapInArrow(frugal(spread), "share int, tok binary, rep binary, g binary, n binary, idx binary")

        def look_up(key, parts):
            import pandas as pd

            tok, rep, g, n, idx = (np.concatenate([np.frombuffer(x, k) for x in parts[c]]) for c, k in (("tok", np.uint64), ("rep", np.int64), ("g", np.int64), ("n", np.int32), ("idx", np.bool_)))
            order = np.lexsort((g, tok))
            tok, g = tok[order], g[order]
            at = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
            ends = np.r_[at[1:], len(tok)]
            shared = g[at] != g[ends - 1]  # tokens of two groups or more
            keep = np.repeat(shared, ends - at)
            order, tok, g = order[keep], tok[keep], g[keep]
            rep, n, idx = rep[order], n[order], idx[order]
            few, n = n < 0, np.abs(n)
            found = [np.empty((0, 4), np.int64)]
            if len(tok):
                # the matrix: a row for each token and group, with the sizes of the members that index it
                m = np.flatnonzero(idx)
                if len(m):
                    start = np.flatnonzero(np.r_[True, (tok[m][1:] != tok[m][:-1]) | (g[m][1:] != g[m][:-1])])
                    m_tok, m_g = tok[m][start], g[m][start]
                    low, high = np.minimum.reduceat(n[m], start), np.maximum.reduceat(n[m], start)
                    lo, hi = np.searchsorted(m_tok, tok, "left"), np.searchsorted(m_tok, tok, "right")
                    todo = np.cumsum(hi - lo)
                    at = 0
                    while at < len(tok):  # so many queries that few meetings are held at once
                        to = max(at + 1, int(np.searchsorted(todo, (todo[at - 1] if at else 0) + 4 * ROWS, "right")))
                        k = (hi - lo)[at:to]
                        q = np.repeat(np.arange(at, to), k)
                        r = np.arange(len(q)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[at:to], k)
                        ok = (m_g[r] != g[q]) & (low[r] <= n[q]) & (100 * high[r].astype(np.int64) >= percent * n[q].astype(np.int64))
                        pairs, count = np.unique(np.c_[rep[q[ok]], m_g[r[ok]], few[q[ok]]], axis=0, return_counts=True)
                        found.append(np.c_[pairs, count])
                        at = to
            out = np.concatenate(found)
            return pd.DataFrame({"q": out[:, 0], "g": out[:, 1], "few": out[:, 2], "shared": out[:, 3]})

        met = blocks.groupBy("share").applyInPandas(look_up, "q bigint, g bigint, few bigint, shared bigint").groupBy("q", "g").agg(F.max("few").alias("few"), F.sum("shared").alias("shared"))
        least = F.when(F.col("few") == 1, 1).otherwise(F.floor(F.ceil(F.col("n") * percent / 100) * MEET / 100) + 1)
        return met.join(classes.select(F.col("rep").alias("q"), "n"), "q").where(F.col("shared") >= least).select("q", "g").distinct()

    def qualify(self, found: DataFrame, classes: DataFrame) -> DataFrame:
        """Of (q, g), those whose group's token union holds enough of the query's tokens.

        A group of one needs no bound: opening it is one verification.
        """
        many = cut(classes.groupBy("g").agg(F.count("*").alias("members")).where("members > 1").select("g"))
        bound = cut(found.join(many, "g"))
        alone = found.join(many, "g", "left_anti").select("q", "g")
        members = classes.join(bound.select("g").distinct(), "g").select("g", "rep")
        sets = cut(self.sets(members.select("rep").union(bound.select("q"))))

        def tokens(batches):
            import pyarrow as pa

            for b in batches:
                for row in range(b.num_rows):
                    own = np.frombuffer(b.column(b.num_columns - 1)[row].as_buffer(), np.int64)
                    for at in range(0, len(own), ROWS):
                        part = pa.array(own[at : at + ROWS])
                        same = pa.array(np.full(len(part), row))
                        yield pa.RecordBatch.from_arrays([*[c.take(same) for c in b.columns[:-1]], part], names=[*b.schema.names[:-1], "token"])

        union = members.join(sets, "rep").select("g", "tokens").mapInArrow(frugal(tokens), "g bigint, token bigint").distinct()
        asked = bound.join(sets.withColumnRenamed("rep", "q"), "q").join(classes.select(F.col("rep").alias("q"), "n"), "q").select("q", "g", "n", "tokens").mapInArrow(frugal(tokens), "q bigint, g bigint, n bigint, token bigint")
        held = asked.join(union, ["g", "token"]).groupBy("q", "g", "n").count()
        return held.where(100 * F.col("count") >= self.percent * F.col("n")).select("q", "g").unionByName(alone)

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(rows with their class, label of each class that links)."""
        rows, blocks = self.describe()
        classes = cut(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("seeds").alias("seeds"), F.first("odd").alias("odd")))
        led = cut(self.verify(self.leaders(classes)))
        group = components(led)
        classes = cut(classes.join(group.withColumnRenamed("node", "rep"), "rep", "left").withColumn("g", F.coalesce("label", "rep")).drop("label", "seeds"))
        found = cut(self.queries(classes, self.frequent(blocks)))
        open_ = self.qualify(found, classes)
        me = F.struct("rep", "n", "odd")
        query = classes.select(F.col("rep").alias("q"), me.alias("x"))
        pairs = open_.join(query, "q").join(classes.select("g", me.alias("y")), "g").where(self.fits("x", "y"))
        more = self.verify(pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")))
        return rows.join(classes.select("key", "rep"), "key", "left").select("id", "n", "rep"), components(led.union(more))


def _key(tokens: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def join(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` per row of ``docs``.

    Texts link when 100 * intersection >= percent * union of their sets of
    ``size``-word shingles (A-Z lower-cased; a shorter text is one shingle).
    ``component_id`` is the smallest id reachable by links, its own included.
    Null and empty texts have no shingles and link with nothing. Rows of one id
    are texts of one document: all of them link, each row is returned. Rows with
    a null id are returned with a null component and link nothing. Ids are
    integers; other columns are not read. Sets are of 64-bit hashes.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    with arrow_bytes(docs.sparkSession, "4m"), scratch() as kept:  # all that needs Python runs in here
        rows, label = _Join(own.where("id is not null"), size, percent).links()
        rows, label = cut(rows), cut(label)
        kept += [rows, label]
    same = rows.where("rep is not null and rep <> id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    repeated = rows.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    if repeated:  # an id with several texts ties their classes together
        label = components(same.union(rows.join(label.withColumnRenamed("node", "rep"), "rep").select(F.col("rep").alias("a"), F.col("label").alias("b"))))
        out = rows.join(label.withColumnRenamed("node", "id"), "id", "left").select("id", "n", F.coalesce("label", "id").alias("c"))
    else:
        out = rows.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("id", "n", F.coalesce("label", "rep", "id").alias("c"))
    out = out.unionByName(own.where("id is null").select("id", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("c")))
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of linked documents, that with the smallest id.

    Of repeated rows of one id one stays, the first by text. Rows with a null id
    take part as documents by their text, after all ids. Documents without text
    link with nothing and stay. All columns are kept; an empty table stays empty.
    """
    by_text = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.col(text_col)), 2)
    keyed = docs.withColumn("__key", F.coalesce(F.col(id_col).cast("bigint"), by_text))
    found = cut(join(keyed.select("__key", F.col(text_col).alias("__text")), size, percent, "__key", "__text"))
    gone = found.where(F.col("component_id") != F.col("__key")).select(F.col("__key").alias("__gone")).distinct()
    left = keyed.join(cut(gone), F.col("__key") == F.col("__gone"), "left_anti")
    again = cut(found.groupBy(F.col("__key").alias("__again")).count().where("count > 1").select("__again"))
    if not again.isEmpty():
        once = keyed.join(again, F.col("__key") == F.col("__again"), "left_semi").join(gone, F.col("__key") == F.col("__gone"), "left_anti")
        first = once.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy(text_col))).where("__n = 1").drop("__n")
        left = left.join(again, F.col("__key") == F.col("__again"), "left_anti").unionByName(first)
    return left.drop("__key")
