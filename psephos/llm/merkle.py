"""Merkle dataset manifest: a content-addressed DAG, and proofs by descending it.

Each row is a leaf. Leaves of a group, in order, are hashed eight by eight
until one node remains; the groups' nodes, in the groups' order, likewise give
the root. The manifest stores a record for each inner node: its digest and its
children's digests. A proof for a leaf is found from the root alone: a leaf's
rank, in digits to the base eight, says which child to take at each record;
the children not taken are one segment of its path, and the segments reversed
lead from the leaf to the root. Requests with the same leading digits go down
together, so a record is opened once for all of them.

Ranks come from one range-sorted write, by sums over its partitions, so no task
holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut

FANOUT = 8
#: Bits of a row's number within its partition, in monotonically_increasing_id.
ROW_BITS = 33


def encode(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encode, values)), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` sorted and written with ``__part`` and ``__at``; and ``group, __part, first, before, n``.

    A row's rank in its group, from 0, is ``__at - first + before``; ``n`` is the
    group's size. Equal rows are dealt by where they were read, so a hot one
    does not land in one partition.
    """
    own = rows.withColumn("__read", F.monotonically_increasing_id())
    keys = [group, *order, "__read"]
    at = own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__read").withColumn("__id", F.monotonically_increasing_id())
    placed = cut(at.withColumns({"__part": F.shiftright("__id", ROW_BITS), "__at": F.col("__id").bitwiseAND((1 << ROW_BITS) - 1)}).drop("__id"))
    runs = placed.groupBy(group, "__part").agg(F.min("__at").alias("first"), F.count("*").alias("rows"))
    # a row for each group and partition: as many in a window as there are partitions
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"before": F.coalesce(F.sum("rows").over(earlier), F.lit(0)), "n": F.sum("rows").over(Window.partitionBy(group))})
    return placed, cut(runs.drop("rows"))


def parents(nodes: DataFrame) -> DataFrame:
    """``g, pos, n, digest, children`` of the level above ``nodes`` (g, pos, n, digest)."""
    runs = nodes.groupBy("g", F.floor(F.col("pos") / FANOUT).alias("pos")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("run"))
    children = F.col("run.digest")
    return runs.select("g", "pos", F.ceil(F.col("n") / FANOUT).alias("n"), F.sha2(F.concat_ws("", children), 256).alias("digest"), children.alias("children"))


def build(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(records of each height, from 1; ``g, digest, height`` of each group's top) of ``leaves`` (g, pos, n, digest).

    The number of levels is the logarithm of the largest group.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0  # one value
    records, tops, nodes = [], [], leaves
    while most > 1:
        tops.append(nodes.where("n = 1").select("g", "digest", F.lit(len(records)).alias("height")))
        nodes = cut(parents(nodes.where("n > 1")))
        records.append(nodes)
        most = -(-most // FANOUT)
    tops.append(nodes.where("n = 1").select("g", "digest", F.lit(len(records)).alias("height")))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return records, out


def descend(records: list[DataFrame], tops: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (g, pos and more) with the ``found`` digest and the ``path`` of segments from the top down.

    ``tops``: g, digest, height and the path so far. At each height the distinct
    leading digits of the requests take their child of the record that the
    digest names; a segment has the children left and right of it.
    """
    children = F.col("children")
    digit = (F.col("to") % FANOUT).cast("int")
    taken = F.get(children, digit)
    segment = F.struct(
        F.concat_ws("", F.slice(children, F.lit(1), digit)).alias("left"), F.concat_ws("", F.slice(children, digit + 2, F.lit(FANOUT))).alias("right")
    )
    longer = F.concat("path", F.array(segment)).alias("path")
    wanted = {1: cut(requests.select("g", F.floor(F.col("pos") / FANOUT).alias("to")).distinct())} if records else {}
    for h in range(2, len(records) + 1):
        wanted[h] = wanted[h - 1].select("g", F.floor(F.col("to") / FANOUT).alias("to")).distinct()
    start = lambda h: tops.where(F.col("height") == h).select("g", F.lit(0).cast("bigint").alias("pos"), "digest", "path")
    up = lambda rows: rows.withColumns({"of": F.col("g"), "up": F.floor(F.col("to") / FANOUT)}).drop("g")
    open_ = None
    for h in range(len(records), 0, -1):
        open_ = start(h) if open_ is None else open_.unionByName(start(h))
        # a digest may stand in several places of the tree, but its record is one
        record = records[h - 1].groupBy("digest").agg(F.first("children").alias("children"))
        opened = open_.join(record, "digest").select("g", "pos", "children", "path")
        below = up(wanted[h - 1]) if h > 1 else up(requests.withColumn("to", F.col("pos")).drop("pos"))
        open_ = opened.join(below, (F.col("g") == F.col("of")) & (F.col("pos") == F.col("up")))
        kept = [c for c in requests.columns if c not in ("g", "pos")] if h == 1 else []
        open_ = open_.select("g", F.col("to").alias("pos"), *kept, taken.alias("digest"), longer)
    alone = requests.join(start(0).drop("pos"), "g").select("g", "pos", *[c for c in requests.columns if c not in ("g", "pos")], "digest", "path")
    return (alone if open_ is None else open_.unionByName(alone)).withColumnRenamed("digest", "found")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its reversed path lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def prove(docs: DataFrame, group: str, order: str, digest: Column, offered: Column) -> DataFrame:
    """``order column, leaf, offered, subroot, root, path`` per row of ``docs``.

    ``digest`` is the leaf; the rows of a ``group``, its null one first, ascend
    by ``order``, ties by digest. ``offered`` is any other digest per row that a
    verifier may fold with the path. ``path``: segments (left, right) from the
    leaf up to the root. Repeated rows are leaves of their own. An empty table
    gives no rows.
    """
    rows = docs.select(F.col(order).alias("id"), F.col(group).alias("lang"), digest.alias("leaf"), offered.alias("offered"))
    placed, runs = ranked(rows, "lang", ["id", "leaf"])
    groups, spans = ranked(runs.where("before = 0").select("lang", "n").withColumn("all", F.lit(0)), "all", ["lang"])
    spans = spans.select(F.col("__part").alias("p"), (F.col("before") - F.col("first")).alias("shift"), F.col("n").alias("groups"))
    groups = cut(groups.join(spans, F.col("__part") == F.col("p")).select(F.col("lang").alias("of"), (F.col("__at") + F.col("shift")).alias("g"), "groups"))
    runs = runs.join(groups, F.col("lang").eqNullSafe(F.col("of"))).select("g", F.col("lang").alias("of"), F.col("__part").alias("p"), (F.col("before") - F.col("first")).alias("shift"), "n")
    leaves = placed.join(runs, (F.col("__part") == F.col("p")) & F.col("lang").eqNullSafe(F.col("of"))).select("g", (F.col("__at") + F.col("shift")).alias("pos"), "n", "id", "leaf", "offered")

    records, tops = build(leaves.select("g", "pos", "n", F.col("leaf").alias("digest")))
    tops = cut(tops)
    of_group = tops.join(groups.select("g", "groups"), "g").select(F.lit(0).cast("bigint").alias("g"), F.col("g").alias("pos"), F.col("groups").alias("n"), "digest", "height")
    of_group = cut(of_group)
    above, root = build(of_group.select("g", "pos", "n", "digest"))
    root = cut(root.select("g", F.col("digest").alias("root"), "height"))
    empty = F.array().cast("array<struct<left: string, right: string>>")
    starts = root.select("g", F.col("root").alias("digest"), "height", empty.alias("path"))
    of_group = descend(above, starts, of_group.select("g", "pos", F.col("height").alias("depth")))
    starts = cut(of_group.select(F.col("pos").alias("g"), F.col("found").alias("digest"), F.col("depth").alias("height"), "path"))
    subroots = tops.select(F.col("g").alias("of"), F.col("digest").alias("subroot"))
    requests = leaves.join(subroots, F.col("g") == F.col("of")).select("g", "pos", "id", "leaf", "offered", "subroot")
    digest_of_all = (root.first() or {"root": None})["root"]  # one row
    return descend(records, starts, requests).select(
        F.col("id").alias(order), "leaf", "offered", "subroot", F.lit(digest_of_all).cast("string").alias("root"), F.reverse("path").alias("path")
    )


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row of ``docs``.

    Leaves are of doc_id, source, lang, n_chars and text, grouped by lang. Where
    3 divides crc32 of the id, the verifier is offered the row with its text's
    A-Z lower-cased. Any of the five may be null (a null id is not tampered with
    and comes first); text may be empty or of any length. Other columns are not
    read.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaf = leaf_digest(*columns)
    offered = F.when(tampered, leaf_digest(*columns[:-1], F.translate("text", UPPER, LOWER))).otherwise(leaf)
    proofs = prove(docs, "lang", "doc_id", leaf, offered)
    siblings = F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    folded = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.col("offered"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
