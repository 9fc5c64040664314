import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from psephos.llm import merkle

from . import helpers

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        lo = at // 8 * 8
        out.append(("".join(level[lo:at]), "".join(level[at + 1 : lo + 8])))
        at //= 8
    return out


def brute(rows):
    """Sorted result rows by plain recursion over lists."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = siblings(trees[g], at) + siblings(top, k)
            folded = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                folded = leaf((*r[:4], None if r[4] is None else helpers.lower(r[4])))
            for a, b in path:
                folded = digest(a, folded, b)
            out.append((r[0], own, trees[g][-1][0], top[-1][0], digest(*[a + b for a, b in path]), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, merkle.manifest(df).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [9, 1], [65, 7, 64, 8, 1, 1, 1, 1, 2, 3], [600]])
def test_equals_brute_force(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(i, rng.choice([None, "a", "b"]), f"l{g}" if g else None, rng.choice([None, 5]), f"Text {i}" if i % 4 else f"text {i}") for i, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(df) == brute(rows)


def test_edge_rows(spark):
    """Null in every column, empty and long texts, repeated rows, other columns."""
    rows = [(i, None if i % 2 else "s", [None, "", "é", "en"][i % 4], None if i % 3 else i, t) for i, t in enumerate(helpers.EDGE_TEXTS)]
    rows += [rows[-1], rows[-1], (None, None, None, None, None), (None, "s", "en", 3, "Null Id"), *[(-i, "s", "en", 3, "Upper Case") for i in range(1, 8)]]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = [c for c in helpers.CLASH if c not in df.columns] + ["g", "pos", "leaf", "offered", "digest", "path"]
    got = result(df.withColumns({c: F.lit("clash") for c in taken}))
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


def test_only_a_tampered_text_fails(spark):
    rows = [(i, "s", "en", 1, "no capital" if i % 2 else "A Capital") for i in range(40)]
    for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.verified == (r.doc_id % 2 == 1 or zlib.crc32(str(r.doc_id).encode()) % 3 != 0)


def test_repeated_rows_do_not_fall_into_one_partition(spark):
    rows = spark.range(0, 4000, 1, 8).select(F.lit(1).alias("id"), F.lit("en").alias("lang"))
    small = "spark.sql.adaptive.coalescePartitions.enabled"  # so few rows would be put together
    spark.conf.set(small, "false")
    try:
        placed, runs = merkle.ranked(rows, "lang", ["id"])
    finally:
        spark.conf.unset(small)
    sizes = [r["count"] for r in placed.groupBy("__part").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1500
    ranks = placed.join(runs.drop("lang"), "__part").select(F.expr("__at - first + before").alias("r"), "n").collect()
    assert sorted(r.r for r in ranks) == list(range(4000)) and {r.n for r in ranks} == {4000}


def test_empty(spark):
    assert merkle.manifest(helpers.empty(spark, SCHEMA)).count() == 0
