import os

from psephos.llm import jaccard
from psephos.llm.common import ARROW_BYTES, arrow_bytes, cut, frugal, lean_batches, scratch
from psephos.plans.sizing import checkpoint_dir


def folders(spark):
    top = checkpoint_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(top) if f.startswith("llm-")}


def test_scratch_removes_all_but_what_is_kept(spark):
    before = folders(spark)
    with scratch() as outer:
        with scratch() as kept:
            a = cut(spark.range(3))
            b = cut(a.withColumn("x", a["id"] + 1))
            kept.append(b)
        assert len(folders(spark) - before) == 1 and b.count() == 3
        c = cut(b)
        outer.append(c)
    assert len(folders(spark) - before) == 1 and c.count() == 3


def test_a_join_leaves_its_last_tables(spark):
    before = folders(spark)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words, f"x{i}"])) for i in range(20)]
    out = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85)
    assert {r.component_id for r in out.collect()} == {0}
    assert len(folders(spark) - before) == 2


def test_limits_of_batches_give_way_to_the_session(spark):
    before = spark.conf.getAll.get(ARROW_BYTES)
    try:
        spark.conf.unset(ARROW_BYTES)
        with arrow_bytes(spark, "3m"):
            assert spark.conf.getAll[ARROW_BYTES] == "3m"
        assert ARROW_BYTES not in spark.conf.getAll  # as it was
        lean_batches(spark, "2m")
        assert spark.conf.getAll[ARROW_BYTES] == "2m"
        lean_batches(spark, "1m")
        assert spark.conf.getAll[ARROW_BYTES] == "2m"
    finally:
        spark.conf.unset(ARROW_BYTES)
        if before is not None:
            spark.conf.set(ARROW_BYTES, before)


def test_frugal_hands_over_all_batches(spark):
    def twice(batches):
        for b in batches:
            yield from (b, b)

    df = spark.range(0, 100, 1, 3)
    assert sorted(r.id for r in df.mapInArrow(frugal(twice), "id bigint").collect()) == sorted([*range(100)] * 2)
    assert df.where("id < 0").mapInArrow(frugal(twice), "id bigint").count() == 0
