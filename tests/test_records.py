"""Feeds with quoted line breaks, rows equal to leading lines and headers that collide."""

import csv
import os
import random

import pytest
from pyspark.sql import functions as F

from psephos.operators import prepoll as E
from psephos.sources import schemas
from psephos.sources.feeds import load_prepoll, read_feed
from psephos.sources.records import _states_before, opens_quote, whole_records
from tests.test_feeds import PP_HEADER, _write


@pytest.fixture()
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "512")
    yield
    spark.conf.set(key, old)


def _random_rows(rng, n):
    pieces = ["plain", "a,b", 'say ""x""', "two\nlines", "\n\n", '"', ",", "é", "", "x" * 90, "line\nwith \"quote\"\nand, comma\n"]
    return [["".join(rng.choices(pieces, k=rng.randrange(3))) for _ in range(3)] for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_records_equal_the_csv_module_at_any_split(spark, tmpdir_path, small_splits, seed):
    rng = random.Random(seed)
    paths, want = [], []
    for k in range(2):
        rows = _random_rows(rng, 300)
        path = os.path.join(tmpdir_path, f"f{k}.csv")
        with open(path, "w", newline="") as f:
            f.write('a "preamble, with an open quote\n')
            w = csv.writer(f, lineterminator="\n")
            w.writerow(["A", "B", "C"])
            w.writerows([*rows, ["A", "B", "C"], ["last", "row", "multi\nline"]])
        with open(path, newline="") as f:
            want += [tuple(r) for r in list(csv.reader(f.readlines()[1:]))[1:] if r]
        paths.append(path)
    df = read_feed(spark, paths, None)
    assert spark.read.text(paths).rdd.getNumPartitions() > 20
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_quote_marks_inside_plain_fields_open_nothing(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "q.csv"), ["pre", "A,B", 'O"Brien,1', 'x,5" pipe', 'y,"two\nlines"', '6" by 4",z'])
    assert sorted(tuple(r) for r in read_feed(spark, p, None).collect()) == [('6" by 4"', "z"), ('O"Brien', "1"), ("x", '5" pipe'), ("y", "two\nlines")]


def test_line_functions_compose(spark):
    """States before each line, for both states of entry, against a loop."""
    rng = random.Random(9)
    rows = [(i, rng.random() < 0.4, rng.random() < 0.6) for i in range(200)]
    from pyspark.sql import Window

    df = spark.createDataFrame(rows, "at int, out0 boolean, out1 boolean").withColumn("g", F.lit(1))
    got = {r["at"]: (r.in0, r.in1) for r in _states_before(df, Window.partitionBy("g").orderBy("at")).collect()}
    a, b = False, True
    for i, out0, out1 in rows:
        assert got[i] == (a, b)
        a, b = (out1 if a else out0), (out1 if b else out0)


def test_an_unclosed_quote_names_the_file(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "unclosed.csv"), ["pre", "A,B", 'x,"never', "closed"])
    with pytest.raises(ValueError, match="unclosed.csv"):
        read_feed(spark, p, None)
    q = _write(os.path.join(tmpdir_path, "header.csv"), ["pre", 'A,"B', 'C"', "1,2"])
    with pytest.raises(ValueError, match="header"):
        read_feed(spark, q, None)


def test_rows_equal_to_leading_lines_are_kept(spark, tmpdir_path):
    a = _write(os.path.join(tmpdir_path, "a.csv"), ["pre", "A,B", "1,2", "pre,", "A,B", "pre,x", "A,B"])
    b = _write(os.path.join(tmpdir_path, "b.csv"), ["A,B", "A,B", "3,4", "A,B"])  # its preamble is a's header
    got = sorted(tuple(r) for r in read_feed(spark, [a, b], None).collect())
    assert got == [("1", "2"), ("3", "4"), ("A", "B"), ("A", "B"), ("A", "B"), ("pre", ""), ("pre", "x")]


def test_clean_feeds_stay_one_scan(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "clean.csv"), ["pre", PP_HEADER, 'NSW,1,B,1,"P, Q",11,S,G,1,N,Y,ALP,Labor,4,0'])
    plan = read_feed(spark, p, schemas.HOUSE_FP_PP)._jdf.queryExecution().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_break_in_a_declared_feed(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "x.csv"), ["pre", PP_HEADER, 'NSW,1,B,1,"Place,\n\nsecond line",11,S,G,1,N,Y,ALP,Labor,4,0', "NSW,1,B,2,P,11,S,G,1,N,Y,,Labor,,0"])
    rows = sorted(read_feed(spark, p, schemas.HOUSE_FP_PP).collect(), key=lambda r: r.PollingPlaceID)
    assert (rows[0].PollingPlace, rows[0].OrdinaryVotes) == ("Place,\n\nsecond line", 4)
    assert (rows[1].PartyAb, rows[1].OrdinaryVotes) == ("", None)


def test_header_names_that_come_out_alike(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "h.csv"), ["pre", "A-B,A B,a_b,A_B_1,,", "1,2,3,4,5,6"])
    df = read_feed(spark, p, None)
    assert df.columns == ["A_B", "A_B_1", "a_b_2", "A_B_1_1", "X", "X_1"]
    assert tuple(df.first()) == ("1", "2", "3", "4", "5", "6")
    own = schemas._struct(("A_B", schemas.L))
    assert read_feed(spark, p, own).collect() == [(1,)]


def test_padded_state_codes_of_the_2013_table(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "p.csv"), ["State,Division,Centre,1/9", "NSW,Banks,X,5"])
    e13 = _write(os.path.join(tmpdir_path, "e13.csv"), ["State,Electors enrolled", "NSW ,1 000", "\u00a0VIC,2 000", "National ,3 000"])
    e16 = _write(os.path.join(tmpdir_path, "e16.csv"), ["a", "b", "c", "d", "State,Division,Electors on 2016 Certified list", 'NSW,Banks,"1,000"'])
    inputs = load_prepoll(spark, p, p, e13, e16)
    both = E.enrolment_both(E.enrolment_2013_by_state(inputs.enrolment_2013), E.enrolment_2016_by_state(inputs.enrolment_2016))
    assert sorted(map(tuple, both.collect())) == [("NSW", 1000, "2013"), ("NSW", 1000, "2016"), ("VIC", 2000, "2013")]
    rate = E.prepoll_state_rate(E.prepoll_state_cumulative(E.combine_elections(inputs.prepoll_2013, inputs.prepoll_2016)), both)
    assert rate.where("Election = '2013' AND State = 'NSW'").first().State_Prop == 0.005


def test_empty_file_and_blank_lines(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "b.csv"), ["pre", "A,B", "", '1,"x', "", 'y"', ""])
    assert [tuple(r) for r in read_feed(spark, p, None).collect()] == [("1", "x\n\ny")]
    assert whole_records(spark.read.text(p), 99).count() == 0
    assert spark.createDataFrame([("",)], "value string").where(opens_quote()).count() == 0
