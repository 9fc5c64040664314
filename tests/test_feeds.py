import csv
import os
from datetime import datetime

import pytest

from psephos.operators import prepoll as E
from psephos.sources import schemas
from psephos.sources.feeds import load_prepoll, load_tcp_type_2013, read_feed, read_prepoll, write_seat_summary

PP_HEADER = "StateAb,DivisionID,DivisionNm,PollingPlaceID,PollingPlace,CandidateID,Surname,GivenNm,BallotPosition,Elected,HistoricElected,PartyAb,PartyNm,OrdinaryVotes,Swing"


def _write(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_feed_scan_drops_preamble_keeps_quoted_comma_and_blank_text(spark, tmpdir_path):
    a = _write(os.path.join(tmpdir_path, "a.csv"), [
        "2016 Federal Election,Event 20499",
        PP_HEADER,
        'NSW,101,Banks,1,"Hurstville, North",11,SMITH,Ann,1,N,Y,ALP,Australian Labor Party,120,1.5',
        "NSW,101,Banks,1,\"Hurstville, North\",12,JONES,Bob,2,N,N,,,7,0",
        "NSW,101,Banks,1,\"Hurstville, North\",13,Informal,,3,N,N,,Informal,,0",
    ])
    b = _write(os.path.join(tmpdir_path, "b.csv"), [
        "2016 Federal Election,Event 20499",
        PP_HEADER,
        "VIC,201,Aston,9,Aston PPVC,21,LEE,Cy,1,N,N,LP,Liberal,50,0",
    ])
    df = read_feed(spark, [a, b], schemas.HOUSE_FP_PP)
    assert df.columns == [f.name for f in schemas.HOUSE_FP_PP.fields]
    rows = sorted(df.collect(), key=lambda r: r.CandidateID)
    assert len(rows) == 4
    assert rows[0].PollingPlace == "Hurstville, North" and rows[0].OrdinaryVotes == 120
    assert rows[1].PartyNm == "" and rows[1].PartyAb == ""  # blank text kept as ""
    assert rows[2].OrdinaryVotes is None  # blank number stays NULL
    # A blank party is formal: it survives PartyNm != 'Informal'.
    assert df.where("PartyNm != 'Informal'").count() == 3


def test_feed_scan_several_preamble_lines_and_header_names(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "enrol.csv"), [
        "Enrolment statistics", "as at 2016", "", "source: count",
        "State,Division,Electors on 2016 Certified list",
        'NSW,Banks,"1,234,567"',
        'NSW,Barton,"10,000"',
    ])
    df = read_feed(spark, p, schemas.ENROLMENT_2016, preamble=4)
    got = E.enrolment_2016_by_state(df).collect()
    assert [(r.State, r.enrolled_total) for r in got] == [("NSW", 1244567)]


def test_enrolment_2013_spaces(spark):
    df = spark.createDataFrame([("NSW", "1 234 567"), ("VIC", "n/a")], schemas.ENROLMENT_2013)
    got = {r.State: r.enrolled_total for r in E.enrolment_2013_by_state(df).collect()}
    assert got == {"NSW": 1234567, "VIC": None}


def test_prepoll_file_and_combine_by_position(spark, tmpdir_path):
    p13 = _write(os.path.join(tmpdir_path, "p13.csv"), ["State,Division,Centre,1/9,2/9", "NSW,Banks,X,5,6"])
    # the third id column may have any name
    p16 = _write(os.path.join(tmpdir_path, "p16.csv"), ["m_state_ab,m_div_nm,pp_nm,d1", "NSW,Banks,X,7"])
    a = read_prepoll(spark, p13)
    b = read_prepoll(spark, p16)
    c = E.combine_elections(a, b)
    assert {"Election", "State", "Division", "Day01", "Day02"} <= set(c.columns)
    got = {(r.Election, r.Day01, r.Day02) for r in c.collect()}
    assert got == {("2013", 5, 6), ("2016", 7, None)}


def test_seat_summary_sink_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([("NSW", 1, 12.5)], "StateAb string, DivisionID long, turnout double")
    path = write_seat_summary(df, tmpdir_path, datetime(2016, 7, 2, 21, 5))
    assert path.endswith("HoR-20160702-2105.csv")
    back = spark.read.option("header", True).schema(df.schema).csv(path).collect()
    assert [tuple(r) for r in back] == [("NSW", 1, 12.5)]


def test_seat_summary_sink_is_one_file_in_order(spark, tmpdir_path):
    when = datetime(2016, 7, 2, 21, 5)
    df = spark.range(0, 300, 1, 7).selectExpr("id", "concat('Seat, ', id) AS name").orderBy("name")
    want = [r.name for r in df.collect()]
    path = write_seat_summary(df, tmpdir_path, when)
    assert os.path.isfile(path) and [f for f in os.listdir(tmpdir_path) if not f.startswith(".")] == ["HoR-20160702-2105.csv"]
    with open(path, newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == ["id", "name"] and [r[1] for r in rows[1:]] == want
    write_seat_summary(df.limit(1), tmpdir_path, when)  # replaced
    with open(path, newline="") as f:
        assert len(list(csv.reader(f))) == 2


def test_interrupted_sink_leaves_no_file(spark, tmpdir_path):
    broken = spark.range(3).selectExpr("id", "CAST(raise_error('interrupted') AS STRING) AS x")
    with pytest.raises(Exception, match="interrupted"):
        write_seat_summary(broken, tmpdir_path, datetime(2016, 7, 2, 21, 5))
    assert os.listdir(tmpdir_path) == []


def test_feed_scan_many_splits_only_first_split_loses_leading_lines(spark, tmpdir_path):
    rows = [f"NSW,{i},Banks,1,Place {i},{i},S,G,1,N,N,ALP,Labor,{i},0" for i in range(1, 401)]
    p = _write(os.path.join(tmpdir_path, "big.csv"), ["preamble line", PP_HEADER] + rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        df = read_feed(spark, p, schemas.HOUSE_FP_PP)
        assert df.rdd.getNumPartitions() > 5
        got = sorted(r.OrdinaryVotes for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(range(1, 401))


def test_feed_scan_gzip(spark, tmpdir_path):
    import gzip

    p = os.path.join(tmpdir_path, "feed.csv.gz")
    with gzip.open(p, "wt") as f:
        f.write("preamble\n" + PP_HEADER + "\n" + "NSW,101,Banks,1,Banks PPVC,11,S,G,1,N,Y,ALP,Labor,42,0\n")
    rows = read_feed(spark, p, schemas.HOUSE_FP_PP).collect()
    assert [(r.PollingPlace, r.OrdinaryVotes) for r in rows] == [("Banks PPVC", 42)]


def test_feed_scan_names_a_missing_column(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "renamed.csv"), ["preamble", PP_HEADER.replace("PartyNm", "Party"), "NSW,1,B,1,P,11,S,G,1,N,Y,ALP,Labor,4,0"])
    with pytest.raises(ValueError, match="PartyNm"):
        read_feed(spark, p, schemas.HOUSE_FP_PP)


def test_feed_scan_keeps_undeclared_columns_on_request(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "more.csv"), ["preamble", PP_HEADER, "NSW,1,B,1,P,11,S,G,1,N,Y,ALP,Labor,4,0.5"])
    assert "Swing" not in read_feed(spark, p, schemas.HOUSE_FP_PP).columns
    more = read_feed(spark, p, schemas.HOUSE_FP_PP, extra=True)
    assert more.columns == [*schemas.HOUSE_FP_PP.names, "BallotPosition", "Swing"]
    assert (more.first().OrdinaryVotes, more.first().Swing) == (4, "0.5")
    own = read_feed(spark, p, None)
    assert own.columns == PP_HEADER.split(",") and own.first().OrdinaryVotes == "4"


def test_feed_data_pass_runs_no_python(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "x.csv"), ["preamble", PP_HEADER, "NSW,1,B,1,P,11,S,G,1,N,Y,ALP,Labor,4,0"])
    plan = read_feed(spark, p, schemas.HOUSE_FP_PP)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_tcp_file_of_2013(spark, tmpdir_path):
    header = ",".join(schemas.HOUSE_TCP_TYPE.names)
    _write(os.path.join(tmpdir_path, "HouseTcpByCandidateByVoteTypeDownload-17496.csv"), ["2013 Federal Election", header, "NSW,1,Banks,11,S,G,1,N,Y,ALP,Labor,10,1,2,3,4,20,-1.5"])
    row = load_tcp_type_2013(spark, tmpdir_path).first()
    assert (row.DivisionNm, row.TotalVotes, row.Swing) == ("Banks", 20, -1.5)


def test_enrolment_2013_total_row_is_no_state(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "p.csv"), ["State,Division,Centre,1/9", "NSW,Banks,X,5"])
    e13 = _write(os.path.join(tmpdir_path, "e13.csv"), ["State,Electors enrolled", "NSW,1 000", "VIC,2 000", "National,3 000"])
    e16 = _write(os.path.join(tmpdir_path, "e16.csv"), ["a", "b", "c", "d", "State,Division,Electors on 2016 Certified list", 'NSW,Banks,"1,000"'])
    inputs = load_prepoll(spark, p, p, e13, e16)
    both = E.enrolment_both(E.enrolment_2013_by_state(inputs.enrolment_2013), E.enrolment_2016_by_state(inputs.enrolment_2016))
    assert sorted(map(tuple, both.collect())) == [("NSW", 1000, "2013"), ("NSW", 1000, "2016"), ("VIC", 2000, "2013")]
