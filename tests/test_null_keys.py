"""Joins match a blank numeric key with a blank one, as the original's joins match NA with NA; parties are found once."""

from psephos.functions import left_join_na
from psephos.operators import house as H
from tests import helpers


def test_left_join_na(spark):
    a = spark.createDataFrame([(1, "x", 10), (None, "x", 20), (None, None, 30)], "k int, s string, v int")
    b = spark.createDataFrame([(1, "x", "p"), (None, "x", "q"), (None, None, "r")], "k int, s string, w string")
    got = left_join_na(a, b, ["k", "s"])
    assert got.columns == ["k", "s", "v", "w"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == [(1, "x", 10, "p"), (None, "x", 20, "q"), (None, None, 30, "r")]


def _inputs(spark):
    def seat(div, div_id, a, b):
        return [helpers.tcp_type_row(div, div_id, p, c, (v, 0, 0, 0, 0), Swing=1.5) for p, c, v in (("ALP", 1, a), ("LP", 2, b))]

    tcp = seat("Banks", 101, 60, 40) + seat("Blank", None, 30, 70)
    pp = [dict(r, PollingPlaceID=1, PollingPlace="Booth") for r in tcp]
    enrol = [dict(StateAb="NSW", DivisionID=101, DivisionNm="Banks", Enrolment=200), dict(StateAb="NSW", DivisionID=None, DivisionNm="Blank", Enrolment=400)]
    return helpers.house(spark, fp_pp=pp, fp_type=tcp, tcp_pp=pp, tcp_type=tcp, enrolment=enrol)


def test_a_blank_division_id_meets_its_enrolment(spark):
    i = _inputs(spark)
    t = H.build_house(i)
    got = {(r.DivisionNm, r.PartyAb): (r.DivisionID, r.Enrolment) for r in t["tcp_type"].collect()}
    assert got == {("Banks", "ALP"): (101, 200), ("Banks", "LP"): (101, 200), ("Blank", "ALP"): (None, 400), ("Blank", "LP"): (None, 400)}
    seats = {r.DivisionNm: r for r in H.seat_summary(t["pp_all"], i.enrolment, t["tcp_type"], i.tcp_type).collect()}
    blank = seats["Blank"]
    assert (blank.DivisionID, blank.Enrolment, blank.turnout, blank.leading_party, blank.lagging_party, blank.leading_tcp, blank.Swing) == (None, 400, 25.0, "LP", "ALP", 70.0, 1.5)
    assert len(seats) == 2 and seats["Banks"].leading_party == "ALP"
    lead = {r.DivisionNm: (r.leading_PartyAb, r.lagging_PartyAb) for r in H.tcp_lead_lag_diff(t["tcp_type"]).collect()}
    assert lead == {"Banks": ("ALP", "LP"), "Blank": ("LP", "ALP")}


def test_parties_are_found_once(spark, monkeypatch):
    i = _inputs(spark)
    t = H.build_house(i)
    assert i.parties == ["ALP", "LP"]
    monkeypatch.setattr(type(i.tcp_pp), "collect", lambda self: (_ for _ in ()).throw(AssertionError("another job")))
    wide = t["tcp_pp"]
    assert H.tcp_by_place_percent(wide).columns == ["DivisionNm", "PollingPlace", "ALP", "LP", "total"]
    assert H.tcp_by_division_percent(t["tcp_long"], i.parties).columns == ["DivisionNm", "ALP", "LP", "total"]
