"""Hand-made House fixtures for cases random data does not produce."""

import pytest

from psephos.operators import house as H
from tests.helpers import house, tcp_type_row

# Three seats. Tie: exact 50/50, no pre-poll place. Close: ALP 40 / LP 60, a
# NULL count at one PPVC, sitting party NP outside the final two. Other:
# NP 70 / GRN 30, NP missing from one pre-poll place, sitting GRN.
TCP_PP = [
    # Tie (no PPVC)
    dict(DivisionNm="Tie", PollingPlace="Tie Booth 2", PartyAb="ALP", OrdinaryVotes=30),
    dict(DivisionNm="Tie", PollingPlace="Tie Booth 2", PartyAb="LP", OrdinaryVotes=30),
    # Close
    dict(DivisionNm="Close", PollingPlace="Close PPVC", PartyAb="ALP", OrdinaryVotes=None),
    dict(DivisionNm="Close", PollingPlace="Close PPVC", PartyAb="LP", OrdinaryVotes=10),
    dict(DivisionNm="Close", PollingPlace="PREPOLL Close", PartyAb="ALP", OrdinaryVotes=5),
    dict(DivisionNm="Close", PollingPlace="PREPOLL Close", PartyAb="LP", OrdinaryVotes=6),
    dict(DivisionNm="Close", PollingPlace="Close Booth 2", PartyAb="ALP", OrdinaryVotes=20),
    dict(DivisionNm="Close", PollingPlace="Close Booth 2", PartyAb="LP", OrdinaryVotes=30),
    # Other: NP has no row at PREPOLL Other
    dict(DivisionNm="Other", PollingPlace="Other PPVC", PartyAb="NP", OrdinaryVotes=40),
    dict(DivisionNm="Other", PollingPlace="Other PPVC", PartyAb="GRN", OrdinaryVotes=10),
    dict(DivisionNm="Other", PollingPlace="PREPOLL Other", PartyAb="GRN", OrdinaryVotes=5),
    dict(DivisionNm="Other", PollingPlace="Other Booth 2", PartyAb="NP", OrdinaryVotes=30),
    dict(DivisionNm="Other", PollingPlace="Other Booth 2", PartyAb="GRN", OrdinaryVotes=15),
]
TCP_TYPE = [
    tcp_type_row("Tie", 1, "ALP", 11, (30, 10, 0, 5, 5), Swing=1.0),
    tcp_type_row("Tie", 1, "LP", 12, (30, 10, 0, 5, 5), Swing=-1.0),
    tcp_type_row("Close", 2, "ALP", 21, (25, 5, 2, 4, 4), Swing=-2.0),
    tcp_type_row("Close", 2, "LP", 22, (46, 5, 2, 4, 3), Swing=2.0),
    tcp_type_row("Other", 3, "NP", 31, (70, 0, 0, 0, 0), Swing=3.5),
    tcp_type_row("Other", 3, "GRN", 32, (30, 0, 0, 0, 0), Swing=-3.5),
]
FP_TYPE = [
    tcp_type_row("Tie", 1, "ALP", 11, (30, 10, 0, 5, 5), HistoricElected="Y"),
    tcp_type_row("Tie", 1, "LP", 12, (30, 10, 0, 5, 5)),
    tcp_type_row("Close", 2, "ALP", 21, (25, 5, 2, 4, 4)),
    tcp_type_row("Close", 2, "LP", 22, (36, 5, 2, 4, 3)),
    tcp_type_row("Close", 2, "NP", 23, (10, 0, 0, 0, 0), HistoricElected="Y"),
    tcp_type_row("Other", 3, "NP", 31, (60, 0, 0, 0, 0)),
    tcp_type_row("Other", 3, "GRN", 32, (30, 0, 0, 0, 0), HistoricElected="Y"),
    tcp_type_row("Other", 3, "IND", 33, (5, 0, 0, 0, 0)),
    tcp_type_row("Other", 3, "IND", 34, (5, 0, 0, 0, 0)),
]
def _fp(div, div_id, cand, party, votes, **kw):
    return dict(StateAb="NSW", DivisionID=div_id, DivisionNm=div, PollingPlaceID=div_id * 10,
                PollingPlace=f"{div} Booth 2", CandidateID=cand, PartyAb=party, PartyNm=f"Party {party}",
                OrdinaryVotes=votes, Elected=kw.get("Elected", "N"), HistoricElected=kw.get("HistoricElected", "N"))


FP_PP = [
    _fp("Tie", 1, 11, "ALP", 30, HistoricElected="Y", Elected="Y"),
    _fp("Tie", 1, 12, "LP", 30),
    _fp("Close", 2, 21, "ALP", 25),
    _fp("Close", 2, 22, "LP", 36, Elected="Y"),
    _fp("Close", 2, 23, "NP", 10, HistoricElected="Y"),
    _fp("Other", 3, 31, "NP", 60, Elected="Y"),
    _fp("Other", 3, 32, "GRN", 30, HistoricElected="Y"),
]
ENROL = [
    dict(StateAb="NSW", DivisionID=1, DivisionNm="Tie", Enrolment=200),
    dict(StateAb="NSW", DivisionID=2, DivisionNm="Close", Enrolment=201),
    dict(StateAb="NSW", DivisionID=3, DivisionNm="Other", Enrolment=300),
]


@pytest.fixture(scope="module")
def world(spark):
    inp = house(spark, fp_pp=FP_PP, tcp_pp=TCP_PP, tcp_type=TCP_TYPE, fp_type=FP_TYPE, enrolment=ENROL)
    return inp, H.build_house(inp)


def test_prepoll_ordinary_null_when_a_party_is_unknown_at_one_ppvc(world):
    _, t = world
    got = {(r.DivisionNm, r.PartyAb): r.PrepollOrdinary for r in t["hor_tcp_type"].collect()}
    assert got[("Close", "ALP")] is None  # NULL count at Close PPVC
    assert got[("Close", "LP")] == 16
    assert got[("Other", "NP")] is None  # no row at PREPOLL Other
    assert got[("Other", "GRN")] == 15
    assert got[("Tie", "ALP")] is None  # seat without pre-poll places


def test_tcp_totals_and_percents(world):
    _, t = world
    rows = {(r.DivisionNm, r.PartyAb): r for r in t["tcp_type"].collect()}
    close = rows[("Close", "LP")]
    assert close.total_PrepollOrdinary is None and close.tpp_percent_PrepollOrdinary is None
    assert close.total_TotalVotes == 100 and close.div_percent_TotalVotes == 60.0
    assert close.margin_votes == 20 and rows[("Close", "ALP")].margin_votes == -20
    assert close.fifty_percent_enrolment == 101  # ceil(201 / 2)
    # A vote type with no votes in the seat: 0 / 0 is NULL, never NaN.
    assert rows[("Other", "NP")].tpp_percent_AbsentVotes is None
    tie = rows[("Tie", "ALP")]
    assert tie.tpp_percent_TotalVotes == 50.0 and tie.margin_votes == 0


def test_division_tcp_percent_zero_fills(world):
    _, t = world
    rows = {(r.DivisionNm, r.PartyAb): r for r in H.division_tcp_percent(t["tcp_type"]).collect()}
    assert rows[("Other", "NP")].AbsentVotes == 0.0
    assert rows[("Tie", "ALP")].PrepollOrdinary == 0.0
    assert rows[("Close", "LP")].OrdinaryVotes == round(46 / 71 * 100, 2)


def test_lagging_incumbents_tie_and_sitting_party_outside_final_two(world):
    inp, t = world
    got = {r.DivisionNm: r for r in H.lagging_incumbents(t["tcp_long"], inp.fp_type, inp.enrolment).collect()}
    assert "Tie" not in got  # 50 is not behind
    close = got["Close"]
    assert (close.held_party, close.held_tpp, close.lead_party) == ("NP", 0.0, "LP")
    assert close.number_counted == 100 and close.percent_counted == pytest.approx(100 / 201 * 100)
    assert (got["Other"].held_party, got["Other"].held_tpp, got["Other"].lead_party) == ("GRN", 30.0, "NP")


def test_seat_summary_tie_gives_two_leading_rows(world):
    inp, t = world
    rows = H.seat_summary(t["pp_all"], inp.enrolment, t["tcp_type"], inp.tcp_type).collect()
    tie = sorted([r for r in rows if r.DivisionNm == "Tie"], key=lambda r: r.leading_party)
    assert [(r.leading_party, r.leading_tcp, r.lagging_party) for r in tie] == [("ALP", 50.0, None), ("LP", 50.0, None)]
    assert [r.Swing for r in tie] == [1.0, -1.0]
    close = next(r for r in rows if r.DivisionNm == "Close")
    # pp_all adds the declaration dummies: 71 ordinary + (15 + 14) declaration votes.
    assert (close.HistoricElected, close.Elected, close.leading_party, close.lagging_party) == ("NP", "LP", "LP", "ALP")
    assert close.total_votes == 71 + (5 + 2 + 4 + 4) + (5 + 2 + 4 + 3) and close.margin == 20
    assert close.turnout == round(close.total_votes / 201 * 100, 2)


def test_tcp_wide_tables(world):
    _, t = world
    wide = {(r.DivisionNm, r.PollingPlace): r.asDict() for r in t["tcp_pp"].collect()}
    assert wide[("Tie", "Tie Booth 2")]["GRN"] is None and wide[("Tie", "Tie Booth 2")]["total"] == 60
    assert wide[("Close", "Close PPVC")]["total"] == 10  # NULL counts as 0 in the row total
    div = {r.DivisionNm: r.asDict() for r in H.tcp_by_division_percent(t["tcp_long"]).collect()}
    assert div["Tie"]["GRN"] == 0.0 and div["Tie"]["ALP"] == 50.0  # absent party shares 0


def test_tcp_comparison_shape(world):
    _, t = world
    rows = H.tcp_comparison(t["tcp_type"]).collect()
    assert len(rows) == 21
    n = {r.Type: r for r in rows if r.Stat == "n"}
    assert n["TotalVotes"].ALP == 2.0 and n["TotalVotes"].COAL == 3.0 and n["TotalVotes"].GRN == 1.0
    sd = {r.Type: r for r in rows if r.Stat == "sd"}
    assert sd["TotalVotes"].GRN is None  # sample sd of one value


def test_two_sitting_independents_fan_out(spark):
    tcp_pp = [
        dict(DivisionNm="Indy", PollingPlace="Indy Booth 2", PartyAb="IND", OrdinaryVotes=45),
        dict(DivisionNm="Indy", PollingPlace="Indy Booth 2", PartyAb="ALP", OrdinaryVotes=55),
    ]
    tcp_type = [tcp_type_row("Indy", 9, "IND", 91, (45, 0, 0, 0, 0)), tcp_type_row("Indy", 9, "ALP", 93, (55, 0, 0, 0, 0))]
    fp_type = [
        tcp_type_row("Indy", 9, "IND", 91, (30, 0, 0, 0, 0), HistoricElected="Y"),
        tcp_type_row("Indy", 9, "IND", 92, (15, 0, 0, 0, 0)),
        tcp_type_row("Indy", 9, "ALP", 93, (55, 0, 0, 0, 0)),
    ]
    enrol = [dict(StateAb="VIC", DivisionID=9, DivisionNm="Indy", Enrolment=150)]
    inp = house(spark, tcp_pp=tcp_pp, tcp_type=tcp_type, fp_type=fp_type, enrolment=enrol)
    rows = H.lagging_incumbents(H.tcp_long(inp.tcp_pp, inp.tcp_type), inp.fp_type, inp.enrolment).collect()
    assert sorted(r.held_surname for r in rows) == ["S91", "S92"]  # joined by party, not candidate
    assert {(r.held_party, r.held_tpp, r.lead_party, r.StateAb) for r in rows} == {("IND", 45.0, "ALP", "VIC")}
