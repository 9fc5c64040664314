"""First-preference fixtures: funding threshold, pooled independents, division tables."""

import pytest

from psephos.operators import house as H
from tests.helpers import house, tcp_type_row


def pp(div, place, cand, party, votes, **kw):
    return dict(
        StateAb="NSW", DivisionID=kw.pop("div_id", 1), DivisionNm=div, PollingPlaceID=1, PollingPlace=place,
        CandidateID=cand, Surname=kw.pop("Surname", f"S{cand}"), GivenNm=f"G{cand}", PartyAb=party,
        Elected="N", HistoricElected="N",
        PartyNm=kw.pop("PartyNm", f"Party {party}"), OrdinaryVotes=votes, **kw,
    )


FP_PP = [
    pp("A", "A Booth 2", 1, "ALP", 48),
    pp("A", "A Booth 2", 2, "LP", 48),
    pp("A", "A Booth 2", 3, "GRN", 4),  # exactly 4.0 percent: not funded
    pp("A", "A Booth 2", 9, "", 10, PartyNm="Informal", Surname="Informal"),
    pp("B", "B PPVC", 4, "ALP", 50, div_id=2),
    pp("B", "B PPVC", 5, "LP", 45, div_id=2),
    pp("B", "B PPVC", 6, "IND", 3, div_id=2),  # two independents pooled: 5 percent
    pp("B", "B PPVC", 7, "IND", 2, div_id=2),
]
FP_TYPE = [
    tcp_type_row("A", 1, "ALP", 1, (48, 2, 0, 0, 0)),
    tcp_type_row("A", 1, "LP", 2, (48, 0, 0, 0, 0)),
    tcp_type_row("A", 1, "GRN", 3, (4, 0, 0, 0, 0)),
    tcp_type_row("A", 1, "", 9, (10, 0, 0, 0, 0), Surname="Informal", PartyNm="Informal"),
    tcp_type_row("B", 2, "ALP", 4, (50, 0, 0, 0, 1)),
    tcp_type_row("B", 2, "LP", 5, (45, 0, 0, 0, 0)),
    tcp_type_row("B", 2, "IND", 6, (3, 0, 0, 0, 0)),
    tcp_type_row("B", 2, "IND", 7, (2, 0, 0, 0, 0)),
]


@pytest.fixture(scope="module")
def inp(spark):
    return house(spark, fp_pp=FP_PP, fp_type=FP_TYPE)


def test_public_funding_strict_threshold_and_pooled_independents(inp):
    got = {r.PartyAb: r for r in H.public_funding(inp.fp_pp).collect()}
    assert "GRN" not in got
    assert got["IND"].total_votes == 5
    assert got["ALP"].total_votes == 98 and got["ALP"].funding == pytest.approx(98 * 262.784 / 100)
    assert got["LP"].group == "COAL" and got["ALP"].group == "ALP"


def test_formal_votes_pool_party(inp):
    got = {(r.DivisionNm, r.PartyAb): r.votes for r in H.formal_votes_by_party(inp.fp_pp).collect()}
    assert got[("B", "IND")] == 5 and ("A", "") not in got


def test_vote_types_prepoll_ordinary_null_without_ppvc(inp):
    got = {r.DivisionNm: r for r in H.vote_types_by_division(inp.fp_type, inp.fp_pp).collect()}
    assert got["A"].prepoll_ordinary is None
    assert got["B"].prepoll_ordinary == 100
    assert got["A"].total == 112 and got["A"].absent == 2


def test_division_tables_informal_last_and_uneven_denominators(inp):
    pp_all = H.polling_place_results_by_candidate(inp.fp_pp, inp.fp_type)
    votes = H.division_votes(pp_all, "A").collect()
    assert votes[-1].Surname == "Informal" and [r.total for r in votes[:-1]] == [50, 48, 4]
    alp = votes[0]
    assert (alp.ordinary, alp.absent, alp.prepoll_ordinary) == (48, 2, 0)
    pct = {r.Surname: r for r in H.division_percent(H.division_votes(pp_all, "A")).collect()}
    # Formal rows: share of the formal column total; informal row: of the grand total.
    assert pct["S1"].total == round(50 / 102 * 100, 2)
    assert pct["Informal"].total == round(10 / 112 * 100, 2)
    assert pct["S1"].absent == 100.0 and pct["S2"].absent == 0.0
    assert pct["S1"].prepoll_ordinary == 0.0  # 0 / 0 reported as 0
    assert "CandidateID" not in pct["S1"].asDict()


def test_polling_place_table_dummy_places_and_flags(inp):
    rows = H.polling_place_results_by_candidate(inp.fp_pp, inp.fp_type).collect()
    assert len(rows) == len(FP_PP) + 4 * len(FP_TYPE)
    places = {r.PollingPlace: (r.DeclarationVote, r.PrepollOrdinary) for r in rows}
    assert places["B PPVC"] == ("N", "Y")
    assert places["_dummy_prepolldec"] == ("Y", "N")  # the pattern is case-sensitive
    assert places["_dummy_absent"] == ("Y", "N")


def test_party_share(inp):
    got = {(r.DivisionNm, r.PartyAb, r.TotalVotes): r.prop_vote for r in H.party_share_by_division(inp.fp_type).collect()}
    assert got[("A", "GRN", 4)] == pytest.approx(4 / 102 * 100)
    assert all(k[1] != "" for k in got)
