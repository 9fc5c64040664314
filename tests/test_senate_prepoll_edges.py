import pytest

from psephos.operators import prepoll as E
from psephos.operators import senate as S
from psephos.sources import schemas
from tests.helpers import frame, senate


@pytest.fixture(scope="module")
def sen(spark):
    groups = [
        dict(StateAb="ACT", GroupAb="A", TotalVotes=300),
        dict(StateAb="ACT", GroupAb="B", TotalVotes=100),
        dict(StateAb="NSW", GroupAb="A", TotalVotes=700),
        dict(StateAb="NSW", GroupAb="B", TotalVotes=300),
    ]
    div = [
        dict(StateAb="NSW", DivisionNm="X", Ticket="A", BallotPosition=1, PartyAb="ALP", OrdinaryVotes=400, TotalVotes=400),
        dict(StateAb="NSW", DivisionNm="Y", Ticket="A", BallotPosition=1, PartyAb="ALP", OrdinaryVotes=300, TotalVotes=300),
        dict(StateAb="NSW", DivisionNm="Y", Ticket="B", BallotPosition=2, PartyAb="LP", OrdinaryVotes=300, TotalVotes=300),
    ]
    return senate(spark, fp_div=div, fp_group=groups)


def test_territory_quota_ignores_vacancies(sen):
    for vac in (6, 12):
        got = {(r.StateAb, r.GroupAb): r.num_quotas for r in S.senate_quotas(sen.fp_group, vac).collect()}
        assert got[("ACT", "A")] == pytest.approx(300 / (400 / 3 + 1))
        assert got[("NSW", "A")] == pytest.approx(700 / (1000 / (vac + 1) + 1))


def test_quota_order_and_both(sen):
    rows = S.senate_quotas(sen.fp_group).collect()
    assert [(r.StateAb, r.TotalVotes) for r in rows] == [("ACT", 300), ("ACT", 100), ("NSW", 700), ("NSW", 300)]
    both = {(r.StateAb, r.GroupAb): r for r in S.senate_quotas_both(sen.fp_group).collect()}
    assert both[("NSW", "A")].quotas_fs > both[("NSW", "A")].quotas_hs
    two = {(r.StateAb, r.GroupAb): r for r in S.senate_quotas_two(sen.fp_group).collect()}
    assert two[("NSW", "B")].num_quotas_dd == pytest.approx(300 / (1000 / 13 + 1))


def test_candidate_rollup(sen):
    rows = S.senate_quotas_candidate(sen.fp_div, 6).collect()
    got = {(r.Ticket, r.PartyAb): r for r in rows}
    assert got[("A", "ALP")].TotalVotes == 700 and got[("A", "ALP")].OrdinaryVotes == 700
    assert got[("A", "ALP")].Quotas == pytest.approx(700 / (1000 / 7 + 1))


def test_senate_turnout(spark, sen):
    enrol = frame(spark, schemas.ENROLMENT_DIV, [dict(StateAb="NSW", DivisionID=1, DivisionNm="X", Enrolment=2000)])
    r = S.senate_turnout(sen.fp_div, enrol).first()
    assert (r.StateAb, r.votes, r.percent_enrolment) == ("NSW", 1000, 50.0)


def _wide(spark, rows13, rows16):
    s13 = schemas.prepoll_schema(schemas.PREPOLL_2013_IDS, 16)
    s16 = schemas.prepoll_schema(schemas.PREPOLL_2016_IDS, 16)
    return E.combine_elections(spark.createDataFrame(rows13, s13), spark.createDataFrame(rows16, s16))


def test_late_zero_day_masks_2016_running_totals(spark):
    d13 = ("NSW", "D1", "C", 0) + tuple(range(2, 17))  # Day01 = 0 in 2013
    d16 = ("NSW", "D1", "C") + tuple(range(1, 16)) + (0,)  # Day16 = 0 in 2016
    combined = _wide(spark, [d13], [d16])
    nat = {(r.Election, r.Day): r for r in E.prepoll_cumulative(E.prepoll_daily(combined)).collect()}
    late = nat[("2016", "Day16")]
    assert (late.Votes, late.Prop_Votes, late.Cum_Total, late.Cum_Prop) == (None, None, None, None)
    early = nat[("2013", "Day01")]
    assert early.Votes is None and early.Cum_Total == 0 and early.Cum_Prop == 0.0
    day2 = nat[("2013", "Day02")]
    assert day2.Cum_Total == 2 and day2.Prop_Votes == pytest.approx(2 / 14712799)
    assert nat[("2016", "Day15")].Cum_Prop == pytest.approx(sum(range(1, 16)) / 15676659 * 100)
    state = {(r.Election, r.Day): r for r in E.prepoll_state_cumulative(combined).collect()}
    assert (state[("2016", "Day16")].Votes, state[("2016", "Day16")].Cum_Total) == (0, None)
    assert (state[("2013", "Day01")].Votes, state[("2013", "Day01")].Cum_Total) == (0, 0)


def test_running_total_is_non_decreasing_and_rate(spark):
    d13 = ("NSW", "Fraser", "C") + tuple([3] * 16)
    d16 = ("NSW", "Fenner", "C") + tuple([1] * 14) + (None, None)
    combined = _wide(spark, [d13], [d16])
    enrol = E.enrolment_both(
        spark.createDataFrame([("NSW", 100)], "State string, enrolled_total long"),
        spark.createDataFrame([("NSW", 50)], "State string, enrolled_total long"),
    )
    rate = sorted(E.prepoll_state_rate(E.prepoll_state_cumulative(combined), enrol).collect(), key=lambda r: (r.Election, r.Day))
    cum13 = [r.Cum_Total for r in rate if r.Election == "2013"]
    assert cum13 == sorted(cum13) and cum13[-1] == 48
    assert rate[15].State_Prop == pytest.approx(0.48)
    assert [r.State_Prop for r in rate if r.Election == "2016"][-2:] == [None, None]
    div = {(r.Election, r.Division) for r in E.prepoll_division(combined).collect()}
    assert div == {("2013", "Fenner"), ("2016", "Fenner")}  # 2013 Fraser renamed
    tot = {r.Election: r for r in E.prepoll_state_totals(combined, enrol).collect()}
    assert tot["2016"].State_Totals == 14 and tot["2016"].State_Vote_Prop == pytest.approx(14 / 50)
