"""Invariants of the reports over the election view of the smoke tables."""

from collections import defaultdict

import pytest

from psephos.operators import house as H
from psephos.operators import prepoll as E
from psephos.sources.binding import election_inputs, prepoll_inputs
from tests.conftest import SF_SMOKE


@pytest.fixture(scope="module")
def view(spark):
    house, senate = election_inputs(spark, SF_SMOKE)
    return house, senate, H.build_house(house)


def test_tpp_percents_of_a_seat_add_to_100(view):
    _, _, t = view
    sums = defaultdict(float)
    for r in t["tcp_type"].collect():
        for c in ("OrdinaryVotes", "AbsentVotes", "TotalVotes"):
            v = getattr(r, f"tpp_percent_{c}")
            if v is not None:
                sums[(r.DivisionNm, c)] += v
    assert sums and all(abs(v - 100) < 1e-9 for v in sums.values())


def test_margins_of_a_seat_cancel(view):
    _, _, t = view
    m = defaultdict(int)
    for r in t["tcp_type"].collect():
        m[r.DivisionNm] += r.margin_votes
    assert set(m.values()) == {0}


def test_division_table_totals_match_vote_type_totals(view):
    house, _, t = view
    by_div = defaultdict(lambda: [0, 0])
    for r in H.division_votes(t["pp_all"]).collect():
        by_div[r.DivisionNm][0] += r.total
        by_div[r.DivisionNm][1] += r.ordinary
    vt = {r.DivisionNm: r for r in t["div_total_type"].collect()}
    assert by_div and all(by_div[d][0] == vt[d].total for d in by_div)
    # The division table's ordinary column includes pre-poll ordinary votes.
    assert all(by_div[d][1] == vt[d].ordinary for d in by_div)


def test_formal_column_percents_add_to_100(view):
    _, _, t = view
    sums = defaultdict(float)
    for r in H.division_percent(H.division_votes(t["pp_all"])).collect():
        if r.Surname != "Informal":
            sums[r.DivisionNm] += r.total
    assert sums and all(abs(v - 100) < 0.05 * 8 for v in sums.values())


def test_running_totals_never_decrease(spark):
    inp = prepoll_inputs(spark, SF_SMOKE)
    combined = E.combine_elections(inp.prepoll_2013, inp.prepoll_2016)
    series = defaultdict(list)
    for r in E.prepoll_state_cumulative(combined).collect():
        series[(r.Election, r.State)].append((r.Day, r.Cum_Total))
    for pts in series.values():
        vals = [c for _, c in sorted(pts) if c is not None]
        assert vals == sorted(vals)


def test_grain_partial_aggregate_before_shuffle(spark):
    """The five-way join is collapsed by a partial aggregate before its shuffle."""
    from psephos.sources.binding import WAREHOUSE_TABLES, ballot_grain, read_tables

    plan = ballot_grain(read_tables(spark, SF_SMOKE, WAREHOUSE_TABLES))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "partial_sum" in plan
