"""Named queries over the driver's tables: ``name -> (spark, sf_dir) -> DataFrame``.

Each query builds the election view from the warehouse tables it reads and
runs one report on it, so its work grows with those tables. A query first
releases what the one before it materialized.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from psephos.operators import house as H
from psephos.operators import prepoll as E
from psephos.operators import senate as S
from psephos.plans.sizing import kept_for_query
from psephos.sources.binding import election_inputs, prepoll_inputs

Query = Callable[[SparkSession, str], DataFrame]


def _house(fn: Callable, *shared: str) -> Query:
    """``shared``: the House tables that the report reads twice or more, to be materialized."""

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = kept_for_query(spark)
        house, _ = election_inputs(spark, sf_dir, kept=kept)
        return fn(house, H.build_house(house, "auto", kept, shared))

    q.__doc__ = fn.__doc__
    return q


def _senate(fn: Callable) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        house, senate = election_inputs(spark, sf_dir, kept=kept_for_query(spark))
        return fn(house, senate)

    return q


def _prepoll(fn: Callable) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        inp = prepoll_inputs(spark, sf_dir, kept=kept_for_query(spark))
        combined = E.combine_elections(inp.prepoll_2013, inp.prepoll_2016)
        enrol = E.enrolment_both(E.enrolment_2013_by_state(inp.enrolment_2013), E.enrolment_2016_by_state(inp.enrolment_2016))
        return fn(combined, enrol)

    return q


QUERIES: dict[str, Query] = {
    # House (H1-H17)
    "pp_results_by_candidate": _house(lambda i, t: t["pp_all"]),
    "formal_votes_by_party": _house(lambda i, t: t["formal_votes_div"]),
    "tcp_by_place": _house(lambda i, t: t["tcp_pp"]),
    "tcp_by_place_percent": _house(lambda i, t: H.tcp_by_place_percent(t["tcp_pp"])),
    "tcp_by_division_percent": _house(lambda i, t: H.tcp_by_division_percent(t["tcp_long"], i.parties)),
    "tcp_by_type": _house(lambda i, t: t["hor_tcp_type"]),
    "tcp_everything": _house(lambda i, t: t["tcp_type"]),
    "lagging_incumbents": _house(lambda i, t: H.lagging_incumbents(t["tcp_long"], i.fp_type, i.enrolment), "tcp_long"),
    "party_share_by_division": _house(lambda i, t: H.party_share_by_division(i.fp_type)),
    "vote_types_by_division": _house(lambda i, t: t["div_total_type"]),
    "division_votes": _house(lambda i, t: H.division_votes(t["pp_all"])),
    "division_percent": _house(lambda i, t: H.division_percent(H.division_votes(t["pp_all"], ordered=False))),
    "division_tcp_votes": _house(lambda i, t: H.division_tcp_votes(t["tcp_type"])),
    "division_tcp_percent": _house(lambda i, t: H.division_tcp_percent(t["tcp_type"])),
    "public_funding": _house(lambda i, t: H.public_funding(i.fp_pp)),
    "seat_summary": _house(lambda i, t: H.seat_summary(t["pp_all"], i.enrolment, t["tcp_type"], i.tcp_type), "tcp_long", "tcp_type"),
    "tcp_comparison": _house(lambda i, t: H.tcp_comparison(t["tcp_type"])),
    # Polling-place locations feed (loaded by the original, not used by a report)
    "polling_place_locations": _house(lambda i, t: i.pp_location),
    # Senate (S1-S3)
    "senate_turnout": _senate(lambda h, s: S.senate_turnout(s.fp_div, h.enrolment)),
    "senate_quotas_half": _senate(lambda h, s: S.senate_quotas(s.fp_group, 6)),
    "senate_quotas_full": _senate(lambda h, s: S.senate_quotas(s.fp_group, 12)),
    "senate_quotas_candidate": _senate(lambda h, s: S.senate_quotas_candidate(s.fp_div, 6)),
    # Pre-poll series (E1-E8)
    "prepoll_combined": _prepoll(lambda c, e: c),
    "prepoll_daily": _prepoll(lambda c, e: E.prepoll_daily(c)),
    "prepoll_cumulative": _prepoll(lambda c, e: E.prepoll_cumulative(E.prepoll_daily(c))),
    "prepoll_state_cumulative": _prepoll(lambda c, e: E.prepoll_state_cumulative(c)),
    "enrolment_by_state": _prepoll(lambda c, e: e),
    "prepoll_state_rate": _prepoll(lambda c, e: E.prepoll_state_rate(E.prepoll_state_cumulative(c), e)),
    # Dormant reports (D1-D8)
    "tcp_division_party": _house(lambda i, t: H.tcp_division_party(t["tcp_long"])),
    "vote_types_plain": _house(lambda i, t: H.vote_types_plain(i.fp_type)),
    "division_votes_tcp": _house(
        lambda i, t: H.division_votes_tcp(H.division_votes(t["pp_all"], ordered=False), t["tcp_long"], t["hor_tcp_type"]), "tcp_long"
    ),
    "tcp_lead_lag_diff": _house(lambda i, t: H.tcp_lead_lag_diff(t["tcp_type"]), "tcp_long", "tcp_type"),
    "senate_quotas_dd_hs": _senate(lambda h, s: S.senate_quotas_two(s.fp_group)),
    "senate_quotas_both": _senate(lambda h, s: S.senate_quotas_both(s.fp_group)),
    "prepoll_division": _prepoll(lambda c, e: E.prepoll_division(c)),
    "prepoll_state_totals": _prepoll(lambda c, e: E.prepoll_state_totals(c, e)),
}

FLAGSHIP = "seat_summary"
