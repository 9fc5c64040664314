"""Declared schemas of the result feeds (no inference at scan time).

Column order is the feed's own order; reports address columns by name only.
"""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from psephos.constants import PREPOLL_DAYS, VOTE_COLUMNS


def _struct(*cols: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in cols])


S, L, D = StringType(), LongType(), DoubleType()

_CANDIDATE = [
    ("CandidateID", L),
    ("Surname", S),
    ("GivenNm", S),
]
_FLAGS = [("Elected", S), ("HistoricElected", S), ("PartyAb", S), ("PartyNm", S)]
_VOTES = [(c, L) for c in VOTE_COLUMNS]

HOUSE_FP_PP = _struct(
    ("StateAb", S),
    ("DivisionID", L),
    ("DivisionNm", S),
    ("PollingPlaceID", L),
    ("PollingPlace", S),
    *_CANDIDATE,
    *_FLAGS,
    ("OrdinaryVotes", L),
)

HOUSE_FP_TYPE = _struct(
    ("StateAb", S),
    ("DivisionID", L),
    ("DivisionNm", S),
    *_CANDIDATE,
    *_FLAGS,
    *_VOTES,
)

# Same shape as the first-preference polling-place feed.
HOUSE_TCP_PP = HOUSE_FP_PP

# 18 columns, OrdinaryVotes 12th.
HOUSE_TCP_TYPE = _struct(
    ("StateAb", S),
    ("DivisionID", L),
    ("DivisionNm", S),
    *_CANDIDATE,
    ("BallotPosition", L),
    *_FLAGS,
    *_VOTES,
    ("Swing", D),
)

ENROLMENT_DIV = _struct(
    ("StateAb", S),
    ("DivisionID", L),
    ("DivisionNm", S),
    ("Enrolment", L),
)

SENATE_FP_DIV = _struct(
    ("StateAb", S),
    ("DivisionNm", S),
    ("Ticket", S),
    ("BallotPosition", L),
    ("PartyAb", S),
    ("PartyName", S),
    ("CandidateDetails", S),
    ("Elected", S),
    ("HistoricElected", S),
    *_VOTES,
)

SENATE_FP_GROUP = _struct(("StateAb", S), ("GroupAb", S), ("TotalVotes", L))

POLLING_PLACES = _struct(
    ("StateAb", S),
    ("DivisionID", L),
    ("DivisionNm", S),
    ("PollingPlaceID", L),
    ("PollingPlace", S),
)


def prepoll_schema(id_cols: list[str], days: int = PREPOLL_DAYS) -> StructType:
    """Wide pre-poll file: id columns then one count column per day."""
    return _struct(*[(c, S) for c in id_cols], *[(f"Day{d:02d}", L) for d in range(1, days + 1)])


PREPOLL_2013_IDS = ["State", "Division", "Centre"]
PREPOLL_2016_IDS = ["m_state_ab", "m_div_nm", "m_centre_nm"]

ENROLMENT_2016 = _struct(("State", S), ("Division", S), ("Electors_on_2016_Certified_list", S))
ENROLMENT_2013 = _struct(("State", S), ("Electors_enrolled", S))
