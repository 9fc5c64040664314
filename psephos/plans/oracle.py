"""DuckDB SQL for every registered query: an independent statement of the same
results over the same parquet tables (views ``lineitem``, ``orders``, ...).

The SQL spells the election view out on its own (CASE tables rather than the
Spark lookups) and states the report rules the way the original analysis did:
the wide party matrices are built as explicit division x party grids, totals
as aggregate-plus-join. Only the base rules are shared: strict sums are NULL
when any input is NULL, ``x / 0`` is NULL, rounding is half-to-even.
"""

from __future__ import annotations

TCP_TYPES = [
    "OrdinaryVotes",
    "PrepollOrdinary",
    "AbsentVotes",
    "ProvisionalVotes",
    "PrePollVotes",
    "PostalVotes",
    "TotalVotes",
]
VOTES5 = ["OrdinaryVotes", "AbsentVotes", "ProvisionalVotes", "PrePollVotes", "PostalVotes"]


def ss(x: str, cond: str | None = None) -> str:
    """Strict sum: NULL if any summed value is NULL, 0 over no rows."""
    if cond is None:
        return f"CASE WHEN count({x}) = count(*) THEN CAST(coalesce(sum({x}), 0) AS BIGINT) END"
    f = f"FILTER (WHERE {cond})"
    return f"CASE WHEN count({x}) {f} = count(*) {f} THEN CAST(coalesce(sum({x}) {f}, 0) AS BIGINT) END"


def pc(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0) * 100"


def r2(x: str) -> str:
    return f"round_even({x}, 2)"


PARTY = (
    "CASE slot WHEN 1 THEN 'ALP' WHEN 2 THEN 'LP' WHEN 3 THEN 'NP' WHEN 4 THEN 'GRN' "
    "WHEN 5 THEN 'IND' WHEN 6 THEN 'IND' WHEN 7 THEN 'MIN' ELSE '' END"
)
FIRST = "(CASE DivisionID % 4 WHEN 3 THEN 2 ELSE 1 END)"
SECOND = "(CASE DivisionID % 4 WHEN 2 THEN 4 WHEN 3 THEN 3 ELSE 2 END)"

CAND = f"""
    DivisionID * 100 + slot AS CandidateID,
    CASE WHEN slot = 8 THEN 'Informal' ELSE 'Cand' || CAST(slot AS VARCHAR) END AS Surname,
    'G' || CAST(slot AS VARCHAR) AS GivenNm,
    CASE WHEN slot = {FIRST} THEN 'Y' ELSE 'N' END AS Elected,
    CASE WHEN slot = DivisionID % 4 + 1 THEN 'Y' ELSE 'N' END AS HistoricElected,
    {PARTY} AS PartyAb,
    CASE WHEN slot = 8 THEN 'Informal' ELSE 'Party ' || ({PARTY}) END AS PartyNm"""

PLACE = (
    "CASE WHEN k % 10 = 0 THEN DivisionNm || ' PPVC ' || CAST(k AS VARCHAR) WHEN k % 10 = 1 THEN 'PREPOLL ' || DivisionNm || ' ' || CAST(k AS VARCHAR) "
    "ELSE DivisionNm || ' Booth ' || CAST(k AS VARCHAR) END"
)

TYPE_SUMS = ",\n    ".join(
    f"CAST(coalesce(sum(votes) FILTER (WHERE vtype = '{t}'), 0) AS BIGINT) AS {t}" for t in VOTES5
)
TOTAL5 = " + ".join(VOTES5) + " AS TotalVotes"
SWING = "((DivisionID * 7 + slot * 3) % 21 - 10) / 2.0::DOUBLE AS Swing"

BASE = f"""
geo AS (
  SELECT n_nationkey AS nk, CAST(n_nationkey AS BIGINT) AS DivisionID, n_name AS DivisionNm,
         CASE r_name WHEN 'AFRICA' THEN 'NSW' WHEN 'AMERICA' THEN 'VIC' WHEN 'ASIA' THEN 'ACT'
                     WHEN 'EUROPE' THEN 'NT' WHEN 'MIDDLE EAST' THEN 'TAS' END AS StateAb
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
ballots AS (
  SELECT g.StateAb, g.DivisionID, g.DivisionNm,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'OrdinaryVotes' WHEN '2-HIGH' THEN 'AbsentVotes'
              WHEN '3-MEDIUM' THEN CASE WHEN g.DivisionID % 6 = 5 THEN 'PostalVotes' ELSE 'ProvisionalVotes' END WHEN '4-NOT SPECIFIED' THEN 'PrePollVotes'
              WHEN '5-LOW' THEN 'PostalVotes' END AS vtype,
         CASE WHEN g.DivisionID % 5 = 4 AND o.o_orderpriority = '1-URGENT' AND l.l_suppkey % 10 < 2
              THEN l.l_suppkey % 10 + 2 ELSE l.l_suppkey % 10 END + 10 * (l.l_suppkey // 100) AS k,
         CASE WHEN l.l_partkey % 100 < 34 THEN 1 WHEN l.l_partkey % 100 < 60 THEN 2
              WHEN l.l_partkey % 100 < 75 THEN 3 WHEN l.l_partkey % 100 < 88 THEN 4
              WHEN l.l_partkey % 100 < 91 THEN 5 WHEN l.l_partkey % 100 < 94 THEN 6
              WHEN l.l_partkey % 100 < 96 THEN 7 ELSE 8 END AS slot,
         l.l_partkey % 2 AS parity,
         CAST(l.l_quantity AS BIGINT) AS votes
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN geo g ON c.c_nationkey = g.nk
),
tcp_ballots AS (
  SELECT StateAb, DivisionID, DivisionNm, vtype, k,
         CASE WHEN parity = 0 THEN {FIRST} ELSE {SECOND} END AS slot, votes
  FROM ballots WHERE slot < 8
),
fp_pp_g AS (
  SELECT StateAb, DivisionID, DivisionNm, k, slot, CAST(sum(votes) AS BIGINT) AS OrdinaryVotes
  FROM ballots WHERE vtype = 'OrdinaryVotes' GROUP BY ALL
),
house_fp_pp AS (
  SELECT StateAb, DivisionID, DivisionNm, k * 100 + DivisionID AS PollingPlaceID, {PLACE} AS PollingPlace,
    {CAND},
    OrdinaryVotes
  FROM fp_pp_g
),
fp_type_g AS (
  SELECT StateAb, DivisionID, DivisionNm, slot,
    {TYPE_SUMS}
  FROM ballots GROUP BY ALL
),
house_fp_type AS (
  SELECT StateAb, DivisionID, DivisionNm,
    {CAND},
    {", ".join(VOTES5)}, {TOTAL5}
  FROM fp_type_g
),
tcp_pp_g AS (
  SELECT StateAb, DivisionID, DivisionNm, k, slot, CAST(sum(votes) AS BIGINT) AS OrdinaryVotes
  FROM tcp_ballots WHERE vtype = 'OrdinaryVotes' GROUP BY ALL
),
house_tcp_pp AS (
  SELECT StateAb, DivisionID, DivisionNm, k * 100 + DivisionID AS PollingPlaceID, {PLACE} AS PollingPlace,
    {CAND},
    OrdinaryVotes
  FROM tcp_pp_g
),
tcp_type_g AS (
  SELECT StateAb, DivisionID, DivisionNm, slot,
    {TYPE_SUMS}
  FROM tcp_ballots GROUP BY ALL
),
house_tcp_type AS (
  SELECT StateAb, DivisionID, DivisionNm, DivisionID * 100 + slot AS CandidateID,
    CASE WHEN slot = 8 THEN 'Informal' ELSE 'Cand' || CAST(slot AS VARCHAR) END AS Surname,
    'G' || CAST(slot AS VARCHAR) AS GivenNm,
    CAST(slot AS BIGINT) AS BallotPosition,
    CASE WHEN slot = {FIRST} THEN 'Y' ELSE 'N' END AS Elected,
    CASE WHEN slot = DivisionID % 4 + 1 THEN 'Y' ELSE 'N' END AS HistoricElected,
    {PARTY} AS PartyAb,
    CASE WHEN slot = 8 THEN 'Informal' ELSE 'Party ' || ({PARTY}) END AS PartyNm,
    {", ".join(VOTES5)}, {TOTAL5}, {SWING}
  FROM tcp_type_g
),
enrolment_div AS (
  SELECT StateAb, DivisionID, DivisionNm, CAST(count(*) * 27 AS BIGINT) AS Enrolment
  FROM ballots GROUP BY ALL
),
senate_fp_div AS (
  SELECT StateAb, DivisionNm, chr(CAST(64 + slot AS INTEGER)) AS Ticket, CAST(slot AS BIGINT) AS BallotPosition,
    {PARTY} AS PartyAb,
    CASE WHEN slot = 8 THEN 'Informal' ELSE 'Party ' || ({PARTY}) END AS PartyName,
    CASE WHEN slot = 8 THEN 'Informal' ELSE 'Cand' || CAST(slot AS VARCHAR) END AS CandidateDetails,
    CASE WHEN slot = {FIRST} THEN 'Y' ELSE 'N' END AS Elected,
    CASE WHEN slot = DivisionID % 4 + 1 THEN 'Y' ELSE 'N' END AS HistoricElected,
    {", ".join(VOTES5)}, {TOTAL5}
  FROM fp_type_g
),
senate_fp_group AS (
  SELECT StateAb, Ticket AS GroupAb, CAST(sum(TotalVotes) AS BIGINT) AS TotalVotes
  FROM senate_fp_div GROUP BY ALL
)"""

# --- House derived tables ---------------------------------------------------------

_DUMMY = [
    ("AbsentVotes", "_dummy_absent"),
    ("ProvisionalVotes", "_dummy_provisional"),
    ("PrePollVotes", "_dummy_prepolldec"),
    ("PostalVotes", "_dummy_postal"),
]
_FP_ID = "StateAb, DivisionID, DivisionNm"
_CAND_COLS = "CandidateID, Surname, GivenNm, Elected, HistoricElected, PartyAb, PartyNm"
_PREPOLL = "regexp_matches(PollingPlace, 'PPVC|PREPOLL')"

PP_ALL = (
    "pp_all0 AS (\n  SELECT "
    + f"{_FP_ID}, PollingPlaceID, PollingPlace, {_CAND_COLS}, OrdinaryVotes, 'N' AS DeclarationVote FROM house_fp_pp\n"
    + "\n".join(
        f"  UNION ALL SELECT {_FP_ID}, CAST(NULL AS BIGINT), '{place}', {_CAND_COLS}, {col}, 'Y' FROM house_fp_type"
        for col, place in _DUMMY
    )
    + "\n),\npp_all AS (\n  SELECT *, CASE WHEN "
    + _PREPOLL
    + " THEN 'Y' ELSE 'N' END AS PrepollOrdinary FROM pp_all0\n)"
)

H2 = f"""h2 AS (
  SELECT DivisionNm, PartyAb, {ss('OrdinaryVotes')} AS votes
  FROM house_fp_pp WHERE PartyNm <> 'Informal' GROUP BY DivisionNm, PartyAb
)"""

TCP_LONG = (
    "tcp_long AS (\n"
    + f"  SELECT DivisionNm, PollingPlace, PartyAb, {ss('OrdinaryVotes')} AS votes FROM house_tcp_pp GROUP BY DivisionNm, PollingPlace, PartyAb\n"
    + "\n".join(
        f"  UNION ALL SELECT DivisionNm, '{place}', PartyAb, {ss(col)} FROM house_tcp_type GROUP BY DivisionNm, PartyAb"
        for col, place in _DUMMY
    )
    + "\n)"
)

# Division x party grid of the wide TCP-by-division table (absent party = 0).
H5_GRID = f"""tcp_parties AS (SELECT DISTINCT PartyAb FROM tcp_long),
tcp_divs AS (
  SELECT DivisionNm, CAST(coalesce(sum(votes), 0) AS BIGINT) AS total FROM tcp_long GROUP BY DivisionNm
),
tcp_div_party AS (
  SELECT DivisionNm, PartyAb, CAST(coalesce(sum(votes), 0) AS BIGINT) AS votes FROM tcp_long GROUP BY ALL
),
h5_long AS (
  SELECT d.DivisionNm, p.PartyAb, d.total,
         {pc('coalesce(v.votes, 0)', 'd.total')} AS vote_percent
  FROM tcp_divs d CROSS JOIN tcp_parties p
  LEFT JOIN tcp_div_party v ON v.DivisionNm = d.DivisionNm AND v.PartyAb = p.PartyAb
)"""

# Pre-poll ordinary votes per seat and party from the wide TCP matrix: every
# (seat, pre-poll place) row has a cell per party; a NULL cell makes the sum NULL.
H6 = f"""pp_places AS (
  SELECT DISTINCT DivisionNm, PollingPlace FROM tcp_long WHERE {_PREPOLL}
),
pp_cells AS (
  SELECT g.DivisionNm, g.PollingPlace, p.PartyAb, t.votes
  FROM pp_places g CROSS JOIN tcp_parties p
  LEFT JOIN tcp_long t ON t.DivisionNm = g.DivisionNm AND t.PollingPlace = g.PollingPlace AND t.PartyAb = p.PartyAb
),
pp_ord AS (
  SELECT DivisionNm, PartyAb, {ss('votes')} AS PrepollOrdinary FROM pp_cells GROUP BY DivisionNm, PartyAb
),
h6 AS (
  SELECT t.StateAb, t.DivisionID, t.DivisionNm, t.CandidateID, t.Surname, t.GivenNm, t.BallotPosition,
         t.Elected, t.HistoricElected, t.PartyAb, t.PartyNm, t.OrdinaryVotes, o.PrepollOrdinary,
         t.AbsentVotes, t.ProvisionalVotes, t.PrePollVotes, t.PostalVotes, t.TotalVotes, t.Swing
  FROM house_tcp_type t
  LEFT JOIN (SELECT * FROM pp_ord WHERE PrepollOrdinary IS NOT NULL) o
    ON o.DivisionNm = t.DivisionNm AND o.PartyAb = t.PartyAb
)"""

H7 = (
    "h7_tot AS (\n  SELECT DivisionNm, "
    + ", ".join(f"{ss(c)} AS total_{c}" for c in TCP_TYPES)
    + "\n  FROM h6 GROUP BY DivisionNm\n),\nh7 AS (\n  SELECT h6.*, "
    + ", ".join(f"t.total_{c}" for c in TCP_TYPES)
    + ",\n    "
    + ", ".join(f"{pc(c, 'total_' + c)} AS tpp_percent_{c}" for c in TCP_TYPES)
    + ",\n    "
    + ", ".join(f"{pc(c, 'TotalVotes')} AS party_percent_{c}" for c in TCP_TYPES)
    + ",\n    "
    + ", ".join(f"{pc(c, 'total_TotalVotes')} AS div_percent_{c}" for c in TCP_TYPES)
    + ",\n    TotalVotes - (total_TotalVotes - TotalVotes) AS margin_votes,"
    + f"\n    {pc('TotalVotes - (total_TotalVotes - TotalVotes)', 'total_TotalVotes')} AS margin_percent,"
    + "\n    e.Enrolment, CAST(ceil(e.Enrolment / 2) AS BIGINT) AS fifty_percent_enrolment"
    + "\n  FROM h6 JOIN h7_tot t USING (DivisionNm)"
    + "\n  LEFT JOIN enrolment_div e ON e.DivisionID = h6.DivisionID\n)"
)

H11 = (
    "h11 AS (\n  SELECT DivisionNm, PartyAb, CandidateID, Surname, GivenNm, Elected, HistoricElected,\n    "
    + ",\n    ".join(
        [
            f"{ss('OrdinaryVotes', "DeclarationVote = 'N'")} AS ordinary",
            f"{ss('OrdinaryVotes', "PrepollOrdinary = 'Y'")} AS prepoll_ordinary",
            f"{ss('OrdinaryVotes', "PollingPlace = '_dummy_absent'")} AS absent",
            f"{ss('OrdinaryVotes', "PollingPlace = '_dummy_provisional'")} AS provisional",
            f"{ss('OrdinaryVotes', "PollingPlace = '_dummy_prepolldec'")} AS prepoll_dec",
            f"{ss('OrdinaryVotes', "PollingPlace = '_dummy_postal'")} AS postal",
            f"{ss('OrdinaryVotes')} AS total",
        ]
    )
    + "\n  FROM pp_all GROUP BY ALL\n)"
)

DIV_COLS = ["ordinary", "prepoll_ordinary", "absent", "provisional", "prepoll_dec", "postal", "total"]


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join([BASE.strip()] + [p.strip() for p in parts]) + "\n"


def _party_columns(x: str, absent: str = "NULL") -> str:
    """One column per party that can be a finalist; ``absent`` where it has no row."""
    return ", ".join(f"coalesce(max({x}) FILTER (WHERE PartyAb = '{p}'), {absent}) AS {p}" for p in ("ALP", "GRN", "LP", "NP"))


def _house_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["pp_results_by_candidate"] = _with(PP_ALL) + "SELECT * FROM pp_all"
    q["formal_votes_by_party"] = _with(H2) + "SELECT * FROM h2"
    q["polling_place_locations"] = _with() + (
        "SELECT DISTINCT StateAb, DivisionID, DivisionNm, PollingPlaceID, PollingPlace FROM house_fp_pp"
    )
    q["tcp_by_place"] = _with(
        TCP_LONG,
        "tcp_tot AS (SELECT *, CAST(coalesce(sum(votes) OVER (PARTITION BY DivisionNm, PollingPlace), 0) AS BIGINT) AS total FROM tcp_long)",
    ) + f"SELECT DivisionNm, PollingPlace, {_party_columns('votes')}, total FROM tcp_tot GROUP BY DivisionNm, PollingPlace, total"
    q["tcp_by_place_percent"] = _with(
        TCP_LONG,
        "tcp_tot AS (SELECT *, CAST(coalesce(sum(votes) OVER (PARTITION BY DivisionNm, PollingPlace), 0) AS BIGINT) AS total FROM tcp_long)",
        f"tcp_pct AS (SELECT DivisionNm, PollingPlace, PartyAb, total, {pc('votes', 'total')} AS p FROM tcp_tot)",
    ) + f"SELECT DivisionNm, PollingPlace, {_party_columns('p')}, total FROM tcp_pct GROUP BY DivisionNm, PollingPlace, total"
    q["tcp_by_division_percent"] = _with(TCP_LONG, H5_GRID) + (
        f"SELECT DivisionNm, {_party_columns('vote_percent', pc('0', 'total'))}, total FROM h5_long GROUP BY DivisionNm, total"
    )
    q["tcp_by_type"] = _with(TCP_LONG, H5_GRID, H6) + "SELECT * FROM h6"
    q["tcp_everything"] = _with(TCP_LONG, H5_GRID, H6, H7) + "SELECT * FROM h7"
    q["lagging_incumbents"] = _with(TCP_LONG, H5_GRID) + f"""
SELECT e.StateAb, h.DivisionNm, h.PartyAb AS held_party, h.vote_percent AS held_tpp,
       f.Surname AS held_surname, f.GivenNm AS held_givenname, l.lead_party,
       h.total AS number_counted, {pc('h.total', 'e.Enrolment')} AS percent_counted
FROM h5_long h
JOIN (SELECT DivisionNm, PartyAb FROM house_fp_type WHERE HistoricElected = 'Y') s
  ON s.DivisionNm = h.DivisionNm AND s.PartyAb = h.PartyAb
LEFT JOIN house_fp_type f ON f.DivisionNm = h.DivisionNm AND f.PartyAb = h.PartyAb
LEFT JOIN enrolment_div e ON e.DivisionNm = h.DivisionNm
LEFT JOIN (SELECT DivisionNm, PartyAb AS lead_party FROM h5_long WHERE vote_percent > 50) l
  ON l.DivisionNm = h.DivisionNm
WHERE h.vote_percent < 50"""
    q["party_share_by_division"] = _with(
        f"""fdiv AS (SELECT DivisionNm, {ss('TotalVotes')} AS div_total FROM house_fp_type
                     WHERE PartyNm <> 'Informal' GROUP BY DivisionNm)"""
    ) + f"""
SELECT t.StateAb, t.DivisionNm, t.HistoricElected, t.PartyAb, t.TotalVotes,
       {pc('t.TotalVotes', 'd.div_total')} AS prop_vote
FROM house_fp_type t LEFT JOIN fdiv d ON d.DivisionNm = t.DivisionNm
WHERE t.PartyNm <> 'Informal'"""
    vt = (
        f"vt AS (SELECT StateAb, DivisionNm, {ss('OrdinaryVotes')} AS ordinary, {ss('AbsentVotes')} AS absent, "
        f"{ss('ProvisionalVotes')} AS provisional, {ss('PrePollVotes')} AS prepoll_dec, "
        f"{ss('PostalVotes')} AS postal, {ss('TotalVotes')} AS total FROM house_fp_type GROUP BY StateAb, DivisionNm)"
    )
    ppt = (
        f"ppt AS (SELECT StateAb, DivisionNm, DivisionID, PollingPlaceID, PollingPlace, {ss('OrdinaryVotes')} AS votes "
        f"FROM house_fp_pp GROUP BY ALL),\n"
        f"ppo AS (SELECT DivisionNm, {ss('votes')} AS prepoll_ordinary FROM ppt WHERE {_PREPOLL} GROUP BY DivisionNm)"
    )
    q["vote_types_by_division"] = _with(vt, ppt) + (
        "SELECT vt.StateAb, vt.DivisionNm, vt.ordinary, ppo.prepoll_ordinary, vt.absent, vt.provisional, "
        "vt.prepoll_dec, vt.postal, vt.total FROM vt LEFT JOIN ppo ON ppo.DivisionNm = vt.DivisionNm"
    )
    q["vote_types_plain"] = _with(vt) + "SELECT * FROM vt"
    q["division_votes"] = _with(PP_ALL, H11) + "SELECT * FROM h11"
    sums = ",\n    ".join(
        f"coalesce(sum(CASE WHEN Surname <> 'Informal' THEN {c} END) OVER (PARTITION BY DivisionNm), 0) AS f_{c}"
        for c in DIV_COLS
    )
    pcts = ",\n  ".join(
        f"coalesce({r2(f'CASE WHEN Surname = ' + chr(39) + 'Informal' + chr(39) + f' THEN {pc(c, "g_total")} ELSE {pc(c, "f_" + c)} END')}, 0) AS {c}"
        for c in DIV_COLS
    )
    q["division_percent"] = _with(
        PP_ALL,
        H11,
        f"""h12s AS (
  SELECT *, coalesce(sum(total) OVER (PARTITION BY DivisionNm), 0) AS g_total,
    {sums}
  FROM h11
)""",
    ) + f"""SELECT DivisionNm, PartyAb, Surname, GivenNm, Elected, HistoricElected,
  {pcts}
FROM h12s"""
    q["division_tcp_votes"] = _with(TCP_LONG, H5_GRID, H6, H7) + (
        "SELECT DivisionNm, PartyAb, Surname, GivenNm, Elected, HistoricElected, "
        + ", ".join(TCP_TYPES)
        + " FROM h7"
    )
    q["division_tcp_percent"] = _with(TCP_LONG, H5_GRID, H6, H7) + (
        "SELECT DivisionNm, PartyAb, Surname, GivenNm, Elected, HistoricElected, "
        + ", ".join(f"coalesce({r2('tpp_percent_' + c)}, 0) AS {c}" for c in TCP_TYPES)
        + " FROM h7"
    )
    q["public_funding"] = _with(
        H2,
        f"h15t AS (SELECT DivisionNm, {ss('votes')} AS total FROM h2 GROUP BY DivisionNm)",
        f"""h15f AS (
  SELECT h2.PartyAb, {ss('h2.votes')} AS total_votes
  FROM h2 LEFT JOIN h15t t ON t.DivisionNm = h2.DivisionNm
  WHERE {pc('h2.votes', 't.total')} > 4.0
  GROUP BY h2.PartyAb
)""",
    ) + """SELECT PartyAb, total_votes, CAST(total_votes AS DOUBLE) * 262.784::DOUBLE / 100 AS funding,
       CASE WHEN PartyAb IN ('LP', 'LNP', 'NP', 'CLP') THEN 'COAL' ELSE PartyAb END AS "group"
FROM h15f"""
    q["seat_summary"] = _with(
        PP_ALL,
        TCP_LONG,
        H5_GRID,
        H6,
        H7,
        f"""st AS (
  SELECT StateAb, DivisionID, DivisionNm, {ss('OrdinaryVotes')} AS total_votes FROM pp_all GROUP BY ALL
),
lead AS (
  SELECT DivisionID, PartyAb AS leading_party, div_percent_TotalVotes AS leading_tcp, margin_votes AS margin
  FROM h7 WHERE div_percent_TotalVotes >= 50
),
lag AS (
  SELECT DivisionID, PartyAb AS lagging_party, div_percent_TotalVotes AS lagging_tcp
  FROM h7 WHERE div_percent_TotalVotes < 50
)""",
    ) + f"""SELECT st.StateAb, st.DivisionID, st.DivisionNm, st.total_votes, e.Enrolment,
  {r2(pc('st.total_votes', 'e.Enrolment'))} AS turnout,
  hi.p AS HistoricElected, el.p AS Elected,
  lead.leading_party, {r2('lead.leading_tcp')} AS leading_tcp,
  lag.lagging_party, {r2('lag.lagging_tcp')} AS lagging_tcp,
  lead.margin, {r2('sw.Swing')} AS Swing
FROM st
LEFT JOIN enrolment_div e ON e.DivisionID = st.DivisionID
LEFT JOIN (SELECT DivisionID, min(PartyAb) AS p FROM pp_all WHERE HistoricElected = 'Y' GROUP BY 1) hi ON hi.DivisionID = st.DivisionID
LEFT JOIN (SELECT DivisionID, min(PartyAb) AS p FROM pp_all WHERE Elected = 'Y' GROUP BY 1) el ON el.DivisionID = st.DivisionID
LEFT JOIN lead ON lead.DivisionID = st.DivisionID
LEFT JOIN lag ON lag.DivisionID = lead.DivisionID
LEFT JOIN house_tcp_type sw ON sw.DivisionID = st.DivisionID AND sw.PartyAb = lead.leading_party"""
    blocs = (
        "CASE WHEN PartyAb = 'ALP' THEN 'ALP' WHEN PartyAb IN ('LP', 'LNP', 'NP', 'CLP') THEN 'COAL' "
        "WHEN PartyAb = 'GRN' THEN 'GRN' END"
    )
    long = "\n  UNION ALL ".join(
        f"SELECT {blocs} AS bloc, '{c}' AS Type, tpp_percent_{c} AS v FROM h7" for c in TCP_TYPES
    )
    aggs = ",\n    ".join(
        f"avg(v) FILTER (WHERE bloc = '{b}') AS {b}_mean, stddev_samp(v) FILTER (WHERE bloc = '{b}') AS {b}_sd, "
        f"CAST(count(*) FILTER (WHERE bloc = '{b}') AS DOUBLE) AS {b}_n"
        for b in ["ALP", "COAL", "GRN"]
    )
    stats = "\nUNION ALL ".join(
        f"SELECT Type, '{s}' AS Stat, {r2('ALP_' + s)} AS ALP, {r2('COAL_' + s)} AS COAL, {r2('GRN_' + s)} AS GRN FROM cmp"
        for s in ["mean", "sd", "n"]
    )
    q["tcp_comparison"] = _with(
        TCP_LONG,
        H5_GRID,
        H6,
        H7,
        f"cl AS (SELECT * FROM (\n  {long}\n) WHERE bloc IS NOT NULL)",
        f"cmp AS (SELECT Type,\n    {aggs}\n  FROM cl GROUP BY Type)",
    ) + stats

    # dormant reports
    q["tcp_division_party"] = _with(
        TCP_LONG,
        H5_GRID,
        f"""all_places AS (SELECT DISTINCT DivisionNm, PollingPlace FROM tcp_long),
d1_cells AS (
  SELECT g.DivisionNm, p.PartyAb, t.votes
  FROM all_places g CROSS JOIN tcp_parties p
  LEFT JOIN tcp_long t ON t.DivisionNm = g.DivisionNm AND t.PollingPlace = g.PollingPlace AND t.PartyAb = p.PartyAb
)""",
    ) + f"SELECT * FROM (SELECT DivisionNm, PartyAb, {ss('votes')} AS votes FROM d1_cells GROUP BY ALL) WHERE votes IS NOT NULL"
    q["division_votes_tcp"] = _with(
        PP_ALL,
        H11,
        TCP_LONG,
        H5_GRID,
        H6,
    ) + (
        "SELECT h11.*, (CASE WHEN h.vote_percent <> 0 THEN h.vote_percent END) / 100 * h.total AS tcp_votes, "
        + ", ".join(f"h6.{c} AS tcp_{c}" for c in TCP_TYPES + ["Swing"])
        + "\nFROM h11 LEFT JOIN h5_long h ON h.DivisionNm = h11.DivisionNm AND h.PartyAb = h11.PartyAb"
        + "\nLEFT JOIN h6 ON h6.CandidateID = h11.CandidateID"
    )
    tpp = [f"tpp_percent_{c}" for c in TCP_TYPES]
    diff_names = ["OrdinaryVotes", "PrepollOrdinary", "Absent", "Provisional", "PrePollVotes", "PostalVotes", "TotalVotes"]
    q["tcp_lead_lag_diff"] = _with(TCP_LONG, H5_GRID, H6, H7) + (
        "SELECT a.DivisionID, a.DivisionNm, a.PartyAb AS leading_PartyAb, "
        + ", ".join(f"a.{c} AS leading_{c}" for c in TCP_TYPES + tpp)
        + ", b.PartyAb AS lagging_PartyAb, "
        + ", ".join(f"b.{c} AS lagging_{c}" for c in TCP_TYPES + tpp)
        + ", a.total_TotalVotes AS TotalVotes, a.Enrolment, "
        + ", ".join(f"a.{c} - b.{c} AS diff_{n}" for c, n in zip(TCP_TYPES, diff_names))
        + "\nFROM (SELECT * FROM h7 WHERE div_percent_TotalVotes >= 50) a"
        + "\nLEFT JOIN (SELECT * FROM h7 WHERE div_percent_TotalVotes < 50) b ON b.DivisionID = a.DivisionID"
    )
    return q


# --- Senate -------------------------------------------------------------------------


def _quota(total: str, vacancies: int) -> str:
    return f"CASE WHEN StateAb IN ('ACT', 'NT') THEN {total} / 3 + 1 ELSE {total} / {vacancies + 1} + 1 END"


def _senate_quotas(vacancies: int) -> str:
    return f"""(SELECT g.StateAb, g.GroupAb, g.TotalVotes, g.TotalVotes / nullif(q.quota, 0) AS num_quotas
  FROM senate_fp_group g LEFT JOIN (
    SELECT StateAb, {_quota('state_total', vacancies)} AS quota
    FROM (SELECT StateAb, {ss('TotalVotes')} AS state_total FROM senate_fp_group GROUP BY StateAb)
  ) q ON q.StateAb = g.StateAb)"""


def _senate_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["senate_turnout"] = _with(
        f"sv AS (SELECT StateAb, {ss('TotalVotes')} AS votes FROM senate_fp_div GROUP BY StateAb)",
        f"se AS (SELECT StateAb, {ss('Enrolment')} AS enrolment FROM enrolment_div GROUP BY StateAb)",
    ) + f"SELECT sv.StateAb, sv.votes, {pc('sv.votes', 'se.enrolment')} AS percent_enrolment FROM sv LEFT JOIN se ON se.StateAb = sv.StateAb"
    q["senate_quotas_half"] = _with() + f"SELECT * FROM {_senate_quotas(6)}"
    q["senate_quotas_full"] = _with() + f"SELECT * FROM {_senate_quotas(12)}"
    keys = "StateAb, Ticket, BallotPosition, PartyAb, PartyName, CandidateDetails, Elected, HistoricElected"
    cols = ["OrdinaryVotes", "AbsentVotes", "ProvisionalVotes", "PrePollVotes", "PostalVotes", "TotalVotes"]
    q["senate_quotas_candidate"] = _with(
        f"sq AS (SELECT StateAb, {_quota('st', 6)} AS quota FROM (SELECT StateAb, {ss('TotalVotes')} AS st FROM senate_fp_div GROUP BY StateAb))",
        f"sc AS (SELECT {keys}, " + ", ".join(f"{ss(c)} AS {c}" for c in cols) + f" FROM senate_fp_div GROUP BY {keys})",
    ) + "SELECT sc.*, sc.TotalVotes / nullif(sq.quota, 0) AS Quotas FROM sc LEFT JOIN sq ON sq.StateAb = sc.StateAb"
    q["senate_quotas_dd_hs"] = _with(
        f"st AS (SELECT StateAb, {ss('TotalVotes')} AS t FROM senate_fp_group GROUP BY StateAb)"
    ) + (
        f"SELECT g.StateAb, g.GroupAb, g.TotalVotes, g.TotalVotes / nullif(({_quota('st.t', 12).replace('StateAb', 'st.StateAb')}), 0) AS num_quotas_dd, "
        f"g.TotalVotes / nullif(({_quota('st.t', 6).replace('StateAb', 'st.StateAb')}), 0) AS num_quotas_hs "
        "FROM senate_fp_group g LEFT JOIN st ON st.StateAb = g.StateAb"
    )
    q["senate_quotas_both"] = _with() + (
        f"SELECT h.StateAb, h.GroupAb, h.TotalVotes, h.num_quotas AS quotas_hs, f.num_quotas AS quotas_fs "
        f"FROM {_senate_quotas(6)} h LEFT JOIN {_senate_quotas(12)} f ON f.StateAb = h.StateAb AND f.GroupAb = h.GroupAb"
    )
    return q


# --- pre-poll -----------------------------------------------------------------------

PREPOLL_BASE = """WITH ev AS (
  SELECT CASE WHEN day(ts) <= 16 THEN '2013' ELSE '2016' END AS Election,
         event_type AS State,
         'D' || CAST(user_id % 5 AS VARCHAR) AS Division,
         printf('Day%02d', CASE WHEN day(ts) <= 16 THEN day(ts) ELSE day(ts) - 16 END) AS "Day"
  FROM events
),
pcounts AS (SELECT Election, State, Division, "Day", count(*) AS Votes FROM ev GROUP BY ALL),
days AS (SELECT printf('Day%02d', d) AS "Day" FROM range(1, 17) t(d)),
enrol AS (SELECT Election, State, CAST(2 * count(*) AS BIGINT) AS enrolled_total FROM ev GROUP BY ALL)
"""


def _prepoll_grid(keys: list[str]) -> str:
    """Per key combination present in an election: every one of the 16 days, missing = 0."""
    k = ", ".join(keys)
    on = " AND ".join(f"c.{x} = g.{x}" for x in keys)
    return f"""(SELECT g.Election{''.join(', g.' + x for x in keys)}, d."Day",
        CAST(coalesce(sum(c.Votes), 0) AS BIGINT) AS Votes
  FROM (SELECT DISTINCT Election{', ' + k if k else ''} FROM pcounts) g CROSS JOIN days d
  LEFT JOIN pcounts c ON c.Election = g.Election AND c."Day" = d."Day"{' AND ' + on if on else ''}
  GROUP BY ALL)"""


def _run(keys: list[str]) -> str:
    part = ", ".join(["Election"] + keys)
    return f'sum(Votes) OVER (PARTITION BY {part} ORDER BY "Day" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)'


def _prepoll_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    enrol_nat = "CASE Election WHEN '2016' THEN 15676659 ELSE 14712799 END"
    days = ",\n  ".join(
        (f"CAST(coalesce(sum(Votes) FILTER (WHERE \"Day\" = 'Day{d:02d}'), 0) AS BIGINT)" if d <= 15 else
         f"CASE WHEN Election = '2013' THEN CAST(coalesce(sum(Votes) FILTER (WHERE \"Day\" = 'Day{d:02d}'), 0) AS BIGINT) END")
        + f" AS Day{d:02d}"
        for d in range(1, 17)
    )
    q["prepoll_combined"] = PREPOLL_BASE + f"""SELECT State, Division,
  CASE WHEN Election = '2013' THEN Division || ' PPVC' END AS Centre,
  {days},
  Election,
  CASE WHEN Election = '2016' THEN Division || ' PPVC' END AS m_centre_nm
FROM pcounts GROUP BY Election, State, Division"""
    q["prepoll_daily"] = PREPOLL_BASE + f"SELECT * FROM {_prepoll_grid([])}"
    q["prepoll_cumulative"] = (
        PREPOLL_BASE
        + f""", nat AS (SELECT *, CAST({_run([])} AS BIGINT) AS cum FROM {_prepoll_grid([])})
SELECT Election, "Day", nullif(Votes, 0) AS Votes,
  CASE WHEN NOT (Election = '2016' AND Votes = 0) THEN cum END AS Cum_Total,
  nullif(Votes, 0) / {enrol_nat} AS Prop_Votes,
  CASE WHEN NOT (Election = '2016' AND Votes = 0) THEN cum / {enrol_nat} * 100 END AS Cum_Prop
FROM nat"""
    )
    state_cum = f"""sc AS (
  SELECT Election, State, "Day", Votes,
    CASE WHEN NOT (Election = '2016' AND Votes = 0) THEN CAST({_run(['State'])} AS BIGINT) END AS Cum_Total
  FROM {_prepoll_grid(['State'])}
)"""
    q["prepoll_state_cumulative"] = PREPOLL_BASE + ", " + state_cum + "\nSELECT * FROM sc"
    q["prepoll_state_rate"] = PREPOLL_BASE + ", " + state_cum + """
SELECT sc.Election, sc.State, sc."Day", sc.Votes, sc.Cum_Total, e.enrolled_total,
  CASE WHEN NOT (sc.Election = '2016' AND sc.Votes = 0) THEN sc.Cum_Total / nullif(e.enrolled_total, 0) END AS State_Prop
FROM sc LEFT JOIN enrol e ON e.Election = sc.Election AND e.State = sc.State"""
    q["enrolment_by_state"] = PREPOLL_BASE + "SELECT State, enrolled_total, Election FROM enrol"
    q["prepoll_division"] = PREPOLL_BASE + f"""
SELECT Election,
  CASE WHEN Election = '2013' AND Division = 'Fraser' THEN 'Fenner'
       WHEN Election = '2013' AND Division = 'Throsby' THEN 'Whitlam' ELSE Division END AS Division,
  "Day", Votes,
  CASE WHEN NOT (Election = '2016' AND Votes = 0) THEN CAST({_run(['Division'])} AS BIGINT) END AS Cum_Total
FROM {_prepoll_grid(['Division'])}"""
    q["prepoll_state_totals"] = PREPOLL_BASE + """, tot AS (
  SELECT Election, State, CAST(sum(Votes) AS BIGINT) AS State_Totals FROM pcounts GROUP BY ALL
)
SELECT t.Election, t.State, t.State_Totals, e.enrolled_total, t.State_Totals / nullif(e.enrolled_total, 0) AS State_Vote_Prop
FROM tot t LEFT JOIN enrol e ON e.Election = t.Election AND e.State = t.State"""
    return q


def oracle_queries() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(_house_queries())
    out.update(_senate_queries())
    out.update(_prepoll_queries())
    return out
