"""Election-shaped feeds derived from the driver's warehouse tables.

The warehouse holds no election data, so a fixed re-labelling turns its rows
into ballots: a line item is a bundle of votes for one candidate at one
polling place, its order carries the vote type and its customer's nation is
the division. The feeds the reports read are aggregates of those ballots.

Scale design: the big join runs once and is immediately collapsed into a
compact *grain* table (division x polling place x candidate slot x vote type
x TCP side), with partial aggregation before the shuffle, so what moves after
the join is tiny whatever the input size. Only keys and small codes cross the
two big shuffles (orders x customer on custkey, then lineitem x orders on
orderkey, the only shuffle of line-item-sized data; AQE splits a skewed key);
names are attached after the aggregate. The grain is then cut from its
lineage (reliable checkpoint into the cluster's ``spark.checkpoint.dir``,
else a memory-and-disk persist): left lazy, predicate pushdown would give
every feed its own copy of the join.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.constants import DAY_FORMAT, INFORMAL, PREPOLL_DAYS
from psephos.functions import case_sql, lit_sql
from psephos.plans.sizing import materialize
from psephos.sources.inputs import HouseInputs, PrepollInputs, SenateInputs
from psephos.sources.schemas import PREPOLL_2013_IDS, PREPOLL_2016_IDS

# --- fixed values of the view (re-labelling of the warehouse tables) ---------

STATE_OF_REGION = {
    "AFRICA": "NSW",
    "AMERICA": "VIC",
    "ASIA": "ACT",
    "EUROPE": "NT",
    "MIDDLE EAST": "TAS",
}

# Candidate slot from l_partkey % 100: first upper bound that is greater wins.
SLOT_BOUNDS = [(34, 1), (60, 2), (75, 3), (88, 4), (91, 5), (94, 6), (96, 7)]
INFORMAL_SLOT = 8

PARTY_OF_SLOT = {1: "ALP", 2: "LP", 3: "NP", 4: "GRN", 5: "IND", 6: "IND", 7: "MIN", 8: ""}

VOTE_TYPE_OF_PRIORITY = {
    "1-URGENT": "OrdinaryVotes",
    "2-HIGH": "AbsentVotes",
    "3-MEDIUM": "ProvisionalVotes",
    "4-NOT SPECIFIED": "PrePollVotes",
    "5-LOW": "PostalVotes",
}

# Final two candidate slots by DivisionID % 4.
FINALISTS = {0: (1, 2), 1: (1, 2), 2: (1, 4), 3: (2, 3)}

# Parties that can be a finalist: the columns of the wide TCP tables.
TCP_PARTIES = sorted({PARTY_OF_SLOT[s] for pair in FINALISTS.values() for s in pair})

ENROLMENT_PER_ROW = 27
ENROLLED_PER_EVENT = 2
# A place k of a seat: ten of each hundred suppliers are one, so places grow with
# the suppliers; k % 10 is its kind.
PLACE_SQL = "l_suppkey % 10 + 10 * (l_suppkey DIV 100)"
PREPOLL_SPLIT_DAY = 16  # days 1-16 are the 2013 campaign, 17-31 the 2016 one

WAREHOUSE_TABLES = ["lineitem", "orders", "customer", "nation", "region"]

# --- helpers ------------------------------------------------------------------

# Declared read schemas: only the columns the view uses, so the scan prunes to
# them and no footer-sampling job runs to infer a schema.
WAREHOUSE_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "ts timestamp_ntz, user_id bigint, event_type string",
}


def read_tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    out = {}
    for n in names:
        reader = spark.read.schema(WAREHOUSE_SCHEMAS[n]) if n in WAREHOUSE_SCHEMAS else spark.read
        out[n] = reader.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet")
    return out


def _slot_sql(partkey: str) -> str:
    whens = " ".join(f"WHEN {partkey} % 100 < {b} THEN {s}" for b, s in SLOT_BOUNDS)
    return f"CASE {whens} ELSE {INFORMAL_SLOT} END"


def _finalist_sql(which: int) -> str:
    return "(" + case_sql("DivisionID % 4", {k: v[which] for k, v in FINALISTS.items()}) + ")"


_PARTY_SQL = case_sql("slot", PARTY_OF_SLOT)

# Candidate attributes as functions of (DivisionID, slot).
_CANDIDATE_SQL = {
    "CandidateID": "DivisionID * 100 + slot",
    "Surname": f"CASE WHEN slot = {INFORMAL_SLOT} THEN {lit_sql(INFORMAL)} ELSE concat('Cand', CAST(slot AS STRING)) END",
    "GivenNm": "concat('G', CAST(slot AS STRING))",
    "BallotPosition": "CAST(slot AS BIGINT)",
    "Elected": f"CASE WHEN slot = {_finalist_sql(0)} THEN 'Y' ELSE 'N' END",
    "HistoricElected": "CASE WHEN slot = DivisionID % 4 + 1 THEN 'Y' ELSE 'N' END",
    "PartyAb": _PARTY_SQL,
    "PartyNm": f"CASE WHEN slot = {INFORMAL_SLOT} THEN {lit_sql(INFORMAL)} ELSE concat('Party ', {_PARTY_SQL}) END",
    "Swing": "((DivisionID * 7 + slot * 3) % 21 - 10) / 2.0D",
}

_PLACE_SQL = {
    "PollingPlaceID": "k * 100 + DivisionID",
    "PollingPlace": (
        "CASE k % 10 WHEN 0 THEN concat(DivisionNm, ' PPVC ', CAST(k AS STRING)) "
        "WHEN 1 THEN concat('PREPOLL ', DivisionNm, ' ', CAST(k AS STRING)) "
        "ELSE concat(DivisionNm, ' Booth ', CAST(k AS STRING)) END"
    ),
}


def _exprs(cols: list[str], known: dict[str, str]) -> list[str]:
    return [f"{known[c]} AS {c}" if c in known else c for c in cols]


# --- the grain ----------------------------------------------------------------


def ballot_grain(tables: dict[str, DataFrame]) -> DataFrame:
    """Votes and ballot rows per (division, place, slot, vote type, parity).

    Only keys and codes cross the two big shuffles: the order side carries
    (orderkey, nation key, vote-type code), not names; the line side carries
    its four raw columns. Division and state names are attached after the
    aggregate, against the few-row nation x region dimension.
    """
    vcodes = {p: i for i, p in enumerate(VOTE_TYPE_OF_PRIORITY, start=1)}
    orders = tables["orders"].selectExpr(
        "o_orderkey", "o_custkey", f"{case_sql('o_orderpriority', vcodes)} AS vcode"
    )
    cust = tables["customer"].select("c_custkey", "c_nationkey")
    order_seat = orders.join(cust, orders.o_custkey == cust.c_custkey).selectExpr(
        "o_orderkey AS l_orderkey", "c_nationkey", "vcode"
    )
    lines = tables["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    rows = lines.join(order_seat, "l_orderkey").selectExpr(
        "c_nationkey",
        "vcode",
        f"{PLACE_SQL} AS k",
        f"{_slot_sql('l_partkey')} AS slot",
        "l_partkey % 2 AS parity",
        "CAST(l_quantity AS BIGINT) AS votes",
    )
    cells = rows.groupBy("c_nationkey", "vcode", "k", "slot", "parity").agg(
        F.expr("sum(votes) AS votes"), F.expr("count(1) AS n_rows")
    )
    # Dimensions carry no hint: Spark broadcasts them only when their
    # statistics pass spark.sql.autoBroadcastJoinThreshold (re-checked by AQE
    # with runtime sizes), so a dimension that grows falls back to a shuffle.
    nation, region = tables["nation"], tables["region"]
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).selectExpr(
        "n_nationkey AS c_nationkey",
        "CAST(n_nationkey AS BIGINT) AS DivisionID",
        "n_name AS DivisionNm",
        f"{case_sql('r_name', STATE_OF_REGION)} AS StateAb",
    )
    vtype = case_sql("vcode", {i: VOTE_TYPE_OF_PRIORITY[p] for p, i in vcodes.items()})
    # Seats without provisional votes (theirs count as postal), and seats
    # without pre-poll places (theirs count at two of the booths). Every row
    # stays; two cells may now share a key, and the feeds sum again.
    moved_type = f"CASE WHEN DivisionID % 6 = 5 AND {vtype} = 'ProvisionalVotes' THEN 'PostalVotes' ELSE {vtype} END"
    moved_place = f"CASE WHEN DivisionID % 5 = 4 AND {vtype} = 'OrdinaryVotes' AND k % 10 < 2 THEN k + 2 ELSE k END"
    return cells.join(geo, "c_nationkey").selectExpr(
        "StateAb", "DivisionID", "DivisionNm", f"{moved_type} AS vtype", f"{moved_place} AS k", "slot", "parity", "votes", "n_rows"
    )


# --- House feeds ----------------------------------------------------------------

_PP_COLS = [
    "StateAb",
    "DivisionID",
    "DivisionNm",
    "PollingPlaceID",
    "PollingPlace",
    "CandidateID",
    "Surname",
    "GivenNm",
    "Elected",
    "HistoricElected",
    "PartyAb",
    "PartyNm",
    "OrdinaryVotes",
]
_VT = list(VOTE_TYPE_OF_PRIORITY.values())
_TYPE_COLS = (
    ["StateAb", "DivisionID", "DivisionNm", "CandidateID", "Surname", "GivenNm"]
    + ["Elected", "HistoricElected", "PartyAb", "PartyNm"]
    + _VT
    + ["TotalVotes"]
)
_TCP_TYPE_COLS = (
    ["StateAb", "DivisionID", "DivisionNm", "CandidateID", "Surname", "GivenNm", "BallotPosition"]
    + ["Elected", "HistoricElected", "PartyAb", "PartyNm"]
    + _VT
    + ["TotalVotes", "Swing"]
)


def _by_place(grain: DataFrame) -> DataFrame:
    out = grain.groupBy("StateAb", "DivisionID", "DivisionNm", "k", "slot").agg(F.expr("sum(votes) AS OrdinaryVotes"))
    return out.selectExpr(*_exprs(_PP_COLS, {**_PLACE_SQL, **_CANDIDATE_SQL}))


def _by_type(grain: DataFrame, cols: list[str]) -> DataFrame:
    sums = [f"coalesce(sum(CASE WHEN vtype = '{t}' THEN votes END), 0L) AS {t}" for t in _VT]
    out = grain.groupBy("StateAb", "DivisionID", "DivisionNm", "slot").agg(*[F.expr(e) for e in sums])
    total = {"TotalVotes": " + ".join(_VT)}
    return out.selectExpr(*_exprs(cols, {**_CANDIDATE_SQL, **total}))


def _tcp_rows(grain: DataFrame) -> DataFrame:
    """Formal grain rows re-assigned to the finalist who holds them after preferences."""
    owner = f"CASE WHEN parity = 0 THEN {_finalist_sql(0)} ELSE {_finalist_sql(1)} END"
    return grain.where(f"slot < {INFORMAL_SLOT}").withColumn("slot", F.expr(owner))


class GrainHouseInputs:
    """House feeds over the ballot grain, each built on first use (a report
    that reads three feeds does not plan the other two)."""

    parties = TCP_PARTIES

    def __init__(self, grain: DataFrame):
        self.grain = grain

    @cached_property
    def fp_pp(self) -> DataFrame:
        return _by_place(self.grain.where("vtype = 'OrdinaryVotes'"))

    @cached_property
    def fp_type(self) -> DataFrame:
        return _by_type(self.grain, _TYPE_COLS)

    @cached_property
    def _tcp(self) -> DataFrame:
        return _tcp_rows(self.grain)

    @cached_property
    def tcp_pp(self) -> DataFrame:
        return _by_place(self._tcp.where("vtype = 'OrdinaryVotes'"))

    @cached_property
    def tcp_type(self) -> DataFrame:
        return _by_type(self._tcp, _TCP_TYPE_COLS)

    @cached_property
    def enrolment(self) -> DataFrame:
        return self.grain.groupBy("StateAb", "DivisionID", "DivisionNm").agg(
            F.expr(f"sum(n_rows) * {ENROLMENT_PER_ROW} AS Enrolment")
        )

    @cached_property
    def pp_location(self) -> DataFrame:
        return self.fp_pp.select("StateAb", "DivisionID", "DivisionNm", "PollingPlaceID", "PollingPlace").distinct()


class GrainSenateInputs:
    """Senate feeds over the ballot grain, built on first use."""

    def __init__(self, grain: DataFrame):
        self.grain = grain

    @cached_property
    def fp_div(self) -> DataFrame:
        by_cand = _by_type(self.grain, _TYPE_COLS + ["BallotPosition"])
        return by_cand.selectExpr(
            "StateAb",
            "DivisionNm",
            "char(64 + BallotPosition) AS Ticket",
            "BallotPosition",
            "PartyAb",
            "PartyNm AS PartyName",
            "Surname AS CandidateDetails",
            "Elected",
            "HistoricElected",
            *_VT,
            "TotalVotes",
        )

    @cached_property
    def fp_group(self) -> DataFrame:
        return (
            self.fp_div.groupBy("StateAb", "Ticket")
            .agg(F.expr("sum(TotalVotes) AS TotalVotes"))
            .withColumnRenamed("Ticket", "GroupAb")
        )


def house_inputs(grain: DataFrame) -> HouseInputs:
    """House feeds (same fields as a loaded ``HouseInputs``), built lazily."""
    return GrainHouseInputs(grain)  # type: ignore[return-value]


def senate_inputs(grain: DataFrame) -> SenateInputs:
    return GrainSenateInputs(grain)  # type: ignore[return-value]


def election_inputs(
    spark: SparkSession, sf_dir: str, cache: str = "auto", kept: list[DataFrame] | None = None
) -> tuple[HouseInputs, SenateInputs]:
    """House and Senate feeds over one materialized ballot grain.

    The grain is cut from its lineage (``cache``, see ``materialize``) so the
    five-way join runs once however many feeds and reports read it; without
    the cut, predicate pushdown gives every feed its own copy of the join.
    ``kept`` takes what was materialized, for ``release``.
    """
    grain = materialize(ballot_grain(read_tables(spark, sf_dir, WAREHOUSE_TABLES)), cache, kept)
    return house_inputs(grain), senate_inputs(grain)


# --- pre-poll feeds -------------------------------------------------------------


def _day_names(n: int) -> list[str]:
    return [DAY_FORMAT % d for d in range(1, n + 1)]


def prepoll_inputs(
    spark: SparkSession, sf_dir: str, cache: str = "auto", kept: list[DataFrame] | None = None
) -> PrepollInputs:
    """Two wide daily pre-poll files and two enrolment texts from ``events``; ``kept`` as for the election."""
    ev = read_tables(spark, sf_dir, ["events"])["events"]
    d, split = "dayofmonth(ts)", PREPOLL_SPLIT_DAY
    counts = (
        ev.selectExpr(
            f"CASE WHEN {d} <= {split} THEN '2013' ELSE '2016' END AS Election",
            "event_type AS State",
            "concat('D', CAST(user_id % 5 AS STRING)) AS Division",
            f"format_string('{DAY_FORMAT}', CASE WHEN {d} <= {split} THEN {d} ELSE {d} - {split} END) AS Day",
        )
        .groupBy("Election", "State", "Division", "Day")
        .agg(F.expr("count(1) AS Votes"))
    )
    # Four feeds read these counts: scan the events once.
    counts = materialize(counts, cache, kept)

    def wide(election: str, days: int, ids: list[str]) -> DataFrame:
        names = _day_names(days)
        w = (
            counts.where(f"Election = '{election}'")
            .groupBy("State", "Division")
            .pivot("Day", names)
            .agg(F.expr("sum(Votes)"))
            .fillna(0, subset=names)
        )
        return w.selectExpr(
            f"State AS {ids[0]}", f"Division AS {ids[1]}", f"concat(Division, ' PPVC') AS {ids[2]}", *names
        )

    pp13 = wide("2013", PREPOLL_DAYS, PREPOLL_2013_IDS)
    pp16 = wide("2016", 31 - PREPOLL_SPLIT_DAY, PREPOLL_2016_IDS)

    enrolled = counts.groupBy("Election", "State", "Division").agg(F.expr(f"sum(Votes) * {ENROLLED_PER_EVENT} AS n"))
    enrol16 = enrolled.where("Election = '2016'").selectExpr(
        "State", "Division", "format_number(n, 0) AS Electors_on_2016_Certified_list"
    )
    enrol13 = (
        enrolled.where("Election = '2013'")
        .groupBy("State")
        .agg(F.expr("sum(n) AS n"))
        .selectExpr("State", "regexp_replace(format_number(n, 0), ',', ' ') AS Electors_enrolled")
    )
    return PrepollInputs(pp13, pp16, enrol13, enrol16)
