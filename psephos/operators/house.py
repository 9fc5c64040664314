"""House of Representatives reports.

Every report is a function from DataFrames to a DataFrame. Party matrices are
kept long ``(keys, PartyAb, votes)`` and pivoted only at the output edge.
Shares of a group total use a window aggregate instead of aggregate plus
self-join (one shuffle instead of two). Reports with a ``division`` argument
accept ``None`` for all divisions at once, which is the form that scales.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.constants import (
    COALITION_LABEL,
    COALITION_PARTIES,
    DUMMY_PLACES,
    FUNDING_CENTS_PER_VOTE,
    FUNDING_THRESHOLD_PERCENT,
    INFORMAL,
    TCP_TYPES,
    VOTE_COLUMNS,
)
from psephos.functions import (
    asc_last,
    case_sql,
    desc_last,
    left_join_na,
    lit_sql,
    pct,
    pct_sql,
    prepoll_place_sql,
    q,
    round_doubles,
    strict_sum,
    strict_sum_over,
)
from psephos.plans.sizing import materialize

_INFORMAL = lit_sql(INFORMAL)
_DUMMY_CASE = case_sql("vote_column", DUMMY_PLACES)


def _numeric_fill0(df: DataFrame) -> DataFrame:
    cols = [f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer", "double")]
    return df.fillna(0, subset=cols)


def _by_division(df: DataFrame, division: str | None) -> DataFrame:
    return df if division is None else df.where(f"DivisionNm = {lit_sql(division)}")


# --- H1 ---------------------------------------------------------------------------


def polling_place_results_by_candidate(fp_pp: DataFrame, fp_type: DataFrame) -> DataFrame:
    """First preferences per polling place, declaration votes as dummy places."""
    ids = [c for c in fp_type.columns if c not in VOTE_COLUMNS]
    decl = (
        fp_type.select(*ids, *DUMMY_PLACES)
        .unpivot(ids, list(DUMMY_PLACES), "vote_column", "OrdinaryVotes")
        .selectExpr("*", f"{_DUMMY_CASE} AS PollingPlace", "'Y' AS DeclarationVote")
        .drop("vote_column")
    )
    out = fp_pp.selectExpr("*", "'N' AS DeclarationVote").unionByName(decl, allowMissingColumns=True)
    order = fp_pp.columns + [c for c in decl.columns if c not in fp_pp.columns]
    return out.selectExpr(
        *[q(c) for c in order], f"CASE WHEN {prepoll_place_sql()} THEN 'Y' ELSE 'N' END AS PrepollOrdinary"
    )


# --- H2 ---------------------------------------------------------------------------


def formal_votes_by_party(fp_pp: DataFrame) -> DataFrame:
    """Formal first-preference votes per division and party."""
    return (
        fp_pp.where(f"PartyNm != {_INFORMAL}")
        .groupBy("DivisionNm", "PartyAb")
        .agg(strict_sum("OrdinaryVotes").alias("votes"))
    )


# --- H3-H5: TCP party matrix --------------------------------------------------------


def tcp_long(tcp_pp: DataFrame, tcp_type: DataFrame) -> DataFrame:
    """TCP votes per (DivisionNm, PollingPlace, PartyAb), declaration votes as dummy places."""
    places = tcp_pp.groupBy("DivisionNm", "PollingPlace", "PartyAb").agg(strict_sum("OrdinaryVotes").alias("votes"))
    decl = (
        tcp_type.groupBy("DivisionNm", "PartyAb")
        .agg(*[strict_sum(c).alias(c) for c in DUMMY_PLACES])
        .unpivot(["DivisionNm", "PartyAb"], list(DUMMY_PLACES), "vote_column", "votes")
        .selectExpr("DivisionNm", f"{_DUMMY_CASE} AS PollingPlace", "PartyAb", "votes")
    )
    return places.unionByName(decl)


def _party_columns(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys and c != "total"]


def _row_total(parties: list[str]) -> str:
    """SQL text: the sum of the party cells of a row, a missing party as 0."""
    return " + ".join([f"coalesce({q(p)}, 0)" for p in parties] or ["0"])


def tcp_by_place(long: DataFrame, parties: list[str] | None = None) -> DataFrame:
    """Wide TCP table: one column per party (NULL where absent), plus ``total``."""
    keys = ["DivisionNm", "PollingPlace"]
    wide = long.groupBy(*keys).pivot("PartyAb", parties).agg(F.first("votes"))
    cols = _party_columns(wide, keys)
    return wide.selectExpr(*keys, *[q(p) for p in cols], f"CAST({_row_total(cols)} AS BIGINT) AS total")


def tcp_by_place_percent(wide: DataFrame) -> DataFrame:
    """Each party column of the wide TCP table as a percent of the row total."""
    parties = _party_columns(wide, ["DivisionNm", "PollingPlace"])
    return wide.withColumns({p: pct(p, "total") for p in parties})


def tcp_by_division_counts(long: DataFrame, parties: list[str] | None = None) -> DataFrame:
    """TCP votes per division, one column per party; absent party counts 0."""
    wide = long.groupBy("DivisionNm").pivot("PartyAb", parties).agg(F.sum("votes"))
    cols = _party_columns(wide, ["DivisionNm"])
    return wide.selectExpr(
        "DivisionNm", *[f"coalesce({q(p)}, 0) AS {q(p)}" for p in cols], f"CAST({_row_total(cols)} AS BIGINT) AS total"
    )


def tcp_by_division_percent(long: DataFrame, parties: list[str] | None = None) -> DataFrame:
    """TCP share of each party per division (0 where the party is absent)."""
    counts = tcp_by_division_counts(long, parties)
    return counts.withColumns({p: pct(p, "total") for p in _party_columns(counts, ["DivisionNm"])})


# --- H6-H7: TCP by vote type ----------------------------------------------------------


def prepoll_ordinary_tcp(long: DataFrame) -> DataFrame:
    """Pre-poll ordinary TCP votes per (DivisionNm, PartyAb).

    The wide matrix this mirrors has a cell for every pre-poll place of the
    seat; a party missing from one of them (no row, or a NULL count) has an
    unknown sum and is dropped, so a sum is kept only when the party has a
    non-null count at every pre-poll place of its seat.
    """
    return _complete_party_sums(long, long.where(prepoll_place_sql()), "PrepollOrdinary")


def tcp_by_type(long: DataFrame, tcp_type: DataFrame) -> DataFrame:
    """TCP-by-vote-type feed with ``PrepollOrdinary`` placed after ``OrdinaryVotes``."""
    prepoll = prepoll_ordinary_tcp(long)
    cols = tcp_type.columns
    at = cols.index("OrdinaryVotes") + 1
    order = cols[:at] + ["PrepollOrdinary"] + cols[at:]
    return tcp_type.join(prepoll, ["DivisionNm", "PartyAb"], "left").select(*order)


def tcp_everything(by_type: DataFrame, enrolment: DataFrame) -> DataFrame:
    """TCP votes with division totals, three kinds of percent, margin and enrolment."""
    df = by_type.select("*", *[strict_sum_over(c, ["DivisionNm"]).alias(f"total_{c}") for c in TCP_TYPES])
    margin = "(TotalVotes - (total_TotalVotes - TotalVotes))"
    df = df.selectExpr(
        "*",
        *[f"{pct_sql(c, 'total_' + c)} AS tpp_percent_{c}" for c in TCP_TYPES],
        *[f"{pct_sql(c, 'TotalVotes')} AS party_percent_{c}" for c in TCP_TYPES],
        *[f"{pct_sql(c, 'total_TotalVotes')} AS div_percent_{c}" for c in TCP_TYPES],
        f"{margin} AS margin_votes",
        f"{pct_sql(margin, 'total_TotalVotes')} AS margin_percent",
    )
    enrol = enrolment.selectExpr("DivisionID", "Enrolment", "ceil(Enrolment / 2) AS fifty_percent_enrolment")
    order = df.columns + ["Enrolment", "fifty_percent_enrolment"]
    return left_join_na(df, enrol, ["DivisionID"]).select(*order)


# --- H8 -----------------------------------------------------------------------------


def _tcp_totals(long: DataFrame) -> DataFrame:
    """TCP votes per seat (every place, NULL counts skipped)."""
    return long.groupBy("DivisionNm").agg(F.expr("CAST(coalesce(sum(votes), 0) AS BIGINT) AS total"))


def _tcp_party_votes(long: DataFrame) -> DataFrame:
    """TCP votes per seat and party present in the seat (NULL counts skipped)."""
    return long.groupBy("DivisionNm", "PartyAb").agg(F.expr("CAST(coalesce(sum(votes), 0) AS BIGINT) AS votes"))


def lagging_incumbents(long: DataFrame, fp_type: DataFrame, enrolment: DataFrame) -> DataFrame:
    """Seats whose sitting party is behind (TCP share strictly under 50).

    A sitting party that is a TCP party somewhere but not in its own seat's
    final two has share 0 there (the wide division table gives it a 0 cell);
    one that is a TCP party nowhere has no share at all.
    """
    # One aggregate per (seat, party), folded into a row per seat: its total,
    # its few parties' votes, and the one that can be over half.
    seats = (
        _tcp_party_votes(long)
        .groupBy("DivisionNm")
        .agg(
            F.expr("sum(votes) AS total"),
            F.expr("map_from_entries(collect_list(struct(PartyAb, votes))) AS votes"),
            F.expr("max_by(PartyAb, votes) AS first_party"),
            F.expr("max(votes) AS first_votes"),
        )
        .withColumn("lead_party", F.expr(f"CASE WHEN {pct_sql('first_votes', 'total')} > 50 THEN first_party END"))
    )
    tcp_parties = long.select("PartyAb").distinct()
    sitting = (
        fp_type.where("HistoricElected = 'Y'").select("DivisionNm", "PartyAb").join(tcp_parties, "PartyAb", "left_semi")
    )
    share = pct_sql("coalesce(try_element_at(votes, PartyAb), 0)", "total")
    held = sitting.join(seats, "DivisionNm").selectExpr("DivisionNm", "PartyAb", "total", "lead_party", f"{share} AS vote_percent")
    names = fp_type.select("DivisionNm", "PartyAb", "Surname", "GivenNm")
    enrolled = enrolment.select("DivisionNm", "Enrolment", "StateAb")
    out = (
        held.where("vote_percent < 50")
        .join(names, ["DivisionNm", "PartyAb"], "left")
        .join(enrolled, "DivisionNm", "left")
    )
    return out.selectExpr(
        "StateAb",
        "DivisionNm",
        "PartyAb AS held_party",
        "vote_percent AS held_tpp",
        "Surname AS held_surname",
        "GivenNm AS held_givenname",
        "lead_party",
        "total AS number_counted",
        f"{pct_sql('total', 'Enrolment')} AS percent_counted",
    ).orderBy(asc_last("percent_counted"))


# --- H9-H10 ---------------------------------------------------------------------------


def party_share_by_division(fp_type: DataFrame) -> DataFrame:
    """Each formal candidate row's share of its division's formal vote."""
    return (
        fp_type.where(f"PartyNm != {_INFORMAL}")
        .select("*", strict_sum_over("TotalVotes", ["DivisionNm"]).alias("div_total"))
        .selectExpr(
            "StateAb", "DivisionNm", "HistoricElected", "PartyAb", "TotalVotes",
            f"{pct_sql('TotalVotes', 'div_total')} AS prop_vote",
        )
    )


_TYPE_NAMES = {
    "OrdinaryVotes": "ordinary",
    "AbsentVotes": "absent",
    "ProvisionalVotes": "provisional",
    "PrePollVotes": "prepoll_dec",
    "PostalVotes": "postal",
    "TotalVotes": "total",
}


def vote_types_plain(fp_type: DataFrame) -> DataFrame:
    """Votes per vote type per (StateAb, DivisionNm)."""
    return fp_type.groupBy("StateAb", "DivisionNm").agg(*[strict_sum(c).alias(n) for c, n in _TYPE_NAMES.items()])


def vote_types_by_division(fp_type: DataFrame, fp_pp: DataFrame) -> DataFrame:
    """Votes per vote type per division, plus pre-poll ordinary votes (NULL if no PPVC)."""
    prepoll = fp_pp.where(prepoll_place_sql()).groupBy("DivisionNm").agg(
        strict_sum("OrdinaryVotes").alias("prepoll_ordinary")
    )
    return vote_types_plain(fp_type).join(prepoll, "DivisionNm", "left").select(
        "StateAb", "DivisionNm", "ordinary", "prepoll_ordinary", "absent", "provisional", "prepoll_dec", "postal", "total"
    )


# --- H11-H14 --------------------------------------------------------------------------

_CAND_KEYS = ["DivisionNm", "PartyAb", "CandidateID", "Surname", "GivenNm", "Elected", "HistoricElected"]
DIVISION_COLUMNS = ["ordinary", "prepoll_ordinary", "absent", "provisional", "prepoll_dec", "postal", "total"]


def division_votes(pp_all: DataFrame, division: str | None = None, ordered: bool = True) -> DataFrame:
    """Votes per candidate by vote type; informal row last, then by total descending.

    ``ordered=False`` leaves the sort out, for a report that sorts its own result.
    """

    def place(col: str) -> str:
        return f"PollingPlace = {lit_sql(DUMMY_PLACES[col])}"

    out = (
        _by_division(pp_all, division)
        .groupBy(*_CAND_KEYS)
        .agg(
            strict_sum("OrdinaryVotes", "DeclarationVote = 'N'").alias("ordinary"),
            strict_sum("OrdinaryVotes", "PrepollOrdinary = 'Y'").alias("prepoll_ordinary"),
            strict_sum("OrdinaryVotes", place("AbsentVotes")).alias("absent"),
            strict_sum("OrdinaryVotes", place("ProvisionalVotes")).alias("provisional"),
            strict_sum("OrdinaryVotes", place("PrePollVotes")).alias("prepoll_dec"),
            strict_sum("OrdinaryVotes", place("PostalVotes")).alias("postal"),
            strict_sum("OrdinaryVotes").alias("total"),
        )
    )
    return out.orderBy("DivisionNm", F.expr(f"Surname = {_INFORMAL}"), desc_last("total")) if ordered else out


def division_percent(votes: DataFrame) -> DataFrame:
    """Division table as percents: formal rows of their column's formal total,
    the informal row of the division's grand total; rounded, NULL as 0."""
    w = "OVER (PARTITION BY DivisionNm)"
    informal = f"Surname = {_INFORMAL}"
    grand = f"coalesce(sum(total) {w}, 0)"
    exprs = {
        c: F.expr(
            f"CASE WHEN {informal} THEN {pct_sql(q(c), grand)} "
            f"ELSE {pct_sql(q(c), f'coalesce(sum(CASE WHEN NOT ({informal}) THEN {q(c)} END) {w}, 0)')} END"
        )
        for c in DIVISION_COLUMNS
    }
    out = _numeric_fill0(round_doubles(votes.withColumns(exprs).drop("CandidateID")))
    return out.orderBy("DivisionNm", F.expr(informal), desc_last("total"))


def division_tcp_votes(tcp_all: DataFrame, division: str | None = None) -> DataFrame:
    return _by_division(tcp_all, division).select(
        "DivisionNm", "PartyAb", "Surname", "GivenNm", "Elected", "HistoricElected", *TCP_TYPES
    )


def division_tcp_percent(tcp_all: DataFrame, division: str | None = None) -> DataFrame:
    out = _by_division(tcp_all, division).selectExpr(
        "DivisionNm",
        "PartyAb",
        "Surname",
        "GivenNm",
        "Elected",
        "HistoricElected",
        *[f"tpp_percent_{c} AS {c}" for c in TCP_TYPES],
    )
    return _numeric_fill0(round_doubles(out))


# --- H15 ------------------------------------------------------------------------------


def public_funding(fp_pp: DataFrame) -> DataFrame:
    """Funding per party from divisions where it polled strictly over 4 percent."""
    shares = formal_votes_by_party(fp_pp).select("*", strict_sum_over("votes", ["DivisionNm"]).alias("total"))
    funded = (
        shares.where(f"{pct_sql('votes', 'total')} > {FUNDING_THRESHOLD_PERCENT!r}D")
        .groupBy("PartyAb")
        .agg(strict_sum("votes").alias("total_votes"))
    )
    coalition = ", ".join(lit_sql(p) for p in COALITION_PARTIES)
    return funded.selectExpr(
        "PartyAb",
        "total_votes",
        f"total_votes * {FUNDING_CENTS_PER_VOTE!r}D / 100 AS funding",
        f"CASE WHEN PartyAb IN ({coalition}) THEN {lit_sql(COALITION_LABEL)} ELSE PartyAb END AS `group`",
    ).orderBy(desc_last("funding"))


# --- H16 ------------------------------------------------------------------------------


def seat_summary(pp_all: DataFrame, enrolment: DataFrame, tcp_all: DataFrame, tcp_type: DataFrame) -> DataFrame:
    """Per seat: votes, turnout, sitting/elected party, TCP leader and lagger, margin, swing."""
    # One pass over the candidate/place table: seat total, and the party of the
    # sitting and of the elected candidate (a seat's rows agree on it, so the
    # smallest is the first).
    total = pp_all.groupBy("StateAb", "DivisionID", "DivisionNm").agg(
        strict_sum("OrdinaryVotes").alias("total_votes"),
        F.expr("min(CASE WHEN HistoricElected = 'Y' THEN PartyAb END) AS HistoricElected"),
        F.expr("min(CASE WHEN Elected = 'Y' THEN PartyAb END) AS Elected"),
    )
    total = left_join_na(total, enrolment.select("DivisionID", "Enrolment"), ["DivisionID"])
    leading = tcp_all.where("div_percent_TotalVotes >= 50").selectExpr(
        "DivisionID", "PartyAb AS leading_party", "div_percent_TotalVotes AS leading_tcp", "margin_votes AS margin"
    )
    lagging = tcp_all.where("div_percent_TotalVotes < 50").selectExpr(
        "DivisionID", "PartyAb AS lagging_party", "div_percent_TotalVotes AS lagging_tcp"
    )
    swing = tcp_type.selectExpr("DivisionID", "PartyAb AS leading_party", "Swing")
    seats = left_join_na(total, left_join_na(leading, lagging, ["DivisionID"]), ["DivisionID"])
    out = left_join_na(seats, swing, ["DivisionID", "leading_party"]).selectExpr(
        "StateAb",
        "DivisionID",
        "DivisionNm",
        "total_votes",
        "Enrolment",
        f"{pct_sql('total_votes', 'Enrolment')} AS turnout",
        "HistoricElected",
        "Elected",
        "leading_party",
        "leading_tcp",
        "lagging_party",
        "lagging_tcp",
        "margin",
        "Swing",
    )
    return round_doubles(out)


# --- H17 ------------------------------------------------------------------------------

BLOCS = ["ALP", COALITION_LABEL, "GRN"]
STATS = ["mean", "sd", "n"]


def tcp_comparison(tcp_all: DataFrame) -> DataFrame:
    """Mean, sample sd and row count of the seven TCP percents for ALP, Coalition, Greens."""
    coalition = ", ".join(lit_sql(p) for p in COALITION_PARTIES)
    bloc = (
        f"CASE WHEN PartyAb = 'ALP' THEN 'ALP' WHEN PartyAb IN ({coalition}) THEN {lit_sql(COALITION_LABEL)} "
        "WHEN PartyAb = 'GRN' THEN 'GRN' END"
    )
    tpp = [f"tpp_percent_{c}" for c in TCP_TYPES]
    long = (
        tcp_all.selectExpr(f"{bloc} AS bloc", *tpp)
        .where("bloc IS NOT NULL")
        .unpivot(["bloc"], tpp, "key", "v")
        .selectExpr("bloc", "v", "regexp_replace(key, '^tpp_percent_', '') AS Type")
    )
    aggs = []
    for b in BLOCS:
        mine = f"bloc = {lit_sql(b)}"
        aggs += [
            f"avg(CASE WHEN {mine} THEN v END) AS {b}_mean",
            f"stddev_samp(CASE WHEN {mine} THEN v END) AS {b}_sd",
            f"CAST(count(CASE WHEN {mine} THEN 1 END) AS DOUBLE) AS {b}_n",
        ]
    wide = long.groupBy("Type").agg(*[F.expr(a) for a in aggs])
    rows = ", ".join(
        "named_struct('Stat', " + lit_sql(s) + ", " + ", ".join(f"'{b}', {b}_{s}" for b in BLOCS) + ")" for s in STATS
    )
    out = wide.selectExpr("Type", f"inline(array({rows}))")
    return round_doubles(out.select("Type", "Stat", *BLOCS))


# --- H18 ------------------------------------------------------------------------------


class HouseTables:
    """The derived House tables (the six the analysis refreshes, plus the long
    TCP matrix they share), built on first use in dependency order.

    ``cache`` is passed to :func:`psephos.plans.sizing.materialize` for the
    tables in ``shared`` (by default those that several reports read: the
    candidate/place table, the long TCP matrix and the full TCP table); the
    default keeps them lazy, which is right when one report runs per plan.
    """

    NAMES = ("pp_all", "formal_votes_div", "tcp_long", "tcp_pp", "hor_tcp_type", "div_total_type", "tcp_type")

    SHARED = ("pp_all", "tcp_long", "tcp_type")

    def __init__(self, inputs, cache: str = "none", kept: list[DataFrame] | None = None, shared: tuple[str, ...] = SHARED):
        self.inputs = inputs
        self.cache = cache
        self.shared = shared
        self.kept = [] if kept is None else kept
        self._built: dict[str, DataFrame] = {}

    def _make(self, name: str) -> DataFrame:
        i = self.inputs
        if name == "pp_all":
            return polling_place_results_by_candidate(i.fp_pp, i.fp_type)
        if name == "formal_votes_div":
            return formal_votes_by_party(i.fp_pp)
        if name == "tcp_long":
            return tcp_long(i.tcp_pp, i.tcp_type)
        if name == "tcp_pp":
            return tcp_by_place(self["tcp_long"], getattr(i, "parties", None))
        if name == "hor_tcp_type":
            return tcp_by_type(self["tcp_long"], i.tcp_type)
        if name == "div_total_type":
            return vote_types_by_division(i.fp_type, i.fp_pp)
        if name == "tcp_type":
            return tcp_everything(self["hor_tcp_type"], i.enrolment)
        raise KeyError(name)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            how = self.cache if name in self.shared else "none"
            self._built[name] = materialize(self._make(name), how, self.kept)
        return self._built[name]

    def all(self) -> dict[str, DataFrame]:
        return {n: self[n] for n in self.NAMES}


def build_house(
    inputs, cache: str = "none", kept: list[DataFrame] | None = None, shared: tuple[str, ...] = HouseTables.SHARED
) -> HouseTables:
    """Refresh of the derived House tables (built lazily on access); ``kept``
    takes what is materialized, for ``release``."""
    return HouseTables(inputs, cache, kept, shared)


# --- dormant reports (kept commented out in the original analysis) ---------------------


def _complete_party_sums(long: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """Per (DivisionNm, PartyAb) sum over ``places`` of the seat, kept only when
    the party has a known count at every one of them (else the sum is unknown)."""
    n_places = (
        places.select("DivisionNm", "PollingPlace").distinct().groupBy("DivisionNm").agg(F.expr("count(1) AS n_places"))
    )
    per_party = places.groupBy("DivisionNm", "PartyAb").agg(
        F.expr(f"sum(votes) AS {q(name)}"), F.expr("count(votes) AS n_known")
    )
    return per_party.join(n_places, "DivisionNm").where("n_known = n_places").select("DivisionNm", "PartyAb", name)


def tcp_division_party(long: DataFrame) -> DataFrame:
    """TCP votes per division and party over all places; unknown sums dropped."""
    return _complete_party_sums(long, long, "votes")


def division_votes_tcp(votes: DataFrame, long: DataFrame, by_type: DataFrame) -> DataFrame:
    """Division table joined to the TCP share/votes of the candidate's party and
    to the candidate's own TCP votes by type. A zero share counts as unknown."""
    share = pct_sql("votes", "total")
    tcp = (
        _tcp_party_votes(long)
        .join(_tcp_totals(long), "DivisionNm")
        .selectExpr("DivisionNm", "PartyAb", f"CASE WHEN {share} != 0 THEN {share} END / 100 * total AS tcp_votes")
    )
    own_cols = TCP_TYPES + ["Swing"]
    own = by_type.selectExpr("CandidateID", *[f"{c} AS tcp_{c}" for c in own_cols])
    return left_join_na(votes.join(tcp, ["DivisionNm", "PartyAb"], "left"), own, ["CandidateID"]).select(
        *votes.columns, "tcp_votes", *[f"tcp_{c}" for c in own_cols]
    )


_DIFF_NAMES = {
    "OrdinaryVotes": "OrdinaryVotes",
    "PrepollOrdinary": "PrepollOrdinary",
    "AbsentVotes": "Absent",
    "ProvisionalVotes": "Provisional",
    "PrePollVotes": "PrePollVotes",
    "PostalVotes": "PostalVotes",
    "TotalVotes": "TotalVotes",
}


def tcp_lead_lag_diff(tcp_all: DataFrame) -> DataFrame:
    """Leading minus lagging TCP votes per vote type, per seat."""
    cols = TCP_TYPES + [f"tpp_percent_{c}" for c in TCP_TYPES]
    lead = tcp_all.where("div_percent_TotalVotes >= 50").selectExpr(
        "DivisionID",
        "DivisionNm",
        "PartyAb AS leading_PartyAb",
        *[f"{c} AS leading_{c}" for c in cols],
        "total_TotalVotes AS TotalVotes",
        "Enrolment",
    )
    lag = tcp_all.where("div_percent_TotalVotes < 50").selectExpr(
        "DivisionID", "PartyAb AS lagging_PartyAb", *[f"{c} AS lagging_{c}" for c in cols]
    )
    return left_join_na(lead, lag, ["DivisionID"]).selectExpr(
        "DivisionID",
        "DivisionNm",
        "leading_PartyAb",
        *[f"leading_{c}" for c in cols],
        "lagging_PartyAb",
        *[f"lagging_{c}" for c in cols],
        "TotalVotes",
        "Enrolment",
        *[f"leading_{c} - lagging_{c} AS diff_{n}" for c, n in _DIFF_NAMES.items()],
    )
