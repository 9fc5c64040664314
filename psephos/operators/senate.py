"""Senate reports: turnout by state and quotas.

State is a key with a handful of values, so state totals are an aggregate
joined back (AQE broadcasts the few-row side at runtime) rather than a window,
which would funnel each state's rows through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from psephos.constants import TERRITORIES, VOTE_COLUMNS
from psephos.functions import asc_last, desc_last, lit_sql, pct, q, ratio, strict_sum

CANDIDATE_KEYS = [
    "StateAb",
    "Ticket",
    "BallotPosition",
    "PartyAb",
    "PartyName",
    "CandidateDetails",
    "Elected",
    "HistoricElected",
]


def quota(state_total: str, vacancies: int, state: str = "StateAb") -> str:
    """SQL text of the Droop quota, not floored: total / (vacancies + 1) + 1;
    territories elect 2 (divisor 3) whatever ``vacancies`` says."""
    territories = ", ".join(lit_sql(t) for t in TERRITORIES)
    t = q(state_total)
    return f"CASE WHEN {q(state)} IN ({territories}) THEN {t} / 3 + 1 ELSE {t} / {vacancies + 1} + 1 END"


def senate_turnout(fp_div: DataFrame, enrolment: DataFrame) -> DataFrame:
    """Senate votes per state as a percent of the state's summed division enrolment."""
    votes = fp_div.groupBy("StateAb").agg(strict_sum("TotalVotes").alias("votes"))
    enrolled = enrolment.groupBy("StateAb").agg(strict_sum("Enrolment").alias("enrolment"))
    return votes.join(enrolled, "StateAb", "left").select(
        "StateAb", "votes", pct("votes", "enrolment").alias("percent_enrolment")
    )


def _state_quota(df: DataFrame, vacancies: int, total_name: str) -> DataFrame:
    return (
        df.groupBy("StateAb")
        .agg(strict_sum("TotalVotes").alias(total_name))
        .selectExpr("*", f"{quota(total_name, vacancies)} AS quota")
    )


def senate_quotas(fp_group: DataFrame, vacancies: int = 6) -> DataFrame:
    """Quotas won by each group on first preferences."""
    quotas = _state_quota(fp_group, vacancies, "state_total")
    return (
        fp_group.join(quotas, "StateAb", "left")
        .select("StateAb", "GroupAb", "TotalVotes", ratio("TotalVotes", "quota").alias("num_quotas"))
        .orderBy(asc_last("StateAb"), desc_last("TotalVotes"))
    )


def senate_quotas_candidate(fp_div: DataFrame, vacancies: int) -> DataFrame:
    """Division rows rolled up to candidate, with quotas won."""
    quotas = _state_quota(fp_div, vacancies, "StateTotal")
    cand = fp_div.groupBy(*CANDIDATE_KEYS).agg(*[strict_sum(c).alias(c) for c in VOTE_COLUMNS])
    return cand.join(quotas, "StateAb", "left").select(
        *CANDIDATE_KEYS, *VOTE_COLUMNS, ratio("TotalVotes", "quota").alias("Quotas")
    )


def senate_quotas_two(fp_group: DataFrame, full: int = 12, half: int = 6) -> DataFrame:
    """Double-dissolution and half-Senate quotas side by side."""
    quotas = (
        fp_group.groupBy("StateAb")
        .agg(strict_sum("TotalVotes").alias("state_total"))
        .selectExpr("StateAb", f"{quota('state_total', full)} AS quota_dd", f"{quota('state_total', half)} AS quota_hs")
    )
    return fp_group.join(quotas, "StateAb", "left").select(
        "StateAb",
        "GroupAb",
        "TotalVotes",
        ratio("TotalVotes", "quota_dd").alias("num_quotas_dd"),
        ratio("TotalVotes", "quota_hs").alias("num_quotas_hs"),
    )


def senate_quotas_both(fp_group: DataFrame, state: str | None = None) -> DataFrame:
    """Half-Senate quotas next to full-Senate quotas, largest groups first."""
    hs = senate_quotas(fp_group, 6).withColumnRenamed("num_quotas", "quotas_hs")
    fs = senate_quotas(fp_group, 12).selectExpr("StateAb", "GroupAb", "num_quotas AS quotas_fs")
    out = hs.join(fs, ["StateAb", "GroupAb"], "left")
    if state is not None:
        out = out.where(f"StateAb = {lit_sql(state)}")
    return out.select("StateAb", "GroupAb", "TotalVotes", "quotas_hs", "quotas_fs").orderBy(desc_last("TotalVotes"))
