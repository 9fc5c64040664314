"""Pre-poll (early voting) daily series of two elections.

The wide day files are unpivoted *first* and aggregated after, so one plan
serves any number of days. Running totals use an explicit ROWS frame (the
default RANGE frame would merge tied days).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.constants import DAY_FORMAT, DIVISION_RENAMES_2013, NATIONAL_ENROLMENT
from psephos.functions import case_sql, lit_sql, pct_sql, ratio, ratio_sql, sum0

ID_RENAMES_2016 = {"m_state_ab": "State", "m_div_nm": "Division"}


def _days_by_position(df: DataFrame, n_ids: int = 3) -> DataFrame:
    """Name every column after the id columns ``Day01``, ``Day02``, ... by position."""
    ids = [f"`{c}`" for c in df.columns[:n_ids]]
    days = [f"CAST(`{c}` AS BIGINT) AS {DAY_FORMAT % (i + 1)}" for i, c in enumerate(df.columns[n_ids:])]
    return df.selectExpr(*ids, *days)


def combine_elections(pp2013: DataFrame, pp2016: DataFrame) -> DataFrame:
    """Stack the two wide files by name; days a file lacks are NULL."""
    a = _days_by_position(pp2013).selectExpr("*", "'2013' AS Election")
    b = _days_by_position(pp2016.withColumnsRenamed(ID_RENAMES_2016)).selectExpr("*", "'2016' AS Election")
    return a.unionByName(b, allowMissingColumns=True)


def day_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("Day")]


def long_days(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Wide day matrix to ``(ids..., Day, Votes)``; NULL cells are kept."""
    return wide.unpivot(ids, day_columns(wide), "Day", "Votes")


# Running total in day order: an explicit ROWS frame, one row per day.
_RUNNING = "OVER (PARTITION BY {} ORDER BY Day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _running_total(partition: str, blank: str = "Election = '2016' AND Votes = 0") -> str:
    """SQL text: the running total, NULL on days matching ``blank``."""
    return f"CASE WHEN NOT ({blank}) THEN sum(Votes) {_RUNNING.format(partition)} END AS Cum_Total"


def prepoll_daily(combined: DataFrame) -> DataFrame:
    """National votes per election and day (missing counts as 0)."""
    return (
        long_days(combined.select("Election", *day_columns(combined)), ["Election"])
        .groupBy("Election", "Day")
        .agg(sum0("Votes").alias("Votes"))
    )


def prepoll_cumulative(daily: DataFrame) -> DataFrame:
    """Running national totals, as counts and as shares of national enrolment.

    The running total is taken first; then a zero day becomes NULL, and for
    2016 the running columns of such days are blanked too (days not yet run).
    ``Prop_Votes`` is a fraction, ``Cum_Prop`` a percent.
    """
    enrolled = case_sql("Election", NATIONAL_ENROLMENT)
    blank = "Election = '2016' AND day_votes = 0"
    return daily.selectExpr(
        "Election", "Day", "Votes AS day_votes", f"sum(Votes) {_RUNNING.format('Election')} AS cum"
    ).selectExpr(
        "Election",
        "Day",
        "nullif(day_votes, 0) AS Votes",
        f"CASE WHEN NOT ({blank}) THEN cum END AS Cum_Total",
        f"{ratio_sql('nullif(day_votes, 0)', enrolled)} AS Prop_Votes",
        f"CASE WHEN NOT ({blank}) THEN {pct_sql('cum', enrolled)} END AS Cum_Prop",
    )


def prepoll_state_cumulative(combined: DataFrame) -> DataFrame:
    """Daily and running votes per election and state; 2016 zero days have no running total."""
    state = (
        long_days(combined.select("Election", "State", *day_columns(combined)), ["Election", "State"])
        .groupBy("Election", "State", "Day")
        .agg(sum0("Votes").alias("Votes"))
    )
    return state.selectExpr("Election", "State", "Day", "Votes", _running_total("Election, State"))


def _number(text_col: str, separator: str) -> F.Column:
    return F.expr(f"try_cast(regexp_replace(`{text_col}`, {lit_sql(separator)}, '') AS BIGINT)")


def enrolment_2016_by_state(enrolment_2016: DataFrame) -> DataFrame:
    """Certified electors summed per state (thousands separators removed)."""
    return enrolment_2016.groupBy("State").agg(
        sum0(_number("Electors_on_2016_Certified_list", ",")).alias("enrolled_total")
    )


def enrolment_2013_by_state(enrolment_2013: DataFrame) -> DataFrame:
    """Electors enrolled per state (space separators removed)."""
    return enrolment_2013.select("State", _number("Electors_enrolled", " ").alias("enrolled_total"))


def enrolment_both(e2013: DataFrame, e2016: DataFrame) -> DataFrame:
    return e2013.selectExpr("*", "'2013' AS Election").unionByName(e2016.selectExpr("*", "'2016' AS Election"))


def prepoll_state_rate(state_cum: DataFrame, enrolment: DataFrame) -> DataFrame:
    """Running state votes as a fraction of state enrolment."""
    return state_cum.join(enrolment, ["Election", "State"], "left").selectExpr(
        "Election",
        "State",
        "Day",
        "Votes",
        "Cum_Total",
        "enrolled_total",
        f"CASE WHEN NOT (Election = '2016' AND Votes = 0) THEN {ratio_sql('Cum_Total', 'enrolled_total')} END AS State_Prop",
    )


def prepoll_division(combined: DataFrame) -> DataFrame:
    """Daily and running votes per election and division; two 2013 divisions take their new names."""
    div = (
        long_days(combined.select("Election", "Division", *day_columns(combined)), ["Election", "Division"])
        .groupBy("Election", "Division", "Day")
        .agg(sum0("Votes").alias("Votes"))
    )
    renamed = case_sql("Division", DIVISION_RENAMES_2013, default="Division")
    return div.selectExpr("*", _running_total("Election, Division")).selectExpr(
        "Election", f"CASE WHEN Election = '2013' THEN {renamed} ELSE Division END AS Division", "Day", "Votes", "Cum_Total"
    )


def prepoll_state_totals(combined: DataFrame, enrolment: DataFrame) -> DataFrame:
    """All-day votes per election and state against that year's state enrolment."""
    totals = (
        long_days(combined.select("Election", "State", *day_columns(combined)), ["Election", "State"])
        .groupBy("Election", "State")
        .agg(sum0("Votes").alias("State_Totals"))
    )
    return totals.join(enrolment, ["Election", "State"], "left").select(
        "Election", "State", "State_Totals", "enrolled_total", ratio("State_Totals", "enrolled_total").alias("State_Vote_Prop")
    )
