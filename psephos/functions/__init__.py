"""Column helpers carrying the missing-value and rounding rules of the reports."""

from psephos.functions.columns import (
    asc_last,
    case_sql,
    desc_last,
    left_join_na,
    lit_sql,
    pct,
    pct_sql,
    prepoll_place_sql,
    q,
    ratio,
    ratio_sql,
    round_doubles,
    strict_sum,
    strict_sum_over,
    sum0,
)

__all__ = [
    "asc_last",
    "case_sql",
    "desc_last",
    "left_join_na",
    "lit_sql",
    "pct",
    "pct_sql",
    "prepoll_place_sql",
    "q",
    "ratio",
    "ratio_sql",
    "round_doubles",
    "strict_sum",
    "strict_sum_over",
    "sum0",
]
