"""Aggregate and scalar column expressions shared by every report.

The reports were written against data frames where a missing value poisons a
plain ``sum`` but is skipped by ``sum(na.rm=TRUE)``, where ``x/0`` is not an
error, and where ``round`` goes half-to-even. Spark differs on each point, so
the rules live here, once, as built-in SQL expressions that stay inside
whole-stage codegen.

Arguments that are ``str`` are column names; each helper then builds its
expression as one SQL string (one parse on the JVM side, instead of one
round trip per sub-expression, which dominates plan-building time). ``Column``
arguments are accepted too and take the Column-API path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from psephos.constants import PREPOLL_PLACE_PATTERN


def q(name: str) -> str:
    """A column name quoted for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def lit_sql(v) -> str:
    """A Python literal as SQL text."""
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(v)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _over(partition: list[str]) -> str:
    return "OVER (PARTITION BY " + ", ".join(q(p) for p in partition) + ")"


def strict_sum(c: str | Column, where: str | Column | None = None) -> Column:
    """Group sum that is NULL when any summed value is NULL, 0 over no rows.

    ``where`` (SQL text, or a Column) restricts the summed rows
    (``sum(x[cond])``); rows where it is false or NULL do not take part.
    """
    if isinstance(c, str) and (where is None or isinstance(where, str)):
        x = q(c)
        if where is None:
            return F.expr(f"CASE WHEN count(1) = count({x}) THEN coalesce(sum({x}), 0) END")
        return F.expr(
            f"CASE WHEN count(CASE WHEN {where} THEN 1 END) = count(CASE WHEN {where} THEN {x} END) "
            f"THEN coalesce(sum(CASE WHEN {where} THEN {x} END), 0) END"
        )
    x = _c(c)
    if where is None:
        n_rows, n_vals, total = F.count(F.lit(1)), F.count(x), F.sum(x)
    else:
        cond = F.expr(where) if isinstance(where, str) else where
        n_rows = F.count(F.when(cond, F.lit(1)))
        n_vals = F.count(F.when(cond, x))
        total = F.sum(F.when(cond, x))
    return F.when(n_rows == n_vals, F.coalesce(total, F.lit(0)))


def strict_sum_over(c: str, partition: list[str]) -> Column:
    """``strict_sum`` as a window aggregate (share-of-group without a self-join)."""
    x, w = q(c), _over(partition)
    return F.expr(f"CASE WHEN count(1) {w} = count({x}) {w} THEN coalesce(sum({x}) {w}, 0) END")


def sum0(c: str | Column) -> Column:
    """Group sum skipping NULLs; 0 when every value is NULL."""
    if isinstance(c, str):
        return F.expr(f"coalesce(sum({q(c)}), 0)")
    return F.coalesce(F.sum(c), F.lit(0))


def ratio_sql(num: str, den: str) -> str:
    """SQL text of ``num / den`` as a double, NULL for a zero or NULL denominator
    (arguments are SQL text)."""
    return f"try_divide(CAST({num} AS DOUBLE), {den})"


def pct_sql(num: str, den: str) -> str:
    """SQL text of ``num / den * 100`` in that order of operations (arguments are SQL text)."""
    return f"{ratio_sql(num, den)} * 100"


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` as a double; NULL for a zero or NULL denominator."""
    if isinstance(num, str) and isinstance(den, str):
        return F.expr(ratio_sql(q(num), q(den)))
    return F.try_divide(_c(num).cast("double"), _c(den))


def pct(num: str | Column, den: str | Column) -> Column:
    """``num / den * 100`` in that order of operations; NULL for ``den = 0``."""
    if isinstance(num, str) and isinstance(den, str):
        return F.expr(pct_sql(q(num), q(den)))
    return ratio(num, den) * F.lit(100)


def round_doubles(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every floating column of ``df`` half-to-even; others unchanged."""
    return df.withColumns(
        {
            f.name: F.expr(f"bround({q(f.name)}, {digits})")
            for f in df.schema.fields
            if isinstance(f.dataType, (DoubleType, FloatType))
        }
    )


def case_sql(key: str, mapping: dict, default: str = "NULL") -> str:
    """SQL text of a CASE lookup of ``key`` (SQL text) in a fixed mapping."""
    whens = " ".join(f"WHEN {lit_sql(k)} THEN {lit_sql(v)}" for k, v in mapping.items())
    return f"CASE {key} {whens} ELSE {default} END"


def prepoll_place_sql(place: str = "PollingPlace") -> str:
    return f"{q(place)} RLIKE {lit_sql(PREPOLL_PLACE_PATTERN)}"


def asc_last(c: str | Column) -> Column:
    return _c(c).asc_nulls_last()


def desc_last(c: str | Column) -> Column:
    return _c(c).desc_nulls_last()


def left_join_na(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` where a NULL key meets a NULL key, as the original's joins match NA with NA."""
    theirs = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(theirs, same, "left").drop(*[f"__{k}" for k in keys])
