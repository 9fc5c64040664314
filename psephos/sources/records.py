"""Whole CSV records from the lines of splittable files.

A quoted field may hold line breaks, so a record may span lines, and a split
may begin inside a quoted field. What a line does depends on the state it is
entered in, outside quotes (0) or inside (1): it is a function from the state
before it to the state after it. Functions compose, so the state before each
line follows from a running composition within its split, for either state in
which the split may be entered, and a running composition of the splits' own
functions within the file settles which of the two it was. All in built-in
functions and windows: within splits, whose size Spark bounds, and over a
file's splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_QUOTED = r'(?:[^"]++|"")*+'
_FIELDS = rf'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+'
#: A line entered outside quotes that ends inside: its last field is not closed.
_OPENS = rf'\A{_FIELDS}"{_QUOTED}\z'
#: A line entered inside quotes that ends inside: no quote closes it, or a later field is not closed.
_STAYS = rf'\A{_QUOTED}(?:\z|"[^,]*+,{_FIELDS}"{_QUOTED}\z)'


def opens_quote(line: str = "value") -> Column:
    """Whether a record that begins with the line goes on in the next."""
    return F.contains(F.col(line), F.lit('"')) & F.col(line).rlike(_OPENS)


def _stays_quoted(line: str = "value") -> Column:
    return ~F.contains(F.col(line), F.lit('"')) | F.col(line).rlike(_STAYS)


def _states_before(rows: DataFrame, order: WindowSpec) -> DataFrame:
    """``rows`` (out0, out1: the state after, by the state before) with in0 and in1:
    the state before each row, by the state in which the whole run is entered."""
    swap = (F.col("out0") & ~F.col("out1")).cast("int")
    constant = F.col("out0") == F.col("out1")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_swaps", F.sum(swap).over(so_far))
    settled = F.when(constant, F.struct(F.col("out0").cast("int").alias("to"), F.col("_swaps").alias("swaps")))
    rows = rows.withColumns({"_last": F.last(settled, ignorenulls=True).over(earlier), "_before": F.col("_swaps") - swap})
    known = (F.col("_last.to") + F.col("_before") - F.col("_last.swaps")) % 2 == 1
    odd = F.col("_before") % 2 == 1
    return rows.withColumns({"in0": F.coalesce(known, odd), "in1": F.coalesce(known, ~odd)}).drop("_swaps", "_last", "_before")


def _after(state: Column) -> Column:
    return F.when(state, F.col("out1")).otherwise(F.col("out0"))


def whole_records(text: DataFrame, skip: int) -> DataFrame:
    """``value``: the records of ``text`` (a text scan with ``_metadata``), without each file's first ``skip`` lines.

    Lines of one record are joined by ``\\n``; blank lines between records are
    dropped, those inside quotes kept. A quote that never closes is an error
    that names the file.
    """
    in_split = Window.partitionBy("file", "split").orderBy("at")
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value"
    ).withColumn("line", F.row_number().over(in_split))
    lines = lines.where((F.col("split") > 0) | (F.col("line") > skip)).withColumns({"out0": opens_quote(), "out1": _stays_quoted()})
    lines = _states_before(lines, in_split)
    so_far = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = lambda state: F.sum((~F.col(state)).cast("long")).over(so_far)
    lines = lines.withColumns({"starts0": starts("in0"), "starts1": starts("in1")})

    splits = lines.groupBy("file", "split").agg(
        F.max_by(_after(F.col("in0")), "at").alias("out0"),
        F.max_by(_after(F.col("in1")), "at").alias("out1"),
        F.max("starts0").alias("n0"),
        F.max("starts1").alias("n1"),
    )
    in_file = Window.partitionBy("file").orderBy("split")
    splits = _states_before(splits, in_file).withColumnRenamed("in0", "entered")
    own = F.when(F.col("entered"), F.col("n1")).otherwise(F.col("n0"))
    before = F.coalesce(F.sum(own).over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = splits.groupBy("file").agg(F.max_by(_after(F.col("entered")), "split").alias("open")).where("open").select("file")
    if unclosed := [r[0] for r in ends.limit(10).collect()]:
        raise ValueError(f"feed files with a quote that never closes: {unclosed}")

    lines = lines.join(splits.select("file", "split", "entered", before.alias("before")), ["file", "split"])
    by_entry = lambda c: F.when(F.col("entered"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    lines = lines.withColumn("inside", by_entry("in"))
    lines = lines.select("file", "split", "at", "value", "inside", _after(F.col("inside")).alias("goes_on"), (F.col("before") + by_entry("starts")).alias("record"))
    alone = lines.where(~F.col("inside") & ~F.col("goes_on") & (F.length("value") > 0)).select("value")
    parts = F.sort_array(F.collect_list(F.struct("split", "at", "value")))
    spread = lines.where(F.col("inside") | F.col("goes_on")).groupBy("file", "record").agg(F.array_join(parts["value"], "\n").alias("value"))
    return alone.unionByName(spread.select("value"))
