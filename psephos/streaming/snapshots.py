"""Following a live count with Structured Streaming.

During a count the result feeds are re-published as whole snapshots; the
analysis re-reads them and rebuilds its tables. Two Spark forms of that:

* ``watch_snapshots``: a file stream of snapshot notices (one line per
  published snapshot folder). Each micro-batch runs the batch reports over the
  new snapshot(s) and writes them under ``out_dir/<report>/snapshot=<path>``.
  The stream's checkpoint makes the refresh exactly-once per notice.
* ``running_formal_votes``: first-preference rows arriving as polling places
  report, kept as a running (division, party) total in the state store.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from psephos.operators import house as H
from psephos.plans.sizing import checkpoint_dir, release
from psephos.sources.feeds import load_house

Report = Callable[[object, H.HouseTables], DataFrame]

DEFAULT_REPORTS: dict[str, Report] = {
    "seat_summary": lambda i, t: H.seat_summary(t["pp_all"], i.enrolment, t["tcp_type"], i.tcp_type),
    "lagging_incumbents": lambda i, t: H.lagging_incumbents(t["tcp_long"], i.fp_type, i.enrolment),
    "public_funding": lambda i, t: H.public_funding(i.fp_pp),
}


def _stream_checkpoint(spark: SparkSession, name: str, given: str | None) -> str:
    if given:
        return given
    base = checkpoint_dir(spark)
    if not base:
        raise ValueError("no checkpointLocation given and spark.checkpoint.dir is not set")
    return f"{base.rstrip('/')}/streams/{name}"


def snapshot_name(snapshot_dir: str) -> str:
    """A name for the folder, from its whole path: two folders never share one."""
    return quote(snapshot_dir.rstrip("/"), safe="").replace("%", "~")


def refresh_snapshot(spark: SparkSession, snapshot_dir: str, out_dir: str, reports: dict[str, Report]) -> None:
    """Run ``reports`` over one snapshot folder and write each under its name."""
    kept: list[DataFrame] = []
    inputs = load_house(spark, snapshot_dir)
    tables = H.build_house(inputs, "auto", kept)
    name = snapshot_name(snapshot_dir)
    try:
        for report, fn in reports.items():
            fn(inputs, tables).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{report}/snapshot={name}")
    finally:
        release(kept)


def watch_snapshots(
    spark: SparkSession,
    notices_dir: str,
    out_dir: str,
    reports: dict[str, Report] | None = None,
    checkpoint_location: str | None = None,
    available_now: bool = False,
    notices_per_trigger: int = 100,
) -> StreamingQuery:
    """Rebuild ``reports`` for every snapshot folder named in a new notice file.

    A trigger takes at most ``notices_per_trigger`` notice files; the rest wait.
    """
    reports = reports or DEFAULT_REPORTS

    def each_batch(batch: DataFrame, epoch_id: int) -> None:
        # Notices are one short line per published snapshot: a bounded list.
        for row in batch.select(F.trim("value").alias("dir")).where(F.length("dir") > 0).distinct().collect():
            refresh_snapshot(spark, row["dir"], out_dir, reports)

    writer = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", notices_per_trigger)
        .load(notices_dir)
        .writeStream.foreachBatch(each_batch)
        .option("checkpointLocation", _stream_checkpoint(spark, "snapshots", checkpoint_location))
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def running_formal_votes(fp_pp_stream: DataFrame) -> DataFrame:
    """Formal first-preference votes per (division, party) over a stream of polling-place rows."""
    return H.formal_votes_by_party(fp_pp_stream)


def start_running_formal_votes(
    fp_pp_stream: DataFrame, out_dir: str, checkpoint_location: str | None = None, available_now: bool = True
) -> StreamingQuery:
    """Write the running totals as parquet under ``out_dir/batch=<n>``, a whole table for each trigger.

    The state holds a row per division and party; each trigger writes them all
    (complete mode), from the executors. The latest batch is the current count.
    """
    spark = fp_pp_stream.sparkSession

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch={epoch_id}")

    w = (
        running_formal_votes(fp_pp_stream)
        .writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", _stream_checkpoint(spark, "running-formal-votes", checkpoint_location))
    )
    return (w.trigger(availableNow=True) if available_now else w).start()
