"""SparkSession construction with the settings the reports are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    # Runtime re-planning: coalesce small shuffle partitions, turn joins with a
    # small runtime side into broadcasts, split skewed join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Remove a query's checkpoint files once nothing references them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """A session with AQE on and the UI off.

    The defaults fill in only what the submit command or an active session
    leaves unset; the arguments are the caller's own choice and always hold.
    """
    b = SparkSession.builder.appName("psephos")
    if master:
        b = b.master(master)
    given = dict(extra or {})
    if shuffle_partitions:
        given["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if SparkSession.getActiveSession() is None:
        from pyspark import SparkConf

        submitted = SparkConf()  # what spark-submit and spark-defaults set
        given = {k: v for k, v in DEFAULTS.items() if not submitted.contains(k)} | given
    for k, v in given.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
