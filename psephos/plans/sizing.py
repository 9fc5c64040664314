"""Lineage cuts for tables several reports share.

No broadcast hints are placed anywhere: joins are left to Spark's size check
(``spark.sql.autoBroadcastJoinThreshold`` on scan statistics) and to AQE,
which re-plans with runtime sizes and splits skewed partitions
(``spark.sql.adaptive.skewJoin.enabled``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def checkpoint_dir(spark) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    try:
        d = spark.sparkContext.getCheckpointDir()
    except Exception:  # noqa: BLE001 - no SparkContext under Spark Connect
        d = None
    return d or spark.conf.get("spark.checkpoint.dir", None) or None


def materialize(df: DataFrame, how: str = "persist", kept: list[DataFrame] | None = None) -> DataFrame:
    """Make ``df`` reusable across several reports.

    ``persist``: memory-and-disk cache; a lost executor's blocks are recomputed
    from lineage. ``checkpoint``: reliable checkpoint into the shared
    ``spark.checkpoint.dir`` (cuts lineage; survives executor loss without
    recomputation). ``auto``: ``checkpoint`` when the cluster names a
    checkpoint folder, else ``persist``; either gives the same answers.
    ``none``: keep it lazy. What is materialized is added to ``kept``;
    ``release`` it before the same sources are read anew, as Spark answers an
    equal plan from its cache.
    """
    if how == "none":
        return df
    if how == "auto":
        how = "checkpoint" if checkpoint_dir(df.sparkSession) else "persist"
    if how == "checkpoint":
        spark = df.sparkSession
        d = checkpoint_dir(spark)
        if not d:
            raise ValueError("spark.checkpoint.dir is not set; refusing a machine-local checkpoint")
        try:
            if not spark.sparkContext.getCheckpointDir():
                spark.sparkContext.setCheckpointDir(d)
        except Exception:  # noqa: BLE001 - Spark Connect reads the conf itself
            pass
        out = df.checkpoint(eager=True)
    else:
        from pyspark import StorageLevel

        out = df.persist(StorageLevel.MEMORY_AND_DISK)
    if kept is not None:
        kept.append(out)
    return out


def release(kept: list[DataFrame]) -> None:
    """Give back what ``materialize`` kept; checkpoint files go with their last reference."""
    while kept:
        kept.pop().unpersist(blocking=True)


#: What the last registered query of each Spark application materialized.
_OF_LAST_QUERY: dict[str, list[DataFrame]] = {}


def kept_for_query(spark) -> list[DataFrame]:
    """A new list for what one registered query materializes; what the query before it kept is released.

    So a session holds one query's tables at a time, and each query reads its
    sources as they are. A result still held from before stays right: Spark
    recomputes what it needs of the released tables.
    """
    app = spark.sparkContext.applicationId
    release(_OF_LAST_QUERY.setdefault(app, []))
    return _OF_LAST_QUERY[app]
