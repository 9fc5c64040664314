"""Result-feed CSV scans and the CSV sink.

The count publishes CSV files that start with preamble lines, then a header,
then rows. Spark's CSV reader can only drop one header line per file, so the
scan reads lines as text. A header pass takes each file's first few lines (a
limit over the split that starts at byte 0, so no more is read), and one survey
looks for what needs care: a quoted line break, or a row equal to a leading
line. Feeds without either, the usual case, are one scan that drops the leading
lines by value; the others go by position (``records``). Rows are parsed by
``from_csv`` with the declared types, all in built-in functions. Quoted commas
and line breaks are kept and nothing is inferred.
Text columns get ``""`` for blanks (a blank party must still pass
``PartyNm != 'Informal'``), numeric blanks stay NULL.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
import uuid
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from psephos.constants import (
    ENROLMENT_2016_PREAMBLE_LINES,
    FEED_PREAMBLE_LINES,
    SEAT_SUMMARY_NAME,
    SEAT_SUMMARY_STAMP,
)
from psephos.sources import schemas
from psephos.sources.inputs import HouseInputs, PrepollInputs, SenateInputs
from psephos.sources.records import opens_quote, whole_records

# --- fixed values: feed file names -------------------------------------------------

EVENT_2016 = "20499"
EVENT_2013 = "17496"
STATE_FILES = ["NSW", "VIC", "QLD", "WA", "SA", "TAS", "ACT", "NT"]
HOUSE_FILES = {
    "fp_pp": "HouseStateFirstPrefsByPollingPlaceDownload-{event}-{state}.csv",
    "tcp_pp": "HouseTcpByCandidateByPollingPlaceDownload-{event}.csv",
    "tcp_type": "HouseTcpByCandidateByVoteTypeDownload-{event}.csv",
    "pp_location": "GeneralPollingPlacesDownload-{event}.csv",
    "fp_type": "HouseFirstPrefsByCandidateByVoteTypeDownload-{event}.csv",
    "enrolment": "GeneralEnrolmentByDivisionDownload-{event}.csv",
}
SENATE_FILES = {
    "fp_div": "SenateFirstPrefsByDivisionByVoteTypeDownload-{event}.csv",
    "fp_group": "SenateFirstPrefsByStateByGroupByVoteTypeDownload-{event}.csv",
}

def _leading_lines(spark: SparkSession, file: str, n: int) -> list[str]:
    """The first ``n`` lines of one file."""
    first = spark.read.text(file).where(F.col("_metadata.file_block_start") == 0).limit(n)
    return [r["value"] for r in first.select("value").collect()]


def _header_fields(line: str) -> list[str]:
    """Header names with runs of non-identifier characters as ``_``
    ("Electors on 2016 Certified list" -> "Electors_on_2016_Certified_list").

    Names that come out alike, in any case, get ``_1``, ``_2``, ... from the
    second on; an empty one is ``X``.
    """
    names: list[str] = []
    taken: set[str] = set()
    for field in next(csv.reader(io.StringIO(line))):
        base = re.sub(r"[^0-9A-Za-z]+", "_", field).strip("_") or "X"
        name = base
        for k in itertools.count(1):
            if name.lower() not in taken:
                break
            name = f"{base}_{k}"
        taken.add(name.lower())
        names.append(name)
    return names


def read_feed(
    spark: SparkSession,
    paths: str | list[str],
    schema: StructType | None,
    preamble: int = FEED_PREAMBLE_LINES,
    extra: bool = False,
) -> DataFrame:
    """Scan result-feed CSV files: ``preamble`` lines, a header, then rows.

    Columns are matched to ``schema`` by header name; a declared column that
    the files lack is an error that names it. Columns the schema does not
    declare are dropped, or with ``extra`` follow as text. Without a schema
    every column of the header is kept as text. Files without a header line
    give no rows. A header over several lines, and a quote that never closes,
    are errors. The header pass is a small job per file; it collects
    ``preamble + 1`` lines of each. The survey reads the files once and brings
    back two counts.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    text = spark.read.text(paths)
    leading = [_leading_lines(spark, unquote(f), preamble + 1) for f in text.inputFiles()]
    headers = sorted({x[preamble] for x in leading if len(x) > preamble})
    if not headers:
        return spark.createDataFrame([], schema or StructType([]))
    if broken := [h for h in headers if h.count('"') % 2]:
        raise ValueError(f"feed files have a line break inside their header: {broken}")
    names = _header_fields(headers[0])
    if any(_header_fields(h) != names for h in headers):
        raise ValueError(f"feed files disagree on their header: {headers}")
    declared = {f.name: f.dataType for f in schema.fields} if schema else {}
    if missing := [n for n in declared if n not in names]:
        raise ValueError(f"feed files lack the declared columns {missing}; their header has {names}")
    ddl = ", ".join(f"`{n}` {declared.get(n, StringType()).simpleString()}" for n in names)
    drop = sorted({line for lines in leading for line in lines})
    is_leading = (F.col("_metadata.file_block_start") == 0) & F.col("value").isin(drop)
    survey = text.agg(F.count_if(is_leading), F.count_if(~is_leading & opens_quote())).first()
    if survey[0] == sum(map(len, leading)) and not survey[1]:
        lines = text.where(~is_leading & (F.length("value") > 0))
    else:
        lines = whole_records(text, preamble + 1)
    # a quote mark inside a quoted field is doubled
    rows = lines.select(F.from_csv("value", ddl, {"mode": "FAILFAST", "escape": '"'}).alias("r"))
    keep = list(declared) + [n for n in names if n not in declared and (extra or not schema)]
    out = rows.select(*[F.col(f"r.`{n}`") for n in keep])
    return out.fillna("", subset=[f.name for f in out.schema.fields if isinstance(f.dataType, StringType)])


def _path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}"


def load_house(
    spark: SparkSession, base: str, event: str = EVENT_2016, states: list[str] = STATE_FILES, extra: bool = False
) -> HouseInputs:
    """The House feeds of one count snapshot from ``base``; ``extra`` keeps undeclared columns (as text).

    The locations feed, which no report reads, has the columns of its own header.
    """
    fp_pp = read_feed(
        spark, [_path(base, HOUSE_FILES["fp_pp"].format(event=event, state=s)) for s in states], schemas.HOUSE_FP_PP, extra=extra
    )

    def one(key, schema):
        return read_feed(spark, _path(base, HOUSE_FILES[key].format(event=event)), schema, extra=extra)

    return HouseInputs(
        fp_pp=fp_pp,
        fp_type=one("fp_type", schemas.HOUSE_FP_TYPE),
        tcp_pp=one("tcp_pp", schemas.HOUSE_TCP_PP),
        tcp_type=one("tcp_type", schemas.HOUSE_TCP_TYPE),
        enrolment=one("enrolment", schemas.ENROLMENT_DIV),
        pp_location=one("pp_location", None),
    )


def load_senate(spark: SparkSession, base: str, event: str = EVENT_2016) -> SenateInputs:
    """The Senate feeds (the division file is read once and serves both of its uses)."""
    return SenateInputs(
        fp_div=read_feed(spark, _path(base, SENATE_FILES["fp_div"].format(event=event)), schemas.SENATE_FP_DIV),
        fp_group=read_feed(spark, _path(base, SENATE_FILES["fp_group"].format(event=event)), schemas.SENATE_FP_GROUP),
    )


def load_tcp_type_2013(spark: SparkSession, base: str) -> DataFrame:
    """The 2013 TCP-by-vote-type file, kept for comparison."""
    return read_feed(spark, _path(base, HOUSE_FILES["tcp_type"].format(event=EVENT_2013)), schemas.HOUSE_TCP_TYPE)


def read_prepoll(spark: SparkSession, path: str, n_ids: int = 3) -> DataFrame:
    """A wide pre-poll file (header row, no preamble): ``n_ids`` id columns under their own names, then day columns."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    ids = [F.col(f"`{c}`") for c in raw.columns[:n_ids]]
    return raw.select(*ids, *[F.col(f"`{d}`").try_cast("long").alias(d) for d in raw.columns[n_ids:]])


def load_prepoll(
    spark: SparkSession,
    prepoll_2013: str,
    prepoll_2016: str,
    enrolment_2013: str,
    enrolment_2016: str,
    states: list[str] = STATE_FILES,
) -> PrepollInputs:
    """Pre-poll files of both elections and the two enrolment tables.

    The landed 2013 enrolment table is cut to the ``states``: it ends in a
    national total, which is no state. White space around its state codes goes.
    """
    e16 = read_feed(spark, enrolment_2016, schemas.ENROLMENT_2016, preamble=ENROLMENT_2016_PREAMBLE_LINES)
    e13 = spark.read.schema(schemas.ENROLMENT_2013).option("header", True).csv(enrolment_2013)
    e13 = e13.withColumn("State", F.regexp_replace("State", r"\A[\s\u00A0]+|[\s\u00A0]+\z", ""))
    return PrepollInputs(
        prepoll_2013=read_prepoll(spark, prepoll_2013),
        prepoll_2016=read_prepoll(spark, prepoll_2016),
        enrolment_2013=e13.where(F.col("State").isin(states)),
        enrolment_2016=e16,
    )


def write_seat_summary(df: DataFrame, out_dir: str, as_of: datetime) -> str:
    """Write the seat summary as one CSV file, ``HoR-<YYYYmmdd-HHMM>.csv``.

    A row per seat, so one task writes it. It is written to a staging folder
    beside its place and then renamed there: readers see the whole file or none,
    and an interrupted write leaves none under that name. A file of that name is
    replaced.
    """
    path = _path(out_dir, SEAT_SUMMARY_NAME.format(stamp=as_of.strftime(SEAT_SUMMARY_STAMP)))
    write_one_csv(df, path)
    return path


def write_one_csv(df: DataFrame, path: str) -> None:
    """``df`` in its order as one CSV file at ``path``, on any file system that Spark writes to."""
    spark = df.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    staging = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_staging-{uuid.uuid4().hex}")
    try:
        df.coalesce(1).write.option("header", True).csv(staging.toString())
        part = next(s.getPath() for s in fs.listStatus(staging) if s.getPath().getName().startswith("part-"))
        if fs.exists(target):
            fs.delete(target, True)
        if not fs.rename(part, target):
            raise OSError(f"could not move the written file to {path}")
    finally:
        fs.delete(staging, True)
