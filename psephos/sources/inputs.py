"""The named inputs every report reads, as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame


@dataclass
class HouseInputs:
    """House of Representatives feeds (one snapshot of the count)."""

    fp_pp: DataFrame  # first preferences by polling place and candidate
    fp_type: DataFrame  # first preferences by candidate and vote type
    tcp_pp: DataFrame  # two-candidate preferred by polling place and candidate
    tcp_type: DataFrame  # two-candidate preferred by candidate and vote type
    enrolment: DataFrame  # enrolment by division
    pp_location: DataFrame | None = None  # polling-place list (loaded, not used)

    @cached_property
    def parties(self) -> list[str]:
        """The parties of the TCP feeds, the columns of the wide tables: found once, by one job.

        As many as Spark allows columns of a pivot; more are an error.
        """
        most = int(self.tcp_pp.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        found = self.tcp_pp.select("PartyAb").unionByName(self.tcp_type.select("PartyAb")).where("PartyAb IS NOT NULL").distinct()
        names = [r[0] for r in found.limit(most + 1).collect()]
        if len(names) > most:
            raise ValueError(f"the TCP feeds name over {most} parties (spark.sql.pivotMaxValues)")
        return sorted(names)


@dataclass
class SenateInputs:
    fp_div: DataFrame  # first preferences by division, candidate and vote type
    fp_group: DataFrame  # first preferences by state and group


@dataclass
class PrepollInputs:
    """Wide daily pre-poll counts of two elections plus state enrolment text."""

    prepoll_2013: DataFrame
    prepoll_2016: DataFrame
    enrolment_2013: DataFrame
    enrolment_2016: DataFrame
