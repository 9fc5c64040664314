"""Session-style access to the reports, for users who work one count at a time.

    count = ElectionCount.from_feeds(spark, "/landing/snapshot-0702-2105")
    count.seat_summary(save_as_csv=True, out_dir="/reports")
    count.grim_reaper().show()
    count.division_total_votes("Canberra").show()
    count.refresh()                       # re-read the feeds, rebuild the tables

Method names follow the report names analysts already use. The shared tables
(candidate/place table, TCP matrix, full TCP table) are materialized once per
refresh: checkpointed into ``spark.checkpoint.dir`` when the cluster names
one, else persisted. Every method returns a lazy DataFrame.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from psephos.operators import house as H
from psephos.operators import prepoll as E
from psephos.operators import senate as S
from psephos.plans.sizing import release
from psephos.sources.binding import election_inputs, prepoll_inputs
from psephos.sources.feeds import STATE_FILES, load_house, load_prepoll, load_senate, write_seat_summary
from psephos.sources.inputs import PrepollInputs, SenateInputs


class ElectionCount:
    """One snapshot of a count: House (and optionally Senate) feeds plus the derived tables."""

    def __init__(self, loader, cache: str = "auto"):
        self._loader = loader
        self.cache = cache
        self._kept: list[DataFrame] = []
        self.refresh()

    @classmethod
    def from_feeds(cls, spark: SparkSession, base: str, senate: bool = True, cache: str = "auto") -> ElectionCount:
        """Feeds landed as CSV files under ``base`` (the published file names)."""
        return cls(lambda kept: (load_house(spark, base), load_senate(spark, base) if senate else None), cache)

    @classmethod
    def from_warehouse(cls, spark: SparkSession, sf_dir: str, cache: str = "auto") -> ElectionCount:
        """The election view over the warehouse tables in ``sf_dir``."""
        return cls(lambda kept: election_inputs(spark, sf_dir, cache, kept), cache)

    def refresh(self) -> ElectionCount:
        """Re-read the feeds and rebuild the derived tables (lazily, on first use).

        The tables of the last refresh are released first.
        """
        release(self._kept)
        self.house, self.senate = self._loader(self._kept)
        self.as_of = datetime.now()
        self.tables = H.build_house(self.house, self.cache, self._kept)
        return self

    def release(self) -> None:
        """Give back what is materialized; results are computed anew from then on."""
        release(self._kept)

    # --- House ----------------------------------------------------------------------

    def polling_place_results_by_candidate(self) -> DataFrame:
        return self.tables["pp_all"]

    def formal_hor_votes_by_party_by_div(self) -> DataFrame:
        return self.tables["formal_votes_div"]

    def tcp_by_party_by_pollingplace(self) -> DataFrame:
        return self.tables["tcp_pp"]

    def tcp_by_party_by_pollingplace_percent(self) -> DataFrame:
        return H.tcp_by_place_percent(self.tables["tcp_pp"])

    def tcp_by_party_by_division_percent(self) -> DataFrame:
        return H.tcp_by_division_percent(self.tables["tcp_long"], getattr(self.house, "parties", None))

    def tcp_by_vote_type_by_division(self) -> DataFrame:
        return self.tables["hor_tcp_type"]

    def tcp_by_vote_type_by_division_percent(self) -> DataFrame:
        return self.tables["tcp_type"]

    def grim_reaper(self) -> DataFrame:
        return H.lagging_incumbents(self.tables["tcp_long"], self.house.fp_type, self.house.enrolment)

    def percent_party_vote_by_division(self) -> DataFrame:
        return H.party_share_by_division(self.house.fp_type)

    def vote_type_by_div_inc_ppord(self) -> DataFrame:
        return self.tables["div_total_type"]

    def division_total_votes(self, division: str | None = None) -> DataFrame:
        return H.division_votes(self.tables["pp_all"], division)

    def division_total_percent(self, division: str | None = None) -> DataFrame:
        return H.division_percent(H.division_votes(self.tables["pp_all"], division, ordered=False))

    def division_tcp_votes(self, division: str | None = None) -> DataFrame:
        return H.division_tcp_votes(self.tables["tcp_type"], division)

    def division_tcp_percent(self, division: str | None = None) -> DataFrame:
        return H.division_tcp_percent(self.tables["tcp_type"], division)

    def public_funding_group_hor(self) -> DataFrame:
        return H.public_funding(self.house.fp_pp)

    def seat_summary(self, save_as_csv: bool = False, out_dir: str | None = None) -> DataFrame:
        """Seat overview; with ``save_as_csv`` also written as ``HoR-<as of>.csv`` under ``out_dir``."""
        df = H.seat_summary(self.tables["pp_all"], self.house.enrolment, self.tables["tcp_type"], self.house.tcp_type)
        if save_as_csv:
            if out_dir is None:
                raise ValueError("save_as_csv needs an out_dir")
            write_seat_summary(df, out_dir, self.as_of)
        return df

    def tcp_comparison(self) -> DataFrame:
        return H.tcp_comparison(self.tables["tcp_type"])

    # --- Senate ---------------------------------------------------------------------

    def _senate(self) -> SenateInputs:
        if self.senate is None:
            raise ValueError("this count was loaded without Senate feeds")
        return self.senate

    def prelim_senate_turnout_by_state(self) -> DataFrame:
        return S.senate_turnout(self._senate().fp_div, self.house.enrolment)

    def calculate_senate_quotas(self, vacancies: int = 6) -> DataFrame:
        return S.senate_quotas(self._senate().fp_group, vacancies)

    def senate_quotas_candidate(self, vacancies: int) -> DataFrame:
        return S.senate_quotas_candidate(self._senate().fp_div, vacancies)


class PrepollSeries:
    """Early-voting series of two elections: daily, running and against enrolment."""

    def __init__(self, inputs: PrepollInputs | None = None, loader=None):
        """From ``inputs``, or from ``loader(kept)``, which ``refresh`` calls again."""
        self._loader = loader or (lambda kept: inputs)
        self._kept: list[DataFrame] = []
        self.refresh()

    def refresh(self) -> PrepollSeries:
        """Release what the last refresh materialized and read the sources anew."""
        self.release()
        self.inputs = inputs = self._loader(self._kept)
        self.prepoll_all = E.combine_elections(inputs.prepoll_2013, inputs.prepoll_2016)
        self.enrolment_state_all = E.enrolment_both(
            E.enrolment_2013_by_state(inputs.enrolment_2013), E.enrolment_2016_by_state(inputs.enrolment_2016)
        )
        return self

    def release(self) -> None:
        """Give back what is materialized; results are computed anew from then on."""
        release(self._kept)

    @classmethod
    def from_files(
        cls,
        spark: SparkSession,
        prepoll_2013: str,
        prepoll_2016: str,
        enrolment_2013: str,
        enrolment_2016: str,
        states: list[str] = STATE_FILES,
    ) -> PrepollSeries:
        """``states``: the rows of the 2013 enrolment table that count (not its total)."""
        return cls(loader=lambda kept: load_prepoll(spark, prepoll_2013, prepoll_2016, enrolment_2013, enrolment_2016, states))

    @classmethod
    def from_warehouse(cls, spark: SparkSession, sf_dir: str, cache: str = "auto") -> PrepollSeries:
        return cls(loader=lambda kept: prepoll_inputs(spark, sf_dir, cache, kept))

    def prepoll_numbers(self) -> DataFrame:
        """National daily votes with running totals and shares of enrolment."""
        return E.prepoll_cumulative(E.prepoll_daily(self.prepoll_all))

    def prepoll_state(self) -> DataFrame:
        return E.prepoll_state_cumulative(self.prepoll_all)

    def prepoll_state_rate(self) -> DataFrame:
        return E.prepoll_state_rate(self.prepoll_state(), self.enrolment_state_all)

    def prepoll_div(self) -> DataFrame:
        return E.prepoll_division(self.prepoll_all)

    def state_totals(self) -> DataFrame:
        return E.prepoll_state_totals(self.prepoll_all, self.enrolment_state_all)


__all__ = ["ElectionCount", "PrepollSeries"]
