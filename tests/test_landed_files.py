"""Senate and pre-poll reports read from landed files equal the same reports
over the warehouse view (the files are written from that view)."""

import os

import pytest

from psephos.api import ElectionCount, PrepollSeries
from psephos.sources.binding import election_inputs, prepoll_inputs
from psephos.sources.feeds import EVENT_2016, SENATE_FILES, load_senate
from tests.conftest import SF_SMOKE


def _write(df, path, preamble_lines=()):
    pdf = df.toPandas()
    with open(path, "w") as f:
        for line in preamble_lines:
            f.write(line + "\n")
        pdf.to_csv(f, index=False)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_senate_from_feed_files(spark, tmpdir_path):
    house, senate = election_inputs(spark, SF_SMOKE)
    _write(senate.fp_div, os.path.join(tmpdir_path, SENATE_FILES["fp_div"].format(event=EVENT_2016)), ["Senate"])
    _write(senate.fp_group, os.path.join(tmpdir_path, SENATE_FILES["fp_group"].format(event=EVENT_2016)), ["Senate"])
    landed = load_senate(spark, tmpdir_path)
    from psephos.operators import senate as S

    assert _rows(S.senate_quotas(landed.fp_group, 12)) == _rows(S.senate_quotas(senate.fp_group, 12))
    assert _rows(S.senate_quotas_candidate(landed.fp_div, 6)) == _rows(S.senate_quotas_candidate(senate.fp_div, 6))
    assert _rows(S.senate_turnout(landed.fp_div, house.enrolment)) == _rows(S.senate_turnout(senate.fp_div, house.enrolment))


def test_prepoll_from_landed_files(spark, tmpdir_path):
    inp = prepoll_inputs(spark, SF_SMOKE)
    paths = {k: os.path.join(tmpdir_path, f"{k}.csv") for k in ("p13", "p16", "e13", "e16")}
    _write(inp.prepoll_2013, paths["p13"])
    _write(inp.prepoll_2016, paths["p16"])
    _write(inp.enrolment_2013, paths["e13"])
    # The 2016 enrolment file carries four preamble lines and a spaced header.
    e16 = inp.enrolment_2016.withColumnRenamed("Electors_on_2016_Certified_list", "Electors on 2016 Certified list")
    _write(e16, paths["e16"], ["Enrolment statistics", "", "as at the close of rolls", ""])
    states = [r.State for r in inp.enrolment_2013.select("State").collect()]
    landed = PrepollSeries.from_files(spark, paths["p13"], paths["p16"], paths["e13"], paths["e16"], states)
    direct = PrepollSeries.from_warehouse(spark, SF_SMOKE)
    for method in ("prepoll_numbers", "prepoll_state_rate", "prepoll_div", "state_totals"):
        assert _rows(getattr(landed, method)()) == _rows(getattr(direct, method)()), method


@pytest.mark.parametrize("vacancies", [6, 12])
def test_count_facade_senate(spark, vacancies):
    count = ElectionCount.from_warehouse(spark, SF_SMOKE, cache="persist")
    assert count.calculate_senate_quotas(vacancies).count() == count.senate.fp_group.count()


def test_count_from_feed_files(spark, tmpdir_path):
    from pyspark.sql import functions as F

    from psephos.sources.feeds import HOUSE_FILES, STATE_FILES

    house, _ = election_inputs(spark, SF_SMOKE)
    for st in STATE_FILES:
        _write(house.fp_pp.where(F.col("StateAb") == st),
               os.path.join(tmpdir_path, HOUSE_FILES["fp_pp"].format(event=EVENT_2016, state=st)), ["House"])
    for key in ("fp_type", "tcp_pp", "tcp_type", "enrolment", "pp_location"):
        _write(getattr(house, key), os.path.join(tmpdir_path, HOUSE_FILES[key].format(event=EVENT_2016)), ["House"])
    landed = ElectionCount.from_feeds(spark, tmpdir_path, senate=False, cache="persist")
    direct = ElectionCount.from_warehouse(spark, SF_SMOKE, cache="persist")
    for method in ("seat_summary", "grim_reaper", "public_funding_group_hor", "tcp_comparison"):
        assert _rows(getattr(landed, method)()) == _rows(getattr(direct, method)()), method
    with pytest.raises(ValueError):
        landed.calculate_senate_quotas()
