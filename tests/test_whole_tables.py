"""No row of the warehouse tables is left out of the view, and a refresh reads them anew."""

import pytest
from pyspark.sql import functions as F

from psephos.api import ElectionCount, PrepollSeries
from psephos.plans import sizing
from psephos.plans.registry import QUERIES
from psephos.sources.binding import WAREHOUSE_TABLES, ballot_grain, read_tables
from tests.conftest import SF_SMOKE


def test_every_line_item_is_in_the_grain(spark):
    tables = read_tables(spark, SF_SMOKE, WAREHOUSE_TABLES)
    grain = ballot_grain(tables).cache()
    assert grain.agg(F.sum("n_rows")).first()[0] == tables["lineitem"].count()
    assert grain.where("DivisionID % 6 = 5 AND vtype = 'ProvisionalVotes'").count() == 0
    assert grain.where("DivisionID % 5 = 4 AND vtype = 'OrdinaryVotes' AND k % 10 < 2").count() == 0


def test_events_on_the_31st_are_counted(spark, tmpdir_path):
    days = [2, 16, 17, 20, 31, 31]
    rows = [(f"2024-01-{d:02d} 10:00:00", i, "view") for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "t string, user_id bigint, event_type string").selectExpr("CAST(t AS timestamp_ntz) AS ts", "user_id", "event_type")
    df.write.parquet(f"{tmpdir_path}/events.parquet")
    daily = QUERIES["prepoll_daily"](spark, tmpdir_path)
    assert daily.agg(F.sum("Votes")).first()[0] == len(days)
    assert daily.where("Election = '2016' AND Day = 'Day15'").first().Votes == 2
    assert {r.State_Vote_Prop for r in QUERIES["prepoll_state_totals"](spark, tmpdir_path).collect()} == {0.5}


@pytest.mark.parametrize("cache", ["persist", "checkpoint"])
def test_refresh_sees_new_rows_and_releases_the_old_tables(spark, tmpdir_path, cache):
    for t in WAREHOUSE_TABLES:
        spark.read.parquet(f"{SF_SMOKE}/{t}.parquet").write.parquet(f"{tmpdir_path}/{t}.parquet")
    count = ElectionCount.from_warehouse(spark, tmpdir_path, cache=cache)

    def votes():
        return count.public_funding_group_hor().agg(F.sum("total_votes")).first()[0], count.seat_summary().agg(F.sum("total_votes")).first()[0]

    first = votes()
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    spark.read.parquet(f"{SF_SMOKE}/lineitem.parquet").write.mode("append").parquet(f"{tmpdir_path}/lineitem.parquet")
    for _ in range(3):
        count.refresh()
        assert votes()[1] == 2 * first[1] and votes()[0] > first[0]
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= held + 1


def test_grain_grows_with_the_input(spark):
    """Places come from the suppliers, so ten times the input has some ten times the grain; no seat's window holds places."""
    counts = {}
    for sf in ("sf0.01", "sf0.1"):
        grain = ballot_grain(read_tables(spark, f"/root/testdata/{sf}", WAREHOUSE_TABLES))
        counts[sf] = grain.groupBy("DivisionID", "k").count().count()
    assert counts["sf0.1"] > 5 * counts["sf0.01"]


@pytest.mark.parametrize("name", ["seat_summary", "prepoll_state_rate", "senate_quotas_half"])
def test_a_query_releases_what_the_one_before_it_kept(spark, tmpdir_path, monkeypatch, name):
    monkeypatch.setattr(sizing, "checkpoint_dir", lambda spark: None)  # persisted, as without a checkpoint folder
    for t in [*WAREHOUSE_TABLES, "events"]:
        spark.read.parquet(f"{SF_SMOKE}/{t}.parquet").write.parquet(f"{tmpdir_path}/{t}.parquet")
    held = lambda: len(spark.sparkContext._jsc.getPersistentRDDs())
    first = sorted(map(tuple, QUERIES[name](spark, tmpdir_path).collect()), key=repr)
    once = held()
    for _ in range(2):
        assert sorted(map(tuple, QUERIES[name](spark, tmpdir_path).collect()), key=repr) == first
    assert 0 < once and held() <= once
    for t in ("lineitem", "events"):
        spark.read.parquet(f"{SF_SMOKE}/{t}.parquet").write.mode("append").parquet(f"{tmpdir_path}/{t}.parquet")
    assert sorted(map(tuple, QUERIES[name](spark, tmpdir_path).collect()), key=repr) != first
    assert held() <= once


def test_prepoll_series_refreshes(spark, tmpdir_path):
    spark.read.parquet(f"{SF_SMOKE}/events.parquet").write.parquet(f"{tmpdir_path}/events.parquet")
    series = PrepollSeries.from_warehouse(spark, tmpdir_path, cache="persist")
    votes = lambda: series.state_totals().agg(F.sum("State_Totals")).first()[0]
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    first = votes()
    spark.read.parquet(f"{SF_SMOKE}/events.parquet").write.mode("append").parquet(f"{tmpdir_path}/events.parquet")
    for _ in range(3):
        series.refresh()
        assert votes() == 2 * first
    series.release()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= held
