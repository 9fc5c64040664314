"""Structured Streaming over feeds derived from the smoke tables."""

import os
import shutil

from pyspark.sql import functions as F

from psephos.operators import house as H
from psephos.sources import schemas
from psephos.sources.binding import election_inputs
from psephos.sources.feeds import EVENT_2016, HOUSE_FILES, STATE_FILES
from psephos.streaming.snapshots import snapshot_name, start_running_formal_votes, watch_snapshots
from tests.conftest import SF_SMOKE


def test_running_formal_votes_matches_batch(spark, tmpdir_path):
    house, _ = election_inputs(spark, SF_SMOKE)
    src = os.path.join(tmpdir_path, "fp_pp")
    # Polling places report in two waves.
    house.fp_pp.where(F.col("PollingPlaceID") % 2 == 0).write.parquet(src + "/wave=1")
    house.fp_pp.where(F.col("PollingPlaceID") % 2 == 1).write.parquet(src + "/wave=2")
    stream = spark.readStream.schema(schemas.HOUSE_FP_PP).parquet(src + "/*")
    out = os.path.join(tmpdir_path, "totals")
    q = start_running_formal_votes(stream, out, os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination()
    last = max(int(d.split("=")[1]) for d in os.listdir(out) if d.startswith("batch="))
    got = {(r.DivisionNm, r.PartyAb): r.votes for r in spark.read.parquet(f"{out}/batch={last}").collect()}
    want = {(r.DivisionNm, r.PartyAb): r.votes for r in H.formal_votes_by_party(house.fp_pp).collect()}
    assert got == want and len(got) > 0


def _write_feed(df, path, preamble="2016 Federal Election"):
    pdf = df.toPandas()
    with open(path, "w") as f:
        f.write(preamble + "\n")
        pdf.to_csv(f, index=False)


def test_snapshot_refresh(spark, tmpdir_path):
    house, _ = election_inputs(spark, SF_SMOKE)
    snap = os.path.join(tmpdir_path, "snap-001")
    os.makedirs(snap)
    for st in STATE_FILES:
        _write_feed(house.fp_pp.where(F.col("StateAb") == st), os.path.join(snap, HOUSE_FILES["fp_pp"].format(event=EVENT_2016, state=st)))
    for key, df in [("fp_type", house.fp_type), ("tcp_pp", house.tcp_pp), ("tcp_type", house.tcp_type),
                    ("enrolment", house.enrolment), ("pp_location", house.pp_location)]:
        _write_feed(df, os.path.join(snap, HOUSE_FILES[key].format(event=EVENT_2016)))
    # A second snapshot: the same count re-published under another name.
    snap2 = os.path.join(tmpdir_path, "later", "snap-001")  # ends like the first
    shutil.copytree(snap, snap2)
    notices = os.path.join(tmpdir_path, "notices")
    os.makedirs(notices)
    with open(os.path.join(notices, "n1.txt"), "w") as f:
        f.write(snap + "\n" + snap2 + "\n")
    out = os.path.join(tmpdir_path, "out")
    q = watch_snapshots(spark, notices, out, checkpoint_location=os.path.join(tmpdir_path, "ckpt"), available_now=True)
    q.awaitTermination()
    names = sorted(snapshot_name(x) for x in (snap, snap2))
    assert len(set(names)) == 2
    assert sorted(d for d in os.listdir(os.path.join(out, "public_funding")) if d.startswith("snapshot=")) == [f"snapshot={n}" for n in names]
    got = spark.read.parquet(os.path.join(out, "public_funding")).where(f"snapshot = '{snapshot_name(snap)}'").drop("snapshot")
    want = H.public_funding(house.fp_pp)
    assert {(r.PartyAb, r.total_votes) for r in got.collect()} == {(r.PartyAb, r.total_votes) for r in want.collect()}
    assert spark.read.parquet(os.path.join(out, "seat_summary")).where(f"snapshot = '{snapshot_name(snap2)}'").count() == H.seat_summary(
        H.build_house(house)["pp_all"], house.enrolment, H.build_house(house)["tcp_type"], house.tcp_type
    ).count()
