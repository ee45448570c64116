import random
from datetime import timedelta

import pytest

from sightings.operators import tracking
from sightings.operators.tracking import track_all
from models import T0, random_archive, track_model

DET = (
    "frame_id long, cam string, frame_no long, frame_ts timestamp, det_no int, tag string, "
    "box struct<left:double,top:double,width:double,height:double>"
)


def tables(spark, frames, dets, interval):
    f = [(i, cam, i, ts) for i, cam, ts in frames]
    d = [
        (i, cam, i, ts, no, tag, box)
        for i, cam, ts in frames
        for no, tag, box in dets.get(i, [])
    ]
    return (
        spark.createDataFrame(d, DET),
        spark.createDataFrame(f, "frame_id long, cam string, frame_no long, frame_ts timestamp"),
        spark.createDataFrame(list(interval.items()), "cam string, interval_s int"),
    )


@pytest.mark.parametrize(
    "seed, slice_s, kw",
    [
        (1, 21_600, {"n": 250}),
        (2, 3600, {"n": 200, "cams": 2}),
        (3, 3600, {"n": 150, "cams": 3, "outage": 0.03, "gap": (20, 400)}),
    ],
)
def test_batch_equals_model(spark, seed, slice_s, kw):
    frames, dets, interval = random_archive(seed, **kw)
    rows, gone = track_model(frames, dets, interval)
    tracked, departures = track_all(*tables(spark, frames, dets, interval), slice_s=slice_s)
    got = {
        (r.frame_id, r.det_no): (r.track_id, r.iou, r.age, r.is_new, tuple(r.box))
        for r in tracked.collect()
    }
    assert len(got) == len(rows)
    bad = {k: (v, rows[k]) for k, v in got.items() if rows[k] != v}
    assert not bad, list(bad.items())[:5]
    left = sorted(
        (r.track_id, r.start_ts, r.last_ts, r.age, r.departed_ts) for r in departures.collect()
    )
    want = sorted(gone, key=lambda t: t[0])
    assert left == want


def test_tracks_that_join_and_never_leave(spark):
    """Two tracks take one box, then a third joins later: all end with the one they joined."""
    parked, halves = (0.0, 0.2, 1.0, 0.5), [(0.0, 0.2, 0.6, 0.5), (0.4, 0.2, 0.6, 0.5)]
    small = (0.3, 0.2, 0.4, 0.5)
    frames, dets = [], {}
    for i in range(900):
        frames.append((i, "c0", T0 + timedelta(seconds=30 * i)))
        dets[i] = [(0, "car", parked)]
    dets[0] = [(n, "car", b) for n, b in enumerate(halves)]
    dets[300].append((1, "car", small))
    dets[301] = [(0, "car", (0.15, 0.2, 0.7, 0.5))]
    interval = {"c0": 30}
    rows, gone = track_model(frames, dets, interval)
    assert len(gone) == 3
    tracked, departures = track_all(*tables(spark, frames, dets, interval), slice_s=1800)
    got = {(r.frame_id, r.det_no): (r.track_id, r.age) for r in tracked.collect()}
    assert got == {k: (v[0], v[2]) for k, v in rows.items()}
    left = sorted((r.track_id, r.start_ts, r.last_ts, r.age, r.departed_ts) for r in departures.collect())
    assert left == sorted(gone, key=lambda t: t[0])


def test_match_feeds_what_overlaps():
    """The comparison written out in `match` is that of `Track.overlap`."""
    rng = random.Random(3)
    some = lambda: tuple(rng.randrange(8) / 8 for _ in range(4))
    for _ in range(300):
        tracks = [tracking.Track(some(), 0, 0) for _ in range(6)]
        box = some()
        over = [t.overlap(box, box[2] * box[3]) for t in tracks]
        fed = [t for t, o in zip(tracks, over) if o > tracking.MIN_IOU]
        last, iou = tracking.match(tracks, box, 5)
        assert [t for t in tracks if t.age] == fed
        assert (last, iou) == ((fed[-1], [o for o in over if o > tracking.MIN_IOU][-1]) if fed else (None, None))


def test_input_of_the_tracker_is_computed_once(spark):
    d = spark.range(40).selectExpr(
        "id as frame_id", "'a' as cam", "id as frame_no",
        "cast(timestamp_seconds(1704148200 + id * 30) as timestamp_ntz) as frame_ts",
        "0 as det_no", "'dog' as tag",
        "named_struct('left', 0.1D, 'top', 0.1D, 'width', 0.2D, 'height', 0.2D) as box",
    )
    cams = spark.sql("select 'a' as cam, 30 as interval_s")
    tracked, gone = tracking.track_all(d, d.select("frame_id", "cam", "frame_no", "frame_ts"), cams)
    assert "Range" not in tracked._jdf.queryExecution().executedPlan().toString()
    assert [r.age for r in tracked.orderBy("frame_no").collect()] == list(range(40))
    assert gone.count() == 1
