import json
import os
import random
import time
import uuid
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from models import T0, random_archive, track_model
from sightings.streaming.feed import count_changes_stream, drop_repeat_frames_stream
from sightings.streaming.tracker import FRAME_STREAM, prepare_stream, track_stream

EMPTY_RULES = (
    "cam string, ord int, tags array<string>, max_bottom double, min_left double, "
    "max_center_x double, ignore string, rename_road boolean"
)
EMPTY_ZONES = (
    "cam string, tag string, ord int, "
    "box struct<left:double,top:double,width:double,height:double>, comment string"
)
CAMS = (
    "cam string, interval_s int, road_mode string, road_line array<struct<x:double,y:double>>, "
    "publish array<string>"
)


def write_frames(folder, frames, dets, parts, offset=0):
    """Frame documents, cut in time order into `parts` files."""
    size = -(-len(frames) // parts)
    for p in range(parts):
        lines = []
        for i, cam, ts in frames[p * size : (p + 1) * size]:
            found = [
                {"det_no": n, "tag_id": 0, "tag": tag, "prob": 0.9,
                 "box": dict(zip(("left", "top", "width", "height"), box))}
                for n, tag, box in dets.get(i, [])
            ]
            lines.append(json.dumps({
                "frame_id": i, "cam": cam, "frame_no": i,
                "frame_ts": ts.strftime("%Y-%m-%dT%H:%M:%SZ"), "detections": found,
            }))
        file = folder / f"{offset + p:04d}.json"
        file.write_text("\n".join(lines))
        # Streams take files in the order of their times.
        os.utime(file, (1_700_000_000 + offset + p,) * 2)


def prepared(spark, folder, interval, per_trigger):
    stream = (
        spark.readStream.schema(FRAME_STREAM)
        .option("maxFilesPerTrigger", per_trigger)
        .json(str(folder))
    )
    cams = spark.createDataFrame(
        [(c, s, None, None, ["car"]) for c, s in interval.items()], CAMS
    )
    none = lambda schema: spark.createDataFrame([], schema)
    return prepare_stream(
        stream, cams, none(EMPTY_RULES), none(EMPTY_ZONES), none("tag string, min_prob double"), 0.5
    )


def run(df, out, checkpoint):
    q = (
        df.writeStream.format("parquet").option("path", str(out))
        .option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def check(spark, out, rows, gone):
    got = spark.read.parquet(str(out)).collect()
    det = {
        (r.frame_id, r.det_no): (r.track_id, r.iou, r.age, r.is_new,
                                 (r.left, r.top, r.width, r.height))
        for r in got if r.kind == "det"
    }
    assert det == rows
    us = lambda t: int((t - T0).total_seconds()) * 1_000_000
    base = us(T0) + 1704139200 * 1_000_000
    left = sorted(
        (r.track_id, r.start_us - base, r.last_us - base, r.age, r.frame_us - base)
        for r in got if r.kind == "departed"
    )
    want = sorted(
        (i, us(s), us(l), a, us(at)) for i, s, l, a, at in gone if at is not None
    )
    assert left == want
    return got


@pytest.mark.parametrize("per_trigger", [1, 3, 100])
def test_stream_equals_model(spark, tmp_path, per_trigger):
    frames, dets, interval = random_archive(11, cams=3, n=60, outage=0.05)
    rows, gone = track_model(frames, dets, interval)
    src = tmp_path / "in"
    src.mkdir()
    write_frames(src, frames, dets, 5)
    run(track_stream(prepared(spark, src, interval, per_trigger), wait_s=0), tmp_path / "out", tmp_path / "cp")
    got = check(spark, tmp_path / "out", rows, gone)
    assert not [r for r in got if r.kind == "late"]
    # Count changes: replayed from the model's rows.
    sent, want = {}, []
    for i, cam, _ in frames:
        n = sum(1 for _, tag, _ in dets.get(i, []) if tag == "car")
        if sent.get(cam) != n:
            want.append((i, n))
            sent[cam] = n
    assert sorted(want) == sorted((r.frame_id, r["count"]) for r in got if r.kind == "count")


def test_restart_goes_on(spark, tmp_path):
    frames, dets, interval = random_archive(12, cams=2, n=80, outage=0.05)
    rows, gone = track_model(frames, dets, interval)
    src = tmp_path / "in"
    src.mkdir()
    half = len(frames) // 2
    write_frames(src, frames[:half], dets, 2)
    run(track_stream(prepared(spark, src, interval, 1), wait_s=0), tmp_path / "out", tmp_path / "cp")
    write_frames(src, frames[half:], dets, 2, offset=50)
    run(track_stream(prepared(spark, src, interval, 1), wait_s=0), tmp_path / "out", tmp_path / "cp")
    check(spark, tmp_path / "out", rows, gone)


def test_late_frames_leave_the_state_alone(spark, tmp_path):
    frames, dets, interval = random_archive(13, cams=1, n=20, outage=0, empty=0)
    rows, gone = track_model(frames, dets, interval)
    src = tmp_path / "in"
    src.mkdir()
    write_frames(src, frames, dets, 1)
    run(track_stream(prepared(spark, src, interval, 1), wait_s=0), tmp_path / "out", tmp_path / "cp")
    late = (10_000, frames[0][1], frames[3][2])
    write_frames(src, [late], {10_000: [(0, "car", (0.0, 0.0, 0.5, 0.5))]}, 1, offset=50)
    run(track_stream(prepared(spark, src, interval, 1), wait_s=0), tmp_path / "out", tmp_path / "cp")
    got = check(spark, tmp_path / "out", rows, gone)
    assert [(r.frame_id, r.tag) for r in got if r.kind == "late"] == [(10_000, "car")]


def memory(df):
    name = "t" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_repeat_frames_and_count_changes(spark, tmp_path):
    hashes = "AABBABBBAACA"
    rows = [
        (c, n, T0 + timedelta(seconds=n), h)
        for c in ("x", "y")
        for n, h in enumerate(hashes if c == "x" else reversed(hashes))
    ]
    schema = "cam string, frame_no long, frame_ts timestamp, hash string"
    for i in range(0, 12, 4):
        part = [r for r in rows if i <= r[1] < i + 4]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "f")
        )
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f"))
    want = {(c, n) for c, n, _, h in rows
            if n == 0 or h != (hashes if c == "x" else hashes[::-1])[n - 1]}
    got = memory(drop_repeat_frames_stream(src, wait_s=0)).collect()
    assert {(r.cam, r.frame_no) for r in got} == want and len(got) == len(want)

    counts = src.select(
        "cam", "frame_no", "frame_ts", F.lit("dog").alias("tag"),
        F.ascii("hash").cast("long").alias("count"),
    )
    got = memory(count_changes_stream(counts, wait_s=0)).collect()
    assert {(r.cam, r.frame_no) for r in got} == want and len(got) == len(want)


def test_frames_in_any_order_within_the_wait(spark, tmp_path):
    """Files shuffled within five minutes give the model's rows; a last frame sets all free."""
    frames, dets, interval = random_archive(14, cams=2, n=60, outage=0, empty=0.1)
    rows, gone = track_model(frames, dets, interval)
    src = tmp_path / "in"
    src.mkdir()
    end = max(t for _, _, t in frames) + timedelta(hours=2)
    mixed = list(frames)
    rng = random.Random(3)
    for _ in range(200):  # neighbours of less than four minutes change places
        i = rng.randrange(len(mixed) - 1)
        if abs((mixed[i][2] - mixed[i + 1][2]).total_seconds()) < 60:
            mixed[i], mixed[i + 1] = mixed[i + 1], mixed[i]
    place = {f[0]: k for k, f in enumerate(mixed)}
    disorder = max(
        (a[2] - b[2]).total_seconds() for a in mixed for b in mixed
        if a[1] == b[1] and place[a[0]] < place[b[0]]
    )
    assert 0 < disorder < 300
    last = [(20_000 + k, cam, end) for k, cam in enumerate(sorted({c for _, c, _ in frames}))]
    write_frames(src, mixed, dets, 12)
    write_frames(src, last, {}, 1, offset=50)
    flush = [(30_000 + k, cam, end + timedelta(minutes=6)) for k, (_, cam, _) in enumerate(last)]
    write_frames(src, flush, {}, 1, offset=60)
    run(track_stream(prepared(spark, src, interval, 1)), tmp_path / "out", tmp_path / "cp")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert not [r for r in got if r.kind == "late"]
    found = sorted((r.frame_id, r.det_no, r.track_id) for r in got if r.kind == "det")
    _, more = track_model(frames + last, dets, interval)
    assert len(found) == len(rows)
    told = [r for r in got if r.kind == "departed"]
    assert len(told) == len([g for g in more if g[4] is not None])
    assert all(r.msg.startswith(f"{r.tag} departed from {r.cam}") for r in told)
    ages = {}
    for r in sorted((r for r in got if r.kind == "det"), key=lambda r: r.frame_us):
        assert r.cam_age >= ages.get(r.cam, 0) and r.warm == (r.cam_age > 2)
        ages[r.cam] = r.cam_age


def test_late_rows_of_the_feed_are_marked(spark, tmp_path):
    schema = "cam string, frame_no long, frame_ts timestamp, hash string"
    order = [0, 2, 1, 4, 3, 5, 900, 1, 2000]
    for k, n in enumerate(order):
        row = [("x", n, T0 + timedelta(seconds=n), None if n == 5 else "AABBA"[n] if n < 5 else "Z")]
        spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
        time.sleep(0.05)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f"))
    got = memory(drop_repeat_frames_stream(src)).collect()
    assert sorted(r.frame_no for r in got if not r.late) == [0, 2, 4, 5, 900]
    assert [r.frame_no for r in got if r.late] == [1]
    assert all(r.frame_ts == T0 + timedelta(seconds=r.frame_no) for r in got)
