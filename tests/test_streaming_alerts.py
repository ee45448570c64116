"""Streams against the batch functions: alerts, states, silent cameras, throttling, retries."""

import os
import uuid
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from models import T0, random_archive, track_model
from sightings.operators import changes, postprocess, reports
from sightings.operators.state import asof_state, with_mode
from sightings.plans import fixtures as X
from sightings.plans.queries import THRESHOLD, Pipeline
from sightings.sources.sinks import BatchLedger, store_changes, today, write_sightings
from sightings.streaming import feed
from sightings.streaming.alerting import AlertJob, extra_text
from sightings.streaming.states import asof_state_stream
from sightings.streaming.tracker import prepare_stream, track_stream
from test_streaming import memory, prepared, run, write_frames

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def put_files(df, folder, parts, order):
    """A table as Parquet files of rising time; streams take files in the order of their times."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    os.makedirs(folder, exist_ok=True)
    spark = df.sparkSession
    for p in range(parts):
        place = f"{folder}/{uuid.uuid4().hex}"
        spark.createDataFrame(rows[p * size : (p + 1) * size], df.schema).coalesce(1).write.parquet(place)
        (name,) = [x for x in os.listdir(place) if x.endswith(".parquet")]
        file = f"{folder}/{p:04d}.parquet"
        os.replace(f"{place}/{name}", file)
        os.utime(file, (1_700_000_000 + p,) * 2)


def stream_of(spark, folder, schema, per_trigger):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/*.parquet")


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    """Frames with their detections and their states, as files, and what the batch makes of them."""
    folder = str(tmp_path_factory.mktemp("archive"))
    d = X.detections(spark, SF)
    item = F.struct("det_no", F.col("tag_id").cast("int").alias("tag_id"), "tag", "prob", "box")
    found = d.groupBy("frame_id").agg(F.array_sort(F.collect_list(item)).alias("detections"))
    states = X.frame_states(spark, SF).select(
        "frame_id", "mode", "vehicle_detector", "person_detector", "dog_status", "vacation_mode"
    )
    frames = X.frames(spark, SF).join(found, "frame_id", "left").join(states, "frame_id")
    extra = extra_text("mode", "vehicle_detector", "person_detector", "dog_status", "vacation_mode", "is_file")
    frames = frames.select(
        "frame_id", "cam", "frame_no", F.col("frame_ts").cast("timestamp").alias("frame_ts"), extra, "detections"
    )
    put_files(frames, folder, 6, "frame_ts")
    p = Pipeline(spark, SF)
    want = {
        "alerts": rows_of(p.alerts.select("frame_id", F.lit("new"), "message", "priority", "sound", "push"))
        + rows_of(p.departure_alerts.select("frame_id", F.lit("departed"), "message", "priority", "sound", "push")),
        "frames": rows_of(p.carried.select("frame_id", "tags", "scored", "priority")),
        "saved": rows_of(p.saved.select("frame_id", "priority", "tags", "min_age", "name")),
        "gone": rows_of(changes.departed_tags(p.carried).select("frame_id", "departed")),
    }
    kept = p.saved.select("frame_id", F.lit(True).alias("saved"))
    per_frame = p.frames.join(kept, "frame_id", "left").fillna(False, ["saved"])
    want["before"] = rows_of(changes.frame_before(per_frame).select("frame_id", "prior_frame_id"))
    want["species"] = rows_of(p.tracked.filter("is_new and tag = 'deer'").select("frame_id", "tag").distinct())
    return folder, frames.schema, {k: sorted(v, key=repr) for k, v in want.items()}


def tracked_stream(spark, frames):
    return track_stream(
        prepare_stream(
            frames, X.cameras(spark), X.rules(spark), X.excludes(spark), X.dim(spark, "thresholds_t"), THRESHOLD
        ),
        wait_s=0,
    )


COLUMNS = {
    "alerts": ["frame_id", "kind", "message", "priority", "sound", "push"],
    "frames": ["frame_id", "tags", "scored", "priority"],
    "saved": ["frame_id", "priority", "tags", "min_age", "name"],
    "gone": ["frame_id", "departed"],
    "before": ["frame_id", "prior_frame_id"],
    "species": ["frame_id", "tag"],
}


def job(spark, path, **options):
    dims = [X.dim(spark, n) for n in ("priorities_t", "sounds_t")]
    return AlertJob(spark, str(path), *dims, species=("deer",), **options)


def check_tables(ledger, want):
    for name, columns in COLUMNS.items():
        assert rows_of(ledger.read(name).select(*columns)) == want[name], name
    pushed = [r[0] for r in want["alerts"] if r[-1]]
    assert pushed and sorted(r["frame_id"] for r in ledger.read("pushes").collect()) == sorted(pushed)


@pytest.mark.parametrize("per_trigger", [1, 3, 100])
def test_alerts_of_a_stream_equal_the_batch(spark, tmp_path, archive, per_trigger):
    folder, schema, want = archive
    j = job(spark, tmp_path / "out")
    q = j.run(tracked_stream(spark, stream_of(spark, folder, schema, per_trigger)), str(tmp_path / "cp"))
    q.awaitTermination()
    assert all(want.values())
    check_tables(j.ledger, want)


def test_alerts_after_a_failure_and_a_restart(spark, tmp_path, archive):
    """A batch fails after some tables, another after all; both are tried again by a new query."""
    folder, schema, want = archive
    told = []

    def push(rows, batch):
        if batch == 4 and len(told) == 0:
            told.append("failed")
            raise RuntimeError("the receiver is away")

    class Broken(AlertJob):
        failed = 0

        def _carried(self, *args):
            if Broken.failed == 0 and self.ledger.entered() == 1:
                Broken.failed += 1
                raise RuntimeError("lost")
            return super()._carried(*args)

    dims = [X.dim(spark, n) for n in ("priorities_t", "sounds_t")]
    for _ in range(4):
        j = Broken(spark, str(tmp_path / "out"), *dims, species=("deer",), push=push)
        q = j.run(tracked_stream(spark, stream_of(spark, folder, schema, 1)), str(tmp_path / "cp"))
        try:
            q.awaitTermination()
            break
        except Exception:
            continue
    assert Broken.failed == 1 and told == ["failed"]
    check_tables(j.ledger, want)


def test_a_batch_written_twice_gives_its_rows_once(spark, tmp_path):
    ledger = BatchLedger(spark, str(tmp_path / "l"))
    rows = spark.range(3).toDF("x")
    ledger.write("t", rows, 0)
    ledger.write("t", spark.range(5).toDF("x"), 0)
    ledger.keep("k", rows, 0)
    assert ledger.entered() == -1 and ledger.kept("k", "x long", 0).count() == 0
    ledger.enter(0)
    ledger.write("t", rows, 1)
    assert ledger.read("t").count() == 5 and ledger.kept("k", "x long", 1).count() == 3
    calls = []
    once = ledger.once(lambda d, n: calls.append(n))
    for n in (0, 1, 1, 0, 2):
        once(rows, n)
    assert calls == [1, 2] and ledger.entered() == 2 and ledger.read("t").count() == 8


def test_days_and_changes_survive_a_retry(spark, tmp_path):
    f = X.frames(spark, SF).select("frame_id", "cam", "frame_ts")
    path = str(tmp_path / "days")
    for _ in range(2):
        write_sightings(f, path)
    assert spark.read.parquet(path).count() == f.count()
    newest = f.agg(F.max("frame_ts").cast("string")).first()[0]
    before = today(spark, path, newest).count()
    write_sightings(f.limit(0), path)
    assert today(spark, path, newest).count() == before
    path = str(tmp_path / "pieces")
    half = f.filter("frame_id % 2 = 0")
    for n, d in ((0, half), (1, f.filter("frame_id % 2 = 1")), (1, f.filter("frame_id % 2 = 1"))):
        write_sightings(d, path, batch=n)
    assert spark.read.parquet(path).count() == f.count()
    put_files(X.frames(spark, SF), str(tmp_path / "src"), 3, "frame_ts")
    src = stream_of(spark, str(tmp_path / "src"), X.frames(spark, SF).schema, 1)
    for _ in range(2):
        ledger, q = store_changes(feed.drop_repeat_frames_stream(src, wait_s=0), spark, str(tmp_path / "ch"), str(tmp_path / "cp"))
        q.awaitTermination()
    want = changes.drop_repeat_frames(X.frames(spark, SF)).select("frame_id")
    assert rows_of(ledger.read("changes").select("frame_id")) == rows_of(want)


def test_rows_of_a_silent_camera_leave(spark, tmp_path):
    """One camera stops; with the default wait its last rows and departures leave by another's time."""
    frames, dets, interval = random_archive(15, cams=2, n=60, outage=0.1)
    quiet = min(c for _, c, _ in frames)
    half = [f for f in frames if f[1] == quiet or True]
    end = max(t for _, c, t in half if c == quiet)
    src = tmp_path / "in"
    src.mkdir()
    write_frames(src, frames, dets, 4)
    other = next(c for _, c, _ in frames if c != quiet)
    last = max(t for _, _, t in frames)
    write_frames(src, [(50_000 + k, other, last + timedelta(minutes=6 + k)) for k in range(3)], {}, 3, offset=50)
    run(track_stream(prepared(spark, src, interval, 1)), tmp_path / "out", tmp_path / "cp")
    got = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.cam == quiet]
    rows, gone = track_model([f for f in frames if f[1] == quiet], dets, interval)
    assert {(r.frame_id, r.det_no) for r in got if r.kind == "det"} == set(rows)
    assert len([r for r in got if r.kind == "departed"]) == len([g for g in gone if g[4] is not None])
    assert max(r.frame_us for r in got if r.kind == "frame") == max(
        int((t - T0).total_seconds()) for _, c, t in frames if c == quiet
    ) * 1_000_000 + (1704139200 * 1_000_000 + int((T0 - T0).total_seconds())) + int(0) + _base()
    assert end <= last


def _base():
    """Microseconds of the archive's start, as the stream tells them."""
    return int((T0 - T0.replace(hour=0, minute=0, second=0)).total_seconds()) * 0 + _T0_US - 1704139200 * 1_000_000


_T0_US = int((T0 - T0.__class__(1970, 1, 1)).total_seconds()) * 1_000_000


@pytest.mark.parametrize("per_trigger,buckets", [(1, 1), (2, 3), (100, 1)])
def test_states_of_a_stream_equal_the_batch(spark, tmp_path, per_trigger, buckets):
    """States and frames in files of their own, states out of order within the wait."""
    states = X.entity_states(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    frames = X.frames(spark, SF).withColumn("frame_ts", F.col("frame_ts").cast("timestamp"))
    frames = frames.filter(F.col("frame_ts") <= states.agg(F.max("ts")).first()[0])
    put_files(frames, str(tmp_path / "f"), 4, "frame_ts")
    put_files(states, str(tmp_path / "s"), 4, F.expr("unix_micros(ts) + hash(ts, state) % 60000000"))
    end = frames.agg(F.max("frame_ts")).first()[0] + timedelta(hours=1)
    put_files(frames.limit(1).withColumn("frame_ts", F.lit(end)).withColumn("cam", F.lit("end")), str(tmp_path / "g"), 1, "frame_ts")
    os.replace(tmp_path / "g/0000.parquet", tmp_path / "f/0009.parquet")
    out = asof_state_stream(
        stream_of(spark, str(tmp_path / "f"), frames.schema, per_trigger),
        stream_of(spark, str(tmp_path / "s"), states.schema, per_trigger),
        X.ENTITIES, buckets=buckets, wait_s=86_400,
    )
    got = memory(out)
    columns = ["frame_id", "cam", *X.ENTITIES, "missing_state"]
    want = asof_state(frames, states, X.ENTITIES)
    # A day's wait holds the last day back; all that left is right, and in the end all leave.
    left = got.filter("cam <> 'end'").select(*columns)
    wanted = want.join(got.select("frame_id"), "frame_id", "left_semi").select(*columns)
    assert rows_of(left) == rows_of(wanted)


def test_states_then_tracks_in_one_stream(spark, tmp_path):
    """Two stateful operators, one behind the other: frames with live states reach the tracker."""
    frames, dets, interval = random_archive(16, cams=2, n=40, outage=0.05)
    src = tmp_path / "in"
    src.mkdir()
    write_frames(src, frames, dets, 3)
    states = spark.createDataFrame(
        [("night_mode", T0 - timedelta(hours=1), "on"), ("presence", T0 + timedelta(minutes=10), "away"),
         ("presence", frames[-1][2] + timedelta(days=1), "home")],
        "entity string, ts timestamp, state string",
    )
    put_files(states, str(tmp_path / "s"), 2, "ts")
    from sightings.streaming.tracker import FRAME_STREAM
    from test_streaming import CAMS, EMPTY_RULES, EMPTY_ZONES

    f = spark.readStream.schema(FRAME_STREAM).option("maxFilesPerTrigger", 1).json(str(src))
    s = stream_of(spark, str(tmp_path / "s"), states.schema, 1)
    both = asof_state_stream(f, s, ["night_mode", "presence"], wait_s=0)
    both = with_mode(both).withColumn("extra", F.to_json(F.struct("mode")))
    cams = spark.createDataFrame([(c, i, None, None, ["car"]) for c, i in interval.items()], CAMS)
    none = lambda schema: spark.createDataFrame([], schema)
    p = prepare_stream(both, cams, none(EMPTY_RULES), none(EMPTY_ZONES), none("tag string, min_prob double"), 0.5)
    run(track_stream(p, wait_s=None), tmp_path / "out", tmp_path / "cp")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    rows, _ = track_model(frames, dets, interval)
    assert {(r.frame_id, r.det_no): r.track_id for r in got if r.kind == "det"} == {k: v[0] for k, v in rows.items()}
    assert {r.extra for r in got if r.kind == "frame"} == {'{"mode":"night"}'}


def test_throttled_events_equal_the_batch_and_state_goes(spark, tmp_path):
    events = X.load(spark, SF, "events").select("event_type", "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    put_files(events, str(tmp_path / "e"), 5, "ts")
    src = stream_of(spark, str(tmp_path / "e"), events.schema, 1)
    keys = ["event_type", "user_id"]
    got = memory(feed.throttle_stream(src, keys, "ts", 86_400, tie="event_id", wait_s=0))
    want = changes.throttle(events, keys, "ts", 86_400, tie="event_id")
    assert rows_of(got.select("event_id")) == rows_of(want.select("event_id")) and got.filter("late").count() == 0
    # A key's state is gone once the period is over: only the last event's key has some left.
    end = events.agg(F.max("ts")).first()[0]
    more = spark.createDataFrame([("end", 1, 10**6, end + timedelta(days=3)), ("end", 1, 10**6 + 1, end + timedelta(days=3, hours=1))], events.schema)
    put_files(events.unionByName(more), str(tmp_path / "m"), 4, "ts")
    src = stream_of(spark, str(tmp_path / "m"), events.schema, 1)
    out = feed.throttle_stream(src, keys, "ts", 86_400, tie="event_id", wait_s=0)
    q = out.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    left = spark.read.format("statestore").option("stateVarName", "fired").load(str(tmp_path / "cp"))
    assert left.count() == 1


def test_cycle_reports_equal_the_batch_and_count_what_is_late(spark, tmp_path):
    f = X.frames(spark, SF).select(
        "cam", F.col("frame_ts").cast("timestamp").alias("frame_ts"), (F.col("frame_no") % 7 / 64).alias("prediction_s"),
        (F.col("frame_no") % 3 / 8).alias("notify_s"), F.concat("cam", F.lit("=[]")).alias("message"),
    )
    put_files(f, str(tmp_path / "f"), 4, "frame_ts")
    end = f.agg(F.max("frame_ts")).first()[0]
    close = f.limit(1).withColumn("frame_ts", F.lit(end + timedelta(hours=1)))
    late = f.limit(1).withColumn("frame_ts", F.lit(T0 - timedelta(days=1)))
    for n, d in ((8, close), (9, late)):
        put_files(d, str(tmp_path / f"x{n}"), 1, "frame_ts")
        os.replace(tmp_path / f"x{n}/0000.parquet", tmp_path / f"f/{n:04d}.parquet")
        os.utime(tmp_path / f"f/{n:04d}.parquet", (1_700_000_000 + n,) * 2)
    src = stream_of(spark, str(tmp_path / "f"), f.schema, 1)
    out = feed.cycle_report_stream(src, wait_s=60)
    name = "t" + uuid.uuid4().hex
    q = out.writeStream.format("memory").outputMode("append").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table(name)
    want = reports.cycle_report(f)
    assert rows_of(got) == rows_of(want) and feed.left_out(q) == 1


def test_suppression_of_arrays_equals_the_batch(spark, tmp_path):
    """Both suppressions over one frame's array, on a stream, against the grouped forms."""
    raw = X.raw_boxes(spark, SF)
    item = F.struct("model", "box_no", "class_id", "conf", "x1", "y1", "x2", "y2")
    frames = raw.groupBy("frame_id").agg(F.collect_list(item).alias("boxes"))
    put_files(frames, str(tmp_path / "b"), 3, "frame_id")
    src = stream_of(spark, str(tmp_path / "b"), frames.schema, 1)
    for mode in (False, True):
        got = memory(src.select("frame_id", F.inline(postprocess.nms_boxes(F.col("boxes"), min_mode=mode))))
        want = postprocess.nms(raw, min_mode=mode)
        columns = ["frame_id", "model", "det_no", "box_no", "tag_id", "prob", "box"]
        assert rows_of(got.select(*columns)) == rows_of(want.select(*columns))
    from sightings.functions.geometry import decode_grid

    cells = X.grid_cells(spark, SF).selectExpr("* except (row, col, frame_id)", "frame_id div 30 as frame_id",
        "cast(frame_id % 30 div 3 as int) as row", "cast(frame_id % 3 * 3 + det_no as int) as col")
    raw = decode_grid(cells, grid=(13, 13)).withColumn("box_no", F.expr("row * 1000 + col * 10 + anchor"))
    frames = raw.groupBy("frame_id").agg(F.collect_list(F.struct("box_no", "box", "probs")).alias("boxes"))
    put_files(frames, str(tmp_path / "g"), 3, "frame_id")
    src = stream_of(spark, str(tmp_path / "g"), frames.schema, 1)
    got = memory(src.select("frame_id", F.inline(postprocess.suppressed_boxes(F.col("boxes")))))
    want = postprocess.nms_suppress(raw)
    columns = ["frame_id", "det_no", "box_no", "tag_id", "prob", "box"]
    assert rows_of(got.select(*columns)) == rows_of(want.select(*columns))
    assert want.groupBy("frame_id").count().agg(F.max("count")).first()[0] == 20
    empty = spark.sql("select cast(null as array<struct<model:string,box_no:int,class_id:int,conf:double,x1:double,y1:double,x2:double,y2:double>>) as b")
    assert empty.select(F.size(postprocess.nms_boxes(F.col("b")))).first()[0] == 0
