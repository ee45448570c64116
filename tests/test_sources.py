import json
import os
import time

from pyspark.sql import functions as F

from sightings.sources import dims, frames, sidecars, sinks


def test_frame_folder(spark, tmp_path):
    cam = tmp_path / "deck"
    (cam / "2024" / "01").mkdir(parents=True)
    now = time.time()
    for name, age in [("a.jpg", 30), ("2024/01/b.jpg", 60), ("old.jpg", 900), ("c.txt", 5)]:
        (cam / name).write_bytes(name.encode())
        os.utime(cam / name, (now - age, now - age))
    d = frames.read_frames_dir(spark, str(tmp_path))
    assert sorted(r.source.split("/")[-1] for r in d.collect()) == ["a.jpg", "b.jpg"]
    first = frames.next_files(d).collect()
    assert [(r.cam, r.source.split("/")[-1]) for r in first] == [("deck", "b.jpg")]
    assert {r.cam for r in frames.read_frames_dir(spark, str(cam)).collect()} == {"2024", None}
    q = (
        frames.read_frames_dir(spark, str(tmp_path), stream=True)
        .writeStream.format("memory").queryName("dropped").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert spark.table("dropped").count() == 2


def test_sidecar_files(spark, tmp_path):
    doc = {
        "source": "x.jpg", "time": "2024-01-01 10:00:00.250000",
        "predictions": [
            {"probability": 0.5, "tagId": 1, "tagName": "dog", "ignore": "road",
             "boundingBox": {"left": 0.1, "top": 0.2, "width": 0.3, "height": 0.4},
             "start_time": "2024-01-01 09:59:00"},
            {"probability": 0.75, "tagId": 0, "tagName": "cat", "age": 3,
             "boundingBox": {"left": 0.0, "top": 0.0, "width": 0.5, "height": 0.5}},
        ],
    }
    day = tmp_path / "20240101"
    day.mkdir()
    (day / "100000-deck-dog.txt").write_text(json.dumps(doc, indent=4))
    rows = sidecars.read_sidecars(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.prediction.tagName for r in rows] == ["dog", "cat"]
    assert rows[0].prediction.ignore == "road" and rows[1].prediction.age == 3
    assert str(rows[0].time) == "2024-01-01 10:00:00.250000"


def test_documents_without_predictions_stay(spark):
    docs = spark.createDataFrame(
        [(1, '{"source": "a", "predictions": [{"tagName": "dog"}]}'), (2, '{"source": "b", "predictions": []}'),
         (3, "broken"), (4, None)],
        "id int, body string",
    )
    got = [(r.id, r.status, r.pos) for r in sidecars.parse_sidecars(docs).orderBy("id").collect()]
    assert got == [(1, "ok", 0), (2, "empty", None), (3, "unreadable", None), (4, "unreadable", None)]


def test_sightings_by_day(spark, tmp_path):
    df = spark.sql(
        "select id as frame_id, timestamp'2024-01-01 20:00:00' + make_interval(0,0,0,0,cast(id as int))"
        " as frame_ts from range(10)"
    )
    path = str(tmp_path / "out")
    sinks.write_sightings(df, path)
    assert sorted(p for p in os.listdir(path) if p.startswith("dt=")) == [
        "dt=20240101", "dt=20240102",
    ]
    today = sinks.today(spark, path, "2024-01-02 03:00:00")
    assert today.count() == 6
    plan = today._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_config_files(spark, tmp_path):
    zone = {"left": 0.1, "top": 0.1, "width": 0.2, "height": 0.2}
    (tmp_path / "z.json").write_text(
        json.dumps({"deck": {"*": [zone, {**zone, "comment": "pole"}], "dog": [zone]}}, indent=2)
    )
    z = dims.load_excludes(spark, str(tmp_path / "z.json"))
    assert sorted((r.cam, r.tag, r.ord, r.comment) for r in z.collect() if r.comment) == [
        ("deck", "*", 1, "pole")
    ]
    assert z.count() == 3
    (tmp_path / "p.json").write_text(json.dumps({"B": {"owner": "x"}, "A": {"announce": False}}))
    p = dims.load_known_plates(spark, str(tmp_path / "p.json")).orderBy("ord").collect()
    assert [(r.plate, r.owner, r.announce) for r in p] == [("B", "x", True), ("A", None, False)]
    assert dims.load_known_plates(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{oops")
    assert dims.load_known_plates(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "labels.txt").write_text("person \nvehicle\r\ndog\n")
    got = dims.load_labels(spark, str(tmp_path / "labels.txt")).orderBy("tag_id").collect()
    assert [(r.tag_id, r.tag) for r in got] == [(0, "person"), (1, "vehicle"), (2, "dog")]


def test_changes_sink(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(5).write.parquet(str(src))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema("id long").parquet(str(src))
    q = sinks.write_changes(
        stream, lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "cp")
    )
    q.awaitTermination()
    assert spark.read.parquet(out).agg(F.sum("id")).first()[0] == 10
