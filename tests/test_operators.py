"""Operators against brute force, at their boundaries, and on documented examples."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightings.functions import geometry, text
from sightings.operators import alerts, changes, filters, plates, postprocess, tracking, zones

BOX = "struct<left:double,top:double,width:double,height:double>"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def box(l, t, w, h):
    return geometry.make_box(*[F.lit(float(v)) for v in (l, t, w, h)])


def test_iou_edges(spark):
    r = one(
        spark,
        geometry.box_iou(box(0, 0, 0, 0), box(0, 0, 0, 0)),
        geometry.box_iou(box(0, 0, 1, 1), box(1, 0, 1, 1)),
        geometry.box_iou(box(0, 0, 1, 1), box(0, 0, 1, 0.5)),
    )
    assert tuple(r) == (0.0, 0.0, 0.5)


def test_road_examples(spark):
    line = lambda s: geometry.parse_road_line(F.lit(s))
    y = lambda x, s: geometry.polyline_y(F.lit(x), line(s))
    three = "0:0.31, 0.651:0.348, 1.0:0.479"
    r = one(
        spark, y(0.5, "0:0.5, 1.0:0.2"), y(-1.0, three), y(0.651, three), y(2.0, three),
        y(0.5, "all"), geometry.parse_road_mode(F.lit("all")), geometry.parse_road_mode(F.lit("")),
    )
    assert r[0] == pytest.approx(0.35) and r[1] == 0.31 and r[2] == pytest.approx(0.348)
    assert r[3] == 0.479 and r[4] is None and r[5] == "all" and r[6] is None


def test_text_matches_python(spark):
    values = [0.0, 0.005, 0.015, 0.125, 0.285, 0.295, 0.375, 0.625, 0.995, 1.0] + [
        i / 1024 for i in range(1025)
    ] + [round(random.Random(i).random(), 8) for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", text.fixed(F.col("v"), 2).alias("a"),
                    text.percent_label(F.lit("x"), "v").alias("p")).collect()
    for r in got:
        assert r.a == "{:.2f}".format(r.v)
        assert r.p == "{} {:.1f}%".format("x", r.v * 100)


def test_names(spark):
    r = one(
        spark,
        text.strip_extension(F.lit("a.b.jpg")), text.strip_extension(F.lit(".hid")),
        text.base_name(F.lit("/x/y.jpg")), text.base_name(F.lit("y.jpg")),
        text.short_camera_name(F.lit("http://front-entry-cam.home/cgi?x=1")),
        text.short_camera_name(F.lit("rtsp://u:p@shed.home:554/s")),
        text.duration_text(F.lit(119)), text.duration_text(F.lit(7200)),
    )
    assert tuple(r) == (
        "a.b", ".hid", "y.jpg", "y.jpg", "front-entry", "shed", "minute", "2 hours",
    )


def strict(spark, ious):
    rows = [(0, "c", 0, "t", (0.0, 0.0, 1.0, x)) for x in ious]
    return spark.createDataFrame(
        [(i, *r[1:]) for i, r in enumerate(rows)],
        f"frame_id long, cam string, det_no int, tag string, box {BOX}",
    ).withColumn("ignore", F.lit(None).cast("string"))


def test_zone_order_and_limits(spark):
    zones_df = spark.createDataFrame(
        [
            ("c", "*", 0, (0.0, 0.0, 1.0, 1.0), None),
            ("c", "*", 1, (0.0, 0.0, 1.0, 1.0), "second"),
            ("c", "t", 0, (0.0, 0.0, 1.0, 0.25), "low"),
            ("c", "u", 0, (0.0, 0.0, 1.0, 1.0), "other"),
        ],
        f"cam string, tag string, ord int, box {BOX}, comment string",
    )
    got = [
        r.ignore
        for r in zones.apply_exclusions(strict(spark, [0.5, 0.75, 0.25, 0.125]), zones_df)
        .orderBy("frame_id").collect()
    ]
    assert got == [None, "static", "low", None]  # exactly one half is not enough
    marked = strict(spark, [1.0]).withColumn("ignore", F.lit("road"))
    assert zones.apply_exclusions(marked, zones_df).first().ignore == "road"


def test_hysteresis_needs_no_marks_of_what_cannot_pass(spark):
    """Rows under every threshold change nothing; a tag with two thresholds repeats no row."""
    probs = [0.2, 0.3, 0.4, 0.41, 0.5, 0.51, 0.7, None, float("nan")]
    rows = [(i, k % 3, t, p) for i, p in enumerate(probs) for k, t in enumerate(["dog", "cat", "fox", None])]
    det = spark.createDataFrame(rows, "frame_id long, det_no int, tag string, prob double")
    limits = spark.createDataFrame([("dog", 0.25), ("cat", 0.9), ("cat", 0.45), ("fox", None)], "tag string, min_prob double")
    got = filters.may_pass(det, limits, 0.5)
    assert got.columns == det.columns
    least = {"dog": 0.25, "cat": 0.45, "fox": 0.5, None: 0.5}
    want = [r for r in rows if r[3] is not None and not r[3] <= min(0.4, least[r[2]])]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_scores_need_no_departures(spark, monkeypatch):
    """Departures take jobs, which a query that doesn't read them does not run."""
    from sightings.plans import queries

    def unread(*_):
        raise AssertionError("departures were computed")

    monkeypatch.setattr(tracking, "_departures", unread)
    p = queries.Pipeline(spark, "/root/testdata/sf0.001")
    assert p.scored.count() == p.tracked.count() > 0
    assert not {"box", "start_ts", "last_ts"} & set(p.scored.columns)
    with pytest.raises(AssertionError, match="departures were computed"):
        p.departures  # noqa: B018


def test_hysteresis_boundaries(spark):
    """Present at 0.6, held at 0.45, not at exactly 0.4; gone after a frame without it."""
    probs = {1: 0.6, 2: 0.45, 3: 0.4, 4: 0.45, 5: 0.7, 7: 0.45, 8: 0.5}
    frames = spark.sql(
        "select id as frame_id, 'c' as cam, id as frame_no,"
        " timestamp_seconds(id * 1800) as frame_ts from range(1, 9)"
    )
    det = spark.createDataFrame(
        [(k, "c", k, 0, "dog", v, (0.0, 0.0, 0.1, 0.1)) for k, v in probs.items()],
        f"frame_id long, cam string, frame_no long, det_no int, tag string, prob double, box {BOX}",
    ).withColumn("frame_ts", F.timestamp_seconds(F.col("frame_id") * 1800))
    none = spark.createDataFrame([], "tag string, min_prob double")
    kept = filters.hysteresis_filter(filters.begin(det), frames, none, 0.5)
    assert sorted(r.frame_id for r in kept.collect()) == [1, 2, 5]


def test_linked_detections_need_no_frames(spark):
    """Steps after `with_links` give what they give with the frames, and don't read those again."""
    frames = spark.range(1, 40).selectExpr(
        "id as frame_id", "if(id % 3 = 0, 'a', 'b') as cam", "id as frame_no",
        "timestamp_seconds(id * 400) as frame_ts",
    )
    det = frames.filter("frame_id % 5 <> 1").selectExpr(
        "*", "0 as det_no", "'dog' as tag", "(frame_id * 29 % 64) / 64D as prob",
        "named_struct('left', 0D, 'top', 0D, 'width', 0.1D, 'height', 0.1D) as box",
    )
    limits = spark.createDataFrame([], "tag string, min_prob double")
    cams = spark.createDataFrame([("a", 30), ("b", 400)], "cam string, interval_s int")
    joined = filters.hysteresis_filter(filters.begin(det), frames, limits, 0.5)
    linked = filters.with_links(filters.begin(det), frames)
    kept = filters.hysteresis_filter(linked, filters.link_frames(frames), limits, 0.5)
    assert sorted(kept.select(*joined.columns).collect()) == sorted(joined.collect())
    want = tracking._prepare(joined, frames, cams, 3600)
    got = tracking._prepare(kept, None, cams, 3600)
    assert sorted(got.collect()) == sorted(want.collect())


def test_a_counted_frame_is_not_counted_again(spark):
    frames = spark.range(1, 12).selectExpr(
        "id as frame_id", "if(id % 3 = 0, 'a', 'b') as cam", "id as frame_no",
        "timestamp_seconds(id * 4000) as frame_ts",
    )
    linked = filters.link_frames(frames, count=True)
    counted = changes.warmed_up(linked)
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (linked, counted)]
    assert plans[0].count("Window") == plans[1].count("Window")
    pick = ("frame_id", "cam_age", "warm")
    assert sorted(counted.select(*pick).collect()) == sorted(changes.warmed_up(frames).select(*pick).collect())


def greedy(boxes, limit):
    keep = []
    for b in sorted(boxes, key=lambda b: (-b[1], b[0])):
        def over(k):
            w = max(0.0, min(k[4], b[4]) - max(k[2], b[2]))
            h = max(0.0, min(k[5], b[5]) - max(k[3], b[3]))
            i = w * h
            u = (k[4] - k[2]) * (k[5] - k[3]) + (b[4] - b[2]) * (b[5] - b[3]) - i
            return u == 0 or i / u > limit
        if not any(over(k) for k in keep):
            keep.append(b)
    return [b[0] for b in keep]


def test_nms_equals_greedy(spark):
    rng = random.Random(4)
    rows = []
    for f in range(60):
        for n in range(rng.randrange(1, 25)):
            x, y = rng.randrange(12) / 16, rng.randrange(12) / 16
            rows.append((f, "m", n, rng.randrange(3), rng.randrange(30, 64) / 64, x, y,
                         x + rng.randrange(0, 6) / 16, y + rng.randrange(0, 6) / 16))
    df = spark.createDataFrame(
        rows, "frame_id long, model string, box_no int, class_id int, conf double,"
              " x1 double, y1 double, x2 double, y2 double"
    )
    got = {}
    for r in postprocess.nms(df).orderBy("frame_id", "det_no").collect():
        got.setdefault((r.frame_id, r.tag_id), []).append(r.box_no)
    want = {}
    for r in rows:
        if r[4] > 0.4:
            want.setdefault((r[0], r[3]), []).append((r[2], *r[4:]))
    assert got == {k: greedy(v, 0.6) for k, v in want.items()}


def suppress_model(items, floor, limit, most):
    """items: list of (box_no, box, probs), in order of confidence."""
    probs = [list(p) for _, _, p in items]
    out = []
    while len(out) < min(most, len(items)):
        i = max(range(len(items)), key=lambda j: max(probs[j]))
        top = max(probs[i])
        if top < floor:
            break
        kind = probs[i].index(top)
        out.append((items[i][0], kind, top))
        a = items[i][1]
        for j, (_, b, _) in enumerate(items):
            w = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
            h = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
            u = a[2] * a[3] + b[2] * b[3] - w * h
            if j == i or (u and w * h / u > limit):
                probs[j][kind] = 0.0
    return out


def test_suppression_equals_model(spark):
    rng = random.Random(6)
    rows = []
    for f in range(40):
        for n in range(rng.randrange(1, 40)):
            b = tuple(rng.randrange(1, 10) / 16 for _ in range(4))
            rows.append((f, n, b, [rng.random() ** 3 for _ in range(4)]))
    df = spark.createDataFrame(rows, f"frame_id long, box_no int, box {BOX}, probs array<double>")
    got = {}
    for r in postprocess.nms_suppress(df).orderBy("frame_id", "det_no").collect():
        got.setdefault(r.frame_id, []).append((r.box_no, r.tag_id, r.prob))
    for f, group in itertools.groupby(rows, key=lambda r: r[0]):
        items = [r[1:] for r in group if max(r[3]) > 0.1]
        items.sort(key=lambda r: (-max(r[2]), r[0]))
        want = [(n, k, round(p, 8)) for n, k, p in suppress_model(items, 0.1, 0.45, 20)]
        assert got.get(f, []) == want


def test_grid_decode(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 9)) * 3
    rows = [(i, int(i % 13), int(i % 7), int(i % 5), v[i].tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "frame_id long, row int, col int, anchor int, v array<double>")
    sig = lambda x: 1 / (1 + np.exp(-x))
    for r in geometry.decode_grid(df, grid=(13, 13)).collect():
        x = v[r.frame_id]
        w = np.exp(x[2]) * geometry.ANCHORS[r.anchor][0] / 13
        assert r.box.left == pytest.approx((sig(x[0]) + r.col) / 13 - w / 2)
        e = np.exp(x[5:] - x[5:].max())
        assert r.probs == pytest.approx((e / e.sum() * sig(x[4])).tolist())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_plate_match_equals_all_pairs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("AB1") for _ in range(rng.randrange(0, 8)))
    known = [(w, i) for i, w in enumerate({word() for _ in range(40)})]
    reads = [(i, word()) for i in range(200)] + [(900, "a-b 1"), (901, "")]
    k = spark.createDataFrame(known, "plate string, ord int")
    r = spark.createDataFrame(reads, "id long, plate string")
    got = {x.id: (x.known_plate, x.distance) for x in plates.match_plates(r, k).collect()}
    norm = lambda s: "".join(c for c in s.upper() if c.isalnum())
    for i, w in reads:
        near = [(distance(norm(w), p), o, p) for p, o in known if distance(norm(w), p) <= 2]
        want = (min(near)[2], min(near)[0]) if near else (None, None)
        assert got[i] == want


def test_deletion_keys_are_all_of_them(spark):
    df = spark.createDataFrame([("ABCA1",), ("AAB",), ("X",), ("",)], "w string")
    got = {}
    for r in plates.with_deletion_keys(df, "w", "key", 2).collect():
        got.setdefault(r.w, set()).add(r.key)
    for w, keys in got.items():
        left = {"".join(c) for k in range(3) for c in itertools.combinations(w, max(0, len(w) - k))}
        assert keys == left
    assert len(got) == 4


def test_plates_are_not_broadcast_however_small_they_look(spark):
    """Their keys are dozens a plate, which the planner can't know from the size of a file."""
    k = spark.range(10).selectExpr("concat('AB1', id) as plate", "cast(id as int) as ord", "'x' as owner")
    r = spark.range(10).selectExpr("id", "concat('AB2', id) as plate")
    for d in (plates.match_plates(r, k), plates.with_known(plates.match_plates(r, k), k)):
        p = d._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in p, p


def test_plates_met_in_passes_are_the_same(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("AB1") for _ in range(rng.randint(0, 6)))
    known = [(word(), rng.choice([None, 1, 2, 3])) for _ in range(30)] + [(None, 0), ("a-b", 1), ("AB", 1), ("A B", 1)]
    k = spark.createDataFrame(known, "plate string, ord int")
    r = spark.createDataFrame([(i, word()) for i in range(60)] + [(900, None), (901, "ab"), (902, "")], "id long, plate string")
    whole = sorted(plates.match_plates(r, k).collect())
    words = r.selectExpr("plate as w").filter("w is not null")
    for most in range(4):
        assert plates._keys(words, "w", most) == plates.with_deletion_keys(words, "w", "key", most).count()
    monkeypatch.setattr(plates, "MOST_KEYS", 400)
    assert sorted(plates.match_plates(r, k).collect()) == whole


def test_only_texts_without_a_nearer_plate_make_more_keys(spark, monkeypatch):
    """Each key is a row of a shuffle."""
    made = []
    keyed = plates.with_deletion_keys

    def counted(df, word, out, most):
        made.append((word, most, sorted(x[word] for x in df.select(word).collect())))
        return keyed(df, word, out, most)

    monkeypatch.setattr(plates, "with_deletion_keys", counted)
    k = spark.createDataFrame([("ABCDE", 1)], "plate string, ord int")
    r = spark.createDataFrame([("ABCDE",), ("ABCDX",), ("ABXXE",), ("XXXXX",)], "plate string")
    got = {x.plate: x.distance for x in plates.match_plates(r, k).collect()}
    assert got == {"ABCDE": 0, "ABCDX": 1, "ABXXE": 2, "XXXXX": None}
    texts = [x for x in made if x[0] == "_text"]
    assert texts == [("_text", 1, ["ABCDX", "ABXXE", "XXXXX"]), ("_text", 2, ["ABXXE", "XXXXX"])]


def test_arrivals_compute_their_matches_once(spark):
    rows = [("Machinery", f"2024-01-0{i} 10:00:00") for i in (1, 1, 2, 3)] + [("other", "2024-01-01 10:00:00")]
    seen = spark.sparkContext.accumulator(0)

    def owner(x):
        seen.add(1)
        return x

    d = spark.createDataFrame(rows, "owner string, at string")
    d = d.select(F.udf(owner, "string").asNondeterministic()("owner").alias("owner"), F.expr("cast(at as timestamp_ntz) as ts"))
    got = alerts.owner_arrivals(d, "machinery", 86_400).orderBy("ts").collect()
    assert [(x.owner, str(x.ts)) for x in got] == [("machinery", "2024-01-01 10:00:00"), ("machinery", "2024-01-03 10:00:00")]
    assert seen.value == len(rows)


def test_edit_variants(spark):
    """All words at a distance of one; the word itself comes from replacing a letter by itself."""
    df = spark.createDataFrame([("A1",), ("",), ("BB",)], "w string")
    short = [""]
    for _ in range(3):
        short += [w + c for w in short for c in plates.ALPHABET if len(w) < 3]
    short = set(short)
    for r in df.select("w", plates.edit_variants("w").alias("v")).collect():
        want = {x for x in short if distance(r.w, x) == 1} | ({r.w} if r.w else set())
        assert set(r.v) == want and len(r.v) == len(want)


def test_phrases_build_up(spark):
    rows = [
        (1, 0, "X", None, None, None, None, None, None),
        (1, 1, "Y", "K1", "Ann", "red", "Ford", "T", True),
        (1, 2, "Z", "K2", "Bob", None, None, None, False),
        (1, 3, "W", None, None, None, None, None, None),
        (2, 0, "V", "K3", None, "blue", None, None, None),
        (2, 1, "U", "K1", "Ann", "red", "Ford", None, True),
    ]
    df = spark.createDataFrame(
        rows, "response_id long, pos int, plate string, known_plate string, owner string,"
              " color string, make string, model string, announce boolean"
    )
    got = [tuple(r) for r in plates.vehicle_phrases(df).orderBy("response_id", "pos").collect()]
    assert got == [
        (1, 0, "X", "Vehicle"),
        (1, 1, "Y", "Vehicle and Ann's red Ford T"),
        (1, 3, "W", "Vehicle and Ann's red Ford T"),
        (2, 0, "V", "blue vehicle"),
        (2, 1, "U", "blue vehicle and Ann's red Ford "),
    ]


def test_alpr_bodies(spark):
    bodies = [
        '{"success":true,"predictions":[{"plate":"A"},{},{"plate":""},{"plate":"B"}]}',
        '{"success":false,"predictions":[{"plate":"A"}]}',
        '{"predictions":[{"plate":"A"}]}', '{"success":true}', "broken", None,
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = {r.id: (r.plates, r.message, r["count"]) for r in plates.alpr_summary(df).collect()}
    assert got == {
        0: (["A", "B"], "Vehicle with plate A, B", 4), 1: ([], "", 1), 2: ([], "", 1),
        3: ([], "", 0), 4: ([], "", 0), 5: ([], "", 0),
    }


def test_sounds_and_priorities_of_departures(spark):
    from sightings.operators import alerts

    det = spark.createDataFrame(
        [
            (1, "deck", 0, "dog", 0.9, False, None),
            (1, "deck", 1, "cat", 0.9, False, None),
            (2, "deck", 0, "dog", 0.9, True, None),
            (3, "deck", 0, "dog", 0.9, True, 1),
            (3, "deck", 1, "cat", 0.9, True, -2),
            (4, "deck", 0, "fox", 0.9, False, None),
        ],
        "frame_id long, cam string, det_no int, tag string, prob double, departed boolean,"
        " prior_priority int",
    ).selectExpr(
        "*", "timestamp'2024-01-01 12:00:00' as frame_ts", "cast(null as double) as iou",
        "cast(null as string) as ignore", "5 as age",
    )
    states = spark.range(1, 5).selectExpr(
        "id as frame_id", "'home' as mode", "'on' as vehicle_detector",
        "'on' as person_detector", "'outside' as dog_status",
    )
    priorities = spark.sql("select * from values ('home','cat',-2), (null,'dog',-1) as t(mode,tag,priority)")
    sounds = spark.sql("select * from values ('dog','bark'), ('departed','falling') as t(tag,sound)")
    context = alerts.frame_context(det)
    s = alerts.score_detections(det, context, states, priorities)
    p = {r.frame_id: r.priority for r in alerts.frame_priority(s, context, states).collect()}
    n = {r.frame_id: r.sound for r in alerts.frame_sound(s, sounds).collect()}
    # Known priorities are kept; with nothing scored, the last detection decides.
    assert p == {1: -1, 2: -1, 3: -2, 4: 1}
    assert n == {1: "bark", 2: "falling", 3: "pushover", 4: "pushover"}


def test_unknown_classes_stay(spark):
    from sightings.operators import postprocess

    boxes = spark.createDataFrame([(1, 0), (2, 7)], "box_no int, tag_id int")
    labels = spark.createDataFrame([(0, "dog")], "tag_id int, tag string")
    got = {tuple(r) for r in postprocess.with_labels(boxes, labels).select("box_no", "tag", "unknown").collect()}
    assert got == {(1, "dog", False), (2, None, True)}


def test_a_missing_hash_is_no_repeat(spark):
    from sightings.operators import changes

    hashes = ["a", "a", None, None, "a", "b", "a"]
    rows = [("deck", i, None, h) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "cam string, frame_no int, x string, hash string").selectExpr(
        "*", "timestamp'2024-01-01 10:00:00' + make_interval(0,0,0,0,0,0,frame_no) as frame_ts"
    )
    kept = sorted(r.frame_no for r in changes.drop_repeat_frames(df).collect())
    assert kept == [0, 2, 3, 4, 5, 6]


def test_states_of_equal_time_have_an_order(spark):
    from sightings.operators.state import asof_state

    f = spark.sql("select 1 as frame_id, timestamp'2024-01-01 10:00:00' as frame_ts")
    for rows in (("on", "off"), ("off", "on")):
        s = spark.createDataFrame([("x", r) for r in rows], "entity string, state string").selectExpr(
            "*", "timestamp'2024-01-01 09:00:00' as ts"
        )
        assert asof_state(f, s, ["x"]).first()["x"] == "on"


def test_alerts_need_a_new_object_past_warm_up(spark):
    from sightings.operators import alerts, changes

    frames = spark.range(1, 6).selectExpr(
        "'deck' as cam", "id as frame_id", "cast(id as int) as frame_no",
        "timestamp'2024-01-01 10:00:00' + make_interval(0,0,0,0,0,0,id) as frame_ts",
    )
    seen = spark.createDataFrame([(2, True), (3, True), (4, False), (5, False), (5, True)], "frame_id long, is_new boolean")
    gate = lambda once: sorted(
        r[0] for r in alerts.alert_gate(seen, changes.warmed_up(frames, once=once)).collect()
    )
    assert gate(False) == [3, 5]
    assert gate(True) == [2, 3, 5]


def test_mailbox_is_silent(spark):
    alerting = spark.createDataFrame([(1, "mailbox", 1), (2, "deck", 1), (3, "deck", 0)], "frame_id long, cam string, visible_vehicles long")
    alpr = spark.createDataFrame([(i, ["K1"], 1) for i in (1, 2, 3)], "frame_id long, plates array<string>, count int")
    known = spark.createDataFrame(
        [("K1", 0, "Ann", "red", "Ford", "T", True)],
        "plate string, ord int, owner string, color string, make string, model string, announce boolean",
    )
    states = spark.createDataFrame([(i, "on", "home") for i in (1, 2, 3)], "frame_id long, vehicle_detector string, presence string")
    told = plates.told_plates(alerting, alpr, known)
    assert {(r.frame_id, r.phrase) for r in told.collect()} == {(1, "Ann's red Ford T"), (2, "Ann's red Ford T")}
    spoken = [(r.frame_id, r.spoken) for r in plates.plate_announcements(told, states).collect()]
    assert spoken == [(2, "Ann's red Ford T in driveway")]


def test_plate_lines_and_links(spark):
    from sightings.operators import alerts

    a = spark.createDataFrame(
        [(1, "peach tree", "cat near it", ["cat", "dog"], True), (2, "deck", "m", ["cat"], False)],
        "frame_id long, cam string, message string, tags array<string>, push boolean",
    )
    p = spark.createDataFrame([(1, 1, "B", "x"), (1, 0, "A", "Vehicle")], "frame_id long, pos int, plate string, phrase string")
    d = alerts.with_plates(a, p)
    assert {r.frame_id: r.message for r in d.collect()} == {1: "cat near it\nVehicle A\nx B", 2: "m"}
    (row,) = alerts.pushes(d, "http://w").collect()
    assert row.url == "http://w?file=1.jpg&model=color&cam=peach_tree&tags=cat,dog"


def test_departures_tell_in_order_with_their_first_priority(spark):
    from sightings.operators import alerts

    at = lambda s: f"timestamp'2024-01-01 10:00:{s:02d}'"
    first = "select * from values (1, 1, 0, 'cat', 't1', 2), (2, 2, 0, 'dog', 't2', -1), (2, 2, 1, 'cat', 't3', 1) as t(frame_id, frame_no, det_no, tag, track_id, priority)"
    scored = spark.sql(first).selectExpr(
        "*", "'deck' as cam", "true as is_new", "0.5D as prob", f"{at(0)} + make_interval(0,0,0,0,0,0,frame_no) as frame_ts"
    )
    gone = spark.sql("select * from values ('t1', 'cat', 9, true), ('t2', 'dog', 9, true), ('t3', 'cat', 9, true), ('t1', 'cat', null, true), ('t2', 'dog', 9, false) as t(track_id, tag, departed_frame, notify)")
    gone = gone.selectExpr(
        "*", "'deck' as cam", "7 as age", f"{at(50)} as departed_ts", "concat('bye ', track_id) as msg",
        f"{at(0)} + make_interval(0,0,0,0,0,0,cast(substr(track_id, 2) as int)) as start_ts",
    )
    gate = spark.createDataFrame([(2,)], "frame_id long")
    d = alerts.departing(gone, scored, scored, gate)
    assert [(r.det_no, r.track_id, r.prior_priority) for r in d.orderBy("det_no").collect()] == [
        (0, "t1", None), (1, "t3", 1), (2, "t2", -1),
    ]
    states = spark.sql("select 9L as frame_id, 'home' as mode, 'on' as vehicle_detector, 'on' as person_detector, 'outside' as dog_status, 'off' as vacation_mode")
    none = spark.sql("select * from values (null, 'cat', -2), ('home', 'x', 0) as t(mode, tag, priority)")
    sounds = spark.sql("select * from values ('departed', 'falling') as t(tag, sound)")
    (a,) = alerts.departure_alerts(d, states, none, sounds).collect()
    assert (a.message, a.priority, a.sound, a.push) == ("bye t1, bye t3, bye t2", -2, "falling", True)
    told = d.filter("prior_priority is not null")
    (a,) = alerts.departure_alerts(told, states, none, sounds).collect()
    assert (a.priority, a.sound, a.tags) == (-1, "pushover", ["cat", "dog"])


def test_zones_apart_are_told_without_the_overlap(spark):
    """And are those that the overlap rejects, also for boxes with missing or odd sides."""
    sides = [0.0, 0.25, 0.5, -0.5, None]
    rows = [(0, "c", "t", None, dict(zip(("left", "top", "width", "height"), b))) for b in itertools.product(sides, repeat=4)]
    rows += [(0, "c", "t", None, {"left": float("nan"), "top": -1.0, "width": 0.5, "height": 0.25}), (0, "c", "t", None, None)]
    box = "struct<left:double,top:double,width:double,height:double>"
    dets = spark.createDataFrame(rows, f"frame_id int, cam string, tag string, ignore string, box {box}")
    zone = {"left": 0.25, "top": 0.0, "width": 0.5, "height": 0.5}
    zones_df = spark.createDataFrame([("c", "*", 1, zone, "z")], f"cam string, tag string, ord int, box {box}, comment string")
    side = F.struct(*[F.lit(v).alias(k) for k, v in zone.items()])
    d = zones.apply_exclusions(dets.withColumn("want", geometry.box_iou(side, "box") > 0.5), zones_df)
    d = d.withColumn("meets", geometry.box_meets(side, "box")).withColumn("over", geometry.box_iou(side, "box") > 0)
    got = d.collect()
    assert len(got) == len(rows) and any(r.want for r in got) and any(not r.want for r in got)
    assert all((r.ignore == "z") == bool(r.want) for r in got)
    assert all(bool(r.meets) >= bool(r.over) for r in got if r.box is not None and r.box.left == r.box.left)
