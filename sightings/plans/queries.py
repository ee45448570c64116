"""One registered query per operator, over the whole derived tables.

Results are flat (boxes as four columns, lists as comma texts), so that they can be compared
value by value with the SQL of `oracle.py`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.functions import geometry, text, timing
from sightings.functions.columns import with_lookup
from sightings.operators import (
    alerts,
    changes,
    filters,
    plates,
    postprocess,
    reports,
    review,
    tracking,
    zones,
)
from sightings.operators.ordered import lag, running
from sightings.plans import fixtures as X
from sightings.schema import FRAME_ORDER
from sightings.session import checkpoint_root, cut, written
from sightings.sources import sidecars, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
THRESHOLD = 0.65


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def flat(df: DataFrame, *extra: str | Column) -> DataFrame:
    """Identity of a detection, its box as columns, and what else is asked for."""
    b = F.col("box")
    return df.select(
        "frame_id", "cam", "det_no", "tag",
        *[b[c].alias(c) for c in ("left", "top", "width", "height")],
        *extra,
    )


def joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


# -- sources and sinks --------------------------------------------------------------------

@query
def s2_drop_repeat_frames(spark, sf):
    kept = changes.drop_repeat_frames(X.frames(spark, sf))
    return kept.select("frame_id", "cam", "frame_no", "frame_ts", "hash")


@query
def s3_sidecars(spark, sf):
    """Documents made from the detections of each frame, parsed back to rows."""
    docs = sidecars.make_sidecars(X.prepared(spark, sf), X.frames(spark, sf))
    back = sidecars.parse_sidecars(docs, "body")
    b = F.col("prediction")["boundingBox"]
    p = F.col("prediction")
    return back.select(
        "source",
        F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"),
        "pos",
        p["tagName"].alias("tag"),
        p["tagId"].alias("tag_id"),
        p["probability"].alias("prob"),
        p["ignore"].alias("ignore"),
        b["left"].alias("left"),
        b["top"].alias("top"),
    )


@query
def s4_sightings_today(spark, sf):
    """Frames written by day, and those of the newest day read back."""
    f = X.frames(spark, sf).select("frame_id", "cam", "frame_ts")
    path = written(f"{checkpoint_root(spark)}/sightings-by-day-{uuid.uuid4().hex}")
    sinks.write_sightings(f, path)
    newest = f.agg(F.max("frame_ts").cast("string")).first()[0]
    return sinks.today(spark, path, newest).select("frame_id", "cam", F.col("dt").cast("string").alias("dt"))


@query
def s7_latest_by_tag(spark, sf):
    """Of the alerts of new objects and of departures."""
    p = Pipeline(spark, sf)
    told = [d.select("frame_id", "frame_ts", F.explode("tags").alias("tag")) for d in (p.alerts, p.departure_alerts)]
    return alerts.latest_by_tag(told[0].unionByName(told[1]))


@query
def s8_file_camera(spark, sf):
    """File cameras are never saved."""
    f = X.frames(spark, sf)
    return f.filter(~F.col("is_file")).groupBy("cam").agg(F.count(F.lit(1)).alias("savable"))


# -- filters ------------------------------------------------------------------------------

@query
def f1_route_models(spark, sf):
    raw = postprocess.nms(X.raw_boxes(spark, sf))
    d = filters.route_models(raw, X.frames(spark, sf), X.cameras(spark))
    return d.select("frame_id", "cam", "det_no", "model", "tag_id", "box_no", r6("prob"))


@query
def f2_center(spark, sf):
    d = filters.with_center(X.detections(spark, sf))
    return d.select(
        "frame_id", "det_no", F.col("center.x").alias("cx"), F.col("center.y").alias("cy")
    )


def _linked_frames(spark, sf):
    """Frames with the camera's frame before; several steps read them, so they are written."""
    return cut(filters.link_frames(X.frames(spark, sf), count=True))


def _kept(spark, sf, frames=None, unread=()):
    """Marked detections past the hysteresis, without columns that the caller doesn't read."""
    frames = _linked_frames(spark, sf) if frames is None else frames
    thresholds = X.dim(spark, "thresholds_t")
    d = filters.may_pass(X.detections(spark, sf), thresholds, THRESHOLD)
    d = cut(X.prepared(spark, sf, frames, d).drop(*unread))
    return filters.hysteresis_filter(d, frames, thresholds, THRESHOLD)


@query
def f3_hysteresis(spark, sf):
    d = _kept(spark, sf)
    return d.select("frame_id", "cam", "det_no", "raw_tag", "tag", "prob", "ignore")


@query
def f4_region_rules(spark, sf):
    d = filters.begin(X.detections(spark, sf))
    return flat(filters.apply_region_rules(d, X.rules(spark)), "raw_tag", "ignore")


@query
def f5_road(spark, sf):
    d = filters.begin(X.detections(spark, sf))
    return flat(filters.classify_road(d, X.cameras(spark)), "raw_tag", r6("road_y"), "ignore")


@query
def f6_valid(spark, sf):
    return flat(filters.valid(X.prepared(spark, sf)), "prob")


@query
def f7_confidence(spark, sf):
    d = X.raw_boxes(spark, sf).filter(F.col("conf") > postprocess.CONFIDENCE)
    return d.select("frame_id", "model", "box_no", "class_id", "conf")


@query
def f8_sample_frames(spark, sf):
    return flat(filters.sample_frames(X.detections(spark, sf)), "frame_no", "prob")


@query
def f9_overdue_cameras(spark, sf):
    """Users stand in for cameras, as those of the archive all end together."""
    seen = X.load(spark, sf, "events").selectExpr("concat('u', user_id) as cam", "ts as frame_ts")
    cams = (
        X.load(spark, sf, "customer")
        .selectExpr("concat('u', c_custkey) as cam", "cast(c_custkey % 50 * 1800 as int) as interval_s")
    )
    return filters.overdue_cameras(seen, cams, "2024-01-31 00:00:00")


# -- joins --------------------------------------------------------------------------------

@query
def j1_exclusions(spark, sf):
    d = filters.begin(X.detections(spark, sf)).transform(
        filters.classify_road, X.cameras(spark)
    )
    return flat(zones.apply_exclusions(d, X.excludes(spark)), "ignore")


@query
def j2_frame_pairs(spark, sf):
    p = zones.frame_pairs(X.detections(spark, sf))
    return p.select(
        "cam", "tag", "frame_no", "frame_id", "det_no", "prev_frame_id", "prev_det_no", r6("iou")
    )


@query
def j3_asof_state(spark, sf):
    return X.frame_states(spark, sf)


@query
def j4_flags(spark, sf):
    d = review.flags_to_frames(
        X.flag_requests(spark, sf), X.frames(spark, sf), X.cameras(spark)
    )
    return d.select("event_id", "cam", "flag_type", "model", "tags", "frame_id", "status")


@query
def j5_match_plates(spark, sf):
    d = plates.match_plates(X.plate_reads(spark, sf), X.known_plates(spark, sf))
    return d.select("read_id", "plate", "known_plate", "distance")


def _flag_files(spark, sf):
    flags = review.flags_to_frames(
        X.flag_requests(spark, sf), X.frames(spark, sf), X.cameras(spark)
    ).filter("status = 'ok'")
    flags = flags.select(
        F.expr("concat('/review/', event_id, '.jpg')").alias("file"), "model", "cam", "tags"
    )
    files = X.load(spark, sf, "events").selectExpr(
        "concat('/review/', event_id, '.jpg') as file", "value"
    )
    return flags, files.filter("value >= 5").select("file")


@query
def j6_route_review(spark, sf):
    flags, files = _flag_files(spark, sf)
    d = review.route_review(flags, files, X.projects(spark))
    return d.select("file", "cam", "model", "tags", "status", "project_id")


@query
def j7_labels(spark, sf):
    labels = spark.sql(
        "select posexplode(array("
        + ", ".join(f"'{t}'" for t in X.TAGS)
        + ")) as (tag_id, tag)"
    )
    d = postprocess.with_labels(X.detections(spark, sf).drop("tag"), labels)
    return d.select("frame_id", "det_no", "tag_id", "tag")


@query
def j8_lookup(spark, sf):
    d = X.detections(spark, sf)
    d = with_lookup(d, X.dim(spark, "thresholds_t"), "tag", "min_prob", THRESHOLD)
    d = with_lookup(d, X.dim(spark, "sounds_t"), "tag", "sound", "pushover")
    return d.select("frame_id", "det_no", "tag", "min_prob", "sound")


# -- aggregations and post-processing -----------------------------------------------------

def _boxes(d: DataFrame, *extra):
    b = F.col("box")
    return d.select(
        "frame_id", *extra, "det_no", "box_no", "tag_id", r6("prob"),
        *[r6(b[c], c) for c in ("left", "top", "width", "height")],
    )


@query
def a1_nms(spark, sf):
    return _boxes(postprocess.nms(X.raw_boxes(spark, sf)), "model")


@query
def a1_nms_min_mode(spark, sf):
    return _boxes(postprocess.nms(X.raw_boxes(spark, sf), min_mode=True), "model")


@query
def a2_nms_suppress(spark, sf):
    cells = X.grid_cells(spark, sf).drop("row", "col").selectExpr(
        "*", "cast(frame_id % 2 as int) as row", "cast(det_no % 2 as int) as col"
    )
    grid = geometry.decode_grid(cells, grid=(13, 13))
    raw = grid.withColumn("box_no", (F.col("row") * 100 + F.col("col") * 10 + F.col("anchor")))
    b = F.col("box")
    return postprocess.nms_suppress(raw).select(
        "frame_id", "det_no", "box_no", "tag_id", "prob",
        *[b[c].alias(c) for c in ("left", "top", "width", "height")],
    )


@query
def a2_nms_suppress_crowded(spark, sf):
    """Forty frames taken as one, so that a frame has over a hundred candidates and the limit holds."""
    cells = X.grid_cells(spark, sf).selectExpr(
        "* except (frame_id, row, col)", "frame_id div 40 as frame_id",
        "cast(frame_id % 40 div 4 as int) as row", "cast(frame_id % 4 * 3 + det_no as int) as col",
    )
    grid = geometry.decode_grid(cells, grid=(13, 13))
    raw = grid.withColumn("box_no", F.col("row") * 1000 + F.col("col") * 10 + F.col("anchor"))
    # Equal candidates are ties in every engine.
    raw = raw.withColumn("probs", F.transform("probs", lambda p: F.round(p, 9)))
    b = F.col("box")
    return postprocess.nms_suppress(raw).select(
        "frame_id", "det_no", "box_no", "tag_id", "prob",
        *[b[c].alias(c) for c in ("left", "top", "width", "height")],
    )


class Pipeline:
    """From raw detections to alerts, counts and what is saved.

    Detections pass the hysteresis threshold, are tracked, scored, and inherit by track; the
    tables that several steps read are written once per query.
    """

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    @cached_property
    def frames(self):
        return _linked_frames(self.spark, self.sf)

    @cached_property
    def cameras(self):
        return X.cameras(self.spark)

    @cached_property
    def _tracks(self):
        # What no step after the marks reads is not carried on.
        kept = _kept(self.spark, self.sf, self.frames, unread=["center", "road_y", "tag_id"])
        return tracking.track_then(filters.valid(kept).drop("raw_tag"), self.frames, self.cameras)

    @cached_property
    def tracked(self):
        """Valid detections with their tracks. All are there; what departs has rows of its own."""
        d = self._tracks[0]
        d = d.drop("prev_frame_id", "prev_frame_ts")
        return cut(
            d.select("*", F.lit(False).alias("departed"), F.lit(None).cast("int").alias("prior_priority"))
        )

    @cached_property
    def departures(self):
        return cut(self._tracks[1]())

    @cached_property
    def counts(self):
        return reports.tag_counts(self.tracked, self.frames, self.cameras)

    @cached_property
    def shows(self):
        return reports.show_flag(self.counts, self.frames)

    @cached_property
    def sets(self):
        return reports.object_sets(self.tracked, self.frames)

    @cached_property
    def states(self):
        return cut(X.frame_states(self.spark, self.sf, self.frames))

    @cached_property
    def warm(self):
        return changes.warmed_up(self.frames).select("frame_id", "cam", "cam_age", "warm")

    @cached_property
    def gate(self):
        return cut(alerts.alert_gate(self.tracked, self.warm))

    @cached_property
    def context(self):
        return alerts.frame_context(self.tracked)

    @cached_property
    def scored(self):
        rules = X.dim(self.spark, "priorities_t")
        # Neither the rules nor their readers ask for boxes and spans.
        d = self.tracked.drop("box", "start_ts", "last_ts")
        return cut(alerts.score_detections(d, self.context, self.states, rules))

    @cached_property
    def priority(self):
        return alerts.frame_priority(self.scored, self.context, self.states)

    @cached_property
    def alerts(self):
        sounds = X.dim(self.spark, "sounds_t")
        return alerts.frame_alerts(self.scored, self.context, self.states, sounds, self.gate)

    @cached_property
    def visible(self):
        """Alerting frames with how many vehicles are in sight."""
        c = self.context.join(self.gate, "frame_id", "left_semi")
        return c.join(self.frames.select("frame_id", "cam"), "frame_id")

    @cached_property
    def told_plates(self):
        alpr = plates.alpr_summary(X.alpr_responses(self.spark, self.sf))
        return plates.told_plates(
            self.visible, alpr.withColumnRenamed("response_id", "frame_id"), X.known_plates(self.spark, self.sf)
        )

    @cached_property
    def departing(self):
        return cut(alerts.departing(self.departures, self.tracked, self.scored, self.gate))

    @cached_property
    def departure_alerts(self):
        dims = [X.dim(self.spark, n) for n in ("priorities_t", "sounds_t")]
        return alerts.departure_alerts(self.departing, self.states, *dims)

    @cached_property
    def carried(self):
        """Every frame with its tag sets and the priority it ends up with."""
        score = self.priority.withColumnRenamed("priority", "scored")
        per_frame = (
            self.sets.join(score, "frame_id", "left")
            .join(self.warm.select("frame_id", "warm"), "frame_id")
            .select(
                "cam", "frame_id", *FRAME_ORDER, "tags", "new_tags",
                (F.size("new_tags") > 0).alias("has_new"),
                (F.size("tags") > 0).alias("has_valid"),
                F.when(F.col("warm"), F.col("scored")).alias("scored"),
            )
        )
        return cut(changes.carry_priority(cut(per_frame)))

    @cached_property
    def saved(self):
        return alerts.saved_sightings(
            self.carried.select("frame_id", "priority", "tags"),
            reports.min_age(self.tracked, self.frames),
            self.frames,
        )


@query
def a3_tag_counts(spark, sf):
    return Pipeline(spark, sf).counts.select("cam", "frame_id", "frame_ts", "tag", "count")


@query
def a4_show_flag(spark, sf):
    return Pipeline(spark, sf).shows.select("cam", "frame_id", "show_count", "show")


@query
def a5_object_sets(spark, sf):
    d = Pipeline(spark, sf).sets
    return d.select("frame_id", "cam", joined("tags"), joined("new_tags"))


@query
def a6_min_age(spark, sf):
    p = Pipeline(spark, sf)
    return reports.min_age(p.tracked, p.frames)


def _crop(d):
    return d.select(
        "frame_id", *[r6(f"crop_{c}") for c in ("left", "top", "right", "bottom")]
    )


@query
def a7_alert_crop(spark, sf):
    return _crop(geometry.alert_crop(Pipeline(spark, sf).tracked, (1920, 1080)))


@query
def a7_vehicle_crop(spark, sf):
    return _crop(geometry.vehicle_crop(Pipeline(spark, sf).tracked, (1920, 1080)))


@query
def a8_frame_context(spark, sf):
    return Pipeline(spark, sf).context


@query
def a9_frame_priority(spark, sf):
    return Pipeline(spark, sf).priority


@query
def a10_cycle_report(spark, sf):
    labels = reports.frame_labels(
        Pipeline(spark, sf).tracked.selectExpr(
            "*", "cast(null as int) as priority", "cast(null as string) as priority_type"
        )
    )
    f = X.frames(spark, sf).select("frame_id", "frame_ts", "frame_no")
    d = labels.join(f, "frame_id").selectExpr(
        "*", "(frame_no % 7) / 64D as prediction_s", "(frame_no % 3) / 8D as notify_s"
    )
    return reports.cycle_report(d)


@query
def a11_alpr_summary(spark, sf):
    d = plates.alpr_summary(X.alpr_responses(spark, sf))
    return d.select("response_id", joined("plates"), "message", "count")


# -- sequential semantics -----------------------------------------------------------------

@query
def w1_tag_presence(spark, sf):
    d = filters.tag_presence(
        X.prepared(spark, sf, frames := _linked_frames(spark, sf)),
        frames,
        X.dim(spark, "thresholds_t"),
        THRESHOLD,
    )
    return d.select("cam", "tag", "frame_id", "present")


@query
def w2_departed_tags(spark, sf):
    d = changes.departed_tags(Pipeline(spark, sf).carried)
    return d.select("cam", "frame_id", joined("departed"))


@query
def w3_carry_priority(spark, sf):
    return Pipeline(spark, sf).carried.select("cam", "frame_id", "scored", "priority")


@query
def w4_count_changes(spark, sf):
    return changes.count_changes(Pipeline(spark, sf).counts).select(
        "cam", "tag", "frame_id", "frame_ts", "count"
    )


@query
def w4_show_changes(spark, sf):
    d = changes.show_changes(Pipeline(spark, sf).shows)
    return d.select("cam", "frame_id", "show_count", "show")


@query
def w5_warmed_up(spark, sf):
    return changes.warmed_up(X.frames(spark, sf)).select("frame_id", "cam", "cam_age", "warm")


@query
def w6_frame_before(spark, sf):
    p = Pipeline(spark, sf)
    kept = p.saved.select("frame_id", F.lit(True).alias("_kept"))
    per_frame = p.frames.join(kept, "frame_id", "left").withColumn(
        "saved", F.coalesce("_kept", F.lit(False))
    )
    d = changes.frame_before(cut(per_frame))
    return d.select("cam", "frame_id", "prior_frame_id", "prior_frame_ts")


@query
def w7_capture_health(spark, sf):
    return changes.capture_health(X.capture_attempts(spark, sf))


@query
def w8_throttle(spark, sf):
    events = X.load(spark, sf, "events").select("event_type", "user_id", "event_id", "ts")
    return changes.throttle(events, ["event_type", "user_id"], "ts", 86_400, tie="event_id")


@query
def k1_oldest_frame(spark, sf):
    """The file each camera's folder would yield first."""
    f = X.frames(spark, sf)
    first = F.min_by(F.struct("frame_id", "source"), F.struct(*FRAME_ORDER))
    return f.groupBy("cam").agg(first.alias("f")).select("cam", "f.frame_id", "f.source")


# -- functions ----------------------------------------------------------------------------

@query
def x1_box_iou(spark, sf):
    """Every detection against every zone of its camera."""
    d = X.detections(spark, sf).join(
        X.excludes(spark).select("cam", F.col("tag").alias("ztag"), "ord", F.col("box").alias("z")),
        "cam",
    )
    return d.select("frame_id", "det_no", "ztag", "ord", r6(geometry.box_iou("z", "box"), "iou"))


@query
def x2_box_iou_px(spark, sf):
    px = lambda dx: F.expr(
        "struct("
        f"cast(box.left * 512 as int) + {dx} as x1, cast(box.top * 512 as int) as y1,"
        f"cast((box.left + box.width) * 512 as int) as x2,"
        "cast((box.top + box.height) * 512 as int) as y2)"
    )
    d = X.detections(spark, sf)
    return d.select("frame_id", "det_no", r6(geometry.box_iou_px(px(0), px(20)), "iou"))


@query
def x3_polyline_y(spark, sf):
    d = X.detections(spark, sf).join(X.cameras(spark).select("cam", "road_line"), "cam")
    d = filters.with_center(d)
    return d.select(
        "frame_id", "det_no", r6(geometry.polyline_y("center.x", "road_line"), "road_y")
    )


@query
def x4_parse_road(spark, sf):
    """The parsed road settings of each detection's camera."""
    c = X.cameras(spark).select(
        "cam", "road_mode", F.expr("transform(road_line, p -> p.x + p.y)").alias("s")
    )
    return X.detections(spark, sf).join(c, "cam").select(
        "frame_id", "det_no", "cam", "road_mode",
        F.when(F.col("s").isNotNull(), F.size("s")).alias("points"),
        r6(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), "sum_xy"),
    )


@query
def x7_decode_grid(spark, sf):
    d = geometry.decode_grid(X.grid_cells(spark, sf), grid=(13, 13))
    b = F.col("box")
    return d.select(
        "frame_id", "row", "col", "anchor",
        *[r6(b[c], c) for c in ("left", "top", "width", "height")],
        *[r6(F.get("probs", F.lit(i)), f"p{i}") for i in range(4)],
    )


@query
def x8_corner_box(spark, sf):
    d = X.raw_boxes(spark, sf)
    box = geometry.corner_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    b = F.col("b")
    return d.withColumn("b", box).select(
        "frame_id", "model", "box_no",
        *[r6(b[c], c) for c in ("left", "top", "width", "height")],
    )


@query
def x9_small_hours(spark, sf):
    return X.load(spark, sf, "events").select(
        "event_id", timing.is_small_hours("ts").alias("small_hours")
    )


@query
def x10_mode(spark, sf):
    return X.frame_states(spark, sf).select("frame_id", "mode")


@query
def x11_edit_variants(spark, sf):
    """One row per plate and text that is one edit away."""
    # A plate has some 600 variants, and a file of plates may be one task's.
    d = X.known_plates(spark, sf).repartition(4 * spark.sparkContext.defaultParallelism)
    return d.select("plate", "ord", F.explode(plates.edit_variants("plate")).alias("variant"))


@query
def x12_location(spark, sf):
    d = Pipeline(spark, sf).sets.filter("size(tags) > 0")
    return d.select("frame_id", text.location_message("tags", "cam").alias("message"))


@query
def x13_departure_text(spark, sf):
    """Texts over the spans between each event and the user's one before."""
    e = X.load(spark, sf, "events")
    d = running(e, ["user_id"], ["ts", "event_id"], {"prev": lag("ts")}).filter("prev is not null")
    seconds = F.floor((timing.epoch_us("ts") - timing.epoch_us("prev")) / 1e6)
    msg = text.departure_text(
        F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id"), seconds
    )
    return d.select("event_id", msg.alias("msg"))


@query
def x14_labels(spark, sf):
    return reports.frame_labels(Pipeline(spark, sf).scored).select("frame_id", "message")


@query
def x15_percent(spark, sf):
    return X.detections(spark, sf).select(
        "frame_id", "det_no", text.percent_label("tag", "prob").alias("label")
    )


@query
def x16_names(spark, sf):
    f = X.frames(spark, sf)
    base = text.base_name("source")
    return f.select(
        "frame_id",
        text.underscored("cam").alias("key"),
        base.alias("base"),
        text.strip_extension(base).alias("stem"),
    )


@query
def x17_short_name(spark, sf):
    uri = F.concat(
        F.lit("http://user@"),
        F.regexp_replace("cam", " ", "-"),
        F.when(F.col("is_grey"), F.lit("-cam.home")).otherwise(F.lit(".home")),
        F.lit(":80/snap?x=1"),
    )
    return X.frames(spark, sf).select("frame_id", text.short_camera_name(uri).alias("name"))


@query
def x18_review_link(spark, sf):
    d = Pipeline(spark, sf).sets
    link = text.review_link(
        F.lit("http://review/flag"),
        F.concat(F.col("frame_id").cast("string"), F.lit(".jpg")),
        F.lit("color"),
        F.col("cam"),
        F.col("tags"),
    )
    return d.select("frame_id", link.alias("url"))


@query
def x19_sighting_name(spark, sf):
    d = Pipeline(spark, sf).sets
    ts, cam, tags = F.col("frame_ts"), F.col("cam"), F.col("tags")
    return d.select(
        "frame_id",
        text.sighting_name(ts, cam, tags).alias("name"),
        text.sighting_name(ts, cam, tags, F.lit("prior")).alias("prior_name"),
    )


def _phrase_rows(spark, sf):
    known = X.known_plates(spark, sf)
    reads = plates.alpr_summary(X.alpr_responses(spark, sf)).select(
        "response_id", F.posexplode("plates").alias("pos", "plate")
    )
    told = known.select("plate", "owner", "color", "make", "model", "announce")
    return plates.with_known(plates.match_plates(reads, known), told)


@query
def l3_vehicle_phrases(spark, sf):
    return plates.vehicle_phrases(_phrase_rows(spark, sf))


# -- tracking -----------------------------------------------------------------------------

def _tracking_inputs(spark, sf):
    return filters.valid(X.prepared(spark, sf)), _linked_frames(spark, sf), X.cameras(spark)


@query
def t1_track(spark, sf):
    d = tracking.track(*_tracking_inputs(spark, sf))
    return flat(d, "track_id", r6("iou"), "age", "is_new", "start_ts")


@query
def t2_departures(spark, sf):
    d = tracking.departures(*_tracking_inputs(spark, sf))
    return d.select("cam", "tag", "track_id", "start_ts", "last_ts", "age", "departed_ts")


@query
def t3_departure_alerts(spark, sf):
    d = tracking.departures(*_tracking_inputs(spark, sf)).filter("notify")
    return d.select("track_id", "departed_ts", "msg")


# -- alert rules --------------------------------------------------------------------------

@query
def p0_known_detections(spark, sf):
    d = Pipeline(spark, sf).scored.filter(~F.col("scored"))
    return d.select("frame_id", "det_no", "tag", "priority")


@query
def p1_scores(spark, sf):
    d = Pipeline(spark, sf).scored
    return d.select("frame_id", "det_no", "tag", "priority", "priority_type", "scored")


@query
def p1b_scores_all_new(spark, sf):
    """The same rules with every detection taken as new, ignored ones included."""
    d = X.prepared(spark, sf).selectExpr(
        "*", "cast(null as double) as iou", "0 as age", "false as departed",
        "cast(null as int) as prior_priority",
    )
    s = alerts.score_detections(
        d, alerts.frame_context(d), X.frame_states(spark, sf), X.dim(spark, "priorities_t")
    )
    return s.select("frame_id", "det_no", "tag", "priority", "priority_type", "scored")


@query
def p2_frame_alerts(spark, sf):
    p = Pipeline(spark, sf)
    return alerts.with_plates(p.alerts, p.told_plates).select(
        "cam", "frame_id", "mode", "message", "priority", "sound", "push"
    )


@query
def p2_departure_alerts(spark, sf):
    return Pipeline(spark, sf).departure_alerts.select(
        "cam", "frame_id", "frame_ts", "message", "priority", "sound", "push"
    )


@query
def p3_frame_sound(spark, sf):
    return alerts.frame_sound(Pipeline(spark, sf).scored, X.dim(spark, "sounds_t"))


@query
def p4_pushes(spark, sf):
    d = alerts.pushes(Pipeline(spark, sf).alerts, "http://review/flag")
    return d.select("cam", "frame_id", "priority", "sound", "url")


@query
def p5_plate_gate(spark, sf):
    return Pipeline(spark, sf).visible.filter("visible_vehicles > 0").select("frame_id", "visible_vehicles")


@query
def p6_announcements(spark, sf):
    p = Pipeline(spark, sf)
    return plates.plate_announcements(p.told_plates, p.states)


@query
def p7_species(spark, sf):
    return alerts.species_events(Pipeline(spark, sf).tracked, ["deer"])


@query
def p7_owner_arrivals(spark, sf):
    """Arrivals of one owner, at most one a year."""
    matched = plates.match_plates(X.plate_reads(spark, sf), X.known_plates(spark, sf))
    owners = X.known_plates(spark, sf).select("plate", "color", "make")
    d = plates.with_known(matched, owners, "inner").select("ts", F.col("color").alias("owner"))
    return alerts.owner_arrivals(d, "machinery", 365 * 86_400)


@query
def p8_saved(spark, sf):
    return Pipeline(spark, sf).saved.select("frame_id", "cam", "priority", joined("tags"), "min_age", "name")


@query
def c1_catalogue(spark, sf):
    """Sensors of the cameras that have detections."""
    cams = X.cameras(spark).join(X.detections(spark, sf).select("cam").distinct(), "cam")
    d = reports.sensor_catalogue(cams, X.dim(spark, "icons_t"))
    return d.select("cam", "tag", "kind", "uniq_id", "title", "topic", "icon", "payload")


@query
def c2_review_queue(spark, sf):
    flags, files = _flag_files(spark, sf)
    return review.review_queue(flags, files, X.projects(spark))


# -- whole pipelines ----------------------------------------------------------------------

def e1_count_changes(spark, sf):
    """Detections to published count changes: marks, hysteresis, tracks, counts, changes."""
    return changes.count_changes(Pipeline(spark, sf).counts).select(
        "cam", "tag", "frame_id", "frame_ts", "count"
    )


query(e1_count_changes)


@query
def e2_all_pushes(spark, sf):
    """Detections to all that is pushed: new objects with their plates, and departures."""
    p = Pipeline(spark, sf)
    new = alerts.with_plates(p.alerts, p.told_plates)
    both = [
        alerts.pushes(d).select("cam", "frame_id", "frame_ts", F.lit(kind).alias("kind"), "message", "priority", "sound")
        for d, kind in ((new, "new"), (p.departure_alerts, "departed"))
    ]
    return both[0].unionByName(both[1])


@query
def e2_hysteresis_counts(spark, sf):
    """Count changes without the age of packages: each package counts at once."""
    v = filters.valid(_kept(spark, sf)).withColumn("age", F.lit(1))
    counts = reports.tag_counts(v, X.frames(spark, sf), X.cameras(spark))
    return changes.count_changes(counts).select("cam", "tag", "frame_id", "frame_ts", "count")
