"""Alert rules: priorities of detections and frames, sounds, pushes and saved sightings.

Everything here is grouped by frame, so groups are as small as one frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightings.functions.text import location_message, review_link, sighting_name
from sightings.functions.timing import is_small_hours
from sightings.operators.changes import NO_PRIORITY, SILENT_PRIORITY, throttle
from sightings.operators.reports import NO_AGE
from sightings.session import cut

# The camera-specific rules. A fixed score of a tag at a camera, with the place
# in the chain of rules; 1 = before the person and vehicle switches (all of these are).
CAMERA_SCORES = [
    ("front entry", "vehicle", -3, "vehicle rule"),
    ("garage", "cat", -2, "cat in garage rule"),
    ("garage", "person", -3, "person in garage rule"),
]
# Cameras that never alert for vehicles; the camera raised at night; the camera
# and confidence of the loose-dog rule; camera and tags of the predator rule.
NO_VEHICLE_CAMERAS = ["mailbox"]
NIGHT_CAMERA, NIGHT_TYPE = "peach tree", "fruit robber"
DOG_CAMERA, DOG_CONFIDENCE, DOG_TYPE = "garage", 0.9, "dog in garage rule"
PREDATOR_CAMERA, PREDATORS = "deck", ["fox", "coyote"]
DEFAULT_SOUND = "pushover"
VISIBLE_AGE = 3


def frame_context(df: DataFrame) -> DataFrame:
    """What a frame holds, as the rules ask for it.

    df: detections with tag, ignore, departed, age.
    """
    tag, kept = F.col("tag"), F.col("ignore").isNull()
    there = ~F.coalesce(F.col("departed"), F.lit(False))
    vehicle = (tag == "vehicle") & kept
    some = lambda c: F.max(F.coalesce(c, F.lit(False)))
    return df.groupBy("frame_id").agg(
        some((tag == "person") & kept).alias("has_person"),
        some(tag == "dog").alias("has_dog"),
        some(tag == "person_road").alias("has_person_road"),
        some(tag == "dog_road").alias("has_dog_road"),
        some((tag == "package") & there).alias("has_package"),
        some(vehicle).alias("has_vehicle"),
        F.count_if(vehicle & there & (F.col("age") < VISIBLE_AGE)).alias("visible_vehicles"),
    )


def _priority_maps(priorities: DataFrame) -> DataFrame:
    """Priorities per tag: the base one, and one per mode. Config, one row per tag."""
    modes = F.col("mode")
    pick = lambda m: F.max(F.when(modes == m, F.col("priority")))
    return priorities.groupBy(F.col("tag").alias("_ptag")).agg(
        F.max(F.when(modes.isNull(), F.col("priority"))).alias("_base"),
        pick("night").alias("_night"),
        pick("home").alias("_home"),
        pick("away").alias("_away"),
    )


def score_detections(
    tracked: DataFrame,
    context: DataFrame,
    states: DataFrame,
    priorities: DataFrame,
    camera_scores: list[tuple] = CAMERA_SCORES,
) -> DataFrame:
    """Priority and its reason per detection; the first rule that applies wins.

    tracked: detections with iou (null = new), ignore, departed, prior_priority (what a
    departing track already carries; null = none). states: one row per frame with mode,
    vehicle_detector, person_detector, dog_status. Adds priority, priority_type, scored.
    """
    want = ["frame_id", "mode", "vehicle_detector", "person_detector", "dog_status"]
    d = tracked.join(context, "frame_id").join(states.select(*want), "frame_id", "left")
    d = d.join(_priority_maps(priorities), F.col("tag") == F.col("_ptag"), "left")
    tag, cam, mode = F.col("tag"), F.col("cam"), F.col("mode")
    known = F.col("iou").isNotNull() | F.col("ignore").isNotNull()
    prior = F.when(known, F.lit(NO_PRIORITY)).otherwise(F.col("prior_priority"))
    d = d.withColumn("_prior", prior).withColumn("scored", prior.isNull())

    night_watch = F.coalesce(mode == "night", F.lit(False)) & is_small_hours("frame_ts")
    # A scored person on the road sets the person switch for the rest of the frame's list.
    so_far = (
        Window.partitionBy("frame_id")
        .orderBy("det_no")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    setting = F.when(F.col("scored") & (tag == "person_road"), night_watch)
    d = d.withColumn("_set", F.last(setting, ignorenulls=True).over(so_far))
    switch = F.col("has_person") & F.coalesce(F.col("person_detector") == "on", F.lit(False))
    person_on = F.coalesce(F.col("_set"), switch)
    vehicle_on = (
        F.col("has_vehicle")
        & ~cam.isin(*NO_VEHICLE_CAMERAS)
        & F.coalesce(F.col("vehicle_detector") == "on", F.lit(False))
    )
    by_mode = (
        F.when(mode == "night", F.col("_night"))
        .when(mode == "home", F.col("_home"))
        .when(mode == "away", F.col("_away"))
    )

    rules: list[tuple[Column, Column, Column]] = [
        (
            tag == "person_road",
            F.when(night_watch, F.lit(0)).otherwise(F.lit(NO_PRIORITY)),
            F.lit(None).cast("string"),
        ),
        (
            tag == "dog_road",
            F.when(F.col("has_person_road"), F.lit(-3)).otherwise(F.lit(1)),
            F.when(F.col("has_person_road"), "person walking dog").otherwise(
                "dog without person"
            ),
        ),
    ]
    rules += [
        ((cam == c) & (tag == t), F.lit(p), F.lit(why)) for c, t, p, why in camera_scores
    ]
    rules += [
        (
            (tag == "person") & F.col("has_person") & ~person_on,
            F.lit(-4),
            F.lit("person detection off"),
        ),
        (
            (tag == "deer") & F.col("has_person"),
            F.lit(-1),
            F.lit("deer and person not possible"),
        ),
        ((tag == "vehicle") & ~vehicle_on, F.lit(-4), F.lit("vehicle detection off")),
        (by_mode.isNotNull(), by_mode, F.concat(F.lit("priority-"), mode)),
        (F.col("_base").isNotNull(), F.col("_base"), F.concat(F.lit("class "), tag)),
        (F.lit(True), F.lit(0), F.lit("default")),
    ]
    # Overrides see the result of the chain, one after the other.
    p, why = F.col("_p"), F.col("_t")
    inside = F.coalesce(F.col("dog_status") == "inside", F.lit(False))
    overrides = [
        (
            (cam == NIGHT_CAMERA) & F.coalesce(mode == "night", F.lit(False)) & (p < 1),
            F.lit(NIGHT_TYPE),
        ),
        (
            (tag == "dog")
            & (cam == DOG_CAMERA)
            & (F.col("prob") > DOG_CONFIDENCE)
            & ~F.col("has_person")
            & inside,
            F.lit(DOG_TYPE),
        ),
        (
            tag.isin(*PREDATORS) & (cam == PREDATOR_CAMERA) & (p < 1),
            F.concat(tag, F.lit(" on "), cam),
        ),
    ]
    chosen = F.coalesce(
        *[
            F.when(cond, F.struct(i.cast("int").alias("p"), t.cast("string").alias("t")))
            for cond, i, t in rules
        ]
    )
    d = d.withColumn("_rule", chosen)
    d = d.withColumn("_p", F.col("_rule")["p"]).withColumn("_t", F.col("_rule")["t"])
    for cond, t in overrides:
        d = d.withColumn("_hit", cond)
        d = d.withColumn("_t", F.when(F.col("_hit"), t).otherwise(why))
        d = d.withColumn("_p", F.when(F.col("_hit"), F.lit(1)).otherwise(p))
    return d.select(
        *tracked.columns,
        F.when(F.col("scored"), p).otherwise(F.col("_prior")).cast("int").alias("priority"),
        F.when(F.col("scored"), why).alias("priority_type"),
        "scored",
    )


def frame_priority(scored: DataFrame, context: DataFrame, states: DataFrame) -> DataFrame:
    """Priority of each frame with detections.

    The highest new score; exactly 1 with a package and a dog while the dog should be
    inside; with nothing scored, that of the last detection; else 0.
    """
    fresh = F.max(F.when(F.col("scored"), F.col("priority")))
    fallback = F.max_by(
        "priority", F.when(F.col("priority").isNotNull(), F.col("det_no"))
    )
    d = (
        scored.groupBy("frame_id")
        .agg(fresh.alias("_fresh"), fallback.alias("_fallback"))
        .join(context.select("frame_id", "has_package", "has_dog"), "frame_id")
        .join(states.select("frame_id", "dog_status"), "frame_id", "left")
    )
    guard = (
        F.col("has_package")
        & F.col("has_dog")
        & F.coalesce(F.col("dog_status") == "inside", F.lit(False))
    )
    return d.select(
        "frame_id",
        F.when(guard, F.lit(1))
        .otherwise(F.coalesce("_fresh", "_fallback", F.lit(0)))
        .cast("int")
        .alias("priority"),
    )


def frame_sound(scored: DataFrame, sounds: DataFrame) -> DataFrame:
    """Sound of a frame: that of the last scored detection that has one.

    sounds: tag and sound; the entry `departed` stands for any tag that is leaving.
    """
    named = sounds.select(F.col("tag").alias("_stag"), F.col("sound").alias("_sound"))
    leaving = F.coalesce(F.col("departed"), F.lit(False))
    key = F.when(leaving, F.lit("departed")).otherwise(F.col("tag"))
    d = scored.join(named, key == F.col("_stag"), "left")
    sound = F.when(F.col("scored"), F.col("_sound"))
    last = F.max_by(sound, F.when(sound.isNotNull(), F.col("det_no")))
    return d.groupBy("frame_id").agg(
        F.coalesce(last, F.lit(DEFAULT_SOUND)).alias("sound")
    )


def alert_gate(tracked: DataFrame, warm: DataFrame) -> DataFrame:
    """frame_id of the frames that alert: with a new object, and past the camera's warm-up.

    warm: frame_id and warm (`warmed_up`, which lets all pass with `once`).
    """
    new = tracked.filter("is_new").select("frame_id").distinct()
    return new.join(warm.filter("warm").select("frame_id"), "frame_id", "left_semi")


def first_scores(scored: DataFrame, gate: DataFrame) -> DataFrame:
    """What each track was scored at its first sighting: prior_priority, null if that didn't alert."""
    first = scored.filter("is_new").join(
        gate.select("frame_id", F.lit(True).alias("_told")), "frame_id", "left"
    )
    return first.select(
        "track_id", "prob", "frame_no", F.col("det_no").alias("birth_no"),
        F.when(F.col("_told"), F.col("priority")).alias("prior_priority"),
    )


def tag_order(tracked: DataFrame) -> DataFrame:
    """cam, tag, tag_from: where a camera first saw a tag."""
    return tracked.groupBy("cam", "tag").agg(F.min(F.struct("frame_ts", "frame_no", "det_no")).alias("tag_from"))


def departing(
    departures: DataFrame, tracked: DataFrame, scored: DataFrame, gate: DataFrame
) -> DataFrame:
    """Departures worth telling, as detections of the frame in which they are noticed.

    A track's priority is what its first sighting was scored, if that frame alerted; a track
    first seen during warm-up has none and is scored now. Of one frame, tracks come in the order
    in which their tag was first seen by the camera, then by birth.
    """
    return departing_of(departures, first_scores(scored, gate), tag_order(tracked))


def departing_of(departures: DataFrame, first: DataFrame, tags: DataFrame) -> DataFrame:
    """The same from the tables `first_scores` and `tag_order`."""
    d = departures.filter(F.col("notify") & F.col("departed_frame").isNotNull())
    d = d.join(first, "track_id").join(tags, ["cam", "tag"])
    line = Window.partitionBy("departed_frame").orderBy("tag_from", "start_ts", "frame_no", "birth_no")
    return d.select(
        F.col("departed_frame").alias("frame_id"),
        "cam",
        F.col("departed_ts").alias("frame_ts"),
        (F.row_number().over(line) - 1).cast("int").alias("det_no"),
        "tag",
        "prob",
        "age",
        "track_id",
        "msg",
        F.lit(None).cast("double").alias("iou"),
        F.lit(None).cast("string").alias("ignore"),
        F.lit(True).alias("departed"),
        "prior_priority",
    )


def departure_alerts(
    leaving: DataFrame, states: DataFrame, priorities: DataFrame, sounds: DataFrame
) -> DataFrame:
    """One row per frame that tells of departures (`departing`): texts, priority, sound, push.

    Not subject to warm-up. With nothing to score, the priority is that of the last track.
    """
    context = frame_context(leaving)
    scored = score_detections(leaving, context, states, priorities)
    told = F.array_sort(F.collect_list(F.struct("det_no", "msg", "tag")))
    rows = leaving.groupBy("frame_id", "cam", "frame_ts").agg(told.alias("_told"))
    quiet = F.coalesce(F.col("vacation_mode") == "off", F.lit(False))
    return (
        rows.join(frame_priority(scored, context, states), "frame_id")
        .join(frame_sound(scored, sounds), "frame_id")
        .join(states.select("frame_id", "vacation_mode"), "frame_id", "left")
        .select(
            "cam", "frame_id", "frame_ts",
            F.array_join(F.transform("_told", lambda x: x["msg"]), ", ").alias("message"),
            F.array_sort(F.array_distinct(F.transform("_told", lambda x: x["tag"]))).alias("tags"),
            "priority", "sound",
            ((F.col("priority") >= SILENT_PRIORITY) & quiet).alias("push"),
        )
    )


def frame_alerts(
    scored: DataFrame, context: DataFrame, states: DataFrame, sounds: DataFrame, gate: DataFrame
) -> DataFrame:
    """One row per frame that alerts (`alert_gate`): message, tags, priority, sound, push."""
    told = scored.join(gate.select("frame_id"), "frame_id", "left_semi")
    tags = told.groupBy("frame_id", "cam", "frame_no", "frame_ts").agg(
        F.collect_set("tag").alias("_tags")
    )
    quiet = F.coalesce(F.col("vacation_mode") == "off", F.lit(False))
    return (
        tags.join(frame_priority(scored, context, states), "frame_id")
        .join(frame_sound(scored, sounds), "frame_id")
        .join(states.select("frame_id", "mode", "vacation_mode"), "frame_id", "left")
        .select(
            "cam",
            "frame_id",
            "frame_no",
            "frame_ts",
            "mode",
            location_message("_tags", "cam").alias("message"),
            F.array_sort("_tags").alias("tags"),
            "priority",
            "sound",
            ((F.col("priority") >= SILENT_PRIORITY) & quiet).alias("push"),
        )
    )


def with_plates(alerts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Alerts with a line per plate of the frame, in order, after the message.

    phrases: frame_id, pos, plate, phrase (`plates.told_plates`), spoken or not.
    """
    item = F.struct("pos", "phrase", "plate")
    lines = phrases.groupBy("frame_id").agg(F.array_sort(F.collect_list(item)).alias("_lines"))
    text = F.array_join(
        F.transform("_lines", lambda x: F.concat(F.lit("\n"), x["phrase"], F.lit(" "), x["plate"])), ""
    )
    d = alerts.join(lines, "frame_id", "left")
    return d.withColumn("message", F.concat("message", F.coalesce(text, F.lit("")))).drop("_lines")


def pushes(alerts: DataFrame, webhook: str | None = None, model: str = "color") -> DataFrame:
    """Alerts that are pushed, each with its link for a review where a webhook is set."""
    d = alerts.filter("push")
    if webhook is None:
        return d
    file = F.concat(F.col("frame_id").cast("string"), F.lit(".jpg"))
    return d.withColumn("url", review_link(F.lit(webhook), file, F.lit(model), F.col("cam"), F.col("tags")))


def species_events(tracked: DataFrame, tags: list[str]) -> DataFrame:
    """One event per frame in which a watched tag appears anew."""
    return (
        tracked.filter(F.col("is_new") & F.col("tag").isin(*tags))
        .select("cam", "frame_id", "frame_ts", "tag")
        .distinct()
    )


def owner_arrivals(matches: DataFrame, owner: str, period_s: int = 86_400) -> DataFrame:
    """Arrivals of a known owner's vehicle, at most one event per period.

    matches: ts and owner of matched plates. Arrivals are written, as they are read twice and the matches
    took much work.
    """
    hits = matches.filter(F.lower("owner") == owner).select(F.lower("owner").alias("owner"), "ts")
    return throttle(cut(hits.distinct()), ["owner"], "ts", period_s)


def saved_sightings(alerts: DataFrame, ages: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames worth keeping: loud enough, not read from a file, with something recent.

    alerts: frame_id, priority, tags; ages: frame_id, min_age; frames: is_file.
    """
    return (
        frames.select("frame_id", "cam", "frame_ts", "is_file")
        .join(alerts.select("frame_id", "priority", "tags"), "frame_id")
        .join(ages.select("frame_id", "min_age"), "frame_id", "left")
        .filter(
            (F.col("priority") > SILENT_PRIORITY)
            & ~F.col("is_file")
            & (F.coalesce(F.col("min_age"), F.lit(NO_AGE)) < 2)
        )
        .withColumn("name", sighting_name(F.col("frame_ts"), F.col("cam"), F.col("tags")))
        .drop("is_file")
    )


def latest_by_tag(alerts: DataFrame) -> DataFrame:
    """Latest alerted frame of each tag."""
    place = F.struct("frame_ts", "frame_id")
    return alerts.groupBy("tag").agg(
        F.max_by("frame_id", place).alias("frame_id"), F.max("frame_ts").alias("frame_ts")
    )
