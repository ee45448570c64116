"""From tracked rows of a stream to alerts, pushes and saved frames, each written once.

Scores and texts need one frame at a time, so a micro-batch goes through the same functions as an
archive. What reaches over micro-batches is little and is handed on by the ledger: the last frame
of each camera, first scores of tracks that are still there, and where tags were first seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.functions.geometry import make_box
from sightings.operators import alerts, changes, reports
from sightings.schema import FRAME_ORDER
from sightings.sources.sinks import BatchLedger

STATES = "mode string, vehicle_detector string, person_detector string, dog_status string, vacation_mode string"
#: What a frame brings along as its text `extra`.
EXTRA = f"{STATES}, is_file boolean"

_LAST = (
    "cam string, frame_id long, frame_ts timestamp, frame_no long, priority int, "
    "tags array<string>, saved boolean"
)
_FIRST = "track_id string, prob double, frame_no long, birth_no int, prior_priority int"
_TAGS = "cam string, tag string, tag_from struct<frame_ts:timestamp,frame_no:long,det_no:int>"


def extra_text(*columns: str) -> F.Column:
    """The text that `track_stream` carries for a frame, of the columns that `EXTRA` names."""
    return F.to_json(F.struct(*columns)).alias("extra")


class AlertJob:
    """Works on micro-batches of `track_stream`; see `run`.

    Tables of the ledger: rows (as they came), alerts (kind new or departed), pushes, saved,
    frames (each with its tags and the priority it ends up with), before (for a saved frame the
    one before it), gone (tags of the frame before that are no longer there), species.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        priorities: DataFrame,
        sounds: DataFrame,
        species: tuple[str, ...] = (),
        webhook: str | None = None,
        push: Callable[[DataFrame, int], None] | None = None,
    ) -> None:
        self.spark, self.priorities, self.sounds = spark, priorities, sounds
        self.species, self.webhook, self.push = list(species), webhook, push
        self.ledger = BatchLedger(spark, path)

    def run(self, tracked: DataFrame, checkpoint: str, trigger: dict | None = None):
        """Start the stream. A batch that is tried again leaves its rows once.

        `push(rows, batch)` gets what is pushed, after all tables are written and before the batch
        is entered: a receiver that keeps the batch's number sees each push once.
        """
        out = tracked.writeStream.foreachBatch(self.ledger.once(self.batch))
        return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def batch(self, rows: DataFrame, n: int) -> None:
        led = self.ledger
        rows = led.write("rows", rows, n)
        ts = F.timestamp_micros("frame_us").alias("frame_ts")
        here = rows.filter("kind = 'frame'").withColumn("_x", F.from_json(F.coalesce("extra", F.lit("{}")), EXTRA))
        frames = here.select("frame_id", "cam", "frame_no", ts, "warm", "_x.*")
        frames = frames.withColumn("is_file", F.coalesce("is_file", F.lit(False)))
        states = frames
        box = make_box(*[F.col(c) for c in ("left", "top", "width", "height")])
        tracked = rows.filter("kind = 'det'").select(
            "frame_id", "cam", "frame_no", ts, "det_no", "tag", "prob", "iou", "age", "is_new", "track_id",
            box.alias("box"), F.lit(None).cast("string").alias("ignore"), F.lit(False).alias("departed"),
            F.lit(None).cast("int").alias("prior_priority"),
        )
        context = alerts.frame_context(tracked)
        scored = led.write("scored", alerts.score_detections(tracked, context, states, self.priorities), n)
        gate = alerts.alert_gate(tracked, frames)
        new = alerts.frame_alerts(scored, context, states, self.sounds, gate)

        first = led.kept("first", _FIRST, n).unionByName(alerts.first_scores(scored, gate).select(*_names(_FIRST)))
        tags = led.kept("tags", _TAGS, n).unionByName(alerts.tag_order(tracked))
        tags = tags.groupBy("cam", "tag").agg(F.min("tag_from").alias("tag_from"))
        gone = rows.filter("kind = 'departed'").select(
            "cam", "tag", "track_id", F.timestamp_micros("start_us").alias("start_ts"), "age", "msg", "notify",
            ts.alias("departed_ts"), F.col("frame_id").alias("departed_frame"),
        )
        leaving = alerts.departing_of(gone, first, tags)
        left = alerts.departure_alerts(leaving, states, self.priorities, self.sounds)
        columns = ["cam", "frame_id", "frame_ts", "kind", "message", "tags", "priority", "sound", "push"]
        both = new.withColumn("kind", F.lit("new")).select(*columns)
        told = led.write("alerts", both.unionByName(left.withColumn("kind", F.lit("departed")).select(*columns)), n)

        last = led.kept("last", _LAST, n)
        carried = led.write("frames", self._carried(tracked, frames, scored, context, states, last), n)
        ages = reports.min_age(tracked, frames)
        saved = led.write("saved", alerts.saved_sightings(carried.select("frame_id", "priority", "tags"), ages, frames), n)
        order = carried.join(saved.select("frame_id", F.lit(True).alias("_s")), "frame_id", "left")
        order = order.select("cam", "frame_id", *FRAME_ORDER, "priority", "tags", F.coalesce("_s", F.lit(False)).alias("saved"))
        order = led.write("order", last.select(*order.columns).unionByName(order), n)
        # The frames that were handed over serve as the ones before, and are not told again.
        mine = carried.select("frame_id")
        before = changes.frame_before(order).join(mine, "frame_id", "left_semi")
        led.write("before", before.select("cam", "frame_id", "prior_frame_id", "prior_frame_ts"), n)
        led.write("gone", changes.departed_tags(order).join(mine, "frame_id", "left_semi"), n)
        led.write("species", alerts.species_events(tracked, self.species), n)
        pushed = led.write("pushes", alerts.pushes(told, self.webhook), n)

        led.keep("last", order.groupBy("cam").agg(F.max_by(F.struct(*_names(_LAST)[1:]), F.struct(*FRAME_ORDER)).alias("l")).select("cam", "l.*"), n)
        still = gone.select("track_id")
        led.keep("first", first.join(still, "track_id", "left_anti"), n)
        led.keep("tags", tags, n)
        if self.push:
            self.push(pushed, n)

    def _carried(self, tracked, frames, scored, context, states, last) -> DataFrame:
        """Every frame of the batch with its tags and the priority it ends up with."""
        score = alerts.frame_priority(scored, context, states).withColumnRenamed("priority", "scored")
        sets = reports.object_sets(tracked, frames)
        per_frame = sets.join(score, "frame_id", "left").join(frames.select("frame_id", "warm"), "frame_id")
        per_frame = per_frame.select(
            "cam", "frame_id", *FRAME_ORDER, "tags", "new_tags",
            (F.size("new_tags") > 0).alias("has_new"), (F.size("tags") > 0).alias("has_valid"),
            F.when(F.col("warm"), F.col("scored")).alias("scored"), F.lit(True).alias("_own"),
        )
        # The last frame handed over gives its priority to the ones that follow.
        entering = last.select(
            "cam", "frame_id", *FRAME_ORDER, "tags", F.lit(True).alias("has_new"), F.lit(True).alias("has_valid"),
            F.col("priority").alias("scored"), F.lit(False).alias("_own"),
        )
        both = per_frame.unionByName(entering, allowMissingColumns=True)
        return changes.carry_priority(both).filter("_own").drop("_own")


def _names(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).names
