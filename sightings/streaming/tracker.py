"""The order-dependent part of the pipeline on a stream, one state per camera.

A stream of frames with their detections is taken through the narrow steps first (center,
road, regions, zones, threshold lookup: the same functions as in batch, on exploded rows).
One processor then carries what needs order: tag presence, tracks and their expiry, and the
published counts. All rows of a frame come from one input row, hence from one micro-batch.
Frames wait until the watermark, which follows all cameras, has passed them, and are then taken in
order of time; a timer sees to those of a camera that has gone silent. Frames that come later still
never touch the state; they leave as `late` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from sightings.functions.text import departure_text
from sightings.functions.timing import epoch_us
from sightings.operators.filters import (
    STICKY_CONFIDENCE,
    apply_region_rules,
    begin,
    classify_road,
)
from sightings.operators.tracking import NOTIFY_AGE, NOTIFY_SEEN_S, Track, lifetime, match
from sightings.operators.zones import apply_exclusions
from sightings.schema import BOX
from sightings.session import ship
from sightings.streaming.ordered import WAIT_S, InOrder, plain_schema, run_in_order, watermarked

# Fixed value: frames of a camera before it may alert.
WARM_FRAMES = 2
FRAME_STREAM = (
    "frame_id long, cam string, frame_no long, frame_ts timestamp, "
    f"detections array<struct<det_no:int,tag_id:int,tag:string,prob:double,box:{BOX}>>"
)
OUTPUT = (
    "cam string, kind string, frame_id long, frame_us long, det_no int, tag string, "
    "track_id string, iou double, age int, is_new boolean, start_us long, last_us long, "
    "left double, top double, width double, height double, count int, cam_age int, "
    "frame_no long, prob double, extra string"
)
_COLUMNS = [c.split(" ")[0] for c in OUTPUT.split(", ")]
_TEXTS = ("track_id", "tag", "extra")
_PANDAS_TYPES = {
    **{c: object for c in _TEXTS}, "is_new": "boolean",
    "det_no": "Int32", "age": "Int32", "count": "Int32", "cam_age": "Int32", "start_us": "Int64", "last_us": "Int64",
}
_TRACKS = (
    "tag string, track_id string, left double, top double, width double, height double, "
    "start_us long, last_us long, age int"
)


def explode_frames(frames: DataFrame) -> DataFrame:
    """One row per detection; a frame without any keeps one row with a null det_no.

    `extra`, a text of the frame's own such as the states of the house, stays on each row.
    """
    extra = F.col("extra") if "extra" in frames.columns else F.lit(None).cast("string")
    d = frames.select(
        "frame_id", "cam", "frame_no", "frame_ts", extra.alias("extra"), F.explode_outer("detections").alias("_d")
    )
    return d.select("frame_id", "cam", "frame_no", "frame_ts", "extra", "_d.*")


def prepare_stream(
    frames: DataFrame,
    cameras: DataFrame,
    rules: DataFrame,
    excludes: DataFrame,
    thresholds: DataFrame,
    default: float,
) -> DataFrame:
    """The narrow steps on the exploded stream, with what the processor needs to know."""
    t = thresholds.select(F.col("tag").alias("_key"), F.col("min_prob").alias("_min"))
    c = cameras.select("cam", "interval_s", F.array_join("publish", ",").alias("publish"))
    return (
        explode_frames(frames)
        .transform(begin)
        .transform(classify_road, cameras)
        .transform(apply_region_rules, rules)
        .transform(apply_exclusions, excludes)
        .join(t, F.col("raw_tag") == F.col("_key"), "left")
        .join(c, "cam", "left")
        .select(
            "cam",
            "frame_id",
            "frame_no",
            epoch_us("frame_ts").alias("now_us"),
            F.coalesce("det_no", F.lit(-1)).alias("det_no"),
            "raw_tag",
            "tag",
            F.coalesce("prob", F.lit(0.0)).alias("prob"),
            F.coalesce("_min", F.lit(default)).alias("min_prob"),
            F.col("ignore").isNotNull().alias("ignored"),
            *[
                F.coalesce(F.col("box")[b], F.lit(0.0)).alias(b)
                for b in ("left", "top", "width", "height")
            ],
            F.coalesce("interval_s", F.lit(30)).alias("interval_s"),
            F.coalesce("publish", F.lit("")).alias("publish"),
            "extra",
        )
    )


class CameraProcessor(InOrder):
    """State of one camera: tracks, tags present, counts sent, frames seen, frames that wait."""

    def __init__(self, columns: list[str], schema: str, hysteresis: bool = True, low: float = STICKY_CONFIDENCE):
        super().__init__(columns, schema, "now_us", "frame_no", ("det_no",))
        self.hysteresis, self.low = hysteresis, low

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.tracks = handle.getListState("tracks", _TRACKS)
        self.present = handle.getListState("present", "tag string")
        self.counts = handle.getMapState("counts", "tag string", "count int")
        self.seen = handle.getValueState("seen", "show int, cam_age int")

    def late(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out = [
            {
                "cam": key[0], "frame_id": int(r.frame_id), "frame_us": int(r.now_us), "frame_no": int(r.frame_no),
                "kind": "late", "det_no": int(r.det_no), "tag": r.tag,
            }
            for r in rows.itertuples()
        ]
        yield _to_frame(out)

    def take(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        cam = key[0]
        tracks = self._load_tracks()
        present = {r[0] for r in self.present.get()} if self.present.exists() else set()
        counts = {k[0]: v[0] for k, v in self.counts.iterator()}
        show, cam_age = self.seen.get() if self.seen.exists() else (-1, 0)
        out: list[dict] = []
        for (now, no), frame in rows.groupby(["now_us", "frame_no"], sort=False):
            head = frame.iloc[0]
            extra = None if pd.isna(head.extra) else head.extra
            base = {"cam": cam, "frame_id": int(head.frame_id), "frame_us": int(now), "frame_no": int(no)}
            cam_age += 1
            base["cam_age"] = cam_age
            out.append({**base, "kind": "frame", "extra": extra})
            kept = [
                r
                for r in frame.itertuples()
                if r.det_no >= 0
                and (
                    not self.hysteresis
                    or r.prob > r.min_prob
                    or (r.raw_tag in present and r.prob > self.low)
                )
            ]
            valid = [r for r in kept if not r.ignored]
            present = {r.tag for r in valid}
            ages = self._track(base, tracks, valid, int(head.interval_s), out)
            show = self._publish(base, head.publish, ages, counts, show, out)
        self._store(tracks, present, counts, (show, cam_age))
        yield _to_frame(out)

    def _load_tracks(self) -> list[Track]:
        tracks = []
        for r in self.tracks.get() if self.tracks.exists() else ():
            t = Track(tuple(r[2:6]), r[7], r[8], birth=(r[0], r[1], r[6]))
            tracks.append(t)
        return tracks

    def _track(self, base, tracks, valid, interval, out):
        now, cam = base["frame_us"], base["cam"]
        rows, ages = [], []
        for r in valid:
            box = (r.left, r.top, r.width, r.height)
            t, iou = match([x for x in tracks if x.birth[0] == r.tag], box, now)
            if t is None:
                name = f"{cam}|{r.tag}|{base['frame_id']}|{r.det_no}"
                t = Track(box, now, 0, birth=(r.tag, name, now))
                tracks.append(t)
                rows.append((r, t, None, None, None))
            else:
                rows.append((r, t, iou, t.age, box))
        for r, t, iou, age, box in rows:
            new = iou is None
            age, box = (t.age, t.box) if new else (age, box)
            ages.append((r.tag, age))
            out.append({
                **base, "kind": "det", "det_no": int(r.det_no), "tag": r.tag, "prob": r.prob,
                "track_id": t.birth[1], "iou": iou, "age": age, "is_new": new,
                "start_us": t.birth[2], "last_us": now,
                "left": box[0], "top": box[1], "width": box[2], "height": box[3],
            })
        for t in [t for t in tracks if now > t.last + lifetime(t.age, interval)]:
            tracks.remove(t)
            out.append({
                **base, "kind": "departed", "tag": t.birth[0], "track_id": t.birth[1],
                "age": t.age, "start_us": t.birth[2], "last_us": t.last,
            })
        return ages

    def _publish(self, base, publish, ages, counts, show, out):
        total = 0
        for tag in [p for p in publish.split(",") if p]:
            n = sum(1 for t, age in ages if t == tag and (tag != "package" or age > 0))
            total += n
            if counts.get(tag) != n:
                counts[tag] = n
                out.append({**base, "kind": "count", "tag": tag, "count": n})
        if total != show:
            out.append({**base, "kind": "show", "count": total})
            show = total
        return show

    def _store(self, tracks, present, counts, seen):
        def save(state, rows):
            state.put(rows) if rows else state.clear()

        save(
            self.tracks,
            [(t.birth[0], t.birth[1], *t.box, t.birth[2], t.last, t.age) for t in tracks],
        )
        save(self.present, [(t,) for t in sorted(present)])
        for tag, n in counts.items():
            self.counts.updateValue((tag,), (n,))
        self.seen.update(seen)


def _to_frame(rows: list[dict]) -> pd.DataFrame:
    d = pd.DataFrame(rows, columns=_COLUMNS).astype(_PANDAS_TYPES)
    # A text column without any text would be taken for numbers.
    return d.assign(**{c: d[c].where(d[c].notna(), None) for c in _TEXTS})


def track_stream(prepared: DataFrame, hysteresis: bool = True, wait_s: int | None = WAIT_S) -> DataFrame:
    """Frames, tracked detections, departures, count changes and late rows of a prepared stream.

    `kind` says which a row is. `cam_age` is the camera's number of frames so far, `warm` whether
    it may alert by it; a departure has its text as `msg`, and `notify` says whether it is told.
    With `wait_s` None the stream has a watermark already.
    """
    ship(prepared.sparkSession)
    processor = CameraProcessor(prepared.columns, plain_schema(prepared), hysteresis)
    out = run_in_order(watermarked(prepared, "now_us", wait_s), ["cam"], processor, OUTPUT)
    seen = (F.col("frame_us") - F.col("start_us")) / 1e6
    gone = F.col("kind") == "departed"
    return out.select(
        "*",
        (F.col("cam_age") > WARM_FRAMES).alias("warm"),
        F.when(gone, departure_text(F.col("tag"), F.col("cam"), F.col("age"), seen)).alias("msg"),
        (gone & (seen > NOTIFY_SEEN_S) & (F.col("age") > NOTIFY_AGE)).alias("notify"),
    )
