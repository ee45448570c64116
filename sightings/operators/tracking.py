"""Object tracking over an archive of detections.

Tracks of one (camera, tag) depend on order, and a busy camera may never have a gap, so the
history is cut into pieces (camera, tag, time slice) that are folded in parallel:

1. every piece is folded from an assumed start state (at first: no tracks);
2. a piece whose predecessor ends in another state than assumed is folded again from that
   state, until nothing changes. The state holds only what steers matching and expiry: box,
   last time, and age up to the point where the lifetime stops growing. Tracks that agree in
   all three behave alike for ever and count as one, so pieces forget their start quickly and
   few rounds are needed; the result is exact whatever their number;
3. identities and true ages of tracks that cross pieces are threaded through the piece
   summaries (a few rows per piece).

Python sees one sorted stream per task (`mapInArrow`), holds only the live tracks, and
collects no group. Lineage is cut by a reliable checkpoint per round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightings.functions.geometry import make_box
from sightings.functions.text import departure_text
from sightings.functions.timing import HOUR, epoch_us, time_bucket
from sightings.operators.filters import link_frames
from sightings.operators.ordered import as_of
from sightings.session import cut, settle, ship

# Overlap that links, lifetime (s) at age 0 and at most, and the rule for
# telling of a departure (seen for longer than, seen more often than).
MIN_IOU = 0.5
BASE_TTL_S = 60
MAX_TTL_S = 3600
NOTIFY_SEEN_S = 120
NOTIFY_AGE = 4

PIECE = ["cam", "tag", "piece"]
_STATE = (
    "array<struct<left:double,top:double,width:double,height:double,last_us:long,age:int>>"
)
_STATE_FIELDS = ("left", "top", "width", "height", "last_us", "age")
_NEVER = -(2**62)

# One layout for everything a fold emits; `kind` is det, done, cross or end.
#   det    a detection: its track (own birth or a slot of the start state), age, iou, box
#   done   a track that began and ended inside the piece
#   cross  what became of a track that was there at the start or lives on after the end
#   end    the end state of the piece, with the start state it was folded from; last_us is the
#          time of the frame before its first one, age the camera's interval
_FOLD = (
    "cam string, tag string, piece long, kind string, frame_id long, det_no int, "
    "birth_frame long, birth_det int, birth_us long, slot int, to_slot int, is_rep boolean, "
    "age int, iou double, is_new boolean, last_us long, "
    "left double, top double, width double, height double, "
    f"start_state {_STATE}, end_state {_STATE}"
)
_FOLD_COLS = (
    "cam tag piece kind frame_id det_no birth_frame birth_det birth_us slot to_slot is_rep "
    "age iou is_new last_us left top width height start_state end_state"
).split()


def ttl_us(age: Column, interval_s: Column) -> Column:
    """Lifetime of a track after its last sighting: a minute, plus an interval per sighting."""
    seconds = F.least(F.lit(BASE_TTL_S) + age * interval_s, F.lit(MAX_TTL_S))
    return seconds.cast("long") * 1_000_000


class Track:
    """A live track inside a fold."""

    __slots__ = ("box", "last", "age", "slot", "birth", "seen", "area")

    def __init__(self, box, last, age, slot=None, birth=None):
        self.box, self.last, self.age = box, last, age
        self.slot, self.birth, self.seen = slot, birth, 0
        self.area = box[2] * box[3]

    def overlap(self, b, area):
        a = self.box
        w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        inter = w * h if w > 0 and h > 0 else 0.0
        whole = self.area + area - inter
        return inter / whole if whole != 0 else 0.0

    def move(self, box, area, now):
        self.box, self.area, self.last = box, area, now
        self.age += 1
        self.seen += 1


def lifetime(age: int, interval_s: int) -> int:
    return min(BASE_TTL_S + age * interval_s, MAX_TTL_S) * 1_000_000


def match(tracks: list[Track], box: tuple, now: int) -> tuple[Track | None, float | None]:
    """Feed a detection to every overlapping track; the last one fed is reported."""
    x, y, width, height = box
    right, bottom, area = x + width, y + height, width * height
    last, iou = None, None
    for t in tracks:
        # `Track.overlap`, in place: this is where a fold spends its time, and most don't touch.
        left, top, w, h = t.box
        w = min(left + w, right) - max(left, x)
        if not w > 0:
            continue
        h = min(top + h, bottom) - max(top, y)
        if not h > 0:
            continue
        inter = w * h
        whole = t.area + area - inter
        o = inter / whole if whole != 0 else 0.0
        if o > MIN_IOU:
            t.move(box, area, now)
            last, iou = t, o
    return last, iou


_NO_BIRTH, _NO_BOX = (None,) * 3, (None,) * 4


class _Piece:
    """Fold of one piece; rows are appended to `out` in the order of `_FOLD_COLS`."""

    def __init__(self, key, out):
        self.key, self.out = key, out
        self.first_prev: int | None = None
        self.tracks: list[Track] = []
        self.start: list[dict] = []
        self.interval = 0
        self.newborn: list[tuple] = []
        self.frame = None

    def row(
        self, kind, frame_id=None, det_no=None, birth=_NO_BIRTH, slot=None, to_slot=None,
        is_rep=None, age=None, iou=None, is_new=None, last_us=None, box=_NO_BOX,
        start_state=None, end_state=None,
    ):
        self.out.append((
            *self.key, kind, frame_id, det_no, *birth, slot, to_slot, is_rep, age, iou, is_new,
            last_us, *box, start_state, end_state,
        ))

    def begin(self, state):
        self.start = state
        for j, s in enumerate(state):
            box = (s["left"], s["top"], s["width"], s["height"])
            self.tracks.append(Track(box, s["last_us"], s["age"], slot=j))

    def retire(self, t: Track):
        if t.slot is not None:
            self.row("cross", slot=t.slot, age=t.seen, last_us=t.last)
        else:
            self.row("done", birth=t.birth, age=t.age, last_us=t.last)

    def flush_newborn(self):
        """A newborn is reported as it stands at the end of its frame."""
        for t in self.newborn:
            f, d, _ = t.birth
            self.row("det", f, d, t.birth, age=t.age, is_new=True, box=t.box)
        self.newborn = []

    def see(self, frame_id, det_no, now, prev, interval, box):
        if self.first_prev is None:
            self.first_prev = prev
        if frame_id != self.frame:
            self.flush_newborn()
            self.frame, self.interval = frame_id, interval
            live = []
            for t in self.tracks:
                if prev > t.last + lifetime(t.age, interval):
                    self.retire(t)
                else:
                    live.append(t)
            self.tracks = live
        t, iou = match(self.tracks, box, now)
        if t is None:
            t = Track(box, now, 0, birth=(frame_id, det_no, now))
            self.tracks.append(t)
            self.newborn.append(t)
        elif t.slot is not None:
            self.row(
                "det", frame_id, det_no, slot=t.slot, age=t.seen, iou=iou, is_new=False, box=box
            )
        else:
            self.row(
                "det", frame_id, det_no, t.birth, age=t.age, iou=iou, is_new=False, box=box
            )

    def finish(self):
        self.flush_newborn()
        full = -(-(MAX_TTL_S - BASE_TTL_S) // self.interval) if self.interval > 0 else 0
        slots: dict[tuple, int] = {}
        same = [(*t.box, t.last, min(t.age, full)) for t in self.tracks]
        final = {k: i for i, k in enumerate(same)}  # a class stands where its last track does
        for k in sorted(final, key=final.get):
            slots[k] = len(slots)
        for i, (k, t) in enumerate(zip(same, self.tracks)):
            v = dict(to_slot=slots[k], is_rep=final[k] == i, last_us=t.last)
            if t.slot is not None:
                self.row("cross", slot=t.slot, age=t.seen, **v)
            else:
                self.row("cross", birth=t.birth, age=t.age, **v)
        self.row(
            "end",
            age=self.interval,
            last_us=self.first_prev,
            start_state=self.start,
            end_state=[dict(zip(_STATE_FIELDS, k)) for k in slots],
        )


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold a stream of pieces, each a header row and then its detections in order."""
    piece, out = None, []
    for batch in batches:
        pdf = batch.to_pandas()
        cols = [pdf[c].tolist() for c in (
            "cam", "tag", "piece", "now_us", "prev_us", "frame_id", "det_no", "interval_s",
            "left", "top", "width", "height", "state",
        )]
        for cam, tag, no, now, prev, frame, det, interval, x, y, w, h, state in zip(*cols):
            key = (cam, tag, no)
            if piece is None or piece.key != key:
                if piece is not None:
                    piece.finish()
                piece = _Piece(key, out)
            if state is not None:
                piece.begin([{f: s[f] for f in _STATE_FIELDS} for s in state])
            else:
                piece.see(frame, det, now, prev, interval, (x, y, w, h))
        if len(out) >= 10_000:
            yield _to_batch(out)
            out.clear()
    if piece is not None:
        piece.finish()
    if out:
        yield _to_batch(out)


_ARROW_STATE = pa.list_(
    pa.struct([(f, t) for f, t in zip(_STATE_FIELDS, [pa.float64()] * 4 + [pa.int64(), pa.int32()])])
)
_ARROW = {
    "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
}
_FOLD_TYPES = [
    _ARROW_STATE if c.endswith("_state") else _ARROW[t]
    for c, t in (f.split(" ") for f in _FOLD.replace(_STATE, "state").split(", "))
]


def _to_batch(rows):
    """Columns straight from the tuples; a number that is not one (NaN) counts as missing."""
    cols = [pa.array(c, t, from_pandas=True) for c, t in zip(zip(*rows), _FOLD_TYPES)]
    return pa.RecordBatch.from_arrays(cols, names=_FOLD_COLS)


def _run_fold(dets: DataFrame, states: DataFrame | None) -> DataFrame:
    """Fold pieces. `states`: PIECE and the state each starts from; none = no tracks."""
    rows = dets.withColumn("state", F.lit(None).cast(_STATE))
    if states is not None:
        zeros = [
            F.lit(0).cast(dets.schema[c].dataType).alias(c)
            for c in dets.columns
            if c not in PIECE and c != "rank_us"
        ]
        header = states.select(*PIECE, F.lit(_NEVER).alias("rank_us"), "state", *zeros)
        rows = rows.unionByName(header)
    return (
        rows.repartition(*PIECE)
        .sortWithinPartitions(*PIECE, "rank_us", "frame_no", "det_no")
        .mapInArrow(_fold, _FOLD)
    )


def _prepare(df: DataFrame, frames: DataFrame, cameras: DataFrame, slice_s: int) -> DataFrame:
    if "prev_frame_ts" not in df.columns:
        df = df.join(link_frames(frames).select("frame_id", "prev_frame_ts"), "frame_id", "left")
    box = F.col("box")
    return (
        df.join(cameras.select("cam", "interval_s"), "cam", "left")
        .select(
            "cam",
            "tag",
            time_bucket("frame_ts", slice_s).alias("piece"),
            epoch_us("frame_ts").alias("now_us"),
            epoch_us("frame_ts").alias("rank_us"),
            F.coalesce(epoch_us("prev_frame_ts"), F.lit(_NEVER)).alias("prev_us"),
            "frame_id",
            "frame_no",
            "det_no",
            F.coalesce("interval_s", F.lit(30)).alias("interval_s"),
            *[box[c].cast("double").alias(c) for c in ("left", "top", "width", "height")],
        )
    )


def _no_tracks() -> Column:
    return F.expr(f"cast(array() as {_STATE})")


def _expired(t: Column) -> Column:
    """Whether a track of an end state is gone before the first detection of a piece."""
    return F.col("first_prev_us") > t["last_us"] + ttl_us(t["age"], F.col("interval_s"))


def _start_states(ends: DataFrame) -> DataFrame:
    """State that enters each piece: the end of the one before, less what expired since."""
    order = Window.partitionBy("cam", "tag").orderBy("piece")
    prior = ends.withColumn("_prior", F.lag("end_state").over(order))
    kept = F.filter("_prior", lambda t: ~_expired(t))
    return prior.select(
        *PIECE,
        "first_prev_us",
        "interval_s",
        "start_state",
        "end_state",
        F.coalesce(kept, _no_tracks()).alias("state"),
    )


def _ends(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'end'").select(
        *PIECE, F.col("last_us").alias("first_prev_us"), F.col("age").alias("interval_s"),
        "start_state", "end_state",
    )


def fold_archive(
    df: DataFrame, frames: DataFrame, cameras: DataFrame, slice_s: int = 6 * HOUR
) -> tuple[DataFrame, DataFrame]:
    """Exact fold of all pieces. Returns (fold rows, piece summary).

    Written detections `with_links` are read again in each round, others are joined and written once.
    """
    ship(df.sparkSession)
    dets = _prepare(df, frames, cameras, slice_s)
    if "prev_frame_ts" not in df.columns:
        dets = cut(dets)
    versions = [cut(_run_fold(dets, None))]
    redone: list[DataFrame] = []
    ends = _ends(versions[0])
    while True:
        entering = settle(_start_states(ends))
        stale = entering.filter(F.col("state") != F.col("start_state")).select(*PIECE, "state")
        if stale.isEmpty():
            break
        again = cut(_run_fold(dets.join(stale.select(*PIECE), PIECE, "left_semi"), stale))
        redone.append(stale.select(*PIECE))
        versions.append(again)
        ends = (
            entering.select(*PIECE, "first_prev_us", "interval_s", "start_state", "end_state")
            .join(stale.select(*PIECE), PIECE, "left_anti")
            .unionByName(_ends(again))
        )
    rows = versions[-1]
    for i in range(len(versions) - 1):
        later = redone[i]
        for r in redone[i + 1 :]:
            later = later.unionByName(r)
        rows = rows.unionByName(versions[i].join(later.distinct(), PIECE, "left_anti"))
    return rows, entering


_CROSSED = (
    "cam string, tag string, piece long, kind string, slot int, birth_frame long, "
    "birth_det int, birth_us long, age int, last_us long, rep_frame long, rep_det int, rep_age int"
)


def _thread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Thread identities of crossing tracks through the pieces of each (cam, tag).

    Emits `slot` rows (which track a slot of a start state reports as, and its age so far),
    `gone` rows (a track with its last time and final age) and `merged` rows: a track that
    behaves like another from a piece's end on, with both ages then. Only the other is held, so
    memory has one track per slot.
    """
    names = [c.split(" ")[0] for c in _CROSSED.split(", ")]
    key, piece, out = None, None, []
    held: dict[int, tuple] = {}  # slot -> the track it reports as: (f, d, us, age)
    after: dict[int, list] = {}  # end slot -> [tracks, reported track]
    when: dict[int, int] = {}  # end slot -> last time

    def close_piece():
        nonlocal held, after
        for members, rep in after.values():
            for m in members:
                if m[:2] != rep[:2]:
                    out.append((*key, piece, "merged", None, *m, None, rep[0], rep[1], rep[3]))
        held, after = {s: rep for s, (_, rep) in after.items()}, {}

    def lose(slots):
        for s in slots:
            out.append((*key, piece, "gone", None, *held[s], when[s], None, None, None))

    for pdf in batches:
        for r in pdf.itertuples(index=False):
            k = (r.cam, r.tag)
            if key is not None and k != key:
                close_piece()
                lose(list(held))
                held, when = {}, {}
            if k != key:
                key, piece = k, None
            if r.piece != piece:
                if piece is not None:
                    close_piece()
                piece = r.piece
            if r.kind == "keep":
                kept = list(r.kept)
                lose([s for s in held if s not in set(kept)])
                held = {j: held[s] for j, s in enumerate(kept)}
                for j, rep in held.items():
                    out.append((*key, piece, "slot", j, *rep, None, None, None, None))
                when = {}
                continue
            slot = None if pd.isna(r.slot) else int(r.slot)
            if slot is None:
                track = (int(r.birth_frame), int(r.birth_det), int(r.birth_us), int(r.age))
            else:
                track = (*held[slot][:3], held[slot][3] + int(r.age))
            if pd.isna(r.to_slot):
                out.append((*key, piece, "gone", None, *track, int(r.last_us), None, None, None))
                continue
            entry = after.setdefault(int(r.to_slot), [[], None])
            entry[0].append(track)
            if r.is_rep:
                entry[1] = track
            when[int(r.to_slot)] = int(r.last_us)
        if len(out) >= 10_000:
            yield _crossed_frame(out, names)
            out = []
    if key is not None:
        close_piece()
        lose(list(held))
    if out:
        yield _crossed_frame(out, names)


def _crossed_frame(rows, names):
    df = pd.DataFrame(rows, columns=names)
    for c in ("slot", "birth_frame", "birth_det", "birth_us", "age", "last_us", "rep_frame",
              "rep_det", "rep_age"):
        df[c] = df[c].astype("Int64")
    return df


def _ended(crossed: DataFrame) -> DataFrame:
    """Last time and final age of all tracks that crossed pieces.

    A merged track ends with the one that it joined, and gains what that one gained since; that
    one may have joined another in turn, so ends are handed on until all have one.
    """
    cols = ["cam", "tag", "birth_frame", "birth_det", "birth_us", "age", "last_us"]
    ended = crossed.filter("kind = 'gone'").select(*cols)
    pending = crossed.filter("kind = 'merged'").drop("last_us", "kind", "slot", "piece")
    found = ended
    while not pending.isEmpty():
        r = found.select(
            "cam", "tag", F.col("birth_frame").alias("rep_frame"), F.col("birth_det").alias("rep_det"),
            F.col("age").alias("_final"), "last_us",
        )
        met = pending.join(r, ["cam", "tag", "rep_frame", "rep_det"], "left")
        met = settle(met.withColumn("age", F.coalesce(F.col("age") + F.col("_final") - F.col("rep_age"), "age")))
        found = met.filter("_final is not null").select(*cols)
        ended = ended.unionByName(found)
        pending = met.filter("_final is null").drop("_final", "last_us")
    return ended


def _crossings(rows: DataFrame, entering: DataFrame) -> DataFrame:
    order = Window.partitionBy("cam", "tag").orderBy("piece")
    prior = entering.withColumn("_prior", F.lag("end_state").over(order))
    slots = F.transform(
        F.coalesce("_prior", _no_tracks()),
        lambda t, i: F.struct(i.alias("i"), _expired(t).alias("gone")),
    )
    keep = prior.select(
        *PIECE,
        F.lit("keep").alias("kind"),
        F.transform(F.filter(slots, lambda s: ~s["gone"]), lambda s: s["i"]).alias("kept"),
    )
    moves = rows.filter("kind = 'cross'").select(
        *PIECE, "kind", "slot", "to_slot", "is_rep", "birth_frame", "birth_det", "birth_us",
        "age", "last_us",
    )
    both = moves.unionByName(keep, allowMissingColumns=True)
    return (
        both.repartition("cam", "tag")
        .sortWithinPartitions("cam", "tag", "piece", F.desc("kind"))
        .mapInPandas(_thread, _CROSSED)
    )


def track_id(frame: Column, det: Column) -> Column:
    return F.concat_ws("|", F.col("cam"), F.col("tag"), frame, det)


def track_all(
    df: DataFrame, frames: DataFrame, cameras: DataFrame, slice_s: int = 6 * HOUR
) -> tuple[DataFrame, DataFrame]:
    """Track valid detections: (tracked detections, departures).

    tracked: the detections with track_id, iou, age, is_new, start_ts, last_ts; the box of a
    new track is the one it holds at the end of its frame.
    departures: one row per track, see `departures`.
    """
    tracked, gone = track_then(df, frames, cameras, slice_s)
    return tracked, gone()


def track_then(
    df: DataFrame, frames: DataFrame, cameras: DataFrame, slice_s: int = 6 * HOUR
) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The same with a function that gives the departures: they take jobs, which only their readers need."""
    df = cut(df)  # read by the fold and again by the join with its result
    rows, entering = fold_archive(df, frames, cameras, slice_s)
    crossed = cut(_crossings(rows, entering))
    slots = crossed.filter("kind = 'slot'").select(
        *PIECE,
        "slot",
        F.col("birth_frame").alias("_f"),
        F.col("birth_det").alias("_d"),
        F.col("birth_us").alias("_us"),
        F.col("age").alias("_age"),
    )
    det = rows.filter("kind = 'det'")
    box = make_box(*[F.col(c) for c in ("left", "top", "width", "height")])
    local = det.filter("slot is null").select(
        "frame_id", "det_no", "iou", "age", "is_new", box.alias("box"),
        track_id(F.col("birth_frame"), F.col("birth_det")).alias("track_id"),
        F.col("birth_us").alias("start_us"),
    )
    carried = (
        det.filter("slot is not null")
        .drop("birth_frame", "birth_det", "birth_us")
        .join(slots, [*PIECE, "slot"])
        .select(
            "frame_id", "det_no", "iou", (F.col("age") + F.col("_age")).alias("age"), "is_new",
            box.alias("box"), track_id(F.col("_f"), F.col("_d")).alias("track_id"),
            F.col("_us").alias("start_us"),
        )
    )
    stamp = df.schema["frame_ts"].dataType
    found = local.unionByName(carried)
    tracked = (
        df.drop("box")
        .join(found, ["frame_id", "det_no"])
        .withColumn("start_ts", F.timestamp_micros("start_us").cast(stamp))
        .withColumn("last_ts", F.col("frame_ts"))
        .drop("start_us")
    )

    def gone() -> DataFrame:
        done = rows.filter("kind = 'done'").select(
            "cam", "tag", "birth_frame", "birth_det", "birth_us", "age", "last_us"
        )
        return _departures(done.unionByName(_ended(crossed)), frames, cameras)

    return tracked, gone


def _departures(tracks: DataFrame, frames: DataFrame, cameras: DataFrame) -> DataFrame:
    stamp = frames.schema["frame_ts"].dataType
    interval = cameras.select("cam", "interval_s")
    t = tracks.join(interval, "cam", "left").withColumn(
        "deadline",
        F.timestamp_micros(
            F.col("last_us") + ttl_us(F.col("age"), F.coalesce("interval_s", F.lit(30)))
        ).cast(stamp),
    )
    t = t.select(
        "cam",
        "tag",
        track_id(F.col("birth_frame"), F.col("birth_det")).alias("track_id"),
        F.timestamp_micros("birth_us").cast(stamp).alias("start_ts"),
        F.timestamp_micros("last_us").cast(stamp).alias("last_ts"),
        "age",
        "deadline",
    )
    ends = frames.select(
        "cam", "frame_ts", "frame_no", F.col("frame_ts").alias("departed_ts"),
        F.col("frame_id").alias("departed_frame"),
    )
    found = ["departed_ts", "departed_frame"]
    t = as_of(t, ends, ["cam"], "deadline", found, "frame_ts", forward=True, tie=["frame_no"])
    seen = (epoch_us("departed_ts") - epoch_us("start_ts")) / 1e6
    notify = (seen > NOTIFY_SEEN_S) & (F.col("age") > NOTIFY_AGE)
    return t.select(
        "cam",
        "tag",
        "track_id",
        "start_ts",
        "last_ts",
        "age",
        "departed_ts",
        "departed_frame",
        F.coalesce(notify, F.lit(False)).alias("notify"),
        F.when(
            F.col("departed_ts").isNotNull(),
            departure_text(F.col("tag"), F.col("cam"), F.col("age"), seen),
        ).alias("msg"),
    )


def track(df, frames, cameras, slice_s: int = 6 * HOUR) -> DataFrame:
    """Tracked detections; see `track_all`."""
    return track_then(df, frames, cameras, slice_s)[0]


def departures(df, frames, cameras, slice_s: int = 6 * HOUR) -> DataFrame:
    """One row per track: when it began, was last seen and departed (null: still there).

    A track departs at the camera's first frame past its lifetime. `notify` marks those seen
    for over two minutes and more than four times after the first.
    """
    return track_all(df, frames, cameras, slice_s)[1]
