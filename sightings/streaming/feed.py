"""Small stateful operators on streams: repeated frames, changed counts, throttled events, reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from sightings.functions.timing import epoch_us
from sightings.operators.reports import cycle_report
from sightings.session import ship
from sightings.streaming.ordered import NEVER, WAIT_S, InOrder, plain_schema, run_in_order, watermarked


class _Changed(InOrder):
    """Passes a row on when its value differs from the key's last one, in order of time.

    A row that comes after later ones were through leaves at once, marked `late`; so does one
    that repeats the time and number of another.
    """

    def __init__(self, value: str, value_type: str, columns: list[str], schema: str) -> None:
        super().__init__(columns, schema, "frame_ts", "frame_no")
        self.value, self.value_type = value, value_type

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"value {self.value_type}")

    def late(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield rows.assign(late=True)

    def take(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        value = self.last.get()[0] if self.last.exists() else None
        at, keep, again = NEVER, [], []
        for v, us, no in zip(rows[self.value], rows["frame_ts"].tolist(), rows["frame_no"].tolist()):
            v = None if pd.isna(v) else v
            fresh = (us, no) > at
            keep.append(fresh and (v is None or v != value))
            again.append(not fresh)
            if fresh:
                value, at = v, (us, no)
        self.last.update((value,))
        yield rows[np.array(keep, bool)].assign(late=False)
        if any(again):
            yield rows[np.array(again, bool)].assign(late=True)


def _in_microseconds(df: DataFrame) -> tuple[DataFrame, dict]:
    """Times as numbers, as they are inside the state, and what they were."""
    kinds = {f.name: f.dataType for f in df.schema if f.dataType.typeName().startswith("timestamp")}
    return df.withColumns({c: epoch_us(c) for c in kinds}), kinds


def _in_time(df: DataFrame, kinds: dict) -> DataFrame:
    return df.withColumns({c: F.timestamp_micros(c).cast(k) for c, k in kinds.items()})


def _only_changes(df: DataFrame, keys: list[str], value: str, value_type: str, wait_s: int | None) -> DataFrame:
    ship(df.sparkSession)
    d, kinds = _in_microseconds(df)
    schema = plain_schema(d)
    d = watermarked(d, "frame_ts", wait_s)
    out = run_in_order(d, keys, _Changed(value, value_type, df.columns, schema), schema + ", late boolean")
    return _in_time(out, kinds)


def drop_repeat_frames_stream(frames: DataFrame, wait_s: int | None = WAIT_S) -> DataFrame:
    """Frames whose hash differs from that of the camera's frame before; late ones are marked.

    A frame without a hash is no repeat.
    """
    return _only_changes(frames, ["cam"], "hash", "string", wait_s)


def count_changes_stream(counts: DataFrame, wait_s: int | None = WAIT_S) -> DataFrame:
    """Counts that differ from the last one sent for the camera and tag; late ones are marked."""
    return _only_changes(counts, ["cam", "tag"], "count", "long", wait_s)


class _Throttled(InOrder):
    """Passes an event on if the key's last one that did is more than a period before it.

    The state of a key goes when the watermark has passed that period. From then on, an event that
    is a period behind the watermark can't be told from one that was passed on, and is late.
    """

    def __init__(self, columns: list[str], schema: str, ts: str, ties: tuple[str, ...], period_us: int) -> None:
        super().__init__(columns, schema, ts, ts, ties)
        self.period = period_us

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.fired = handle.getValueState("fired", "us long")

    def is_late(self, rows: pd.DataFrame, watermark_ms: int) -> np.ndarray:
        if self.place.exists():
            return (rows[self.us] < self.place.get()[0]).to_numpy(bool)
        return (rows[self.us] <= watermark_ms * 1000 - self.period).to_numpy(bool)

    def late(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield rows.assign(late=True)

    def take(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fired = self.fired.get()[0] if self.fired.exists() else None
        keep = []
        for us in rows[self.us].tolist():
            keep.append(fired is None or us - fired > self.period)
            fired = us if keep[-1] else fired
        self.fired.update((fired,))
        self.handle.registerTimer((fired + self.period) // 1000 + 1)
        yield rows[np.array(keep, bool)].assign(late=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(key, None, timerValues)
        over = self.fired.exists() and self.fired.get()[0] + self.period < timerValues.getCurrentWatermarkInMs() * 1000
        if over and not self.pending.exists():
            self.fired.clear()
            self.place.clear()


def throttle_stream(
    df: DataFrame, keys: list[str], ts: str = "ts", period_s: int = 86_400, tie: str | None = None,
    wait_s: int | None = WAIT_S,
) -> DataFrame:
    """Events that fire when each may only follow the last fired one by more than a period.

    The same as `changes.throttle`, with `late` for events that came too late to be judged.
    """
    ship(df.sparkSession)
    d, kinds = _in_microseconds(df)
    schema = plain_schema(d)
    ties = (tie,) if tie else tuple(c for c in df.columns if c != ts)
    processor = _Throttled(d.columns, schema, ts, ties, period_s * 1_000_000)
    out = run_in_order(watermarked(d, ts, wait_s), keys, processor, schema + ", late boolean")
    return _in_time(out, kinds)


def owner_arrivals_stream(
    matches: DataFrame, owner: str, period_s: int = 86_400, wait_s: int | None = WAIT_S
) -> DataFrame:
    """Arrivals of a known owner's vehicle on a stream of matched plates, one event a period at most."""
    hits = matches.filter(F.lower("owner") == owner).select(F.lower("owner").alias("owner"), "ts")
    return throttle_stream(hits, ["owner"], "ts", period_s, wait_s=wait_s)


def cycle_report_stream(df: DataFrame, window: str = "30 seconds", wait_s: int = WAIT_S) -> DataFrame:
    """Reports of cycles that the watermark has closed; see `cycle_report`.

    Frames of closed cycles are left out; `left_out` counts them.
    """
    return cycle_report(df.withWatermark("frame_ts", f"{wait_s} seconds"), window)


def left_out(query) -> int:
    """Rows that a running or ended query has dropped for being behind the watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def drop_old(frames: DataFrame, max_age: str = "5 minutes", arrival: str | None = None) -> DataFrame:
    """Drop frames that were already too old when they arrived.

    `arrival` names the column with the time of arrival; without it the time of the
    micro-batch counts.
    """
    now = F.col(arrival) if arrival else F.current_timestamp()
    return frames.filter(F.col("frame_ts") >= now - F.expr(f"interval {max_age}"))
