"""Household states at frame time, on a stream of frames and one of states."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from sightings.functions.timing import epoch_us
from sightings.session import ship
from sightings.streaming.ordered import WAIT_S, InOrder, plain_schema, run_in_order, watermarked

_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: A frame comes after the states of its time.
_STATE, _FRAME = 0, 1


class _AsOf(InOrder):
    """The last state of each entity, and frames that wait for the states of their time.

    A state that comes late still holds for the frames after it, unless its entity has a later
    one; a late frame leaves at once with the states of the moment, marked.
    """

    def __init__(self, columns: list[str], schema: str, entities: Sequence[str]) -> None:
        super().__init__(columns, schema, "us", "side", ("tie",))
        self.entities = list(entities)
        self.watermark = 0

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "entity string", "us long, tie string, state string")

    def is_late(self, rows: pd.DataFrame, watermark_ms: int) -> np.ndarray:
        self.watermark = watermark_ms
        # Several frames share a time; only what lies before the last one taken is late.
        at = self.place.get()[0] if self.place.exists() else None
        return np.zeros(len(rows), bool) if at is None else (rows["us"] < at).to_numpy(bool)

    def _learn(self, values: dict, r) -> None:
        new = (r.us, r.tie or "")
        old = values.get(r.entity)
        if old is None or new >= (old[0], old[1] or ""):
            values[r.entity] = (r.us, r.tie, r.state)
            self.known.updateValue((r.entity,), (int(r.us), r.tie, r.state))

    def _go(self, rows: pd.DataFrame, late: bool) -> Iterator[pd.DataFrame]:
        values = {k[0]: tuple(v) for k, v in self.known.iterator()}
        out = []
        for r in rows.astype(object).where(rows.notna(), None).itertuples(index=False):
            if r.side == _STATE:
                self._learn(values, r)
            else:
                out.append((r.frame, r.us, *[values.get(e, (0, None, None))[2] for e in self.entities]))
        d = pd.DataFrame(out, columns=["frame", "us", *self.entities])
        # The time by which operators behind this one go: a late frame's is now.
        now = d["us"].astype("int64").clip(lower=self.watermark * 1000 if late else None)
        yield d.assign(late=late, event_ts=pd.to_datetime(now, unit="us")).drop(columns="us")

    def late(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield from self._go(rows, True)

    def take(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield from self._go(rows, False)


def asof_state_stream(
    frames: DataFrame,
    states: DataFrame,
    entities: Sequence[str],
    buckets: int = 1,
    wait_s: int = WAIT_S,
    tie: str = "state",
) -> DataFrame:
    """Last known state of each entity at each frame: `asof_state` on two streams.

    Adds a column per entity, `missing_state` and `late`. Both streams share one watermark, which
    follows the newer of them, so states that rarely change hold no frame up. Frames are dealt
    into buckets by their camera, and each bucket gets all states. A stateful operator behind
    this one takes its watermark over (`wait_s=None`).
    """
    ship(frames.sparkSession)
    text = F.to_json(F.struct(*frames.columns), _EXACT)
    f = frames.select(
        F.pmod(F.xxhash64("cam"), F.lit(buckets)).alias("bucket"), epoch_us("frame_ts").alias("us"),
        F.lit(_FRAME).cast("long").alias("side"), F.lit("").alias("tie"),
        F.lit(None).cast("string").alias("entity"), F.lit(None).cast("string").alias("state"), text.alias("frame"),
    )
    s = states.filter(F.col("entity").isin(*entities)).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"),
        epoch_us("ts").alias("us"), F.lit(_STATE).cast("long").alias("side"),
        F.coalesce(F.col(tie).cast("string"), F.lit("")).alias("tie"), "entity", "state",
        F.lit(None).cast("string").alias("frame"),
    )
    both = f.unionByName(s)
    schema = plain_schema(both)
    columns = both.columns
    names = ", ".join(f"`{e}` string" for e in entities)
    out = run_in_order(
        watermarked(both, "us", wait_s), ["bucket"], _AsOf(columns, schema, entities),
        f"frame string, {names}, late boolean, event_ts timestamp", "event_ts",
    )
    missing = F.lit(False)
    for e in entities:
        missing = missing | F.col(e).isNull()
    back = F.from_json("frame", frames.schema, _EXACT).alias("_f")
    return out.select(back, *entities, missing.alias("missing_state"), "late").select(
        "_f.*", *entities, "missing_state", "late"
    )
