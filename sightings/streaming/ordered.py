"""Rows of a key in the order of their time, on a stream.

Rows wait in state until the watermark has passed them. It comes from all keys together, and a
timer wakes a key whose own rows have stopped, so the last rows of a camera that goes silent leave
with the time of the others. What comes after later rows of its key were taken is late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that rows may come after others of a later time.
WAIT_S = 300
NEVER = (-(2**62), -1)


def plain_schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def watermarked(df: DataFrame, us: str, wait_s: int | None) -> DataFrame:
    """The stream with a watermark on a column of microseconds; None leaves the one it has.

    The column that carries it is dropped again, as rows behind the watermark would be dropped
    before an operator sees them; here they are told apart as late.
    """
    if wait_s is None:
        return df
    d = df.withColumn("_event", F.timestamp_micros(us)).withWatermark("_event", f"{wait_s} seconds")
    return d.drop("_event")


def not_after(us: pd.Series, no: pd.Series, at: tuple) -> np.ndarray:
    """Rows that aren't after a place in time."""
    return ((us < at[0]) | ((us == at[0]) & (no <= at[1]))).to_numpy(bool)


class InOrder(StatefulProcessor):
    """Holds rows until the watermark passes them; `take` gets them in order, `late` the others.

    `us` and `no` name a row's time in microseconds and its number within it, `ties` what else
    orders rows. Subclasses open their own state in `open_state`.
    """

    def __init__(self, columns: list[str], schema: str, us: str, no: str, ties: tuple[str, ...] = ()) -> None:
        self.columns, self.schema = columns, schema
        self.us, self.no, self.ties = us, no, ties

    def open_state(self, handle: StatefulProcessorHandle) -> None: ...

    def take(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def late(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        return iter(())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.schema)
        self.place = handle.getValueState("place", "us long, no long")
        self.open_state(handle)

    def is_late(self, rows: pd.DataFrame, watermark_ms: int) -> np.ndarray:
        at = tuple(self.place.get()) if self.place.exists() else NEVER
        return not_after(rows[self.us], rows[self.no], at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([d[self.columns] for d in rows], ignore_index=True)
        behind = self.is_late(new, timerValues.getCurrentWatermarkInMs())
        if behind.any():
            yield from self.late(key, new[behind])
        yield from self._due(key, new[~behind], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(key, None, timerValues)

    def _due(self, key, new: pd.DataFrame | None, timerValues) -> Iterator[pd.DataFrame]:
        parts = [new] if new is not None else []
        if self.pending.exists():
            parts.insert(0, pd.DataFrame(list(self.pending.get()), columns=self.columns))
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=self.columns)
        watermark = timerValues.getCurrentWatermarkInMs()
        due = (rows[self.us] // 1000 <= watermark).to_numpy(bool) if len(rows) else np.zeros(0, bool)
        if due.any():
            ready = rows[due].sort_values(list(dict.fromkeys([self.us, self.no, *self.ties])), kind="stable")
            last = ready.iloc[-1]
            yield from self.take(key, ready)
            self.place.update((int(last[self.us]), int(last[self.no])))
        wait = rows[~due]
        if new is not None or due.any():
            if len(wait):
                plain = wait.astype(object).where(wait.notna(), None)
                self.pending.put(list(plain.itertuples(index=False, name=None)))
            else:
                self.pending.clear()
        if len(wait):
            self.wake(int(wait[self.us].min()) // 1000, watermark)

    def wake(self, ms: int, watermark: int) -> None:
        """Be called when the watermark has reached a time, unless a timer is set already.

        Timers that the watermark has passed are about to go off, or are going off now.
        """
        at = ms - 1 if ms - 1 > watermark else ms
        if not any(watermark < t <= at for t in self.handle.listTimers()):
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def run_in_order(df: DataFrame, keys: list[str], processor: InOrder, schema: str, event: str = "") -> DataFrame:
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=schema,
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName=event,
    )
