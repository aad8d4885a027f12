"""Rules with state over a stream: the alarms of ``tidemark.operators.rules``, judged in the order of time as the watermark passes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.rules import level

#: Waiting rows in one element of the state.
FRAME = 10_000


class _Alarms(StatefulProcessor):
    """A key's rows that the watermark hasn't passed, and its alarm: last breach, breaches in a row, highest tier, raised or not.

    Waiting rows are state by frames of them, columns of us, tie and level as 64-bit numbers. A timer stands at the first waiting row and at the alarm's end. One that comes too early finds nothing to do and is set anew;
    a key whose alarm is over and that has no row waiting keeps no state."""

    def __init__(self, in_row: int, quiet: int):
        self.in_row, self.quiet = in_row, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.alarm = handle.getValueState("alarm", "last long, run int, tier int, raised boolean")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        first = None
        for frame in rows:
            new = frame.loc[frame["us"] > passed, ["us", "tie", "level"]].to_numpy("int64")
            if len(new):
                self.waiting.appendValue((new.tobytes(),))
                first = min(int(new[:, 0].min()), first if first is not None else int(new[0, 0]))
        if first is not None:  # one timer, however many frames came
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = np.concatenate([np.empty((0, 3), "int64"), *(np.frombuffer(v[0], "int64").reshape(-1, 3) for v in self.waiting.get())]) if self.waiting.exists() else np.empty((0, 3), "int64")
        held = held[np.lexsort(held.T[::-1])]
        alarm, out = (self.alarm.get() if self.alarm.exists() else None), []
        due = int(np.searchsorted(held[:, 0], passed, side="right"))
        tiers = held[:due, 2]
        # of clean rows in a row the first tells it all
        for us, _, tier in held[:due][(tiers > 0) | np.append(True, tiers[:-1] > 0)[:due]].tolist():
            alarm = self._until(alarm, us, key[0], out)
            if not tier:
                alarm = alarm and (alarm[0], 0, alarm[2], alarm[3])
                continue
            _, run, highest, raised = alarm or (None, 0, 0, False)
            run += 1
            if raised and tier > highest:
                out.append((key[0], us, "escalate", tier))
            highest = max(highest, tier)
            if not raised and run >= self.in_row:
                raised = True
                out.append((key[0], us, "raise", highest))
            alarm = (us, run, highest, raised)
        alarm = self._until(alarm, passed, key[0], out)
        rest = held[due:]
        if due:
            if len(rest):
                self.waiting.put([(rest[k : k + FRAME].tobytes(),) for k in range(0, len(rest), FRAME)])
            else:
                self.waiting.clear()
        if len(rest):
            self._wake(int(rest[0, 0]))
        if alarm:
            self.alarm.update(alarm)
            self._wake(alarm[0] + self.quiet)
        elif self.alarm.exists():
            self.alarm.clear()
        if out:
            yield pd.DataFrame(out, columns=["symbol", "us", "action", "tier"])

    def _until(self, alarm, us: int, key: str, out: list):
        """The alarm at a time: over, and told so if it was raised, the quiet time after its last breach."""
        if alarm and alarm[0] + self.quiet <= us:
            if alarm[3]:
                out.append((key, alarm[0] + self.quiet, "release", alarm[2]))
            return None
        return alarm

    def close(self) -> None:
        pass


def actions(rows: DataFrame, value: str, limits: Sequence[float], in_row: int, quiet: int, lateness: str) -> DataFrame:
    """symbol, us, action, tier of a stream (symbol, ts, tie, value): what ``operators.rules.actions`` finds up to the watermark, in whatever order the rows
    come; rows the watermark has passed are left out. Needs the RocksDB state store (``streams.ROCKS``)."""
    judged = rows.withWatermark("ts", lateness).select("symbol", "ts", F.unix_micros("ts").alias("us"), F.col("tie").cast("long").alias("tie"), level(value, limits).alias("level"))
    return judged.groupBy("symbol").transformWithStateInPandas(_Alarms(in_row, quiet), "symbol string, us long, action string, tier int", "Append", "EventTime")
