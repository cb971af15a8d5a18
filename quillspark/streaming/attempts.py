"""Download attempts as a stream: each is closed once, by its first close or by its horizon.

Rows may come late, twice and out of order.  An attempt's rows are held until
the watermark has passed its end, so nothing that could still come changes it;
then one outcome is returned and its state goes.  What is held are the attempts
of the last hours, whatever the length of the history.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspark.streaming.runs import keyed_state

#: Two to this power attempts of neighbouring numbers share an entry of the state.
NEIGHBOURS = 6

OUTCOME_DDL = "attempt_id long, file_id long, status string, countable boolean, started_us long, finished_us long"


def outcome(start: int, closes: list, horizon: int) -> tuple[int, str, bool]:
    """End, status and whether it may count: the first close from the start to the horizon, else an interruption there."""
    fine = [c for c in closes if start <= c[0] <= start + horizon]
    return min(fine) if fine else (start + horizon, "interrupted", False)


class Attempts(StatefulProcessor):
    """Start, file and closes of attempts of neighbouring numbers; a timer where the first of them ends as far as is known.

    They are read and written together, as each call to the state is a message.
    """

    def __init__(self, horizon_us: int):
        self.horizon = horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "timer long, attempts array<struct<attempt_id:long,start:long,file_id:long,closes:array<struct<at:long,status:string,countable:boolean>>>>")

    def _load(self) -> tuple[int | None, dict]:
        timer, attempts = self.held.get() or (None, [])
        return timer, {a[0]: (a[1], a[2], [tuple(c) for c in a[3]]) for a in attempts}

    def _due(self, start: int | None, closes: list) -> int:
        # closes that nothing opened are kept as long as their start may still come
        end = outcome(start, closes, self.horizon)[0] if start is not None else max(c[0] for c in closes) + self.horizon
        return end // 1000 + 1

    def _keep(self, timer: int | None, attempts: dict) -> None:
        """``timer``: the one that is set."""
        soonest = min((self._due(start, closes) for start, _, closes in attempts.values()), default=None)
        if timer is not None and timer != soonest:
            self.handle.deleteTimer(timer)
        if soonest is None:
            self.held.clear()
            return
        if timer != soonest:
            self.handle.registerTimer(soonest)
        self.held.update((soonest, [(i, *a) for i, a in attempts.items()]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        timer, attempts = self._load()
        for row in rows:
            start, file_id, closes = attempts.get(row.attempt_id, (None, None, []))
            if row.status != "started":
                closes = sorted({*closes, (row.us, row.status, row.countable)})
            elif start is None or row.us < start:
                start, file_id = row.us, row.file_id
            attempts[row.attempt_id] = start, file_id, closes
        self._keep(timer, attempts)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        _, attempts = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        over = [i for i, (start, _, closes) in attempts.items() if self._due(start, closes) < now]
        ended = [(i, *attempts.pop(i)) for i in over]
        # the timer that ran out is gone
        self._keep(None, attempts)
        for i, start, file_id, closes in ended:
            if start is not None:
                end, status, countable = outcome(start, closes, self.horizon)
                yield Row(attempt_id=i, file_id=file_id, status=status, countable=countable, started_us=start, finished_us=end)

    def close(self) -> None:
        pass


def attempt_outcomes(events: DataFrame, horizon_seconds: int, late: str) -> DataFrame:
    """A stream of outcomes from a stream of events (attempt_id, file_id, at, status, countable).

    ``late`` bounds how much older than the newest event a row may come; older
    ones are left out.  A close that comes again, a close of an attempt that
    never began, and one after the horizon change nothing.
    """
    rows = events.withWatermark("at", late).select("attempt_id", "file_id", "at", "status", F.coalesce("countable", F.lit(True)).alias("countable"), F.unix_micros("at").alias("us"), F.shiftright(F.col("attempt_id").cast("long"), NEIGHBOURS).alias("neighbours"))
    with keyed_state(events.sparkSession):
        out = rows.groupBy("neighbours").transformWithState(Attempts(horizon_seconds * 1_000_000), OUTCOME_DDL, "Append", "EventTime")
    return out.select("attempt_id", "file_id", "status", "countable", F.timestamp_micros("started_us").alias("started_at"), F.timestamp_micros("finished_us").alias("finished_at"))
