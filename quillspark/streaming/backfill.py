"""Rolling import of older posts as a state machine: a bounded batch a run, runs at least an hour apart.

A feed's state is what its sitemap has shown and no run has taken yet, what has
been taken and may be shown again, and its last run.  Time is that of the rows:
a run falls due where the watermark has passed it, so that all it has to see
has come, and the result is that of one pass over the whole history, however
the rows are cut into batches and wherever the stream stops and goes on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from heapq import heappop, heappush
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspark.streaming.runs import keyed_state

#: Fixed value: seconds between two reads of a sitemap.
APART = 3600
RUN_DDL = "feed_id long, url string, run_us long, run int, place int, imported long, total long, done boolean"


def first_day(run_us: int, days: int) -> int:
    """First day of the window, since 1970; of -1 days the first of all."""
    if days < 0:
        return -(1 << 31)
    return (datetime.fromtimestamp(run_us // 1_000_000, UTC) - timedelta(days=days)).date().toordinal() - 719163


class Backfill(StatefulProcessor):
    def __init__(self, budget: int, days: int, apart: int = APART):
        self.budget, self.days, self.apart = budget, days, apart * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # lists are read and written whole: an entry of a map would be a message of its own
        self.pending = handle.getListState("pending", "url string, day int, us long")
        self.taken = handle.getListState("taken", "url string, day int")
        self.progress = handle.getValueState("progress", "last long, runs int, imported long, soonest long, timer long")

    def _progress(self) -> tuple:
        return self.progress.get() or (None, 0, 0, None, None)

    def _put(self, last: int | None, runs: int, imported: int, soonest: int | None, timer: int | None) -> None:
        """A run is due when there is something to take, and not before the last run's hour is over."""
        run = soonest if soonest is None or last is None else max(soonest, last + self.apart)
        due = None if run is None else run // 1000 + 1
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.progress.update((last, runs, imported, soonest, due))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last, runs, imported, soonest, timer = self._progress()
        taken = {url for url, _ in self.taken.get()}
        new: dict[str, tuple[int, int]] = {}
        for row in rows:
            if row.url not in taken:
                day, us = new.get(row.url, (row.day, row.us))
                new[row.url] = (day, min(us, row.us))
        if new:
            # one shown before stands twice until the next run; the earliest counts
            self.pending.appendList([(url, day, us) for url, (day, us) in new.items()])
            soonest = min([us for _, us in new.values()] + ([] if soonest is None else [soonest]))
        self._put(last, runs, imported, soonest, timer)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        last, runs, imported, soonest, _ = self._progress()
        held: dict[str, tuple[int, int]] = {}
        for url, day, us in self.pending.get():
            first, earliest = held.get(url, (day, us))
            held[url] = (first, min(earliest, us))
        coming = sorted(((us, day, url) for url, (day, us) in held.items()), reverse=True)
        # what has come, the newest day first, and how many of each day that is in the window
        known: list[tuple[int, str]] = []
        days: Counter[int] = Counter()
        taken, oldest, size = [], None, 0
        # the watermark may have passed several runs at once
        while soonest is not None:
            run = soonest if last is None else max(soonest, last + self.apart)
            if run // 1000 + 1 > timerValues.getCurrentWatermarkInMs():
                break
            oldest = first_day(run, self.days)
            while coming and coming[-1][0] <= run:
                _, day, url = coming.pop()
                heappush(known, (-day, url))
                days[day] += 1
            # what is out of the window doesn't come back into it
            for day in [d for d in days if d < oldest]:
                del days[day]
            todo = days.total()
            batch = [heappop(known) for _ in range(min(self.budget, todo))]
            for day, url in batch:
                days[-day] -= 1
                taken.append((url, -day))
            size = todo - len(batch)
            if not size:
                known = []
            total, imported = imported + todo, imported + len(batch)
            for place, (_, url) in enumerate(batch):
                yield Row(feed_id=key[0], url=url, run_us=run, run=runs, place=place, imported=imported, total=total, done=not size)
            last, runs = run, runs + 1
            soonest = last if size else coming[-1][0] if coming else None
        if oldest is not None:
            rest = [(url, -day, held[url][1]) for day, url in known if -day >= oldest] + [(url, day, us) for us, day, url in coming]
            kept = [(url, day) for url, day in [*self.taken.get(), *taken] if day >= oldest]
            for state, values in ((self.pending, rest), (self.taken, kept)):
                state.put(values) if values else state.clear()
        self._put(last, runs, imported, soonest, None)

    def close(self) -> None:
        pass


def backfill(posts: DataFrame, budget: int, days: int, late: str, apart: int = APART) -> DataFrame:
    """A stream of imports from a stream of sitemap rows (feed_id, url, day, at): feed_id, url, run_at, run, place, imported, total, done.

    Each run takes ``budget`` posts of the last ``days`` (-1: all, 0: none), the
    newest first; ``imported`` and ``total`` are the feed's progress after it,
    ``done`` tells that none was left.  A post that is shown again is taken
    once; rows older than ``late`` behind the newest are left out.  Rows without
    feed, address or day are ignored.
    """
    rows = posts.withWatermark("at", late).filter("feed_id IS NOT NULL AND url IS NOT NULL AND day IS NOT NULL")
    cut = rows.select(F.col("feed_id").cast("long").alias("feed_id"), "url", F.unix_date("day").alias("day"), "at", F.unix_micros("at").alias("us"))
    if days == 0:
        cut = cut.filter("false")
    with keyed_state(posts.sparkSession):
        out = cut.groupBy("feed_id").transformWithState(Backfill(budget, days, apart), RUN_DDL, "Append", "EventTime")
    return out.select("feed_id", "url", F.timestamp_micros("run_us").alias("run_at"), "run", "place", "imported", "total", "done")
