"""Stateful streams against plain versions; stops, repeats and late rows change nothing."""

import random
from collections import defaultdict
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from quillspark.streaming.attempts import Attempts, attempt_outcomes
from quillspark.streaming.backfill import Backfill, backfill
from quillspark.streaming.runs import drain

START = datetime(2024, 1, 1)


def us(t):
    return int((t.replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


def fed(spark, slices, ddl, make, tmp_path, name):
    """Slice after slice, the stream stopping after each."""
    at, out, check = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "check"))
    for rows in slices:
        spark.createDataFrame(rows, ddl).withColumn("at", F.col("at").cast("timestamp")).coalesce(2).write.mode("append").parquet(at)
        stream = spark.readStream.schema(spark.read.parquet(at).schema).parquet(at)
        result = drain(make(stream), out, check)
    return result.collect()


def in_slices(rng, rows, n, late):
    """Rows in order of time cut into slices, some of them delayed, some twice."""
    rows = sorted(rows, key=lambda r: r["at"])
    size, out = -(-len(rows) // n), defaultdict(list)
    for i, r in enumerate(rows):
        k = i // size
        delayed = rng.random() < 0.2 and k + 1 < n and rows[min(len(rows), (k + 1) * size) - 1]["at"] - r["at"] < late / 2
        out[k + delayed].append(r)
        if rng.random() < 0.2:
            out[min(n - 1, k + delayed + rng.randrange(2))].append(r)
    return [out[k] for k in range(n)]


def test_attempts(spark, tmp_path):
    rng = random.Random(2)
    horizon, late = timedelta(hours=1), timedelta(hours=3)
    rows = []
    for a in range(150):
        begin = START + timedelta(minutes=rng.randrange(2000))
        if a % 11:
            rows.append({"attempt_id": a, "file_id": a % 7, "at": begin, "status": "started", "countable": None})
        for _ in range(rng.choice([0, 1, 1, 2])):
            rows.append({"attempt_id": a, "file_id": a % 7, "at": begin + timedelta(seconds=rng.choice([-5, 0, 30, 3600, 3601, 9000])), "status": rng.choice(["completed", "interrupted", "error"]), "countable": rng.choice([True, False])})
    got = fed(spark, in_slices(rng, rows, 5, late), "attempt_id long, file_id long, at timestamp, status string, countable boolean", lambda s: attempt_outcomes(s, 3600, "3 hours"), tmp_path, "attempts")
    mark = max(r["at"] for r in rows) - late
    want = []
    for a in range(150):
        mine = [r for r in rows if r["attempt_id"] == a]
        begin = min((r["at"] for r in mine if r["status"] == "started"), default=None)
        if begin is None:
            continue
        end = min(((r["at"], r["status"], r["countable"]) for r in mine if r["status"] != "started" and begin <= r["at"] <= begin + horizon), default=(begin + horizon, "interrupted", False))
        if end[0] < mark:
            want.append((a, a % 7, end[1], end[2], begin, end[0]))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def runs_of(posts, budget, days, apart=3600):
    """What each feed's runs take, over its whole history."""
    out = []
    for feed in {p["feed_id"] for p in posts}:
        held, taken, last, run, imported = {}, set(), None, 0, 0
        for p in posts:
            if p["feed_id"] == feed:
                held[p["url"]] = min(held.get(p["url"], (p["at"], p["day"])), (p["at"], p["day"]))
        while left := {u: v for u, v in held.items() if u not in taken}:
            soonest = min(at for at, _ in left.values())
            now = soonest if last is None else max(soonest, last + timedelta(seconds=apart))
            known = [(day, u) for u, (at, day) in left.items() if at <= now]
            todo = sorted((x for x in known if days < 0 or x[0] >= now.date() - timedelta(days=days)), key=lambda x: (-x[0].toordinal(), x[1]))
            batch = todo[:budget]
            taken |= {u for _, u in batch} | {u for _, u in known if (_, u) not in todo}
            total, imported = imported + len(todo), imported + len(batch)
            out += [(feed, u, now, run, k, imported, total, len(todo) <= len(batch)) for k, (_, u) in enumerate(batch)]
            last, run = now, run + 1
    return out


def test_backfill(spark, tmp_path):
    rng = random.Random(3)
    late = timedelta(hours=30)
    posts = []
    for i in range(400):
        at = START + timedelta(hours=rng.choice([0, 1, 2, 30, 31, 90, 130]), seconds=rng.choice([0, 0, 1800, 3599]))
        posts.append({"feed_id": i % 3, "url": f"u{i}", "day": date(2024, 1, 3) - timedelta(days=rng.randrange(60)), "at": at})
    slices = in_slices(rng, posts, 4, late)
    slices[3].append({**posts[0], "at": START + timedelta(hours=129)})
    for days, budget in ((30, 7), (-1, 15)):
        got = fed(spark, slices, "feed_id long, url string, day date, at timestamp", lambda s, b=budget, d=days: backfill(s, b, d, "30 hours"), tmp_path, f"backfill{days}")
        mark = max(p["at"] for p in posts) - late
        want = [r for r in runs_of(posts, budget, days) if r[2] < mark]
        assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50 and any(not r[7] for r in want)


class Told:
    """State and timers of one key that count the messages to them."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, {}, set()

    def _counted(self, name):
        def call(*args):
            self.calls += 1
            return getattr(self, f"_{name}")(*args)

        return call

    def state(self, name):
        out = type("State", (), {})()
        for call in ("get", "update", "appendList", "put", "clear"):
            setattr(out, call, lambda *a, call=call: self._counted(call)(name, *a))
        return out

    getListState = getValueState = getMapState = lambda self, name, ddl: self.state(name)
    registerTimer = lambda self, at: self.timers.add(at)
    deleteTimer = lambda self, at: self.timers.remove(at)

    def _get(self, name):
        return self.held.get(name) or (None if name == "progress" else [])

    def _update(self, name, value):
        self.held[name] = value

    _put = _update

    def _appendList(self, name, values):
        self.held[name] = [*self._get(name), *values]

    def _clear(self, name):
        self.held.pop(name, None)


def test_backfill_messages_do_not_grow_with_the_rows():
    told, late = Told(), type("Mark", (), {"getCurrentWatermarkInMs": lambda self: 10**9})()
    machine = Backfill(9, -1)
    machine.init(told)
    rows = [Row(url=f"u{i}", day=i % 30, us=i * 1000) for i in range(1000)]
    assert list(machine.handleInputRows((1,), iter(rows), late)) == [] and told.calls <= 5 and len(told.timers) == 1
    out = list(machine.handleExpiredTimer((1,), late, None))
    assert len({r.url for r in out}) == len(out) > 900 and told.calls <= 12


def test_neighbouring_attempts_share_their_state():
    """One read, one write and one timer for the rows of 64 attempts; those that are over go, the others stay."""
    calls, value = [], [None]

    class Held:
        get = staticmethod(lambda: value[0])
        update = staticmethod(lambda v: (calls.append("update"), value.__setitem__(0, v)))
        clear = staticmethod(lambda: value.__setitem__(0, None))

    class Handle:
        getValueState = staticmethod(lambda *a: Held)
        registerTimer = staticmethod(lambda t: calls.append(("set", t)))
        deleteTimer = staticmethod(lambda t: calls.append(("unset", t)))

    class Now:
        getCurrentWatermarkInMs = staticmethod(lambda: 40)

    of = Attempts(10_000)
    of.init(Handle)
    rows = [Row(attempt_id=i, file_id=i, status="started", us=i * 1000, countable=True) for i in range(64)]
    list(of.handleInputRows((0,), iter(rows), None))
    assert calls == [("set", 11), "update"]
    gone = [r.attempt_id for r in of.handleExpiredTimer((0,), Now, None)]
    assert gone == list(range(29)) and calls[2:] == [("set", 40), "update"] and len(value[0][1]) == 35
