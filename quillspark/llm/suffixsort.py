"""External induced suffix sorting with common-prefix values.

Text, names, suffix tuples (place, common prefix with the one before) and the
flags that come out are files; memory holds one block of tuples, the queues'
share of tuples and a few counters, whatever the length of the text.

The priority queue of an induction is dealt by symbol: one first-in first-out
queue on disk for each range of symbols, taken in symbol order.  Larger (L)
suffixes are induced upwards from the leftmost-smaller (LMS) ones, smaller (S)
suffixes downwards from those.  The common prefix of two neighbours is one more
than the least common prefix between the suffixes that induced them.

LMS suffixes are ordered first: one induction sorts and names their substrings;
the string of names, at most half as long, is sorted by the same method, with
its common prefixes.  Names are many, so neighbouring rare names share a range
that fits in a block; inside it, suffixes that induce one another are ordered by
doubling along their chains.  The recursion ends where names are all different
or the whole string is one such range.

Order and prefixes are exact up to a depth of ``limit`` symbols.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples of a block, and tuples that the queues of one induction hold in memory before they go to disk.
BLOCK, HELD = 1 << 16, 1 << 19


class Scratch:
    """A folder of arrays and tuple files, in the executor's own scratch space; gone with the sort."""

    def __init__(self):
        roots = os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS") or ""
        self.dir = tempfile.TemporaryDirectory(prefix="suffixes-", dir=roots.split(",")[0] or None, ignore_cleanup_errors=True)
        self.names = 0

    def path(self) -> str:
        self.names += 1
        return f"{self.dir.name}/{self.names}"

    def array(self, size: int, dtype, path: str | None = None) -> np.ndarray:
        """An array on disk: the file of that path, or a new one of zeros, which goes with the array."""
        at = path or self.path()
        out = np.asarray(np.memmap(at, dtype=dtype, mode="r+" if path else "w+", shape=(max(1, size),)))[:size]
        # the mapping keeps the space until the array is gone
        os.unlink(at)
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.dir.cleanup()


class Tuples:
    """A list of (place, common prefix) that grows at its end: in memory up to ``held`` tuples, then a file."""

    def __init__(self, scratch: Scratch, dtype, held: int = 0):
        self.path, self.dtype, self.held, self.size = scratch.path(), np.dtype(dtype), held, 0
        self.parts: list[np.ndarray] = []
        self.on_disk = False

    def append(self, *parts: tuple[np.ndarray, np.ndarray]) -> None:
        for places, common in parts:
            both = np.empty((len(places), 2), self.dtype)
            both[:, 0], both[:, 1] = places, common
            self.parts.append(both)
            self.size += len(places)
        if self.on_disk or self.size > self.held:
            with open(self.path, "ab") as f:
                for both in self.parts:
                    f.write(both.tobytes())
            self.parts, self.on_disk = [], True

    def read(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        if self.on_disk:
            both = np.fromfile(self.path, dtype=self.dtype, count=2 * (stop - start), offset=2 * self.dtype.itemsize * start).reshape(-1, 2)
        else:
            if len(self.parts) > 1:
                self.parts = [np.concatenate(self.parts)]
            both = self.parts[0][start:stop]
        return both[:, 0].astype(np.int64), both[:, 1].astype(np.int64)

    def backwards(self, low: int, high: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of low..high-1 from the end; each tuple's prefix is then that with the one read before it, 0 for the first."""
        carry = 0
        for stop in range(high, low, -block):
            places, common = self.read(max(low, stop - block), stop)
            yield places[::-1], np.concatenate([[carry], common[:0:-1]])
            carry = int(common[0])

    def delete(self) -> None:
        self.parts, self.size = [], 0
        if self.on_disk:
            os.unlink(self.path)


class Queues:
    """First-in first-out queues of tuples, one for each range of symbols.

    Together they hold at most ``held`` tuples in memory (a part weighs as much
    as ``PART`` more); beyond that the longest go to the ends of their files
    until half of that is left.
    """

    PART = 16

    def __init__(self, scratch: Scratch, dtype, held: int):
        self.scratch, self.dtype, self.limit = scratch, dtype, held
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.sizes: dict[int, int] = {}
        self.files: dict[int, Tuples] = {}
        self.done: dict[int, int] = {}
        self.held = 0
        self.spilled = 0

    def push(self, r: int, places: np.ndarray, common: np.ndarray) -> None:
        # copies: a slice would keep its whole block in memory
        self.parts.setdefault(r, []).append((places.copy(), common.copy()))
        self.sizes[r] = self.sizes.get(r, 0) + len(places) + self.PART
        self.held += len(places) + self.PART
        if self.held > self.limit:
            for q in sorted(self.sizes, key=self.sizes.get, reverse=True):
                if q not in self.files:
                    self.files[q] = Tuples(self.scratch, self.dtype)
                self.files[q].append(*self.parts.pop(q))
                self.spilled += self.sizes[q]
                self.held -= self.sizes.pop(q)
                if self.held <= self.limit // 2:
                    break

    def take(self, r: int, block: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next tuples of a queue, at most ``block`` of them; it may grow meanwhile."""
        file, at = self.files.get(r), self.done.get(r, 0)
        if file is not None and at < file.size:
            stop = min(file.size, at + block)
            self.done[r] = stop
            return file.read(at, stop)
        parts = self.parts.pop(r, None)
        if not parts:
            if file is not None:
                file.delete()
                del self.files[r], self.done[r]
            return None
        self.held -= self.sizes.pop(r)
        places, common = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
        if len(places) > block:
            self.parts[r] = [(places[block:], common[block:])]
            self.sizes[r] = len(places) - block + self.PART
            self.held += self.sizes[r]
        return places[:block], common[:block]


def _least_table(values: np.ndarray) -> np.ndarray:
    """Row j: the least of the 2**j values from each place on (fewer at the end)."""
    rows, w = [values], 1
    while 2 * w <= len(values):
        new = rows[-1].copy()
        np.minimum(new[:-w], rows[-1][w:], out=new[:-w])
        rows.append(new)
        w *= 2
    return np.stack(rows)


def _least(table: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least value in each low..high, both inside."""
    j = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    return np.minimum(table[j, low], table[j, high - (1 << j.astype(np.int64)) + 1])


class Since:
    """Common prefix of each induced suffix with the one induced before it into the same symbol.

    For a symbol, the least prefix between its last inducing suffix and now is
    kept with the block where that stood; blocks in between count by their own
    least.  Inducing suffixes of different ranges share nothing.
    """

    def __init__(self, symbols: int, limit: int, scratch: Scratch):
        self.value, self.block = scratch.array(symbols, np.int64), scratch.array(symbols, np.int64)
        self.limit, self.at, self.base, self.minima = limit, 1, 0, []

    def next_range(self) -> None:
        self.base, self.minima = self.at - 1, []

    def common(self, prefix: np.ndarray, symbols: np.ndarray, source: np.ndarray) -> np.ndarray:
        """prefix: of the block's inducing suffixes; symbols, sorted, and source: those induced, by place in the block."""
        out = np.empty(len(symbols), np.int64)
        if len(symbols):
            new = np.concatenate([[True], symbols[1:] != symbols[:-1]])
            first, last = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True))
            rest = np.flatnonzero(~new)
            if len(rest):
                out[rest] = 1 + _least(_least_table(prefix), source[rest - 1] + 1, source[rest])
            d = symbols[first]
            seen = self.block[d]
            between = np.append(np.minimum.accumulate(self.minima[::-1])[::-1] if self.minima else np.empty(0, np.int64), self.limit)
            known = seen > self.base
            since = np.minimum(self.value[d], between[np.where(known, seen - self.base, 0)])
            since = np.minimum(since, np.minimum.accumulate(prefix)[source[first]])
            out[first] = np.where(known, 1 + since, 1)
            tail = np.append(np.minimum.accumulate(prefix[::-1])[::-1][1:], self.limit)
            self.value[symbols[last]] = tail[source[last]]
            self.block[symbols[last]] = self.at
        self.minima.append(int(prefix.min()))
        self.at += 1
        return np.minimum(out, self.limit)


class Level:
    """One string of the recursion: its text on disk, and ranges of symbols by their first ones (``cuts``)."""

    def __init__(self, text: np.ndarray, symbols: int, cuts: np.ndarray, limit: int, scratch: Scratch, block: int, held: int):
        self.text, self.symbols, self.limit, self.scratch, self.block, self.held = text, symbols, limit, scratch, block, held
        self.cuts = np.append(cuts, symbols).astype(np.int64)
        self.single = (np.diff(self.cuts) == 1).tolist()
        #: Of places and prefixes.
        self.kind = np.int32 if max(len(text), limit + 1) < 1 << 31 else np.int64
        self.spilled = 0

    def ranges(self, symbols: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, symbols, side="right") - 1

    def shared(self, a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Common prefix of suffixes a and b, up to ``limit``, by their symbols; the first ``start`` are known to be equal."""
        out = np.zeros(len(a), np.int64) if start is None else np.minimum(start, self.limit)
        live, end, steps = np.flatnonzero(out < self.limit), len(self.text) - 1, np.arange(4)
        while len(live):
            at = out[live, None] + steps
            differs = self.text[np.minimum(a[live, None] + at, end)] != self.text[np.minimum(b[live, None] + at, end)]
            some = differs.any(axis=1)
            out[live] += np.where(some, differs.argmax(axis=1), len(steps))
            live = live[~some & (out[live] < self.limit)]
            steps = np.arange(min(2 * len(steps), 64))
        return np.minimum(out, self.limit)

    def smaller(self) -> np.ndarray:
        """Whether each suffix is smaller than the next one; the last, the sentinel, is."""
        n, after = len(self.text), True
        out = self.scratch.array(n, np.bool_)
        out[n - 1] = True
        for stop in range(n - 1, 0, -self.block):
            start = max(0, stop - self.block)
            part = self.text[start : stop + 1]
            known = part[:-1] < part[1:]
            spot = np.where(part[:-1] != part[1:], np.arange(stop - start), stop - start)
            spot = np.minimum.accumulate(spot[::-1])[::-1]
            out[start:stop] = np.append(known, after)[spot]
            after = bool(out[start])
        return out

    def lms(self, up: np.ndarray) -> np.ndarray:
        path, size = self.scratch.path(), 0
        with open(path, "wb") as f:
            for start in range(1, len(up), self.block):
                stop = min(len(up), start + self.block)
                found = np.flatnonzero(up[start:stop] & ~up[start - 1 : stop - 1]) + start
                f.write(found.astype(self.kind).tobytes())
                size += len(found)
        return self.scratch.array(size, self.kind, path)

    def order(self, items: np.ndarray, common: np.ndarray | None, seeds: np.ndarray, seed_common: np.ndarray | None, r: int, upwards: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """All suffixes of a range of several symbols in order of the pass: places, common prefixes, whether induced.

        items: induced from outside, by time; seeds: given ones, in order of
        the pass.  Those induced inside are found here.
        """
        low, high = self.cuts[r], self.cuts[r + 1]
        k, places, source = len(items), [items, seeds], [np.empty(0, np.int64)]
        front, induced, index = np.concatenate(places), np.arange(len(items) + len(seeds)) < k, np.arange(len(items) + len(seeds))
        total = len(front)
        while len(front):
            before = np.maximum(front - 1, 0)
            mine, theirs = self.text[before], self.text[front]
            fits = (front > 0) & (mine >= low) & (mine < high) & ((mine > theirs if upwards else mine < theirs) | ((mine == theirs) & induced))
            front, index = before[fits], index[fits]
            source.append(index)
            places.append(front)
            index, induced = np.arange(total, total + len(front)), np.ones(len(front), bool)
            total += len(front)
        place, inner = np.concatenate(places), np.concatenate(source)
        symbol = self.text[place].astype(np.int64)
        is_seed = np.zeros(total, bool)
        is_seed[k : k + len(seeds)] = True
        turn = symbol if upwards else -symbol
        # ranks: first the k times of induction from outside, then symbols, seeds after others and in their order
        seq = np.where(is_seed, np.arange(total), 0)
        by = np.lexsort((seq, is_seed, turn))
        key = np.stack([turn[by], is_seed[by], seq[by]])
        rank = np.empty(total + k, np.int64)
        rank[by] = k + np.cumsum(np.concatenate([[0], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if total else 0
        rank[total:] = np.arange(k)
        after = np.concatenate([np.arange(total, total + k), np.arange(k, k + len(seeds)), inner, np.arange(total, total + k)])
        depth = 1
        while True:
            pair = rank * (total + k + 1) + rank[after]
            by = np.argsort(pair, kind="stable")
            steps = np.cumsum(np.concatenate([[0], pair[by][1:] != pair[by][:-1]])) if total else np.empty(0, np.int64)
            rank[by] = steps
            after, depth = after[after], 2 * depth
            if not total or steps[-1] == total + k - 1 or depth > max(self.limit, 1):
                break
        by = np.argsort(rank[:total], kind="stable")
        if common is None:
            return place[by], None, ~is_seed[by]
        given = np.full(total, -1, np.int64)
        given[:k], given[k : k + len(seeds)] = common, seed_common
        out, a, b = given[by], by[:-1], by[1:]
        alike = np.concatenate([[False], symbol[a] == symbol[b]]) if total else np.empty(0, bool)
        out[~alike] = 0
        open_ = alike & ((out < 0) | np.concatenate([[False], is_seed[b] & ~is_seed[a]])) if total else alike
        at = np.flatnonzero(open_)
        out[at] = self.shared(place[by[at - 1]], place[by[at]])
        return place[by], out, ~is_seed[by]

    def induce(self, seeds, upwards: bool, with_common: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Yield (range, places, common prefixes, whether induced) by blocks, in the order of the pass.

        seeds: range to its given suffixes, by blocks in the order of the pass.
        """
        queues = Queues(self.scratch, self.kind, self.held)
        since = Since(self.symbols, self.limit, self.scratch) if with_common else None
        small = self.symbols <= 1 << 16
        of = self.ranges(np.arange(self.symbols)) if small else None

        def deal(r: int, places: np.ndarray, common: np.ndarray, induced) -> None:
            before = places - 1
            symbol = self.text[np.maximum(before, 0)]
            if self.single[r]:
                c = self.cuts[r]
                fits = (symbol > c if upwards else symbol < c) | ((symbol == c) & induced)
            else:
                fits = symbol >= self.cuts[r + 1] if upwards else symbol < self.cuts[r]
            source = np.flatnonzero(fits & (places > 0))
            target = symbol[source]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            shared = since.common(common, target.astype(np.int64), source) if since else None
            if not len(source):
                return
            new = before[source]
            to = of[target] if small else self.ranges(target)
            edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            blank = np.zeros(len(new), np.int64) if shared is None else shared
            for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(to)], strict=True):
                queues.push(int(to[s]), new[s:e], blank[s:e])

        count = len(self.single)
        for r in range(count) if upwards else range(count - 1, -1, -1):
            if since:
                since.next_range()
            if not self.single[r]:
                got = []
                while (part := queues.take(r, self.block)) is not None:
                    got.append(part)
                places, common = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.empty(0, np.int64),) * 2
                turn = self.text[places].astype(np.int64)
                by = np.argsort(turn if upwards else -turn, kind="stable")
                given = [(p, c) for p, c in seeds(r)]
                more, more_common = (np.concatenate(x) for x in zip(*given, strict=True)) if given else (np.empty(0, np.int64),) * 2
                if len(places) or len(more):
                    every, shared, induced = self.order(places[by], common[by] if with_common else None, more, more_common if with_common else None, r, upwards)
                    shared = np.zeros(len(every), np.int64) if shared is None else shared
                    deal(r, every, shared, induced)
                    yield r, every, shared, induced
                continue
            last = None
            while (part := queues.take(r, self.block)) is not None:
                places, common = part
                if last is None:
                    common = np.concatenate([[0], common[1:]])
                deal(r, places, common, True)
                yield r, places, common, np.ones(len(places), bool)
                last = int(places[-1])
            for k, (places, common) in enumerate(seeds(r)):
                if not k and with_common:
                    edge = 0 if last is None else int(self.shared(np.array([last]), places[:1])[0])
                    common = np.concatenate([[edge], common[1:]])
                deal(r, places, common, False)
                yield r, places, common, np.zeros(len(places), bool)
        self.spilled += queues.spilled

    def both_ways(self, seeds, with_common: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes but the sentinel's, the greatest first, with the common prefix with the one before."""
        larger, ends = Tuples(self.scratch, self.kind, self.held), np.zeros(len(self.single) + 1, np.int64)
        for r, places, common, induced in self.induce(seeds, True, with_common):
            if induced.any():
                larger.append((places[induced], self._among(places, common, induced, with_common)))
                ends[r + 1] = larger.size
        ends = np.maximum.accumulate(ends).tolist()
        back = lambda r: larger.backwards(ends[r], ends[r + 1], self.block)
        for _, places, common, _ in self.induce(back, False, with_common):
            yield places, common
        larger.delete()

    @staticmethod
    def _among(places: np.ndarray, common: np.ndarray, chosen: np.ndarray, with_common: bool) -> np.ndarray:
        """Common prefixes of the chosen with the chosen before; those between stand at ends of symbols only."""
        if not with_common or chosen.all():
            return common[chosen]
        at = np.flatnonzero(chosen)
        out = common[at]
        gap = np.flatnonzero(np.diff(at, prepend=at[0]) > 1)
        out[gap] = _least(_least_table(common), at[gap - 1] + 1, at[gap])
        return out

    def sorted_lms(self) -> tuple[Tuples, np.ndarray]:
        """LMS suffixes, the greatest first, with their common prefixes; and how many are in each range."""
        up = self.smaller()
        lms = self.lms(up)
        m = len(lms)
        out, sizes = Tuples(self.scratch, self.kind, self.held), np.zeros(len(self.single), np.int64)

        def keep(places: np.ndarray, common: np.ndarray) -> None:
            sizes[:] += np.bincount(self.ranges(self.text[places]), minlength=len(sizes))
            out.append((places, common))

        if m == 1:
            keep(lms[:1], np.zeros(1, np.int64))
            return out, sizes
        # substrings of LMS places, in order and named
        seeds = Queues(self.scratch, self.kind, self.held)
        for start in range(0, m, self.block):
            part = lms[start : start + self.block]
            to = self.ranges(self.text[part])
            by = np.argsort(to, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], to[by][1:] != to[by][:-1]]))
            for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(by)], strict=True):
                seeds.push(int(to[by[s]]), part[by[s:e]], np.zeros(e - s, np.int64))

        def unsorted(r: int):
            got = []
            while (part := seeds.take(r, self.block)) is not None:
                if self.single[r]:
                    yield part
                else:
                    got.append(part[0])
            if got:
                places = np.concatenate(got)
                yield places[np.argsort(self.text[places], kind="stable")], np.zeros(len(places), np.int64)

        sorted_places = Tuples(self.scratch, self.kind, self.held)
        names = self.scratch.array(m, self.kind)
        cuts, run, distinct, before = Cuts(self.block), 0, 0, None

        def substrings():
            for places, _ in self.both_ways(unsorted, False):
                yield places[up[places] & ~up[np.maximum(places - 1, 0)] & (places > 0)]
            yield np.array([len(self.text) - 1])

        for places in substrings():
            if not len(places):
                continue
            index = np.searchsorted(lms, places.astype(lms.dtype))  # of its own kind: it would be copied whole otherwise
            size = np.minimum(self._after(lms, index) + 1 - places, self.limit)
            a = np.concatenate([[places[0] if before is None else before[0]], places[:-1]])
            a_size = np.concatenate([[-1 if before is None else before[1]], size[:-1]])
            same = a_size == size
            at = np.flatnonzero(same)
            same[at] = self.shared(a[at], places[at]) >= size[at]
            name = distinct - 1 + np.cumsum(~same)
            edges = np.flatnonzero(~same)
            if len(edges):
                runs = np.diff(np.append(edges, len(places)))
                cuts.feed(np.concatenate([[run + edges[0]], runs[:-1]]) if distinct else runs[:-1])
                run = int(runs[-1])
            else:
                run += len(places)
            distinct = int(name[-1]) + 1
            names[index] = name
            sorted_places.append((places, np.zeros(len(places), np.int64)))
            before = (int(places[-1]), int(size[-1]))
        cuts.feed(np.array([run]))
        if distinct == m:
            blocks = (sorted_places.read(s, min(m, s + self.block)) for s in range(0, m, self.block))
            last = None
            for places, common in blocks:
                a = np.concatenate([[places[0] if last is None else last], places[:-1]])
                common = self.shared(a, places)
                common[0] = 0 if last is None else common[0]
                keep(places, common)
                last = int(places[-1])
            sorted_places.delete()
            return out, sizes
        string = self.scratch.array(m, np.uint32 if distinct < 1 << 32 else np.int64)
        for start in range(0, m, self.block):
            string[start : start + self.block] = distinct - 1 - names[start : start + self.block]
        sorted_places.delete()
        del names
        deeper = Level(string, distinct, cuts.upwards(distinct), self.limit // 2 + 1, self.scratch, self.block, self.held)
        last = None
        for index, common in deeper.sorted():
            places = lms[index]
            a = np.concatenate([[index[0] if last is None else last], index[:-1]])
            known = np.minimum(lms[np.minimum(index + common, m - 1)] - places, lms[np.minimum(a + common, m - 1)] - lms[a])
            shared = self.shared(lms[a], places, known)
            if last is None:
                shared[0] = 0
            keep(places, shared)
            last = int(index[-1])
        self.spilled += deeper.spilled
        return out, sizes

    def _after(self, lms: np.ndarray, index: np.ndarray) -> np.ndarray:
        """The next LMS place of each, the sentinel for the last."""
        return np.where(index + 1 < len(lms), lms[np.minimum(index + 1, len(lms) - 1)], len(self.text) - 1)

    def sorted(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All places, the greatest suffix first, with the common prefix with the one before."""
        lms, sizes = self.sorted_lms()
        # greatest first in the file: range r ends where the greater ranges' suffixes do
        ends = np.cumsum(sizes[::-1])[::-1]
        seeds = lambda r: lms.backwards(int(ends[r] - sizes[r]), int(ends[r]), self.block)
        yield from self.both_ways(seeds, True)
        yield np.array([len(self.text) - 1]), np.zeros(1, np.int64)


class Cuts:
    """Ranges of names, fed with their counts from the greatest name on: several of at most ``block`` places together, or one name."""

    def __init__(self, block: int):
        self.block, self.ends, self.names, self.total = block, [], 0, 0

    def feed(self, counts: np.ndarray) -> None:
        sums, at = np.concatenate([[0], np.cumsum(counts)]), 0
        while at < len(counts):
            to = max(at, int(np.searchsorted(sums, sums[at] + self.block - self.total, side="right")) - 1)
            self.total += int(sums[to] - sums[at])
            at = to
            if at < len(counts):
                alone = not self.total
                at += alone
                self.ends.append(self.names + at)
                self.total = 0
        self.names += len(counts)

    def upwards(self, distinct: int) -> np.ndarray:
        """The first name of each range, in ascending order of names."""
        ends = self.ends + ([distinct] if self.total else [])
        return distinct - np.array(ends)[::-1]


def bytes_level(text: np.ndarray, symbols: int, limit: int, scratch: Scratch, block: int = BLOCK, held: int = HELD) -> Level:
    """A text of few symbols, each a range of its own; it ends with a sentinel that is unique and least."""
    return Level(text, symbols, np.arange(symbols), limit, scratch, block, held)


def suffix_order(text: np.ndarray, limit: int, block: int = BLOCK, held: int = HELD) -> np.ndarray:
    """Places of all suffixes in order; the text ends with a sentinel that is unique and least."""
    with Scratch() as scratch:
        level = bytes_level(text, int(text.max()) + 1, limit, scratch, block, held)
        return np.concatenate([places for places, _ in level.sorted()])[::-1]


def repeated_starts(text: np.ndarray, symbols: int, width: int, scratch: Scratch, block: int = BLOCK, held: int = HELD) -> np.ndarray:
    """Flags on disk: places whose suffix shares its first ``width`` symbols with another's.

    text: symbols below ``symbols``, with a unique least sentinel at the end.
    """
    out = scratch.array(len(text), np.bool_)
    last = None
    for places, common in bytes_level(text, symbols, width, scratch, block, held).sorted():
        hit = np.flatnonzero(common >= width)
        if len(hit):
            out[places[hit]] = True
            out[places[hit[hit > 0] - 1]] = True
            if not hit[0]:
                out[last] = True
        last = int(places[-1])
    return out
