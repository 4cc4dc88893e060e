"""Statistics of sliding windows, sample by sample, at a cost that does not grow with the window.

Statistics that merge (sum, mean, max, min, variance, ...) keep blocks of as many samples as the window has: a window is
the tail of one block and the head of the next, the head is carried on and the tails are made once, when a block is
full. Nothing is ever subtracted, so a spike leaves no trace once it has left the window. Order statistics and the mode
keep the window's values counted and sorted, in chunks of bounded size under a directory.

What has to outlive a call (samples, heads, tails, chunks) lies in pages, so a caller that keeps them elsewhere, as
streaming state does, reads and writes the touched pages only.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np

PAGE = 256
# Windows up to so many samples are looked at one by one: that is cheaper, and bounded as well.
NARROW = 32
CHUNK = 128
# Cells of the narrow windows that are laid side by side at a time.
WINDOW_CELLS = 1 << 20

MERGED = ("sum", "mean", "count", "max", "min", "abs_max", "variance", "std")
PARTS = {"variance": 4, "std": 4}  # origin, sum and sum of squares of the distances to it, count; one number for the others

Key = tuple[str, int]


class Pages:
    """Pages by key, read when first asked for; ``changes`` are those put or dropped since."""

    def __init__(self, read: Callable[[Key], list[float] | None] = lambda key: None):
        self.read, self.held, self.changed, self.stored = read, {}, set(), set()

    def get(self, key: Key) -> list[float]:
        if key not in self.held:
            self.held[key] = self.read(key)
            if self.held[key] is not None:
                self.stored.add(key)
        return self.held[key] or []

    def put(self, key: Key, page: list[float]) -> None:
        self.held[key] = page
        self.changed.add(key)

    def drop(self, key: Key) -> None:
        self.get(key)
        self.held[key] = None
        self.changed.add(key) if key in self.stored else self.changed.discard(key)

    def changes(self) -> Iterator[tuple[Key, list[float] | None]]:
        for key in sorted(self.changed):
            yield key, self.held[key]
        self.changed = set()


class Row:
    """A growing row of numbers in pages of PAGE places, of which the last ones are kept."""

    def __init__(self, pages: Pages, name: str, width: int = 1):
        self.pages, self.name, self.width = pages, name, width

    def slice(self, first: int, last: int) -> np.ndarray:
        """Places first to last; they must still be kept."""
        if last <= first:
            return np.zeros((0, self.width))
        found = [self.pages.get((self.name, p)) for p in range(first // PAGE, (last - 1) // PAGE + 1)]
        flat = np.array([x for page in found for x in page], float).reshape(-1, self.width)
        at = first - first // PAGE * PAGE
        return flat[at : at + last - first]

    def append(self, at: int, values: np.ndarray) -> None:
        """Values for the places from ``at`` on."""
        values = values.reshape(-1, self.width)
        end, start = at + len(values), at
        while start < end:
            page, stop = start // PAGE, min(end, (start // PAGE + 1) * PAGE)
            before = self.pages.get((self.name, page))[: (start - page * PAGE) * self.width]
            before = before + [0.0] * ((start - page * PAGE) * self.width - len(before))  # places nobody will ask for
            self.pages.put((self.name, page), before + values[start - at : stop - at].ravel().tolist())
            start = stop

    def forget(self, before: int, known_from: int) -> None:
        """Drop the pages that end by ``before``; none ends by ``known_from``."""
        for page in range(max(0, known_from) // PAGE, max(0, before) // PAGE):
            self.pages.drop((self.name, page))


def one_by_one(samples: np.ndarray, width: int, statistic: str, quantile: float) -> np.ndarray:
    """The statistic of the window that ends at each sample, each on its own."""
    padded = np.concatenate([np.full(width - 1, np.nan), samples])
    if not len(samples):
        return np.empty(0)
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    step = max(1, WINDOW_CELLS // width)
    return np.concatenate([_over(windows[at : at + step], statistic, quantile) for at in range(0, len(windows), step)])


def _over(windows: np.ndarray, statistic: str, quantile: float) -> np.ndarray:
    match statistic:
        case "mean":
            return np.nanmean(windows, axis=1)
        case "sum":
            return np.nansum(windows, axis=1)
        case "count":
            return (~np.isnan(windows)).sum(axis=1).astype(float)
        case "max":
            return np.nanmax(windows, axis=1)
        case "min":
            return np.nanmin(windows, axis=1)
        case "abs_max":
            return np.nanmax(np.abs(windows), axis=1)
        case "variance" | "std":
            count = (~np.isnan(windows)).sum(axis=1)
            squares = np.nansum((windows - np.nanmean(windows, axis=1, keepdims=True)) ** 2, axis=1)
            out = np.where(count > 1, squares / np.maximum(count - 1, 1), np.nan)
            return np.sqrt(out) if statistic == "std" else out
        case "quantile":
            return np.nanquantile(windows, quantile, axis=1)
        case "iqr":
            low, high = np.nanquantile(windows, [0.25, 0.75], axis=1)
            return high - low
    ordered = np.sort(windows, axis=1)  # the mode; NaN last
    new = np.ones(ordered.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    place = np.arange(ordered.shape[1])
    run = place - np.maximum.accumulate(np.where(new, place, 0), axis=1) + 1
    run[np.isnan(ordered)] = 0
    return ordered[np.arange(len(ordered)), run.argmax(axis=1)]  # the first longest run is that of the smallest value


def _runs(values: np.ndarray, statistic: str, start: np.ndarray | None) -> np.ndarray:
    """The parts of values[:1], values[:2], ..., after what ``start`` stands for."""
    values = values.astype(float)
    if statistic in ("variance", "std"):
        origin, s1, s2, n = start if start is not None else (values[0], 0.0, 0.0, 0.0)
        d = values - origin
        return np.column_stack((np.full(len(d), origin), s1 + np.cumsum(d), s2 + np.cumsum(d * d), n + np.arange(1, len(d) + 1)))
    if statistic in ("sum", "mean", "count"):
        out = np.cumsum(values if statistic != "count" else np.ones(len(values)))
        return (out + (0.0 if start is None else start[0]))[:, None]
    values = np.abs(values) if statistic == "abs_max" else values
    pick = np.minimum if statistic == "min" else np.maximum
    out = pick.accumulate(values)
    return (out if start is None else pick(out, start[0]))[:, None]


def _merged(head: np.ndarray, tail: np.ndarray | None, statistic: str, count: np.ndarray) -> np.ndarray:
    """The statistic of windows of ``count`` samples from the parts of their heads and, if they have one, tails."""
    if statistic in ("variance", "std"):
        mean = lambda p: p[:, 0] + p[:, 1] / p[:, 3]
        squares = lambda p: np.maximum(p[:, 2] - p[:, 1] ** 2 / p[:, 3], 0.0)
        m2 = squares(head)
        if tail is not None:
            m2 = m2 + squares(tail) + (mean(head) - mean(tail)) ** 2 * (head[:, 3] * tail[:, 3] / (head[:, 3] + tail[:, 3]))
        out = np.where(count > 1, m2 / np.maximum(count - 1, 1), np.nan)
        return np.sqrt(out) if statistic == "std" else out
    own = head[:, 0]
    if tail is not None:
        own = own + tail[:, 0] if statistic in ("sum", "mean", "count") else np.minimum(own, tail[:, 0]) if statistic == "min" else np.maximum(own, tail[:, 0])
    return own / count if statistic == "mean" else own


class Merged:
    """Windows of ``width`` samples of a statistic that merges."""

    def __init__(self, pages: Pages, name: str, width: int, statistic: str):
        self.pages, self.name, self.width, self.statistic = pages, name, width, statistic
        self.tails = Row(pages, f"{name}t", PARTS.get(statistic, 1))

    def extend(self, samples: Row, seen: int, values: np.ndarray) -> np.ndarray:
        """The statistic after each of the new values, which follow ``seen`` samples."""
        w, out, at = self.width, [], 0
        while at < len(values):
            first = seen + at
            block = first // w
            some = values[at : at + (block + 1) * w - first]
            start = self.pages.get((f"{self.name}h", 0)) if first % w else None
            heads = _runs(some, self.statistic, start)
            last = first + len(some)
            count = np.minimum(np.arange(first + 1, last + 1), w)
            if block == 0:
                out.append(_merged(heads, None, self.statistic, count))
            else:
                own = min(last, (block + 1) * w - 1)  # the last window of a block has no tail
                merged = _merged(heads[: own - first], self.tails.slice(first + 1 - w, own + 1 - w), self.statistic, count[: own - first])
                out.append(np.concatenate((merged, _merged(heads[own - first :], None, self.statistic, count[own - first :]))))
            if last % w == 0:
                whole = samples.slice(last - w, last)[:, 0]
                self.tails.append(last - w, _runs(whole[::-1], self.statistic, None)[::-1])
                self.tails.forget(last - w, last - 3 * w)
            self.pages.put((f"{self.name}h", 0), heads[-1].tolist())
            at += len(some)
        return np.concatenate(out) if out else np.empty(0)


class Counted:
    """Values with their counts, sorted, in chunks of at most 2 * CHUNK distinct values.

    The directory has, per chunk: its page, its least value, how many values it counts, the highest count and the least
    value that has it.
    """

    def __init__(self, pages: Pages, name: str):
        self.pages, self.name = pages, name
        flat = pages.get((f"{name}d", 0))
        n = len(flat) // 5
        self.page, self.least, self.total, self.top, self.mode_of = (flat[i * n : (i + 1) * n] for i in range(5))
        self.free = int(max(self.page, default=-1)) + 1
        self.open: dict[int, tuple[list[float], list[float]]] = {}

    def _chunk(self, i: int) -> tuple[list[float], list[float]]:
        page = int(self.page[i])
        if page not in self.open:
            flat = self.pages.get((f"{self.name}c", page))
            self.open[page] = flat[: len(flat) // 2], flat[len(flat) // 2 :]
        return self.open[page]

    def _told(self, i: int) -> None:
        values, counts = self._chunk(i)
        best = max(counts)
        self.least[i], self.top[i], self.mode_of[i] = values[0], best, values[counts.index(best)]
        self.pages.changed.add((f"{self.name}c", int(self.page[i])))

    def add(self, value: float) -> None:
        i = max(0, bisect_right(self.least, value) - 1)
        if not self.page:
            self._insert(0, [value], [1.0])
            return
        values, counts = self._chunk(i)
        at = bisect_left(values, value)
        if at < len(values) and values[at] == value:
            counts[at] += 1.0
        else:
            values.insert(at, value)
            counts.insert(at, 1.0)
        self.total[i] += 1.0
        self._told(i)
        if len(values) > 2 * CHUNK:
            right = values[CHUNK:], counts[CHUNK:]
            del values[CHUNK:], counts[CHUNK:]
            self.total[i] = sum(counts)
            self._told(i)
            self._insert(i + 1, *right)

    def _insert(self, i: int, values: list[float], counts: list[float]) -> None:
        self.open[self.free] = values, counts
        for column, x in zip((self.page, self.least, self.total, self.top, self.mode_of), (float(self.free), 0.0, sum(counts), 0.0, 0.0)):
            column.insert(i, x)
        self.free += 1
        self._told(i)

    def remove(self, value: float) -> None:
        i = bisect_right(self.least, value) - 1
        values, counts = self._chunk(i)
        at = bisect_left(values, value)
        counts[at] -= 1.0
        self.total[i] -= 1.0
        if not counts[at]:
            del values[at], counts[at]
        if values:
            self._told(i)
            return
        self.pages.drop((f"{self.name}c", int(self.page[i])))
        self.open.pop(int(self.page[i]))
        for column in (self.page, self.least, self.total, self.top, self.mode_of):
            del column[i]

    def _at(self, place: int) -> float:
        ends = list(accumulate(self.total))
        i = bisect_right(ends, place)
        values, counts = self._chunk(i)
        return values[bisect_right(list(accumulate(counts)), place - (ends[i - 1] if i else 0))]

    def quantile(self, q: float) -> float:
        place = q * (sum(self.total) - 1)
        low, part = math.floor(place), place - math.floor(place)
        first = self._at(low)
        return first + (self._at(low + 1) - first) * part if part else first

    def mode(self) -> float:
        """The least of the most frequent values."""
        return self.mode_of[self.top.index(max(self.top))]

    def close(self) -> None:
        """Put what was changed back into pages."""
        for page in {int(p) for p in self.page}:
            if page in self.open and (f"{self.name}c", page) in self.pages.changed:
                values, counts = self.open[page]
                self.pages.put((f"{self.name}c", page), values + counts)
        self.pages.put((f"{self.name}d", 0), [*self.page, *self.least, *self.total, *self.top, *self.mode_of])


class Ranked:
    """Windows of ``width`` samples of an order statistic or the mode."""

    def __init__(self, pages: Pages, name: str, width: int, statistic: str, quantile: float):
        self.pages, self.name, self.width, self.statistic, self.q = pages, name, width, statistic, quantile

    def extend(self, samples: Row, seen: int, values: np.ndarray) -> np.ndarray:
        counted, out = Counted(self.pages, self.name), np.empty(len(values))
        gone = iter(samples.slice(max(0, seen - self.width), max(0, seen + len(values) - self.width))[:, 0].tolist())
        for i, value in enumerate(values.tolist()):
            if seen + i >= self.width:
                counted.remove(next(gone))
            counted.add(value)
            if self.statistic == "mode":
                out[i] = counted.mode()
            elif self.statistic == "iqr":
                out[i] = counted.quantile(0.75) - counted.quantile(0.25)
            else:
                out[i] = counted.quantile(self.q)
        counted.close()
        return out


class Narrow:
    """Windows of few samples, one by one."""

    def __init__(self, width: int, statistic: str, quantile: float):
        self.width, self.statistic, self.q = width, statistic, quantile

    def extend(self, samples: Row, seen: int, values: np.ndarray) -> np.ndarray:
        before = samples.slice(max(0, seen - self.width + 1), seen)[:, 0]
        return one_by_one(np.concatenate((before, values)), self.width, self.statistic, self.q)[len(before) :]


def window(pages: Pages, name: str, width: int, statistic: str, quantile: float) -> Merged | Ranked | Narrow:
    if width <= NARROW:
        return Narrow(width, statistic, quantile)
    return Merged(pages, name, width, statistic) if statistic in MERGED else Ranked(pages, name, width, statistic, quantile)


def rolled(samples: np.ndarray, width: int, statistic: str, quantile: float = 0.5) -> np.ndarray:
    """The statistic of the window of ``width`` samples that ends at each sample."""
    pages = Pages()
    row = Row(pages, "v")
    row.append(0, samples)
    return window(pages, "w", width, statistic, quantile).extend(row, 0, samples)


def over_ranges(values: np.ndarray, low: np.ndarray, high: np.ndarray, statistic: str, quantile: float = 0.5) -> np.ndarray:
    """The statistic of values[low:high] for windows whose ends never go back; NaN for an empty one, where counts are 0.

    For statistics that merge, a point is fixed that windows have in them one after another: what lies before it is
    gathered backwards once, what follows it forwards, and each window is one of these and one of those. When the
    windows have left the point behind, the next one is fixed. Every value is gathered twice at most.
    """
    size = high - low
    if statistic == "count":
        return size.astype(float)
    out = np.full(len(low), np.nan)
    live = np.flatnonzero(size > 0)
    if not len(live):
        return out
    low, high, size = low[live], high[live], size[live]
    widest = int(size.max())
    if widest <= NARROW:
        step = max(1, WINDOW_CELLS // widest)
        for at in range(0, len(live), step):
            place = high[at : at + step, None] - widest + np.arange(widest)
            windows = np.where(place >= low[at : at + step, None], values[np.maximum(place, 0)], np.nan)
            out[live[at : at + step]] = _over(windows, statistic, quantile)
    elif statistic in MERGED:
        at = 0
        while at < len(live):
            point = int(high[at])
            end = int(np.searchsorted(low, point, "left"))
            own = slice(at, end)
            tails = _runs(values[low[at] : point][::-1], statistic, None)[::-1][low[own] - low[at]]
            more = high[own] > point
            told = _merged(tails, None, statistic, size[own])
            if more.any():
                heads = _runs(values[point : high[end - 1]], statistic, None)[high[own][more] - 1 - point]
                told[more] = _merged(heads, tails[more], statistic, size[own][more])
            out[live[own]] = told
            at = end
    else:
        counted, first, last = Counted(Pages(), "c"), int(low[0]), int(low[0])
        listed = values.tolist()
        for i, (a, b) in zip(live.tolist(), zip(low.tolist(), high.tolist())):
            while last < b:
                counted.add(listed[last])
                last += 1
            while first < a:
                counted.remove(listed[first])
                first += 1
            out[i] = counted.mode() if statistic == "mode" else counted.quantile(0.75) - counted.quantile(0.25) if statistic == "iqr" else counted.quantile(quantile)
    return out
