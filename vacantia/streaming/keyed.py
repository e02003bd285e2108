"""Keyed state of streams: processors whose batches touch only the keys that they hold."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from math import floor

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor


class Windows:
    """Observation windows of one run, told its activity in order: (first, last, count) of each window that is over.

    A window ends when nothing happens for ``gap``, or ``longest`` after its first activity; what comes then opens the next."""

    def __init__(self, gap: int, longest: int, window=None):
        self.gap, self.longest, self.window = gap, longest, window

    def add(self, time: int):
        """Take an activity; the window that it finds over, if any."""
        over = self.settle(time)
        first, _, count = self.window or (time, time, 0)
        self.window = (first, time, count + 1)
        return over

    def end(self) -> int | None:
        """When the open window ends if nothing more happens."""
        return min(self.window[1] + self.gap, self.window[0] + self.longest) if self.window else None

    def settle(self, time: int):
        """The open window if it is over by then."""
        over = self.window if self.window and time >= self.end() else None
        if over:
            self.window = None
        return over

    def described(self, window, shortest: int) -> tuple:
        """(first, last, activities, observed seconds, ended by) of a window."""
        first, last, count = window
        if last + self.gap > first + self.longest:
            return first, last, count, self.longest / 1e6, "MAX_OBSERVATION"
        return first, last, count, floor((last - first) / 1e6 * 1000 + 0.5) / 1000, "BELOW_MINIMUM" if last - first < shortest else "QUIET"


def moment(micros: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


WINDOW_COLUMNS = ["first_at", "last_at", "activities", "observed_seconds", "ended_by"]


class QuietPeriods(StatefulProcessor):
    """Observation windows by event time: a run keeps its open window and the activity that the watermark has not passed.

    A timer stands at the end of the window, so it closes there, whether or not the run goes on."""

    def __init__(self, run: str, shortest: int, gap: int, longest: int):
        self.run, self.shortest, self.gap, self.longest = run, shortest, gap, longest

    def init(self, handle):
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, count long, timer long")
        self.pending = handle.getListState("pending", "time long")

    def _advance(self, key, times, watermark_ms: int):
        first, last, count, timer = self.open.get() if self.open.exists() else (None, None, None, None)
        known = Windows(self.gap, self.longest, (first, last, count) if first is not None else None)
        limit, out = watermark_ms * 1000, []
        for time in sorted(t for t in times if t < limit):
            out.append(known.add(time))
        out.append(known.settle(limit))
        later = [t for t in times if t >= limit]
        self.pending.clear()
        if later:
            self.pending.put([(t,) for t in later])
        ends = [t for t in (known.end(), min(later, default=None)) if t is not None]
        due = max(watermark_ms + 1, -(-min(ends) // 1000) + 1) if ends else None
        if timer is not None and timer != due and timer > watermark_ms:
            self.handle.deleteTimer(timer)
        if due is not None and due != timer:
            self.handle.registerTimer(due)
        if due is None:
            self.open.clear()
        else:
            self.open.update((*(known.window or (None, None, None)), due))
        for window in filter(None, out):
            first, last, *rest = known.described(window, self.shortest)
            yield Row(**dict(zip([self.run, *WINDOW_COLUMNS], [key[0], *map(moment, (first, last)), *rest])))

    def handleInputRows(self, key, rows, timerValues):
        times = [row.time for row in rows]
        times += [t for (t,) in self.pending.get()]
        yield from self._advance(key, times, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._advance(key, [t for (t,) in self.pending.get()], timerValues.getCurrentWatermarkInMs())

    def close(self):
        pass


def window_scan(shortest: int, gap: int, longest: int):
    """Batches of (run, time), ordered by both, to observation windows."""
    def run(batches):
        import pyarrow as pa

        known, now, started, out, kind = None, None, False, [], None

        def emit():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), *[pa.array(columns[i], pa.timestamp("us", "UTC")) for i in (1, 2)], pa.array(columns[3], pa.int64()),
                 pa.array(columns[4], pa.float64()), pa.array(columns[5], pa.string())], [name, *WINDOW_COLUMNS])

        for batch in batches:
            kind, name = batch.schema.field(0).type, batch.schema.names[0]
            for key, time in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not started or key != now:
                    if started and known.window:
                        out.append((now, *known.described(known.window, shortest)))
                    known, now, started = Windows(gap, longest), key, True
                over = known.add(time)
                if over:
                    out.append((now, *known.described(over, shortest)))
            if len(out) >= 10_000:
                yield emit()
                out.clear()
        if started and known.window:
            out.append((now, *known.described(known.window, shortest)))
        if out:
            yield emit()

    return run
