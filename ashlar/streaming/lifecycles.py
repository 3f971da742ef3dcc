"""Lifecycles as event-time state: hand-offs of sessions and event streams of jobs.

Rows of a key may arrive in any order over any number of micro-batches, while they
are no later than the watermark. They wait in the key's state until the watermark
has passed them, and are then taken in order of time and id, so that the outcome is
that of the batch form whatever the batches were. Timers end what nothing else ends.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How long rows may be late, and after how long a job's stream ends without a terminal row (the mark that it has ended goes after twice that).
DELAY = "1 hour"
CAP_MS = 3_600_000
TERMINAL = ("done", "error", "cancelled")


class Waiting(StatefulProcessor):
    """Holds rows by (time, id) until the watermark has passed them; ``take`` sees each once, in order."""

    VALUE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "at_ms long, id long", self.VALUE)
        self.ready()

    def ready(self) -> None:
        """Further state."""

    def held(self, row: Row) -> tuple:
        """What is kept of a row."""
        raise NotImplementedError

    def take(self, key: tuple, at_ms: int, number: int, value: tuple) -> Iterator[Row]:
        raise NotImplementedError

    def expired(self, key: tuple, at_ms: int) -> Iterator[Row]:
        """What a timer ends, after the rows up to its time."""
        return iter(())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            if not self.rows.containsKey((row.at_ms, row.event_id)):  # a repeated row is the same row
                self.rows.updateValue((row.at_ms, row.event_id), self.held(row))
                self.handle.registerTimer(row.at_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((tuple(k), tuple(v)) for k, v in self.rows.iterator() if k[0] <= until)
        for (at_ms, number), value in due:
            self.rows.removeKey((at_ms, number))
            yield from self.take(key, at_ms, number, value)
        yield from self.expired(key, until)


class Handoffs(Waiting):
    """At most one open hand-off a session: further opens while one is open change nothing, a resolve closes it."""

    VALUE = "action string, reason string"
    OUT = "session_id long, id long, reason string, status string, created_at long, resolved_at long"

    def ready(self) -> None:
        self.opened = self.handle.getValueState("opened", "id long, reason string, created_at long")

    def held(self, row: Row) -> tuple:
        return row.action, row.reason

    def take(self, key: tuple, at_ms: int, number: int, value: tuple) -> Iterator[Row]:
        action, reason = value
        if action == "open" and not self.opened.exists():
            self.opened.update((number, reason, at_ms))
            yield Row(session_id=key[0], id=number, reason=reason, status="open", created_at=at_ms, resolved_at=None)
        elif action == "resolve" and self.opened.exists():
            first, why, since = self.opened.get()
            self.opened.clear()
            yield Row(session_id=key[0], id=first, reason=why, status="resolved", created_at=since, resolved_at=at_ms)


class Jobs(Waiting):
    """A job's rows up to its first terminal one, or to ``CAP_MS`` after its first row; what comes behind is dropped."""

    VALUE = "status string"
    OUT = "job_id long, event_id long, status string, at_ms long"

    def ready(self) -> None:
        self.begun = self.handle.getValueState("begun", "at_ms long, ended boolean")

    def held(self, row: Row) -> tuple:
        return (row.status,)

    def take(self, key: tuple, at_ms: int, number: int, value: tuple) -> Iterator[Row]:
        if not self.begun.exists():
            self.begun.update((at_ms, False))
            self.handle.registerTimer(at_ms + CAP_MS)
        since, ended = self.begun.get()
        if ended or at_ms >= since + CAP_MS:
            return
        if value[0] in TERMINAL:
            self.begun.update((since, True))
        yield Row(job_id=key[0], event_id=number, status=value[0], at_ms=at_ms)

    def expired(self, key: tuple, at_ms: int) -> Iterator[Row]:
        if not self.begun.exists():
            return
        since, ended = self.begun.get()
        if at_ms >= since + 2 * CAP_MS:
            self.begun.clear()
        elif at_ms == since + CAP_MS:  # the mark stays as long again, so that stragglers do not begin the job anew
            self.begun.update((since, True))
            self.handle.registerTimer(since + 2 * CAP_MS)
            if not ended:
                yield Row(job_id=key[0], event_id=-1, status="timeout", at_ms=since + CAP_MS)


def _timed(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("_at", F.timestamp_millis("at_ms")).withWatermark("_at", delay)


def handoff_lifecycle(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Changes of hand-offs of a stream of (event_id, session_id, action, reason, at_ms); the state store must be RocksDB's.

    Rows later than the watermark are dropped, as in every windowed aggregate.
    """
    return _timed(events, delay).groupBy("session_id").transformWithState(Handoffs(), Handoffs.OUT, "Append", "EventTime")


def job_lifecycle(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """The rows of jobs that their readers see, from a stream of (event_id, job_id, status, at_ms); a job without an end gets a row 'timeout'."""
    return _timed(events, delay).groupBy("job_id").transformWithState(Jobs(), Jobs.OUT, "Append", "EventTime")
