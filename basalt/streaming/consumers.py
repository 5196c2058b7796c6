"""Consumer groups and run timeouts: keyed state with processing-time timers.

A delivery that isn't acknowledged in time is claimed again, by the next consumer of the group, as often as the group allows; then it is dead.
A run that neither completes nor fails in time is timed out. State lives in the query's checkpoint, so a restarted query goes on with its timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from basalt.tables import ship

#: The state store that keyed state with timers needs; set it on the session before the query starts.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

DELIVERIES = "message string, consumer int, delivery int, event string, at timestamp"
TIMEOUTS = "run string, status string, started timestamp, ended timestamp"


def _now(timers) -> int:
    return timers.getCurrentProcessingTimeInMs()


def _rows(rows: list[tuple], columns: list[str], times: list[str]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=columns)
    for c in times:
        made[c] = pd.to_datetime(made[c], unit="ms")
    return made


class _Group(StatefulProcessor):
    """One message: delivered when it arrives, again whenever it was idle too long, until it is acknowledged or dead."""

    def __init__(self, consumers: int, idle_ms: int, most: int):
        self.consumers, self.idle_ms, self.most = consumers, idle_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Deliveries so far; -1 once the message is settled.
        self.state = handle.getValueState("deliveries", "n int, consumer int")

    def _again(self, now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + self.idle_ms)

    def _settle(self) -> None:
        self.state.update((-1, 0))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        message, now, out = key[0], _now(timerValues), []
        kinds = {k for frame in rows for k in frame["event"]}
        n, consumer = self.state.get() if self.state.exists() else (0, 0)
        if "publish" in kinds and n == 0:
            n, consumer = 1, sum(message.encode()) % self.consumers
            self.state.update((n, consumer))
            self._again(now)
            out.append((message, consumer, n, "delivered", now))
        if "ack" in kinds and n > 0:
            self._settle()
            out.append((message, consumer, n, "acknowledged", now))
        yield _rows(out, ["message", "consumer", "delivery", "event", "at"], ["at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        message, now, out = key[0], _now(timerValues), []
        n, consumer = self.state.get() if self.state.exists() else (-1, 0)
        if n > 0:
            if n >= self.most:
                self._settle()
                out.append((message, consumer, n, "dead", now))
            else:
                n, consumer = n + 1, (consumer + 1) % self.consumers
                self.state.update((n, consumer))
                self._again(now)
                out.append((message, consumer, n, "claimed", now))
        yield _rows(out, ["message", "consumer", "delivery", "event", "at"], ["at"])

    def close(self) -> None:
        pass


def consumer_group(events: DataFrame, consumers: int, idle_seconds: float, most: int) -> DataFrame:
    """(message, consumer, delivery, event, at) for a stream of (message, event), event publish or ack.

    Events: delivered, claimed (idle for idle_seconds, handed to the next consumer), acknowledged, dead (idle at the last of `most`
    deliveries). A message is delivered once however often it is published; an acknowledgement before its message, or after it is settled, does nothing.
    """
    ship(events.sparkSession)
    return events.select("message", "event").groupBy("message").transformWithStateInPandas(_Group(consumers, int(idle_seconds * 1000), most), DELIVERIES, "Append", "ProcessingTime")


class _Runs(StatefulProcessor):
    """One run: open from its start to its end, or to the timeout."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "started long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = _now(timerValues), []
        kinds = [k for frame in rows for k in frame["status"]]
        started, ended = self.state.get() if self.state.exists() else (None, False)
        if started is None and "running" in kinds:
            started = now
            self.state.update((started, False))
            self.handle.registerTimer(now + self.ttl_ms)
        over = next((k for k in kinds if k in ("completed", "failed")), None)
        if over and not ended and started is not None:
            self.state.update((started, True))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            out.append((key[0], over, started, now))
        yield _rows(out, ["run", "status", "started", "ended"], ["started", "ended"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        started, ended = self.state.get() if self.state.exists() else (None, True)
        if not ended:
            self.state.update((started, True))
            out.append((key[0], "timeout", started, _now(timerValues)))
        yield _rows(out, ["run", "status", "started", "ended"], ["started", "ended"])

    def close(self) -> None:
        pass


def run_timeouts(runs: DataFrame, ttl_seconds: float) -> DataFrame:
    """(run, status, started, ended) for a stream of (run, status): each started run once, as completed, failed, or timeout when it ran for ttl_seconds without an end. What comes after a run's end does nothing."""
    ship(runs.sparkSession)
    return runs.select("run", "status").groupBy("run").transformWithStateInPandas(_Runs(int(ttl_seconds * 1000)), TIMEOUTS, "Append", "ProcessingTime")
