"""Keyed state over streams, by transformWithState: usage of a month, credits of an hour, and keys that expire."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quire.operators.fold import grants

HOUR = 3_600_000_000  # microseconds


def in_order(pdfs: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """A key's rows of one trigger, sorted: they come in several chunks in any order. The source's rate bounds a trigger."""
    return pd.concat(pdfs, ignore_index=True).sort_values([by, "event_id"], ignore_index=True)


class MonthlyUse(StatefulProcessor):
    """Month-to-date cost and level of each call of a user: user_id, event_id, month, used, level.

    A trigger's rows are charged by time and event_id, after all rows of earlier triggers. A late row, of a month that has passed or before rows
    of earlier triggers, is charged to its own month, on top of all that came before it; what was put out before stays.
    """

    def __init__(self, limit: float):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getMapState("used", "month string", "used double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = in_order(rows, "ts")
        pdf["month"] = pdf["ts"].dt.strftime("%Y-%m")
        used = pdf.groupby("month")["cost"].cumsum()
        for month in pdf["month"].unique():
            own = pdf["month"] == month
            before = self.used.getValue((month,))
            used[own] += before[0] if before else 0.0
            self.used.updateValue((month,), (float(used[own].iloc[-1]),))
        share = used / self.limit * 100
        level = np.select([share >= 100, share >= 90, share >= 70], [3, 2, 1], 0).astype("int32")
        yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"], "month": pdf["month"], "used": used.round(9), "level": level})

    def close(self) -> None:
        pass


class HourlyCredits(StatefulProcessor):
    """Whether each call of a user is granted: user_id, event_id, granted. `size` credits for an hour from first use; a refused call costs nothing.

    A trigger's rows are taken by time and event_id. A late row, before the hour that the state holds, draws on that hour.
    """

    def __init__(self, size: int = 100):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "since long, credits long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = in_order(rows, "us")
        state = self.bucket.get() if self.bucket.exists() else None
        granted, state = grants(pdf["us"].to_numpy(), pdf["cost"].to_numpy(), tuple(state) if state else None, self.size, HOUR)
        self.bucket.update((int(state[0]), int(state[1])))
        yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"], "granted": granted})

    def close(self) -> None:
        pass


class TrailingCalls(StatefulProcessor):
    """Calls of a user in each trailing `width` hours that hold one, hour by hour: user_id, until (microseconds), n (those that count).

    The state holds a number for each hour with a call instead of one for each window, `width` of which hold a call. A window is put out
    when the watermark has passed its end, and once only; a row counts for those that are still to come.
    """

    def __init__(self, width: int = 24):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getValueState("hours", "done long, hour binary, n binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done, hour, n = self._state(timerValues)
        due = self._due(done, hour)
        for pdf in rows:
            hour, at = np.unique(np.concatenate([hour, pdf["us"].to_numpy(np.int64) // HOUR]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, pdf["counts"].to_numpy(np.int64)])).astype(np.int64)  # whole numbers under 2^53
        self._keep(done, hour, n, due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done, hour, n = self._state(timerValues)
        now = max(done, timerValues.getCurrentWatermarkInMs() * 1000 // HOUR)
        until = np.unique(np.concatenate([own[(own > done) & (own <= now)] for own in (hour + k for k in range(1, self.width + 1))]))
        total = np.concatenate([[0], np.cumsum(n)])
        calls = total[np.searchsorted(hour, until)] - total[np.searchsorted(hour, until - self.width)]
        left = hour > now - self.width
        self._keep(now, hour[left], n[left], None)
        yield pd.DataFrame({"user_id": key[0], "until": until * HOUR, "n": calls})

    def _state(self, timerValues) -> tuple[int, np.ndarray, np.ndarray]:
        """Hour up to which windows are done, hours and their numbers. A user without state starts at the watermark."""
        state = self.hours.get()
        if state:
            return state[0], np.frombuffer(state[1], np.int64), np.frombuffer(state[2], np.int64)
        return timerValues.getCurrentWatermarkInMs() * 1000 // HOUR, np.empty(0, np.int64), np.empty(0, np.int64)

    def _due(self, done: int, hour: np.ndarray) -> int | None:
        """When the first window that is not done ends."""
        return (max(int(hour[0]), done) + 1) * (HOUR // 1000) if len(hour) else None

    def _keep(self, done: int, hour: np.ndarray, n: np.ndarray, before: int | None) -> None:
        own = hour > done - self.width
        hour, n = hour[own], n[own]
        due = self._due(done, hour)
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if due is None:
            self.hours.clear()
            return
        self.hours.update((int(done), hour.tobytes(), n.tobytes()))
        if before != due:
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


class LastSeen(StatefulProcessor):
    """Keys that had no row for `idle` ms of event time: user_id, last_seen, n (their rows). Such a key starts anew.

    Late rows count while their key is there; what is later than the watermark is dropped by Spark where a query asks for that.
    """

    def __init__(self, idle: int = 7_200_000):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, n = tuple(self.seen.get()) if self.seen.exists() else (0, 0)
        if last:
            self.handle.deleteTimer(self._due(last))
        for pdf in rows:
            last, n = max(last, int(pdf["us"].max())), n + len(pdf)
        self.seen.update((last, n))
        self.handle.registerTimer(self._due(last))
        return iter(())

    def _due(self, last: int) -> int:
        return last // 1000 + self.idle

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, n = tuple(self.seen.get())
        self.seen.clear()
        yield pd.DataFrame({"user_id": [key[0]], "last_seen": [pd.Timestamp(last, unit="us")], "n": [n]})

    def close(self) -> None:
        pass


class Recent(StatefulProcessor):
    """The running number of each key's rows: user_id, n. A key without rows for `ttl` ms of the clock loses its state, by the state store's own TTL, and starts anew."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = (self.count.get()[0] if self.count.exists() else 0) + sum(len(pdf) for pdf in rows)
        self.count.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    def close(self) -> None:
        pass
