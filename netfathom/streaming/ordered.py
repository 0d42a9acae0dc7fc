"""Rules along a key's rows in the order of event time, whatever the order of arrival and the cut of micro-batches.

A row waits in the key's state until the watermark has passed it; then rows are released in order of time, and between them the
times at which a rule asked to be woken. So a stream gives what a table would, for all rows that come within the lateness;
later ones are dropped by the watermark. State of a key: the rows of one lateness, and the rule's own. Timers are event-time
timers at the next row or wake-up. Rows without a time are dropped. A state store that keeps many timers is needed
(``use_state_store``).
"""

from __future__ import annotations

import heapq
import pickle
from abc import ABC, abstractmethod
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..operators.devices import DWELL_MS, ENTER, LEAST, LEAVE, WINDOW_MS
from ..operators.faults import EVIDENCE_MS, QUIET_MS, SUSTAINED_MS
from ..operators.faults import LEAST as FAULT_LEAST
from ..operators.faults import WINDOW_MS as FAULT_WINDOW_MS
from ..operators.timeline import BRACKET_MS, CAP_MS

LATENESS = "3 minutes"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """The store of state that timers need; a cluster may set it for all its streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Rule(ABC):
    """What is held of one key. ``out`` is the schema of what it tells, without the keys. Rows are dictionaries."""

    out: str

    @abstractmethod
    def row(self, t: int, row: dict) -> Iterator[tuple]:
        """What a row tells."""

    def wake(self) -> int | None:
        """When the rule wants to be called without a row."""
        return None

    def time(self, now: int) -> Iterator[tuple]:
        """What that time tells; ``wake`` must then be later, or None."""
        return iter(())


def released(rule: Rule, held: list[tuple], before: int) -> Iterator[tuple]:
    """What the rule tells of the rows held (a heap of (t, order, row)) and its wake-ups earlier than ``before``."""
    while True:
        due = rule.wake()
        at = held[0][0] if held else None
        if due is not None and due < before and (at is None or due < at):
            yield from rule.time(due)
        elif at is not None and at < before:
            t, _, row = heapq.heappop(held)
            yield from rule.row(t, row)
        else:
            return


class _Processor(StatefulProcessor):
    def __init__(self, rule: Rule, t: str, order: list[str], names: list[str]):
        self.rule, self.t, self.order, self.names = rule, t, order, names

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "held binary, timer long")

    def _run(self, key, rows: Iterator[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        rule, held, timer = self.rule, [], None
        if self.state.exists():
            data, timer = self.state.get()
            rule, held = pickle.loads(bytes(data))
        else:
            rule = pickle.loads(pickle.dumps(self.rule))
        for frame in rows:
            frame = frame.astype(object).where(frame.notna(), None)
            for row in frame.to_dict("records"):
                if row[self.t] is not None:
                    heapq.heappush(held, (int(row[self.t]), tuple((row[c] is not None, row[c]) for c in self.order), row))
        told = [(*key, *x) for x in released(rule, held, watermark)]
        next_ = min([x for x in (rule.wake(), held[0][0] if held else None) if x is not None], default=None)
        if next_ is not None:
            next_ = max(next_, watermark) + 1
        if next_ != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if next_ is not None:
                self.handle.registerTimer(next_)
        self.state.update((pickle.dumps((rule, held)), next_))
        yield pd.DataFrame(told, columns=self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        return self._run(key, rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._run(key, iter(()), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def ordered(stream: DataFrame, keys: list[str], t: str, order: list[str], rule: Rule, lateness: str = LATENESS) -> DataFrame:
    """(keys, what ``rule`` tells) of the rows of each key by ``t`` (milliseconds) and then ``order``."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = StructType.fromDDL(", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + rule.out)
    timed = stream.withColumn("_at", F.timestamp_millis(F.col(t))).withWatermark("_at", lateness)
    return timed.groupBy(*keys).transformWithStateInPandas(_Processor(rule, t, order, schema.names), schema, "append", "EventTime")


def along(rows: list[dict], rule: Rule, t: str, order: list[str]) -> list[tuple]:
    """What the rule tells of all rows of one key, to the end of time."""
    held = [(int(r[t]), tuple((r[c] is not None, r[c]) for c in order), r) for r in rows if r[t] is not None]
    heapq.heapify(held)
    return list(released(rule, held, 1 << 62))


class Area(Rule):
    """Where the state of an area changes (``devices.area_state``). Rows: ``bad``."""

    out = "t long, poor boolean"

    def __init__(self, bad: str, window: int = WINDOW_MS, least: int = LEAST, dwell: int = DWELL_MS):
        self.bad, self.window, self.least, self.dwell = bad, window, least, dwell
        self.held, self.n_bad, self.poor, self.since = deque(), 0, False, None

    def row(self, t: int, row: dict) -> Iterator[tuple]:
        self.held.append((t, bool(row[self.bad])))
        self.n_bad += bool(row[self.bad])
        while self.held[0][0] < t - self.window:
            self.n_bad -= self.held.popleft()[1]
        if len(self.held) >= self.least and (self.since is None or t - self.since >= self.dwell):
            share = self.n_bad / len(self.held)
            if not self.poor and share >= ENTER or self.poor and share <= LEAVE:
                self.poor, self.since = not self.poor, t
                yield t, self.poor


class Quiet(Rule):
    """Rows that come ``gap`` or more after the last one told (alerts, predictions). Rows: ``id``."""

    out = "t long, id long"

    def __init__(self, gap: int):
        self.gap, self.last = gap, None

    def row(self, t: int, row: dict) -> Iterator[tuple]:
        if self.last is None or t - self.last >= self.gap:
            self.last = t
            yield t, row["id"]


class Confirmed(Rule):
    """Values that are held for ``dwell`` (``devices.confirmed``); told when the time is over, not when the next row comes."""

    def __init__(self, value: str, kind: str, dwell: int):
        self.value, self.dwell, self.out = value, dwell, f"value {kind}, since_ms long, at_ms long"
        self.now = self.since = self.told = None

    def wake(self) -> int | None:
        return None if self.now is None or self.now == self.told else self.since + self.dwell

    def time(self, now: int) -> Iterator[tuple]:
        self.told = self.now
        yield self.now, self.since, now

    def row(self, t: int, row: dict) -> Iterator[tuple]:
        if row[self.value] is not None and row[self.value] != self.now:
            if self.now is not None and self.now != self.told and t == self.since + self.dwell:
                yield from self.time(t)
            self.now, self.since = row[self.value], t


class Bins(Rule):
    """What samples add to bins, as soon as it is known. Rows have a ``kind``: ``fix`` (cell, speed, reach: how far in time it places
    samples), ``link`` (transport, validated, not_suspended) or ``sample`` (id, sub_id); fixes and links come before samples of
    their time.

    A sample is placed when the next fix comes or none can reach it any more, and counts then (n 1); its weight is known when
    the next sample of its subscription comes, and is told by a further row (n 0). As bins are sums, the rows of any cut of the
    stream add up to the same bins. A sample without a place tells nothing.
    """

    out = "id long, sub_id int, cell long, speed double, transport string, validated boolean, not_suspended boolean, n long, weight_ms long"
    order = {"link": 0, "fix": 1, "sample": 2}

    def __init__(self):
        self.fix = self.link = None
        self.waiting: deque[list] = deque()  # [t, row, fix before, link]
        self.open: dict[int, list] = {}  # by subscription, the sample whose weight is not known: [t, what it tells, if placed]

    def _placed(self, item: list, after: tuple | None) -> Iterator[tuple]:
        t, row, before, link, own = item
        cell = speed = None
        if before and after and before[1] == after[1] and after[0] - before[0] <= BRACKET_MS:
            cell, known = before[1], [x for x in (before[2], after[2]) if x is not None]
            speed = sum(known) / len(known) if known else None
        else:
            near = [(t - before[0], 0, before)] if before and t - before[0] <= before[3] else []
            near += [(after[0] - t, 1, after)] if after and after[0] - t <= after[3] else []
            if near:
                _, cell, speed, _ = min(near, key=lambda x: x[:2])[2]
        own[1] = (row["id"], row["sub_id"], cell, speed, *(link or (None, None, None))) if cell is not None else ()
        if own[1]:
            yield (*own[1], 1, 0)
            if own[2]:
                yield (*own[1], 0, own[2])

    def wake(self) -> int | None:
        return self.waiting[0][0] + BRACKET_MS + 1 if self.waiting else None

    def time(self, now: int) -> Iterator[tuple]:
        while self.waiting and self.waiting[0][0] + BRACKET_MS < now:
            yield from self._placed(self.waiting.popleft(), None)

    def row(self, t: int, row: dict) -> Iterator[tuple]:
        if row["kind"] == "link":
            self.link = (row["transport"], row["validated"], row["not_suspended"])
        elif row["kind"] == "fix":
            fix = (t, int(row["cell"]), row["speed"], int(row["reach"]))
            later = [x for x in self.waiting if x[0] >= t]
            for item in self.waiting:
                if item[0] < t:
                    yield from self._placed(item, fix)
            self.waiting = deque(later)
            self.fix = fix
        else:
            last = self.open.get(row["sub_id"])
            if last:
                last[2] = max(0, min(CAP_MS, t - last[0]))
                if last[1] and last[2]:
                    yield (*last[1], 0, last[2])
            own = [t, None, 0]
            self.open[row["sub_id"]] = own
            self.waiting.append([t, row, self.fix, self.link, own])


class Faults(Rule):
    """Faults as they open and clear (``faults.carrier_faults``, by failures and evidence told). Rows: ``told`` is null for a
    failure, else what evidence from outside tells."""

    out = "event string, t long, first_ms long, last_ms long, n long"

    def __init__(self, window: int = FAULT_WINDOW_MS, least: int = FAULT_LEAST, sustained: int = SUSTAINED_MS, quiet: int = QUIET_MS, valid: int = EVIDENCE_MS):
        self.window, self.least, self.sustained, self.quiet, self.valid = window, least, sustained, quiet, valid
        self.times, self.count, self.most = deque(), 0, 0
        self.first = self.last = self.until = self.before = self.through = self.told = None

    def wake(self) -> int | None:
        return None if self.until is None else self.until + 1

    def time(self, now: int) -> Iterator[tuple]:
        yield "cleared", self.until, self.first, self.last, self._n()
        self.first = self.last = self.until = self.before = self.through = self.told = None

    def _n(self) -> int:
        return max(1, self.told or 0, self.through - self.before if self.before is not None else 0)

    def row(self, t: int, row: dict) -> Iterator[tuple]:
        opened = self.until is None
        if row["told"] is not None:
            self.most = max(self.most, int(row["told"]))
            if self.most < self.least:
                return
            until, first = t + max(self.valid, self.quiet), t
            self.told = max(self.told or 0, self.most)
        else:
            self.times.append(t)
            self.count += 1
            while self.times[0] < t - self.window:
                self.times.popleft()
            if len(self.times) < self.least or t - self.times[0] < self.sustained:
                return
            spread = max(x for x in self.times if x <= t - self.sustained)
            until, first = max(min(self.times[-self.least], spread) + self.window, t + self.quiet), self.times[0]
            if self.before is None:
                self.before = self.count - len(self.times)
            self.through = self.count
        self.first = first if opened else self.first
        self.until = until if opened else max(self.until, until)
        self.last = t
        if opened:
            yield "opened", t, self.first, t, self._n()
