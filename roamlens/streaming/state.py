"""Keyed state in time order: submission decisions and the rate flag.

Keys are dealt into buckets, and the rows of a bucket wait in the state store until the watermark has passed the end of their time slot. They
are written as runs, in time order and of up to ``InTimeOrder.run`` rows, so what the store costs goes by runs and not by rows, keys or slots. A timer
merges the runs that have begun, decides the rows of the slots that are over and files what is left of a run by its slots: each row is written at most
twice and read at most twice, however busy its key. A row older than the watermark on arrival is late and is left out. A finished input is closed by
an end marker (``arrivals.end_of_input``), whose time moves the watermark past the last slot.
"""

from __future__ import annotations

import heapq
import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

END = "\u0000end"  # the key of end markers: they move the watermark and nothing else

# Which state may follow which.
NEXT = {"pending": ["approved", "rejected"], "approved": ["approved", "rejected", "ingested"],
        "rejected": ["approved", "rejected"], "ingested": []}

DECIDED = StructType([StructField("submission_id", StringType()), StructField("seq", LongType()), StructField("from_state", StringType()),
                      StructField("to_state", StringType()), StructField("outcome", StringType())])
FLAGGED = StructType([StructField("client", StringType()), StructField("event_id", LongType()), StructField("at", DoubleType()),
                      StructField("outcome", StringType())])


class InTimeOrder(StatefulProcessor):
    """Holds the rows of a bucket of keys until the watermark passes their time slot; subclasses decide them one after another.

    ``held`` starts with the key, the time in seconds and a tie-breaking number. What a key carries from one decision to the next is its own
    entry (``known``), read and written once for all its rows that are decided together.
    """

    held: StructType
    out: StructType
    slot = 600  # seconds
    run = 500  # rows
    chunk = 10_000  # decided rows that leave at once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.index = handle.getValueState("index", "runs string")  # [first slot, number] of each run and the next number
        self.rows = handle.getMapState("rows", "no bigint", "rows string")
        self.known = handle.getMapState("known", "key string", "value string")

    def _read_index(self) -> tuple[list[list[int]], int]:
        got = self.index.get()
        return json.loads(got[0]) if got else ([], 0)

    def _slot(self, row: list) -> int:
        return int(row[1] // self.slot)

    def _file(self, runs: list[list[int]], number: int, rows: list[list]) -> int:
        """Write a run of rows in time order, with a timer at the end of its first slot."""
        first = self._slot(rows[0])
        self.rows.updateValue((number,), (json.dumps(rows),))
        self.handle.registerTimer((first + 1) * self.slot * 1000)
        runs.append([first, number])
        return number + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() // (self.slot * 1000)  # slots before this one have been decided
        runs, number = self._read_index()
        for chunk in rows:
            chunk = chunk[(chunk["at"] // self.slot >= closed) & (chunk["key"] != END)]
            part = chunk[[f.name for f in self.held]].astype(object).where(chunk.notna(), None).values.tolist()
            part.sort(key=_in_time)
            for at in range(0, len(part), self.run):
                number = self._file(runs, number, part[at : at + self.run])
        self.index.update((json.dumps([runs, number]),))
        yield self._frame([])

    def _taken(self, no: int, closed: int, later: list[list]) -> Iterator[list]:
        """The rows of a run whose slot is over; the others go to ``later``."""
        rows = json.loads(self.rows.getValue((no,))[0])
        self.rows.removeKey((no,))
        for at, row in enumerate(rows):
            if self._slot(row) >= closed:
                later.append(rows[at:])
                return
            yield row

    def _merged(self, begun: list[list[int]], closed: int, later: list[list]) -> Iterator[list]:
        """The rows of all begun runs in time order; a run is read when its first slot comes, so only runs that overlap are in memory."""
        waiting, heap, turn = deque(sorted(begun)), [], 0
        while waiting or heap:
            while waiting and (not heap or waiting[0][0] <= self._slot(heap[0][2])):
                rows = self._taken(waiting.popleft()[1], closed, later)
                for row in rows:
                    heapq.heappush(heap, (_in_time(row), turn, row, rows))
                    turn += 1
                    break
            if heap:
                _, _, row, rows = heap[0]
                yield row
                after = next(rows, None)
                if after is None:
                    heapq.heappop(heap)
                else:
                    heapq.heapreplace(heap, (_in_time(after), turn, after, rows))
                    turn += 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() // (self.slot * 1000)
        runs, number = self._read_index()
        begun, runs = [r for r in runs if r[0] < closed], [r for r in runs if r[0] >= closed]
        if not begun:  # an earlier timer of this watermark has decided them
            return
        later, out, state = [], [], {}
        for row in self._merged(begun, closed, later):
            if row[0] not in state:
                got = self.known.getValue((_name(row[0]),))
                state[row[0]] = self.start(json.loads(got[0]) if got else None)
            state[row[0]], decided = self.decide(state[row[0]], row)
            out.append(decided)
            if len(out) == self.chunk:
                yield self._frame(out)
                out = []
        for who, value in state.items():
            self.known.updateValue((_name(who),), (json.dumps(self.keep(value)),))
        slots: dict[int, list[list]] = {}
        for rows in later:
            for row in rows:
                slots.setdefault(self._slot(row), []).append(row)
        for rows in slots.values():
            rows.sort(key=_in_time)
            number = self._file(runs, number, rows)
        self.index.update((json.dumps([runs, number]),))
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        got = pd.DataFrame(rows, columns=[f.name for f in self.out])
        return got if rows else got.astype({f.name: "int64" for f in self.out if isinstance(f.dataType, LongType)})

    def start(self, kept: object) -> object:
        """What a key carries, from what ``keep`` gave; None: a new key."""
        return kept

    def keep(self, value: object) -> object:
        return value

    def decide(self, now: object, row: list) -> tuple[object, tuple]:
        """What the key carries after a row, and the row's decision."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _in_time(row: list) -> tuple:
    return row[1], row[2] is not None, row[2] or 0


def _name(key: str | None) -> str:
    return "" if key is None else f"={key}"


def in_time_order(rows: DataFrame, processor: InTimeOrder, buckets: int = 1024) -> DataFrame:
    """The decisions of ``processor`` over a stream of (key, ts, at, ...); a key's rows lie in one of ``buckets``."""
    use_rocksdb(rows)
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(
        processor, processor.out, "Append", "EventTime")


def next_state(now: str, state: str, explained: bool) -> str:
    """The outcome of a step: accepted, or why it is refused and changes nothing."""
    if state != "ingested" and not explained:
        return "needs author and reason"
    return "accepted" if state in NEXT.get(now, []) else f"refused: {now} cannot become {state}"


class Decisions(InTimeOrder):
    """The state of each submission; a step that may not follow is refused and changes nothing."""

    held = StructType([StructField("key", StringType()), StructField("at", DoubleType()), StructField("seq", LongType()), StructField("state", StringType()),
                       StructField("explained", BooleanType())])
    out = DECIDED

    def start(self, kept: str | None) -> str:
        return kept or "pending"

    def decide(self, now: str, row: list) -> tuple[str, tuple]:
        key, _, seq, state, explained = row
        outcome = next_state(now, state, bool(explained))
        return (state if outcome == "accepted" else now), (key, seq, now, state, outcome)


def decide(decisions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Outcome of every decision (submission_id, seq, state, decided_by, reason, ts) of a stream, in time order."""
    rows = decisions.withWatermark("ts", late).selectExpr(
        "submission_id AS key", "ts", "CAST(unix_micros(ts) AS double) / 1000000 AS at", "CAST(seq AS bigint) AS seq", "state",
        "trim(coalesce(decided_by, '')) <> '' AND trim(coalesce(reason, '')) <> '' AS explained")
    return in_time_order(rows, Decisions())


def use_rocksdb(df: DataFrame) -> None:
    """Keyed list and value state needs the RocksDB store; it also keeps large state off the heap."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass",
                             "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def admit(recent: deque, at: float, limit: int, window: float) -> bool:
    """Whether an event is accepted; ``recent`` keeps the accepted times of the last window, at most ``limit``."""
    while recent and at - recent[0] >= window:
        recent.popleft()
    if len(recent) < limit:
        recent.append(at)
        return True
    return False


class RateFlag(InTimeOrder):
    """At most ``limit`` accepted events per client and ``window`` seconds; a refusal does not count."""

    held = StructType([StructField("key", StringType()), StructField("at", DoubleType()), StructField("event_id", LongType())])
    out = FLAGGED

    def __init__(self, limit: int = 5, window: float = 3600.0):
        self.limit, self.window = limit, window

    def start(self, kept: list[float] | None) -> deque:
        return deque(kept or ())

    def keep(self, value: deque) -> list[float]:
        return list(value)

    def decide(self, now: deque, row: list) -> tuple[deque, tuple]:
        key, at, event_id = row
        return now, (key, event_id, at, "accepted" if admit(now, at, self.limit, self.window) else "refused")


def rate_flag(events: DataFrame, limit: int = 5, window: float = 3600.0, late: str = "10 minutes") -> DataFrame:
    """Accepted or refused for every event (client, event_id, ts) of a stream, in time order."""
    rows = events.withWatermark("ts", late).selectExpr("client AS key", "ts", "CAST(unix_micros(ts) AS double) / 1000000 AS at", "CAST(event_id AS bigint) AS event_id")
    return in_time_order(rows, RateFlag(limit, window))


def rate_flag_batch(events: DataFrame, limit: int = 5, window: float = 3600.0) -> DataFrame:
    """The same rule over a finished table of (client, event_id, ts).

    Clients are spread over tasks and each task walks its rows in (client, time) order with the last accepted times only, so
    a busy client costs its length once and no memory.
    """
    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, recent = None, deque()
        for f in frames:
            ok = []
            for c, at in zip(f["client"], f["at"]):
                if c != client:
                    client, recent = c, deque()
                ok.append("accepted" if admit(recent, at, limit, window) else "refused")
            yield f.assign(outcome=ok)

    rows = events.selectExpr("client", "CAST(event_id AS bigint) AS event_id", "CAST(unix_micros(ts) AS double) / 1000000 AS at")
    return rows.repartition("client").sortWithinPartitions("client", "at", "event_id").mapInPandas(walk, FLAGGED)
