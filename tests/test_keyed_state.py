"""Keyed state costs by runs of rows, not by rows, keys or time slots, and still decides in time order."""

import collections
import random

import pandas as pd

from roamlens.streaming import state


class Value:
    def __init__(self):
        self.held, self.writes = None, 0

    def get(self):
        return self.held

    def update(self, value):
        self.held, self.writes = value, self.writes + 1


class Map:
    def __init__(self):
        self.held, self.writes = {}, 0

    def getValue(self, key):  # noqa: N802
        return self.held.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.held[key], self.writes = value, self.writes + 1

    def removeKey(self, key):  # noqa: N802
        del self.held[key]


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, Value())

    def getMapState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, Map())

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


class Now:
    def __init__(self, seconds):
        self.ms = int(seconds * 1000)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_runs_of_many_keys_and_slots():
    rnd, handle = random.Random(3), Handle()
    flags = state.RateFlag(limit=2, window=5000.0)
    flags.init(handle)
    rows = [(f"c{rnd.randrange(40)}" if rnd.random() < 0.9 else None, float(rnd.randrange(600_000)), n) for n in range(3000)]
    got, mark = {}, 0.0
    for k, until in enumerate((200_000, 200_100, 450_000, 10**7)):  # arrivals from the watermark on, then the watermark moves
        part = [r for i, r in enumerate(rows) if (i % 3 == k if r[1] // 600 >= 450_000 // 600 else k == 0)]
        if part:
            frame = pd.DataFrame(part, columns=["key", "at", "event_id"])
            before = handle.states["rows"].writes
            list(flags.handleInputRows((0,), iter([frame]), Now(mark)))
            assert handle.states["rows"].writes - before <= len(part) // flags.run + 1
        mark = until
        for at in sorted(t for t in handle.timers if t <= mark * 1000):
            handle.timers.discard(at)
            for f in flags.handleExpiredTimer((0,), Now(mark), None):
                got |= {r.event_id: r.outcome for r in f.itertuples()}
    assert not handle.states["rows"].held  # all are decided and gone
    assert handle.states["rows"].writes < len(rows)  # what a watermark cuts is filed again by slot, the rest only as runs
    want, recent = {}, collections.defaultdict(collections.deque)
    for key, at, event_id in sorted(rows, key=lambda r: r[1:]):
        want[event_id] = "accepted" if state.admit(recent[key], at, 2, 5000.0) else "refused"
    assert got == want
