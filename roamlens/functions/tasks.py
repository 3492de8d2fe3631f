"""Small helpers that run inside tasks; no Spark objects, so workers can import them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def _lcs(a: str, b: str) -> int:
    """Longest common subsequence length, one bit row per character of ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(b):
        where[ch] = where.get(ch, 0) | (1 << i)
    row, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    for ch in a:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return bin(~row & full).count("1")


def indel(a: str, b: str) -> float:
    """0-100: share of characters kept when only inserts and deletes are allowed."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _lcs(a, b) / total


def lcs_rows(left: list[str], right: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(place in ``left``, longest common subsequence lengths with all of ``right``), in the order of the sorted names.

    One 64-bit row per right name and all of them at once; what a name shares with the start of the one before is kept.
    Names of more than 64 characters are compared one by one.
    """
    short = np.array([len(x) <= 64 for x in right], dtype=bool)
    full = np.array([(1 << len(x)) - 1 if ok else 0 for x, ok in zip(right, short)], dtype=np.uint64)
    where: dict[str, np.ndarray] = {}
    for j in np.flatnonzero(short):
        for i, ch in enumerate(right[j]):
            where.setdefault(ch, np.zeros(len(right), np.uint64))[j] |= np.uint64(1 << i)
    none, rows, before = np.zeros(len(right), np.uint64), [full], ""
    for at in sorted(range(len(left)), key=left.__getitem__):
        name = left[at]
        same = next((k for k, (x, y) in enumerate(zip(name, before)) if x != y), min(len(name), len(before)))
        del rows[same + 1 :]
        for ch in name[same:]:
            hit = rows[-1] & where.get(ch, none)
            rows.append(((rows[-1] + hit) | (rows[-1] - hit)) & full)
        before, length = name, np.bitwise_count(~rows[-1] & full).astype(np.int64)
        for j in np.flatnonzero(~short):
            length[j] = _lcs(name, right[j])
        yield at, length


def token_set(a: str, b: str) -> float:
    """Best indel ratio among the shared words and the shared words plus each rest."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    only_a, only_b = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and (not only_a or not only_b):
        return 100.0
    with_a, with_b = f"{shared} {only_a}".strip(), f"{shared} {only_b}".strip()
    best = indel(with_a, with_b)
    if shared:
        best = max(best, indel(shared, with_a), indel(shared, with_b))
    return best


def walk_claims(group: pd.DataFrame) -> pd.DataFrame:
    """Root after root takes its lowest id that none before has taken."""
    taken: dict[str, str] = {}
    got: dict[str, str] = {}
    for root, entity_id in group.sort_values(["root", "no", "entity_id"])[["root", "entity_id"]].itertuples(index=False):
        if root not in got and entity_id not in taken:
            got[root], taken[entity_id] = entity_id, root
    return pd.DataFrame({"root": list(got), "entity_id": list(got.values())})


def fill_days(group: pd.DataFrame) -> pd.DataFrame:
    """Days of one region of one trip: a day is the best place left and the free places nearest in kind to it.

    Nearness to the day's first place is a tier (same district, same city, elsewhere); inside a tier the rank decides.
    """
    group = group.sort_values("pos")
    place, per_day = group.place_id.to_list(), group.per_day.to_list()
    district, city = ([None if pd.isna(v) or v == "" else v for v in group[c].to_list()] for c in ("district", "city"))
    free, stops = list(range(len(place))), []
    for day in range(1, int(group.region_days.iloc[0]) + 1):
        if not free:
            break
        first = free[0]
        kind = lambda i: 0 if district[i] is not None and district[i] == district[first] else 1 if city[i] is not None and city[i] == city[first] else 2  # noqa: E731, B023
        today = [first, *sorted(free[1:], key=kind)][: int(per_day[first])]
        stops += [(day, stop, place[i]) for stop, i in enumerate(today, 1)]
        used = set(today)
        free = [i for i in free if i not in used]
    out = pd.DataFrame(stops, columns=["region_day", "stop", "place_id"])
    for at, name in enumerate(("request_id", "region", "region_rank")):
        out.insert(at, name, group[name].iloc[0])
    return out
