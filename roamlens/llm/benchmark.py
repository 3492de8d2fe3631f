"""Benchmark decontamination: pigeonhole pieces found exactly, whole items verified by bit-parallel edit distance.

Items and documents are normalised alike: lower case, ASCII digits to 0, other ASCII marks and line ends to single spaces. An item of n
characters may differ in ``rate`` * n places; cut into one piece more than that, some piece stands unchanged in every
occurrence. A document is scanned once for the pieces of all items; a hit is verified from small runs of pieces to the
whole item, where the smallest edit distance to any substring decides. Items under ``min_chars`` normalised characters are searched
with the spaces around them, so that they stand at word boundaries; only items without a letter or digit are left out.

The items are a stated query set: they go to the tasks in blocks of at most ``block_chars`` characters, one pass over
the documents for each block, so neither a task nor the driver holds more than a block.

Null texts match nothing; null or repeated item ids are searched like others (a null id is reported as -1). Repeated rows
are reported each. Extra columns are ignored. Without documents there are no rows, without items no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.llm.common import arrow_rows, keyed, normalise, packed, read, stored, unpacked

RATE, MIN_CHARS, BLOCK_CHARS = 0.1, 40, 4_000_000
MATCH = "doc_id long, _d long, _t long, item_id long, distance int"


def flat(text: str | None) -> str:
    return b" ".join(x for x in normalise(text or "") if x).decode("utf-8", "surrogatepass")


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length with their offsets."""
    n = budget + 1
    at = [len(item) * k // n for k in range(n + 1)]
    return [(lo, item[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]


class Item:
    """One searched text, or a run of its pieces, with its bit masks."""

    def __init__(self, item_id: int, text: str, budget: int):
        self.item_id, self.text, self.budget = item_id, text, budget
        self.masks: dict[str, int] = {}
        for i, ch in enumerate(text):
            self.masks[ch] = self.masks.get(ch, 0) | 1 << i

    def nearest(self, window: str) -> int:
        """The smallest edit distance to a substring of the window: columns start at zero cost anywhere."""
        full, top = (1 << len(self.text)) - 1, 1 << len(self.text) - 1
        pv, mv, d = full, 0, len(self.text)
        best = d
        for ch in window:
            eq = self.masks.get(ch, 0)
            diagonal = (((eq & pv) + pv) ^ pv) | eq | mv
            up = mv | ~(diagonal | pv) & full
            down = pv & diagonal
            if up & top:
                d += 1
            elif down & top:
                d -= 1
                if d < best:
                    best = d
            up = up << 1 & full
            pv = (down << 1) & full | ~(diagonal | up) & full
            mv = up & diagonal
        return best


def ancestors(item: Item) -> list[list[tuple[int, Item]]]:
    """For each piece, the runs of pieces above it in a halving tree below the whole item, smallest first, with their offsets.

    At most m - 1 errors in m pieces leave one half with fewer errors than pieces; so an occurrence has an exact
    piece all of whose runs of m pieces are within m - 1 errors.
    """
    cuts = pieces(item.text, item.budget)
    out: list[list[tuple[int, Item]]] = [[] for _ in cuts]

    def halve(lo: int, hi: int) -> None:
        if hi - lo > 1:
            mid = (lo + hi) // 2
            halve(lo, mid)
            halve(mid, hi)
            if hi - lo < len(cuts):
                run = Item(item.item_id, "".join(p for _, p in cuts[lo:hi]), hi - lo - 1)
                for k in range(lo, hi):
                    out[k].append((cuts[lo][0], run))

    halve(0, len(cuts))
    return out


def automaton(items: list[Item]) -> ahocorasick.Automaton:
    found: dict[str, list[tuple[int, int, list]]] = {}
    for k, item in enumerate(items):
        for (offset, piece), above in zip(pieces(item.text, item.budget), ancestors(item)):
            found.setdefault(piece, []).append((k, offset, above))
    a = ahocorasick.Automaton()
    for piece, at in found.items():
        a.add_word(piece, (len(piece), at))
    a.make_automaton()
    return a


def matches(text: str, items: list[Item], machine: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """(item, distance) of the items within their budget somewhere in the normalised text."""
    windows: dict[int, list[list[int]]] = {}
    for end, (size, at) in machine.iter(text):
        for k, offset, above in at:
            item = items[k]
            start = end + 1 - size - offset  # of the item, were there no errors
            if any(run.nearest(text[max(0, start + o - run.budget) : start + o + len(run.text) + run.budget]) > run.budget for o, run in above):
                continue
            lo = end + 1 - size - offset - item.budget
            hi = lo + len(item.text) + 2 * item.budget
            held = windows.setdefault(k, [])
            if held and lo <= held[-1][1]:
                held[-1][1] = max(held[-1][1], hi)
                held[-1][0] = min(held[-1][0], lo)
            else:
                held.append([lo, hi])
    out = []
    for k, held in windows.items():
        best = min(items[k].nearest(text[max(0, lo) : hi]) for lo, hi in held)
        if best <= items[k].budget:
            out.append((k, best))
    return out


def _normal_items():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(-1 if i is None else i, t) for i, x in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist())
                    if (t := flat(x))]
            yield arrow_rows(["item_id", "text", "n"], [pa.int64(), pa.string(), pa.int64()], [
                [i for i, _ in kept], [t for _, t in kept], [len(t) for _, t in kept]])

    return run


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, _d, _t, item_id and distance of every (document, item) within the budget."""
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    normal = stored(named.mapInArrow(_normal_items(), "item_id long, text string, n long").distinct())
    size = normal.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()["s"]  # one number
    blocks = max(1, -(-2 * size // block_chars))  # twice as many as needed, for uneven hashing
    rows, out = keyed(docs), None
    for k in range(blocks):
        block = normal.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text")
        texts = [(r["item_id"], r["text"]) for r in block.collect()]  # at most a block
        part = rows.mapInArrow(_scan(texts, rate, min_chars), MATCH)
        out = part if out is None else out.unionByName(part)
    return out


def _scan(texts: list[tuple[int, str]], rate: float, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [Item(i, t if len(t) >= min_chars else f" {t} ", int(len(t) * rate)) for i, t in texts]
        machine = automaton(items) if items else None
        types = [pa.int64()] * 4 + [pa.int32()]
        for batch in batches if machine else ():
            out: list[list] = [[] for _ in types]
            for i, text in enumerate(batch.column("text")):
                for k, best in matches(f" {flat(text.as_py())} ", items, machine):
                    for col, v in zip(out, (*(batch.column(c)[i].as_py() for c in ("doc_id", "_d", "_t")), items[k].item_id, best)):
                        col.append(v)
            yield arrow_rows(["doc_id", "_d", "_t", "item_id", "distance"], types, out)

    return run


def clean_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    bad = contaminated(docs, items).select("_d", "_t").distinct()
    return unpacked(packed(docs).join(bad, ["_d", "_t"], "left_anti"), docs.columns)


def query(spark, folder: str) -> DataFrame:
    """Every document with the items found in it."""
    docs = read(spark, folder, "documents")
    hits = contaminated(docs, read(spark, folder, "benchmark")).groupBy("_d", "_t").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.min("distance").alias("distance"))
    ids = keyed(docs).select("doc_id", "_d", "_t")
    return ids.join(hits, ["_d", "_t"], "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), "distance")
