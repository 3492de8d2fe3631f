"""Removal of bytes inside strings that occur twice, by a column-wise Burrows-Wheeler construction.

Each text is UTF-8 bytes. A string of ``length`` bytes is repeated when it starts at two places of the collection.

1. Anchors. Every string of ``length`` bytes holds an anchor: a 64-byte gram whose hash is the smallest of the
   string's grams. Equal strings hold the same anchor at the same offset, so only anchors seen twice matter.
2. Documents of the construction are the segments around those anchors that could share a string with another
   (at most 736 bytes for 400), aligned at the anchor; segments with equal bytes are one document with a count.
3. Construction. The segments of an anchor are taken together, from the last column to the first: each round inserts one
   symbol per segment in front of what is sorted already. The round's transform is the symbols in the old order; its stable
   sort gives the new order, and the common prefix of two neighbours is one more than the smallest between their old
   places. A neighbour with a common prefix of ``length`` or more marks a repeated string. Segments come from files of the
   shared folder, sorted by anchor and read once in sequence; a batch keeps a few arrays as long as its segments.
   An anchor with more than ``group_limit`` distinct segments is not taken into one task: its strings are counted by hash.

Null text is empty. Rows of one doc_id and text are separate copies. Null ids and other columns do no harm; an empty
table gives no rows. Very long texts need memory in proportion to one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.llm.common import arrow_rows, by_unit, keyed, mix, read, slices, stored

LENGTH, GRAM = 400, 64
BATCH = 8192  # segments sorted at once, besides a whole group
GROUP_LIMIT = 16384
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F)]


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every window of the width."""
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def _smallest(h: np.ndarray, width: int, first: bool) -> np.ndarray:
    """Where the smallest value of every window is; of equal ones the first or the last."""
    at, size = np.arange(len(h)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(h[a] <= h[b] if first else h[a] < h[b], a, b)

    while size * 2 <= width:
        at = better(at[:-size], at[size:])
        size *= 2
    rest = width - size
    return better(at[: len(at) - rest], at[rest:]) if rest else at


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Positions and hashes of a text's anchors, and the ranges that strings repeated inside the text itself cover.

    An anchor is the smallest gram of some string of the length. Where grams repeat inside a string (runs of one word),
    there would be one for every period. Then the first of equal grams is taken if they go on to the string's end, else the last,
    and a string that stands in the text several times needs the anchor of its first place only, as all its places are
    covered here already.
    """
    a = np.frombuffer(data, np.uint8)
    if len(a) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), []
    h, step = _LETTER[a], 1
    for times in _TIMES:
        h = h[:-step] * times + h[step:]
        step *= 2
    h = mix(h)
    width = length - GRAM + 1
    low = sliding(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([pad, low, pad]), width, np.maximum) == h)
    order = at[np.argsort(h[at], kind="stable")]
    if not np.any((h[order][1:] == h[order][:-1]) & (np.diff(order) < width)):
        return at, h[at], []
    first, last = _smallest(h, width, True), _smallest(h, width, False)
    before = np.zeros(len(h), np.int64)
    before[order[1:]] = order[:-1]
    goes_on = np.arange(len(last)) + width - 1 - last < last - before[last]
    chosen = np.where(goes_on, first, last)
    whole = np.zeros(len(last), np.uint64)
    for k in [*range(0, length - GRAM, GRAM), length - GRAM]:
        whole = mix(whole * _TIMES[0] + h[k : k + len(last)])
    _, one, where, many = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    at = np.unique(chosen[one])
    again = np.flatnonzero(many[where] > 1)
    return at, h[at], runs(again, length) if len(again) else []


def column_wise(segments: list[bytes], offsets: list[int], groups: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each segment, which columns start a string that another segment of its group has at the same column.

    ``groups`` ascends. Column ``length - GRAM`` is the anchor's first byte.
    """
    n, before = len(segments), length - GRAM
    wide = 2 * length - GRAM
    absent = 256
    x = np.full((n, wide), absent, np.int16)
    for i, (s, off) in enumerate(zip(segments, offsets)):
        x[i, before - off : before - off + len(s)] = np.frombuffer(s, np.uint8)
    x = np.ascontiguousarray(x.T)
    order, common = np.arange(n), np.zeros(n + 1, np.int16)  # one more: the end of the last range
    found = np.zeros((n, before + 1), bool)
    base = groups.astype(np.int64) * 257
    for c in range(wide - 1, -1, -1):
        symbols = x[c][order]
        key = base + symbols
        perm = np.argsort(key, kind="stable")
        sorted_key = key[perm]
        left, right = perm[:-1], perm[1:]
        same = (sorted_key[1:] == sorted_key[:-1]) & (symbols[right] != absent)
        value = common[right]
        apart = np.flatnonzero(same & (right != left + 1))
        if len(apart):
            ends = np.empty(2 * len(apart), np.int64)
            ends[::2], ends[1::2] = left[apart] + 1, right[apart] + 1
            value[apart] = np.minimum.reduceat(common, ends)[::2]
        common = np.zeros(n + 1, np.int16)
        common[1:n] = np.where(same, value + 1, 0)
        order = order[perm]
        if c <= before:
            hit = np.flatnonzero(common[:n] >= length)
            found[order[hit], c] = True
            found[order[hit - 1], c] = True
    return found


def runs(starts: np.ndarray, length: int) -> list[int]:
    """Maximal covered ranges of strings beginning at ascending starts, as begin, end, begin, end, ..."""
    cut = np.flatnonzero(np.diff(starts) > length)
    first = starts[np.concatenate([[0], cut + 1])]
    last = starts[np.concatenate([cut, [len(starts) - 1]])] + length
    return np.stack([first, last], 1).ravel().tolist()


def repeated_bytes(docs: DataFrame, length: int = LENGTH, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, _d, _t, n_bytes, n_removed, n_spans, kept_sha256 and spans (begin, end, ... of removed bytes) per row."""
    before = length - GRAM
    rows = keyed(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
        for batch in batches:
            for first, texts in slices(batch):
                out: list[list] = [[] for _ in types]
                for i, b in enumerate(texts, first):
                    at, h, own = anchors(b, length)
                    if not len(at):
                        continue
                    if own:  # a row without an anchor: what the text covers by itself
                        for col, v in zip(out, (None, batch.column("_d")[i].as_py(), batch.column("_t")[i].as_py(), 0, own)):
                            col.append(v)
                    order = np.argsort(h, kind="stable")
                    at, h = at[order], h[order].view(np.int64)
                    cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                    many = np.diff(np.append(cuts, len(h)))
                    out[0].extend(h[cuts].tolist())
                    out[1].extend([batch.column("_d")[i].as_py()] * len(cuts))
                    out[2].extend([batch.column("_t")[i].as_py()] * len(cuts))
                    out[3].extend(many.tolist())
                    out[4].extend(x.tolist() for x in np.split(at, cuts[1:]))
                yield arrow_rows(["h", "_d", "_t", "k", "pos"], types, out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            sent: set[tuple[int, int]] = set()
            for first, texts in slices(batch):
                out: list[list] = [[] for _ in types]
                for i, b in enumerate(texts, first):
                    d, t = batch.column("_d")[i].as_py(), batch.column("_t")[i].as_py()
                    for a in batch.column("at")[i].as_py():
                        here: dict[int, list[int]] = {}
                        for pos in a["pos"]:
                            lo = max(0, pos - before)
                            seg = b[lo : pos + length]
                            s = int.from_bytes(blake2b(seg, digest_size=8, salt=(pos - lo).to_bytes(4, "big")).digest(), "big", signed=True)
                            if s in here:
                                here[s].append(lo)
                                continue
                            new = (a["h"], s) not in sent
                            sent.add((a["h"], s))
                            here[s] = [lo]
                            for col, v in zip(out, (a["h"], s, d, t, here[s], 0, pos - lo, len(seg), seg if new else None)):
                                col.append(v)
                out[5] = [len(x) for x in out[4]]
                yield arrow_rows(["h", "s", "_d", "_t", "los", "k", "off", "size", "seg"], types, out)

    def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done() -> pa.RecordBatch:
            t = pa.concat_tables(held)
            h = t.column("h").to_numpy()
            found = column_wise(t.column("seg").to_pylist(), off := t.column("off").to_pylist(), np.cumsum(np.concatenate([[False], h[1:] != h[:-1]])), length)
            hit = np.flatnonzero(found.any(axis=1))
            return arrow_rows(["h", "s", "iv"], [pa.int64(), pa.int64(), pa.list_(pa.int32())], [
                h[hit], t.column("s").to_numpy()[hit], [runs(np.flatnonzero(found[i]) - (before - off[i]), length) for i in hit]])

        for t in by_unit(batches, "h"):
            held.append(t)
            if sum(len(x) for x in held) >= BATCH:
                yield done()
                held.clear()
        if held:
            yield done()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, s, off, seg in zip(*(batch.column(c).to_pylist() for c in ("h", "s", "off", "seg"))):
                at = [j for j in range(max(0, off - before), min(off, len(seg) - length) + 1)]
                yield arrow_rows(["h", "s", "j", "w"], [pa.int64(), pa.int64(), pa.int32(), pa.binary()], [
                    [h] * len(at), [s] * len(at), at, [blake2b(seg[j : j + length], digest_size=16, salt=(off - j).to_bytes(4, "big")).digest() for j in at]])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield arrow_rows(["h", "s", "iv"], [pa.int64(), pa.int64(), pa.list_(pa.int32())], [
                batch.column("h"), batch.column("s"), [runs(np.array(sorted(j.as_py())), length) for j in batch.column("j")]])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int32())]
        for batch in batches:
            for first, texts in slices(batch):
                gone, many, sha, spans = [], [], [], []
                for i, b in enumerate(texts, first):
                    ranges: list[int] = []
                    for piece in sorted((p[k], p[k + 1]) for p in batch.column("iv")[i].as_py() for k in range(0, len(p), 2)):
                        if ranges and piece[0] <= ranges[-1]:
                            ranges[-1] = max(ranges[-1], piece[1])
                        else:
                            ranges += piece
                    edges = [0, *ranges, len(b)]
                    left = sha256()
                    for k in range(0, len(edges), 2):
                        left.update(b[edges[k] : edges[k + 1]])
                    gone.append(sum(ranges[1::2]) - sum(ranges[::2]))
                    many.append(len(ranges) // 2)
                    sha.append(left.hexdigest())
                    spans.append(ranges)
                part = batch.slice(first, len(texts))
                yield arrow_rows(["_d", "_t", "n_removed", "n_spans", "sha", "spans"], types, [part.column("_d"), part.column("_t"), gone, many, sha, spans])

    at = stored(rows.mapInArrow(find, "h long, _d long, _t long, k int, pos array<int>"))
    twice = at.groupBy("h").agg(F.sum("k").alias("n")).filter("n > 1").select("h")
    alone = at.filter("h is null").select("_d", "_t", "pos")
    pairs = at.join(twice, "h", "left_semi").select("_d", "_t", F.struct("h", "pos").alias("a"))
    per_doc = pairs.unionByName(alone.select("_d", "_t", F.lit(None).cast(pairs.schema["a"].dataType).alias("a"))).groupBy("_d", "_t").agg(
        F.collect_set("a").alias("at"))
    # From here only the texts with such an anchor move; the others stay whole.
    touched = stored(rows.join(per_doc, ["_d", "_t"]).select("_d", "_t", "text", "at"))
    places = stored(touched.mapInArrow(cut, "h long, s long, _d long, _t long, los array<int>, k int, off int, size int, seg binary"))

    counts = places.groupBy("h", "s").agg(F.sum("k").alias("n"))
    mixed = counts.groupBy("h").agg(F.count(F.lit(1)).alias("segments")).filter("segments > 1")
    bodies = places.filter("seg is not null").select("h", "s", "off", "seg")
    kind = "h long, s long, iv array<int>"
    bounded = bodies.repartition("h").join(mixed.filter(F.col("segments") <= group_limit).select("h"), "h", "left_semi").dropDuplicates(["h", "s"])
    found = bounded.sortWithinPartitions("h", "s").mapInArrow(sort_groups, kind)
    many = mixed.filter(F.col("segments") > group_limit).select("h")
    hot = bodies.join(many, "h", "left_semi").dropDuplicates(["h", "s"]).mapInArrow(windows, "h long, s long, j int, w binary")
    again = hot.groupBy("h", "w").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h", "w")
    found = found.unionByName(hot.join(again, ["h", "w"]).groupBy("h", "s").agg(F.collect_set("j").alias("j")).mapInArrow(joined, kind))
    marks = counts.join(found, ["h", "s"], "left").filter("n > 1 or iv is not null")
    own = F.transform("iv", lambda x: x + F.col("los")[0])
    covered = places.join(marks, ["h", "s"]).select("_d", "_t", F.when(F.col("n") > 1, F.flatten(F.transform("los", lambda x: F.array(
        x, x + F.col("size"))))).otherwise(own).alias("iv")).unionByName(alone.select("_d", "_t", F.col("pos").alias("iv")))
    spans = covered.groupBy("_d", "_t").agg(F.collect_set("iv").alias("iv"))
    kept = touched.select("_d", "_t", "text").dropDuplicates(["_d", "_t"]).join(spans, ["_d", "_t"]).mapInArrow(
        keep, "_d long, _t long, n_removed long, n_spans long, sha string, spans array<int>")
    text = F.coalesce("text", F.lit(""))
    whole = rows.select("doc_id", "_d", "_t", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("all_sha256"))
    zero = F.lit(0).cast("long")
    return whole.join(kept, ["_d", "_t"], "left").select(
        "doc_id", "_d", "_t", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("sha", "all_sha256").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<int>")).alias("spans"))


def query(spark, folder: str) -> DataFrame:
    return repeated_bytes(read(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
