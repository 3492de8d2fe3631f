"""SimHash near-duplicates found by Golay-code keys.

A fingerprint has 64 bits, each the majority of the XXH64 hashes (seed 42) of a document's four-word shingles, repeats included, A-Z
lower-cased; fewer words are one shingle. Documents of equal fingerprints are one class; classes at ``LIMIT`` = 4 or fewer differing bits
are linked, and a group is all that links reach.

Keys. The fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the binary Golay code of 23 bits. The code
is perfect: every word is within three bits of exactly one codeword, whose 12 message bits are its index. A segment's keys are
the indices of all words within one bit of it, one index or six. Two segments at most two bits apart have a word within one bit of both, so they
share a key. Four errors over three segments leave two cases: no segment has more than two, then a key from each of the three meets
(36 bits); or one has three or four, then of the other two one is equal and the other at most one bit off (21 or 22
bits and an index). A fingerprint has about 180 keys, all found by table, and no linked pair is missed. Chance shares a
key between 3 of 10 million pairs.

One pass over the sorted keys compares the fingerprints of a key on all their bits, eight bytes each, and sends one link per fingerprint:
to the first of its group there. No pairs are sent. A key with more than ``HELD`` fingerprints goes to ``connect``, which
compares the same pairs in stars and bounded tiles of several tasks.

Null and wordless texts have the fingerprint zero and are linked by it like others. Rows with a null id take part; their group has the smallest
id that is not null, or none. Repeated rows are copies, ties fall to the smallest id. Very long texts are hashed in pieces of 65,536 shingles;
memory grows with one text. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.llm.common import arrow_rows, components, connect, keyed, read, slices, stored

SHINGLE, SEED, LIMIT = 4, 42, 4
PIECE = 1 << 16  # shingles hashed at once
HELD = 1 << 15  # fingerprints of a key compared in one task; a larger key is compared in tiles
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and width
CODE, GENERATOR = 23, 0b110001110101  # the binary Golay code: length and generator polynomial

# Each of the eight bits of a byte in a lane of its own, so 255 bytes can be added without a carry.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


# ---- fingerprints ---------------------------------------------------------------------------------
def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # bytes.lower() touches A-Z only; blanks are those of the contract
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, many = np.append(0, ends[:-1] + 1), len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, many, PIECE):
        upto = min(many, at + PIECE)
        h = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(
            starts[at:upto].tolist(), ends[at + SHINGLE - 1 : upto + SHINGLE - 1].tolist())), np.uint64, upto - at)
        lanes = np.add.reduceat(_LANES[h.astype(">u8").view(np.uint8).reshape(-1, 8)], np.arange(0, upto - at, 255), axis=0)
        ones += lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > many).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in slices(batch):
            part = batch.slice(first, len(texts))
            made = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_d"), part.column("_t"), pa.array(made)], names=["doc_id", "_d", "_t", "c"])


# ---- keys -----------------------------------------------------------------------------------------
def _remainder(x: np.ndarray) -> np.ndarray:
    for bit in range(CODE - 1, 10, -1):
        x = np.where(x >> bit & 1, x ^ (GENERATOR << (bit - 11)), x)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the high and the low bits; for each remainder the up to six flips that lead to near codewords, and how many."""
    high, low = _remainder(np.arange(1 << 11) << 12), _remainder(np.arange(1 << 12))
    errors = [0] + [sum(1 << b for b in some) for k in (1, 2, 3) for some in combinations(range(CODE), k)]
    errors = np.array(errors)
    nearest = np.zeros(1 << 11, np.int64)
    nearest[_remainder(errors)] = errors
    ones = np.append(0, 1 << np.arange(CODE))
    flips = nearest[np.arange(1 << 11)[:, None] ^ _remainder(ones)[None, :]] ^ ones[None, :]
    known = [np.unique(row) for row in flips]
    many = np.array([len(k) for k in known])
    return high, low, np.stack([np.resize(k, 6) for k in known]), many


_HIGH, _LOW, _FLIPS, _MANY = _tables()


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each 23-bit word the codeword indices within one bit (six places, repeated where there is one), and how many."""
    rest = _HIGH[words >> 12] ^ _LOW[words & 0xFFF]
    return (words[:, None] ^ _FLIPS[rest]) >> 11, _MANY[rest]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of its fingerprint): fingerprints up to four bits apart have one in common."""
    parts = [(prints >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    near, many = zip(*(indices(p) for p in parts))
    place = np.arange(6)
    real = [place[None, :] < m[:, None] for m in many]
    whole = near[0][:, :, None, None] << 24 | near[1][:, None, :, None] << 12 | near[2][:, None, None, :]
    kept = real[0][:, :, None, None] & real[1][:, None, :, None] & real[2][:, None, None, :]
    out, owner = [whole[kept]], [np.broadcast_to(np.arange(len(prints))[:, None, None, None], whole.shape)[kept]]
    for tag, (same, off) in enumerate(((a, b) for a in range(3) for b in range(3) if a != b), 1):
        pair = parts[same][:, None] << 12 | near[off] | tag << 60
        out.append(pair[real[off]])
        owner.append(np.broadcast_to(np.arange(len(prints))[:, None], pair.shape)[real[off]])
    return np.concatenate(out), np.concatenate(owner)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = batch.column("c").to_numpy()
        for at in range(0, len(c), 512):
            part = c[at : at + 512]
            key, owner = keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[owner])], names=["bucket", "c"])


def local_groups(prints: np.ndarray, limit: int) -> np.ndarray:
    """Of each fingerprint the smallest position linked to it through the others; each is compared only with those no group has yet."""
    root, left = np.full(len(prints), -1), np.arange(len(prints))
    while len(left):
        seed, left = int(left[0]), left[1:]
        root[seed], waiting = seed, [seed]
        while waiting and len(left):
            near = np.bitwise_count(prints[left] ^ prints[waiting.pop()]) <= limit
            found, left = left[near], left[~near]
            root[found] = seed
            waiting += found.tolist()
    return root


def _links(limit: int, most: int):
    """From rows sorted by key: (a, b) for each fingerprint and the first one of its group under the key.

    A key with more than ``most`` fingerprints is not held; its rows pass as (key, a).
    """
    types = [pa.int64()] * 3

    def linked(c: np.ndarray) -> Iterator[pa.RecordBatch]:
        c = np.sort(c)
        root = local_groups(c.view(np.uint64), limit)
        own = np.flatnonzero(root != np.arange(len(c)))
        if len(own):
            yield arrow_rows(["bucket", "a", "b"], types, [pa.nulls(len(own), pa.int64()), c[own], c[root[own]]])

    def passed(key: int, c: np.ndarray) -> pa.RecordBatch:
        return arrow_rows(["bucket", "a", "b"], types, [np.full(len(c), key), c, pa.nulls(len(c), pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, many = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if 1 < many <= most:
                yield from linked(np.concatenate(held))

        for batch in batches:
            keys, c = batch.column("bucket").to_numpy(), batch.column("c").to_numpy()
            if not len(keys):
                continue
            edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            some = np.diff(edges) > 1  # a key of one row inside the batch is alone
            some[[0, -1]] = True
            for lo, hi in zip(edges[:-1][some].tolist(), edges[1:][some].tolist()):
                if keys[lo] != key:
                    yield from done()
                    key, held, many = keys[lo], [], 0
                held.append(c[lo:hi])
                many += hi - lo
                if many > most:
                    yield passed(key, np.concatenate(held))
                    held = []
        yield from done()

    return run


# ---- groups ---------------------------------------------------------------------------------------
def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, _d, _t, fingerprint (16 hex digits) and component_id for every row; ``limit`` is 4 at most."""
    if not 0 <= limit <= LIMIT:
        raise ValueError(f"the keys meet for up to {LIMIT} differing bits")
    rows = stored(keyed(docs).mapInArrow(_fingerprints, "doc_id long, _d long, _t long, c long"))
    classes = stored(rows.groupBy("c").agg(F.min("doc_id").alias("m")))
    kind = "bucket long, c long"
    keyed_classes = classes.select("c").mapInArrow(_members, "bucket long, c long")
    met = stored(keyed_classes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links(limit, HELD), "bucket long, a long, b long"))
    links, large = met.filter("bucket is null").select("a", "b").distinct(), met.filter("bucket is not null").select("bucket", F.col("a").alias("c"))

    def check(pairs: DataFrame) -> DataFrame:
        return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit).select("a", "b")

    def unpack(loads: list[int]) -> np.ndarray:
        return np.array(loads, np.int64)

    def near(load: np.ndarray, i: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = np.bitwise_count((load[at] ^ load[i]).view(np.uint64)).astype(np.int64)
        kept = np.flatnonzero(apart <= limit)
        return kept, -apart[kept]

    if large.limit(1).count():
        rest = connect(large, classes.select("c", F.col("c").alias("load")), check, unpack, near)
        links = links.unionByName(rest.select(F.col("c").alias("a"), F.col("root").alias("b")))
    linked = components(links)
    whole = classes.join(linked, "c", "left").select("c", F.coalesce("root", "c").alias("root"), "m")
    named = whole.select("c", "root").join(whole.groupBy("root").agg(F.min("m").alias("low")), "root").select("c", "low")
    return rows.join(named, "c").select("doc_id", "_d", "_t", F.lower(F.lpad(F.hex("c"), 16, "0")).alias("fingerprint"), F.coalesce("low", "doc_id").alias("component_id"))


def query(spark, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")
