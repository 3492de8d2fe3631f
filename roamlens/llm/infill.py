"""Fill-in-the-middle texts by block rotation inside one buffer.

A text is cut into tokens (blanks with the word after them; blanks at the end are one token). Two cuts, drawn by the SHA-256 of
``seed:doc_id``, part it into prefix, middle and suffix. Form ``plain`` leaves the text as it is (``100 - rate`` % of the texts, empty
ones, and those that hold a sentinel themselves); ``psm`` writes prefix, suffix, middle and ``spm`` suffix, prefix, middle, each
behind its sentinel. The sentinels are inserted into a bytearray of the text at the cuts, last first; then two neighbouring blocks
change places by three reversals of the buffer's own bytes (each block, then both together). Restoring finds the three sentinels,
rotates the same blocks back and deletes the sentinels, last first, so the text comes back byte for byte, from output and form alone.

Null texts are empty: plain, 0 tokens. A null id is drawn as ``seed:null``. Repeated rows get equal results; there are no ties, as
draws are remainders. Rows are independent: nothing is shuffled, and a text of any length is held once with a copy of half of it. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.llm.common import _SPACE, CHUNK, read

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, RATE, SPM = 42, 50, 80


def token_ends(data: bytes) -> np.ndarray:
    """Where the tokens of a text end, in bytes."""
    blank = np.append(_SPACE[np.frombuffer(data, np.uint8)], True)
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(ends, len(data)) if len(data) and blank[len(data) - 1] else ends


def _reverse(buffer: bytearray, lo: int, hi: int) -> None:
    """The bytes lo..hi in the other order; one half is set aside at a time."""
    half = (hi - lo) // 2
    a = np.frombuffer(buffer, np.uint8)
    front = a[lo : lo + half].copy()
    a[lo : lo + half] = a[hi - half : hi][::-1]
    a[hi - half : hi] = front[::-1]


def rotate(buffer: bytearray, lo: int, mid: int, hi: int) -> None:
    """The blocks lo..mid and mid..hi change places."""
    _reverse(buffer, lo, mid)
    _reverse(buffer, mid, hi)
    _reverse(buffer, lo, hi)


def arranged(data: bytes, first: int, second: int, form: str) -> bytes:
    """The text cut at two byte offsets, with sentinels, in the order of the form."""
    buffer = bytearray(data)
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[at:at] = mark
    first, second = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, first if form == "psm" else 0, second, len(buffer))
    return bytes(buffer)


def original(data: bytes, form: str) -> bytes:
    """The text from an output and its form."""
    if form == "plain":
        return data
    buffer = bytearray(data)
    if form == "psm":
        rotate(buffer, buffer.index(SUFFIX), buffer.index(MIDDLE), len(buffer))
    else:
        rotate(buffer, 0, buffer.index(PREFIX), len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def _points(a: np.ndarray) -> int:
    return int(np.count_nonzero((a & 0xC0) != 0x80))


def decided(data: bytes, doc_id: int | None, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Tokens, form, code points of prefix and middle, and output of one text."""
    ends = token_ends(data)
    n = len(ends)
    digest = sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    h = [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]
    if not data or h[2] % 100 >= rate or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    first, second = (0 if k == 0 else int(ends[k - 1]) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    form, a = "spm" if h[3] % 100 < spm else "psm", np.frombuffer(data, np.uint8)
    return n, form, _points(a[:first]), _points(a[first:second]), arranged(data, first, second, form)


def _text(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


_KIND = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def rearranged(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and output for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["doc_id", "n", "form", "prefix_chars", "middle_chars"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def made(held: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*held))
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), _text(columns[5])], names=[*names, "output"])

        for batch in batches:
            held, size = [], 0
            for i, data in zip(batch.column("doc_id"), _bytes(batch.column("text"))):
                held.append((i := i.as_py(), *decided(data, i, seed, rate, spm)))
                size += len(data) + 64
                if size > CHUNK:
                    yield made(held)
                    held, size = [], 0
            if held:
                yield made(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _KIND)


def restored(outputs: DataFrame) -> DataFrame:
    """The rows of ``rearranged`` with ``restored``, the text made again from output and form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            for k, (data, form) in enumerate(zip(_bytes(batch.column("output")), batch.column("form").to_pylist()), 1):
                held.append(original(data, form))
                size += len(data) + 64
                if size > CHUNK or k == batch.num_rows:
                    part = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, _text(held)], names=[*part.schema.names, "restored"])
                    first, held, size = k, [], 0

    kind = ", ".join(f"{c} {t}" for c, t in outputs.dtypes)
    return outputs.mapInArrow(run, f"{kind}, restored string")


def query(spark, folder: str) -> DataFrame:
    done = restored(rearranged(read(spark, folder, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


SQL = r"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS k FROM documents),
drawn AS (
  SELECT *, len(k) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(k) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(k) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM tokens),
parts AS (
  SELECT *, array_to_string(k[1:least(a, b)], '') AS p, array_to_string(k[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(k[greatest(a, b) + 1:], '') AS s FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
