"""Rotated infill texts, Golay keys and whitening against exact round trips and brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from roamlens.llm import golay, infill, whitening
from roamlens.llm.common import read
from tests.checker import compare, connect
from tests.llm.conftest import LONG

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# ---- op11 -----------------------------------------------------------------------------------------
def test_infill_equals_sql(spark, sf_dir):
    assert compare(infill.query(spark, sf_dir), connect(sf_dir), infill.SQL) == []


def test_tokens_and_rotation():
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = "".join(rng.choice(list("ab é𝄞 \t\n"), rng.integers(0, 30)))
        data = text.encode()
        tokens = [m.group().encode() for m in TOKEN.finditer(text)]
        assert infill.token_ends(data).tolist() == np.cumsum([len(x) for x in tokens]).tolist()
        first, second = sorted(rng.integers(0, len(data) + 1, 2))
        p, m, s = data[:first], data[first:second], data[second:]
        assert infill.arranged(data, first, second, "psm") == b"<P>" + p + b"<S>" + s + b"<M>" + m
        assert infill.arranged(data, first, second, "spm") == b"<S>" + s + b"<P>" + p + b"<M>" + m
        for form in ("psm", "spm"):
            assert infill.original(infill.arranged(data, first, second, form), form) == data
    buffer = bytearray(b"abcdefg")
    infill.rotate(buffer, 1, 3, 6)
    assert buffer == b"adefbcg"


def test_halves_of_sentinels_in_the_text():
    """Text that would be a sentinel with its neighbour is told from the real ones."""
    for data in (b"a<P b> <S> c".replace(b"<S>", b"<S"), b"<<<P", b">M><", b"P><S"):
        for first in range(len(data) + 1):
            for second in range(first, len(data) + 1):
                for form in ("psm", "spm"):
                    assert infill.original(infill.arranged(data, first, second, form), form) == data


def test_infill_of_awkward_rows(spark, awkward, nothing, make):
    got = infill.restored(infill.rearranged(awkward, rate=100)).collect()
    texts = {r.doc_id: r.text or "" for r in awkward.collect() if r.doc_id is not None}
    assert len(got) == 12 and all(r.restored == texts[r.doc_id] for r in got if r.doc_id is not None)
    assert {r.form for r in got if r.doc_id in (4, 5)} <= {"psm", "spm"} and [r.n for r in got if r.doc_id == 4] == [60_000]
    assert [(r.form, r.n, r.prefix_chars) for r in got if r.doc_id in (1, 2)] == [("plain", 0, None)] * 2
    assert infill.restored(infill.rearranged(nothing)).collect() == []
    marked = infill.rearranged(make(["a <P> b", "x <S>", "<M>"]), rate=100).collect()
    assert {r.form for r in marked} == {"plain"} and sorted(r.output for r in marked) == ["<M>", "a <P> b", "x <S>"]


def test_infill_shares(spark, make):
    got = infill.rearranged(make([f"some words of text {i}" for i in range(2000)])).collect()
    forms = [r.form for r in got]
    assert 900 < forms.count("plain") < 1100 and 730 < forms.count("spm") < 870
    for r in got[:50]:
        h = hashlib.sha256(f"42:{r.doc_id}".encode()).hexdigest()
        assert (r.form == "plain") == (int(h[16:24], 16) % 100 >= 50)


# ---- op13 -----------------------------------------------------------------------------------------
def _print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(prints, limit=4):
    """The smallest key reachable from each, by all pairs."""
    names, values = np.array(list(prints)), np.array(list(prints.values()), np.uint64)
    root = dict(zip(names.tolist(), names.tolist()))
    for i in range(len(names)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= limit) + i + 1:
            low, high = sorted((root[names[i]], root[names[j]]))
            root = {k: low if v == high else v for k, v in root.items()} if low != high else root
    return root


def test_golay_duplicates_equal_brute_force(spark, sf_dir):
    prints = {r.doc_id: _print(r.text) for r in read(spark, sf_dir, "documents").collect()}
    root = _groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in golay.query(spark, sf_dir).collect()}
    assert got == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}


def test_every_word_has_a_codeword_within_three_bits():
    assert np.bincount(golay._MANY).tolist() == [0, 277, 0, 0, 0, 0, 1771]
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 500)
    for a in words:
        near, many = golay.indices(np.append(a, a ^ (1 << np.arange(23))))
        own = {int(golay.indices(np.array([x]))[0][0, 0]) for x in (a,)}
        assert own <= set(near[0][: many[0]].tolist())


def test_fingerprints_four_bits_apart_share_a_key():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, 4, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    (kx, ox), (ky, oy) = golay.keys(x), golay.keys(y)
    left, right = [set(zip(k.tolist(), o.tolist())) for k, o in ((kx, ox), (ky, oy))]
    assert {o for _, o in left & right} == set(range(len(x)))
    assert len(left) == len(kx)


@pytest.mark.parametrize("held", [golay.HELD, 3])
def test_golay_links_a_hot_group_and_chains(spark, make, monkeypatch, held):
    """Fingerprints planted a few bits apart: chains, a dense group, and others just too far."""
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 4)]
    planted = []
    for i in range(60):
        planted.append(base[0] ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)))
    chain = base[1]
    for i in range(12):
        planted.append(chain)
        chain ^= sum(1 << ((5 * i + k) % 64) for k in range(4 + i % 2))
    planted += [base[2], base[2] ^ 0b11111, base[3], base[3] ^ 0b1111 << 30, 0, 0, 7]
    docs = make([f"text {i}" for i in range(len(planted))])
    kinds = "doc_id long, _d long, _t long, c long"
    signed = [v - (1 << 64) if v >> 63 else v for v in planted]
    rows = spark.createDataFrame([(i, i, i, v) for i, v in enumerate(signed)], kinds)
    monkeypatch.setattr(golay, "HELD", held)
    monkeypatch.setattr(golay, "stored", lambda df, real=golay.stored: real(rows if df.columns == ["doc_id", "_d", "_t", "c"] else df))
    got = {r.doc_id: r.component_id for r in golay.near_duplicates(docs).collect()}
    assert got == _groups(dict(enumerate(planted)))


def test_local_groups_are_those_of_all_pairs():
    rng = np.random.default_rng(6)
    for n in (1, 2, 40):
        prints = rng.integers(0, 1 << 7, n).astype(np.uint64) << np.uint64(3)
        root = golay.local_groups(prints, 1)
        want = _groups(dict(enumerate(prints.tolist())), 1)
        assert root.tolist() == [want[i] for i in range(n)]


def test_golay_of_awkward_rows(spark, awkward, nothing):
    got = golay.near_duplicates(awkward).collect()
    assert len(got) == 12 and golay.near_duplicates(nothing).collect() == []
    assert {(r.fingerprint, r.component_id) for r in got if r.doc_id in (1, 2, 3)} == {("0" * 16, 1)}
    assert len([r for r in got if r.doc_id is None and r.component_id == 1]) == 1
    assert {r.fingerprint for r in got if r.doc_id == 4} == {f"{_print(LONG):016x}"}
    assert [r.component_id for r in got if r.doc_id == 6] == [6, 6] and [r.component_id for r in got if r.doc_id == 5] == [4]
    with pytest.raises(ValueError):
        golay.near_duplicates(awkward, 5)


# ---- op12 -----------------------------------------------------------------------------------------
def _exact(x):
    c = x - x.sum(axis=0) / len(x)
    values, axes = np.linalg.eigh(c.T @ c / len(x))
    return c, values[::-1], axes[:, ::-1]


def test_whitening_equals_eigenvectors(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").toPandas()
    x = np.floor(1024 * np.array(e.embedding.tolist(), float)).astype(np.int64) + 100_000
    c, values, axes = _exact(x)
    got = whitening.query(spark, sf_dir).toPandas()
    z = got.pivot(index="vec_id", columns="component", values="whitened").loc[e.vec_id].to_numpy()
    want = c @ axes[:, :8] / np.sqrt(values[:8])
    assert np.abs(z * np.sign((z * want).sum(axis=0)) - want).max() < 1e-9
    n = len(x)
    assert (got.groupby("vec_id").deviation.first().loc[e.vec_id].to_numpy() == ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)).all()
    assert np.allclose(got.groupby("component").explained.first(), values[:8] / values.sum(), rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9 and set(got.n) == {n}


@pytest.mark.parametrize("values", [
    np.linspace(2, 1, 64), np.append(1e9, np.linspace(2, 1, 63)), np.append([5.0, 4.0], np.full(62, 1.0)), np.r_[np.full(20, 3.0), np.full(44, 1.0)],
    np.r_[9.0, 8.0, 7.0, np.zeros(61)], np.ones(64), np.zeros(64), np.geomspace(1e8, 1, 64), np.array([4.0, 2.0, 1.0])])
def test_subspace_iteration_of_many_spectra(values):
    """Flat, steep, repeated and missing eigenvalues: certified residuals, right values."""
    d = len(values)
    turn = np.linalg.qr(np.random.default_rng(7).standard_normal((d, d)))[0]
    v = turn * values @ turn.T
    wanted = min(8, d)
    got, axes, residual, passes = whitening.principal(lambda q: v @ q, d, wanted)
    assert np.allclose(got, values[:wanted], atol=1e-10 * max(values[0], 1e-30)) and passes <= 150
    assert residual < max(1e-10, 1e-15 * values[0] / max(values[wanted - 1], 1e-9)) and np.allclose(axes.T @ axes, np.eye(wanted), atol=1e-10)


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    kind = "vec_id long, embedding array<float>, n string, whitened string"
    rows = [(1, [1.0, 2.0]), (None, [3.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (8, [0.5, -1.5]), (8, [0.5, -1.5]), (9, [1e30, 0.0])]
    got = whitening.whitened(spark.createDataFrame([(*r, "x", "y") for r in rows], kind)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (8, 1), (8, 1), (8, 2), (8, 2)]
    assert {r.n for r in got} == {4} and got[0].identity_error < 1e-10
    x = np.array([[1124, 2148], [3172, 1124], [612, -1436], [612, -1436]]) + 100_000 - 100
    assert sorted({r.deviation for r in got}) == sorted(set(((4 * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist()))
    same = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], "x", "y"), (2, [1.0, 2.0], "x", "y")], kind)).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 for r in same)
    assert whitening.whitened(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None, "x", "y")], kind)).collect() == []


def test_deviation_beyond_a_long_is_null():
    middle = whitening.Centre(10**9, np.array([0, 0], np.int64))
    assert middle.deviation(np.array([[10, 0], [3 * 10**9, 1]], np.int64)) == [None if (10 * 10**9) ** 2 >= 1 << 63 else 10**20, None]
    assert whitening.Centre(4, np.array([6, 8], np.int64)).deviation(np.array([[1, 2]], np.int64)) == [(4 - 6) ** 2]
