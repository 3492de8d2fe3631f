"""Claims of stable ids against the sequential rule, bootstrap against direct resampling."""

from __future__ import annotations

import random

import numpy as np
import pytest

from roamlens.functions.tasks import walk_claims
from roamlens.operators import resolution, stats


def _sequential(claims):
    taken, got = set(), {}
    for root in sorted({r for r, _ in claims}):
        for no in sorted(n for r, n in claims if r == root):
            if no not in taken:
                taken.add(no)
                got[root] = no
                break
    return got


def _solve(spark, claims, **options):
    frame = spark.createDataFrame([(r, f"E{n:05d}", n) for r, n in claims], "root string, entity_id string, no long")
    return {r.root: int(r.entity_id[1:]) for r in resolution.solve_claims(frame, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"rounds": 0}, {"rounds": 1, "largest": 3}])
def test_claims_equal_the_sequential_rule(spark, options):
    rng = random.Random(1)
    claims = sorted({(f"r{rng.randint(0, 60):03d}", rng.randint(0, 50)) for _ in range(160)})
    assert _solve(spark, claims, **options) == _sequential(claims)


def test_a_chain_of_ten_thousand_claims(spark, monkeypatch):
    """Each root waits for the one before: solved without a round per link."""
    n, turns = 10_000, []
    monkeypatch.setattr(resolution, "cut_lineage", lambda df, real=resolution.cut_lineage: turns.append(1) or real(df))
    claims = [(f"r{i:06d}", i + k) for i in range(n) for k in (0, 1)] + [("q", 0)]
    got = _solve(spark, claims)
    assert got == {"q": 0} | {f"r{i:06d}": i + 1 for i in range(n)}
    assert len(turns) < 32  # rounds of doubling and of claims together, each of them one written table or two


def test_walk_takes_the_lowest_free_id():
    import pandas as pd

    got = walk_claims(pd.DataFrame({"root": ["b", "b", "a", "c"], "entity_id": ["E1", "E2", "E1", "E2"], "no": [1, 2, 1, 2]}))
    assert dict(zip(got.root, got.entity_id)) == {"a": "E1", "b": "E2"}


def test_bootstrap_interval_equals_direct_resampling(spark):
    rng = np.random.default_rng(4)
    rows, sides = [], {}
    for kind, n, rate in (("PLACE", 400, 0.7), ("FOOD", 90, 0.4), ("ONE", 1, 1.0)):
        named = rng.integers(1, 7, n)
        kept = rng.binomial(named, rate)
        sides[kind] = named, kept
        rows += [(kind, i, True, k < kept[i]) for i in range(n) for k in range(named[i])] + [(kind, i, False, True) for i in range(min(n, 20))]
    frame = spark.createDataFrame([(k, i, o, bool(t)) for k, i, o, t in rows], "entity_type string, review_id long, in_original boolean, in_translation boolean")
    got = {r.entity_type: (r.low, r.high) for r in stats.bootstrap_interval(frame).collect()}
    for kind, (named, kept) in sides.items():
        draws = rng.integers(0, len(named), (20_000, len(named)))
        rates = np.sort(kept[draws].sum(axis=1) / named[draws].sum(axis=1))
        assert abs(got[kind][0] - rates[500]) < 0.005 and abs(got[kind][1] - rates[19_499]) < 0.005
    assert got == {r.entity_type: (r.low, r.high) for r in stats.bootstrap_interval(frame.repartition(3)).collect()}
