"""Parity sketches and hubs of the n-gram Jaccard join."""

import numpy as np
import pyarrow as pa
import pytest

from triplewright.llm import jaccard_join as J


def some_sets(rng, n):
    out = []
    while len(out) < n:
        base = np.unique(rng.integers(0, 2**63, int(np.exp(rng.uniform(0, 9)))).astype(np.uint64))
        out.append(base)
        for _ in range(int(rng.integers(0, 4))):
            new = rng.integers(0, 2**63, rng.integers(0, len(base) // 8 + 2)).astype(np.uint64)
            out.append(np.unique(np.concatenate([rng.permutation(base)[rng.integers(0, len(base) // 8 + 2) :], new])))
    return [x for x in out[:n] if len(x)]


def differ(a, b):
    a, b = (np.frombuffer(x, np.uint64)[None] for x in sorted((a, b), key=len))
    return int(np.bitwise_count(a ^ J.folded(b, a.shape[1])).sum())


def test_sketches_differ_in_no_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(1)
    sets = some_sets(rng, 120)
    drawn = J.sketches(sets)
    assert all(8 * len(d) >= max(len(s), J.SKETCH_BITS) for d, s in zip(drawn, sets, strict=True))
    for i in range(len(sets)):
        for j in range(i):
            assert differ(drawn[i], drawn[j]) <= len(np.setxor1d(sets[i], sets[j]))
    large = [np.unique(rng.integers(0, 2**63, 6000).astype(np.uint64)) for _ in range(2)]
    assert differ(*J.sketches(large)) > 0.3 * 6000  # sets that share nothing are told apart at any size


@pytest.mark.parametrize("few", [0, 1000])
def test_hubs_keep_every_pair_that_may_be_linked(monkeypatch, few):
    monkeypatch.setattr(J, "FEW", few)
    rng = np.random.default_rng(2)
    sets = some_sets(rng, 150)
    drawn, size = J.sketches(sets), [len(s) for s in sets]
    table = pa.table({"hub": [0] * len(sets), "node": list(range(len(sets))), "n_shingles": size, "sketch": pa.array(drawn, pa.binary())})
    found = J._compatible(80)(table)
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True):
        assert root(a) != root(b)  # spanning edges only
        up[root(a)] = root(b)
    want = 0
    for i in range(len(sets)):
        for j in range(i):
            near = max(size[i], size[j]) * 80 <= 100 * min(size[i], size[j]) and 180 * differ(drawn[i], drawn[j]) <= 20 * (size[i] + size[j])
            both = len(np.intersect1d(sets[i], sets[j]))
            assert near or 100 * both < 80 * (size[i] + size[j] - both)
            want += near
            assert not near or root(i) == root(j)
    assert want > 20


def test_windows_and_pivots_spare_comparisons(monkeypatch):
    """Two far clusters of chains: regions and the distances to pivots rule most pairs out, and no link is lost."""
    rng = np.random.default_rng(6)
    sets = []
    for c in range(2):
        now = np.unique(rng.integers(0, 2**40, 300).astype(np.uint64))
        for _ in range(60):
            now = np.unique(np.concatenate([rng.permutation(now)[8:], rng.integers(0, 2**40, 8).astype(np.uint64)]))
            sets.append(now)
    compared = []
    shared = J.Sets.shared
    monkeypatch.setattr(J.Sets, "shared", lambda self, i, among=None: (compared.append(0 if among is None else len(among)), shared(self, i, among))[1])
    roots = J.join_region(sets, 80)
    assert set(roots.tolist()) == {0, 60}
    near = J.linked(np.array([len(np.intersect1d(sets[0], s)) for s in sets]), len(sets[0]), np.array([len(s) for s in sets]), 80)
    assert near.sum() < 30  # the chains' ends aren't linked directly
    assert sum(compared) < 120 * 119 / 2 / 4


def test_known_groups_are_not_compared_again(monkeypatch):
    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(0, 2**40, 200).astype(np.uint64))
    sets = [np.unique(np.append(base, np.uint64(i))) for i in range(20)]
    monkeypatch.setattr(J.Sets, "shared", lambda self, i, among=None: pytest.fail("compared"))
    assert J.join_region(sets, 80, [b"one"] * 20).tolist() == [0] * 20


def test_pivots_of_a_hub_rule_pairs_out():
    """Unrelated sets of like size: most pairs are told apart by their distances to pivots alone."""
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, int(n)).astype(np.uint64)) for n in rng.integers(150, 170, 200)]
    d = J.pivot_distances(np.concatenate([np.frombuffer(x, np.uint64)[None] for x in J.sketches(sets)]))
    assert d.shape == (200, J.HUB_PIVOTS)
    near = (np.abs(d[:, None] - d[None]) <= 5 * 320 // 95).all(2)  # at 90 % and these sizes
    assert near.mean() < 0.7
