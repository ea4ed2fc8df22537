"""Edge tests by halving against the matrix of all edges."""

import resource

import numpy as np
import pytest

from hydrolens.operators import polygons
from hydrolens.operators.sweep import near_edges


def star(rng, n, wild=0.0):
    """A ring around the origin; ``wild`` moves single vertices far out, so that edges may cross."""
    angle = np.sort(rng.uniform(0, 2 * np.pi, n)) + wild * rng.standard_normal(n)
    radius = rng.uniform(0.5, 1.5, n)
    ring = np.column_stack([radius * np.cos(angle), radius * np.sin(angle)])
    return np.vstack([ring, ring[:1]])


def matrix_crosses(ring):
    s = polygons._segments(ring)
    n = len(s)
    i, j = np.nonzero(np.triu(polygons._edges_meet(s, s, proper=False), 2))
    return n >= 4 and bool(np.any(~((i == 0) & (j == n - 1))))


def test_rings_equal_the_matrix():
    rng = np.random.default_rng(3)
    seen = set()
    for k in range(1000):
        ring = star(rng, int(rng.integers(3, 160)), wild=rng.choice([0.0, 0.0, 0.001, 0.05]))
        if k % 4 == 0:
            ring = np.round(ring * 6)  # many touching and repeated vertices
        seen.add(want := matrix_crosses(ring))
        assert polygons._ring_crosses(ring) == want
    assert seen == {True, False}


def test_pairs_equal_the_matrix():
    rng = np.random.default_rng(4)
    seen = set()
    for _ in range(400):
        a, b = polygons._segments(star(rng, int(rng.integers(3, 200)))), polygons._segments(star(rng, int(rng.integers(3, 200))) * 0.3 + rng.uniform(-2, 2, 2))
        seen.add(want := bool(polygons._edges_meet(a, b, proper=False).any()))
        assert polygons._any_meet(a, b) == want
        met = {(x, y) for i, j in near_edges(a, b) for x in i.tolist() for y in j.tolist()}
        assert set(zip(*(k.tolist() for k in np.nonzero(polygons._edges_meet(a, b, proper=False))))) <= met
    assert seen == {True, False}


def test_edges_through_one_point():
    """No cut parts them; they are tested in strips."""
    angle = np.linspace(0, np.pi, 900, endpoint=False)
    end = np.column_stack([np.cos(angle), np.sin(angle)])
    edges = np.hstack([-end, end])
    assert polygons._any_meet(edges, edges + [0.0, 5.0, 0.0, 5.0]) is False
    assert max(len(i) * len(j) for i, j in near_edges(edges)) <= 1 << 18


def test_long_rings_need_little_memory():
    """100,000 vertices; the matrix would need 80 GB."""
    rng = np.random.default_rng(5)
    n = 100_000
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
    radius = 1 + 0.3 * np.cos(40 * angle) + rng.uniform(0, 1e-6, n)
    ring = np.column_stack([radius * np.cos(angle), radius * np.sin(angle)])
    ring = np.vstack([ring, ring[:1]])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert not polygons._ring_crosses(ring)
    a = polygons._segments(ring)
    assert polygons._any_meet(a, a + 0.1) and not polygons._any_meet(a, polygons._segments(ring * 0.5))
    crossed = ring.copy()
    crossed[[20_000, 20_003]] = crossed[[20_003, 20_000]]
    assert polygons._ring_crosses(crossed)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000


def test_union_of_long_outlines_has_its_area():
    """Trapezoids of rings with many vertices add up to the polygon's area."""
    rng = np.random.default_rng(6)
    ring = star(rng, 3000)
    pieces = polygons.union_trapezoids([[ring], [ring * 0.5]])
    assert sum(polygons._ring_area(p, True) for p in pieces) == pytest.approx(polygons._ring_area(ring, True), rel=1e-9)
