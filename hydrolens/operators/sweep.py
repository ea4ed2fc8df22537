"""Which edges of one or two outlines may meet, without a matrix of all edges.

The plane is halved again and again at the median of the edges, along the longer side of the box that both sides share. An edge that
lies on the cut goes to both halves. Edges outside the shared box drop out, so two outlines that only touch at a corner end after a
few halvings. A part is handed out when it holds few pairs; parts that no cut makes smaller, such as a bundle of edges through one point, are
handed out in strips of bounded size. Work is n log n for outlines whose edges are short, and memory is in proportion to the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of a part that are tested together, and of one strip of a part that cannot be cut.
PART, STRIP = 4096, 1 << 18


def boxes(edges: np.ndarray) -> np.ndarray:
    """x0, y0, x1, y1 of edges given by their end points."""
    return np.hstack([np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])])


def _within(box: np.ndarray, which: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    own = box[which]
    return which[(own[:, :2] <= high).all(axis=1) & (own[:, 2:] >= low).all(axis=1)]


def _halves(box: np.ndarray, which: np.ndarray, axis: int, at: float):
    return which[box[which, axis] <= at], which[box[which, axis + 2] >= at]


def near_edges(s: np.ndarray, t: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays (i, j) of small parts; every pair of edges of ``s`` and ``t`` (or of ``s`` alone) whose boxes meet is in a part.

    A pair may be in several parts.
    """
    a = boxes(s)
    b = a if t is None else boxes(t)
    stack = [(np.arange(len(a)), np.arange(len(b)))]
    while stack:
        i, j = stack.pop()
        if not len(i) or not len(j):
            continue
        # Only what both sides share can meet.
        low = np.maximum(a[i, :2].min(axis=0), b[j, :2].min(axis=0))
        high = np.minimum(a[i, 2:].max(axis=0), b[j, 2:].max(axis=0))
        if (low > high).any():
            continue
        if t is not None:
            i, j = _within(a, i, low, high), _within(b, j, low, high)
        if len(i) * len(j) <= PART:
            if len(i) and len(j):
                yield i, j
            continue
        for axis in np.argsort(low - high):
            middle = np.median(np.concatenate([a[i, axis] + a[i, axis + 2], b[j, axis] + b[j, axis + 2]])) / 2
            (left_i, right_i), (left_j, right_j) = _halves(a, i, axis, middle), _halves(b, j, axis, middle)
            if max(len(left_i) * len(left_j), len(right_i) * len(right_j)) <= 0.7 * len(i) * len(j):
                stack += [(left_i, left_j), (right_i, right_j)]
                break
        else:
            step = max(1, STRIP // len(j))
            for at in range(0, len(i), step):
                yield i[at:at + step], j
