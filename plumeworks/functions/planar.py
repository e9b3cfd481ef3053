"""Kernels over numpy arrays of points and segments ``(n, 4)``: nearest segments and linked segments without all pairs."""

from __future__ import annotations

import numpy as np

#: Pairs that are measured at once instead of being divided further.
PAIRS = 1 << 14
#: What a bound is widened by, as a part of the coordinates, so that rounding drops no pair.
SLACK = 1e-9


def to_segments(x, y, s: np.ndarray) -> np.ndarray:
    """Distances from points to segments, by the arithmetic of geometry.to_segment; arguments broadcast."""
    x1, y1 = s[..., 0], s[..., 1]
    dx, dy = s[..., 2] - x1, s[..., 3] - y1
    q = dx * dx + dy * dy
    t = np.clip(((x - x1) * dx + (y - y1) * dy) / np.where(q == 0, np.inf, q), 0.0, 1.0)
    u, v = x - (x1 + t * dx), y - (y1 + t * dy)
    return np.sqrt(u * u + v * v)


def feet(xy: np.ndarray, segs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of the place on each segment that is nearest to its point."""
    d = segs[:, 2:] - segs[:, :2]
    q = (d * d).sum(1)
    t = np.clip(((xy - segs[:, :2]) * d).sum(1) / np.where(q == 0, np.inf, q), 0.0, 1.0)
    return segs[:, 0] + t * d[:, 0], segs[:, 1] + t * d[:, 1]


def nearest(xy: np.ndarray, segs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the nearest segment of each point, ties to the first.

    Points are halved; a part keeps the segments that can be nearest to any of its
    points: those within its middle's least distance and its width.
    """
    place, dist = np.zeros(len(xy), np.int64), np.full(len(xy), np.inf)
    slack = SLACK * (1 + max(np.abs(xy).max(initial=0.0), np.abs(segs).max(initial=0.0)))
    todo = [(np.arange(len(xy)), np.arange(len(segs)))] if len(xy) and len(segs) else []
    while todo:
        some, near = todo.pop()
        low, high = xy[some].min(0), xy[some].max(0)
        middle, wide = (low + high) / 2, high - low
        if len(some) > 1 and len(near) > 1:
            d = to_segments(middle[0], middle[1], segs[near])
            near = near[d <= d.min() + np.hypot(*wide) + slack]
        if len(some) == 1 or len(some) * len(near) <= PAIRS:
            d = to_segments(xy[some, 0][:, None], xy[some, 1][:, None], segs[near][None])
            best = d.argmin(1)
            place[some], dist[some] = near[best], d[np.arange(len(some)), best]
        else:
            half = np.argpartition(xy[some, int(wide[1] > wide[0])], len(some) // 2)
            todo += [(some[half[: len(some) // 2]], near), (some[half[len(some) // 2 :]], near)]
    return place, dist


def within(xy: np.ndarray, segs: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, segment, distance) of all pairs within a distance. Points are halved; a part keeps the segments that come near enough to any of its points."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    slack = SLACK * (1 + max(np.abs(xy).max(initial=0.0), np.abs(segs).max(initial=0.0)))
    todo = [(np.arange(len(xy)), np.arange(len(segs)))] if len(xy) and len(segs) else []
    while todo:
        some, near = todo.pop()
        low, high = xy[some].min(0), xy[some].max(0)
        middle, wide = (low + high) / 2, high - low
        near = near[to_segments(middle[0], middle[1], segs[near]) <= reach + np.hypot(*wide) / 2 + slack]
        if len(some) == 1 or len(some) * len(near) <= PAIRS:
            d = to_segments(xy[some, 0][:, None], xy[some, 1][:, None], segs[near][None])
            a, b = np.nonzero(d <= reach)
            out.append((some[a], near[b], d[a, b]))
        else:
            half = np.argpartition(xy[some, int(wide[1] > wide[0])], len(some) // 2)
            todo += [(some[half[: len(some) // 2]], near), (some[half[len(some) // 2 :]], near)]
    p, s, d = (np.concatenate(c) for c in zip(*out))
    return p, s, d


def meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether segments have a place in common, an end on the other one too: by the sides on which ends are, as a foot that is computed may be beside its segment."""
    side = lambda p, x, y: (p[:, 2] - p[:, 0]) * (y - p[:, 1]) - (p[:, 3] - p[:, 1]) * (x - p[:, 0])
    out = (side(a, b[:, 0], b[:, 1]) * side(a, b[:, 2], b[:, 3]) <= 0) & (side(b, a[:, 0], a[:, 1]) * side(b, a[:, 2], a[:, 3]) <= 0)
    for c in (0, 1):  # those in one line
        out &= (np.minimum(a[:, c], a[:, c + 2]) <= np.maximum(b[:, c], b[:, c + 2])) & (np.minimum(b[:, c], b[:, c + 2]) <= np.maximum(a[:, c], a[:, c + 2]))
    return out


def _close(a: np.ndarray, b: np.ndarray, near: float) -> np.ndarray:
    """Whether segments come within a distance: by an end of one, or as they meet."""
    d = np.minimum(np.minimum(to_segments(a[:, 0], a[:, 1], b), to_segments(a[:, 2], a[:, 3], b)), np.minimum(to_segments(b[:, 0], b[:, 1], a), to_segments(b[:, 2], b[:, 3], a)))
    return (d <= near) | meets(a, b)


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each node's is the smallest node of its class) after the pairs a, b of nodes are united."""
    while True:
        p, q = label[a], label[b]
        if (p == q).all():
            return label
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]


def linked(node: np.ndarray, segs: np.ndarray, near: float) -> np.ndarray:
    """The smallest node that each node (numbers from 0) can reach over segments within a distance of one another.

    Only pairs of different classes are measured. A box of segments that are of one class
    is done; others first try pairs at random, while many of them link, and are then
    quartered: two segments that are near have a place within half the distance of both,
    and are found in the quarter with that place. Where quarters do not part the pairs
    any more, all that are left are measured, so none is lost.
    """
    n = int(node.max(initial=-1)) + 1
    label, rng = np.arange(n), np.random.default_rng(0)
    if not len(segs):
        return label
    reach = near / 2 + SLACK * (1 + np.abs(segs).max() + near)
    low_x, high_x, low_y, high_y = np.minimum(segs[:, 0], segs[:, 2]), np.maximum(segs[:, 0], segs[:, 2]), np.minimum(segs[:, 1], segs[:, 3]), np.maximum(segs[:, 1], segs[:, 3])
    dx, dy = segs[:, 2] - segs[:, 0], segs[:, 3] - segs[:, 1]

    def apart(some: np.ndarray) -> int:
        """Twice the number of pairs of different classes."""
        c = np.bincount(np.unique(label[node[some]], return_inverse=True)[1])
        return len(some) ** 2 - int((c * c).sum())

    def test(a: np.ndarray, b: np.ndarray) -> int:
        nonlocal label
        of = label[node[a]] != label[node[b]]
        a, b = a[of], b[of]
        hit = _close(segs[a], segs[b], near)
        label = unite(label, node[a[hit]], node[b[hit]])
        return int(hit.sum())

    def measure(some: np.ndarray) -> None:
        """All pairs of different classes, a few rows at a time; classes that grow leave fewer."""
        step = max(1, 16 * PAIRS // len(some))
        for k in range(0, len(some), step):
            rows = some[k : k + step]
            a, b = np.nonzero(label[node[rows]][:, None] != label[node[some[k:]]][None])
            test(rows[a], some[k:][b])

    def inside(some: np.ndarray, x: float, y: float, w: float, h: float) -> np.ndarray:
        """Segments within reach of the box with the middle x, y and half the sides w, h."""
        w, h = w + reach, h + reach
        s = some[(low_x[some] <= x + w) & (high_x[some] >= x - w) & (low_y[some] <= y + h) & (high_y[some] >= y - h)]
        off = np.abs((x - segs[s, 0]) * dy[s] - (y - segs[s, 1]) * dx[s])
        return s[off <= (np.abs(dx[s]) * h + np.abs(dy[s]) * w) * (1 + SLACK) + reach * SLACK]

    x, y = (low_x.min() + high_x.max()) / 2, (low_y.min() + high_y.max()) / 2
    todo = [(np.arange(len(segs)), x, y, high_x.max() - x, high_y.max() - y)]
    while todo:
        some, x, y, w, h = todo.pop()
        left = apart(some)
        while left > PAIRS and test(some, rng.permutation(some)) * 16 > len(some):
            left = apart(some)
        if 0 < left <= PAIRS:
            measure(some)
        elif left:
            parts = [(inside(some, x + i * w / 2, y + j * h / 2, w / 2, h / 2), x + i * w / 2, y + j * h / 2, w / 2, h / 2) for i in (-1, 1) for j in (-1, 1)]
            if sum(apart(p[0]) for p in parts) > 0.7 * left:
                measure(some)
            else:
                todo += parts
    return label
