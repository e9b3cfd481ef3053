"""The arrangement of ``polygons`` for many groups of small polygons at once, over flat arrays.

Shapes are arrays with offsets, as Arrow has them: points, the first point of each ring,
the first ring of each polygon and the first polygon of each group. Results are the
parts that ``polygons.intersection`` or ``polygons.union`` gives for each group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .polygons import BLOCK, CLOSE, Polygon, _chained, _combined, _parts, area, meetings

#: Points of the groups that are done at once, about, and edges times polygons of a group up to which it is done with others.
POINTS, SMALL = 1 << 15, 1 << 16


@dataclass
class Shapes:
    """points ``(n, 2)``; rings, polygons and groups: offsets into the level below, each with the end as its last."""

    points: np.ndarray
    rings: np.ndarray
    polygons: np.ndarray
    groups: np.ndarray

    def slice(self, low: int, high: int) -> Shapes:
        """Groups from low to before high."""
        g = self.groups[low : high + 1]
        p = self.polygons[g[0] : g[-1] + 1]
        r = self.rings[p[0] : p[-1] + 1]
        return Shapes(self.points[r[0] : r[-1]], r - r[0], p - p[0], g - g[0])


    def plain(self, group: int) -> list[Polygon]:
        """A group's polygons as lists of points."""
        ring = lambda r: list(map(tuple, self.points[self.rings[r] : self.rings[r + 1]].tolist()))
        return [[ring(r) for r in range(*self.polygons[p : p + 2])] for p in range(*self.groups[group : group + 2])]

    @staticmethod
    def of(groups: list[list[Polygon]]) -> Shapes:
        polygons = [p for g in groups for p in g]
        rings = [np.asarray(r, float).reshape(-1, 2) for p in polygons for r in p]
        sizes = lambda x: np.r_[0, np.cumsum([len(y) for y in x])].astype(int)
        return Shapes(np.concatenate([np.zeros((0, 2)), *rings]), sizes(rings), sizes(polygons), sizes(groups))

    def side_by_side(self, other: Shapes) -> Shapes:
        """Groups of one polygon of self and one of other, both of as many polygons."""
        n, r = len(self.polygons) - 1, len(self.rings) - 1
        rings, polygons = np.r_[self.rings, other.rings[1:] + self.rings[-1]], np.r_[self.polygons, other.polygons[1:] + r]
        by = np.arange(2 * n).reshape(2, n).T.reshape(-1)
        _, ring = _spans(polygons[by], polygons[by + 1])
        _, point = _spans(rings[ring], rings[ring + 1])
        points = np.concatenate([self.points, other.points])[point]
        return Shapes(points, np.r_[0, np.cumsum(np.diff(rings)[ring])], np.r_[0, np.cumsum(np.diff(polygons)[by])], np.arange(0, 2 * n + 1, 2))


def _spans(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, member) for all members first[row] <= member < end[row]."""
    n = np.maximum(end - first, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]


def _of(offsets: np.ndarray) -> np.ndarray:
    """The number of the parent of each member."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _offsets(parent: np.ndarray, n: int) -> np.ndarray:
    return np.r_[0, np.cumsum(np.bincount(parent, minlength=n))]


def _least(x: np.ndarray, parent: np.ndarray, n: int, of=np.minimum, empty: float = np.inf) -> np.ndarray:
    """The least (or most) of x by parent, of which x is in the order."""
    out = np.full((n, *x.shape[1:]), empty)
    if len(x):
        starts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        out[parent[starts]] = of.reduceat(x, starts)
    return out


def _within(xy: np.ndarray, edges: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each point is inside the polygon of its own range of edges, by the even-odd rule."""
    out, total = np.zeros(len(xy), bool), np.cumsum(np.maximum(end - first, 0))
    x1, y1, x2, y2 = map(np.ascontiguousarray, edges.T)
    slope = (x2 - x1) / np.where(y2 == y1, 1.0, y2 - y1)
    for low, high in blocks(np.r_[0, total]):
        row, e = _spans(first[low:high], end[low:high])
        y = xy[low:high, 1][row]
        level = np.flatnonzero((y1[e] > y) != (y2[e] > y))
        row, e, y = row[level], e[level], y[level]
        hit = xy[low:high, 0][row] < slope[e] * (y - y1[e]) + x1[e]
        out[low:high] = np.bincount(row[hit], minlength=high - low) % 2 == 1
    return out


def _meet(a: list[np.ndarray], i: np.ndarray, b: list[np.ndarray], j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of boxes of a and b meet; boxes are ``low x, low y, high x, high y``."""
    at = np.flatnonzero((a[0][i] <= b[2][j]) & (a[2][i] >= b[0][j]))
    i, j = i[at], j[at]
    return at[(a[1][i] <= b[3][j]) & (a[3][i] >= b[1][j])]


def blocks(total: np.ndarray, most: int = BLOCK):
    """(low, high) of runs of members with about ``most`` units, by their running total."""
    low, n = 0, len(total) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(total, total[low] + most, "right")) - 1)
        yield low, high
        low = high


def _directed(s: Shapes, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, their polygon): each with its polygon on the left; rings without an area and edges without a length are left out."""
    ring, n = _of(s.rings), len(s.rings) - 1
    a = np.flatnonzero(ring[1:] == ring[:-1])
    edges, ring = np.c_[xy[a], xy[a + 1]], ring[a]
    start = xy[np.minimum(s.rings[:-1], max(len(xy) - 1, 0))] if len(xy) else np.zeros((n, 2))
    p, q = edges[:, :2] - start[ring], edges[:, 2:] - start[ring]
    twice = np.bincount(ring, p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1], n)
    use = (twice != 0) & (np.diff(s.rings) > 3)
    edges, ring = edges[use[ring]], ring[use[ring]]
    polygon, offs = _of(s.polygons), _offsets(ring, n)
    # the number of other rings of the polygon that hold most of a ring's edges
    many = np.bincount(polygon[use], minlength=len(s.polygons) - 1)[polygon] > 1
    mine, other = _spans(s.polygons[polygon], s.polygons[polygon + 1])
    both = many[mine] & use[mine] & use[other] & (mine != other)
    mine, other = mine[both], other[both]
    at, e = _spans(offs[mine], offs[mine + 1])
    middle = (edges[e, :2] + edges[e, 2:]) / 2
    held = np.bincount(at[_within(middle, edges, offs[other[at]], offs[other[at] + 1])], minlength=len(mine))
    depth = np.bincount(mine[held * 2 > offs[mine + 1] - offs[mine]], minlength=n)
    turned, at = ((twice > 0) == (depth % 2 == 1))[ring], np.arange(len(ring))
    edges = edges[np.where(turned, offs[ring] + offs[ring + 1] - 1 - at, at)]
    edges = np.where(turned[:, None], edges[:, [2, 3, 0, 1]], edges)
    long = (edges[:, :2] != edges[:, 2:]).any(1)
    return edges[long], polygon[ring[long]]


def _pairs(edges: np.ndarray, polygon: np.ndarray, group: np.ndarray, offs: np.ndarray, last: np.ndarray):
    """Pairs of edges of different polygons of a group with boxes that meet, in blocks."""
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    n = len(offs) - 1
    box = [np.ascontiguousarray(c) for c in (*low.T, *high.T)]
    whole = [np.ascontiguousarray(c) for c in (*_least(low, polygon, n).T, *_least(high, polygon, n, np.maximum, -np.inf).T)]
    i, b = _spans(polygon + 1, last[group[polygon]])
    meet = _meet(box, i, whole, b)
    i, b = i[meet], b[meet]
    for k, m in blocks(np.r_[0, np.cumsum(offs[b + 1] - offs[b])]):
        row, j = _spans(offs[b[k:m]], offs[b[k:m] + 1])
        e = i[k:m][row]
        hit = _meet(box, e, box, j)
        yield e[hit], j[hit]


def in_runs(s: Shapes, every: bool):
    """(first group, parts, areas) of runs of groups, as ``combined`` has them; a group of many edges is done by itself."""
    points = s.rings[s.polygons[s.groups]]
    n, polygons, rings = np.diff(points), np.diff(s.groups), np.diff(s.polygons[s.groups])
    large = n * np.maximum(polygons, rings) > SMALL
    for low, high in blocks(np.r_[0, np.cumsum(np.where(large, POINTS, n + 1))], POINTS):
        if not large[low:high].any():
            yield low, *combined(s.slice(low, high), every)
            continue
        for g in range(low, high):
            if large[g]:
                parts = _combined(s.plain(g), every)
                one = Shapes.of([parts])
                yield g, one, np.array([area(parts)])
            else:
                yield g, *combined(s.slice(g, g + 1), every)


def combined(s: Shapes, every: bool) -> tuple[Shapes, np.ndarray]:
    """(the parts of what is in all polygons of a group, or in any, and the area of each group's): the groups of the result are those of s, its polygons the parts."""
    groups, n = _of(s.groups), len(s.groups) - 1
    owner_group = groups  # the group of each polygon
    point_group = groups[_of(s.polygons)[_of(s.rings)]] if len(s.points) else np.zeros(0, int)
    low, high = _least(s.points, point_group, n), _least(s.points, point_group, n, np.maximum, -np.inf)
    seen = np.isfinite(low[:, :1])
    low, high = np.where(seen, low, 0.0), np.where(seen, high, 0.0)
    origin, close = (low + high) / 2, CLOSE * np.maximum((high - low).max(1), 1e-300)
    own, polygon = _directed(s, s.points - origin[point_group])
    count = np.bincount(polygon, minlength=len(owner_group))
    if every:  # a polygon without an area shares none
        whole = np.bincount(owner_group[count == 0], minlength=n) == 0
        own, polygon = own[whole[owner_group[polygon]]], polygon[whole[owner_group[polygon]]]
    offs = _offsets(polygon, len(owner_group))
    pairs = _pairs(own, polygon, owner_group, offs, s.groups[1:])
    near = close[owner_group[polygon]]
    which, at = meetings(own, pairs, near)
    same = which[1:] == which[:-1]
    a, b, owner = at[:-1][same], at[1:][same], polygon[which[:-1][same]]
    # places of a group that agree within twice the closeness are one node
    ends, of = np.r_[a, b], np.tile(owner_group[owner], 2)
    cell = np.round(ends / (2 * close[of])[:, None])
    by = np.lexsort((cell[:, 1], cell[:, 0], of))
    new = np.r_[True, (np.diff(of[by]) != 0) | (np.diff(cell[by], axis=0) != 0).any(1)] if len(by) else np.zeros(0, bool)
    node = np.empty(len(by), int)
    node[by] = np.cumsum(new) - 1
    place = np.zeros((int(new.sum()), 2))
    place[node] = ends
    u, v = node[: len(a)], node[len(a) :]
    real = u != v
    u, v, owner = u[real], v[real], owner[real]
    code = u * len(place) + v
    keys, first, key = np.unique(code, return_index=True, return_inverse=True)
    u, v = u[first], v[first]
    of = owner_group[owner[first]]
    back = v * len(place) + u
    found = np.searchsorted(keys, back)
    keep = keys[np.minimum(found, max(len(keys) - 1, 0))] != back if len(keys) else np.zeros(0, bool)
    owned = np.unique(key * max(len(owner_group), 1) + owner)
    along = np.bincount(owned // max(len(owner_group), 1), minlength=len(keys))
    middle = (place[u] + place[v]) / 2
    low, high = np.minimum(own[:, :2], own[:, 2:]), np.maximum(own[:, :2], own[:, 2:])
    whole = [*_least(low, polygon, len(owner_group)).T, *_least(high, polygon, len(owner_group), np.maximum, -np.inf).T]
    x, y = map(np.ascontiguousarray, middle.T)
    k, p = _spans(np.where(keep, s.groups[of], 0), np.where(keep, s.groups[of + 1], 0))
    meet = _meet([x, y, x, y], k, whole, p)
    k, p = k[meet], p[meet]
    at = k * len(owner_group) + p
    look = owned[np.minimum(np.searchsorted(owned, at), max(len(owned) - 1, 0))] != at if len(owned) else np.zeros(0, bool)
    k, p = k[look], p[look]
    k = k[_within(middle[k], own, offs[p], offs[p + 1])]
    inner = np.bincount(k, minlength=len(keys))
    keep &= along + inner == np.diff(s.groups)[of] if every else inner == 0
    by = np.flatnonzero(keep)
    by = by[np.lexsort((first[by], of[by]))]
    return _assembled(u[by], v[by], of[by], place, origin, close)


def _assembled(a: np.ndarray, b: np.ndarray, group: np.ndarray, place: np.ndarray, origin: np.ndarray, close: np.ndarray) -> tuple[Shapes, np.ndarray]:
    """Directed edges as rings, and these as parts of their groups; ``polygons`` does the groups with places that several rings pass and with holes in one of several parts."""
    n, m = len(origin), len(place)
    odd = (np.bincount(a, minlength=m) != np.bincount(b, minlength=m)) | (np.bincount(a, minlength=m) > 1)
    hard = np.bincount(group[odd[a] | odd[b]], minlength=n) > 0
    plain = np.flatnonzero(~hard[group])
    leave = np.zeros(m, int)
    leave[a[plain]] = plain
    after = np.zeros(len(a), int)
    after[plain] = leave[b[plain]]
    label, jump = np.arange(len(a)), after
    while True:
        less = np.minimum(label[plain], label[jump[plain]])
        if (less == label[plain]).all():
            break
        label[plain] = less
        jump = jump[jump]
    heads = plain[label[plain] == plain]
    rings, turn, edge, now, left = np.arange(len(heads)), [], [], heads.copy(), np.arange(len(heads))
    while len(left):
        turn.append(left)
        edge.append(now)
        now = after[now]
        on = now != heads[left]
        left, now = left[on], now[on]
    turn, edge = (np.concatenate(x) if x else np.zeros(0, int) for x in (turn, edge))
    by = np.argsort(turn, kind="stable")
    turn, edge = turn[by], edge[by]
    size = np.bincount(turn, minlength=len(rings))
    starts = np.cumsum(size) - size
    p, q = place[a[edge]], place[b[edge]]
    zero = place[a[heads]][turn]
    twice = np.bincount(turn, (p[:, 0] - zero[:, 0]) * (q[:, 1] - zero[:, 1]) - (q[:, 0] - zero[:, 0]) * (p[:, 1] - zero[:, 1]), len(rings)) if len(turn) else np.zeros(len(rings))
    of, tiny = group[heads], close[group[heads]] ** 2
    outer, hole = twice > tiny, twice < -tiny
    parts = np.bincount(of[outer], minlength=n)
    # of several parts, the order and the holes need their places
    by = np.lexsort((twice, of))
    tied = np.flatnonzero(outer[by][1:] & outer[by][:-1] & (of[by][1:] == of[by][:-1]) & (twice[by][1:] == twice[by][:-1]))
    later = np.zeros(n, bool)
    later[of[by[tied]]] = True
    later |= (np.bincount(of[hole], minlength=n) > 0) & (parts > 1)
    done = (outer | hole) & ~later[of] & (parts[of] > 0)
    order = np.flatnonzero(done)
    order = order[np.lexsort((twice[order], hole[order], of[order]))]
    slow: dict[int, list] = {}
    for r in np.flatnonzero(later[of]).tolist():
        e = edge[starts[r] : starts[r] + size[r]]
        slow.setdefault(int(of[r]), []).append(place[np.r_[a[e], b[e[-1]]]])
    bounds = np.searchsorted(group, np.arange(n + 1))
    for g in np.flatnonzero(hard).tolist():
        some = slice(bounds[g], bounds[g + 1])
        slow[g] = [place[r] for r in _chained(a[some], b[some], place)]
    made = {g: _parts(rs, close[g]) for g, rs in slow.items()}
    # rings of the easy groups, then those of the others, in the order of groups
    row, at = _spans(starts[order], starts[order] + size[order] + 1)
    last = at == (starts[order] + size[order])[row]
    points = place[a[edge[np.where(last, starts[order][row], at)]]] if len(at) else np.zeros((0, 2))
    points = points + origin[of[order]][row] if len(at) else points
    ring_group, ring_part = of[order], ~hole[order]
    ring_size = size[order] + 1
    area = np.bincount(ring_group, np.where(ring_part, 1, -1) * np.abs(twice[order]), n) / 2 if len(order) else np.zeros(n)
    if made:
        more, g2, first2, s2 = [], [], [], []
        for g, of_g in made.items():
            for part in of_g:
                for k, r in enumerate(part):
                    more.append(r + origin[g])
                    g2.append(g)
                    first2.append(k == 0)
                    s2.append(len(r))
                    w = r - r[0]
                    area[g] += (1 if k == 0 else -1) * abs(float((w[:-1, 0] * w[1:, 1] - w[1:, 0] * w[:-1, 1]).sum())) / 2
        every_size = np.r_[ring_size, np.array(s2, int)]
        begin = np.cumsum(every_size) - every_size
        every_group = np.r_[ring_group, np.array(g2, int)]
        by = np.argsort(every_group, kind="stable")
        points = np.concatenate([points, *more])[_spans(begin[by], begin[by] + every_size[by])[1]]
        ring_group, ring_part, ring_size = every_group[by], np.r_[ring_part, np.array(first2, bool)][by], every_size[by]
    parts_at = np.flatnonzero(ring_part)
    return Shapes(points, np.r_[0, np.cumsum(ring_size)].astype(int), np.r_[parts_at, len(ring_part)], _offsets(ring_group[parts_at], n)), area
