"""Sweep over the edges of many groups of polygons at once.

The plane is cut at the heights of all vertices and crossings of a group.  Inside
a strip between two cuts only the edges that are active there count, in order of
x, and all that lies between two of them is a trapezoid.  All groups of a batch
are swept in the same arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Active edges of strips that are handled at a time.
ACTIVE = 2_000_000


@dataclass
class Strips:
    """Active edges of some strips, by strip and then by x.

    ``group``, ``low`` and ``high`` belong to strips, all else to active edges:
    ``side`` is +1 where the edge enters its shape and -1 where it leaves it.
    """

    group: np.ndarray
    low: np.ndarray
    high: np.ndarray
    strip: np.ndarray
    x: np.ndarray
    edge: np.ndarray
    shape: np.ndarray
    side: np.ndarray

    def depth(self, chosen: np.ndarray | None = None) -> np.ndarray:
        """Shapes that cover what lies right of every active edge, or those of them for which ``chosen`` holds."""
        return np.cumsum(self.side if chosen is None else np.where(chosen, self.side, 0))

    def widths(self, inside: np.ndarray) -> np.ndarray:
        """Width between an active edge and the next where ``inside`` holds."""
        return np.where(inside, np.r_[self.x[1:], 0.0] - self.x, 0.0)


def _cuts(group: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, y) in order, and the place of every given one among them."""
    order = np.lexsort((y, group))
    g, v = group[order], y[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])] if len(g) else np.zeros(0, bool)
    place = np.empty(len(g), np.int64)
    place[order] = np.cumsum(new) - 1
    return g[new], v[new], place


def _x_at(edges: np.ndarray, which: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x of edges at heights, exact at their ends."""
    x1, y1, x2, y2 = edges[which].T
    x = x1 + (y - y1) * ((x2 - x1) / (y2 - y1))
    return np.where(y == y1, x1, np.where(y == y2, x2, x))


def _pieces(first: np.ndarray, last: np.ndarray, strips: int):
    """(edge, strip) of all active edges, some strips at a time."""
    delta = np.zeros(strips + 1, np.int64)
    np.add.at(delta, first, 1)
    np.add.at(delta, last, -1)
    total = np.cumsum(np.cumsum(delta[:-1]))
    at = 0
    while at < strips:
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + ACTIVE, "right")))
        edges = np.flatnonzero((first < end) & (last > at))
        a, b = np.maximum(first[edges], at), np.minimum(last[edges], end)
        n = b - a
        start = np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(edges, n), np.repeat(a, n) + np.arange(n.sum()) - start
        at = end


def _crossings(edges: np.ndarray, edge: np.ndarray, strip: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(strip, y) of the crossings inside strips: pairs of active edges whose order differs below and above."""
    below, above = _x_at(edges, edge, low[strip]), _x_at(edges, edge, high[strip])
    order = np.lexsort((above, below, strip))
    strip, below, above = strip[order], below[order], above[order]
    odd = np.unique(strip[1:][(strip[1:] == strip[:-1]) & (above[1:] < above[:-1])])
    use = np.isin(strip, odd)
    strip, below, above = strip[use], below[use], above[use]
    if len(strip) == 0:
        return np.zeros(0, np.int64), np.zeros(0)
    ends = np.searchsorted(strip, strip, "right")
    found = [(np.zeros(0, np.int64), np.zeros(0))]
    later = ends - np.arange(len(strip)) - 1
    upto = np.cumsum(later)
    at = 0
    while at < len(strip):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ACTIVE, "right")))
        n = later[at:end]
        i = np.repeat(np.arange(at, end), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        met = above[j] < above[i]
        i, j = i[met], j[met]
        near, far = below[j] - below[i], above[i] - above[j]
        share = near / (near + far)
        s = strip[i]
        y = low[s] + share * (high[s] - low[s])
        inner = (y > low[s]) & (y < high[s])
        found.append((s[inner], y[inner]))
        at = end
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def swept(edges: np.ndarray, group: np.ndarray, shape: np.ndarray):
    """``Strips`` of all groups, some at a time; edges (n, 4) are x1, y1, x2, y2, shapes are even-odd and numbered inside their group."""
    flat = edges[:, 1] == edges[:, 3]
    own = np.flatnonzero(~flat)
    edges, group, shape = edges[own], group[own], shape[own]
    if len(edges) == 0:
        return
    low_y, high_y = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    extra_g, extra_y = np.zeros(0, group.dtype), np.zeros(0)
    for again in (True, False):
        cut_g, cut_y, place = _cuts(np.concatenate([group, group, extra_g]), np.concatenate([low_y, high_y, extra_y]))
        first, last = place[: len(edges)], place[len(edges) : 2 * len(edges)]
        if again:
            more = [_crossings(edges, e, s, cut_y, np.r_[cut_y[1:], 0.0]) for e, s in _pieces(first, last, len(cut_y))]
            extra_g, extra_y = cut_g[np.concatenate([m[0] for m in more])], np.concatenate([m[1] for m in more])
            if len(extra_y) == 0:
                break
    high = np.r_[cut_y[1:], 0.0]
    for e, s in _pieces(first, last, len(cut_y)):
        x = _x_at(edges, e, (cut_y[s] + high[s]) / 2)
        # entering and leaving alternate along x inside a strip and shape
        order = np.lexsort((x, shape[e], s))
        same = np.r_[False, (s[order][1:] == s[order][:-1]) & (shape[e][order][1:] == shape[e][order][:-1])]
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        side = np.empty(len(order), np.int8)
        side[order] = np.where((np.arange(len(order)) - start) % 2 == 0, 1, -1)
        order = np.lexsort((x, s))
        yield Strips(cut_g, cut_y, high, s[order], x[order], own[e[order]], shape[e[order]], side[order])


#: Whether a region lies right of every active edge.
Rule = Callable[[Strips], np.ndarray]


def common(shapes: int) -> Rule:
    return lambda s: s.depth() >= shapes


def any_of(s: Strips) -> np.ndarray:
    return s.depth() >= 1


def covered_part(s: Strips) -> np.ndarray:
    """What any of the shapes from 1 on covers of shape 0."""
    return (s.depth(s.shape == 0) >= 1) & (s.depth(s.shape > 0) >= 1)


def uncovered_part(s: Strips) -> np.ndarray:
    """What none of the shapes from 1 on covers of shape 0."""
    return (s.depth(s.shape == 0) >= 1) & (s.depth(s.shape > 0) < 1)


def areas(edges: np.ndarray, group: np.ndarray, shape: np.ndarray, rule: Rule, groups: int) -> np.ndarray:
    """Area of every group's region."""
    out = np.zeros(groups)
    for s in swept(edges, group, shape):
        weight = s.widths(rule(s)) * (s.high - s.low)[s.strip]
        out += np.bincount(s.group[s.strip], weight, groups)
    return out


def regions(edges: np.ndarray, group: np.ndarray, shape: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(group, trapezoids) of every group's region: y0, y1, and x on the left and right at both.

    Trapezoids between the same two edges, one strip above the other, are one.
    """
    found_g, found = [np.zeros(0, np.int64)], [np.zeros((0, 6))]
    for s in swept(edges, group, shape):
        inside = rule(s)
        # runs of intervals that are inside become one: its left edge, and the edge at which it ends
        before = np.r_[False, inside[:-1]]
        left, right = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
        use = s.x[left] < s.x[right]
        left, right = left[use], right[use]
        order = np.lexsort((s.strip[left], s.edge[right], s.edge[left]))
        left, right = left[order], right[order]
        a, b, k = s.edge[left], s.edge[right], s.strip[left]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (k[1:] != k[:-1] + 1)] if len(a) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(a)] - 1 if len(a) else first
        y0, y1 = s.low[k[first]], s.high[k[last]]
        found_g.append(s.group[k[first]].astype(np.int64))
        found.append(np.stack([y0, y1, _x_at(edges, a[first], y0), _x_at(edges, a[first], y1), _x_at(edges, b[first], y0), _x_at(edges, b[first], y1)], axis=1))
    return np.concatenate(found_g), np.concatenate(found)
