"""Persistent cohomology of one space in numpy: the kernel of the grouped plan, and the parts that the distributed
plan's tasks share with it.

Columns are simplices from the largest diameter down; a column's pivot is its cofacet of least diameter, of largest
index among those. Pairs of a simplex and a cofacet of equal diameter that are first matches of each other
(apparent pairs) need no reduction; simplices that ended a class one dimension below need none either (clearing).
A column that is being reduced is kept as the simplices that were added up in it. Their cofacets are listed again
when they are needed, and merged in order no further than the next pivot.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import OrderedDict
from heapq import heappop, heappush, heapreplace

import numpy as np

from skein.plans.cycles import cycle_bars

INF = float("inf")
#: Entries of arrays of distances that are looked at together, and edges of which Kruskal makes Python objects at once.
BLOCK, EDGES = 1 << 23, 1 << 16
#: Bytes of listed coboundaries that are kept, and entries of one that are sorted at once.
KEPT_BYTES, FRONT = 128 << 20, 64
#: Coboundaries merged in the reduction of edges, after which bars are looked for by annotations (see cycles.py).
FED = 1 << 11
#: Entries of the matrix for each edge, from which on lists of neighbours are kept instead.
LISTED = 64


class Dense:
    """The distances of n points as a matrix: infinite outside the complex, and from a point to itself."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, d: np.ndarray):
        self.n = n
        self.distance = np.full((n, n), INF)
        self.distance[u, v] = self.distance[v, u] = d

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.distance[a, b]

    def row(self, v: int) -> np.ndarray:
        return self.distance[v]

    def rows(self, v: np.ndarray) -> np.ndarray:
        return self.distance[v]

    def reach(self, verts: list[int], diameter: float) -> tuple[np.ndarray, np.ndarray]:
        """The vertices (ascending) that make cofacets of a simplex, and those cofacets' diameters."""
        far = self.row(verts[0])
        for v in verts[1:]:
            far = np.maximum(far, self.row(v))
        added = np.flatnonzero(far < INF)
        return added, np.maximum(far[added], diameter)

    def last_match(self, verts: np.ndarray, diameter: np.ndarray) -> np.ndarray:
        """For each simplex (a row) the largest vertex that makes a cofacet as short as the simplex; -1 if none. All
        simplices try the vertices from the last one down; long ones, which are many, find theirs soon."""
        found, left = np.full(len(verts), -1), np.arange(len(verts))
        own, d = [np.ascontiguousarray(verts[:, i]) for i in range(verts.shape[1])], diameter
        for w in range(self.n - 1, -1, -1):
            if not len(left):
                break
            row = self.row(w)
            ok = row[own[0]] <= d
            for x in own[1:]:
                ok &= row[x] <= d
            if ok.any():
                found[left[ok]] = w
                ok = ~ok
                left, d, own = left[ok], d[ok], [x[ok] for x in own]
        return found

    def above(self, verts: np.ndarray, diameter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All simplices one dimension up, each once: by a vertex above all others."""
        parts, lengths = [np.zeros((0, verts.shape[1] + 1), np.int64)], [np.zeros(0)]
        step, names = max(1, BLOCK // max(self.n, 1)), np.arange(self.n)
        for k in range(0, len(verts), step):
            own = verts[k : k + step]
            reach = np.repeat(diameter[k : k + step, None], self.n, 1)
            for i in range(own.shape[1]):
                np.maximum(reach, self.rows(own[:, i]), out=reach)
            row, new = np.nonzero((reach < INF) & (names > own[:, -1:]))
            parts.append(np.concatenate([own[row], new[:, None]], 1))
            lengths.append(reach[row, new])
        return np.concatenate(parts), np.concatenate(lengths)


class Listed(Dense):
    """Lists of neighbours."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, d: np.ndarray):
        self.n = n
        a, b, length = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([d, d])
        self.key = a * n + b
        order = np.argsort(self.key)
        self.key, self.near, self.length = self.key[order], b[order], length[order]
        self.start = np.searchsorted(self.key, np.arange(n + 1) * n)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.multiply(a, self.n) + b
        if not len(self.key):
            return np.full(np.shape(key), INF)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.length[at], INF)

    def row(self, v: int) -> np.ndarray:
        out = np.full(self.n, INF)
        own = slice(self.start[v], self.start[v + 1])
        out[self.near[own]] = self.length[own]
        return out

    def reach(self, verts: list[int], diameter: float) -> tuple[np.ndarray, np.ndarray]:
        fewest = min(verts, key=lambda v: self.start[v + 1] - self.start[v])
        own = slice(self.start[fewest], self.start[fewest + 1])
        added, far = self.near[own], np.maximum(self.length[own], diameter)
        for v in verts:
            if v != fewest:
                far = np.maximum(far, self.between(np.full(len(added), v), added))
        return added[far < INF], far[far < INF]

    def last_match(self, verts: np.ndarray, diameter: np.ndarray) -> np.ndarray:
        """As of a matrix, but by the neighbours of each simplex's vertex that has fewest."""
        found, step = np.full(len(verts), -1), 1 << 14
        degree = np.diff(self.start)
        for k in range(0, len(verts), step):
            own, d = verts[k : k + step], diameter[k : k + step]
            fewest = own[np.arange(len(own)), degree[own].argmin(1)]
            size = degree[fewest]
            of = np.repeat(np.arange(len(own)), size)
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + self.start[fewest][of]
            w, ok = self.near[at], self.length[at] <= d[of]
            for i in range(own.shape[1]):
                of, w, other = of[ok], w[ok], own[of[ok], i]
                ok = (other == fewest[of]) | (self.between(other, w) <= d[of])
            np.maximum.at(found, k + of[ok], w[ok])
        return found

    def rows(self, v: np.ndarray) -> np.ndarray:
        return np.stack([self.row(int(x)) for x in v]) if len(v) else np.zeros((0, self.n))

    def above(self, verts: np.ndarray, diameter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As of a matrix, but by the neighbours of each simplex's last vertex."""
        parts, lengths = [np.zeros((0, verts.shape[1] + 1), np.int64)], [np.zeros(0)]
        degree, step = np.diff(self.start), 1 << 14
        for k in range(0, len(verts), step):
            own = verts[k : k + step]
            last = own[:, -1]
            size = degree[last]
            of = np.repeat(np.arange(len(own)), size)
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + self.start[last][of]
            new, far = self.near[at], np.maximum(self.length[at], diameter[k : k + step][of])
            ok = new > last[of]
            of, new, far = of[ok], new[ok], far[ok]
            for i in range(own.shape[1] - 1):
                far = np.maximum(far, self.between(own[of, i], new))
                ok = far < INF
                of, new, far = of[ok], new[ok], far[ok]
            parts.append(np.concatenate([own[of], new[:, None]], 1))
            lengths.append(far)
        return np.concatenate(parts), np.concatenate(lengths)

    def edges(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = slice(self.start[low], self.start[high])
        u, v, d = np.repeat(np.arange(low, high), np.diff(self.start[low : high + 1])), self.near[own], self.length[own]
        return u[v < u], v[v < u], d[v < u]

class Ranks:
    """Numbers of simplices of up to `top` vertices out of n."""

    def __init__(self, n: int, top: int):
        self.table = np.zeros((n + 1, top + 1), np.int64)
        for k in range(top + 1):
            self.table[:, k] = [min(math.comb(i, k), 2**63 - 1) for i in range(n + 1)]
        self.lists = [self.table[:, k].tolist() for k in range(top + 1)]

    def rank(self, verts: np.ndarray) -> np.ndarray:
        return sum(self.table[verts[:, i], i + 1] for i in range(verts.shape[1]))

    def unrank(self, index: int, size: int) -> list[int]:
        out = []
        for k in range(size, 0, -1):
            v = bisect_right(self.lists[k], index) - 1
            out.append(v)
            index -= self.lists[k][v]
        return out[::-1]


def forest(n: int, u: np.ndarray, v: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which edges, taken in an order, join two components (Kruskal)."""
    parent = list(range(n))
    joins, left = np.zeros(len(order), bool), n - 1
    for at in range(0, len(order), EDGES):
        part = order[at : at + EDGES]
        for k, (a, b) in enumerate(zip(u[part].tolist(), v[part].tolist(), strict=True), at):
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a != b:
                parent[a] = b
                joins[k] = True
                left -= 1
        if not left:
            break
    return joins


def apparent(space, verts: np.ndarray, diameter: np.ndarray, match: np.ndarray) -> np.ndarray:
    """Whether the simplex is also the matched cofacet's first facet of equal diameter: no facet without a vertex
    above the match is as long."""
    ok = match >= 0
    size = verts.shape[1]
    for i in range(size):
        # the facet that lacks vertex i: the match and the other vertices
        own = np.flatnonzero(ok & (verts[:, i] > match))
        longest = np.zeros(len(own))
        others = [j for j in range(size) if j != i]
        for a, j in enumerate(others):
            longest = np.maximum(longest, space.between(match[own], verts[own, j]))
            for q in others[:a]:
                longest = np.maximum(longest, space.between(verts[own, q], verts[own, j]))
        ok[own[longest == diameter[own]]] = False
    return ok


def with_match(verts: np.ndarray, match: np.ndarray) -> np.ndarray:
    return np.sort(np.concatenate([verts, match[:, None]], 1), 1)


class Enough(Exception):
    """More coboundaries were merged than a reducer should."""


class Reducer:
    """Reduces columns over simplices of `size` vertices. A reduced column is the simplices in it with coefficients."""

    def __init__(self, space, ranks: Ranks, size: int, modulus: int):
        self.space, self.ranks, self.size, self.modulus = space, ranks, size, modulus
        self.listed: OrderedDict[int, tuple] = OrderedDict()
        self.bytes = self.fed = 0
        self.most = INF

    def diameter(self, verts: list[int]) -> float:
        return max((float(self.space.row(a)[b]) for k, a in enumerate(verts) for b in verts[:k]), default=0.0)

    def cofacets(self, index: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Diameters, indices (ascending) and coefficients of a simplex's cofacets."""
        if (found := self.listed.get(index)) is not None:
            self.listed.move_to_end(index)
            return found
        verts, size, table = self.ranks.unrank(index, self.size), self.size, self.ranks.table
        added, reach = self.space.reach(verts, self.diameter(verts))
        place = np.searchsorted(verts, added)
        kept = np.array([sum(int(table[verts[i], i + 1 if i < r else i + 2]) for i in range(size)) for r in range(size + 1)])
        sign = None if self.modulus == 2 else np.where(place % 2 == 0, 1, self.modulus - 1)
        found = reach, kept[place] + table[added, place + 1], sign
        self.listed[index] = found
        self.bytes += 16 * len(added)
        while self.bytes > KEPT_BYTES and len(self.listed) > 1:
            self.bytes -= 16 * len(self.listed.popitem(last=False)[1][0])
        return found

    def _feed(self, heap: list, simplex: int, factor: int, after: tuple[float, int] | None) -> None:
        """Puts a simplex's cofacets, times a factor, into the merge, those after an entry only. About FRONT of them are
        sorted; when the merge has come to their end, the simplex is fed again from there on."""
        lengths, indices, signs = self.cofacets(simplex)
        if after is not None:
            left = np.flatnonzero((lengths > after[0]) | ((lengths == after[0]) & (indices < after[1])))
            lengths, indices, signs = lengths[left], indices[left], signs if signs is None else signs[left]
        end = None
        if len(lengths) > 4 * FRONT:
            end = float(np.partition(lengths, FRONT)[FRONT])
            left = np.flatnonzero(lengths <= end)
            end = None if len(left) == len(lengths) else end
            lengths, indices, signs = lengths[left], indices[left], signs if signs is None else signs[left]
        if len(lengths):
            order = np.lexsort((-indices, lengths))
            signs = [factor] * len(order) if signs is None else (signs[order] * factor % self.modulus).tolist()
            entries = list(zip(lengths[order].tolist(), (-indices[order]).tolist(), signs, strict=True))
            self.count += 1
            self.fed += 1
            if self.fed > self.most:
                raise Enough
            heappush(heap, (*entries[0][:2], self.count, 0, entries, simplex, factor, end))

    def _pop(self, heap: list) -> tuple[float, int, int] | None:
        """The next entry that doesn't cancel: diameter, index and coefficient."""
        while heap:
            length, index, total = heap[0][0], heap[0][1], 0
            while heap and heap[0][0] == length and heap[0][1] == index:
                _, _, mark, at, entries, simplex, factor, end = heap[0]
                total += entries[at][2]
                if at + 1 < len(entries):
                    heapreplace(heap, (*entries[at + 1][:2], mark, at + 1, entries, simplex, factor, end))
                else:
                    heappop(heap)
                    if end is not None:
                        self._feed(heap, simplex, factor, (end, -1))
            if total % self.modulus:
                return length, -index, total % self.modulus
        return None

    def reduce(self, column: dict[int, int], pivot: tuple[float, int, int] | None, owner_of) -> tuple[dict[int, int], tuple[float, int, int] | None]:
        """Adds owners' columns until the pivot has none, or there is no pivot. pivot: the one that the column has, if it
        is known. owner_of(index, diameter): the column (simplices with coefficients, and its lead) that has a pivot."""
        self.count, heap = 0, []
        if pivot is None:
            for index, c in column.items():
                self._feed(heap, index, c, None)
            pivot = self._pop(heap)
            if pivot is None:
                return column, None
        elif (owner_of(pivot[1], pivot[0])) is None:
            return column, pivot
        else:
            for index, c in column.items():
                self._feed(heap, index, c, pivot[:2])
        column = dict(column)
        while pivot is not None and (owner := owner_of(pivot[1], pivot[0])) is not None:
            other, lead = owner
            factor = -pivot[2] * pow(lead, -1, self.modulus) % self.modulus
            for index, c in other.items():
                c = c * factor % self.modulus
                self._feed(heap, index, c, pivot[:2])
                if total := (column.get(index, 0) + c) % self.modulus:
                    column[index] = total
                else:
                    del column[index]
            pivot = self._pop(heap)
        return column, pivot


def point_distances(coords: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """All distances of points (rows) to others, by default to themselves, as the scaled two-norm, summed coordinate by
    coordinate from the left: the same bits as the column expression gives."""
    other = coords if other is None else other
    m = np.zeros((len(coords), len(other)))
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        g = np.empty_like(m)
        for k in range(coords.shape[1]):
            np.maximum(m, np.abs(np.subtract(coords[:, None, k], other[None, :, k], out=g), out=g), out=m)
        plain = (m != 0) & ~np.isinf(m)
        total, scale = np.zeros_like(m), np.where(plain, m, 1.0)
        for k in range(coords.shape[1]):
            np.subtract(coords[:, None, k], other[None, :, k], out=g)
            g /= scale
            g *= g
            total += g
        np.sqrt(total, out=total)
        total *= scale
        return np.where(plain, total, m)


def point_bars(coords: np.ndarray, max_dim: int, threshold: float | None = None, modulus: int = 2, **toggles: bool) -> list[tuple[int, float, float]]:
    """Bars of a cloud, by default up to its enclosing radius."""
    n = len(coords)
    if n == 0:
        return []
    if max_dim == 0:
        return point_components(coords, threshold)
    distance = point_distances(coords)
    limit = float(distance.max(1).min()) if threshold is None else threshold
    u, v = np.nonzero(np.tril((distance <= limit) & (distance < INF), -1))
    return rips_bars(n, u, v, distance[u, v], max_dim, modulus, **toggles)


def point_components(coords: np.ndarray, threshold: float | None = None) -> list[tuple[int, float, float]]:
    """Bars of dimension 0 of a cloud: the lengths of a minimum spanning tree, which holds no edge beyond the enclosing
    radius. Points on a line are sorted; else the tree grows by its nearest point (Prim), and one row of distances is held."""
    n = len(coords)
    if coords.shape[1] == 1:
        with np.errstate(over="ignore"):
            d = np.diff(np.sort(coords[:, 0]))
    else:
        d, reach, left = np.zeros(n - 1), np.full(n - 1, INF), np.array(coords[1:])
        now, most = coords[:1], np.abs(coords).max(initial=0.0)
        squares = (left * left).sum(1) if 1e-100 < most < 1e100 else None
        slack = 1e-12 * (coords.shape[1] + 8) * 2 * coords.shape[1] * most * most if squares is not None else 0.0
        for k in range(n - 1):
            if squares is None:
                np.minimum(reach, point_distances(now, left)[0], out=reach)
            else:  # a product shows which points may have come nearer; their distances are exact
                rough = left @ now[0]
                rough *= -2.0
                rough += squares + float(now[0] @ now[0])
                near = np.flatnonzero(rough <= reach * reach + 2 * slack)
                reach[near] = np.minimum(reach[near], point_distances(now, left[near])[0])
            at = int(reach.argmin())
            d[k], now = reach[at], left[at : at + 1].copy()
            end = len(reach) - 1
            reach[at], left[at] = reach[end], left[end]
            reach, left = reach[:end], left[:end]
            if squares is not None:
                squares[at] = squares[end]
                squares = squares[:end]
    d = np.sort(d[(d < INF) & (d <= (INF if threshold is None else threshold))])
    return [(0, 0.0, x) for x in d[d > 0].tolist()] + [(0, 0.0, INF)] * (n - len(d))


class Level:
    """The simplices of one dimension in the order of their numbers, and which of them are in apparent pairs."""

    def __init__(self, space, ranks: Ranks, verts: np.ndarray, diameter: np.ndarray):
        self.space, self.ranks, self.index = space, ranks, ranks.rank(verts)
        self.verts, self.diameter = verts, diameter
        if len(verts) and (self.index[1:] < self.index[:-1]).any():
            order = np.argsort(self.index)
            self.verts, self.diameter, self.index = verts[order], diameter[order], self.index[order]

    def pair(self, use: np.ndarray, find_apparent: bool, find_early: bool) -> None:
        """Sets match, first (in an apparent pair) of the simplices in `use`."""
        self.match, self.first = np.full(len(self.index), -1), np.zeros(len(self.index), bool)
        if find_apparent or find_early:
            self.match[use] = self.space.last_match(self.verts[use], self.diameter[use])
        if find_apparent:
            self.first[use] = apparent(self.space, self.verts[use], self.diameter[use], self.match[use])

    def mates(self) -> np.ndarray:
        """The cofacets in apparent pairs."""
        return self.ranks.rank(with_match(self.verts[self.first], self.match[self.first]))

    def facet_of(self, cofacet: int) -> int | None:
        """The facet that a cofacet is in an apparent pair with."""
        size = self.verts.shape[1]
        verts = self.ranks.unrank(cofacet, size + 1)
        for k in range(size, -1, -1):
            index = sum(self.ranks.lists[i + 1][v] for i, v in enumerate(verts[:k] + verts[k + 1 :]))
            at = int(np.searchsorted(self.index, index))
            if self.first[at] and self.match[at] == verts[k]:
                return index
        return None


def rips_bars(n: int, u: np.ndarray, v: np.ndarray, d: np.ndarray, max_dim: int, modulus: int = 2, apparent_pairs: bool = True, clearing: bool = True, emergent: bool = True) -> list[tuple[int, float, float]]:
    """Bars (dim, birth, death) of the flag complex of n vertices and edges u > v of finite diameters d."""
    if n == 0:
        return []
    kind = Listed if len(d) * LISTED < n * n else Dense
    space, ranks = kind(n, u, v, d), Ranks(n, max_dim + 2)
    plain = max_dim == 1 and modulus == 2 and apparent_pairs and clearing and emergent
    level = Level(space, ranks, np.stack([v, u], 1).astype(np.int64).reshape(-1, 2), np.asarray(d, np.float64))
    order = (len(level.index) - 1 - np.argsort(level.diameter[::-1], kind="stable")) if len(level.index) else np.zeros(0, np.int64)
    cleared = np.zeros(len(order), bool)
    cleared[order] = forest(n, level.verts[:, 1], level.verts[:, 0], order)
    deaths = np.sort(level.diameter[cleared])
    bars = [(0, 0.0, x) for x in deaths[deaths > 0].tolist()] + [(0, 0.0, INF)] * (n - len(deaths))
    for dim in range(1, max_dim + 1):
        if not len(level.index):
            break
        use = np.flatnonzero(~cleared) if clearing else np.arange(len(cleared))
        level.pair(use, apparent_pairs, emergent)
        rest = use[~level.first[use]]
        rest = rest[np.lexsort((level.index[rest], -level.diameter[rest]))]
        early = np.full(len(rest), -1)
        if emergent:  # the pivots of columns that have a cofacet as short as they are
            some = level.match[rest] >= 0
            early[some] = ranks.rank(with_match(level.verts[rest[some]], level.match[rest[some]]))
        reducer = Reducer(space, ranks, dim + 1, modulus)
        instead = (lambda: cycle_bars(n, u, v, d, kind)) if plain else None
        found = pair(reducer, level.index[rest].tolist(), level.diameter[rest].tolist(), early.tolist(), level.facet_of, instead)
        if found.instead is not None:
            return found.instead
        for k, pivot in zip(rest.tolist(), found.pivots, strict=True):
            birth = float(level.diameter[k])
            if pivot is None:
                if not cleared[k]:
                    bars.append((dim, birth, INF))
            elif pivot[0] > birth:
                bars.append((dim, birth, pivot[0]))
        if dim < max_dim:
            mates = level.mates()
            level = Level(space, ranks, *space.above(level.verts, level.diameter))
            cleared = np.isin(level.index, np.concatenate([np.array([*found.by_pivot], np.int64), mates]))
    return bars


class Pairing:
    """Pivots by column, in the columns' order, and columns by pivot."""

    def __init__(self) -> None:
        self.pivots: list[tuple[float, int, int] | None] = []
        self.by_pivot: dict[int, tuple[dict[int, int], int]] = {}
        self.instead: list[tuple[int, float, float]] | None = None


def pair(reducer: Reducer, columns: list[int], diameters: list[float], early: list[int], facet_of, instead=None) -> Pairing:
    """Reduces columns from the first on. early: the pivots that columns start with, as far as they are known (-1: not).
    facet_of(cofacet): the facet that it is in an apparent pair with, or None. instead(): all bars in another way, or None;
    asked once, when FED coboundaries were merged, and what it gives ends the reduction."""
    out, modulus = Pairing(), reducer.modulus
    reducer.most = INF if instead is None else FED

    def owner_of(pivot: int, diameter: float) -> tuple[dict[int, int], int] | None:
        if (found := out.by_pivot.get(pivot)) is None and (facet := facet_of(pivot)) is not None:
            found = {facet: 1}, sign_of(reducer.ranks, facet, pivot, reducer.size, modulus)
        return found

    for column, diameter, first in zip(columns, diameters, early, strict=True):
        known = (diameter, first, sign_of(reducer.ranks, column, first, reducer.size, modulus)) if first >= 0 else None
        try:
            reduced, pivot = reducer.reduce({column: 1}, known, owner_of)
        except Enough:
            reducer.most = INF
            out.instead = instead()
            if out.instead is not None:
                return out
            reduced, pivot = reducer.reduce({column: 1}, known, owner_of)
        if pivot is not None:
            out.by_pivot[pivot[1]] = reduced, pivot[2]
        out.pivots.append(pivot)
    return out


def sign_of(ranks: Ranks, facet: int, cofacet: int, size: int, modulus: int) -> int:
    """The coefficient of a cofacet in the coboundary of a facet of `size` vertices."""
    if modulus == 2:
        return 1
    own = set(ranks.unrank(facet, size))
    place = next(k for k, v in enumerate(ranks.unrank(cofacet, size + 1)) if v not in own)
    return 1 if place % 2 == 0 else modulus - 1
