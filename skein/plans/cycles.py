"""Dimensions 0 and 1 over Z/2 by annotations: each edge's part in the classes that live now.

Edges come one by one, shortest first, and with each the triangles whose last edge it is. An edge without a triangle
joins two components or begins a class, a bit. Any other edge is, up to boundaries, the sum of its first triangle's other
two, so its annotation is the sum of theirs; each further triangle says that two such sums are equal. Where they differ the
youngest class among the difference dies: its bit stands for the rest of the difference from then on, and is replaced in an
annotation when that is looked at next. When no class lives, edges with a triangle have nothing to say and are passed by.
This costs little where classes are many and die while the graph is still thin, as of points in many dimensions, for which
columns are long to reduce. Where it would look at too many triangles or hold too much, it gives up and columns are reduced.
"""

from __future__ import annotations

from functools import reduce
from operator import xor

import numpy as np

INF = float("inf")
#: Triangles that are looked at, as multiples of edges and at least, and bytes of annotations, before it gives up.
TRIANGLES, LEAST, BYTES = 8, 1 << 20, 1 << 30
#: Bits of dead classes from which on they are listed together.
FEW = 16


class _Classes:
    """Annotations as whole numbers, a bit a class in the order in which they began. Equal annotations stay equal, so edges
    may share one; number 0 is zero. One of a class alone is held as -1 - bit until the class dies."""

    def __init__(self) -> None:
        self.rows, self.stamp = [0], [0]
        #: By bit: the difference that ended the class (0: it lives), when its other bits were looked at, the edge that began it.
        self.relation: list[int] = []
        self.fresh: list[int] = []
        self.born: list[int] = []
        self.dead = self.deaths = self.bytes = 0

    @property
    def living(self) -> int:
        return len(self.born) - self.deaths

    def begin(self, at: int) -> int:
        self.rows.append(-1 - len(self.born))
        self.stamp.append(self.deaths)
        self.born.append(at)
        self.relation.append(0)
        self.fresh.append(0)
        self.bytes += 64
        return len(self.rows) - 1

    def add(self, row: int) -> int:
        self.rows.append(row)
        self.stamp.append(self.deaths)
        self.bytes += 64 + (row.bit_length() >> 3)
        return len(self.rows) - 1

    def value(self, at: int) -> int:
        """An annotation without dead classes."""
        row = self.rows[at]
        if row < 0:
            if not self.relation[-1 - row]:
                return 1 << (-1 - row)
            row = 1 << (-1 - row)
        elif self.stamp[at] == self.deaths:
            return row
        else:
            self.bytes -= row.bit_length() >> 3
        self.rows[at] = row = self.reduced(row)
        self.stamp[at] = self.deaths
        self.bytes += row.bit_length() >> 3
        return row

    def reduced(self, row: int) -> int:
        relation = self.relation
        while left := row & self.dead:
            if left.bit_count() <= FEW:
                bit = left.bit_length() - 1
                self._refresh(bit)
                row ^= relation[bit]
            else:  # relations have no dead bits but their own, so they may be added together
                found = np.frombuffer(left.to_bytes((left.bit_length() + 7) >> 3, "little"), np.uint8)
                bits = np.flatnonzero(np.unpackbits(found, bitorder="little")).tolist()
                for bit in bits:
                    self._refresh(bit)
                row = reduce(xor, map(relation.__getitem__, bits), row)
        return row

    def _refresh(self, bit: int) -> None:
        """Takes dead bits out of a relation, but for its own; relations that this takes are left as they are."""
        if self.fresh[bit] != self.deaths:
            relation, dead, own = self.relation, self.dead, 1 << bit
            row = relation[bit] ^ own
            if left := row & dead:
                while left:
                    row ^= relation[left.bit_length() - 1]
                    left = row & dead
                relation[bit] = row ^ own
            self.fresh[bit] = self.deaths

    def end(self, relation: int) -> int:
        """Makes a relation zero; which edge began the class that dies."""
        bit = relation.bit_length() - 1
        self.relation[bit] = relation
        self.dead |= 1 << bit
        self.deaths += 1
        self.fresh[bit] = self.deaths
        self.bytes += relation.bit_length() >> 3
        return self.born[bit]


class Annotations:
    """Takes the edges of n points in their order, shortest first, and knows the bars that have ended so far."""

    def __init__(self, n: int):
        self.n, self.joined, self.seen, self.taken = n, 0, 0, 0
        self.near: list[dict[int, int]] = [{} for _ in range(n)]
        self.parent, self.classes = list(range(n)), _Classes()
        self.lengths: list[float] = []
        self.bars: list[tuple[int, float, float]] = []

    def join(self, x: int, y: int, length: float) -> bool:
        """Whether an edge joins two components."""
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x == y:
            return False
        parent[x] = y
        self.joined += 1
        if length > 0:
            self.bars.append((0, 0.0, length))
        return True

    def copy_of_parts(self) -> Annotations:
        """What is known of components and bars, to which edges may be joined without a change here; no class must live."""
        out = Annotations(self.n)
        out.joined, out.parent, out.bars = self.joined, list(self.parent), list(self.bars)
        return out

    def take(self, u: np.ndarray, v: np.ndarray, d: np.ndarray, last: int | None = None, triangles: int | None = None) -> bool:
        """Takes further edges u, v in their order; whether it didn't give up. last: the place among them of the last one
        that no triangle has, if it is known. triangles: as TRIANGLES, if it is another number."""
        near, classes, most = self.near, self.classes, max(LEAST, (TRIANGLES if triangles is None else triangles) * (self.taken + len(d)))
        self.taken += len(d)
        for k, (a, b, length) in enumerate(zip(u.tolist(), v.tolist(), d.tolist(), strict=True)):
            row, one, two = 0, near[a], near[b]
            if one.keys().isdisjoint(two):
                if not self.join(a, b, length):
                    row = classes.begin(len(self.lengths))
                    self.lengths.append(length)
            elif classes.deaths < len(classes.born):
                met = one.keys() & two.keys()
                self.seen += len(met)
                row = self._close(one, two, met, length)
            if self.seen > most or classes.bytes > BYTES:
                return False
            if last is not None and k >= last and not classes.living:
                break
            near[a][b] = near[b][a] = row
        return True

    def _close(self, one: dict[int, int], two: dict[int, int], met: set[int], length: float) -> int:
        """Ends the classes that the triangles of an edge of a length end; the edge's annotation."""
        classes, pairs, same = self.classes, set(), False
        for w in met:
            i, j = one[w], two[w]
            if i == j:
                same = True
            else:
                pairs.add((i, j) if i < j else (j, i))
        if not pairs:
            return 0
        first, row, alone = 0 if same else None, 0, len(pairs) == 1 and not same
        for i, j in pairs:
            if not i:
                row = j
                if alone:
                    return row
            found = classes.value(i) ^ classes.value(j)
            if first is None:
                first = found
            elif found != first and (relation := classes.reduced(found ^ first)):
                birth = self.lengths[classes.end(relation)]
                if length > birth:
                    self.bars.append((1, birth, length))
        if same or not (first := classes.reduced(first)):
            return 0
        return row or classes.add(first)

    def all_bars(self) -> list[tuple[int, float, float]]:
        """The bars, if no further edge comes."""
        alive = [self.lengths[at] for at, relation in zip(self.classes.born, self.classes.relation, strict=True) if not relation]
        return self.bars + [(0, 0.0, INF)] * (self.n - self.joined) + [(1, birth, INF) for birth in alive]


def cycle_bars(n: int, u: np.ndarray, v: np.ndarray, d: np.ndarray, space_of) -> list[tuple[int, float, float]] | None:
    """Bars (dim, birth, death) of dimensions 0 and 1 of n points and edges u > v of finite diameters d; None where it
    gives up. space_of(n, u, v, d): a structure with last_match(), as in the kernel."""
    order = np.argsort(d, kind="stable")
    u, v, d = np.asarray(u)[order], np.asarray(v)[order], np.asarray(d, np.float64)[order]
    place = np.arange(len(d), dtype=np.float64)
    # Edges of one length come in this order too, which changes bars of length zero alone.
    bare = np.flatnonzero(space_of(n, u, v, place).last_match(np.stack([v, u], 1).astype(np.int64).reshape(-1, 2), place) < 0)
    found = Annotations(n)
    return found.all_bars() if found.take(u, v, d, int(bare[-1]) if len(bare) else -1) else None
