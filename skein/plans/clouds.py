"""Dimensions 0 and 1 over Z/2 of large clouds from their shortest pairs alone.

Annotations take the pairs of points shortest first, as many as it needs until no class of dimension 1 lives. A longer pair
begins a class that lives for a while only if no third point is nearer to both of its ends. Two points with a neighbour in
common among the pairs taken are no such pair, which rows of bits show for nearly all pairs of points in many dimensions; the
few others are looked at one by one. If all those join two components, no pair beyond has anything to say; nor has the
enclosing radius, since every longer pair forms a triangle with the point in the centre. Where too many pairs are in question,
as of points in few dimensions, or annotations give up, this gives up too.
"""

from __future__ import annotations

import numpy as np

from skein.operators.metric import _exact, _rough
from skein.plans.cycles import Annotations

#: Pairs for each point that are taken at first, and most pairs that are taken.
EACH, MOST = 48, 1 << 22
#: Triangles that are looked at, as multiples of pairs, before it gives up.
TRIANGLES = 256
#: Points whose distances are looked at together, and pairs in question for each point at which it gives up.
ROWS, OPEN = 512, 32


def cloud_bars(coords: np.ndarray) -> list[tuple[int, float, float]] | None:
    """Bars (dim, birth, death) of dimensions 0 and 1 up to the enclosing radius; None where it gives up."""
    n, most = len(coords), np.abs(coords).max(initial=0.0)
    if n < 2 or not 1e-100 < most < 1e100:
        return None
    found, below, each = Annotations(n), -1.0, EACH
    while True:
        limit = _limit(coords, each)
        u, v, d = _shortest(coords, limit)
        if len(d) > MOST:
            return None
        late = _open_pairs(coords, u, v, limit)
        if late is not None:
            new = d > below
            order = np.flatnonzero(new)[np.argsort(d[new], kind="stable")]
            if not found.take(u[order], v[order], d[order], triangles=TRIANGLES):
                return None
            below = limit
            if not found.classes.living:
                if not len(late[0]):
                    return found.all_bars()
                ahead = found.copy_of_parts()
                a, b, length = late
                if all(ahead.join(x, y, z) for x, y, z in zip(a.tolist(), b.tolist(), length.tolist(), strict=True)):
                    return ahead.all_bars()
        if 2 * each >= n - 1:
            return None
        each *= 2


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """The squares of all distances, and how far they are from those of exact distances at most."""
    rough, slack, squared = _rough(a, b)
    return rough if squared else rough * rough, slack


def _limit(coords: np.ndarray, each: int) -> float:
    """A length that about `each` pairs for each point don't exceed."""
    if 2 * each >= len(coords) - 1:
        return float("inf")
    some = np.arange(0, len(coords), max(1, len(coords) // 512))
    rough = _squares(coords[some], coords)[0]
    return float(np.sqrt(max(0.0, np.quantile(rough, 2.0 * each / (len(coords) - 1)))))


def _shortest(coords: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, v, d of all pairs u > v that are not longer than a limit."""
    parts: list[tuple] = []
    for at in range(0, len(coords), ROWS):
        own = coords[at : at + ROWS]
        rough, slack = _squares(own, coords[: at + len(own)])
        a, b = np.nonzero(rough <= limit * limit + 2 * slack)
        a, b = a[b < a + at], b[b < a + at]
        d = _exact(own, coords, a, b)
        near = d <= limit
        parts.append((a[near] + at, b[near], d[near]))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _open_pairs(coords: np.ndarray, u: np.ndarray, v: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The pairs beyond the limit, shortest first, of which no third point is seen that is nearer to both ends; None if
    too many have no neighbour in common among the pairs u, v."""
    n = len(coords)
    near = np.zeros((n, -(-n // 8)), np.uint8)
    ends = np.concatenate([np.stack([u, v]), np.stack([v, u])], 1)
    ends = ends[:, np.argsort(ends[0], kind="stable")]
    start = np.searchsorted(ends[0], np.arange(n + 1))
    row = np.zeros(n, bool)
    for x in range(n):
        row[:] = False
        row[ends[1, start[x] : start[x + 1]]] = True
        near[x] = np.packbits(row)
    left, total = [], 0
    for x in range(n):
        own = ends[1, start[x] : start[x + 1]]
        met = np.bitwise_or.reduce(near[own], axis=0) | near[x] if len(own) else near[x]
        found = np.flatnonzero(np.unpackbits(met, count=n)[:x] == 0)
        total += len(found)
        if total > OPEN * n:
            return None
        left.append(found)
    a, b, lengths = [], [], []
    for x, found in enumerate(left):
        for at in range(0, len(found), ROWS):
            some = found[at : at + ROWS]
            rough, slack = _squares(coords[np.append(some, x)], coords)
            other, own = rough[:-1], rough[-1]
            bound = own[some, None] - 2 * slack
            # A point that is nearer to both ends for certain is neither of them.
            bare = some[~((other < bound) & (own[None, :] < bound)).any(1)]
            a.append(np.full(len(bare), x))
            b.append(bare)
            lengths.append(_exact(coords, coords, a[-1], bare))
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, lengths = np.concatenate(a), np.concatenate(b), np.concatenate(lengths)
    beyond = lengths > limit
    order = np.flatnonzero(beyond)[np.argsort(lengths[beyond], kind="stable")]
    return a[order], b[order], lengths[order]
