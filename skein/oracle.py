"""Brute force, for tests only: all simplices listed, the boundary matrix reduced column by column. Shares no code
with the engine."""

from __future__ import annotations

from itertools import combinations

INF = float("inf")


def rips_persistence_oracle(matrix: list[list[float]], max_dim: int, threshold: float | None = None, modulus: int = 2) -> list[tuple[int, float, float]]:
    """Bars, sorted, of a full symmetric matrix with zeros on the diagonal; by default up to the enclosing radius."""
    n = len(matrix)
    if n == 0:
        return []
    if threshold is None:
        threshold = min(max(row) for row in matrix)
    max_dim = min(max_dim, n - 1)
    found = []
    for size in range(1, max_dim + 3):
        for verts in combinations(range(n), size):
            length = max((matrix[a][b] for a, b in combinations(verts, 2)), default=0.0)
            if length <= threshold and length < INF:
                found.append((length, size, verts))
    found.sort()
    place = {verts: k for k, (_, _, verts) in enumerate(found)}
    low: dict[int, dict[int, int]] = {}
    deaths, births = {}, []
    for k, (length, size, verts) in enumerate(found):
        column = {place[verts[:i] + verts[i + 1 :]]: (-1) ** i % modulus for i in range(size)} if size > 1 else {}
        while column and (pivot := max(column)) in low:
            other = low[pivot]
            factor = -column[pivot] * pow(other[pivot], modulus - 2, modulus) if modulus > 2 else 1
            for row, c in other.items():
                new = (column.get(row, 0) + factor * c) % modulus
                if new:
                    column[row] = new
                else:
                    column.pop(row, None)
        if column:
            low[max(column)] = column
            deaths[max(column)] = length
        else:
            births.append(k)
    bars = []
    for k in births:
        length, size, _ = found[k]
        if size - 1 <= max_dim and deaths.get(k, INF) > length:
            bars.append((size - 1, length, deaths.get(k, INF)))
    return sorted(bars)
