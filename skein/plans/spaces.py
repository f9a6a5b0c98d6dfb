"""One group's structure in a worker of the distributed plan: read from the shared folder, kept while it is in use."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq

from skein.plans.kernel import INF, Dense, Listed, point_distances
from skein.storage import filesystem

#: Most points of which a worker keeps the whole matrix (128 MB); of more it keeps points or lists of neighbours.
DENSE_POINTS = 4096
#: Bytes of rows of distances that a worker keeps.
ROW_BYTES = 64 << 20


class Cloud(Dense):
    """Points; distances are computed when they are needed."""

    def __init__(self, coords: np.ndarray, limit: float):
        self.n, self.coords, self.limit, self.kept = len(coords), coords, limit, OrderedDict()

    def _cut(self, d: np.ndarray, same: np.ndarray) -> np.ndarray:
        d[(d > self.limit) | same] = INF
        return d

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gaps = np.abs(self.coords[a] - self.coords[b])
        d = point_distances(gaps.reshape(-1, gaps.shape[-1]), np.zeros((1, gaps.shape[-1])))[:, 0].reshape(gaps.shape[:-1])
        return self._cut(d, np.equal(a, b))

    def rows(self, v: np.ndarray) -> np.ndarray:
        return np.stack([self.row(int(x)) for x in v]) if len(v) else np.zeros((0, self.n))

    def row(self, v: int) -> np.ndarray:
        if (found := self.kept.get(v)) is None:
            found = self.kept[v] = self._cut(point_distances(self.coords[v : v + 1], self.coords)[0], np.arange(self.n) == v)
            while len(self.kept) * self.n * 8 > ROW_BYTES and len(self.kept) > 8:
                self.kept.popitem(last=False)
        else:
            self.kept.move_to_end(v)
        return found

    def edges(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """u, v, d of the edges u > v with u from low to high (exclusive), by u and v."""
        u, v, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for x in range(low, high):
            row = self.row(x)[:x]
            near = np.flatnonzero(row < INF)
            u.append(np.full(len(near), x))
            v.append(near)
            d.append(row[near])
        return np.concatenate(u), np.concatenate(v), np.concatenate(d)


class Matrix(Dense):
    """A matrix that is given."""

    def __init__(self, distance: np.ndarray, limit: float):
        self.n, self.distance = len(distance), distance
        distance[distance > limit] = INF
        np.fill_diagonal(distance, INF)

    edges = Cloud.edges


def rows_of(path: str, part: int, key: object, columns: list[str]) -> pa.Table:
    """The rows of a group in a table of the shared folder that was written by group (see stored_by_group)."""
    store, root = filesystem(path)
    folder = f"{root}/_part={part}"
    names = [f.path for f in store.get_file_info(_selector(folder)) if f.path.endswith(".parquet")]
    tables = [pq.read_table(name, columns=["group_id", *columns], filesystem=store, partitioning=None) for name in sorted(names)]
    if not tables:
        return pa.table({c: pa.array([]) for c in columns})
    table = pa.concat_tables(tables)
    own = table.column("group_id")
    return table.filter(pc.is_null(own) if key is None else pc.equal(own, pa.scalar(key, own.type))).select(columns)


def _selector(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder, allow_not_found=True)


_loaded: dict[str, object] = {}


def loaded(path: str, part: int, key: object, n: int, limit: float, points: bool) -> Dense:
    """The structure of a group, from its points or its edges; a worker keeps the last one that it used."""
    name = repr((path, part, key, limit))
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = _load(path, part, key, n, limit, points)
    return _loaded[name]


def _load(path: str, part: int, key: object, n: int, limit: float, points: bool) -> Dense:
    if points:
        table = rows_of(path, part, key, ["id", "coords"])
        table = table.take(pc.sort_indices(table.column("id")))
        coords = np.array(table.column("coords").to_pylist(), np.float64).reshape(n, -1)
        return Matrix(point_distances(coords), limit) if n <= DENSE_POINTS else Cloud(coords, limit)
    table = rows_of(path, part, key, ["u", "v", "d"])
    u, v, d = (table.column(c).to_numpy().astype(t) for c, t in (("u", np.int64), ("v", np.int64), ("d", np.float64)))
    if n > DENSE_POINTS:
        return Listed(n, u, v, d)
    distance = np.full((n, n), INF)
    distance[u, v] = distance[v, u] = d
    return Matrix(distance, INF)
