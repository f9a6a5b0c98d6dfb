"""Distributed reduction for groups too large for one task.

A group's points or edges lie in the shared folder; every task reads those of its group, and none of the simplices
is stored but the few that need reduction. Tasks share out a group's edges by their larger vertex: each finds its
edges' spanning forest (forests of parts are merged for H0), then streams its simplices and drops those that ended a
class below or are in an apparent pair, which is seen from distances alone. What is left are columns: a simplex, the
simplices added to it, and its pivot. Pivots are dealt to blocks by length. In a round each block reduces its
columns from left to right as far as pivots stay in it; columns whose pivots leave it go to the block of their new
pivot. Only earlier columns are ever added to later ones, and a block whose columns change is reduced anew, so the
pairing is the unique one. The first block is final after one round, the next after two, and so on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.kernel import INF, Ranks, Reducer, apparent, forest, sign_of, with_match
from skein.plans.spaces import loaded, rows_of
from skein.storage import cut, part_of_group, stored_by_group

#: Pairs of points (or edges, of listed ones) that one task looks at, and simplices that it holds at once.
PAIRS, HELD = 1 << 18, 1 << 18
#: Columns of a block, and forests of parts that are merged at once.
COLUMNS, FAN_IN = 8192, 32

_STATE = "idx long, diameter double, dead boolean, p_len double, p_idx long, p_c int, v array<long>, c array<int>"


def _ranges(n: int, parts: int) -> list[int]:
    """Bounds of ranges of vertices with about equally many smaller partners."""
    return [round(n * (k / parts) ** 0.5) for k in range(parts)] + [n]


class _Plan:
    """What the tasks of one run share."""

    def __init__(self, path: str, points: bool, modulus: int, find_apparent: bool, clearing: bool, emergent: bool):
        self.path, self.points, self.modulus = path, points, modulus
        self.find_apparent, self.clearing, self.emergent = find_apparent, clearing, emergent

    def space(self, task: dict):
        return loaded(self.path, task["part"], task["group_id"], task["n"], task["limit"], self.points)

    def radius(self, task: dict) -> pd.DataFrame:
        space, bounds = self.space(task), _ranges(task["n"], task["tasks"])
        far = [np.where(np.isinf(row := space.row(u)), -INF, row).max(initial=0.0) for u in range(bounds[task["no"]], bounds[task["no"] + 1])]
        return pd.DataFrame({"far": [min(far)]} if far else {"far": np.zeros(0)})

    def edges(self, task: dict) -> tuple[np.ndarray, np.ndarray]:
        bounds = _ranges(task["n"], task["tasks"])
        u, v, d = self.space(task).edges(bounds[task["no"]], bounds[task["no"] + 1])
        return np.stack([v, u], 1).astype(np.int64).reshape(-1, 2), d

    def forest(self, task: dict) -> pd.DataFrame:
        verts, d = self.edges(task)
        return _forest(task["n"], verts[:, 1], verts[:, 0], d)

    def columns(self, task: dict, dim: int, dead: str) -> Iterator[pd.DataFrame]:
        """The part's simplices that need reduction, with their first pivots."""
        space, ranks = self.space(task), Ranks(task["n"], dim + 2)
        verts, d = self.edges(task)
        names = rows_of(dead, task["part"], task["group_id"], ["idx"]).column("idx").to_numpy()
        names = np.sort(names.astype(np.int64))
        for own, lengths in _expanded(space, verts, d, dim):
            index = ranks.rank(own)
            gone = np.isin(index, names)
            if dim > 1 and self.find_apparent:
                gone[~gone] = _is_mate(space, own[~gone], lengths[~gone])
            use = np.flatnonzero(~gone) if self.clearing else np.arange(len(own))
            match = space.last_match(own[use], lengths[use]) if self.find_apparent or self.emergent else np.full(len(use), -1)
            if self.find_apparent:
                left = ~apparent(space, own[use], lengths[use], match)
                use, match = use[left], match[left]
            yield self._first(space, ranks, own[use], lengths[use], index[use], gone[use], match, dim)

    def _first(self, space, ranks: Ranks, verts: np.ndarray, d: np.ndarray, index: np.ndarray, gone: np.ndarray, match: np.ndarray, dim: int) -> pd.DataFrame:
        reducer = Reducer(space, ranks, dim + 1, self.modulus)
        p_len, p_idx = np.full(len(d), np.nan), np.full(len(d), -1)
        known = match >= 0 if self.emergent else np.zeros(len(d), bool)
        p_len[known], p_idx[known] = d[known], ranks.rank(with_match(verts[known], match[known]))
        for k in np.flatnonzero(~known):
            lengths, indices, _ = reducer.cofacets(int(index[k]))
            if len(lengths):
                at = len(lengths) - 1 - int(np.argmin(lengths[::-1]))
                p_len[k], p_idx[k] = lengths[at], indices[at]
        signs = [sign_of(ranks, int(i), int(p), dim + 1, self.modulus) if p >= 0 else 0 for i, p in zip(index, p_idx, strict=True)]
        return pd.DataFrame({"idx": index, "diameter": d, "dead": gone, "p_len": p_len, "p_idx": p_idx, "p_c": signs, "v": [[i] for i in index.tolist()], "c": [[1]] * len(index)})

    def reduced(self, task: dict, rows: pd.DataFrame, dim: int, low: float, high: float) -> pd.DataFrame:
        """A block's columns after reduction as far as their pivots are from low to high (exclusive)."""
        space, ranks = self.space(task), Ranks(task["n"], dim + 2)
        reducer, size = Reducer(space, ranks, dim + 1, self.modulus), dim + 1
        rows = rows.iloc[np.lexsort((rows["idx"].to_numpy(), -rows["diameter"].to_numpy()))]
        owners: dict[int, tuple] = {}

        def owner_of(pivot: int, length: float):
            if low <= length < high and (found := owners.get(pivot)) is not None:
                return found
            facet = _facet_of(space, ranks, pivot, length, size) if self.find_apparent else None
            return None if facet is None else ({facet: 1}, sign_of(ranks, facet, pivot, size, self.modulus))

        p_len, p_idx, p_c, vs, cs = [], [], [], [], []
        for length, pivot, lead, v, c in zip(rows["p_len"], rows["p_idx"], rows["p_c"], rows["v"], rows["c"], strict=True):
            column, found = reducer.reduce(dict(zip(map(int, v), map(int, c), strict=True)), (float(length), int(pivot), int(lead)), owner_of)
            if found is not None and low <= found[0] < high:
                owners[found[1]] = column, found[2]
            p_len.append(np.nan if found is None else found[0])
            p_idx.append(-1 if found is None else found[1])
            p_c.append(0 if found is None else found[2])
            vs.append(list(column) if found else [])
            cs.append(list(column.values()) if found else [])
        return pd.DataFrame({"idx": rows["idx"].to_numpy(), "diameter": rows["diameter"].to_numpy(), "dead": rows["dead"].to_numpy(), "p_len": p_len, "p_idx": p_idx, "p_c": p_c, "v": vs, "c": cs})


def _forest(n: int, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((-(u * (u - 1) // 2 + v), d))
    own = order[forest(n, u, v, order)]
    return pd.DataFrame({"u": u[own], "v": v[own], "d": d[own]})


def _expanded(space, verts: np.ndarray, d: np.ndarray, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The simplices of a dimension whose two lowest vertices are the edges given, a number at a time."""
    step = HELD if verts.shape[1] == dim + 1 else max(1, HELD // max(space.n, 1))
    for k in range(0, len(verts), step):
        if verts.shape[1] == dim + 1:
            yield verts[k : k + step], d[k : k + step]
        else:
            yield from _expanded(space, *space.above(verts[k : k + step], d[k : k + step]), dim)


def _first_facet(space, verts: np.ndarray, diameter: np.ndarray) -> np.ndarray:
    """The place of the vertex that the first facet (by number) as long as the simplex lacks; -1 if none is."""
    size, place = verts.shape[1], np.full(len(verts), -1)
    for k in range(size):  # the facet without the last vertex has the smallest number, so it is looked at last
        others, longest = [j for j in range(size) if j != k], np.zeros(len(verts))
        for a, j in enumerate(others):
            for q in others[:a]:
                longest = np.maximum(longest, space.between(verts[:, q], verts[:, j]))
        place[longest == diameter] = k
    return place


def _is_mate(space, verts: np.ndarray, diameter: np.ndarray) -> np.ndarray:
    """Whether simplices are the cofacets of apparent pairs."""
    place, out = _first_facet(space, verts, diameter), np.zeros(len(verts), bool)
    for k in range(verts.shape[1]):
        own = np.flatnonzero(place == k)
        if len(own):
            facet = np.delete(verts[own], k, axis=1)
            out[own] = space.last_match(facet, diameter[own]) == verts[own, k]
    return out


def _facet_of(space, ranks: Ranks, cofacet: int, length: float, size: int) -> int | None:
    """The facet that a cofacet is in an apparent pair with, from distances alone."""
    verts = np.array([ranks.unrank(cofacet, size + 1)])
    k = int(_first_facet(space, verts, np.array([length]))[0])
    if k < 0:
        return None
    facet = np.delete(verts, k, axis=1)
    added, reach = space.reach(facet[0].tolist(), length)
    return int(ranks.rank(facet)[0]) if int(added[reach <= length][-1]) == verts[0, k] else None


def _key(value: object, kind: str) -> object:
    """A group's identifier as pandas gives it: null may come as NaN, and then whole numbers as floats."""
    if value is None or value is pd.NA or value != value and kind not in ("float", "double"):
        return None
    return int(value) if kind in ("tinyint", "smallint", "int", "bigint") else value


def _run(tasks: DataFrame, work, schema: str) -> DataFrame:
    """work(task) gives a task's frames; group_id and no are put before their columns."""
    kind = tasks.schema["group_id"].dataType.simpleString()
    columns = tasks.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.astype(object).itertuples(index=False):
                task = dict(zip(columns, row, strict=True))
                task["group_id"] = _key(task["group_id"], kind)
                for name in ("part", "n", "tasks", "no"):
                    task[name] = int(task[name])
                found = work(task)
                for frame in [found] if isinstance(found, pd.DataFrame) else found:
                    if not len(frame):
                        continue
                    frame.insert(0, "group_id", [task["group_id"]] * len(frame))
                    frame.insert(1, "no", np.full(len(frame), task["no"], np.int32))
                    yield frame

    return tasks.mapInPandas(run, f"group_id {kind}, no int, {schema}")


def _tasks(groups: DataFrame, total: int) -> DataFrame:
    """One row a task: group_id, part, n, limit, tasks (of the group), no; spread over partitions, of which there are as
    many as tasks, or a few thousand."""
    rows = groups.select("group_id", part_of_group().alias("part"), "n", "limit", "tasks", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("no"))
    return rows.repartition(max(1, min(total, 4096)), "part", "no")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("group_id", "_g")


def _merged_forests(parts: DataFrame, n: DataFrame, most: int) -> DataFrame:
    """Forests of parts (group_id, no, u, v, d) merged FAN_IN at a time to one a group."""
    kind = parts.schema["group_id"].dataType.simpleString()
    sizes = _named(n.select("group_id", "n"))
    while most > 1:
        most = -(-most // FAN_IN)
        rows = parts.withColumn("no", F.floor(F.col("no") / FAN_IN).cast("int")).join(F.broadcast(sizes), F.col("group_id").eqNullSafe(F.col("_g"))).drop("_g")

        def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            out = _forest(int(rows["n"].iloc[0]), *(rows[c].to_numpy() for c in "uvd"))
            out.insert(0, "group_id", [key[0]] * len(out))
            out.insert(1, "no", np.full(len(out), key[1], np.int32))
            return out

        parts = rows.groupBy("group_id", "no").applyInPandas(merge, f"group_id {kind}, no int, u long, v long, d double")
    return cut(parts.select("group_id", "u", "v", "d", (F.call_function("div", F.col("u") * (F.col("u") - 1), F.lit(2).cast("long")) + F.col("v")).alias("idx")))


def _blocks(state: DataFrame, bounds: DataFrame) -> DataFrame:
    """state with block, low and high: the block of each column's pivot."""
    met = state.join(F.broadcast(_named(bounds)), F.col("group_id").eqNullSafe(F.col("_g")))
    block = F.size(F.filter("bounds", lambda x: x <= F.col("p_len")))
    met = met.withColumn("block", block)
    low = F.when(F.col("block") == 0, -INF).otherwise(F.get("bounds", F.col("block") - 1))
    high = F.coalesce(F.get("bounds", F.col("block")), F.lit(INF))
    return met.select(*state.columns, "part", "n", "limit", "block", low.alias("low"), high.alias("high"))


def _reduce(plan: _Plan, state: DataFrame, groups: DataFrame, dim: int) -> DataFrame:
    """The columns with their final pivots: p_idx is -1 where there is none."""
    state = cut(state.drop("no"))
    cols = state.columns
    size = state.where("p_idx >= 0").groupBy("group_id").agg(F.count(F.lit(1)).alias("k"))
    counts = size.agg(F.max("k")).first()[0]
    if not counts:
        return state
    blocks = -(-counts // COLUMNS)
    at = [k / blocks for k in range(1, blocks)]
    bounds = groups.select("group_id", part_of_group().alias("part"), "n", "limit", F.array().cast("array<double>").alias("bounds"))
    if blocks > 1:
        cuts = _named(state.where("p_idx >= 0").groupBy("group_id").agg(F.array_distinct(F.percentile_approx("p_len", at)).alias("cuts")))
        bounds = bounds.join(cuts, F.col("group_id").eqNullSafe(F.col("_g"))).select("group_id", "part", "n", "limit", F.col("cuts").alias("bounds"))
        bounds = cut(bounds)
    kind = state.schema["group_id"].dataType.simpleString()

    def reduce_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        task = {"group_id": _key(key[0], kind), "part": int(first["part"]), "n": int(first["n"]), "limit": float(first["limit"])}
        out = plan.reduced(task, rows, dim, float(first["low"]), float(first["high"]))
        out.insert(0, "group_id", [key[0]] * len(out))
        out["moved"] = (out["p_idx"] >= 0) & ~((out["p_len"] >= first["low"]) & (out["p_len"] < first["high"]))
        return out

    done = state.where("p_idx < 0")
    while True:
        placed = _blocks(state.where("p_idx >= 0"), bounds)
        after = cut(placed.groupBy("group_id", "block").applyInPandas(reduce_block, f"group_id {kind}, {_STATE}, moved boolean"))
        if blocks == 1 or not after.where("moved").limit(1).count():
            return done.unionByName(after.select(*cols))
        done, state = done.unionByName(after.where("p_idx < 0").select(*cols)), after.select(*cols)


def rips_rounds(vertices: DataFrame, edges: DataFrame | None, points: DataFrame | None, max_dim: int, threshold: float | None, modulus: int = 2, find_apparent: bool = True, clearing: bool = True, emergent: bool = True, threads: int = 1) -> DataFrame:
    """Bars (group_id, dim, birth, death) of all groups up to max_dim; of points up to the threshold, by default each
    group's enclosing radius, or else of edges, which are those in the complex."""
    plan = _Plan(stored_by_group(edges if points is None else points), points is not None, modulus, find_apparent, clearing, emergent)
    groups = vertices.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).withColumn("limit", F.lit(INF if threshold is None else float(threshold)))
    if points is None:
        count = _named(edges.groupBy("group_id").agg(F.count(F.lit(1)).alias("pairs")))
        groups = groups.join(count, F.col("group_id").eqNullSafe(F.col("_g")), "left").select("group_id", "n", "limit", F.coalesce("pairs", F.lit(0)).alias("pairs"))
    else:
        groups = groups.withColumn("pairs", F.col("n") * F.col("n") / 2)
    groups = cut(groups.withColumn("tasks", F.greatest(F.lit(threads), F.ceil(F.col("pairs") / PAIRS).cast("int"), F.lit(1))).drop("pairs"))
    total, most = (x or 1 for x in groups.agg(F.sum("tasks"), F.max("tasks")).first())
    tasks = _tasks(groups, total)
    if points is not None and threshold is None:
        radius = _run(tasks, plan.radius, "far double").groupBy("group_id").agg(F.min("far").alias("r"))
        groups = cut(groups.drop("limit").join(_named(radius), F.col("group_id").eqNullSafe(F.col("_g"))).select("group_id", "n", F.col("r").alias("limit"), "tasks"))
        tasks = _tasks(groups, total)
    joins = _merged_forests(_run(tasks, plan.forest, "u long, v long, d double"), groups, max(most, 2))
    finite = joins.where("d > 0").select("group_id", F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), F.col("d").alias("death"))
    m = _named(joins.groupBy("group_id").agg(F.count(F.lit(1)).alias("m")))
    left = groups.join(m, F.col("group_id").eqNullSafe(F.col("_g")), "left").select("group_id", (F.col("n") - F.coalesce("m", F.lit(0))).cast("int").alias("k"))
    essential = left.select("group_id", F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), F.explode(F.array_repeat(F.lit(INF), F.col("k"))).alias("death"))
    bars, dead = finite.unionByName(essential), joins.select("group_id", "idx")
    for dim in range(1, max_dim + 1):
        names = stored_by_group(dead)
        state = _reduce(plan, _run(tasks, lambda task, dim=dim, names=names: plan.columns(task, dim, names), _STATE), groups, dim)
        finite = state.where("p_idx >= 0 and p_len > diameter").select("group_id", F.lit(dim).alias("dim"), F.col("diameter").alias("birth"), F.col("p_len").alias("death"))
        essential = state.where("p_idx < 0 and not dead").select("group_id", F.lit(dim).alias("dim"), F.col("diameter").alias("birth"), F.lit(INF).alias("death"))
        bars, dead = bars.unionByName(finite).unionByName(essential), state.where("p_idx >= 0").select("group_id", F.col("p_idx").alias("idx"))
    return bars
