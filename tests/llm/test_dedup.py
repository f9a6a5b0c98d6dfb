"""Exact dedup, SimHash and components against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import common, exact_dedup, shingles, simhash
from skein.llm.common import ascii_lower
from skein.llm.components import components

from .conftest import TRICKY

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for i, t in rows:
        own = groups[(t or "").translate(LOWER)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()))
    return sorted(map(repr, out))


def test_exact_groups_of_tricky_rows(tricky):
    assert sorted(repr(tuple(r)) for r in exact_dedup.exact_groups(tricky).collect()) == brute_exact(TRICKY)


@pytest.mark.parametrize("fan_in", [2, 4, 64])
def test_exact_groups_through_many_rounds(documents, monkeypatch, fan_in):
    monkeypatch.setattr(exact_dedup, "FAN_IN", fan_in)
    monkeypatch.setattr(exact_dedup, "ENTRIES", 4)
    draw = random.Random(1)
    rows = [(k, "hot" if draw.random() < 0.4 else f"T{draw.randint(0, 60)}") for k in range(400)]
    found = exact_dedup.exact_groups(documents(rows).repartition(11))
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute_exact(rows)


def test_drop_exact(documents, tricky, clashing):
    rows = [(5, "a"), (5, "b"), (7, "A"), (8, "b"), (8, "b"), (3, None), (2, "")]
    assert sorted((r.doc_id, r.text) for r in exact_dedup.drop_exact(documents(rows)).collect()) == [(3, None), (7, "A"), (8, "b")]
    kept = exact_dedup.drop_exact(tricky)
    assert kept.columns == tricky.columns and kept.count() == len({(t or "").translate(LOWER) for _, t in TRICKY})
    assert sorted(r.doc_id for r in exact_dedup.drop_exact(clashing).collect()) == [2, 3, 4]
    assert exact_dedup.drop_exact(tricky.limit(0)).count() == 0 and exact_dedup.exact_groups(tricky.limit(0)).count() == 0


def test_many_dropped_rows_are_joined_by_shuffle(documents, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    rows = [(k, f"t{k % 5}") for k in range(50)]
    assert sorted(r.doc_id for r in exact_dedup.drop_exact(documents(rows)).collect()) == list(range(45, 50))


def test_ascii_lower(documents):
    texts = ["ABC xyz", "ÀÉZ", "İI", "ΑΣ", ""]
    found = documents(list(enumerate(texts))).select("doc_id", ascii_lower(F.col("text")).alias("t")).orderBy("doc_id").collect()
    assert [r.t for r in found] == [t.translate(LOWER) for t in texts]


def brute_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, fps):
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(rows))]


def near_rows():
    draw = random.Random(4)
    rows, k = list(TRICKY[:6]) + TRICKY[7:12], 100
    for _ in range(25):
        words = [f"v{draw.randint(0, 400)}" for _ in range(draw.randint(5, 90))]
        for _ in range(draw.randint(1, 6)):
            rows.append((k, " ".join(words)))
            words[draw.randrange(len(words))] = "changed"
            k += 1
    return rows


def test_near_groups(documents):
    rows = near_rows()
    fps = [brute_fingerprint(t or "") for _, t in rows]
    assert [simhash.fingerprint((t or "").encode()) for _, t in rows] == fps
    expected = sorted(repr((i, f"{f:016x}", c)) for (i, _), f, c in zip(rows, fps, brute_components(rows, fps), strict=True))
    assert sorted(repr(tuple(r)) for r in simhash.near_groups(documents(rows).repartition(5)).collect()) == expected


def test_fingerprint_of_a_long_text(monkeypatch):
    text = TRICKY[6][1][:60_000]
    expected = brute_fingerprint(text)
    monkeypatch.setattr(shingles, "BLOCK", 1000)
    assert simhash.fingerprint(text.encode()) == expected


@pytest.mark.parametrize("chain", [2, 3])
def test_links_lose_none(spark, monkeypatch, chain):
    monkeypatch.setattr(simhash, "chain_length", lambda n: chain)
    draw = random.Random(chain)
    values = set()
    for _ in range(30):
        base = draw.getrandbits(64)
        values |= {base, base ^ (1 << 63)} | {base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 5))) for _ in range(3)}
    values = sorted(np.array(sorted(values), np.uint64).view(np.int64).tolist())
    near = {(b, a) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    found = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    assert found <= near and groups_of(values, found) == groups_of(values, near)


def groups_of(values, pairs):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        parent[find(a)] = find(b)
    sets = {}
    for v in values:
        sets.setdefault(find(v), set()).add(v)
    return sorted(map(sorted, sets.values()))


def test_dense_fingerprints_give_few_links(spark):
    """All ways to change one or two bits of one fingerprint: 2,081 vertices, each within four bits of all others."""
    base = 0x0123456789ABCDEF
    values = {base} | {base ^ 1 << i for i in range(64)} | {base ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)}
    values = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    found = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()]
    assert len(groups_of(values, found)) == 1 and len(found) < 15 * len(values)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in found)


def test_chains_grow_with_the_input():
    assert simhash.chain_length(10**6) == 2 and simhash.chain_length(10**11) == 3
    assert sum(len(simhash.changes(s, 2)) for s in range(5)) == 5 * 14 - 1


def test_components_of_paths_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(200 + k, 200 + (k + 1) % 17) for k in range(17)] + [(5, 5), (300, 301), (301, 300)]
    found = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 61)} | {100 + k: 100 for k in range(1, 40)} | {200 + k: 200 for k in range(1, 17)} | {301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(documents):
    assert simhash.near_groups(documents([])).count() == 0
