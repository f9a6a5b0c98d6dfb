"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words, lower-cased, make one automaton. Training texts are streamed through it word by word; the
automaton keeps the longest suffix read so far that occurs in any item. A suffix of `window` words or more ends
an occurrence of a window; items with fewer words are one window each and are met on the suffix links. Words
inside occurrences are hit, whichever item they are from.

A word that no item has resets the automaton, so only stretches of item words that are long enough to hold a
window are streamed. Documents are never shuffled. The items are sent to all executors; one automaton holds
AUTOMATON_BYTES of item text at most, and a larger benchmark is dealt to several automata, one pass each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import arrow_batches, cut, free, map_rows, table, texts

#: Words of a window.
WINDOW = 13
#: Bytes of item text in one automaton, which is sent to every executor. As Python holds it, an automaton takes some
#: 70 times its text, so 140 MB in the driver and in each Python worker.
AUTOMATON_BYTES = 2 << 20
#: A document is contaminated if it has a hit and MOST_CLEAN times its hit words are at least all its words.
MOST_CLEAN = 20

#: Every byte that is not of a word becomes a space, A-Z become a-z: words are runs of 0-9, a-z and bytes over 0x7F.
_NORMAL = bytes(b if chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(128)) + bytes(range(128, 256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Automaton:
    """Generalised suffix automaton over items: pairs of an identifier (string) and its words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in item]) for name, item in items if item]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        n = len(self.length)
        #: By state: items with a window that ends there; and lengths of short items that end there, with their names.
        self.whole: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        self.shortest = window
        for name, codes in coded:
            size = min(window, len(codes))
            self.shortest = min(self.shortest, size)
            for end, v, matched in self.stream(codes):
                if matched >= size:
                    while self.length[self.link[v]] >= size:
                        v = self.link[v]
                    if size == window:
                        self.whole.setdefault(v, set()).add(name)
                    elif end == len(codes) - 1:
                        # Several lengths can share a state only if the strings end alike; keep each length.
                        self.short.setdefault(v, {}).setdefault(size, set()).add(name)
        #: The nearest state with short items on the way of suffix links, the state itself included.
        self.near = [-1] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            self.near[v] = v if v in self.short else self.near[self.link[v]]

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        state = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return state

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(edges)
        self.link.append(link)
        return len(self.length) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        state = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = state
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = state
            p = self.link[p]
        return state

    def stream(self, codes: list[int]) -> Iterator[tuple[int, int, int]]:
        """Position, state and length of the longest match that ends there, for each code."""
        edges, link, length = self.next, self.link, self.length
        v = matched = 0
        for k, c in enumerate(codes):
            while v and c not in edges[v]:
                v = link[v]
                matched = length[v]
            if c in edges[v]:
                v = edges[v][c]
                matched += 1
            yield k, v, matched

    def hits(self, document: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Disjoint ascending spans [start, end) of hit words, and the items that have windows there."""
        n, found, spans = len(document), set(), []
        if n < self.shortest:
            return spans, found
        codes = np.fromiter(map(self.vocabulary.get, document, repeat(-1)), np.int64, n)
        breaks = np.concatenate(([-1], np.flatnonzero(codes < 0), [n]))
        for k in np.flatnonzero(np.diff(breaks) > self.shortest):
            first = int(breaks[k]) + 1
            self._stretch(codes[first : breaks[k + 1]].tolist(), first, spans, found)
        return spans, found

    def _stretch(self, codes: list[int], first: int, spans: list[list[int]], found: set[str]) -> None:
        window, near, link, length = self.window, self.near, self.link, self.length
        for k, v, matched in self.stream(codes):
            most, u = 0, near[v]
            while u > 0:
                for size, names in self.short[u].items():
                    if size <= matched:
                        most = max(most, size)
                        found |= names
                u = near[link[u]]
            if matched >= window:
                most, u = window, v
                while length[link[u]] >= window:
                    u = link[u]
                found |= self.whole[u]
            if most:
                start, end = first + k + 1 - most, first + k + 1
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, end])


def automata(benchmark: DataFrame, window: int, text: str, item_id: str) -> Iterator[Automaton]:
    """One automaton, or several over disjoint parts of a benchmark of more than AUTOMATON_BYTES."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // AUTOMATON_BYTES) or 1
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == k) if parts > 1 else items
        yield Automaton([(r.name, words(r.text.encode())) for r in part.collect()], window)


_SPANS = "array<struct<start:int,end:int>>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row of docs: doc_id, text, n_words, hit_spans (word positions, end exclusive, disjoint, in order)
    and hit_items (identifiers as strings, sorted).

    A null text has no words; a text without words has no hit. Null and empty items have no window; an item with
    a null identifier is named by the empty string; items that repeat an identifier count as one. Repeated rows
    give repeated results. Without items nothing is hit."""
    spark = docs.sparkSession
    arrow_batches(spark)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.lit(None).cast(_SPANS), "hit_items": F.lit(None).cast("array<string>")})
    for k, automaton in enumerate(automata(benchmark, window, item_text, item_id)):
        shared = spark.sparkContext.broadcast(automaton)

        def scan(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in rows:
                n, all_spans, all_items = [], [], []
                for body, old_spans, old_items in zip(texts(batch.column(1)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    document = words(body)
                    found, names = automaton.hits(document)
                    n.append(len(document))
                    all_spans.append(_merged([*((x["start"], x["end"]) for x in old_spans or ()), *map(tuple, found)]))
                    all_items.append(sorted(names.union(old_items or ())))
                columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(all_spans, spans), pa.array(all_items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_words", "hit_spans", "hit_items"])

        out = (cut(out) if k else out).mapInArrow(scan, T.StructType(out.schema.fields))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [{"start": a, "end": b} for a, b in out]


def verdicts(found: DataFrame) -> DataFrame:
    """The contamination rule's columns for contamination()'s rows."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (MOST_CLEAN * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, columns as they are; one narrow pass with all columns."""
    return _filtered(docs, benchmark, window, text, None)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", min_words: int = WINDOW, max_coverage: float = 1 / MOST_CLEAN) -> DataFrame:
    """docs with hit spans of min_words or more cut out of the texts (from the first word's start to the last
    word's end); rows of which hits cover max_coverage or more go whole."""
    return _filtered(docs, benchmark, window, text, (min_words, max_coverage))


def _filtered(docs: DataFrame, benchmark: DataFrame, window: int, text: str, limits: tuple[int, float] | None) -> DataFrame:
    """One pass an automaton over whole rows; spans found so far travel in a column of their own, and the last pass
    judges. A worker holds one automaton at a time."""
    spark = docs.sparkSession
    arrow_batches(spark)
    at, column = docs.columns.index(text), free(docs.columns, "_spans")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    found = docs.withColumn(column, F.lit(None).cast(_SPANS))
    parts = automata(benchmark, window, "text", "item_id")
    now = next(parts)
    while now is not None:
        after = next(parts, None)
        shared, last = spark.sparkContext.broadcast(now), after is None

        def scan(rows: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                bodies = texts(batch.column(at))
                listed = [words(body) for body in bodies]
                before = batch.column(batch.num_columns - 1).to_pylist()
                spans = [_merged([*((x["start"], x["end"]) for x in old or ()), *map(tuple, shared.value.hits(w)[0])]) for w, old in zip(listed, before, strict=True)]
                plain = batch.select(range(batch.num_columns - 1))
                yield _judged(plain, bodies, [len(w) for w in listed], spans, at, limits) if last else plain.append_column(column, pa.array(spans, kind))

        found = map_rows(found, scan, docs.schema if last else found.schema)
        now, found = after, found if last else cut(found)
    return found


def _judged(batch: pa.RecordBatch, bodies: list[bytes], sizes: list[int], spans: list[list[dict]], at: int, limits: tuple[int, float] | None) -> pa.RecordBatch:
    hits = [sum(x["end"] - x["start"] for x in own) for own in spans]
    if limits is None:
        keep = [not (hit and MOST_CLEAN * hit >= n) for hit, n in zip(hits, sizes, strict=True)]
    else:
        keep = [not (hit and hit >= limits[1] * n) for hit, n in zip(hits, sizes, strict=True)]
        there = batch.column(at).is_valid().to_pylist()
        left = [_without(b, [x for x in own if x["end"] - x["start"] >= limits[0]]).decode() if x else None for b, own, x in zip(bodies, spans, there, strict=True)]
        batch = batch.set_column(at, batch.schema.field(at).name, pa.array(left, pa.string()))
    return batch.filter(pa.array(keep, pa.bool_()))


def _without(body: bytes, spans: list[dict[str, int]]) -> bytes:
    if not spans:
        return body
    at = [m.span() for m in _WORD.finditer(body)]
    pieces, last = [], 0
    for x in spans:
        pieces.append(body[last : at[x["start"]][0]])
        last = at[x["end"] - 1][1]
    return b"".join([*pieces, body[last:]])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def brute_force(document: bytes, items: list[tuple[str, bytes]], window: int = WINDOW) -> tuple[int, int, int, str, bool]:
    """n_words, n_hit, n_items, items_sha256 and contaminated of one text by comparing all windows; for tests."""
    w, hit, names = words(document), set(), set()
    for name, text in items:
        item = words(text)
        size = min(window, len(item))
        for j in range(len(item) - size + 1 if size else 0):
            for k in range(len(w) - size + 1):
                if w[k : k + size] == item[j : j + size]:
                    hit.update(range(k, k + size))
                    names.add(name)
    joined = ",".join(sorted(names)).encode()
    return len(w), len(hit), len(names), hashlib.sha256(joined).hexdigest(), bool(hit) and MOST_CLEAN * len(hit) >= len(w)


def oracle() -> str:
    return r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), b AS (
        SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), sized AS (SELECT item, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0
    ), windows AS (SELECT DISTINCT item, k, array_to_string(w[j : j + k - 1], ' ') AS s FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM sized)
    ), spots AS (
        SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS s
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)
    ), found AS (SELECT doc_id, p, k, item FROM spots JOIN windows USING (k, s)
    ), hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY doc_id
    ), named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """
