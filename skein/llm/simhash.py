"""SimHash near duplicates with pigeonring filtering.

Fingerprints of 64 bits lie on a ring of SEGMENTS segments. If two differ in at most BITS bits, then by the
pigeonring principle (Qin and Xiao, VLDB 2018) some segment starts a chain all of whose prefixes of l segments
differ in at most l * BITS / SEGMENTS bits. The first CHAIN segments of such chains are found by equality of keys:
one side has the chain's bits as they are, the other all ways to change them within the budgets. The longer prefixes
are then checked, and at last the whole distance. No link is lost and no bucket is capped.

Of a dense bucket not all pairs are listed. Fingerprints that have a chain's bits in common are first linked with the
smallest and the largest of them only. A bucket whose members are all connected by then is done; of the others, pairs
are compared that aren't connected, and of each two groups one link is kept. So the links are about as many as the
fingerprints, and connect what all links would.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.llm import shingles, similar
from skein.llm.common import SALTS, arrow_batches, cut, discard, few, lookup, table, texts
from skein.llm.components import components

#: Words of a shingle, and most differing bits of a link.
SHINGLE, BITS = 4, 4
#: Bits of the segments on the ring.
SEGMENTS = (13, 13, 13, 13, 12)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    return shingles.fingerprint(shingles.hashes(text, size))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row; null counts as empty."""
    arrow_batches(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = np.fromiter(map(fingerprint, texts(batch.column(1))), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("fp", T.LongType())]))


def budget(length: int) -> int:
    """Most differing bits in a chain's first `length` segments."""
    return length * BITS // len(SEGMENTS)


def changes(start: int, chain: int) -> list[int]:
    """All ways to change the bits of a chain within the budgets of its prefixes, as masks, no change first; the chain's
    first segment is in the lowest bits."""
    widths = [SEGMENTS[(start + j) % len(SEGMENTS)] for j in range(chain)]
    edges = np.cumsum([0, *widths])
    found = []
    for n in range(budget(chain) + 1):
        for bits in combinations(range(int(edges[-1])), n):
            if all(sum(b < edges[j] for b in bits) <= budget(j) for j in range(1, chain + 1)):
                found.append(sum(1 << b for b in bits))
    return found


def chain_length(n: int) -> int:
    """Segments in the join key for n fingerprints: the fewer rows and expected chance candidates a fingerprint."""
    bits = sum(SEGMENTS) / len(SEGMENTS)
    cost = {c: (1 + n / 2 ** (bits * c)) * sum(len(changes(s, c)) for s in range(len(SEGMENTS))) for c in (2, 3)}
    return min(cost, key=cost.__getitem__)


def _turned(fp: Column, start: int) -> Column:
    """The ring turned so that segment `start` is in the lowest bits."""
    at = sum(SEGMENTS[:start])
    return fp if at == 0 else F.shiftrightunsigned(fp, at).bitwiseOR(F.shiftleft(fp, 64 - at))


def _chain(fp: Column, start: int, chain: int) -> Column:
    width = sum(SEGMENTS[(start + j) % len(SEGMENTS)] for j in range(chain))
    return _turned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _key(chain: Column, start: int) -> Column:
    """The join key: a chain's bits and where it starts."""
    return F.shiftleft(chain, 3).bitwiseOR(F.lit(start).cast("long"))


def _near(x: Column, key: Column, chain: int) -> Column:
    """Whether two fingerprints whose difference is x, met under a key, are within the budgets of the key's chain."""
    ahead = F.lit(False)
    for s in range(len(SEGMENTS)):
        within = F.lit(True)
        for length in range(chain + 1, len(SEGMENTS)):
            within = within & (F.bit_count(_chain(x, s, length)) <= budget(length))
        ahead = ahead | ((key.bitwiseAND(F.lit(7).cast("long")) == s) & within)
    return ahead & (F.bit_count(x) <= BITS)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): pairs of different fingerprints, a > b, that differ in at most BITS bits: not all such pairs, but so many
    that what all of them would connect is connected. fps: distinct values in column fp."""
    starts = range(len(SEGMENTS))
    chain = chain_length(fps.count())
    fp = F.col("fp")
    # Stars: each fingerprint and the least and greatest one with the same chain.
    own = fps.select("fp", F.explode(F.array(*[_key(_chain(fp, s, chain), s) for s in starts])).alias("key"))
    ends = own.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    met = own.join(ends, "key").select("fp", "key", F.explode(F.array("low", "high")).alias("b")).where("fp <> b")
    met = met.where(_near(fp.bitwiseXOR(F.col("b")), F.col("key"), chain))
    stars = cut(met.select(F.greatest("fp", "b").alias("a"), F.least("fp", "b").alias("b")).distinct(), "stars")
    # All others: rows of the keys that hold fingerprints which aren't connected yet, and one of them unchanged.
    known = components(stars).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = lookup(fps, known, "fp", F.pmod(F.xxhash64("fp"), F.lit(SALTS))).select("fp", F.coalesce("root", "fp").alias("root"))

    def changed(s: int) -> Column:
        here = _chain(fp, s, chain)
        return F.transform(F.lit(changes(s, chain)).cast("array<long>"), lambda mask: F.struct(_key(here.bitwiseXOR(mask), s).alias("key"), (mask == 0).alias("own")))

    rows = rooted.select("fp", "root", F.inline(F.flatten(F.array(*map(changed, starts)))))
    over = Window.partitionBy("key")
    rows = rows.select("*", F.min("root").over(over).alias("low"), F.max("root").over(over).alias("high"), F.max("own").over(over).alias("met"))
    rows = cut(rows.where("met and low < high").select("key", "fp", "root", "own"), "mixed")
    x = rows.select("key", F.col("fp").alias("x"), F.col("root").alias("rx"))
    y = rows.where("own").select("key", F.col("fp").alias("y"), F.col("root").alias("ry"))
    pairs = x.join(y, "key").where((F.col("rx") != F.col("ry")) & _near(F.col("x").bitwiseXOR(F.col("y")), F.col("key"), chain))
    one = pairs.groupBy(F.greatest("rx", "ry").alias("_r"), F.least("rx", "ry").alias("_q")).agg(F.min(F.struct(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))).alias("link"))
    found = cut(stars.unionByName(one.select("link.a", "link.b")), "links")
    discard(stars), discard(rows)
    return found


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row.

    Rows are linked if their fingerprints differ in at most BITS bits; component_id is the smallest identifier
    that can be reached, a row's own included. Equal fingerprints are one vertex, however many rows have them.
    Texts without words have fingerprint zero and are linked like others. Null identifiers don't count for
    component_id (null if a component has no other). Repeated rows stay. An empty table gives an empty result."""
    rows = cut(fingerprints(docs, text, doc_id), "fingerprints")
    vertices = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "vertices")
    tied = components(links(vertices.select("fp")))
    # Only fingerprints that are linked or that several rows have need be looked up.
    roots = tied.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(tied.select("b", "b").distinct())
    linked = cut(roots.join(vertices, "fp").select("fp", "root", "least"), "linked")
    best = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")), "best")
    found = lookup(linked, best, "root", F.pmod(F.xxhash64("fp"), F.lit(SALTS))).select("fp", "component_id")
    copies = vertices.where("n > 1").join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    found = cut(found.unionByName(copies).withColumn("met", F.lit(True)), "found")
    out = lookup(rows, found, "fp", F.pmod(F.xxhash64("doc_id", "fp"), F.lit(SALTS)))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("met"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, columns as they are: of each group of near duplicates one, as keep_one() has it.

    Near duplicates have sets of five-word shingles with a Jaccard similarity of 0.8 or more; groups are what such
    links connect. Rows whose SimHash fingerprints (of the same shingles) are equal or linked are compared first, each
    link verified on the whole sets. Texts of that similarity often differ in more bits than any key can bridge, so the
    pairs that fingerprints miss are then found by the shingles themselves (see similar.linked); none is lost. Rows are
    told apart by number, not by identifier, so null and repeated identifiers and repeated rows do no harm. A null
    text counts as empty; texts without words are one group."""
    docs, row = similar.with_rows(docs)
    rows = docs.select(F.col(row).alias("row"), F.col(text).alias("text"))
    keyed = similar.keyed(rows)
    first = cut(keyed.groupBy("fp").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), "first")
    several = first.where("n > 1").select("fp", "first")
    equal = keyed.select("row", "fp").join(F.broadcast(several) if few(several) else several, "fp").where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    pairs = links(first.select("fp"))
    pairs = pairs.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    ties = similar.linked(rows, keyed, equal.union(pairs.select("x", "y")))
    groups = ties.select(F.col("a").alias("row"), F.col("b").alias("root")).union(ties.select("b", "b").distinct())
    return similar.keep_one(docs, row, groups, text, doc_id)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
