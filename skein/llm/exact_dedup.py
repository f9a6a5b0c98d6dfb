"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition is a run: its distinct texts in the order of their digests, one entry each with the identifier
that stays and the number of copies, as one array (or several, by ranges of digests). Runs are exchanged in rounds as
in a binomial tree with FAN_IN children a node: in a round the runs of FAN_IN nodes meet at their parent, each cut
into FAN_IN ranges of digests, so that a range of a parent is no longer than one of a child and no task's share grows
with the tree. The exchange is dealt by node and range and moves whole runs. Those that meet are put end to end and
merged by a sort that takes ascending runs as they are (array_sort is a natural merge sort), and equal neighbours
become one entry. An entry is a SHA-256 digest verified by the text's length and a second, independent 64-bit hash:
entries are equal only if all three agree, at every level. At the top only texts with copies are kept; rows look
theirs up by run, so that a text that a third of all rows share is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import ascii_lower, cut, few, free, lookup, table

#: Children of a node of the tree, a power of two, and entries of an array of a run, about.
FAN_IN, ENTRIES = 8, 4096
#: Bits of a digest by which ranges are cut: levels of the tree and first ranges have that many at most.
_BITS = 60
_ENTRY = ["_digest", "_bytes", "_check"]


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, run and verified digest of each row's text after lower-casing A-Z; null counts as empty."""
    normal = docs.select(F.col(doc_id).alias("doc_id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    return normal.select(
        "doc_id",
        F.spark_partition_id().alias("_run"),
        F.unhex(F.sha2("_text", 256)).alias("_digest"),
        F.octet_length("_text").alias("_bytes"),
        F.xxhash64("_text").alias("_check"),
    )


def _part(lead: Column, bits: int) -> Column:
    """The range of a digest: its first bits."""
    return F.shiftrightunsigned(lead, _BITS - bits) if bits else F.lit(0).cast("long")


def _merged(runs: str) -> list[tuple[str, Column]]:
    """Steps (column name, expression) from an array of sorted runs to one sorted run with one entry a text."""
    c, at = F.col, lambda k: F.element_at(F.col("_all"), k)
    same = lambda a, b: (a["digest"] == b["digest"]) & (a["bytes"] == b["bytes"]) & (a["check"] == b["check"])
    group = lambda a, b: F.slice(c("_all"), a, b - a)

    def entry(a: Column, b: Column) -> Column:
        first, copies = at(a), group(a, b)
        best = F.array_max(F.transform(copies, lambda e: e["best"]))
        n = F.aggregate(copies, F.lit(0).cast("long"), lambda s, e: s + e["n"])
        return F.struct(first["lead"].alias("lead"), first["digest"].alias("digest"), first["bytes"].alias("bytes"), first["check"].alias("check"), best.alias("best"), n.alias("n"))

    heads = F.filter(F.sequence(F.lit(1), F.size("_all")), lambda k: (k == 1) | ~same(at(k), at(F.greatest(k - 1, F.lit(1)))))
    return [
        ("_all", F.array_sort(F.flatten(c(runs)))),
        ("_heads", heads),
        ("_run_of", F.zip_with(c("_heads"), F.concat(F.slice(c("_heads"), 2, F.size("_heads")), F.array(F.size("_all") + 1)), entry)),
    ]


def _with(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    for name, step in steps:
        df = df.withColumn(name, step)
    return df


def merge_tree(leaves: DataFrame) -> DataFrame:
    """The distinct texts of `leaves` (doc_id, _run and the entry columns), from the top of the tree: the entry columns,
    _best (a struct of the largest identifier) and _n (how many rows have the text)."""
    lead = F.conv(F.hex(F.substring("_digest", 1, 8)), 16, 10).cast("decimal(20,0)")
    lead = F.call_function("div", lead, F.lit(1 << (64 - _BITS))).cast("long")
    # The largest identifier is of a fixed size for most types, so that this is a hash aggregation, begun where rows are.
    texts = leaves.groupBy("_run", *_ENTRY).agg(F.max("doc_id").alias("_best"), F.count(F.lit(1)).alias("_n")).withColumn("_lead", lead)
    texts = cut(texts, "run")
    size = texts.groupBy("_run").count().agg(F.max("_run"), F.max("count")).first()
    runs, longest = (size[0] or 0) + 1, size[1] or 0
    step, bits = FAN_IN.bit_length() - 1, max(0, (longest // ENTRIES).bit_length())
    fields = F.struct(F.col("_lead").alias("lead"), F.col("_digest").alias("digest"), F.col("_bytes").alias("bytes"), F.col("_check").alias("check"), F.struct(F.col("_best").alias("doc_id")).alias("best"), F.col("_n").alias("n"))
    level = texts.groupBy(F.col("_run").alias("_node"), _part(F.col("_lead"), bits).alias("_range")).agg(F.array_sort(F.collect_list(fields)).alias("_run_of"))
    while runs > 1:
        runs = -(-runs // FAN_IN)
        deeper = min(bits + step, _BITS)
        cuts = F.transform(F.sequence(F.lit(0), F.lit((1 << (deeper - bits)) - 1)), lambda j: F.struct((F.shiftleft(F.col("_range"), deeper - bits) + j).alias("_range"), F.filter("_run_of", lambda e: _part(e["lead"], deeper) == F.shiftleft(F.col("_range"), deeper - bits) + j).alias("_piece")))
        up = level.select(F.floor(F.col("_node") / FAN_IN).cast("int").alias("_node"), F.inline(cuts)).where(F.size("_piece") > 0)
        met = up.groupBy("_node", "_range").agg(F.collect_list("_piece").alias("_runs"))
        level, bits = _with(met, _merged("_runs")).select("_node", "_range", "_run_of"), deeper
    top = level.select(F.inline("_run_of"))
    return top.select(F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes"), F.col("check").alias("_check"), F.col("best").alias("_best"), F.col("n").alias("_n"))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row.

    Of rows with equal texts (A-Z lower-cased, null as empty) the one with the largest identifier stays. A null
    identifier is below all others. Rows that repeat both text and identifier are all counted in group_size;
    if theirs is the largest identifier each of them is marked kept. An empty table gives an empty result."""
    leaves = cut(digests(docs, text, doc_id), "leaves")
    copies = cut(merge_tree(leaves).where("_n > 1"), "copies")
    found = lookup(leaves, copies, _ENTRY, F.col("_run"))
    keep, size = F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_best.doc_id")), F.coalesce("_n", F.lit(1).cast("long"))
    out = found.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.lower(F.hex("_digest")).alias("text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, one for each distinct text, columns as they are.

    Rows that go are found by identifier and digest, so an identifier that several texts bear does no harm; of
    rows that repeat both identifier and text one stays. The rows that go are broadcast if they are few, by
    count, and else joined by shuffle."""
    key, sha = free(docs.columns, "_key"), free(docs.columns, "_sha")
    other = free([*docs.columns, key, sha], "_other_key"), free([*docs.columns, key, sha], "_other_sha")
    groups = cut(exact_groups(docs, text, doc_id).where("group_size > 1").select(F.col("doc_id").alias(other[0]), F.col("text_sha256").alias(other[1]), "kept"), "groups")
    marked = docs.withColumn(sha, F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))), 256)).withColumn(key, F.col(doc_id))
    same = F.col(key).eqNullSafe(F.col(other[0])) & (F.col(sha) == F.col(other[1]))

    def matched(rows: DataFrame, how: str) -> DataFrame:
        return marked.join(F.broadcast(rows) if few(rows) else rows, same, how)

    gone = groups.where("not kept").select(*other).distinct()
    repeated = cut(groups.where("kept").groupBy(*other).count().where("count > 1").select(*other), "repeated")
    if not repeated.limit(1).count():
        return matched(gone, "left_anti").drop(key, sha)
    once = matched(repeated, "left_semi").dropDuplicates([key, sha])
    return matched(gone.union(repeated), "left_anti").unionByName(once).drop(key, sha)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def oracle() -> str:
    return """
    WITH t AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents
    ), g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, h AS text_sha256 FROM t JOIN g USING (h)
    """
