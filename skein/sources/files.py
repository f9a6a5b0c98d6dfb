"""Text files of points, lower distance matrices and sparse distances, read and parsed by Spark."""

from __future__ import annotations

import json
from pathlib import PurePath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.params import InputOutput, InvalidDistance, InvalidInput, rust_float
from skein.plans.rips import MetricSpace
from skein.operators.metric import pairwise
from skein.sources.memory import ALONE, from_edge_frame, size_of_condensed

FORMATS = ("point-cloud", "lower-distance", "sparse")
#: Number and vertex grammars, separators, and the first vertex number that is out of range.
NUMBER = r"^[+-]?((?i)inf|infinity|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)$"
VERTEX = r"^\+?\d+$"
SEPARATORS = r"(?U)[,\s]+"
LAST_VERTEX = (1 << 64) - 1


def infer_format(path: str) -> str:
    """By the extension, in either case: .csv, .pts and .xyz are point clouds, all else lower distance matrices."""
    return "point-cloud" if PurePath(path).suffix.lower() in (".csv", ".pts", ".xyz") else "lower-distance"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """no (from 1 on) and tokens of the lines that aren't blank or comments. Lines end at LF or CR LF only. Lines are
    numbered without moving them: each block of the file counts its own, and the blocks' counts are few."""
    try:
        raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
        blocks = raw.groupBy("block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(~F.is_valid_utf8("value")).alias("bad")).orderBy("block").collect()
    except AnalysisException as e:
        raise InputOutput(f"{path}: {str(e).splitlines()[0]}") from None
    if any(b.bad for b in blocks):
        raise InputOutput(f"{path}: stream did not contain valid UTF-8")
    before, starts = 0, []
    for b in blocks:
        starts.append((b.block, b.first, before))
        before += b.n
    where = spark.createDataFrame(starts, "block long, first long, before long")
    numbered = raw.join(F.broadcast(where), "block").select((F.col("at") - F.col("first") + F.col("before") + 1).alias("no"), F.regexp_replace("value", "\r$", "").alias("line"))
    kept = numbered.where(~F.col("line").rlike(r"(?U)^\s*(#|$)"))
    return kept.select("no", F.filter(F.split("line", SEPARATORS), lambda t: t != "").alias("tokens"))


def _number(token: Column) -> Column:
    return F.when(token.rlike(NUMBER), token.try_cast("double"))


def _first_bad(rows: DataFrame, good) -> tuple[int, str] | None:
    """Line and first token that isn't `good`, of the first such line."""
    bad = rows.select("no", F.get(F.filter("tokens", lambda t: ~good(t)), F.lit(0)).alias("token"))
    found = bad.where("token is not null").orderBy("no").limit(1).collect()
    return (found[0].no, found[0].token) if found else None


def _quoted(token: str) -> str:
    return json.dumps(token, ensure_ascii=False)


def read_point_cloud(spark: SparkSession, path: str) -> MetricSpace:
    """One point a line; lines of separators only are skipped. The earliest fault is reported, with its line."""
    rows = lines(spark, path).where(F.size("tokens") > 0)
    first = rows.orderBy("no").limit(1).collect()
    size = len(first[0].tokens) if first else 0
    wrong = _first_bad(rows, lambda t: t.rlike(NUMBER))
    ragged = rows.where(F.size("tokens") != size).orderBy("no").limit(1).collect()
    if wrong and (not ragged or wrong[0] <= ragged[0].no):
        raise InvalidInput(f"{path}:{wrong[0]}: not a number: {_quoted(wrong[1])}")
    if ragged:
        raise InvalidInput(f"{path}:{ragged[0].no}: point has {len(ragged[0].tokens)} coordinates, expected {size}")
    points = rows.select("no", F.transform("tokens", _number).alias("coords"))
    odd = points.where(F.exists("coords", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).orderBy("no").limit(1).collect()
    if odd:
        k = points.where(F.col("no") < odd[0].no).count()
        raise InvalidInput(f"point {k} has a non-finite coordinate {rust_float(next(x for x in odd[0].coords if x != x or x in (float('inf'), -float('inf'))))}")
    # Points are numbered by line: a cloud's number of points is bounded by what can be paired.
    numbers = {r.no: k for k, r in enumerate(points.select("no").orderBy("no").collect())}
    ids = spark.createDataFrame(list(numbers.items()), "no long, id long") if numbers else spark.createDataFrame([], "no long, id long")
    frame = points.join(ids, "no").select(F.lit(ALONE).cast("long").alias("group_id"), "id", "coords")
    return MetricSpace(frame.select("group_id", "id"), pairwise(frame), "dense", frame)


def _stream(rows: DataFrame) -> DataFrame:
    """value and place (from 0 on) of all tokens in file order."""
    sizes = rows.select("no", F.size("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("no", before.alias("before"))
    return rows.join(starts, "no").select(F.col("before"), F.posexplode("tokens").alias("k", "token")).select((F.col("before") + F.col("k")).alias("place"), _number(F.col("token")).alias("d"))


def read_lower_distances(spark: SparkSession, path: str) -> MetricSpace:
    """All numbers of the file in order are the lower triangle by rows; line breaks don't matter."""
    rows = lines(spark, path)
    if wrong := _first_bad(rows, lambda t: t.rlike(NUMBER)):
        raise InvalidInput(f"{path}:{wrong[0]}: not a number: {_quoted(wrong[1])}")
    values = _stream(rows)
    m = rows.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    n = size_of_condensed(m)
    odd = values.where(F.isnan("d") | (F.col("d") < 0)).orderBy("place").limit(1).collect()
    if odd:
        d = odd[0].d
        raise InvalidDistance(f"NaN at condensed index {odd[0].place}" if d != d else f"negative entry {rust_float(d)} at condensed index {odd[0].place}")
    u = F.floor((1 + F.sqrt(1 + 8 * F.col("place").cast("double"))) / 2).cast("long")
    u = F.when(F.call_function("div", u * (u - 1), F.lit(2).cast("long")) > F.col("place"), u - 1).otherwise(u)
    placed = values.select("place", "d", u.alias("u"))
    edges = placed.select(F.lit(ALONE).cast("long").alias("group_id"), "u", (F.col("place") - F.call_function("div", F.col("u") * (F.col("u") - 1), F.lit(2).cast("long"))).cast("long").alias("v"), (F.col("d") + 0.0).alias("d"))
    return MetricSpace(spark.range(n).select(F.lit(ALONE).cast("long").alias("group_id"), "id"), edges, "dense")


def read_sparse(spark: SparkSession, path: str) -> MetricSpace:
    """Lines `i j d`; the number of points is one more than the largest vertex."""
    rows = lines(spark, path)
    t = F.col("tokens")
    huge = lambda k: F.get(t, F.lit(k)).try_cast("decimal(38,0)") >= F.lit(str(LAST_VERTEX)).cast("decimal(38,0)")
    over = lambda k: F.get(t, F.lit(k)).try_cast("decimal(38,0)") > F.lit(str(LAST_VERTEX)).cast("decimal(38,0)")
    vertex = lambda k: F.get(t, F.lit(k)).rlike(VERTEX) & ~F.coalesce(over(k), F.lit(True))
    fault = (
        F.when(F.size("tokens") != 3, F.concat(F.lit("expected 'i j d', got "), F.size("tokens").cast("string"), F.lit(" fields")))
        .when(~vertex(0), F.concat(F.lit("not a vertex index: \""), F.get(t, F.lit(0)), F.lit("\"")))
        .when(~vertex(1), F.concat(F.lit("not a vertex index: \""), F.get(t, F.lit(1)), F.lit("\"")))
        .when(huge(0) | huge(1), F.lit("vertex index out of range"))
        .when(~F.get(t, F.lit(2)).rlike(NUMBER), F.concat(F.lit("not a number: \""), F.get(t, F.lit(2)), F.lit("\"")))
    )
    bad = rows.select("no", fault.alias("fault")).where("fault is not null").orderBy("no").limit(1).collect()
    if bad:
        raise InvalidInput(f"{path}:{bad[0].no}: {bad[0].fault}")
    edges = rows.select(F.lit(ALONE).cast("long").alias("group_id"), F.get(t, F.lit(0)).try_cast("long").alias("i"), F.get(t, F.lit(1)).try_cast("long").alias("j"), _number(F.get(t, F.lit(2))).alias("d"))
    n = edges.agg(F.coalesce(F.max(F.greatest("i", "j")) + 1, F.lit(0))).first()[0]
    return from_edge_frame(spark.range(n).select(F.lit(ALONE).cast("long").alias("group_id"), "id"), edges)


def read_space(spark: SparkSession, path: str, form: str | None = None) -> MetricSpace:
    return {"point-cloud": read_point_cloud, "lower-distance": read_lower_distances, "sparse": read_sparse}[form or infer_format(path)](spark, path)
