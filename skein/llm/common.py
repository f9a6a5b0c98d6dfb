"""Helpers shared by the corpus operators: shared storage, Arrow batches, sized lookups."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.storage import cut, discard, filesystem, fresh

#: Rows and bytes of one Arrow batch sent to Python. Documents reach 100 KB and more, so the default of
#: 10,000 rows a batch could be a gigabyte.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: A lookup table is broadcast up to this many rows; beyond it the lookup is a salted shuffle join over SALTS salts.
BROADCAST_ROWS, SALTS = 50_000, 1024

__all__ = ["cut", "discard", "filesystem"]  # of the storage that all of the library shares, for the operators

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that the next Python stages of this session get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder."""
    return fresh(spark, name)


def free(columns: Iterable[str], name: str) -> str:
    """The name, or it with underscores after it, such that it is none of the columns."""
    columns = {c.lower() for c in columns}
    while name.lower() in columns:
        name += "_"
    return name


def schema_with(df: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    """df's columns, without those that bear the names of further ones, and the further ones."""
    names = {name.lower() for name, _ in more}
    return T.StructType([*(f for f in df.schema.fields if f.name.lower() not in names), *(T.StructField(n, t) for n, t in more)])


def hand_back() -> None:
    """Gives memory that this process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def lean(run):
    """run, a function of an Arrow stage, such that a worker hands the memory it no longer uses back when a task ends:
    workers outlive their tasks, and stages after this one would run beside what it left."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return whole


def map_rows(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any names, ticks and dots included."""
    names = df.columns
    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(lean(lambda batches: run(b.rename_columns(names) for b in batches)), schema)


def few(df: DataFrame) -> bool:
    """Whether df has few enough rows to be broadcast, by count."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def publish(uri: str, data: bytes | Iterable[bytes]) -> None:
    """Write a file under a temporary name and move it into place, so that a task that is lost or run twice
    leaves either nothing or the whole file."""
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(temporary) as out:
        for piece in [data] if isinstance(data, (bytes, bytearray, memoryview)) else data:
            out.write(piece)
    store.move(temporary, path)


def read_file(uri: str) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        return f.read()


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII texts take Spark's byte-wise lower."""
    ascii_only = (F.octet_length(text) == F.char_length(text)) & F.is_valid_utf8(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; remainder 2 is held out. A null id is in no held-out fold (-1)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(-1))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty, without decoding."""
    return [x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The strings of a column, null as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def batches(rows: Iterator[pa.RecordBatch], schema: pa.Schema, f) -> Iterator[pa.RecordBatch]:
    """f gives a batch's output columns; empty batches pass as empty ones."""
    for batch in rows:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(f(batch), schema.types, strict=True)], schema=schema)


def lookup(rows: DataFrame, found: DataFrame, key: str | list[str], salt: Column | None = None) -> DataFrame:
    """rows left-joined with `found` (at most one row a key). A small `found`, by count, is broadcast. A larger
    one is dealt in two steps, first to each (salt, key) that occurs and then to the rows, so that a key with a
    third of all rows is spread over the salts. The salt is an expression of a row alone, so that both readings of
    the rows give it alike; by default a hash of all their plain columns. Rows with a null in the key stay, with nulls."""
    key = [key] if isinstance(key, str) else key
    if few(found):
        return rows.join(F.broadcast(found), key, "left")
    if salt is None:
        salt = F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t]), F.lit(SALTS))
    name, one = free(rows.columns + found.columns, "_salt"), free(rows.columns + found.columns, "_one")
    salted = rows.withColumn(name, salt)
    whole = salted.select(name, *key).where(" and ".join(f"`{c}` is not null" for c in key))
    per_salt = whole.groupBy(name, *key).agg(F.lit(1).alias(one)).join(found, key, "left").drop(one)
    return salted.join(per_salt, [name, *key], "left").drop(name)
