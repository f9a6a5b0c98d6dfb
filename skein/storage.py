"""The folder that driver and all executors share: tables that cut lineage, and files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of Spark 4.1: whether a command's shuffle files are deleted at its end. Else they stay on disk until the driver happens to
#: collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_temporary: dict[str, str] = {}
_roots: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir or, where it is unset, in local runs, a temporary folder of this machine, which is deleted
    when Python ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if spark.sparkContext.applicationId not in _temporary:
            local = tempfile.mkdtemp(prefix="skein-")
            atexit.register(shutil.rmtree, local, True)
            _temporary[spark.sparkContext.applicationId] = "file://" + local
        folder = _temporary[spark.sparkContext.applicationId]
    return folder.rstrip("/")


def _folder(spark: SparkSession, path: str):
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), name


def fresh(spark: SparkSession, name: str = "table") -> str:
    """A fresh folder name in this application's part of the shared folder, which is deleted when the application ends."""
    key = spark.sparkContext.applicationId, shared_folder(spark)
    if key not in _roots:
        _roots[key] = f"{key[1]}/skein-{key[0]}-{uuid.uuid4().hex[:8]}"
        store, path = _folder(spark, _roots[key])
        store.mkdirs(path)
        store.deleteOnExit(path)
    return f"{_roots[key]}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """df computed once, written as a table to the shared folder and read back: free of its lineage, safe against lost
    executors. A written table has the size it has; a checkpoint would keep the estimates of the plan before it, which
    grow without bound from round to round. The shuffle files that it took are deleted."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.skein_folder = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table that cut() wrote and that nothing reads any more."""
    store, path = _folder(df.sparkSession, df.skein_folder)
    store.delete(path, True)


def part_of_group() -> Column:
    """The number that a group's rows are filed under."""
    return F.xxhash64("group_id")


def stored_by_group(df: DataFrame) -> str:
    """The folder of a table whose rows are filed by group, for tasks that read one group's rows by themselves."""
    path = fresh(df.sparkSession)
    df.withColumn("_part", part_of_group()).write.partitionBy("_part").parquet(path)
    return path


def filesystem(uri: str):
    """The pyarrow file system of a URI (file, hdfs, s3, gs) and the path in it; works on executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
