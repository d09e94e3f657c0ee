"""Session helpers: the shared scratch folder and lineage cuts.

Everything that must survive the loss of an executor is written below the folder that the cluster names in
``spark.checkpoint.dir``.  Only where that setting is absent (single-machine tests) is a local folder used.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []
_TO_DROP: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of a folder for intermediate data that driver and executors share; created on first use.

    A cluster must name it: a folder of one machine would lose the rows that the executors of other machines write.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="keelstone-"))
        atexit.register(_remove_local_root)
    return "file://" + _LOCAL_ROOT[0]


def warehouse(spark: SparkSession) -> str:
    """URI of the lasting folder of tables without a location and of their names; never below the intermediate data."""
    chosen = spark.conf.get("spark.keelstone.warehouse", None) or spark.conf.get("spark.sql.warehouse.dir")
    return qualified(chosen).rstrip("/")


def _remove_local_root() -> None:
    import shutil

    for path in _LOCAL_ROOT:
        shutil.rmtree(path, ignore_errors=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    if not _TO_DROP:
        atexit.register(_drop_scratch)
    path = f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    _TO_DROP[path] = spark
    return path


def _drop_scratch() -> None:
    for path, spark in list(_TO_DROP.items()):
        try:
            remove_path(spark, path)
        except Exception:  # the session may be gone already; a local root is removed by its own hook
            pass
    _TO_DROP.clear()


def remove_path(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _filesystem(spark, path)
    fs.delete(hadoop_path, True)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def local_path(uri: str) -> str:
    """``file:`` URIs as plain paths; other URIs unchanged."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:"):].lstrip("/")
    return uri


def qualified(path: str) -> str:
    """Plain absolute paths as ``file://`` URIs; URIs unchanged."""
    if "://" in path or path.startswith("file:"):
        return path
    return "file://" + os.path.abspath(path)


def list_files(spark: SparkSession, folder: str, suffix: str = ".parquet") -> list[tuple[str, int, int]]:
    """(path below ``folder``, size, modification time in ms) of every file with the suffix."""
    found = []
    if folder.startswith("file:"):
        root = local_path(folder)
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(suffix) and not name.startswith((".", "_")):
                    stat = os.stat(os.path.join(at, name))
                    found.append((os.path.relpath(os.path.join(at, name), root), stat.st_size, int(stat.st_mtime * 1000)))
        return sorted(found)
    fs, path = _filesystem(spark, folder)
    if not fs.exists(path):
        return []
    prefix = len(fs.makeQualified(path).toString().rstrip("/")) + 1
    files = fs.listFiles(path, True)
    while files.hasNext():
        status = files.next()
        name = status.getPath().getName()
        if name.endswith(suffix) and not name.startswith((".", "_")):
            found.append((status.getPath().toString()[prefix:], status.getLen(), status.getModificationTime()))
    return sorted(found)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes in this block go when the write ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The written table replaces the lineage: later stages, and retries after a lost executor, read the same rows in the
    same files.  ``spark_partition_id()`` or other placement-dependent columns are frozen by it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
