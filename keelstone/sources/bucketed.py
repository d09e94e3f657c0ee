"""Bucketed Parquet files without a catalog table.

Spark's writer and scan know buckets (``BucketSpec``), but the public API reaches them through catalog tables only, and a
catalog table is a whole folder, while a snapshot of ours is a list of files.  So the same data source that ``save`` and
``load`` build is built here with a bucket specification: files are named, split and sorted by Spark's own writer, and the
scan reports that its rows are partitioned by the hash of the keys.  Joins and aggregates on the keys then need no shuffle.
Where the planner has no use for buckets it reads the files as plain splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_BUCKET = re.compile(r"_(\d+)(?:\..*)?$")


def bucket_in_name(path: str) -> int:
    """The bucket that Spark's writer put into a file's name; -1 if none."""
    found = _BUCKET.search(path.rsplit("/", 1)[-1])
    return int(found[1]) if found else -1


def _source(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None, partitions: Sequence[str], keys: Sequence[str], buckets: int, options: dict):
    jvm = spark.sparkContext._jvm
    seq, option = jvm.PythonUtils.toSeq, jvm.scala.Option
    spec = jvm.org.apache.spark.sql.catalyst.catalog.BucketSpec(buckets, seq(list(keys)), seq(list(keys)))
    known = option.apply(jvm.org.apache.spark.sql.types.DataType.fromJson(schema.json())) if schema is not None else option.empty()
    return jvm.org.apache.spark.sql.execution.datasources.DataSource(
        spark._jsparkSession, "parquet", seq(list(paths)), known, seq(list(partitions)), option.apply(spec),
        jvm.PythonUtils.toScalaMap(options), option.empty(),
    )


def write_bucketed(rows: DataFrame, folder: str, partitions: Sequence[str], keys: Sequence[str], buckets: int, compression: str) -> None:
    """Write rows below ``folder`` by partition columns and bucket, each file sorted by key."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    source = _source(spark, [], None, partitions, keys, buckets, {"path": folder, "compression": compression})
    command = source.planForWriting(jvm.org.apache.spark.sql.SaveMode.ErrorIfExists, rows._jdf.queryExecution().analyzed())
    jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, command)


def read_bucketed(spark: SparkSession, paths: Sequence[str], schema: T.StructType, keys: Sequence[str], buckets: int) -> DataFrame | None:
    """The rows of bucketed files as one relation that knows its buckets; None where this Spark has no such way in.

    ``keys`` hold no nulls, and the relation says so.  Spark would otherwise filter nulls out of them below a union of
    such relations, after which it no longer sees that the sides are partitioned alike.
    """
    strict = T.StructType([T.StructField(f.name, f.dataType, f.name not in keys, f.metadata) for f in schema.fields])
    try:
        r = _source(spark, paths, schema, [], keys, buckets, {}).resolveRelation(True, True)
        known = spark.sparkContext._jvm.org.apache.spark.sql.types.DataType.fromJson(strict.json())
        relation = r.copy(r.location(), r.partitionSchema(), known, r.bucketSpec(), r.fileFormat(), r.options(), spark._jsparkSession)
    except Py4JError as e:
        if "does not exist" not in str(e):
            raise
        return None
    return DataFrame(spark._jsparkSession.baseRelationToDataFrame(relation), spark)


@contextmanager
def buckets_kept(spark: SparkSession) -> Iterator[None]:
    """Scans that are planned in this block read one task per bucket even where nothing above them asks for it."""
    name = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def is_placed(rows: DataFrame, buckets: int) -> bool:
    """True if the plan of these rows ends in one partition per bucket."""
    plan = rows._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    placed = plan.outputPartitioning()
    return placed.toString().startswith("hashpartitioning(") and placed.numPartitions() == buckets
