"""Writing a table's Parquet files and reading them back, merged."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.operators.merge import Layer, MergeOperator, merge_layers, newest_rows
from keelstone.session import list_files
from keelstone.sources.bucketed import bucket_in_name, buckets_kept, is_placed, read_bucketed, write_bucketed
from keelstone.sources.log import UNPARTITIONED, DataFile, Meta, Snapshot
from keelstone.sources.schema import align, check_rows, file_schema

_NULL_DIRECTORY = "__HIVE_DEFAULT_PARTITION__"
#: A bucket is read by one task only while its files hold at most so many bytes (``spark.keelstone.bucket.scan.max.bytes``).
BUCKET_SCAN_BYTES = 4 << 30
#: Spark's own limit on buckets.
MOST_BUCKETS = 100_000


def range_key(values: dict) -> str:
    """``k=v,k2=v2`` in order of name; nulls by the directory name that stands for them."""
    return ",".join(f"{k}={_NULL_DIRECTORY if v is None else v}" for k, v in sorted(values.items())) or UNPARTITIONED


def output_columns(meta: Meta) -> list[str]:
    """Data columns, then range columns."""
    names = meta.struct.names
    return [n for n in names if n not in meta.range_columns] + list(meta.range_columns)


def bucket_of(keys: Sequence[str], buckets: int, schema: T.StructType | None = None):
    return F.pmod(F.hash(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets))


def write_files(
    df: DataFrame, meta: Meta, table_path: str, *, base: bool = False, checked: bool = True, unique: bool = False
) -> list[DataFile]:
    """Write rows as files of the table; they count only once a commit names them.

    Keyed tables: one shuffle by (range, bucket) serves three ends: the last row of a key wins, each (range, bucket)
    becomes one file, and files are sorted by key.  Rows that already lie one partition per bucket are not shuffled.
    Other tables are rebalanced by range, so that neither tiny nor huge files come out.
    """
    spark, schema = df.sparkSession, meta.struct
    rows = align(df, schema)
    if checked:
        rows = check_rows(rows, schema)
    columns = rows.columns
    directories = [f"__r_{i}" for i in range(len(meta.range_columns))]
    if meta.keyed and not unique:
        rows = rows.withColumn("__at", F.monotonically_increasing_id())
    rows = rows.withColumns({d: F.col(f"`{c}`").cast("string") for d, c in zip(directories, meta.range_columns)} or {})
    folder = f"{table_path}/data/{uuid.uuid4().hex}"
    compression = spark.conf.get("spark.keelstone.compression", "snappy")
    if meta.keyed:
        with buckets_kept(spark):
            if not (unique and is_placed(rows, meta.bucket_num)):
                layout = [*directories, "__bucket"]
                rows = rows.withColumn("__bucket", bucket_of(meta.hash_columns, meta.bucket_num)).repartition(*layout)
                if not unique:
                    last = Window.partitionBy(*layout, *[f"`{k}`" for k in meta.hash_columns]).orderBy(F.desc("__at"))
                    rows = rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__at")
                rows = rows.drop("__bucket")
            write_bucketed(rows, folder, directories, meta.hash_columns, meta.bucket_num, compression)
    else:
        sort_by = meta.properties.get("keelstone.sortBy")
        if directories:
            rows = rows.hint("rebalance", *[F.col(d) for d in directories])
        if sort_by:
            rows = rows.sortWithinPartitions(*directories, f"`{sort_by}`")
        writer = rows.write.option("compression", compression)
        (writer.partitionBy(*directories) if directories else writer).parquet(folder)
    files = []
    for path, size, _ in list_files(spark, folder):
        values = dict(part.split("=", 1) for part in path.split("/")[:-1])
        own = {
            c: None if values[d] == _NULL_DIRECTORY else unquote(values[d]) for d, c in zip(directories, meta.range_columns)
        }
        bucket = bucket_in_name(path) if meta.keyed else -1
        files.append(DataFile(f"{folder[len(table_path) + 1:]}/{path}", range_key(own), own, bucket, size, tuple(columns), 0, base))
    return files


# reading ---------------------------------------------------------------------------------------------------------------


def _token(path: str) -> str:
    return path.split("/")[1]


def in_buckets(spark: SparkSession, meta: Meta, files: Sequence[DataFile]) -> bool:
    """Whether a scan of these files may take one task per bucket: all files lie in buckets, and none holds too much."""
    if not meta.keyed or not meta.bucket_num <= MOST_BUCKETS or any(f.bucket < 0 for f in files):
        return False
    sizes: dict[int, int] = {}
    for f in files:
        sizes[f.bucket] = sizes.get(f.bucket, 0) + f.size
    return max(sizes.values(), default=0) <= int(spark.conf.get("spark.keelstone.bucket.scan.max.bytes", str(BUCKET_SCAN_BYTES)))


def read_group(
    spark: SparkSession, meta: Meta, table_path: str, files: Sequence[DataFile], ordered: bool, bucketed: bool = False
) -> DataFrame:
    """Files of one set of columns in one scan; missing columns are null, ``_order`` is added on request.

    The version of a row is told by the folder of its file, which a commit's files share.
    """
    schema = meta.struct
    stored = file_schema(schema, files[0].columns)
    paths = [f"{table_path}/{_escaped(f.path)}" for f in files]
    rows = read_bucketed(spark, paths, stored, meta.hash_columns, meta.bucket_num) if bucketed else None
    if rows is None:
        rows = spark.read.schema(stored).parquet(*paths)
    picked = []
    for name in output_columns(meta):
        kind = next(f.dataType for f in schema.fields if f.name == name)
        picked.append(F.col(f"`{name}`") if name in stored.names else F.lit(None).cast(kind).alias(name))
    if ordered:
        orders = {_token(f.path): f.order for f in files}
        if len(set(orders.values())) == 1:
            version = F.lit(next(iter(orders.values()))).cast("long")
        else:
            folder = F.regexp_extract("_metadata.file_path", r"/data/([0-9a-f]{32})/", 1)
            version = F.create_map(*[F.lit(x) for pair in orders.items() for x in pair])[folder].cast("long")
        picked.append(version.alias("_order"))
    return rows.select(*picked)


def _escaped(path: str) -> str:
    """Paths are given to Spark as patterns: signs that mean something in a pattern are escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _by_columns(files: Iterable[DataFile]) -> list[list[DataFile]]:
    groups: dict[frozenset, list[DataFile]] = {}
    for f in files:
        groups.setdefault(frozenset(f.columns), []).append(f)
    return list(groups.values())


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def scan_kind(meta: Meta, files: Sequence[DataFile]) -> str:
    """Which read serves these files: ``plain`` (nothing to merge), ``newest`` (whole-row deltas) or ``columns``."""
    if not meta.keyed:
        return "plain"
    orders: dict[tuple, set] = {}
    for f in files:
        orders.setdefault((f.range_key, f.bucket), set()).add(f.order)
    if all(len(o) == 1 for o in orders.values()):
        return "plain"
    return "newest" if len({frozenset(f.columns) for f in files}) == 1 else "columns"


def scan(
    spark: SparkSession, meta: Meta, table_path: str, files: Sequence[DataFile], operators: dict[str, MergeOperator] | None = None
) -> DataFrame:
    """The rows of ``files``, versions of a key merged.

    Buckets with a single version are read as they are, however many others have deltas; only buckets with several
    versions are merged.  All versions of a key lie in the same bucket, so the merge works inside buckets, without a
    shuffle, and its rows are still partitioned by the hash of the keys.

    Of tables without range columns, and wherever the deltas are small enough to be broadcast, the oldest version is
    joined against and not aggregated.  Buckets too large for a task (see :func:`in_buckets`) are read in splits and
    merged by a shuffle.
    """
    columns = output_columns(meta)
    if not files:
        empty = T.StructType([next(f for f in meta.struct.fields if f.name == c) for c in columns])
        return spark.createDataFrame([], empty)
    operators = operators or {}
    orders: dict[tuple, set] = {}
    for f in files:
        orders.setdefault((f.range_key, f.bucket), set()).add(f.order)
    alone = [f for f in files if not meta.keyed or (len(orders[f.range_key, f.bucket]) == 1 and not operators)]
    mixed = [f for f in files if meta.keyed and not (len(orders[f.range_key, f.bucket]) == 1 and not operators)]
    bucketed = in_buckets(spark, meta, files)
    parts = [read_group(spark, meta, table_path, g, False, bucketed) for g in _by_columns(alone)]
    if mixed:
        keys = [*meta.range_columns, *meta.hash_columns]
        oldest = [f for f in mixed if f.order == min(orders[f.range_key, f.bucket])]
        newer = [f for f in mixed if f.order != min(orders[f.range_key, f.bucket])]
        whole_rows = not operators and scan_kind(meta, mixed) == "newest" and set(mixed[0].columns) >= set(columns)
        # a join on range and hash columns would be shuffled by both; an aggregate is content with the buckets
        joins = not meta.range_columns or not bucketed or sum(f.size for f in newer) <= _broadcast_limit(spark)
        if whole_rows and joins:
            base = read_group(spark, meta, table_path, oldest, False, bucketed)
            parts.append(newest_rows(base, read_group(spark, meta, table_path, newer, True, bucketed), keys, columns))
        else:
            layers = [Layer(read_group(spark, meta, table_path, g, True, bucketed), frozenset(g[0].columns)) for g in _by_columns(mixed)]
            parts.append(merge_layers(layers, keys, columns, operators))
    return _union(parts)


def _broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which Spark broadcasts a side of a join by itself; 0 if it never does."""
    text = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return max(0, int(text))



def prune_ranges(spark: SparkSession, snapshot: Snapshot, condition: str) -> set[str] | None:
    """The range keys whose values can satisfy ``condition``; None if it is not about range columns alone.

    The condition is evaluated by Spark over one row per partition.
    """
    from pyspark.errors import AnalysisException

    meta = snapshot.meta
    if not meta.range_columns:
        return None
    values = {f.range_key: f.range_values for f in snapshot.files.values()}
    fields = [T.StructField("_key", T.StringType()), *[T.StructField(c, T.StringType()) for c in meta.range_columns]]
    rows = [(k, *[v[c] for c in meta.range_columns]) for k, v in values.items()]
    typed = spark.createDataFrame(rows, T.StructType(fields)).select(
        "_key", *[F.col(f"`{c}`").cast(meta.struct[c].dataType).alias(c) for c in meta.range_columns]
    )
    try:
        return {r["_key"] for r in typed.where(condition).select("_key").collect()}
    except AnalysisException:
        return None


def expired_on_disk(spark: SparkSession, snapshot: Snapshot, table_path: str, retention_ms: int) -> list[str]:
    """Files below the table that no longer (or never) count and are older than the retention."""
    now = int(time.time() * 1000)
    old = []
    for path, _, modified in list_files(spark, table_path, ""):
        kept = path in snapshot.files or path.startswith("_log/")
        if not kept and now - max(modified, snapshot.expired.get(path, 0)) >= retention_ms:
            old.append(path)
    return old
