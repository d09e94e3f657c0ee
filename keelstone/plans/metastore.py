"""Queries p1 to p5 over the metadata tables of a keyed lakehouse.

``sf_dir`` holds one Parquet table per name.  Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.functions.metadata import file_name, is_reference, month_of
from keelstone.operators.drift import column_values, path_type_statistics, read_unified, schema_changes, schema_fields
from keelstone.operators.incremental import StateStore
from keelstone.operators.orphans import orphan_references
from keelstone.operators.skew import HEAVY_SHARE, chunked_aggregate, chunked_states, heavy_keys, largest_gap, replicate_for_salt, salt_of
from keelstone.operators.sorted_runs import merge_sorted_files, plan_merges
from keelstone.session import list_files, materialize, scratch_path, shuffles_dropped

NEVER = 9223372036854775807
PARTITION = ["table_id", "range_id"]
#: Least share of a table's rows that makes a value frequent (problem 4), in per cent.
FREQUENT_PER_CENT = 3
#: Rows of a small file and bytes of a merged one in p2_merged, so that the test tables give many files and several ranges.
MERGED_FILE_ROWS = 2_000
MERGED_BYTES = 8_388_608


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per partition with its current version; rows without a complete key are no partitions."""
    rows = table(spark, sf_dir, "partition_info").where("table_id is not null and range_id is not null")
    return rows.groupBy(*PARTITION).agg(F.max("read_version").alias("current_version"))


def _hot_partitions(data_info: DataFrame) -> list[tuple]:
    return heavy_keys(data_info.select(*PARTITION), PARTITION)


def salted_files(data_info: DataFrame, heavy: list[tuple]) -> DataFrame:
    """Each file once, laid out by (table_id, range_id, _salt) so that a join on these needs no second shuffle.

    The smallest expire_version holds, and the size is the one known.  Rows without table, range or path are no files.
    """
    rows = data_info.where("table_id is not null and range_id is not null and file_path is not null")
    rows = rows.select(*PARTITION, file_name(F.col("file_path")).alias("file_name"), "write_version", "expire_version", "size")
    rows = rows.withColumn("_salt", salt_of([F.col(c) for c in PARTITION], [F.col("file_name")], heavy))
    known = F.when(F.col("size") > 0, F.col("size"))
    return (
        rows.repartition(*PARTITION, "_salt")
        .groupBy(*PARTITION, "_salt", "file_name")
        .agg(
            F.min("write_version").alias("write_version"),
            F.min("expire_version").alias("expire_version"),
            F.max(known).alias("size"),
        )
    )


def visible_at(version: str) -> F.Column:
    return (F.col("write_version") <= F.col(version)) & (F.col(version) < F.col("expire_version"))


# 1 ---------------------------------------------------------------------------------------------------------------------


def watched_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, table_id, range_id, version_read, current_version`` of every partition that a query reads."""
    recorded = table(spark, sf_dir, "streaming_info").where("batch_id is not null")
    recorded = recorded.groupBy("query_id").agg(F.max("batch_id").alias("recorded"))
    progress = table(spark, sf_dir, "read_progress").where("query_id is not null and table_id is not null")
    progress = progress.select("query_id", *PARTITION, "batch_id", "attempt", "end_version")
    last = F.max(F.struct("batch_id", "attempt", "end_version"))
    done = F.max("batch_id").alias("_any")
    read = (
        progress.join(recorded, "query_id")
        .where("batch_id <= recorded and range_id is not null")
        .groupBy("query_id", *PARTITION)
        .agg(last.alias("last"), done)
        .select("query_id", *PARTITION, F.col("last.end_version").alias("version_read"))
    )
    partitions = current_versions(spark, sf_dir)
    large = heavy_keys(partitions.select("table_id"), ["table_id"])  # tables with a large share of all partitions
    partitions = partitions.withColumn("_salt", salt_of([F.col("table_id")], [F.col("range_id")], large))
    subscribed = replicate_for_salt(progress.select("query_id", "table_id").distinct(), ["table_id"], large)
    watched = subscribed.join(partitions, ["table_id", "_salt"]).drop("_salt").join(read, ["query_id", *PARTITION], "left")
    return watched.withColumn("version_read", F.coalesce("version_read", F.lit(0)))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that entered or left a partition since the last recorded batch of each query that reads it.

    The files that a query had when its last recorded batch ended are the committed state; the files visible now are
    the current rows; the state operator finds what was added and removed and swaps in the next state.
    """
    data_info = table(spark, sf_dir, "data_info")
    heavy = _hot_partitions(data_info)
    watched = replicate_for_salt(watched_partitions(spark, sf_dir), PARTITION, heavy)
    pairs = salted_files(data_info, heavy).join(watched, [*PARTITION, "_salt"])
    pairs = pairs.where(visible_at("version_read") | visible_at("current_version"))
    pairs = materialize(
        pairs.select(
            "query_id", *PARTITION, "file_name", "write_version",
            visible_at("version_read").alias("had"), visible_at("current_version").alias("has"),
        ),
        "p1-pairs",
    )
    store = StateStore(spark, scratch_path(spark, "p1-state"), ["query_id", *PARTITION, "file_name"])
    store.run(pairs.where("had"), ["write_version"], "recorded", unique=True)
    version = store.run(pairs.where("has"), ["write_version"], "now", unique=True)
    found = store.changes(version).where("_kind in ('added', 'removed')")
    return found.select("query_id", "table_id", "file_name", F.col("_kind").alias("change"))


P1_SQL = """
with files as (
  select table_id, range_id, regexp_extract(file_path, '[^/]*$') as file_name,
         min(write_version) as w, min(expire_version) as e
  from data_info group by all),
parts as (select table_id, range_id, max(read_version) as cur from partition_info group by all),
rec as (select query_id, max(batch_id) as b from streaming_info where batch_id is not null group by 1),
rd as (
  select query_id, table_id, range_id, end_version
  from read_progress join rec using (query_id) where batch_id <= b
  qualify row_number() over (partition by query_id, table_id, range_id order by batch_id desc, attempt desc) = 1),
watched as (
  select s.query_id, p.table_id, p.range_id, coalesce(rd.end_version, 0) as v, cur
  from (select distinct query_id, table_id from read_progress) s join parts p using (table_id)
  left join rd on rd.query_id = s.query_id and rd.table_id = p.table_id and rd.range_id = p.range_id),
x as (
  select query_id, table_id, file_name, (w <= v and v < e) as had, (w <= cur and cur < e) as has
  from watched join files using (table_id, range_id))
select query_id, table_id, file_name, case when has then 'added' else 'removed' end as change from x where had <> has
"""


# 2 ---------------------------------------------------------------------------------------------------------------------


def merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consolidation plan of every partition with too many small files."""
    data_info = table(spark, sf_dir, "data_info")
    heavy = _hot_partitions(data_info)
    versions = replicate_for_salt(current_versions(spark, sf_dir), PARTITION, heavy)
    visible = salted_files(data_info, heavy).join(versions, [*PARTITION, "_salt"]).where(visible_at("current_version"))
    return plan_merges(visible, PARTITION, ["write_version", "file_name"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions for which the consolidation plan has work."""
    return merge_plan(spark, sf_dir).groupBy(*PARTITION).agg(F.sum("files").alias("files")).select(*PARTITION)


P2_SQL = """
with files as (
  select table_id, range_id, regexp_extract(file_path, '[^/]*$') as file_name, min(write_version) as w,
         min(expire_version) as e, max(size) filter (where size > 0) as size
  from data_info group by all),
parts as (select table_id, range_id, max(read_version) as cur from partition_info group by all)
select table_id, range_id from files join parts using (table_id, range_id)
where w <= cur and cur < e and size > 0 and size < 16777216
group by table_id, range_id having count(*) >= 8
"""


def p2_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outputs of the consolidation plan with the versions they cover; delta_file_num and be_compacted are not planned."""
    plan = merge_plan(spark, sf_dir)
    return plan.select(
        *PARTITION, "output_no", "files", "bytes",
        F.col("first_run.write_version").alias("from_version"), F.col("last_run.write_version").alias("to_version"),
    )


P2_PLAN_SQL = """
with files as (
  select table_id, range_id, regexp_extract(file_path, '[^/]*$') as file_name, min(write_version) as w,
         min(expire_version) as e, max(size) filter (where size > 0) as size
  from data_info group by all),
parts as (select table_id, range_id, max(read_version) as cur from partition_info group by all),
small as (
  select table_id, range_id, file_name, w, size, count(*) over (partition by table_id, range_id) as n,
         sum(size) over (partition by table_id, range_id order by w, file_name) - size as before
  from files join parts using (table_id, range_id)
  where w <= cur and cur < e and size > 0 and size < 16777216)
select table_id, range_id, cast(before // 134217728 as bigint) as output_no, count(*) as files,
       cast(sum(size) as bigint) as bytes, min(w) as from_version, max(w) as to_version
from small where n >= 8 group by 1, 2, 3
"""


def p2_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of data_info after they were stored as many small sorted files and merged into few.

    The small files are laid out by name, as a writer of many deltas would leave them; a missing path sorts as empty.
    Each spans the whole key range, and their number grows with the table, beyond what a task merges at once.
    """
    folder, out = scratch_path(spark, "p2-small"), scratch_path(spark, "p2-merged")
    rows = table(spark, sf_dir, "data_info").withColumn("sort_key", F.coalesce("file_path", F.lit("")))
    files = max(64, rows.count() // MERGED_FILE_ROWS)
    small = rows.repartition(files, F.xxhash64("sort_key", "write_version")).sortWithinPartitions("sort_key")
    with shuffles_dropped(spark):
        small.write.option("compression", "zstd").parquet(folder)
    paths = [f"{folder}/{name}" for name, _, _ in list_files(spark, folder)]
    merged = merge_sorted_files(spark, paths, "sort_key", out, MERGED_BYTES)
    kept = [r["path"] for r in merged.select("path").collect()]  # the new files, about one per target_bytes
    columns = ["table_id", "range_id", "file_path", "write_version", "expire_version", "commit_id", "size"]
    return spark.read.schema(rows.schema).parquet(*kept).select(*columns) if kept else rows.select(*columns).limit(0)


P2_MERGED_SQL = "select table_id, range_id, file_path, write_version, expire_version, commit_id, size from data_info"


# 3 ---------------------------------------------------------------------------------------------------------------------


def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``table_id, commit_id, place, table_schema, logged``: every schema version once, table_info's last."""
    undo_log = table(spark, sf_dir, "undo_log")
    succeeded = undo_log.where("commit_type = 'commit' and tag = -1").select("table_id", "commit_id")
    logged = undo_log.where("commit_type = 'schema' and table_schema is not null")
    logged = logged.select("table_id", "commit_id", F.struct("write_version", "table_schema").alias("v"))
    logged = logged.join(succeeded, ["table_id", "commit_id"], "left_semi")
    logged = logged.groupBy("table_id", "commit_id").agg(F.min("v").alias("v"))
    logged = logged.select(
        "table_id", "commit_id", F.struct(F.lit(0), "v.write_version", "commit_id").alias("place"),
        F.col("v.table_schema").alias("table_schema"),
    )
    last = table(spark, sf_dir, "table_info").where("table_id is not null and table_schema is not null")
    last = last.groupBy("table_id").agg(F.max(F.struct("read_version", "table_schema")).alias("v"))
    place = F.struct(F.lit(1), F.lit(None).cast("long").alias("write_version"), F.lit("table_info").alias("commit_id"))
    last = last.select("table_id", F.lit("table_info").alias("commit_id"), place.alias("place"), "v.table_schema")
    return logged.unionByName(last)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of fields between consecutive schema versions, and columns of files that no version declares.

    Schema versions and the column lists of files are loaded as path-value maps; their path-type statistics give the
    fields of each version, which are compared, and the paths of each list, which are looked up among the declared ones.
    """
    versions = materialize(schema_versions(spark, sf_dir), "p3-versions")
    fields = materialize(schema_fields(versions, ["table_id", "commit_id"], "table_schema"), "p3-fields")
    changes = schema_changes(versions, "table_id", ["place"], "commit_id", "table_schema", skip_unreadable=True, fields=fields)

    tracked = versions.where("commit_id <> 'table_info'").select("table_id").distinct()
    declared = fields.where("parent = ''").select("table_id", F.lower("name").alias("path")).distinct()
    files = table(spark, sf_dir, "data_info").select("table_id", "commit_id", "file_exist_cols")
    files = files.where("table_id is not null and commit_id is not null and file_exist_cols is not null")
    listed = ["table_id", "file_exist_cols"]
    lists = materialize(files.groupBy(*listed).agg(F.count(F.lit(1)).alias("n")), "p3-lists")
    maps = lists.join(tracked, "table_id", "left_semi").select(*listed, column_values(F.col("file_exist_cols")).alias("row_values"))
    undeclared = path_type_statistics(maps, listed).join(declared, ["table_id", "path"], "left_anti")
    everything = lists.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    heavy = [tuple(r) for r in lists.where(F.col("n") >= everything * HEAVY_SHARE).orderBy(F.desc("n")).limit(int(1 / HEAVY_SHARE)).select(*listed).collect()]
    files = files.withColumn("_salt", salt_of([F.col(c) for c in listed], [F.col("commit_id")], heavy))
    names = replicate_for_salt(undeclared.select(*listed, "path"), listed, heavy)
    undeclared = files.join(names, [*listed, "_salt"])
    undeclared = undeclared.select("table_id", "commit_id", F.lit("undeclared").alias("change"), F.col("path").alias("field_name")).distinct()
    return changes.unionByName(undeclared)


def p3_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of p3_found that SQL can state: columns of files that no version of their table declares."""
    return p3_found(spark, sf_dir).where("change = 'undeclared'").drop("change")


P3_UNDECLARED_SQL = """
with v as (
  select table_id, table_schema from undo_log u where commit_type = 'schema' and table_schema is not null and exists (
    select 1 from undo_log c where c.commit_type = 'commit' and c.tag = -1 and c.table_id = u.table_id and c.commit_id = u.commit_id)),
every as (select * from v union all select table_id, table_schema from table_info where table_id in (select table_id from v)),
names as (select distinct table_id, lower(unnest(json_extract_string(table_schema, '$.fields[*].name'))) as n from every where json_valid(table_schema)),
listed as (
  select distinct table_id, commit_id, lower(trim(unnest(string_split(file_exist_cols, ',')))) as n from data_info
  where commit_id is not null and table_id in (select table_id from v))
select table_id, commit_id, n as field_name from listed l
where n <> '' and not exists (select 1 from names d where d.table_id = l.table_id and d.n = l.n)
"""


def drifted_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """All rows of data_info in four folders, by write_version modulo 4, whose schemas differ as by several writers.

    0 as stored; 1 names in capitals, a wider ``part``, sizes as text, implausible ones with their unit; 2 without
    is_base_file; 3 commit_id under a new name, modification_time as text and a further column.
    """
    rows = table(spark, sf_dir, "data_info").withColumn("part", F.pmod(F.coalesce("write_version", F.lit(0)), F.lit(4)).cast("int"))
    size = F.when(F.col("size") > 0, F.col("size").cast("string")).otherwise(F.concat(F.col("size").cast("string"), F.lit(" bytes")))
    wide = rows.withColumn("part", F.col("part").cast("long")).withColumn("size", size)
    writers = [
        rows,
        wide.toDF(*[c.upper() for c in wide.columns]),
        rows.drop("is_base_file"),
        rows.withColumnRenamed("commit_id", "commit_ref").withColumn("modification_time", F.col("modification_time").cast("string")).withColumn("writer", F.lit("late")),
    ]
    folder = scratch_path(spark, "p3-drifted")
    for i, written in enumerate(writers):
        written.where(F.col("part") == i).write.parquet(f"{folder}/{i}")
    return [f"{folder}/{i}" for i in range(len(writers))]


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of data_info, stored as files of drifting schemas, as one typed table with the casts that failed."""
    unified = read_unified(spark, drifted_files(spark, sf_dir), {"size": "long", "modification_time": "long"}, follow_renames=True)
    failed = F.array_join(F.transform("failed_casts", lambda c: F.concat_ws(":", c["path"], c["type"], c["value"])), ";")
    return unified.select(
        "table_id", "range_id", "file_path", "write_version", "expire_version", F.col("commit_ref").alias("commit_id"), "size",
        "modification_time", "file_exist_cols", "is_base_file", "part", "writer", F.to_json("hash_value").alias("hash_value"), failed.alias("failed"),
    )


P3_UNIFIED_SQL = """
with x as (select *, coalesce(write_version, 0) % 4 as part from data_info)
select table_id, range_id, file_path, write_version, expire_version, commit_id,
       case when part <> 1 or size > 0 then size end as size, modification_time, file_exist_cols,
       case when part <> 2 then is_base_file end as is_base_file, part, case when part = 3 then 'late' end as writer,
       cast(to_json(hash_value) as varchar) as hash_value,
       case when part = 1 and size <= 0 then 'size:string:' || size || ' bytes' else '' end as failed
from x
"""


# 4 ---------------------------------------------------------------------------------------------------------------------


def range_results(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """``key, rows, chunks, bytes, newest_version`` per value of ``key``, complete and in equal-sized chunks.

    The input partition of a row is its file block; its position there is the row's number in the file.
    """
    rows = table(spark, sf_dir, name)
    if "size" in rows.columns:
        known = F.when(F.col("size") > 0, F.col("size"))
        states = {"bytes": F.sum(known), "newest_version": F.max("write_version")}
    else:
        states = {"bytes": F.sum(F.lit(None).cast("long")), "newest_version": F.max("read_version")}
    merges = {"bytes": F.sum("bytes"), "newest_version": F.max("newest_version")}
    return _chunked(rows, key, states, merges)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that hold at least 3 per cent of all rows of their table."""
    found = []
    for name, key in (("data_info", "range_id"), ("partition_info", "range_value")):
        total = table(spark, sf_dir, name).count()
        results = range_results(spark, sf_dir, name, key)
        frequent = results.where(F.col(key).isNotNull() & (F.col("rows") * 100 >= total * FREQUENT_PER_CENT))
        found.append(frequent.select(F.lit(f"{name}.{key}").alias("field"), F.col(key).alias("key_value")))
    return found[0].unionByName(found[1])


P4_SQL = """
select 'data_info.range_id' as field, range_id as key_value from data_info where range_id is not null
group by range_id having count(*) * 100 >= 3 * (select count(*) from data_info)
union all
select 'partition_info.range_value', range_value from partition_info where range_value is not null
group by range_value having count(*) * 100 >= 3 * (select count(*) from partition_info)
"""


def p4_range_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows, bytes over all listings and newest version of every range_id; files: :func:`p4_range_files`."""
    return range_results(spark, sf_dir, "data_info", "range_id").select("range_id", "rows", "bytes", "newest_version")


P4_RANGES_SQL = """
select range_id, count(*) as rows, cast(sum(size) filter (where size > 0) as bigint) as bytes,
       max(write_version) as newest_version from data_info group by range_id
"""


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``table_id, range_id, file_name, size, write_version``: each file once with its known size, however often listed.

    The file name is part of the key, so a hot range is spread over tasks.  Files without table or range count too.
    """
    rows = table(spark, sf_dir, "data_info").where("file_path is not null")
    rows = rows.select(*PARTITION, file_name(F.col("file_path")).alias("file_name"), "size", "write_version")
    known = F.when(F.col("size") > 0, F.col("size"))
    once = rows.groupBy(*PARTITION, "file_name").agg(F.max(known).alias("size"), F.max("write_version").alias("write_version"))
    return materialize(once, "p4-files")


def _chunked(stored: DataFrame, key: str, states: dict[str, F.Column], merges: dict[str, F.Column]) -> DataFrame:
    """Results per key over a written table, in equal-sized chunks; see :func:`range_results`."""
    part = F.xxhash64("_metadata.file_path", "_metadata.file_block_start")
    return chunked_aggregate(stored, key, part, F.col("_metadata.row_index"), states, merges)


def p4_range_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, bytes and newest version of every range_id, each file once."""
    states = {"bytes": F.sum("size"), "newest_version": F.max("write_version")}
    merges = {"bytes": F.sum("bytes"), "newest_version": F.max("newest_version")}
    results = _chunked(listed_files(spark, sf_dir), "range_id", states, merges)
    return results.select("range_id", F.col("rows").alias("files"), "bytes", "newest_version")


_FILES_CTE = """
files as (
  select table_id, range_id, regexp_extract(file_path, '[^/]*$') as file_name,
         max(size) filter (where size > 0) as size, max(write_version) as w
  from data_info where file_path is not null group by 1, 2, 3)"""
P4_RANGE_FILES_SQL = f"""
with {_FILES_CTE}
select range_id, count(*) as files, cast(sum(size) as bigint) as bytes, max(w) as newest_version from files group by range_id
"""


def p4_range_value_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, bytes and newest version of every range_value: those of its partitions, 0 files if they have none.

    Files are first summed per partition (partial sums, so no task sees a hot partition); the hot values are then
    aggregated over partitions in chunks.
    """
    per_partition = listed_files(spark, sf_dir).groupBy(*PARTITION).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("write_version").alias("newest_version")
    )
    partitions = table(spark, sf_dir, "partition_info").select(*PARTITION, "range_value").distinct()
    stored = materialize(partitions.join(per_partition, PARTITION, "left"), "p4-partitions")
    merges = {"files": F.sum("files"), "bytes": F.sum("bytes"), "newest_version": F.max("newest_version")}
    results = _chunked(stored, "range_value", merges, merges)
    return results.select("range_value", F.coalesce("files", F.lit(0)).alias("files"), "bytes", "newest_version")


P4_RANGE_VALUE_FILES_SQL = f"""
with {_FILES_CTE},
per_partition as (
  select table_id, range_id, count(*) as files, sum(size) as bytes, max(w) as newest_version from files group by 1, 2)
select range_value, cast(coalesce(sum(files), 0) as bigint) as files, cast(sum(bytes) as bigint) as bytes,
       max(newest_version) as newest_version
from (select distinct table_id, range_id, range_value from partition_info) left join per_partition using (table_id, range_id)
group by range_value
"""


#: Rows of a chunk in p4_chunks and p4_version_gaps, so that keys of the test tables have several.
CHUNK_ROWS = 256


def p4_chunks(spark: SparkSession, sf_dir: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The equal-sized chunks into which the rows of every range_id are cut."""
    rows = table(spark, sf_dir, "data_info")
    part = F.xxhash64("_metadata.file_path", "_metadata.file_block_start")
    chunks = chunked_states(rows, "range_id", part, F.col("_metadata.row_index"), {}, chunk_rows)
    return chunks.select("range_id", "chunk", "chunk_first", "chunk_size")


P4_CHUNKS_SQL = f"""
with n as (select range_id, count(*) as n from data_info group by 1),
x as (select range_id, n, unnest(range((n + {CHUNK_ROWS - 1}) // {CHUNK_ROWS})) as chunk from n)
select range_id, chunk, chunk * {CHUNK_ROWS} as chunk_first, least({CHUNK_ROWS}, n - chunk * {CHUNK_ROWS}) as chunk_size from x
"""


def p4_version_gaps(spark: SparkSession, sf_dir: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per range_id the largest step between consecutive write_versions: a result that depends on the order of the chunks."""
    gaps = largest_gap(table(spark, sf_dir, "data_info"), "range_id", "write_version", chunk_rows)
    return gaps.select("range_id", "rows", F.col("first").alias("first_version"), F.col("last").alias("last_version"), "gap")


P4_GAPS_SQL = """
with x as (
  select range_id, write_version as v, write_version - lag(write_version) over (partition by range_id order by write_version) as step
  from data_info where write_version is not null)
select range_id, count(*) as rows, min(v) as first_version, max(v) as last_version, max(step) as gap from x group by 1
"""


# 5 ---------------------------------------------------------------------------------------------------------------------


def orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field, table_id, ref_value, period, n`` of every reference that leads nowhere, per month."""
    table_info = table(spark, sf_dir, "table_info").where(is_reference(F.col("table_id"))).select("table_id").distinct()
    partition_info = table(spark, sf_dir, "partition_info")
    partitions = partition_info.select(*PARTITION).distinct()
    data_info = table(spark, sf_dir, "data_info").where(is_reference(F.col("table_id")))
    undo_log = table(spark, sf_dir, "undo_log")

    def named(field: str, orphans: DataFrame, value: str) -> DataFrame:
        return orphans.select(F.lit(field).alias("field"), "table_id", F.col(value).alias("ref_value"), "period", "n")

    written = month_of(F.col("modification_time"))
    tables = orphan_references(data_info, ["table_id"], written, table_info)
    ranges = orphan_references(data_info.where(is_reference(F.col("range_id"))), PARTITION, written, partitions)
    entries = undo_log.where("commit_type not in ('commit', 'dropTable', 'dropPartition')")
    entries = entries.where(is_reference(F.col("commit_id")))
    known = undo_log.where("commit_type = 'commit'").select("table_id", "commit_id").distinct()
    commits = orphan_references(entries, ["table_id", "commit_id"], month_of(F.col("timestamp")), known)
    started = partition_info.where(is_reference(F.col("range_id"))).groupBy(*PARTITION)
    started = started.agg(F.max("read_version").alias("v"), F.max("last_update_timestamp").alias("t")).where("v > 0")
    filled = data_info.where("range_id is not null").select(*PARTITION).distinct()
    empty = orphan_references(started, PARTITION, month_of(F.col("t")), filled)
    return (
        named("data_info.table_id", tables, "table_id")
        .unionByName(named("data_info.range_id", ranges, "range_id"))
        .unionByName(named("undo_log.commit_id", commits, "commit_id"))
        .unionByName(named("partition_info.range_id", empty, "range_id"))
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different reference that leads nowhere."""
    return orphan_counts(spark, sf_dir).select("field", "table_id", "ref_value").distinct()


P5_SQL = """
with d as (select * from data_info where table_id is not null and table_id not in ('', '-5'))
select distinct 'data_info.table_id' as field, table_id, table_id as ref_value from d
where table_id not in (select table_id from table_info where table_id is not null)
union all
select distinct 'data_info.range_id', table_id, range_id from d
where range_id is not null and range_id not in ('', '-5')
  and not exists (select 1 from partition_info p where p.table_id = d.table_id and p.range_id = d.range_id)
union all
select distinct 'undo_log.commit_id', table_id, commit_id from undo_log u
where commit_type not in ('commit', 'dropTable', 'dropPartition')
  and commit_id is not null and commit_id not in ('', '-5')
  and not exists (select 1 from undo_log c where c.commit_type = 'commit' and c.table_id = u.table_id
                  and c.commit_id = u.commit_id)
union all
select 'partition_info.range_id', table_id, range_id from partition_info p
where range_id is not null and range_id not in ('', '-5')
  and not exists (select 1 from data_info x where x.table_id = p.table_id and x.range_id = p.range_id)
group by table_id, range_id having max(read_version) > 0
"""


def p5_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per field, table and month."""
    counts = orphan_counts(spark, sf_dir).groupBy("field", "table_id", "period")
    return counts.agg(F.countDistinct("ref_value").alias("ref_values"), F.sum("n").alias("references"))


def _month_sql(epoch: str) -> str:
    seconds = f"cast(floor(case when {epoch} >= 100000000000 then {epoch} / 1000 else {epoch} end) as bigint)"
    known = f"{epoch} > 0 and {epoch} < 100000000000000"
    return f"case when {known} then strftime(make_timestamp({seconds} * 1000000), '%Y-%m') else 'unknown' end"


P5_MONTHS_SQL = f"""
with d as (select * from data_info where table_id is not null and table_id not in ('', '-5')),
x as (
  select 'data_info.table_id' as field, table_id, table_id as ref_value, {_month_sql('modification_time')} as period from d
  where table_id not in (select table_id from table_info where table_id is not null)
  union all
  select 'data_info.range_id', table_id, range_id, {_month_sql('modification_time')} from d
  where range_id is not null and range_id not in ('', '-5')
    and not exists (select 1 from partition_info p where p.table_id = d.table_id and p.range_id = d.range_id)
  union all
  select 'undo_log.commit_id', table_id, commit_id, {_month_sql('u."timestamp"')} from undo_log u
  where commit_type not in ('commit', 'dropTable', 'dropPartition') and commit_id is not null and commit_id not in ('', '-5')
    and not exists (select 1 from undo_log c where c.commit_type = 'commit' and c.table_id = u.table_id
                    and c.commit_id = u.commit_id)
  union all
  select 'partition_info.range_id', table_id, range_id, {_month_sql('t')} from (
    select table_id, range_id, max(last_update_timestamp) as t from partition_info p
    where range_id is not null and range_id not in ('', '-5')
      and not exists (select 1 from data_info y where y.table_id = p.table_id and y.range_id = p.range_id)
    group by table_id, range_id having max(read_version) > 0))
select field, table_id, period, count(distinct ref_value) as ref_values, count(*) as references from x group by 1, 2, 3
"""

QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_plan": p2_plan,
    "p2_merged": p2_merged,
    "p3_found": p3_found,
    "p3_undeclared": p3_undeclared,
    "p3_unified": p3_unified,
    "p4_found": p4_found,
    "p4_range_results": p4_range_results,
    "p4_chunks": p4_chunks,
    "p4_version_gaps": p4_version_gaps,
    "p4_range_files": p4_range_files,
    "p4_range_value_files": p4_range_value_files,
    "p5_found": p5_found,
    "p5_per_month": p5_per_month,
}
SQL = {
    "p1_found": P1_SQL,
    "p2_found": P2_SQL,
    "p2_plan": P2_PLAN_SQL,
    "p2_merged": P2_MERGED_SQL,
    "p3_undeclared": P3_UNDECLARED_SQL,
    "p3_unified": P3_UNIFIED_SQL,
    "p4_found": P4_SQL,
    "p4_range_results": P4_RANGES_SQL,
    "p4_chunks": P4_CHUNKS_SQL,
    "p4_version_gaps": P4_GAPS_SQL,
    "p4_range_files": P4_RANGE_FILES_SQL,
    "p4_range_value_files": P4_RANGE_VALUE_FILES_SQL,
    "p5_found": P5_SQL,
    "p5_per_month": P5_MONTHS_SQL,
}
