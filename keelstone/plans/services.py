"""Queries over statements, rules, services and streams of tables, each with the rows that SQL gives for the same."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone import catalog
from keelstone.errors import EngineError
from keelstone.lake import Table
from keelstone.plans import views
from keelstone.plans.reference import ADDED, DOUBLED, added, doubled, fresh_name, keyed_orders, plain, query, source
from keelstone.session import local_path, scratch_path
from keelstone.streaming.sink import Sink, write_stream


def _refusals(spark: SparkSession, attempts: dict) -> DataFrame:
    """``attempt, refused``: the kind of error of each attempt, ``none`` if it went through."""
    found = []
    for name, attempt in attempts.items():
        try:
            attempt()
            found.append((name, "none"))
        except EngineError as e:
            found.append((name, type(e).__name__))
        except Exception as e:  # an error of Spark's own, such as a violated constraint
            found.append((name, "SparkError" if "pyspark" in type(e).__module__ or "py4j" in type(e).__module__ else type(e).__name__))
    return spark.createDataFrame(found, "attempt string, refused string")


def _rows_sql(pairs: dict[str, str]) -> str:
    return "select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in pairs.items()) + ") as t(attempt, refused)"


# statements ------------------------------------------------------------------------------------------------------------


@query("select n_nationkey, n_name, cast(null as integer) as n_regionkey from nation union all select n_nationkey + 100, 'it''s -- where', n_regionkey from nation")
def insert_sql_columns(spark, sf_dir):
    name = fresh_name(spark)
    source(spark, sf_dir, "nation").createOrReplaceTempView("nation_rows")
    catalog.sql(spark, f"create table keel.{name} (n_nationkey int, n_name string, n_regionkey int)")
    catalog.sql(spark, f"insert into keel.{name} (n_name, n_nationkey) select n_name, n_nationkey from nation_rows")
    catalog.sql(spark, f"insert into keel.{name} by name select n_regionkey, 'it\\'s -- where' as n_name, n_nationkey + 100 as n_nationkey from nation_rows")
    return catalog.sql(spark, f"select n_nationkey, n_name, n_regionkey from keel.{name}")


@query("select n_nationkey, case when n_regionkey = 1 then 'x where y' else n_name end as n_name, 'keel.none' as kept from nation where n_regionkey <> 2")
def update_sql_literals(spark, sf_dir):
    name = fresh_name(spark)
    plain(spark, sf_dir, "nation", table_name=name)
    catalog.sql(spark, f"update keel.{name} as n set n_name = 'x where y' /* keel.none */ where n.n_regionkey = 1")
    catalog.sql(spark, f"delete from keel.{name} n where n.n_regionkey = 2 -- and n_name = 'x'")
    return catalog.sql(spark, f"select n_nationkey, n_name, 'keel.none' as kept from keel.{name}")


@query("select * from nation where n_regionkey <> 3 union all select n_nationkey + 100, n_name, 3 from nation where n_regionkey = 3")
def writer_v2(spark, sf_dir):
    """Create, append by name, and overwrite by an expression, through the second writer interface."""
    name, nation = fresh_name(spark), source(spark, sf_dir, "nation")
    catalog.write_to(spark, nation.where("n_regionkey < 2"), name).partitionedBy("n_regionkey").tableProperty("note", "v2").create(scratch_path(spark, "v2"))
    catalog.write_to(spark, nation.where("n_regionkey >= 2").select("n_regionkey", "n_name", "n_nationkey"), name).append()
    changed = nation.where("n_regionkey = 3").withColumn("n_nationkey", (F.col("n_nationkey") + 100).cast(nation.schema["n_nationkey"].dataType))
    catalog.write_to(spark, changed, name).overwrite("n_regionkey = 3")
    return Table.forName(spark, name).toDF().select(*nation.columns)


@query(
    "select * from (values ('k', 'int', cast(null as varchar)), ('s', 'string', 'text'), ('d', 'struct<e:int,f:string>', null), ('late', 'double', null), ('p', 'int', null),"
    " ('# Partitioning', '', null), ('Range 0', 'p', null), ('# note', 'two', null)) as t(col_name, data_type, comment)"
)
def ddl_round_trip(spark, sf_dir):
    """ADD, CHANGE and move columns, SET and UNSET properties, and what DESCRIBE then says."""
    name = fresh_name(spark)
    run = lambda text: catalog.sql(spark, text)
    run(f"create table keel.{name} (s string, k int, d struct<e: int>, p int) partitioned by (p) tblproperties ('note' = 'one', 'gone' = 'x')")
    run(f"alter table keel.{name} add columns (late double after d, d.f string)")
    run(f"alter table keel.{name} change column s comment 'text'")
    run(f"alter table keel.{name} alter column k first")
    run(f"alter table keel.{name} set tblproperties ('note' = 'two')")
    run(f"alter table keel.{name} unset tblproperties if exists ('gone', 'never')")
    return run(f"describe keel.{name}")


@query("select n_nationkey, n_regionkey, cast(null as varchar) as extra from nation")
def ddl_replace_columns(spark, sf_dir):
    name = fresh_name(spark)
    plain(spark, sf_dir, "nation", table_name=name)
    catalog.sql(spark, f"alter table keel.{name} replace columns (n_nationkey int, n_regionkey int, extra string)")
    return catalog.sql(spark, f"select * from keel.{name}")


@query("select false as named, false as there")
def drop_table(spark, sf_dir):
    """A dropped table loses its name and its folder."""
    name = fresh_name(spark)
    table = plain(spark, sf_dir, "region", table_name=name)
    catalog.sql(spark, f"drop table keel.{name}")
    catalog.sql(spark, f"drop table if exists keel.{name}")
    return spark.createDataFrame([(name in catalog.names(spark), Table.isTable(spark, table.path))], "named boolean, there boolean")


_REFUSED = {
    "like": "create table keel.{t}2 like keel.{t}", "rename": "alter table keel.{t} rename to keel.{t}2", "replace": "replace table keel.{t} (a int)",
    "location": "alter table keel.{t} set location '/x'", "partition": "alter table keel.{t} add partition (p = 1)", "repair": "msck repair table keel.{t}",
    "analyze": "analyze table keel.{t} compute statistics", "load": "load data inpath '/x' into table keel.{t}", "buckets": "create table keel.{t}3 (a int) clustered by (a) into 2 buckets",
    "subquery": "delete from keel.{t} where r_regionkey in (select 1)", "random": "delete from keel.{t} where rand() > 0.5",
}


@query(_rows_sql(dict.fromkeys(_REFUSED, "UnsupportedError")))
def refused_statements(spark, sf_dir):
    name = fresh_name(spark)
    plain(spark, sf_dir, "region", table_name=name)
    return _refusals(spark, {k: lambda text=v: catalog.sql(spark, text.format(t=name)) for k, v in _REFUSED.items()})


# rules -----------------------------------------------------------------------------------------------------------------

_RULES = {"null": "SparkError", "condition": "SparkError", "fits": "none", "extra column": "SchemaError", "append-only": "UnsupportedError", "duplicate": "SchemaError"}


@query(_rows_sql(_RULES))
def schema_rules(spark, sf_dir):
    """NOT NULL, conditions on rows, append-only tables, and rows that do not fit."""
    table = catalog.create_table(spark, scratch_path(spark, "rules"), "a int not null, v int", properties={"keelstone.appendOnly": "true"})
    catalog.add_constraint(table, "v", "v > 3")
    rows = lambda *data, ddl="a int, v int": spark.createDataFrame(list(data), ddl)
    return _refusals(spark, {
        "null": lambda: table.write(rows((None, 5))), "condition": lambda: table.write(rows((1, 2))), "fits": lambda: table.write(rows((1, 5))),
        "extra column": lambda: table.write(rows((1, 5, 7), ddl="a int, v int, w int")), "append-only": lambda: table.delete("a = 1"),
        "duplicate": lambda: table.write(rows((1, 5, 7), ddl="a int, v int, V int")),
    })


@query("select r_regionkey, r_name, cast(null as varchar) as kept from region")
def void_columns(spark, sf_dir):
    """Columns without a type are left out; names are matched whatever their case; missing columns become null."""
    table = Table(spark, scratch_path(spark, "void"))
    region = source(spark, sf_dir, "region").select("r_regionkey", "r_name")
    table.write(region.limit(0).withColumn("kept", F.lit(None).cast("string")).withColumn("nothing", F.lit(None)))
    table.write(region.toDF("R_REGIONKEY", "R_Name"), "append")
    return table.toDF().select("r_regionkey", "r_name", "kept")


_CONFLICTS = {"two deltas": "none", "compaction after a delta": "none", "delete of what a compaction replaced": "ConflictError", "overwrite after an append": "ConflictError", "same batch twice": "ConflictError"}


@query(_rows_sql(_CONFLICTS))
def commit_conflicts(spark, sf_dir):
    """Which commits go through though another one came first since they read the table."""
    def race(first, second):
        table = keyed_orders(spark, sf_dir)
        table.upsert(doubled(spark, sf_dir))
        state = table.snapshot()
        first(table)
        second(table, state, list(state.files.values()))

    def raw(f):
        return f.__dict__ | {"path": f"data/{uuid.uuid4().hex}/x", "columns": list(f.columns), "order": 0}

    return _refusals(spark, {
        "two deltas": lambda: race(lambda t: t.upsert(added(spark, sf_dir)), lambda t, s, f: t.log.commit(s, {"kind": "delta", "add": [raw(f[0])]})),
        "compaction after a delta": lambda: race(
            lambda t: t.upsert(added(spark, sf_dir)), lambda t, s, f: t.log.commit(s, {"kind": "compaction", "add": [raw(f[0])], "expire": [f[0].path]}, [f[0].path])),
        "delete of what a compaction replaced": lambda: race(
            lambda t: t.compaction(), lambda t, s, f: t.log.commit(s, {"kind": "simple", "expire": [x.path for x in f]}, [x.path for x in f])),
        "overwrite after an append": lambda: race(
            lambda t: t.upsert(added(spark, sf_dir)), lambda t, s, f: t.log.commit(s, {"kind": "simple", "add": [raw(f[0])], "expire": []}, [])),
        "same batch twice": lambda: race(
            lambda t: t.upsert(added(spark, sf_dir), stream={"query_id": "q", "batch_id": 3}),
            lambda t, s, f: t.log.commit(s, {"kind": "delta", "add": [raw(f[0])], "stream": {"query_id": "q", "batch_id": 3}})),
    })


@query(
    "select o_orderstatus as range_value, n as version, deltas, compacted from (select distinct o_orderstatus from orders),"
    " (values (1, 1, false), (2, 2, false), (3, 0, true), (4, 1, false)) as t(n, deltas, compacted)"
)
def partition_bookkeeping(spark, sf_dir):
    """Version, deltas and state of each partition after a write, an upsert, a compaction and another upsert."""
    table, told = keyed_orders(spark, sf_dir), []

    def note():
        for key, p in table.snapshot().partitions.items():
            told.append((key.split("=", 1)[1], p.version, p.deltas, p.compacted))

    note()
    table.upsert(doubled(spark, sf_dir))
    note()
    table.compaction()
    note()
    table.upsert(doubled(spark, sf_dir))
    note()
    return spark.createDataFrame(told, "range_value string, version int, deltas int, compacted boolean")


# reading ---------------------------------------------------------------------------------------------------------------


@query(f"select o_orderkey, cast(length(o_orderpriority) as bigint) as n, case when o_orderkey % 2 = 0 then 'even' else 'odd' end as kind from ({DOUBLED}) union all"
       f" select o_orderkey, null, case when o_orderkey % 2 = 0 then 'even' else 'odd' end from ({ADDED})")
def udf_over_merge(spark, sf_dir):
    """Python functions, row by row and over Arrow batches, over merged rows; null in, null out."""
    table = keyed_orders(spark, sf_dir)
    table.upsert(doubled(spark, sf_dir))
    table.upsert(added(spark, sf_dir).withColumn("o_orderpriority", F.lit(None).cast("string")))
    length = F.udf(lambda s: None if s is None else len(s), "long")
    kind = F.pandas_udf(lambda k: k.map(lambda x: "odd" if x % 2 else "even"), "string")
    return table.toDF().select("o_orderkey", length("o_orderpriority").alias("n"), kind("o_orderkey").alias("kind"))


@query(f"select o_orderstatus, round(max(o_totalprice) - min(o_totalprice), 4) as spread from ({DOUBLED}) group by 1")
def udaf_over_merge(spark, sf_dir):
    """An aggregate function written in Python, on partial results of the JVM so that no group is gathered whole."""
    table = keyed_orders(spark, sf_dir)
    table.upsert(doubled(spark, sf_dir))
    parts = table.toDF().groupBy("o_orderstatus", F.spark_partition_id().alias("part")).agg(F.max("o_totalprice").alias("top"), F.min("o_totalprice").alias("low"))

    @F.pandas_udf("double")
    def spread(top: pd.Series, low: pd.Series) -> float:
        return float(top.max() - low.min())

    return parts.groupBy("o_orderstatus").agg(F.round(spread("top", "low"), 4).alias("spread"))


@query("with e as (select user_id, count(*) as n from events group by 1) select user_id, cast(n * (1 + (user_id % 2 = 0)::int) as bigint) as n from e")
def merge_op_in_sql(spark, sf_dir):
    """A merge operator named in the text of a query."""
    name = fresh_name(spark)
    events = source(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    table = Table(spark, scratch_path(spark, "counters"))
    table.write(events, hash_partitions="user_id", bucket_num=8, short_name=name)
    table.upsert(events.where("user_id % 2 = 0"))
    return catalog.sql(spark, f"select user_id, merge_sum(n) as n from keel.{name}")


@query(f"{DOUBLED} union all {ADDED}")
def part_merge_on_read(spark, sf_dir):
    """A read of a partition with many versions folds the oldest of them first."""
    table = keyed_orders(spark, sf_dir)
    table.upsert(doubled(spark, sf_dir).where("o_orderkey % 2 = 0"))
    table.upsert(added(spark, sf_dir))
    table.upsert(doubled(spark, sf_dir))
    before, keys = len(table.snapshot().files), {"spark.keelstone.part.merge.enable": "true", "spark.keelstone.part.merge.file.minimum.num": "2"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        rows = table.toDF()
    finally:
        for k in keys:
            spark.conf.unset(k)
    if len(table.snapshot().files) >= before:
        raise RuntimeError("nothing was folded")
    return rows


@query("select event_id, event_type from events where event_type <> (select min(event_type) from events)")
def missing_files_skipped(spark, sf_dir):
    """With Spark's tolerance for missing files, a partition whose files are gone reads as empty."""
    import os

    table = plain(spark, sf_dir, "events", "event_type")
    first = source(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    key = "spark.sql.files.ignoreMissingFiles"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        rows = table.toDF().select("event_id", "event_type")
        for f in table.snapshot().files.values():
            if f.range_values["event_type"] == first:
                os.remove(local_path(f"{table.path}/{f.path}"))
        path = scratch_path(spark, "kept")
        rows.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(path)


@query(f"select o_orderkey from orders where o_orderkey % 3 <> 0 union all select o_orderkey from ({ADDED})")
def except_keys_in_sql(spark, sf_dir):
    """EXCEPT on the keys of two tables with as many buckets, in SQL: planned as a join without a shuffle."""
    left, right = fresh_name(spark), fresh_name(spark)
    rows = source(spark, sf_dir, "orders")
    for name, data in ((left, rows.unionByName(added(spark, sf_dir))), (right, rows.where("o_orderkey % 3 = 0"))):
        Table(spark, scratch_path(spark, "keys")).write(data, hash_partitions="o_orderkey", bucket_num=8, short_name=name)
    return catalog.sql(spark, f"select o_orderkey from keel.{left} except select o_orderkey from keel.{right}")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 150000)")
def anti_join_some(spark, sf_dir):
    customer, orders = (plain(spark, sf_dir, n).toDF() for n in ("customer", "orders"))
    return customer.join(orders.where("o_totalprice > 150000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("select event_id, event_type from events where event_id % 2 = 1")
def cleanup_keeps(spark, sf_dir):
    """Clean-up deletes what no snapshot needs and nothing else."""
    table = plain(spark, sf_dir, "events", "event_type")
    table.delete("event_id % 2 = 0")
    key, before = "spark.keelstone.cleanup.interval", spark.conf.get("spark.keelstone.cleanup.interval", None)
    spark.conf.set(key, "0")
    try:
        if not table.cleanup() or table.cleanup(justList=True):
            raise RuntimeError("the old files should have gone, once")
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return table.toDF().select("event_id", "event_type")


# streams ---------------------------------------------------------------------------------------------------------------


@query("select event_id, user_id from events union all select event_id + 1000000, user_id from events where event_id % 2 = 0")
def stream_replay(spark, sf_dir):
    """Batches that are delivered again count once; the next one counts."""
    events = source(spark, sf_dir, "events").select("event_id", "user_id")
    later = events.where("event_id % 2 = 0").withColumn("event_id", F.col("event_id") + 1_000_000)
    path = scratch_path(spark, "replay")
    for batch_id, rows in ((0, events), (0, events), (1, later), (1, later), (0, events)):
        Sink(path, "query", "append")(rows, batch_id)
    return Table.forPath(spark, path).toDF()


@query("select date_trunc('hour', ts) as start, count(*) as n from events group by 1")
def stream_late_rows(spark, sf_dir):
    """Hourly counts with a watermark of an hour: a last file of events a year old comes too late and is dropped."""
    events = source(spark, sf_dir, "events").select("event_id", "ts")
    folder, seconds = scratch_path(spark, "late"), F.unix_timestamp(F.col("ts").cast("timestamp"))
    cuts = events.select(seconds.alias("s")).approxQuantile("s", [0.33, 0.67], 0.01)
    parts = [seconds <= cuts[0], (seconds > cuts[0]) & (seconds <= cuts[1]), seconds > cuts[1]] if cuts else []
    for part in parts:  # in order of time
        events.where(part).coalesce(1).write.mode("append").parquet(folder)
    events.where("event_id % 3 = 0").withColumn("ts", F.expr("ts - interval 365 days")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    counts = stream.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "late-sink")
    counts = counts.select(F.col("w.start").alias("start"), "n")
    write_stream(counts, path, "late", scratch_path(spark, "late-progress"), "update", {"availableNow": True}, hash_partitions="start", bucket_num=4).awaitTermination()
    return Table.forPath(spark, path).toDF().select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


_STREAM_RULES = {"no type": "SchemaError", "update without keys": "UnsupportedError", "unknown mode": "UnsupportedError", "new column": "SchemaError", "new column allowed": "none"}


@query(_rows_sql(_STREAM_RULES))
def stream_rules(spark, sf_dir):
    path = scratch_path(spark, "stream-rules")
    region = source(spark, sf_dir, "region")
    Sink(path, "q")(region, 0)
    return _refusals(spark, {
        "no type": lambda: Sink(path, "q")(region.withColumn("x", F.lit(None)), 1),
        "update without keys": lambda: Sink(path, "q", "update")(region, 1),
        "unknown mode": lambda: Sink(path, "q", "upsert"),
        "new column": lambda: Sink(path, "q")(region.withColumn("x", F.lit(1)), 1),
        "new column allowed": lambda: Sink(path, "q", merge_schema=True)(region.withColumn("x", F.lit(1)), 1),
    })


# views -----------------------------------------------------------------------------------------------------------------

_VIEW_RULES = {"write": "UnsupportedError", "update": "UnsupportedError", "view of a view": "UnsupportedError", "other source": "UnsupportedError", "stale": "EngineError", "stale allowed": "none", "dropped with its table": "NotFoundError"}


@query(_rows_sql(_VIEW_RULES))
def mv_rules(spark, sf_dir):
    """A view takes no writes, reads tables of ours only, is not read when stale, and goes with its table."""
    name, view_name = fresh_name(spark), fresh_name(spark)
    table = keyed_orders(spark, sf_dir, name)
    path = scratch_path(spark, "view")
    view = views.create_view(spark, view_name, path, f"select o_orderkey, o_totalprice from keel.{name} where o_totalprice > 100000")
    key = "spark.keelstone.allow.stale.materialView"
    spark.range(3).createOrReplaceTempView("not_ours")

    def allowed():
        spark.conf.set(key, "true")
        try:
            view.toDF()
        finally:
            spark.conf.unset(key)

    def dropped():
        table.dropTable()
        Table.forPath(spark, path)

    first = _refusals(spark, {
        "write": lambda: view.write(view.toDF(), "append"), "update": lambda: view.update(set={"o_totalprice": "0"}),
        "view of a view": lambda: views.create_view(spark, fresh_name(spark), scratch_path(spark, "v"), f"select o_orderkey from keel.{view_name}"),
        "other source": lambda: views.create_view(spark, fresh_name(spark), scratch_path(spark, "v"), "select id from not_ours"),
    })
    table.upsert(doubled(spark, sf_dir))
    return first.unionByName(_refusals(spark, {"stale": view.toDF, "stale allowed": allowed, "dropped with its table": dropped}))
