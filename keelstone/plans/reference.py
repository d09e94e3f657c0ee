"""Queries over keyed tables made from the driver's tables, one or more per feature of the engine, with equivalent SQL.

Every query builds its tables in a fresh folder from whole input tables and returns a DataFrame.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelstone import catalog
from keelstone.lake import Table, read
from keelstone.operators.merge import PythonOperator
from keelstone.plans import views
from keelstone.session import scratch_path
from keelstone.streaming.sink import write_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(spark: SparkSession) -> str:
    """A name for a table that lives as long as the query; unless told otherwise, such names are no lasting ones."""
    for key, label in (("spark.keelstone.catalog.dir", "names"), ("spark.keelstone.warehouse", "tables")):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, scratch_path(spark, label))
    return f"t{uuid.uuid4().hex[:12]}"


def keyed_orders(spark: SparkSession, sf_dir: str, name: str | None = None) -> Table:
    """Orders, range-partitioned by status and keyed by order number."""
    creator = Table.createTable(spark, source(spark, sf_dir, "orders"), scratch_path(spark, "orders"))
    creator = creator.rangePartitions("o_orderstatus").hashPartitions("o_orderkey").hashBucketNum(8)
    return (creator.shortTableName(name) if name else creator).create()


def plain(spark: SparkSession, sf_dir: str, name: str, ranges=None, table_name: str | None = None) -> Table:
    table = Table(spark, scratch_path(spark, name))
    table.write(source(spark, sf_dir, name), range_partitions=ranges, short_name=table_name)
    return table


def doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta 1: every fifth order at twice its price."""
    return source(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)


def added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta 2: new orders."""
    return source(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)


ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
DOUBLED = "select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 5 = 0 then o_totalprice * 2 else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority from orders"
ADDED = "select o_orderkey + 10000000 as o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 7 = 0"


# scans and writes ------------------------------------------------------------------------------------------------------


@query(f"select {ORDER_COLUMNS} from orders union all {ADDED}")
def write_append_scan(spark, sf_dir):
    table = plain(spark, sf_dir, "orders")
    table.write(added(spark, sf_dir), "append")
    return table.toDF()


@query("select * from nation where n_regionkey = 1")
def write_overwrite(spark, sf_dir):
    table = plain(spark, sf_dir, "nation")
    table.write(source(spark, sf_dir, "nation").where("n_regionkey = 1"), "overwrite")
    return table.toDF()


@query(f"select {ORDER_COLUMNS} from orders where o_orderstatus <> 'F' union all select o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1, o_orderdate, o_orderpriority from orders where o_orderstatus = 'F'")
def replace_where(spark, sf_dir):
    table = plain(spark, sf_dir, "orders", "o_orderstatus")
    new = source(spark, sf_dir, "orders").where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    table.write(new, "overwrite", replace_where="o_orderstatus = 'F'")
    return table.toDF()


@query("select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_orderstatus = 'F' group by 1")
def range_partition_prune(spark, sf_dir):
    rows = keyed_orders(spark, sf_dir).toDF("o_orderstatus = 'F'")
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'O'")
def partition_path_load(spark, sf_dir):
    table = keyed_orders(spark, sf_dir)
    return read(spark, f"{table.path}/o_orderstatus=O").select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_totalprice from orders where o_orderkey = (select min(o_orderkey) from orders)")
def bucket_prune(spark, sf_dir):
    table = keyed_orders(spark, sf_dir)
    key = source(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    return table.toDF(f"o_orderkey = {key}").select("o_orderkey", "o_totalprice")


@query("select n_nationkey, n_name, n_regionkey from nation where n_regionkey in (0, 2)")
def insert_sql(spark, sf_dir):
    name = fresh_name(spark)
    source(spark, sf_dir, "nation").createOrReplaceTempView("nation_rows")
    catalog.sql(spark, f"create table keel.{name} (n_nationkey int, n_name string, n_regionkey int) partitioned by (n_regionkey)")
    for region in (0, 2):
        catalog.sql(spark, f"insert into keel.{name} select n_nationkey, n_name, n_regionkey from nation_rows where n_regionkey = {region}")
    return catalog.sql(spark, f"select n_nationkey, n_name, n_regionkey from keel.{name}")


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def create_table_as_select(spark, sf_dir):
    name, other = fresh_name(spark), fresh_name(spark)
    plain(spark, sf_dir, "nation", table_name=name)
    plain(spark, sf_dir, "region", table_name=other)
    target = fresh_name(spark)
    catalog.sql(spark, f"create table keel.{target} as select n_name, r_name from keel.{name} join keel.{other} on n_regionkey = r_regionkey")
    return Table.forName(spark, target).toDF()


# upserts ---------------------------------------------------------------------------------------------------------------


@query(DOUBLED)
def upsert_mor(spark, sf_dir):
    table = keyed_orders(spark, sf_dir)
    table.upsert(doubled(spark, sf_dir))
    return table.toDF()


@query(f"with x as ({DOUBLED}) select {ORDER_COLUMNS.replace('o_orderpriority', '')} case when o_orderkey % 10 = 0 then 'late' else o_orderpriority end as o_orderpriority from x union all {ADDED}")
def upsert_mor_multi(spark, sf_dir):
    table = keyed_orders(spark, sf_dir)
    table.upsert(doubled(spark, sf_dir))
    table.upsert(added(spark, sf_dir))
    table.upsert(doubled(spark, sf_dir).where("o_orderkey % 10 = 0").withColumn("o_orderpriority", F.lit("late")))
    return table.toDF()


@query(f"select {ORDER_COLUMNS} from orders union all {ADDED}")
def upsert_insert_only(spark, sf_dir):
    table = keyed_orders(spark, sf_dir)
    table.upsert(added(spark, sf_dir))
    return table.toDF()


@query("select o_orderkey, o_orderstatus, o_totalprice, case when o_orderkey % 5 = 0 then 'partial' else o_orderpriority end as o_orderpriority from orders")
def upsert_partial_columns(spark, sf_dir):
    table = keyed_orders(spark, sf_dir)
    part = source(spark, sf_dir, "orders").where("o_orderkey % 5 = 0")
    table.upsert(part.select("o_orderkey", "o_orderstatus", F.lit("partial").alias("o_orderpriority")))
    return table.toDF().select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("select o_orderkey, case when o_orderkey % 5 = 0 then null else o_orderpriority end as o_orderpriority, o_totalprice from orders")
def upsert_null_overwrites(spark, sf_dir):
    table = keyed_orders(spark, sf_dir)
    part = source(spark, sf_dir, "orders").where("o_orderkey % 5 = 0")
    table.upsert(part.select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("o_orderpriority")))
    return table.toDF().select("o_orderkey", "o_orderpriority", "o_totalprice")


def _rewriting(spark: SparkSession, action: Callable[[], object]) -> None:
    """Run an upsert that rewrites partitions; the session's settings are put back."""
    keys = ("spark.keelstone.deltaFile.enabled", "spark.keelstone.full.partitioned.table.scan.enabled")
    before = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set(keys[0], "false")
    spark.conf.set(keys[1], "true")
    try:
        action()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@query(f"{DOUBLED} union all {ADDED}")
def upsert_cow(spark, sf_dir):
    table = keyed_orders(spark, sf_dir)
    _rewriting(spark, lambda: table.upsert(doubled(spark, sf_dir).unionByName(added(spark, sf_dir))))
    return table.toDF()


@query("select o_orderkey, o_orderstatus, case when o_orderkey % 5 = 0 and o_orderstatus = 'F' then o_totalprice * 2 else o_totalprice end as o_totalprice from orders")
def upsert_cow_condition(spark, sf_dir):
    table = keyed_orders(spark, sf_dir)
    _rewriting(spark, lambda: table.upsert(doubled(spark, sf_dir), "o_orderstatus = 'F'"))
    return table.toDF().select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("select user_id, event_type, round(sum(value), 4) as value from events group by all")
def upsert_composite_key(spark, sf_dir):
    events = source(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("value"))
    table = Table(spark, scratch_path(spark, "users"))
    table.write(events.withColumn("value", F.lit(0.0)), hash_partitions="user_id,event_type", bucket_num=8)
    table.upsert(events)
    return table.toDF()


# merge operators -------------------------------------------------------------------------------------------------------


def _counters(spark: SparkSession, sf_dir: str) -> Table:
    """A counter per user and type in three layers: long n, string tag."""
    events = source(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    table = Table(spark, scratch_path(spark, "counters"))
    table.write(events.withColumn("tag", F.lit("a")), hash_partitions="user_id", bucket_num=8)
    table.upsert(events.where("user_id % 2 = 0").withColumn("tag", F.lit("b")))
    table.upsert(events.where("user_id % 3 = 0").select("user_id", F.lit(None).cast("long").alias("n"), F.lit("c").alias("tag")))
    return table


_COUNTS = "with e as (select user_id, count(*) as n from events group by 1)"


@query(f"{_COUNTS} select user_id, cast(n * (1 + (user_id % 2 = 0)::int) as bigint) as n from e")
def merge_op_sum(spark, sf_dir):
    return _counters(spark, sf_dir).toDF(merge={"n": "sum"}).select("user_id", "n")


@query(f"{_COUNTS} select user_id, 'a' || case when user_id % 2 = 0 then ',b' else '' end || case when user_id % 3 = 0 then ',c' else '' end as tag from e")
def merge_op_concat(spark, sf_dir):
    return _counters(spark, sf_dir).toDF(merge={"tag": "join"}).select("user_id", "tag")


@query(f"{_COUNTS} select user_id, cast(1 + (user_id % 2 = 0)::int + (user_id % 3 = 0)::int as bigint) as n from e")
def merge_op_custom(spark, sf_dir):
    return _counters(spark, sf_dir).toDF(merge={"n": PythonOperator(len, "long")}).select("user_id", "n")


@query(f"{_COUNTS} select user_id, cast(n * (1 + (user_id % 2 = 0)::int) as bigint) as n from e")
def compaction_merge_op(spark, sf_dir):
    table = _counters(spark, sf_dir)
    table.compaction(mergeOperatorInfo={"n": "sum"})
    return table.toDF().select("user_id", "n")


@query("select user_id, max(event_id) as event_id from events group by 1")
def dedup_on_key(spark, sf_dir):
    table = Table(spark, scratch_path(spark, "dedup"))
    events = source(spark, sf_dir, "events").select("user_id", "event_id").repartition(1).sortWithinPartitions("event_id")
    table.write(events, hash_partitions="user_id", bucket_num=8)
    return table.toDF()


# services --------------------------------------------------------------------------------------------------------------


@query(f"{DOUBLED} union all {ADDED}")
def compaction_preserves(spark, sf_dir):
    table = keyed_orders(spark, sf_dir)
    table.upsert(doubled(spark, sf_dir))
    table.upsert(added(spark, sf_dir))
    table.compaction()
    return table.toDF()


@query("select event_id, user_id, event_type, value, ts from events union all select event_id, user_id, event_type, value, ts from events where event_id % 2 = 0")
def consolidate_files(spark, sf_dir):
    """Many small sorted files, repeated rows among them, merged into few in one commit."""
    events = source(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    table = Table(spark, scratch_path(spark, "sorted"))
    table.write(events, range_partitions="event_type", properties={"keelstone.sortBy": "event_id"})
    for part in range(3):
        table.write(events.where(f"event_id % 2 = 0 and event_id % 3 = {part}"), "append")
    before = len(table.snapshot().files)
    table.consolidate(min_files=2)
    if len(table.snapshot().files) >= before:
        raise RuntimeError("nothing was merged")
    return table.toDF()


@query(f"{DOUBLED} union all {ADDED}")
def part_compaction(spark, sf_dir):
    table = keyed_orders(spark, sf_dir)
    table.upsert(added(spark, sf_dir))
    table.upsert(doubled(spark, sf_dir).where("o_orderkey % 2 = 0"))
    table.upsert(doubled(spark, sf_dir))
    table.part_compaction(minimum=2)
    return table.toDF()


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'F'")
def delete_range_only(spark, sf_dir):
    table = keyed_orders(spark, sf_dir)
    table.delete("o_orderstatus = 'F'")
    return table.toDF().select("o_orderkey", "o_orderstatus")


@query("select o_orderkey, o_totalprice from orders where not o_totalprice > 150000")
def delete_rows(spark, sf_dir):
    table = keyed_orders(spark, sf_dir)
    table.delete("o_totalprice > 150000")
    return table.toDF().select("o_orderkey", "o_totalprice")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then null else o_totalprice end as o_totalprice from orders where not coalesce(case when o_orderkey % 3 = 0 then null else o_totalprice end > 150000, false)")
def delete_null_cond(spark, sf_dir):
    table = Table(spark, scratch_path(spark, "orders"))
    table.write(source(spark, sf_dir, "orders").select("o_orderkey", F.expr("if(o_orderkey % 3 = 0, null, o_totalprice)").alias("o_totalprice")))
    table.delete("o_totalprice > 150000")
    return table.toDF()


@query("select o_orderkey, case when o_totalprice > 150000 then o_totalprice - 1 else o_totalprice end as o_totalprice, case when o_totalprice > 150000 then 'big' else o_orderpriority end as o_orderpriority from orders")
def update_rows(spark, sf_dir):
    table = keyed_orders(spark, sf_dir)
    table.update("o_totalprice > 150000", {"o_totalprice": "o_totalprice - 1", "o_orderpriority": "'big'"})
    return table.toDF().select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("select l_orderkey, l_linenumber, l_partkey, round(l_tax, 4) as l_tax, 'X' as l_linestatus from lineitem")
def update_all(spark, sf_dir):
    table = plain(spark, sf_dir, "lineitem")
    table.update(set={"l_linestatus": "'X'"})
    return table.toDF().select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_tax", 4).alias("l_tax"), "l_linestatus")


@query("select o_orderkey, case when o_custkey % 2 = 0 then 'even' else o_orderpriority end as priority, o_custkey as customer from orders")
def update_nested(spark, sf_dir):
    rows = source(spark, sf_dir, "orders").select(
        "o_orderkey", F.struct(F.struct(F.col("o_orderpriority").alias("priority")).alias("c"), F.col("o_custkey").alias("g")).alias("a")
    )
    table = Table(spark, scratch_path(spark, "nested"))
    table.write(rows)
    table.update("a.g % 2 = 0", {"a.c.priority": "'even'"})
    return table.toDF().select("o_orderkey", F.col("a.c.priority").alias("priority"), F.col("a.g").alias("customer"))


@query("select event_id, event_type from events where event_type <> (select min(event_type) from events)")
def drop_partition(spark, sf_dir):
    table = plain(spark, sf_dir, "events", "event_type")
    first = source(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    table.dropPartition(f"event_type = '{first}'")
    return table.toDF().select("event_id", "event_type")


@query()
def cleanup_list(spark, sf_dir):
    """Files that a compaction left behind, by kind of folder."""
    table = plain(spark, sf_dir, "events", "event_type")
    table.delete("event_id % 2 = 0")
    key, before = "spark.keelstone.cleanup.interval", spark.conf.get("spark.keelstone.cleanup.interval", None)
    spark.conf.set(key, "0")
    try:
        old = table.cleanup(justList=True)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.createDataFrame([(p.split("/")[0], p.rsplit(".", 1)[-1]) for p in old], "folder string, kind string").groupBy("folder", "kind").count()


@query("select n_nationkey, n_name, n_regionkey, null::integer as rank from nation union all select n_nationkey + 100, n_name, n_regionkey, n_nationkey from nation")
def schema_merge_append(spark, sf_dir):
    table = plain(spark, sf_dir, "nation")
    nation = source(spark, sf_dir, "nation")
    table.write(nation.withColumn("rank", F.col("n_nationkey")).withColumn("n_nationkey", F.col("n_nationkey") + 100), merge_schema=True)
    return table.toDF()


@query("select n_nationkey, upper(n_name) as label from nation")
def schema_overwrite(spark, sf_dir):
    table = plain(spark, sf_dir, "nation")
    table.write(source(spark, sf_dir, "nation").select("n_nationkey", F.upper("n_name").alias("label")), "overwrite", overwrite_schema=True)
    return table.toDF()


@query("select r_regionkey, r_name, null::varchar as note from region")
def alter_add_column(spark, sf_dir):
    name = fresh_name(spark)
    plain(spark, sf_dir, "region", table_name=name)
    catalog.sql(spark, f"alter table keel.{name} add columns (note string comment 'added later')")
    return catalog.sql(spark, f"select r_regionkey, r_name, note from keel.{name}")


# joins and set operations ----------------------------------------------------------------------------------------------


def bucketed_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two tables with as many buckets of the same key: a join on the key finds its rows side by side."""
    orders = keyed_orders(spark, sf_dir)
    lines = source(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    table = Table(spark, scratch_path(spark, "lines"))
    table.write(lines.where("l_orderkey % 4 <> 0"), hash_partitions="l_orderkey", bucket_num=8)
    return orders.toDF(), table.toDF()


_LINES = "(select l_orderkey, count(*) as lines, round(sum(l_quantity), 2) as quantity from lineitem where l_orderkey % 4 <> 0 group by 1)"


def _bucket_join(how: str, sql_how: str):
    @query(f"select o_orderkey, l_orderkey, o_totalprice, lines, quantity from orders {sql_how} join {_LINES} on o_orderkey = l_orderkey")
    def join(spark, sf_dir):
        left, right = bucketed_pair(spark, sf_dir)
        return left.join(right, left.o_orderkey == right.l_orderkey, how).select("o_orderkey", "l_orderkey", "o_totalprice", "lines", "quantity")

    QUERIES[f"bucket_join_{how}"] = QUERIES.pop("join")
    SQL[f"bucket_join_{how}"] = SQL.pop("join")


for _how in ("inner", "left", "full"):
    _bucket_join(_how, _how)


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [plain(spark, sf_dir, n).toDF() for n in names]


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders)")
def semi_join(spark, sf_dir):
    customer, orders = _tables(spark, sf_dir, "customer", "orders")
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)")
def anti_join(spark, sf_dir):
    customer, orders = _tables(spark, sf_dir, "customer", "orders")
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("select s.s_suppkey as s_suppkey, n.n_nationkey as n_nationkey from supplier s join nation n on s.s_nationkey < n.n_nationkey and s.s_acctbal > n.n_regionkey * 1000")
def theta_join(spark, sf_dir):
    supplier, nation = _tables(spark, sf_dir, "supplier", "nation")
    on = (F.col("s_nationkey") < F.col("n_nationkey")) & (F.col("s_acctbal") > F.col("n_regionkey") * 1000)
    return supplier.join(nation, on).select("s_suppkey", "n_nationkey")


@query("select r_name, n_name from region, nation")
def cross_join(spark, sf_dir):
    region, nation = _tables(spark, sf_dir, "region", "nation")
    return region.crossJoin(nation).select("r_name", "n_name")


@query("select n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey group by 1")
def broadcast_join(spark, sf_dir):
    customer, nation = _tables(spark, sf_dir, "customer", "nation")  # nation: 25 rows at every scale
    joined = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def key_sets(spark: SparkSession, sf_dir: str) -> tuple[Table, Table]:
    left = keyed_orders(spark, sf_dir)
    right = Table(spark, scratch_path(spark, "keys"))
    right.write(source(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").unionByName(added(spark, sf_dir)), hash_partitions="o_orderkey", bucket_num=8)
    return left, right


_LEFT, _RIGHT = "select o_orderkey from orders", f"(select o_orderkey from orders where o_orderkey % 3 = 0 union all select o_orderkey from ({ADDED}))"


@query(f"{_LEFT} intersect select * from {_RIGHT}")
def intersect_keys(spark, sf_dir):
    left, right = key_sets(spark, sf_dir)
    return left.intersectKeys(right)


@query(f"{_LEFT} except select * from {_RIGHT}")
def except_keys(spark, sf_dir):
    left, right = key_sets(spark, sf_dir)
    return left.exceptKeys(right)


@query("select o_custkey from orders intersect all select c_custkey from customer")
def intersect_all(spark, sf_dir):
    orders, customer = _tables(spark, sf_dir, "orders", "customer")
    return orders.select("o_custkey").intersectAll(customer.select(F.col("c_custkey").alias("o_custkey")))


@query(f"{_LEFT} union all select * from {_RIGHT}")
def union_all(spark, sf_dir):
    left, right = key_sets(spark, sf_dir)
    return left.toDF().select("o_orderkey").unionByName(right.toDF().select("o_orderkey"))


# aggregation, windows, sorting -----------------------------------------------------------------------------------------


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by 1, 2")
def agg_group(spark, sf_dir):
    (lines,) = _tables(spark, sf_dir, "lineitem")
    return lines.where("l_shipdate <= timestamp '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("n"),
    )


@query("select o_orderstatus, count(distinct o_custkey) as customers from orders group by 1")
def agg_distinct(spark, sf_dir):
    return keyed_orders(spark, sf_dir).toDF().groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"))


def _grouping(spark: SparkSession, sf_dir: str, clause: str) -> DataFrame:
    name = fresh_name(spark)
    plain(spark, sf_dir, "orders", table_name=name)
    return catalog.sql(spark, f"select o_orderstatus, o_orderpriority, count(*) as n from keel.{name} group by {clause}")


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, sf_dir):
    return _grouping(spark, sf_dir, "rollup (o_orderstatus, o_orderpriority)")


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def agg_cube(spark, sf_dir):
    return _grouping(spark, sf_dir, "cube (o_orderstatus, o_orderpriority)")


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(spark, sf_dir):
    return _grouping(spark, sf_dir, "grouping sets ((o_orderstatus), (o_orderpriority), ())")


@query("select o_custkey, count(*) as n, max(o_totalprice) as top from orders group by 1 having count(*) > 12")
def agg_having(spark, sf_dir):
    grouped = keyed_orders(spark, sf_dir).toDF().groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    return grouped.where("n > 12")


@query("select o_orderkey, rank() over w as rnk, row_number() over w as rn, lag(o_orderkey) over w as before from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)")
def window_rank(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = keyed_orders(spark, sf_dir).toDF()
    return rows.select("o_orderkey", F.rank().over(w).alias("rnk"), F.row_number().over(w).alias("rn"), F.lag("o_orderkey").over(w).alias("before"))


@query("select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row), 2) as last3 from orders")
def window_frame(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 0)
    return keyed_orders(spark, sf_dir).toDF().select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("last3"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def topk(spark, sf_dir):
    return keyed_orders(spark, sf_dir).toDF().select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("select n_name from nation order by n_name")
def sort_rows(spark, sf_dir):
    (nation,) = _tables(spark, sf_dir, "nation")
    return nation.select("n_name").orderBy("n_name")


# scalar functions ------------------------------------------------------------------------------------------------------


@query("select p_partkey, upper(p_name) as up, length(p_name) as len, substring(p_name, 2, 3) as sub, replace(p_brand, '#', '-') as rep, lpad(p_brand, 12, '*') as padded, reverse(p_type) as rev, md5(p_name) as md, instr(p_name, 'a') as at, split_part(p_type, ' ', 1) as word, concat_ws('|', p_brand, p_type) as joined, p_name like '%a%' as has, regexp_replace(p_type, '[AEIOU]', '', 'g') as consonants from part")
def scalar_string(spark, sf_dir):
    (part,) = _tables(spark, sf_dir, "part")
    return part.select(
        "p_partkey", F.upper("p_name").alias("up"), F.length("p_name").alias("len"), F.substring("p_name", 2, 3).alias("sub"),
        F.expr("replace(p_brand, '#', '-')").alias("rep"), F.lpad("p_brand", 12, "*").alias("padded"), F.reverse("p_type").alias("rev"),
        F.md5("p_name").alias("md"), F.instr("p_name", "a").alias("at"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("word"),
        F.concat_ws("|", "p_brand", "p_type").alias("joined"), F.col("p_name").like("%a%").alias("has"),
        F.regexp_replace("p_type", "[AEIOU]", "").alias("consonants"),
    )


@query("select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, quarter(o_orderdate) as q, dayofyear(o_orderdate) as doy, cast(date_trunc('month', o_orderdate) as date) as first, last_day(o_orderdate) as last, cast(o_orderdate as date) + 7 as week_later, date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as days from orders")
def scalar_date(spark, sf_dir):
    d = F.col("o_orderdate")
    return keyed_orders(spark, sf_dir).toDF().select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"), F.quarter(d).alias("q"), F.dayofyear(d).alias("doy"),
        F.to_date(F.date_trunc("month", d)).alias("first"), F.last_day(d).alias("last"), F.date_add(F.to_date(d), 7).alias("week_later"),
        F.datediff(F.to_date(d), F.lit("1992-01-01").cast("date")).alias("days"),
    )


@query("select s_suppkey, round(sqrt(abs(s_acctbal)), 6) as root, floor(s_acctbal) as fl, ceil(s_acctbal) as ce, round(ln(abs(s_acctbal) + 1), 6) as ln, sign(s_acctbal) as sg, s_suppkey % 7 as md, round(power(s_nationkey, 2), 2) as sq, greatest(s_nationkey, 10) as gr, s_suppkey & 5 as bits, round(s_acctbal, 1) as r1 from supplier")
def scalar_math(spark, sf_dir):
    (s,) = _tables(spark, sf_dir, "supplier")
    b = F.col("s_acctbal")
    return s.select(
        "s_suppkey", F.round(F.sqrt(F.abs(b)), 6).alias("root"), F.floor(b).cast("double").alias("fl"), F.ceil(b).cast("double").alias("ce"),
        F.round(F.log(F.abs(b) + 1), 6).alias("ln"), F.signum(b).cast("tinyint").alias("sg"), (F.col("s_suppkey") % 7).alias("md"),
        F.round(F.pow("s_nationkey", F.lit(2)), 2).alias("sq"), F.greatest("s_nationkey", F.lit(10)).alias("gr"),
        F.col("s_suppkey").bitwiseAND(5).alias("bits"), F.round(b, 1).alias("r1"),
    )


@query("select vec_id, len(embedding) as n, embedding[1] as first, list_contains(embedding[1:3], embedding[2]) as has, list_max(embedding) as top, list_min(embedding) as low, round(list_sum(list_transform(embedding, lambda x: x::double * x)), 4) as norm from embeddings")
def scalar_array(spark, sf_dir):
    (e,) = _tables(spark, sf_dir, "embeddings")
    v = F.col("embedding")
    return e.select(
        "vec_id", F.size(v).cast("long").alias("n"), v[0].alias("first"), F.array_contains(F.slice(v, 1, 3), v[1]).alias("has"),
        F.array_max(v).alias("top"), F.array_min(v).alias("low"),
        F.round(F.aggregate(F.transform(v, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x), 4).alias("norm"),
    )


@query("select event_type, count(*) as n, count(distinct json_extract_string(props, '$.k')) as keys, max(cast(json_extract_string(props, '$.k') as bigint)) as top from events group by 1")
def scalar_json(spark, sf_dir):
    (e,) = _tables(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(k).alias("keys"), F.max(k.cast("long")).alias("top"))


@query("select table_id, len(map_keys(setting)) as n, setting['engine'] as engine from table_info where setting is not null")
def scalar_map(spark, sf_dir):
    (t,) = _tables(spark, sf_dir, "table_info")
    return t.where("setting is not null").select("table_id", F.size("setting").cast("long").alias("n"), F.col("setting")["engine"].alias("engine"))


# streaming -------------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of several files, one per batch."""
    folder = scratch_path(spark, "stream")
    source(spark, sf_dir, "events").repartitionByRange(4, "event_id").write.parquet(folder)
    events = source(spark, sf_dir, "events")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _run(spark: SparkSession, rows: DataFrame, mode: str, **options) -> Table:
    path = scratch_path(spark, "sink")
    write_stream(rows, path, uuid.uuid4().hex, scratch_path(spark, "progress"), mode, {"availableNow": True}, **options).awaitTermination()
    return Table.forPath(spark, path)


@query("select event_id, user_id, event_type, value from events")
def stream_append(spark, sf_dir):
    table = _run(spark, _stream(spark, sf_dir).select("event_id", "user_id", "event_type", "value"), "append", range_partitions="event_type")
    return table.toDF()


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def stream_complete(spark, sf_dir):
    rows = _stream(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return _run(spark, rows, "complete").toDF()


@query("select user_id, count(*) as n from events group by 1")
def stream_update(spark, sf_dir):
    rows = _stream(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return _run(spark, rows, "update", hash_partitions="user_id", bucket_num=4).toDF()


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def stream_window_watermark(spark, sf_dir):
    """Hourly windows; the watermark is wide enough that no event of the input is late."""
    events = _stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "3650 days")
    rows = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select(F.col("window.start").alias("start"), "event_type", "n")
    return _run(spark, rows, "update", hash_partitions="start,event_type", bucket_num=4).toDF().withColumn("start", F.col("start").cast("timestamp_ntz"))


# materialized views ----------------------------------------------------------------------------------------------------


def _view(spark: SparkSession, text: str, question: str, must: bool = True) -> DataFrame:
    views.create_view(spark, fresh_name(spark), scratch_path(spark, "view"), text)
    found = views.rewritten(spark, question)
    if found is None and must:
        raise RuntimeError("the view should answer the query")
    return catalog.sql(spark, question)


def _named(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, str]:
    made = {n: fresh_name(spark) for n in names}
    for n, short in made.items():
        keyed_orders(spark, sf_dir, short) if n == "orders" else plain(spark, sf_dir, n, table_name=short)
    return made


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 100000")
def mv_create(spark, sf_dir):
    t = _named(spark, sf_dir, "orders")["orders"]
    path = scratch_path(spark, "view")
    views.create_view(spark, fresh_name(spark), path, f"select o_orderkey, o_totalprice from keel.{t} where o_totalprice > 100000")
    return Table.forPath(spark, path).toDF()


@query("select o_orderkey, case when o_orderkey % 5 = 0 then o_totalprice * 2 else o_totalprice end as p from orders where case when o_orderkey % 5 = 0 then o_totalprice * 2 else o_totalprice end > 100000")
def mv_update(spark, sf_dir):
    t = _named(spark, sf_dir, "orders")["orders"]
    path = scratch_path(spark, "view")
    view = views.create_view(spark, fresh_name(spark), path, f"select o_orderkey, o_totalprice as p from keel.{t} where o_totalprice > 100000")
    Table.forName(spark, t).upsert(doubled(spark, sf_dir))
    view.updateMaterialView()
    return view.toDF()


@query("select o_orderkey, o_totalprice + 1 as q from orders where o_totalprice > 200000 and o_orderstatus = 'F'")
def mv_rewrite_range(spark, sf_dir):
    t = _named(spark, sf_dir, "orders")["orders"]
    return _view(spark, f"select o_orderkey, o_totalprice, o_orderstatus from keel.{t} where o_totalprice > 100000",
                 f"select o_orderkey, o_totalprice + 1 as q from keel.{t} where o_totalprice > 200000 and o_orderstatus = 'F'")


@query("select c_name, o_totalprice from orders join customer on o_custkey = c_custkey where o_totalprice > 150000 and c_mktsegment = 'BUILDING'")
def mv_rewrite_join(spark, sf_dir):
    t = _named(spark, sf_dir, "orders", "customer")
    body = f"from keel.{t['orders']} join keel.{t['customer']} on o_custkey = c_custkey where o_totalprice > 150000"
    return _view(spark, f"select c_custkey, c_name, c_mktsegment, o_totalprice {body}", f"select c_name, o_totalprice {body} and c_mktsegment = 'BUILDING'")


@query("select o_custkey, max(o_totalprice) as top, count(*) as n from orders where o_orderstatus = 'F' group by 1 having count(*) > 5")
def mv_rewrite_agg(spark, sf_dir):
    t = _named(spark, sf_dir, "orders")["orders"]
    body = f"select o_custkey, max(o_totalprice) as top, count(*) as n from keel.{t} where o_orderstatus = 'F' group by o_custkey"
    return _view(spark, body, f"{body} having count(*) > 5")


@query("select o_orderkey from orders where (o_totalprice > 200000 or o_custkey < 50) and o_orderpriority <> 'x'")
def mv_rewrite_or(spark, sf_dir):
    t = _named(spark, sf_dir, "orders")["orders"]
    return _view(spark, f"select o_orderkey, o_totalprice, o_custkey, o_orderpriority from keel.{t} where o_totalprice > 100000 or o_custkey < 100",
                 f"select o_orderkey from keel.{t} where (o_totalprice > 200000 or o_custkey < 50) and o_orderpriority <> 'x'")
