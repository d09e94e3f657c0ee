"""Keyed tables: upserts, merge operators, changes, services, schema rules, DDL, concurrency."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone import catalog
from keelstone.errors import ConflictError, EngineError, NotFoundError, SchemaError, UnsupportedError
from keelstone.lake import Table, read
from keelstone.operators.merge import PythonOperator
from keelstone.sources import schema as schemas

BASE = [(20201101, 1, 1), (20201101, 2, 2), (20201101, 3, 3), (20201102, 4, 4)]
DDL = "range int, hash int, value int"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    creator = Table.createTable(spark, spark.createDataFrame(BASE, DDL), f"{tmp_path}/t")
    return creator.rangePartitions("range").hashPartitions("hash").hashBucketNum(2).create()


def keyed(spark, path, data, ddl, keys="hash", buckets=1, **more):
    t = Table(spark, str(path))
    t.write(spark.createDataFrame(data, ddl), hash_partitions=keys, bucket_num=buckets, **more)
    return t


ALL = ("range", "hash", "value")


def test_upsert_basic(spark, table):
    table.upsert(spark.createDataFrame([(20201101, 1, 11), (20201101, 3, 33), (20201101, 4, 44)], DDL))
    assert table.scanKind() == "newest"
    wanted = [(20201101, 1, 11), (20201101, 2, 2), (20201101, 3, 33), (20201101, 4, 44), (20201102, 4, 4)]
    assert rows(table.toDF(), *ALL) == wanted
    assert table.toDF().columns == ["hash", "value", "range"]
    table.compaction("range = 20201101")
    assert table.scanKind("range = 20201101") == "plain" and rows(table.toDF(), *ALL) == wanted
    assert table.snapshot().partitions["range=20201101"].compacted


def test_upsert_new_column_needs_permission(spark, table, settings):
    source = spark.createDataFrame([(20201101, 1, "a"), (20201103, 9, "z")], "range int, hash int, name string")
    with pytest.raises(SchemaError):
        table.upsert(source)
    settings("spark.keelstone.schema.autoMerge.enabled", "true")
    table.upsert(source)
    assert table.scanKind() == "columns"
    found = rows(table.toDF(), "range", "hash", "value", "name")
    assert (20201101, 1, 1, "a") in found and (20201101, 2, 2, None) in found and (20201103, 9, None, "z") in found
    table.compaction()
    assert rows(table.toDF(), "range", "hash", "value", "name") == found


def test_upsert_errors(spark, table, tmp_path):
    with pytest.raises(SchemaError, match="key columns"):
        table.upsert(spark.createDataFrame([(1, 1)], "hash int, value int"))
    plain = Table(spark, f"{tmp_path}/plain")
    plain.write(spark.createDataFrame(BASE, DDL))
    with pytest.raises(UnsupportedError):
        plain.upsert(spark.createDataFrame(BASE, DDL))
    with pytest.raises(UnsupportedError, match="subqueries"):
        table.upsert(spark.createDataFrame(BASE, DDL), "range in (select 1)")
    with pytest.raises(UnsupportedError, match="deterministic"):
        table.upsert(spark.createDataFrame(BASE, DDL), "range > rand()")
    with pytest.raises(UnsupportedError):
        table.write(spark.createDataFrame(BASE, DDL), "append")


def test_copy_on_write(spark, table, settings):
    settings("spark.keelstone.deltaFile.enabled", "false")
    source = spark.createDataFrame([(20201101, 1, None), (20201101, 2, 22), (20201102, 4, 44)], DDL)
    with pytest.raises(UnsupportedError, match="condition"):
        table.upsert(source)
    table.upsert(source, "range = 20201101")
    assert rows(table.toDF(), *ALL) == [(20201101, 1, 1), (20201101, 2, 22), (20201101, 3, 3), (20201102, 4, 4)]


def test_composite_keys_are_not_glued(spark, tmp_path):
    t = keyed(spark, f"{tmp_path}/t", [("a", "bc", 1), ("ab", "c", 2)], "k1 string, k2 string, v int", "k1,k2", 2)
    t.upsert(spark.createDataFrame([("a", "bc", 3)], "k1 string, k2 string, v int"))
    assert rows(t.toDF()) == [("a", "bc", 3), ("ab", "c", 2)]


def test_merge_operators(spark, tmp_path):
    t = keyed(spark, f"{tmp_path}/long", [("a", 1), ("b", 2), ("c", 3)], "hash string, value long")
    t.upsert(spark.createDataFrame([("a", 11), ("b", 22), ("d", 44)], "hash string, value long"))
    summed = [("a", 12), ("b", 24), ("c", 3), ("d", 44)]
    assert rows(t.toDF(merge={"value": "sum"})) == summed
    assert rows(t.toDF()) == [("a", 11), ("b", 22), ("c", 3), ("d", 44)]
    assert rows(t.toDF(merge={"value": PythonOperator(lambda v: sum(v), "long")})) == summed
    assert rows(t.toDF(merge={"value": lambda values: F.array_max(values)})) == [("a", 11), ("b", 22), ("c", 3), ("d", 44)]
    t.compaction(mergeOperatorInfo={"value": "sum"})
    assert rows(t.toDF()) == summed
    s = keyed(spark, f"{tmp_path}/string", [(1, "1", "x"), (2, None, "y")], "hash int, v1 string, v2 string")
    s.upsert(spark.createDataFrame([(1, "3"), (2, "4")], "hash int, v1 string"))
    assert rows(s.toDF(merge={"V1": "join", "hash": "sum"})) == [(2, "1,3", "x"), (4, "null,4", "y")]
    with pytest.raises(EngineError, match="two merge"):
        s.toDF(merge={"v1": "join", "V1": "sum"})
    with pytest.raises(NotFoundError):
        s.toDF(merge={"nope": "sum"})
    with pytest.raises(EngineError, match="registered"):
        s.toDF(merge={"v1": "nope"})
    Table.registerMergeOperator(spark, "longest", lambda values: F.array_max(values))
    assert rows(s.toDF(merge={"v1": "longest"}), "v1") == [("3",), ("4",)]


def test_null_overwrites_and_sums_as_zero(spark, tmp_path):
    t = keyed(spark, f"{tmp_path}/t", [(1, 1, 1), (2, 2, 2)], "hash int, v1 int, v2 int")
    t.upsert(spark.createDataFrame([(1, None), (2, None)], "hash int, v2 int"))
    assert rows(t.toDF()) == [(1, 1, None), (2, 2, None)]
    assert rows(t.toDF(merge={"v2": "sum"})) == [(1, 1, 1), (2, 2, 2)]
    assert rows(t.toDF().select(F.udf(lambda x: None if x is None else x + 1, "int")("v2"))) == [(None,), (None,)]


def test_last_row_of_a_batch_wins(spark, tmp_path):
    data = spark.createDataFrame([(i % 50, i) for i in range(500)], "hash int, v int").coalesce(1)
    t = Table(spark, f"{tmp_path}/t")
    t.write(data, hash_partitions="hash", bucket_num=4)
    assert rows(t.toDF()) == sorted([(k, 450 + k) for k in range(50)], key=repr)


def test_random_upserts_against_a_model(spark, tmp_path):
    import random

    rng, model = random.Random(9), {}
    t = None
    for version in range(5):
        batch = {(rng.randrange(2), rng.randrange(60)): (rng.choice([None, rng.randrange(100)]), version) for _ in range(40)}
        data = [(r, k, *v) for (r, k), v in batch.items()]
        df = spark.createDataFrame(data, "r int, k int, a int, b int")
        if t is None:
            t = Table(spark, f"{tmp_path}/t")
            t.write(df, range_partitions="r", hash_partitions="k", bucket_num=3)
            model = dict(batch)
        elif version % 2:
            t.upsert(df.drop("a"))
            for key, (_, b) in batch.items():
                model[key] = (model.get(key, (None, None))[0], b)
        else:
            t.upsert(df)
            model.update(batch)
        if version == 2:
            t.part_compaction(minimum=2)
        if version == 3:
            t.compaction("r = 0")
        assert rows(t.toDF(), "r", "k", "a", "b") == sorted([(*k, *v) for k, v in model.items()], key=repr)


def test_delete_and_null_conditions(spark, tmp_path, table):
    t = Table(spark, f"{tmp_path}/plain")
    t.write(spark.createDataFrame([("a", None), ("b", None), ("c", "v"), ("d", "vv")], "key string, value string"))
    t.delete("value = 'v'")
    assert rows(t.toDF()) == [("a", None), ("b", None), ("d", "vv")]
    t.delete(F.col("value").isNull())
    assert rows(t.toDF()) == [("d", "vv")]
    with pytest.raises(TypeError):
        t.delete(condition=1)
    with pytest.raises(UnsupportedError):
        t.delete("key in (select max('d'))")
    before = table.snapshot()
    table.delete("range = 20201102")
    assert {f.path for f in table.snapshot().files.values()} < {f.path for f in before.files.values()}
    table.upsert(spark.createDataFrame([(20201101, 1, 5)], DDL))
    table.delete("value = 1 or value = 2")
    assert rows(table.toDF(), *ALL) == [(20201101, 1, 5), (20201101, 3, 3)]
    table.delete()
    assert rows(table.toDF()) == []


def test_update(spark, tmp_path, table):
    t = Table(spark, f"{tmp_path}/plain")
    t.write(spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("d", 4)], "value string, key int").repartition(4))
    t.update("value = 'a'", {"key": "100"})
    t.update(set={"value": F.coalesce("value", F.lit("none"))})
    assert rows(t.toDF()) == [("a", 100), ("d", 4), ("none", 2), ("none", 3)]
    table.update("hash = 1", {"value": "value + 10"})
    assert (20201101, 1, 11) in rows(table.toDF(), *ALL)
    for bad, error, text in (
        (lambda: t.update({"value": "200"}), ValueError, "cannot be None"),
        (lambda: t.update(condition="a"), ValueError, "cannot be None"),
        (lambda: t.update(set=1), TypeError, "must be a dict"),
        (lambda: t.update(1, {}), TypeError, "must be a Spark SQL Column or a string"),
        (lambda: t.update(set={"value": 1}), TypeError, "Values of dict in .* must contain only"),
        (lambda: t.update(set={1: ""}), TypeError, "Keys of dict in .* must contain only"),
    ):
        with pytest.raises(error, match=text):
            bad()


def test_update_nested(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    t.write(spark.createDataFrame([((("r", "s"), 1), 10), ((("x", "y"), 2), 20)], "a struct<c struct<d string, e string>, g long>, z long"))
    t.update("z = 10", {"a.c.d": "'new'", "a.g": "z * 2"})
    assert rows(t.toDF(), "a.c.d", "a.c.e", "a.g", "z") == [("new", "s", 20, 10), ("x", "y", 2, 20)]
    with pytest.raises(EngineError, match="conflicting"):
        t.update(set={"a.c": "null", "a.c.d": "'q'"})
    with pytest.raises(EngineError, match="not inside a struct"):
        t.update(set={"z.q": "1"})


def test_modes_and_replace_where(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "p int, v string")
    t = Table(spark, f"{tmp_path}/t")
    t.write(df, range_partitions="p")
    with pytest.raises(EngineError):
        t.write(df, "error")
    t.write(df, "ignore")
    t.write(df, "append")
    assert t.toDF().count() == 4
    t.write(spark.createDataFrame([(2, "z")], "p int, v string"), "overwrite", replace_where="p = 2")
    assert rows(t.toDF(), "p", "v") == [(1, "a"), (1, "a"), (2, "z")]
    with pytest.raises(EngineError, match="replaceWhere"):
        t.write(df, "overwrite", replace_where="p = 2")
    with pytest.raises(UnsupportedError):
        t.write(df, "overwrite", replace_where="v = 'a'")
    with pytest.raises(SchemaError):
        t.write(df, "append", range_partitions="v")
    assert rows(read(spark, f"{tmp_path}/t/p=2"), "v") == [("z",)]
    with pytest.raises(NotFoundError):
        Table.forPath(spark, f"{tmp_path}/t/v=2")
    with pytest.raises(NotFoundError):
        Table.forPath(spark, f"{tmp_path}/nothing")
    for odd in ("a b/c", "x%3Ay", "é=1"):
        t.write(spark.createDataFrame([(odd, 1), (odd, 2)], "p string, v int"), "overwrite", overwrite_schema=True)
        t.delete("v = 1")
        assert rows(t.toDF(), "p", "v") == [(odd, 2)]


def test_schema_rules(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    t.write(spark.createDataFrame([(1, "a")], "id int, Name string"))
    t.write(spark.createDataFrame([("b", 2)], "NAME string, ID int"))
    assert rows(t.toDF()) == [(1, "a"), (2, "b")] and t.toDF().columns == ["id", "Name"]
    with pytest.raises(SchemaError, match="new column"):
        t.write(spark.createDataFrame([(1, 2)], "id int, extra int"))
    with pytest.raises(SchemaError):
        t.write(spark.createDataFrame([("x",)], "id string"))
    t.write(spark.createDataFrame([(3, 1.5)], "id int, x double"), merge_schema=True)
    assert (3, None, 1.5) in rows(t.toDF())
    with pytest.raises(SchemaError, match="duplicate"):
        t.write(spark.createDataFrame([(1, 2)], "id int, ID2 int").toDF("id", "ID"))
    t.write(spark.createDataFrame([("k",)], "other string"), "overwrite", overwrite_schema=True)
    assert rows(t.toDF()) == [("k",)]
    t.write(spark.sql("select 'q' as other, null as nothing"))
    assert t.toDF().columns == ["other"]
    with pytest.raises(SchemaError):
        Table(spark, f"{tmp_path}/u").write(spark.createDataFrame([(1,)], "a int"), range_partitions="a")
    with pytest.raises(SchemaError):
        Table(spark, f"{tmp_path}/u").write(spark.createDataFrame([(1, 2)], "a int, b int"), hash_partitions="a")
    old = T.StructType.fromDDL("a tinyint, s struct<x int>, d decimal(10,2)")
    assert schemas.merge_schemas(old, T.StructType.fromDDL("A int, s struct<y string>, z date")).simpleString() == (
        "struct<a:int,s:struct<x:int,y:string>,d:decimal(10,2),z:date>"
    )
    with pytest.raises(SchemaError):
        schemas.merge_schemas(old, T.StructType.fromDDL("d decimal(12,2)"))


def test_constraints(spark, tmp_path, table):
    with pytest.raises(Exception, match="NOT NULL"):
        table.upsert(spark.createDataFrame([(20201101, None, 1)], DDL))
    t = catalog.create_table(spark, f"{tmp_path}/c", "a int not null, s struct<x: int not null>, v int")
    catalog.add_constraint(t, "v", "v > 3")
    t.write(spark.createDataFrame([(1, (1,), 4), (2, None, 5)], "a int, s struct<x int>, v int"))
    assert t.toDF().count() == 2
    for bad in ((None, (1,), 4), (1, (None,), 4), (1, (1,), 3), (1, (1,), None)):
        with pytest.raises(Exception, match="constraint|NOT NULL"):
            t.write(spark.createDataFrame([bad], "a int, s struct<x int>, v int"))
    with pytest.raises(SchemaError):
        t.write(spark.createDataFrame([(4,)], "v int"))
    assert t.toDF().count() == 2


def test_append_only_and_properties(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    t.write(spark.createDataFrame([(1,)], "a int"), properties={"keelstone.appendOnly": "true"})
    for refused in (lambda: t.delete("a = 1"), lambda: t.update(set={"a": "2"}), lambda: t.write(spark.createDataFrame([(1,)], "a int"), "overwrite")):
        with pytest.raises(UnsupportedError):
            refused()
    catalog.unset_properties(t, ["keelstone.appendOnly"])
    t.delete("a = 1")
    with pytest.raises(EngineError):
        catalog.set_properties(t, {"keelstone.nothing": "1"})


def test_services(spark, tmp_path, table, settings):
    (tmp_path / "t" / "abc.txt").write_text("left over")
    assert table.cleanup() == []
    settings("spark.keelstone.cleanup.interval", "0")
    table.delete("value = 1")
    listed = table.cleanup(justList=True)
    assert "abc.txt" in listed and any(p.endswith(".parquet") for p in listed)
    assert table.cleanup() == listed and table.cleanup(True) == [] and table.toDF().count() == 3
    with pytest.raises(NotFoundError):
        table.compaction("range > 0")
    with pytest.raises(NotFoundError):
        table.dropPartition("range > 0")
    table.dropPartition("range = 20201102")
    assert rows(table.toDF(), "hash") == [(2,), (3,)]
    settings("spark.keelstone.deltaFile.max.num", "3")
    version = table.snapshot().version
    table.compaction(force=False)
    assert table.snapshot().version == version
    table.upsert(spark.createDataFrame([(20201101, 2, 5)], DDL))
    table.compaction(force=False)
    assert table.scanKind() == "plain"
    assert Table.isTable(spark, table.path)
    table.dropTable()
    assert not Table.isTable(spark, table.path) and not (tmp_path / "t").exists()


def test_pruning(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    t.write(spark.range(200).selectExpr("cast(id % 4 as int) as p", "id as k", "id as v"), range_partitions="p", hash_partitions="k", bucket_num=5)
    state = t.snapshot()
    assert len(state.files) == 20
    assert len(t._files(state, "p = 1 and v > 3")) == 5
    assert len(t._files(state, "k = 5")) == 4 and len(t._files(state, "p in (1, 2) and 5L = k")) == 2
    assert rows(t.toDF("k = 5"), "v") == [(5,)] and t.toDF("p = 9").count() == 0


def exchanges(df):
    """Shuffles in the plan that ran."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def layered(spark, path, ranges, delta_columns=("k", "p", "v", "w")):
    """A table of 4 buckets with two deltas, and what it holds."""
    base = spark.range(400).selectExpr("cast(id as int) as k", "cast(id % 3 as string) as p", "cast(id as int) as v", "'base' as w")
    t = Table(spark, str(path))
    t.write(base, range_partitions="p" if ranges else None, hash_partitions="k", bucket_num=4)
    t.upsert(base.where("k % 2 = 0").withColumn("v", F.col("v") + 1000).select(*delta_columns))
    t.upsert(base.where("k % 5 = 0").withColumn("k", F.col("k") + 1000).unionByName(base.where("k % 4 = 0")).withColumn("v", F.lit(-1)))
    model = {k: [str(k % 3), k, "base"] for k in range(400)}
    model |= {k: [str(k % 3), k + 1000, "base"] for k in range(0, 400, 2)}
    model |= {k + 1000: [str(k % 3), -1, "base"] for k in range(0, 400, 5)} | {k: [str(k % 3), -1, "base"] for k in range(0, 400, 4)}
    return t, sorted(((k, *x) for k, x in model.items()), key=repr)


@pytest.mark.parametrize("ranges", [False, True], ids=["plain", "ranges"])
@pytest.mark.parametrize("columns", [("k", "p", "v", "w"), ("k", "p", "v")], ids=["rows", "columns"])
def test_merge_on_read_works_inside_buckets(spark, tmp_path, settings, ranges, columns):
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    t, wanted = layered(spark, tmp_path / "t", ranges, columns)
    assert exchanges(t.toDF()) == 0 and rows(t.toDF(), "k", "p", "v", "w") == wanted
    assert exchanges(t.toDF().groupBy("k").count()) == 0
    settings("spark.keelstone.bucket.scan.max.bytes", "1")  # buckets too large for a task: by a shuffle
    assert exchanges(t.toDF()) > 0 and rows(t.toDF(), "k", "p", "v", "w") == wanted


@pytest.mark.parametrize("ranges", [False, True], ids=["plain", "ranges"])
def test_compaction_keeps_buckets_in_place(spark, tmp_path, settings, ranges, monkeypatch):
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    t, wanted = layered(spark, tmp_path / "t", ranges)
    shuffled = []
    from keelstone.sources import files

    plain = files.is_placed
    monkeypatch.setattr(files, "is_placed", lambda *a: shuffled.append(not plain(*a)) or not shuffled[-1])
    t.compaction()
    assert shuffled == [False] and rows(t.toDF(), "k", "p", "v", "w") == wanted
    held = list(t.snapshot().files.values())
    assert len({(f.range_key, f.bucket) for f in held}) == len(held) and all(f.is_base for f in held)


def test_a_write_is_one_shuffle_and_one_file_per_bucket(spark, tmp_path, settings):
    settings("spark.sql.adaptive.coalescePartitions.enabled", "false")
    t = Table(spark, f"{tmp_path}/t")
    data = spark.range(0, 4000, 1, 8).selectExpr("id % 1000 as k", "cast(id % 2 as string) as p", "id as v")
    t.write(data, range_partitions="p", hash_partitions="k", bucket_num=5)
    files = list(t.snapshot().files.values())
    assert len(files) == 10 == len({(f.range_key, f.bucket) for f in files})
    assert rows(t.toDF(), "k", "v") == sorted(((k, k + 3000) for k in range(1000)), key=repr)
    for f in files:
        keys = [r[0] for r in spark.read.parquet(f"{t.path}/{f.path}").select("k").collect()]
        assert keys == sorted(keys)


def test_small_sorted_files_are_swapped_in_one_commit(spark, tmp_path, monkeypatch):
    t = Table(spark, f"{tmp_path}/t")
    data = spark.range(300).selectExpr("id", "cast(id % 2 as string) as p", "timestamp_seconds(id) as ts", "cast(id as decimal(9,2)) as d", "array(struct(id as x)) as n")
    t.write(data, range_partitions="p", properties={"keelstone.sortBy": "ID"})
    for i in range(9):
        t.write(data.where(f"id % 9 = {i}"), "append")
    t.write(data.where("id < 3").withColumn("late", F.lit("x")), "append", merge_schema=True)
    wanted, before = rows(t.toDF()), len(t.snapshot().files)
    with monkeypatch.context() as m:
        m.setattr(Table, "_commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost before the commit")))
        with pytest.raises(RuntimeError):
            t.consolidate(fan_in=3)
    assert len(t.snapshot().files) == before and rows(t.toDF()) == wanted
    t.consolidate(fan_in=3)
    assert rows(t.toDF()) == wanted and len(t.snapshot().files) == 4  # one per partition and list of columns
    for f in t.snapshot().files.values():
        ids = [r[0] for r in spark.read.parquet(f"{t.path}/{f.path}").select("id").collect()]
        assert ids == sorted(ids)
    t.delete("id = 5")
    assert rows(t.toDF()) == [r for r in wanted if 5 not in r[:1]]
    with pytest.raises(SchemaError):
        Table(spark, f"{tmp_path}/u").write(data, properties={"keelstone.sortBy": "zz"})
    with pytest.raises(UnsupportedError):
        keyed(spark, f"{tmp_path}/k", [(1, 2)], "k int, v int", "k").consolidate()


def test_joins_and_set_operations_on_keys_have_no_shuffle(spark, tmp_path, settings):
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    left, wanted = layered(spark, tmp_path / "left", True)
    right = keyed(spark, f"{tmp_path}/right", [(i, f"r{i}") for i in range(100, 1100)], "key int, name string", "key", 4)
    right.upsert(spark.createDataFrame([(i, "late") for i in range(90, 120)], "key int, name string"))
    keys = {r[0] for r in wanted}
    theirs = set(range(90, 1100))
    joined = left.toDF().join(right.toDF(), F.col("k") == F.col("key"))
    assert exchanges(joined) == 0 and {r["k"] for r in joined.collect()} == keys & theirs
    for found, expected in ((left.intersectKeys(right), keys & theirs), (left.exceptKeys(right), keys - theirs), (right.exceptKeys(left), theirs - keys)):
        assert exchanges(found) == 0
        assert sorted(r[0] for r in found.collect()) == sorted(expected)
    settings("spark.keelstone.catalog.dir", f"{tmp_path}/names")
    catalog.register_name(spark, "l", left.path), catalog.register_name(spark, "r", right.path)
    for text, expected, shuffles in (
        ("select k from keel.l intersect select key from keel.r", keys & theirs, 0), ("SELECT `k` FROM keel.l EXCEPT DISTINCT SELECT key FROM keel.r", keys - theirs, 0),
        ("select k + 0 from keel.l except select key from keel.r", keys - theirs, None), ("select p from keel.l intersect select name from keel.r", set(), None),
    ):
        found = catalog.sql(spark, text)
        assert sorted(r[0] for r in found.collect()) == sorted(expected) and (shuffles is None or exchanges(found) == shuffles)
    with pytest.raises(UnsupportedError):
        left.intersectKeys(keyed(spark, f"{tmp_path}/two", [(1, 2)], "a int, b int", "a,b", 2))


def test_merge_of_small_deltas_does_not_shuffle_the_base(spark, tmp_path):
    t = keyed(spark, f"{tmp_path}/t", [(i, i) for i in range(1000)], "k int, v int", "k", 4)
    t.upsert(spark.createDataFrame([(1, 7)], "k int, v int"))
    plan = t.toDF().where("v = 7")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert rows(t.toDF().where("v = 1")) == []  # the old version must not come back


def test_sql_statements(spark, tmp_path, settings):
    settings("spark.keelstone.catalog.dir", f"{tmp_path}/names")
    settings("spark.keelstone.warehouse", f"{tmp_path}/house")
    run = lambda text: catalog.sql(spark, text)
    run("CREATE TABLE keel.t (a INT, b STRING COMMENT 'x', p INT) USING parquet PARTITIONED BY (p) TBLPROPERTIES ('note' = 'n')")
    run("create table if not exists keel.t (z int)")
    run("insert into keel.t values (1, 'x', 1), (2, 'y', 2)")
    run("insert overwrite keel.t partition (p = 2) select 3, 'z'")
    assert rows(run("select a, b, p from keel.t")) == [(1, "x", 1), (3, "z", 2)]
    run("alter table keel.t add columns (c double after a, d struct<e: int>)")
    run("alter table keel.t add columns (d.f string)")
    run("alter table keel.t alter column c comment 'price'")
    run("alter table keel.t change column b b string first")
    run("update keel.t set c = 2.5 where a = 3")
    run("delete from keel.t where a = 1")
    assert rows(run(f"select b, a, c, d, p from keel.`{Table.forName(spark, 't').path}`")) == [("z", 3, 2.5, None, 2)]
    assert Table.forName(spark, "t").meta.struct.names[:3] == ["b", "a", "c"]
    described = {r["col_name"]: r for r in run("describe keel.t").collect()}
    assert described["c"]["comment"] == "price" and described["d"]["data_type"] == "struct<e:int,f:string>"
    for refused in ("alter table keel.t rename to keel.u", "create table keel.u like keel.t", "replace table keel.t (a int)",
                    "alter table keel.t add partition (p = 3)", "create table keel.w (a int) clustered by (a) into 2 buckets"):
        with pytest.raises(UnsupportedError):
            run(refused)
    for bad in ("alter table keel.t change column a q int", "alter table keel.t change column a a string", "alter table keel.t add columns (n int not null)",
                "alter table keel.t add columns (A int)"):
        with pytest.raises(SchemaError):
            run(bad)
    run("create table keel.copy tblproperties ('hashPartitions' = 'a', 'hashBucketNum' = '2') as select a, b from keel.t")
    assert Table.forName(spark, "copy").meta.hash_columns == ["a"]
    writer = catalog.write_to(spark, spark.createDataFrame([("q", 9, 1.0, None, 7)], "b string, a int, c double, d struct<e: int, f: string>, p int"), "t")
    writer.append()
    writer.overwrite("p = 7")
    with pytest.raises(UnsupportedError):
        writer.overwritePartitions()
    assert run("select * from keel.t").count() == 2
    run("drop table keel.t")
    with pytest.raises(NotFoundError):
        run("select * from keel.t")
    run("drop table if exists keel.t")


def test_sql_text_is_read_as_tokens(spark, tmp_path, settings):
    settings("spark.keelstone.catalog.dir", f"{tmp_path}/names")
    settings("spark.keelstone.warehouse", f"{tmp_path}/house")
    run = lambda text: catalog.sql(spark, text)
    run("create table keel.t (k int comment 'it''s (a) key', v string, `where` int) tblproperties ('hashPartitions'='k', 'hashBucketNum'='2', 'note'='x, (y) = z')")
    assert Table.forName(spark, "t").meta.properties["note"] == "x, (y) = z"
    run("insert into keel.t (k, v) values (1, 'a where b'), (2, 'keel.t')")
    run("insert into keel.t (`where`, v, k) select 7, 'x', 3  -- from keel.none")
    run("insert into keel.t by name select 'n' as v, 4 as k, 1 as `where`")
    assert rows(run("select k, v, `where` from keel.t")) == [(1, "a where b", None), (2, "keel.t", None), (3, "x", 7), (4, "n", 1)]
    assert run("select 'keel.tt' as x, \"keel.tt\" as y from keel.t limit 1").first() == ("keel.tt", "keel.tt")
    assert run("select /* keel.none */ count(*) as n from keel . `t` -- keel.none").first()["n"] == 4
    run("update keel.t as t set t.v = 'x where y, z = 1', `where` = 5 where t.k = 1 and v = 'a where b'")
    run("delete from keel.t x where x.v = 'keel.t' or x.v = 'a'")
    assert rows(run("select k, v, `where` from keel.t")) == [(1, "x where y, z = 1", 5), (3, "x", 7), (4, "n", 1)]
    run("create table keel.p (k int, p string) partitioned by (p)")
    run("insert into keel.p partition (p = 'it''s') values (1)")
    run("insert overwrite keel.p partition (P = \"it's\") (k) values (2)")
    assert rows(run("select k, p from keel.p")) == [(2, "it's")]
    for bad in ("insert into keel.t (k, k) values (1, 2)", "insert into keel.t (k, v) values (1)"):
        with pytest.raises(SchemaError):
            run(bad)
    with pytest.raises(NotFoundError):
        run("insert into keel.t (k, w) values (1, 2)")
    run("create table keel.c (k int, n int) tblproperties ('hashPartitions'='k', 'hashBucketNum'='2')")
    run("insert into keel.c values (1, 10), (2, 20)")
    run("insert into keel.c values (1, 5)")
    assert rows(run("select c.k, merge_sum(n) as n from keel.c as c")) == [(1, 15), (2, 20)]
    assert rows(run("select k, n from keel.c")) == [(1, 5), (2, 20)]
    with pytest.raises(EngineError):
        run("select merge_sum(n), merge_last(n) from keel.c")
    with pytest.raises(EngineError):
        run("select merge_sum(zz) from keel.c")


def test_tables_without_location_outlast_the_session(spark, tmp_path, settings):
    from keelstone.session import shared_root, warehouse

    settings("spark.keelstone.warehouse", f"{tmp_path}/house")
    catalog.sql(spark, "create table keel.lasting (k int)")
    assert Table.forName(spark, "lasting").path == f"file://{tmp_path}/house/lasting"
    assert list((tmp_path / "house" / "_names").glob("lasting.json"))
    spark.conf.unset("spark.keelstone.warehouse")
    assert not warehouse(spark).startswith(shared_root(spark))


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from keelstone.session import shared_root

    none = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("yarn", "spark://x:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_root(SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master=master)))


# concurrency -----------------------------------------------------------------------------------------------------------


def test_commit_rules(spark, table):
    from keelstone.sources.log import COMPACTION, DELTA, SIMPLE, CommitLog

    state = table.snapshot()
    some = next(iter(state.files.values()))
    raw = lambda f, path: f.__dict__ | {"path": path, "columns": list(f.columns), "order": 0}
    other = CommitLog(spark, table.path)
    other.commit(other.snapshot(), {"kind": DELTA, "add": [raw(some, "data/x1")]})
    table.log.commit(state, {"kind": DELTA, "add": [raw(some, "data/x2")]})  # deltas do not conflict
    after = table.log.commit(state, {"kind": COMPACTION, "add": [raw(some, "data/b") | {"order": some.order}], "expire": [some.path]}, [some.path])
    assert after.partitions[some.range_key].deltas == 2 and not after.partitions[some.range_key].compacted
    with pytest.raises(ConflictError, match="gone"):
        table.log.commit(state, {"kind": COMPACTION, "expire": [some.path]}, [some.path])
    with pytest.raises(ConflictError, match="appeared"):
        table.log.commit(state, {"kind": SIMPLE, "expire": []}, [])
    meta = {**table.meta.__dict__, "comment": "changed"}
    table.log.commit(table.snapshot(), {"kind": SIMPLE, "meta": meta, "blind": True})
    with pytest.raises(ConflictError, match="schema"):
        table.log.commit(after, {"kind": DELTA, "add": [raw(some, "data/x3")]})


def test_concurrent_upserts_all_count(spark, table):
    failures = []

    def work(n):
        try:
            Table(spark, table.path).upsert(spark.createDataFrame([(20201101, 100 + n, n)], DDL))
        except Exception as e:  # noqa: BLE001
            failures.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failures and table.toDF("hash >= 100").count() == 3


def test_log_of_many_commits_and_many_partitions(spark, tmp_path):
    import time

    from keelstone.sources.log import CHECKPOINT_EVERY, DELTA, SIMPLE, CommitLog, Meta

    log = CommitLog(spark, f"file://{tmp_path}/t")
    raw = lambda p, i: {"path": f"data/{i}/p={p}", "range_key": f"p={p}", "range_values": {"p": str(p)}, "bucket": 0, "size": 1, "columns": ["a"]}
    began = time.time()
    log.commit(log.snapshot(), {"kind": SIMPLE, "meta": Meta("t", "{}").__dict__, "add": [raw(p, 0) for p in range(100_000)]})
    log.commit(log.snapshot(), {"kind": DELTA, "add": [raw(p, 1) for p in range(100_000)]})
    assert time.time() - began < 20  # both together take a few seconds; work in proportion to partitions x files would take hours
    for i in range(2, 2 * CHECKPOINT_EVERY + 3):
        log.commit(log.snapshot(), {"kind": DELTA, "add": [raw(7, i)]})
    assert len(list((tmp_path / "t" / "_log").glob("*.checkpoint"))) == 1  # the few later changes are not worth another state of 200,000 files
    reads = []
    fresh = CommitLog(spark, f"file://{tmp_path}/t")
    fresh._read = lambda name: reads.append(name) or CommitLog._read(fresh, name)
    assert fresh.snapshot() == log.snapshot() and len(reads) == 5  # the state, a batch and three commits
    held = fresh.snapshot()
    log.commit(log.snapshot(), {"kind": SIMPLE, "expire": ["data/1/p=7"], "touched": ["p=7"]})
    assert "data/1/p=7" in held.files and "data/1/p=7" not in fresh.snapshot().files
    assert fresh.snapshot().partitions["p=7"].deltas == log.snapshot().partitions["p=7"].deltas


def test_log_through_hadoops_file_system(spark, tmp_path):
    """The way that is taken off local disks: the same commits, the same state, and no commit overwrites another."""
    from keelstone.sources.log import CHECKPOINT_EVERY, DELTA, SIMPLE, CommitLog, Meta

    def remote():
        log = CommitLog(spark, f"file://{tmp_path}/t")
        log._local = None
        return log

    raw = lambda i: {"path": f"data/{i}/x", "range_key": "-5", "range_values": {}, "bucket": -1, "size": 1, "columns": ["a"]}
    one, two = remote(), remote()
    assert one.snapshot().meta is None
    one.commit(one.snapshot(), {"kind": SIMPLE, "meta": Meta("t", "{}").__dict__, "add": [raw(0)]})
    stale = two.snapshot()
    one.commit(one.snapshot(), {"kind": DELTA, "add": [raw(1)]})
    two.commit(stale, {"kind": DELTA, "add": [raw(2)]})  # finds its number taken, and goes on
    for i in range(3, CHECKPOINT_EVERY + 2):
        one.commit(one.snapshot(), {"kind": DELTA, "add": [raw(i)]})
    assert not one._create(f"{1:020d}.json", "other") and "data/1/x" in one._read(f"{1:020d}.json")
    local = CommitLog(spark, f"file://{tmp_path}/t")
    assert remote().snapshot() == local.snapshot() and len(local.snapshot().files) == CHECKPOINT_EVERY + 2
    with pytest.raises(ConflictError):
        two.commit(stale, {"kind": SIMPLE, "expire": ["data/none"]}, ["data/none"])


def test_log_checkpoint_and_replay(spark, tmp_path):
    from keelstone.sources.log import CHECKPOINT_EVERY, CommitLog, Snapshot

    t = Table(spark, f"{tmp_path}/t")
    t.write(spark.createDataFrame([(1,)], "a int"))
    for i in range(CHECKPOINT_EVERY + 2):
        catalog.set_properties(t, {"n": str(i)})
    fresh = CommitLog(spark, t.path).snapshot()
    assert fresh == t.snapshot() and fresh.meta.properties["n"] == str(CHECKPOINT_EVERY + 1)
    assert Snapshot.from_json(fresh.to_json()) == fresh
    assert list((tmp_path / "t" / "_log").glob("*.checkpoint"))
