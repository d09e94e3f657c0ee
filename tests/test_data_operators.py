"""The metadata operators against plain recomputation on small, awkward inputs."""

import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from keelstone.functions.metadata import file_name, is_reference, month_of
from keelstone.operators.drift import compare_entries, read_unified, schema_changes, schema_entries
from keelstone.operators.incremental import StateConflict, StateStore
from keelstone.operators.orphans import orphan_references
from keelstone.operators.skew import chunked_aggregate, heavy_keys, largest_gap, replicate_for_salt, running_total, salt_of
from keelstone.operators.sorted_runs import merge_blocks, merge_sorted_files, plan_merges
from keelstone.session import scratch_path


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 4: exact offset chunking


def skewed(spark):
    data = [("hot", i, i * 2) for i in range(700)] + [(None, i, None) for i in range(50)] + [("", i, 1) for i in range(5)]
    data += [(f"k{i % 40}", i, i) for i in range(300)] + [("hot", 3, 6)] * 4
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, "key string, at int, weight long"), data


def test_running_total_is_exact_per_key(spark):
    df, data = skewed(spark)
    found = running_total(df.repartition(7).withColumn("_k", F.lit(1)), ["key"], ["at"], "weight", "upto").collect()
    assert len(found) == len(data)
    totals = {}
    for k, _, w in data:
        totals[k] = totals.get(k, 0) + (w or 0)
    last = {}
    for r in sorted(found, key=lambda r: r["upto"]):
        last[r["key"]] = r["upto"]
    assert last == totals
    numbers = sorted(r["row_no"] for r in running_total(df, ["key"], ["at"]).where("key = 'hot'").collect())
    assert numbers == list(range(1, 705))


def test_running_total_of_nothing_and_replaced_column(spark):
    empty = spark.createDataFrame([], "key string, at int, weight long")
    assert running_total(empty, ["key"], ["at"], "weight").count() == 0
    one = spark.createDataFrame([("a", 1, 7)], "key string, at int, row_no long")
    assert running_total(one, ["key"], ["at"]).first()["row_no"] == 1


@pytest.mark.parametrize("chunk_rows", [1, 64, 100_000])
def test_chunked_aggregate_matches_group_by(spark, chunk_rows):
    df, _ = skewed(spark)
    df = df.withColumn("_k0", F.lit("clash")).withColumn("part", F.pmod("at", F.lit(5)))
    states = {"total": F.sum("weight"), "top": F.max("at")}
    merges = {"total": F.sum("total"), "top": F.max("top")}
    found = chunked_aggregate(df, "key", F.col("part"), F.col("at"), states, merges, chunk_rows)
    wanted = df.groupBy("key").agg(F.count(F.lit(1)), F.sum("weight"), F.max("at"))
    assert rows(found.select("key", "rows", "total", "top")) == rows(wanted)
    chunks = {r["key"]: r["chunks"] for r in found.collect()}
    assert chunks["hot"] == -(-704 // chunk_rows)
    assert chunked_aggregate(df.limit(0), "key", F.col("part"), F.col("at"), states, merges).count() == 0


@pytest.mark.parametrize("chunk_rows", [1, 7, 100_000])
def test_largest_gap_over_chunk_borders(spark, chunk_rows):
    rng = random.Random(6)
    data = [("hot", rng.randrange(10**6)) for _ in range(300)] + [("one", 5), (None, 3), (None, 90), ("nulls", None), ("same", 4), ("same", 4)]
    df = spark.createDataFrame(data, "key string, v long").withColumn("chunk", F.lit("x"))
    wanted = []
    for k in {k for k, v in data if v is not None}:
        own = sorted(v for x, v in data if x == k and v is not None)
        wanted.append((k, len(own), own[0], own[-1], max((b - a for a, b in zip(own, own[1:])), default=None)))
    assert rows(largest_gap(df, "key", "v", chunk_rows)) == sorted(wanted, key=repr)
    assert largest_gap(df.limit(0), "key", "v").count() == 0


def test_heavy_keys_and_salting(spark):
    df, _ = skewed(spark)
    heavy = heavy_keys(df, ["key"], 0.1)
    assert heavy == [("hot",)]
    left = df.where("key is not null").withColumn("_salt", salt_of([F.col("key")], [F.col("at")], heavy, 4))
    right = replicate_for_salt(spark.createDataFrame([("hot", 1), ("k1", 2), ("zz", 3)], "key string, x int"), ["key"], heavy, 4)
    assert left.where("key = 'hot'").select("_salt").distinct().count() == 4
    joined = left.join(right, ["key", "_salt"])
    assert joined.where("key = 'hot'").count() == 704 and joined.where("key = 'k1'").count() == 8
    assert heavy_keys(df.limit(0), ["key"]) == []


# 1: new or changed records


def test_state_reports_changes_once(spark):
    store = StateStore(spark, scratch_path(spark, "state"), ["id"])
    first = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (None, "n", "x"), (3, "", "x")], "id int, v string, _h1 string")
    assert rows(store.process(first, ["v"], "run1").select("id", "v")) == rows(first.select("id", "v"))
    assert store.process(first, ["v"], "run2").count() == 0
    second = spark.createDataFrame([(1, "a"), (2, ""), (None, "n"), (4, "new")], "id int, v string")
    version = store.run(second, ["v"], "run3")
    assert rows(store.changes(version)) == [(2, "changed"), (3, "removed"), (4, "added")]
    again = store.run(second.limit(0), ["v"], "run3")  # the same run, delivered again
    assert again == version and store.current() == version
    assert rows(store.changes(store.run(second.limit(0), ["v"], "run4"))) == [(1, "removed"), (2, "removed"), (4, "removed"), (None, "removed")]
    assert store.process(second, ["v"], "run5").count() == 4


def test_repeated_rows_are_a_set(spark):
    store = StateStore(spark, scratch_path(spark, "state"), ["id"])
    store.run(spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string"), ["v"], "r1")
    same = store.run(spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "id int, v string"), ["v"], "r2")
    assert store.changes(same).count() == 0
    other = store.run(spark.createDataFrame([(1, "b"), (1, "c")], "id int, v string"), ["v"], "r3")
    assert rows(store.changes(other)) == [(1, "changed")]


NEAR = [
    ("array<string>", [["a", "b"], ["a, b"], ["a"], ["a", None], [None, "a"], [], None, [None], ["ab"], ["", "ab"]]),
    ("array<array<int>>", [[[1], [2]], [[1, 2]], [[1, 2], []], [[], [1, 2]], [[1, 2], None], [None, [1, 2]], [[1], [None], [2]]]),
    ("struct<x:string,y:string>", [("a", None), (None, "a"), (None, None), None, ("a", ""), ("", "a"), ("null", None)]),
    ("map<int,string>", [{1: "a", 2: "b"}, {1: "b", 2: "a"}, {1: "a"}, {1: None}, {}, None, {12: "a"}, {1: "a, 2 -> b"}]),
    ("map<string,array<map<string,int>>>", [{"a": [{"x": 1}]}, {"a": [{"x": 1}, {}]}, {"a": [{"x": None}]}, {"a": []}, {"a": [None]}]),
    ("string", ["1", "01", " 1", "", None, "null"]),
    ("binary", [b"", b"\0", b"\0\0", None]),
    ("decimal(20,2)", [None, 0, 1, 100]),
]


@pytest.mark.parametrize("kind, values", NEAR, ids=[k for k, _ in NEAR])
def test_near_equal_contents_have_different_hashes(spark, kind, values):
    from decimal import Decimal

    values = [Decimal(v) if kind.startswith("decimal") and v is not None else v for v in values]
    df = spark.createDataFrame(list(enumerate(values)), f"id int, `v.x` {kind}")
    hashes = StateStore(spark, scratch_path(spark, "state"), ["id"]).hashed(df, ["v.x"]).collect()
    for h in ("_h1", "_h2"):
        assert len({r[h] for r in hashes}) == len(values)


def test_maps_in_another_order_and_other_zones_are_unchanged(spark, settings):
    store = StateStore(spark, scratch_path(spark, "state"), ["id"])
    rows_of = "select id, map_from_arrays({keys}, {values}) as m, timestamp_micros(id * 1000003) as t, `f` from (select id, double({zero}) as f from range(50))"
    store.run(spark.sql(rows_of.format(keys="array('a','b')", values="array(1,2)", zero="0.0")), ["m", "t", "f"], "r1")
    settings("spark.sql.session.timeZone", "Asia/Tokyo")
    same = store.run(spark.sql(rows_of.format(keys="array('b','a')", values="array(2,1)", zero="-0.0")), ["m", "t", "f"], "r2")
    assert store.changes(same).count() == 0


def test_many_near_equal_rows_are_all_found(spark):
    """Every one of 100,000 rows is changed a little: an element moves, a null appears, a border shifts."""
    store = StateStore(spark, scratch_path(spark, "state"), ["id"])
    before = "select id, array(string(id % 10), string(id % 7)) as a, named_struct('x', string(id % 3), 'y', cast(null as string)) as s from range(100000)"
    after = """select id,
      case id % 4 when 0 then reverse(array(string(id % 10), string(id % 7))) when 1 then array(concat(id % 10, ', ', id % 7))
                  when 2 then array(string(id % 10), string(id % 7), null) else array(string(id % 10), string(id % 7)) end as a,
      case when id % 4 = 3 then named_struct('x', cast(null as string), 'y', string(id % 3)) else named_struct('x', string(id % 3), 'y', cast(null as string)) end as s
      from range(100000)"""
    store.run(spark.sql(before), ["a", "s"], "r1")
    same = spark.sql("select count(*) from range(100000) where id % 4 = 0 and id % 10 = id % 7").first()[0]
    assert store.changes(store.run(spark.sql(after), ["a", "s"], "r2")).where("_kind = 'changed'").count() == 100_000 - same


def test_state_outlives_the_store_and_a_crash(spark, tmp_path, monkeypatch):
    """Two runs by different stores over one lasting folder, with a crash before and one after the commit between them."""
    first = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "`k.1` int, v array<string>")
    second = spark.createDataFrame([(1, ["a, b"]), (2, ["c"]), (3, None)], "`k.1` int, v array<string>")
    path = f"file://{tmp_path}/state"
    assert StateStore(spark, path, ["k.1"]).process(first, ["v"], "monday").count() == 2
    with monkeypatch.context() as m:
        m.setattr(StateStore, "_swap", lambda *_: (_ for _ in ()).throw(RuntimeError("lost before the swap")))
        with pytest.raises(RuntimeError):
            StateStore(spark, path, ["k.1"]).process(second, ["v"], "tuesday")
    assert StateStore(spark, path, ["k.1"]).current().number == 1
    StateStore(spark, path, ["k.1"]).run(second, ["v"], "tuesday")  # committed, but the answer never arrives
    again = StateStore(spark, path, ["k.1"]).process(second, ["v"], "tuesday")
    assert rows(again) == [(1, ["a, b"]), (3, None)]
    assert StateStore(spark, path, ["k.1"]).process(second, ["v"], "wednesday").count() == 0
    with pytest.raises(ValueError):
        StateStore(spark, path, ["_kind"])


def test_failed_run_leaves_the_old_state(spark, monkeypatch):
    store = StateStore(spark, scratch_path(spark, "state"), ["id"])
    store.run(spark.createDataFrame([(1, "a")], "id int, v string"), ["v"], "r1")
    new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    with monkeypatch.context() as m:
        m.setattr(StateStore, "_swap", lambda *_: (_ for _ in ()).throw(RuntimeError("crash before the swap")))
        with pytest.raises(RuntimeError):
            store.run(new, ["v"], "r2")
    assert store.current().run_id == "r1"
    assert rows(store.changes(store.run(new, ["v"], "r2"))) == [(2, "added")]
    with pytest.raises(StateConflict):
        store._swap(store.current())
    assert StateStore(spark, scratch_path(spark, "none"), ["id"]).current() is None


# 2: small files


def test_plan_rolls_by_bytes_and_skips_unknown_sizes(spark):
    files = [("p", f"f{i:02d}", 1, 10) for i in range(9)] + [("p", "big", 1, 999), ("p", "none", 1, None), ("p", "zero", 1, 0), ("p", "neg", 1, -1)]
    files += [("q", f"f{i}", 1, 10) for i in range(7)] + [("q", "x", 1, None)]
    df = spark.createDataFrame(files, "part string, name string, v int, size long")
    plan = plan_merges(df, ["part"], ["v", "name"], small_bytes=100, min_files=8, target_bytes=40)
    found = rows(plan.select("part", "output_no", "files", "bytes"))
    assert found == [("p", 0, 4, 40), ("p", 1, 4, 40), ("p", 2, 1, 10)]
    assert plan_merges(df.limit(0), ["part"], ["v", "name"]).count() == 0


def _write_runs(folder, runs):
    paths = []
    for i, keys in enumerate(runs):
        path = f"{folder}/run{i}.parquet"
        nested = pa.array([[("a", k)] for k in keys], pa.map_(pa.string(), pa.int64()))
        table = pa.table({"m": nested, "key": pa.array(keys, pa.int64()), "run": pa.array([i] * len(keys), pa.int64()), "at": pa.array(range(len(keys)), pa.int64())})
        pq.write_table(table, path, row_group_size=50)
        paths.append(path)
    return paths


@pytest.mark.parametrize("target", [1500, 10_000_000])
def test_sorted_runs_merge_without_loss(spark, tmp_path, target):
    rng = random.Random(3)
    runs = [sorted(rng.choice([7, rng.randrange(100)]) for _ in range(n)) for n in (0, 1, 60, 333, 120, 200)]
    paths = _write_runs(tmp_path, runs)
    meta = merge_sorted_files(spark, paths, "key", f"{tmp_path}/out", target_bytes=target, block_rows=16).orderBy("lo", "hi").collect()
    seen, end = [], None
    for m in meta:
        table = pq.read_table(m["path"].replace("file://", ""))
        keys = table.column("key").to_pylist()
        assert keys == sorted(keys) and (keys[0], keys[-1], len(keys)) == (m["lo"], m["hi"], m["rows"])
        assert end is None or m["lo"] >= end
        end = m["hi"]
        seen += list(zip(keys, table.column("run").to_pylist(), table.column("at").to_pylist()))
    wanted = [(k, r, i) for r, keys in enumerate(runs) for i, k in enumerate(keys)]
    assert sorted(seen) == sorted(wanted)
    assert len(meta) == 1 if target > 1e6 else len(meta) > 1


def test_merge_is_stable_and_refuses_null_keys(spark, tmp_path):
    blocks = lambda *parts: iter([pa.table({"key": p, "v": [f"{p[0]}-{i}" for i in range(len(p))]}) for p in parts])
    merged = pa.concat_tables(merge_blocks([blocks([1, 2, 2], [2, 5]), blocks([2, 2, 3]), blocks([9])], "key"))
    assert merged.column("key").to_pylist() == [1, 2, 2, 2, 2, 2, 3, 5, 9]
    pq.write_table(pa.table({"key": pa.array([None, 1], pa.int64())}), f"{tmp_path}/null.parquet")
    with pytest.raises(ValueError, match="nulls"):
        merge_sorted_files(spark, [f"{tmp_path}/null.parquet"], "key", f"{tmp_path}/out")
    with pytest.raises(ValueError, match="no files"):
        merge_sorted_files(spark, [], "key", f"{tmp_path}/out")


def test_merge_keeps_nan_keys(spark, tmp_path):
    nan, rng = float("nan"), random.Random(5)
    runs = [sorted(rng.random() for _ in range(300)) + [nan] * n for n in (0, 3, 40)] + [[nan] * 5]
    paths = [f"{tmp_path}/run{i}.parquet" for i in range(len(runs))]
    for path, keys in zip(paths, runs):
        pq.write_table(pa.table({"key": pa.array(keys, pa.float64())}), path, row_group_size=50)
    meta = merge_sorted_files(spark, paths, "key", f"{tmp_path}/out", target_bytes=3_000, block_rows=64).collect()
    found = [pq.read_table(m["path"].replace("file://", "")).column("key").to_pylist() for m in meta]
    place = lambda k: (k != k, 0 if k != k else k)
    assert len(meta) > 1 and sum(m["rows"] for m in meta) == sum(map(len, runs))
    assert all([*map(place, keys)] == sorted(map(place, keys)) for keys in found)
    assert sorted(place(k) for keys in found for k in keys) == sorted(place(k) for keys in runs for k in keys)


def test_merge_keeps_run_order_across_blocks():
    runs = [iter([pa.table({"key": k, "run": [r] * len(k)}) for k in blocks]) for r, blocks in enumerate(([[1, 2], [2, 2]], [[2, 2], [2, 3]]))]
    merged = pa.concat_tables(merge_blocks(runs, "key"))
    assert list(zip(*merged.to_pydict().values())) == [(1, 0), (2, 0), (2, 0), (2, 0), (2, 1), (2, 1), (2, 1), (3, 1)]


def test_merge_of_many_runs_in_passes_with_even_ranges(spark, tmp_path):
    rng = random.Random(7)
    runs = [sorted([0, *(rng.choice([500, rng.randrange(1, 1000)]) for _ in range(38)), 1000]) for _ in range(37)]
    paths = _write_runs(tmp_path, runs)
    size = sum(pq.read_metadata(p).row_group(0).total_byte_size for p in paths)
    meta = merge_sorted_files(spark, paths, "key", f"{tmp_path}/out", target_bytes=size // 10, block_rows=256, fan_in=4).collect()
    of_task = {}
    for m in sorted(meta, key=lambda m: m["path"]):
        task = m["path"].rsplit("/", 1)[1].split("-")[1]
        of_task[task] = of_task.get(task, 0) + m["rows"]
    files = [pq.read_table(m["path"].replace("file://", "")) for m in meta]
    files = [[*zip(*(t.column(c).to_pylist() for c in ("key", "run", "at")))] for t in files]
    found = [row for rows_of_file in sorted(files) for row in rows_of_file]
    hot = sum(keys.count(500) for keys in runs)
    assert found == sorted((k, r, i) for r, keys in enumerate(runs) for i, k in enumerate(keys))
    assert len(of_task) >= 4 and max(of_task.values()) < hot + len(found) / 5


def test_merge_of_groups_given_as_a_table(spark, tmp_path):
    rng = random.Random(11)
    runs = [sorted(rng.choice([3, rng.randrange(500)]) for _ in range(rng.randrange(1, 40))) for _ in range(50)]
    paths = _write_runs(tmp_path, runs)
    group = lambda i: f"p={i % 3}" if i else "p=once"
    files = spark.createDataFrame([(p, group(i), i, "x") for i, p in enumerate(paths)], "path string, g string, i int, run string")
    meta = merge_sorted_files(spark, files, "key", f"{tmp_path}/out", block_rows=64, fan_in=4, group="g", order_by=["i"]).collect()
    assert {m["grp"] for m in meta} == {"p=0", "p=1", "p=2", "p=once"} and len(meta) == 4
    for m in meta:
        assert f"/out/{m['grp']}/" in m["path"]
        table = pq.ParquetFile(m["path"].replace("file://", "")).read()
        found = list(zip(*(table.column(c).to_pylist() for c in ("key", "run", "at"))))
        assert found == sorted((k, r, i) for r, keys in enumerate(runs) if group(r) == m["grp"] for i, k in enumerate(keys))
    assert merge_sorted_files(spark, files.limit(0), "key", f"{tmp_path}/out").count() == 0


def test_merge_refuses_runs_that_are_not_sorted(spark, tmp_path):
    pq.write_table(pa.table({"key": [1, 3, 2]}), f"{tmp_path}/a.parquet")
    with pytest.raises(Exception, match="not sorted"):
        merge_sorted_files(spark, [f"{tmp_path}/a.parquet"], "key", f"{tmp_path}/out")


def test_merged_row_groups_are_large_and_ranges_even(spark, tmp_path):
    rng = random.Random(13)
    paths = []
    for i in range(40):  # every run spans the whole key space
        keys = sorted(rng.randrange(10**6) for _ in range(8_000))
        paths.append(f"{tmp_path}/{i}.parquet")
        pq.write_table(pa.table({"key": keys, "text": [f"{k:x}" * 12 for k in keys]}), paths[-1], row_group_size=500)
    size = sum(pq.read_metadata(p).row_group(g).total_byte_size for p in paths for g in range(16))
    meta = merge_sorted_files(spark, paths, "key", f"{tmp_path}/out", target_bytes=size // 6).collect()
    assert sum(m["rows"] for m in meta) == 320_000 and max(m["rows"] for m in meta) < 2 * 320_000 / 6
    for m in meta:
        file = pq.ParquetFile(m["path"].replace("file://", ""))
        assert all(file.read_row_group(g).nbytes >= 2**20 for g in range(file.num_row_groups - 1)) and file.num_row_groups < 4


# 3: drifting schemas


def schema(*fields):
    out = []
    for f in fields:
        name, kind, *rest = f
        out.append({"name": name, "type": kind, "nullable": True, "metadata": {"id": rest[0]} if rest else {"comment": "c"}})
    return {"type": "struct", "fields": out}


def changes(old, new):
    return sorted(compare_entries(schema_entries(old), schema_entries(new)))


def test_schema_rules():
    inner = schema(("x", "long"), ("y", "string"))
    assert changes(schema(("a", "int"), ("B", "string")), schema(("b", "string"), ("A", "integer"))) == []
    assert changes(schema(("a", "int")), schema(("a", "bigint"), ("c", "date"))) == [("added", "c"), ("retyped", "a")]
    assert changes(schema(("a", "int"), ("b", "date")), schema(("a", "int"), ("z", "date"))) == [("renamed", "z")]
    assert changes(schema(("a", "int"), ("b", "date")), schema(("a", "int"), ("z", "long"))) == [("added", "z"), ("removed", "b")]
    assert changes(schema(("s", inner)), schema(("t", inner))) == [("added", "t"), ("removed", "s")]
    assert changes(schema(("s", inner)), schema(("s", schema(("x", "int"), ("w", "string"))))) == [("renamed", "s.w"), ("retyped", "s.x")]
    assert changes(schema(("s", inner)), schema(("s", "string"))) == [("retyped", "s")]
    assert changes(schema(("a", "int", 1), ("b", "date", 2)), schema(("b", "date", 1), ("q", "long", 2), ("n", "int", 3))) == [
        ("added", "n"), ("renamed", "b"), ("renamed", "q"), ("retyped", "b"), ("retyped", "q"),
    ]
    arrays = [{"type": "array", "elementType": k, "containsNull": n} for k, n in (("long", True), ("bigint", False), ("int", True))]
    assert changes(schema(("a", arrays[0])), schema(("a", arrays[1]))) == []
    assert changes(schema(("a", arrays[0])), schema(("a", arrays[2]))) == [("retyped", "a")]


def test_schema_changes_over_versions(spark):
    texts = [json.dumps(schema(("a", "int")), indent=2), json.dumps(schema(("a", "int"), ("b", "int"))), "{broken \"type\"", None, json.dumps(schema(("a", "long")))]
    data = [("t", f"c{i}", i, s) for i, s in enumerate(texts)] + [("u", "c", 1, texts[0])]
    df = spark.createDataFrame(data, "table_id string, commit_id string, v int, s string")
    assert rows(schema_changes(df, "table_id", ["v"], "commit_id", "s")) == [("t", "c1", "added", "b")]
    assert schema_changes(df.limit(0), "table_id", ["v"], "commit_id", "s").count() == 0


def test_unreadable_schemas_hide_no_change(spark):
    texts = [json.dumps(schema(("a", "int"))), "{broken", "[]", json.dumps(schema(("a", "long"))), "", json.dumps(schema(("a", "long"), ("b", "int")))]
    df = spark.createDataFrame([("t", f"c{i}", i, s) for i, s in enumerate(texts)], "table_id string, commit_id string, v int, s string")
    found = rows(schema_changes(df, "table_id", ["v"], "commit_id", "s", skip_unreadable=True))
    assert found == [("t", "c3", "retyped", "a"), ("t", "c5", "added", "b")]


def test_files_of_drifting_schemas_read_as_one_table(spark, tmp_path):
    spark.createDataFrame([(1, "7", 1.5)], "id int, n string, x double").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(2, 8, "q", [1])], "ID long, n int, extra string, tags array<int>").write.parquet(f"{tmp_path}/b")
    spark.createDataFrame([(None, "bad")], "id int, n string").write.parquet(f"{tmp_path}/c")
    unified = read_unified(spark, [f"{tmp_path}/{x}" for x in "abc"], {"n": "int"})
    found = {(r["id"], r["n"], r["x"], r["extra"], tuple(r["tags"] or ()), tuple(map(tuple, r["failed_casts"]))) for r in unified.collect()}
    assert found == {(1, 7, 1.5, None, (), ()), (2, 8, None, "q", (1,), ()), (None, None, None, None, (), (("n", "string", "bad"),))}


def test_unified_table_keeps_columns_without_values(spark, tmp_path):
    spark.createDataFrame([(1, None)], "id int, empty date").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(2, "x")], "id long, other string").write.parquet(f"{tmp_path}/b")
    unified = read_unified(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert dict(unified.dtypes)["empty"] == "date" and dict(unified.dtypes)["id"] == "bigint"
    assert rows(unified.select("id", "empty", "other")) == [(1, None, None), (2, None, "x")]


def test_unified_table_changes_no_value_silently(spark, tmp_path):
    longs = [(1, 2**53 + 1, bytearray(b"a\xff")), (2, 2**62, None), (3, 2**63 - 1, bytearray(b"")), (4, -(2**63), None)]
    spark.createDataFrame(longs, "id int, n long, b binary").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(5, 0.5)], "id int, n double").write.parquet(f"{tmp_path}/b")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        spark.createDataFrame([(6, "x", "y"), (7, "z", "z"), (8, None, "w")], "id int, v string, V string").write.parquet(f"{tmp_path}/c")
        unified = read_unified(spark, [f"{tmp_path}/{x}" for x in "abc"])
        found = {r["id"]: (r["n"], r["b"], r["v"], [tuple(c) for c in r["failed_casts"]]) for r in unified.collect()}
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert found == {
        1: (None, b"a\xff", None, [("n", "bigint", str(2**53 + 1))]), 2: (2.0**62, None, None, []),
        3: (None, b"", None, [("n", "bigint", str(2**63 - 1))]), 4: (-(2.0**63), None, None, []), 5: (0.5, None, None, []),
        6: (None, None, "x", [("v", "string", "y")]), 7: (None, None, "z", []), 8: (None, None, "w", []),
    }


KINDS = {
    "boolean": "id % 2 = 0", "tinyint": "id", "smallint": "-id", "int": "id * 1000003", "bigint": "9223372036854775807 - id", "float": "id / 3", "double": "id / 7",
    "decimal(38,18)": "id / 9", "string": "concat('\"', id, ',é')", "binary": "unhex('00ff10')", "date": "date_add('1890-01-01', int(id * 9999))",
    "timestamp": "timestamp_micros(id * 1234567891234567)", "timestamp_ntz": "timestamp_ntz'1969-12-31 23:59:59.123456'",
    "array<timestamp>": "array(timestamp_micros(id * 1000003), null)", "array<binary>": "array(unhex('00ff'), null, unhex(''))", "map<int,string>": "map(int(id), 'a', 7000, null)",
    "map<date,array<map<bigint,decimal(9,2)>>>": "map(date'2020-01-31', array(map(id, 1.5), null, map()))", "struct<a:int,b:struct<c:string>>": "named_struct('a', id, 'b', named_struct('c', null))",
    "array<struct<x:map<boolean,double>,y:int>>": "array(named_struct('x', map(true, 0.1), 'y', null), null)", "array<array<string>>": "array(array(), null, array('x', null))",
}


@pytest.mark.parametrize("kind", KINDS)
def test_unified_values_survive_the_way_through_maps(spark, tmp_path, kind):
    from keelstone.operators.drift import typed_table, raw_maps

    written = spark.range(40).selectExpr("id", f"case when id % 8 <> 5 then cast({KINDS[kind]} as {kind}) end as v")
    written.write.parquet(f"{tmp_path}/a")
    spark.range(40, 42).write.parquet(f"{tmp_path}/b")
    back = read_unified(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert back.where("size(failed_casts) > 0").count() == 0
    columns = ["id", *[c for c in back.columns if c.startswith("v")]]
    flat = "id, v.a as v__a, v.b.c as v__b__c" if kind.startswith("struct") else "id, v"
    wanted = written.selectExpr(*flat.split(", "))
    assert sorted(columns) == sorted(wanted.columns) and [back.schema[c].dataType for c in wanted.columns] == [f.dataType for f in wanted.schema.fields]
    assert rows(back.where("id < 40").select(*wanted.columns)) == rows(wanted) and back.count() == 42


def test_renamed_columns_are_followed(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1.5)], "id int, name string, x double").write.parquet(f"{tmp_path}/1")
    spark.createDataFrame([(2, "b", 2.5)], "id int, label string, x double").write.parquet(f"{tmp_path}/2")
    spark.createDataFrame([(3, "c", 3.5, "n")], "id int, Title string, x double, name string").write.parquet(f"{tmp_path}/3")
    paths = [f"{tmp_path}/{i}" for i in (1, 2, 3)]
    found = read_unified(spark, paths, follow_renames=True)
    assert rows(found.select("id", "title", "name", "x")) == [(1, "a", None, 1.5), (2, "b", None, 2.5), (3, "c", "n", 3.5)]
    given = read_unified(spark, paths[:2], renames={"name": "label"})
    assert rows(given.select("id", "label")) == [(1, "a"), (2, "b")] and "name" not in given.columns
    assert {"name", "label", "title"} <= set(read_unified(spark, paths).columns)
    with pytest.raises(ValueError):
        read_unified(spark, [])


# 5: references


def test_orphans_match_a_plain_anti_join(spark):
    refs = [("a", "hot", "m1")] * 300 + [("a", "hot", "m2")] * 20 + [("a", "gone", "m1")] * 200 + [("b", f"k{i}", "m1") for i in range(50)]
    refs += [("b", "k1", None), (None, "k1", "m1"), ("b", None, "m1")]
    df = spark.createDataFrame(refs, "t string, r string, m string").withColumn("n", F.lit(1))
    targets = spark.createDataFrame([("a", "hot")] * 3 + [("b", f"k{i}") for i in range(0, 50, 2)], "t string, r string")
    wanted = df.groupBy("t", "r", F.col("m").alias("period")).agg(F.count(F.lit(1)).alias("n")).join(targets, ["t", "r"], "left_anti")
    for share in (0.1, 1.0):
        found = orphan_references(df, ["t", "r"], F.col("m"), targets, share)
        assert rows(found.select("t", "r", "period", "n")) == rows(wanted.select("t", "r", "period", "n"))
    assert orphan_references(df.limit(0), ["t", "r"], F.col("m"), targets).count() == 0
    assert orphan_references(df, ["t", "r"], F.col("m"), targets.limit(0)).agg(F.sum("n")).first()[0] == len(refs)


def test_metadata_expressions(spark):
    df = spark.createDataFrame([("s3://a//b/c.parquet", 1735657988645), ("c.parquet", 1735657988), (None, None), ("x/", -1)], "p string, t long")
    got = df.select(file_name(F.col("p")), month_of(F.col("t")), is_reference(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("c.parquet", "2024-12", True), ("c.parquet", "2024-12", True), (None, "unknown", False), ("", "unknown", True)]
