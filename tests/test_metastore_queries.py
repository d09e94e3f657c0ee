"""p1 to p5 on the smallest tables against SQL or brute force."""

import json
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from keelstone.operators.drift import compare_entries, schema_entries
from keelstone.plans import metastore

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(metastore.SQL))
def test_equals_sql(spark, db, name):
    found = metastore.QUERIES[name](spark, DATA)
    cursor = db.execute(metastore.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, cursor.fetchall()))


def test_p3_brute_force(spark, db):
    ok = set(db.execute("select table_id, commit_id from undo_log where commit_type = 'commit' and tag = -1").fetchall())
    logged = defaultdict(dict)
    for t, c, v, s in db.execute("select table_id, commit_id, write_version, table_schema from undo_log where commit_type = 'schema'").fetchall():
        if (t, c) in ok:
            logged[t][c] = (v, json.loads(s))
    last = {t: json.loads(s) for t, s in db.execute("select table_id, table_schema from table_info").fetchall()}
    wanted = set()
    for t, versions in logged.items():
        line = [(c, s) for c, (v, s) in sorted(versions.items(), key=lambda x: x[1][0])]
        line += [("table_info", last[t])] if t in last else []
        for (_, a), (c, b) in zip(line, line[1:]):
            wanted |= {(t, c, *x) for x in compare_entries(schema_entries(a), schema_entries(b))}
        names = {f["name"].lower() for _, s in line for f in s["fields"]}
        for c, cols in db.execute("select commit_id, file_exist_cols from data_info where table_id = ? and commit_id is not null and file_exist_cols is not null", [t]).fetchall():
            wanted |= {(t, c, "undeclared", n.strip().lower()) for n in cols.split(",") if n.strip() and n.strip().lower() not in names}
    found = [tuple(r) for r in metastore.p3_found(spark, DATA).select("table_id", "commit_id", "change", "field_name").collect()]
    assert len(found) == len(set(found)) and set(found) == wanted and wanted


def test_p3_finds_changes_across_an_unreadable_version(spark, tmp_path):
    text = lambda kind: json.dumps({"type": "struct", "fields": [{"name": "a", "type": kind, "nullable": True, "metadata": {}}]})
    versions = [("c1", 1, text("integer")), ("c2", 2, "{broken"), ("c3", 3, text("long"))]
    log = [(k, "t", c, v, s if k == "schema" else None, -1) for c, v, s in versions for k in ("commit", "schema")]
    ddl = "commit_type string, table_id string, commit_id string, write_version long, table_schema string, tag int"
    spark.createDataFrame(log, ddl).write.parquet(f"{tmp_path}/undo_log.parquet")
    spark.createDataFrame([], "table_id string, table_schema string, read_version int").write.parquet(f"{tmp_path}/table_info.parquet")
    files = [("t", "c1", "a"), ("t", "c3", "A, x")]
    spark.createDataFrame(files, "table_id string, commit_id string, file_exist_cols string").write.parquet(f"{tmp_path}/data_info.parquet")
    found = sorted(map(tuple, metastore.p3_found(spark, str(tmp_path)).collect()))
    assert found == [("t", "c3", "retyped", "a"), ("t", "c3", "undeclared", "x")]


def test_p4_counts_files_once(spark, tmp_path):
    files = [("t", "r", "/a/f1", 10, 1), ("t", "r", "s3://b/f1", None, 1), ("t", "r", "/a/f1", 10, 1), ("t", "r", "/a/f2", 5, 3), ("t", "q", "/a/f1", 7, 2), (None, None, "/a/f9", 2, 9)]
    ddl = "table_id string, range_id string, file_path string, size long, write_version long"
    spark.createDataFrame(files, ddl).write.parquet(f"{tmp_path}/data_info.parquet")
    parts = [("t", "r", "d=1"), ("t", "r", "d=1"), ("t", "q", "d=1"), ("t", "none", "d=2")]
    spark.createDataFrame(parts, "table_id string, range_id string, range_value string").write.parquet(f"{tmp_path}/partition_info.parquet")
    per_range = {tuple(r) for r in metastore.p4_range_files(spark, str(tmp_path)).collect()}
    assert per_range == {("r", 2, 15, 3), ("q", 1, 7, 2), (None, 1, 2, 9)}
    per_value = {tuple(r) for r in metastore.p4_range_value_files(spark, str(tmp_path)).collect()}
    assert per_value == {("d=1", 3, 22, 3), ("d=2", 0, None, None)}


def test_empty_tables(spark, tmp_path):
    for f in Path(DATA).glob("*.parquet"):
        spark.read.parquet(str(f)).limit(0).write.parquet(f"{tmp_path}/{f.name}")
    for name, query in metastore.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
