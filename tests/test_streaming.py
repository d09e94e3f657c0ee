"""The streaming sink."""

import pytest
from pyspark.sql import functions as F

from keelstone.errors import SchemaError, UnsupportedError
from keelstone.lake import Table
from keelstone.streaming.sink import Sink, write_stream


def run(spark, folder, ddl, path, query_id, checkpoint, mode="append", change=lambda d: d, **options):
    stream = change(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    write_stream(stream, str(path), query_id, str(checkpoint), mode, {"availableNow": True}, **options).awaitTermination()
    return Table(spark, str(path))


def feed(spark, folder, data, ddl):
    spark.createDataFrame(data, ddl).coalesce(1).write.mode("append").parquet(str(folder))


def test_append_and_restart(spark, tmp_path):
    feed(spark, tmp_path / "in", [(1, "a"), (2, "b")], "v int, p string")
    t = run(spark, tmp_path / "in", "v int, p string", tmp_path / "t", "q", tmp_path / "cp", range_partitions="p")
    feed(spark, tmp_path / "in", [(3, "a")], "v int, p string")
    run(spark, tmp_path / "in", "v int, p string", tmp_path / "t", "q", tmp_path / "cp")
    assert sorted(map(tuple, t.toDF().collect())) == [(1, "a"), (2, "b"), (3, "a")]
    assert t.snapshot().streams == {"q": 1}
    # the progress folder is lost: every batch comes again under the ids it had
    run(spark, tmp_path / "in", "v int, p string", tmp_path / "t", "q", tmp_path / "cp2")
    assert t.toDF().count() == 3


def test_replayed_batches_are_skipped(spark, tmp_path):
    batch = spark.createDataFrame([(1, 1)], "k int, v int")
    sink = Sink(f"{tmp_path}/t", "q")
    for number in (0, 0, 1, 0, 1):
        sink(batch, number)
    assert Table(spark, f"{tmp_path}/t").toDF().count() == 2
    Sink(f"{tmp_path}/t", "other")(batch, 0)
    assert Table(spark, f"{tmp_path}/t").toDF().count() == 3


def test_update_and_complete(spark, tmp_path):
    feed(spark, tmp_path / "in", [(1,), (2,), (2,)], "v int")
    feed(spark, tmp_path / "in", [(2,), (3,)], "v int")
    count = lambda d: d.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    for mode, layout in (("update", {"hash_partitions": "v", "bucket_num": 2}), ("complete", {})):
        t = run(spark, tmp_path / "in", "v int", tmp_path / mode, "q", tmp_path / f"cp-{mode}", mode, count, **layout)
        assert sorted(map(tuple, t.toDF().collect())) == [(1, 1), (2, 3), (3, 1)]


def test_refusals(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    t.write(spark.createDataFrame([(1, 1)], "k int, v int"), properties={"keelstone.appendOnly": "true"})
    batch = spark.createDataFrame([(2, 2)], "k int, v int")
    with pytest.raises(UnsupportedError, match="append-only"):
        Sink(t.path, "q", "complete")(batch, 0)
    with pytest.raises(UnsupportedError, match="hash columns"):
        Sink(t.path, "q", "update")(batch, 0)
    with pytest.raises(UnsupportedError):
        Sink(t.path, "q", "sometimes")
    with pytest.raises(SchemaError):
        Sink(t.path, "q")(batch.withColumn("n", F.lit(None)), 0)
    with pytest.raises(SchemaError):
        Sink(t.path, "q")(batch.withColumn("n", F.lit(1)), 0)
    Sink(t.path, "q", merge_schema=True)(batch.withColumn("n", F.lit(1)), 0)
    assert t.toDF().columns == ["k", "v", "n"]


def test_late_rows_fall_out_of_windows(spark, tmp_path):
    for batch in ([100], [104, 123], [140]):
        feed(spark, tmp_path / "in", [(x,) for x in batch], "t long")
    def windows(d):
        d = d.select(F.timestamp_seconds("t").alias("ts")).withWatermark("ts", "10 seconds")
        return d.groupBy(F.window("ts", "5 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("s"), "n")
    t = run(spark, tmp_path / "in", "t long", tmp_path / "t", "q", tmp_path / "cp", "append", windows)
    assert sorted(map(tuple, t.toDF().collect())) == [(100, 2), (120, 1)]
