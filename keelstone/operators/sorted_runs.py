"""Consolidation of many small sorted files: planning from metadata, and the external k-way merge itself."""

from __future__ import annotations

import bisect
import itertools
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from keelstone.operators.skew import running_total
from keelstone.session import materialize, remove_path, scratch_path

TARGET_BYTES = 134_217_728
SMALL_BYTES = 16_777_216
MIN_FILES = 8
#: Runs that a task merges at once; more are merged in several passes.
FAN_IN = 32
#: Keys sampled per ``target_bytes`` to find the cuts.
SAMPLES = 64
#: Bytes (in memory) of a row group of an output.
GROUP_BYTES = 8_388_608
CODEC = "zstd"


def plan_merges(
    files: DataFrame,
    groups: Sequence[str],
    order_by: Sequence[str],
    size: str = "size",
    small_bytes: int = SMALL_BYTES,
    min_files: int = MIN_FILES,
    target_bytes: int = TARGET_BYTES,
) -> DataFrame:
    """One row per output file to be written: ``groups, output_no, files, bytes, first_run, last_run``.

    ``files`` holds each file once.  Files of a known size above 0 and below ``small_bytes`` are runs; the runs of a
    group are taken in ``order_by`` order and an output is closed when it has ``target_bytes`` (an exact running total
    that spreads large groups over many tasks).  Groups with fewer than ``min_files`` runs are left alone.  Files of
    null or non-positive size are never taken.  ``first_run`` and ``last_run`` (structs of ``order_by``) are the range
    metadata of an output.  No files give no rows.
    """
    runs = files.where((F.col(size) > 0) & (F.col(size) < small_bytes)).select(*groups, *order_by, F.col(size).alias("_b"))
    placed = running_total(runs, groups, order_by, "_b", "_upto")
    output_no = F.floor((F.col("_upto") - F.col("_b")) / F.lit(target_bytes)).cast("long")
    outputs = placed.groupBy(*groups, output_no.alias("output_no")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("_b").alias("bytes"),
        F.min(F.struct(*order_by)).alias("first_run"),
        F.max(F.struct(*order_by)).alias("last_run"),
    )
    enough = outputs.groupBy(*groups).agg(F.sum("files").alias("_f")).where(F.col("_f") >= min_files).drop("_f")
    return outputs.join(enough, list(groups), "left_semi")


# the merge -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Ranges:
    """The key ranges of a batch: range ``i`` goes from cut ``i - 1`` (included) to cut ``i`` and is task ``first + i``."""

    first: int
    cuts: tuple

    def of(self, key) -> int:
        return bisect.bisect_right(self.cuts, _place(key), key=_place)

    def edges(self, task: int) -> tuple:
        i = task - self.first
        return (self.cuts[i - 1] if i else None, self.cuts[i] if i < len(self.cuts) else None)


def _boundaries(spans: DataFrame, target_bytes: int) -> dict[tuple, list]:
    """Cut points of each batch's key space, so that a range has about ``target_bytes``, by the sampled keys.

    The samples (about ``SAMPLES`` short rows per range, not the data) are numbered by exact offsets over many tasks; a
    sample's tile is its number in units of a range.  A key is a cut where a tile ends first, so ``last``, the last tile
    of a key, is larger than that of the key before.  A key that fills more than a range is cut off on both sides, so its
    range holds little else.  The driver receives the cuts, one key per ``target_bytes``.
    """
    batch = ["grp", "batch"]
    ranges = spans.groupBy(*batch).agg(F.greatest(F.lit(1), F.round(F.sum("bytes") / target_bytes).cast("long")).alias("ranges"))
    ranges = ranges.where("ranges > 1")
    keys = spans.join(ranges, batch, "left_semi").select(*batch, "path", "group", F.posexplode("keys").alias("at", "k"))
    if dict(keys.dtypes)["k"] in ("float", "double"):
        keys = keys.where(~F.isnan("k"))  # NaN sorts last and stays in the last range
    numbered = running_total(keys, batch, ["k", "path", "group", "at"], None, "no")
    size = numbered.groupBy(*batch).agg(F.max("no").alias("n"), F.min("k").alias("least"))
    tiles = numbered.join(size.join(ranges, batch), batch)
    tiles = tiles.withColumn("tile", F.floor((F.col("no") - 1) * F.col("ranges") / F.col("n")))
    each = tiles.groupBy(*batch, "k", "least").agg(F.min("tile").alias("first"), F.max("tile").alias("last"))
    each = materialize(each, "cuts")
    ends = each.groupBy(*batch, "last", "least").agg(F.min("k").alias("k")).where("k > least").select(*batch, "k")
    hot = each.where("last - first >= 2").select(*batch, F.col("last").alias("first"))
    after = each.join(hot, [*batch, "first"], "left_semi").groupBy(*batch, "first").agg(F.min("k").alias("k")).select(*batch, "k")
    cuts: dict[tuple, list] = {}
    for r in ends.unionByName(after).distinct().toArrow().to_pylist():
        cuts.setdefault((r["grp"], r["batch"]), []).append(r["k"])
    return {b: sorted(k) for b, k in cuts.items()}


def _sampled(path: str, group: int, rows: int, expected: float) -> list[int]:
    """Evenly spaced row numbers, ``expected`` on average; which ones depends on path and group only."""
    chance = zlib.crc32(f"{path}#{group}".encode()) / 2**32
    n = min(rows, int(expected + chance))
    return [int((i + chance * 997 % 1) * rows / n) for i in range(n)]


def read_spans(listed: DataFrame, key: str, key_type: str, target_bytes: int) -> DataFrame:
    """``grp, run, piece, path, group, lo, hi, rows, bytes, keys``: every row group with its key range and some of its keys.

    ``listed`` has ``grp, run, piece, path``.  The executors read footers, and the key column where keys are sampled.
    """
    schema = (
        f"grp string, run int, piece long, path string, `group` int, lo {key_type}, hi {key_type}, rows long, bytes long, keys array<{key_type}>"
    )
    floating = key_type in ("float", "double")

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for grp, run, piece, path in zip(*(batch.column(i).to_pylist() for i in range(4))):
                with open_parquet(path) as file:
                    meta = file.metadata
                    leaves = [meta.schema.column(i).path for i in range(meta.num_columns)]
                    column = leaves.index(key)  # nested columns have several leaves, so places differ from the fields'
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        if not group.num_rows:
                            continue
                        stats = None if floating else group.column(column).statistics  # those of floats may leave out NaN
                        chosen = _sampled(path, g, group.num_rows, group.total_byte_size * SAMPLES / target_bytes)
                        known = stats is not None and stats.has_min_max and not stats.null_count
                        keys = None if known and not chosen else _zoned(file, file.read_row_group(g, columns=[key])).column(0)
                        if known:
                            lo, hi = stats.min, stats.max
                        else:
                            lo, hi = (None, None) if keys.null_count else (keys[0].as_py(), keys[-1].as_py())
                        sample = [keys[i].as_py() for i in chosen] if lo is not None else []
                        rows.append((grp, run, piece, path, g, lo, hi, group.num_rows, group.total_byte_size, sample))
            columns = list(zip(*rows)) if rows else [[]] * 10
            yield _batch(columns, arrow)

    spark = listed.sparkSession
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return listed.select("grp", "run", "piece", "path").repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(footers, schema)


def _batch(columns: Sequence[Sequence], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)


def open_parquet(path: str) -> pq.ParquetFile:
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/") if path.startswith("file:") else path
        filesystem, inner = fs.FileSystem.from_uri(path)
        return pq.ParquetFile(inner, filesystem=filesystem, coerce_int96_timestamp_unit="us")
    return pq.ParquetFile(path, coerce_int96_timestamp_unit="us")


def _zoned(file: pq.ParquetFile, block: pa.Table) -> pa.Table:
    """Spark's old timestamps (INT96) are points in time; Arrow reads them without a zone, and Spark would so read them back."""
    old = [c for c in map(file.metadata.schema.column, range(file.metadata.num_columns)) if c.physical_type == "INT96"]
    for column in old:
        if "." in column.path:
            raise ValueError(f"{column.path}: an INT96 timestamp inside a nested column cannot be merged")
        at = block.schema.get_field_index(column.path)
        if at >= 0:
            kind = pa.timestamp("us", "UTC")
            field = block.schema.field(at).with_type(kind)
            block = block.set_column(at, field, pc.assume_timezone(block.column(at), "UTC").cast(kind))
    return block


def _place(value) -> tuple:
    """Sorts like Spark: NaN after every other value and equal to itself."""
    return (1,) if value != value else (0, value)


def _rows_up_to(keys: pa.ChunkedArray, safe: tuple, included: bool) -> int:
    """How many of the sorted keys have a place before ``safe``, or of at most ``safe``."""
    find = bisect.bisect_right if included else bisect.bisect_left
    return find(range(len(keys)), safe, key=lambda i: _place(keys[i].as_py()))


def merge_blocks(runs: Sequence[Iterator[pa.Table]], key: str) -> Iterator[pa.Table]:
    """Stable k-way merge of sorted block streams: two blocks per run in memory, equal keys in run order.

    A run whose next block is known to be missing is loaded whole.  Of the other runs the smallest last loaded key is
    safe: every row before it is loaded.  The first run that ends with it may go on with it in its next block, so the rows
    equal to it are taken up to that run only.  Those rows are cut off by binary search, joined and sorted as one block;
    the runs that are used up load their next block.  When all runs are loaded whole, the rest is one block.
    """
    heads: list[pa.Table | None] = [next(r, None) for r in runs]
    ahead = [None if h is None else next(r, None) for h, r in zip(heads, runs)]
    while live := [i for i, h in enumerate(heads) if h is not None]:
        waiting = [(_place(heads[i].column(key)[-1].as_py()), i) for i in live if ahead[i] is not None]
        parts = []
        for i in live:
            head = heads[i]
            n = head.num_rows
            if waiting:
                safe, first = min(waiting)
                n = _rows_up_to(head.column(key), safe, i <= first)
            if n:
                parts.append(head.slice(0, n))
            if n < head.num_rows:
                heads[i] = head.slice(n)
            else:
                heads[i], ahead[i] = ahead[i], None if ahead[i] is None else next(runs[i], None)
        if len(parts) == 1:
            yield parts[0]
        else:
            block = pa.concat_tables(parts)
            order = pc.sort_indices(block.append_column("_at", pa.array(range(block.num_rows), pa.int64())),
                                    sort_keys=[(key, "ascending"), ("_at", "ascending")])
            yield block.take(order)


def _listed(spark: SparkSession, files: Sequence[str] | DataFrame, group: str | None, order_by: Sequence[str]) -> DataFrame:
    """``grp, run, piece, path``: the runs of each group, numbered in order."""
    if not isinstance(files, DataFrame):
        return spark.createDataFrame([("", i, 0, p) for i, p in enumerate(files)], "grp string, run int, piece long, path string")
    named = files.select((F.col(group) if group else F.lit("")).alias("grp"), F.struct(*order_by, "path").alias("o"), F.col("path").alias("path"))
    numbered = running_total(named, ["grp"], ["o"], None, "no")
    return materialize(numbered.select("grp", (F.col("no") - 1).cast("int").alias("run"), F.lit(0).cast("long").alias("piece"), "path"), "runs")


def merge_sorted_files(
    spark: SparkSession,
    files: Sequence[str] | DataFrame,
    key: str,
    out: str,
    target_bytes: int = TARGET_BYTES,
    block_rows: int = 262_144,
    fan_in: int = FAN_IN,
    group: str | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Merge Parquet files, each sorted by ``key``, into few files of about ``target_bytes`` below ``out``.

    ``files`` is a list of paths or, for very many, a table with ``path``; with ``group`` (a column of folder names) the
    files of each group are merged among themselves, into ``out/<group>``, all groups in the same jobs.  Runs stand in the
    order of the list, or of ``order_by`` and path.

    At most ``fan_in`` runs are merged at once.  If a group has more, a pass merges each batch of ``fan_in`` neighbours
    into one longer run in the scratch folder, until one batch is left; every pass reads and writes each row once.

    In a pass the key space of a batch is cut into ranges of about ``target_bytes`` by sampled keys.  A task owns a key
    range: it reads from every run only the row groups that overlap its range, merges them block by block (the blocks of
    all runs together hold about ``block_rows`` rows), and starts a new output when the current one is full.  Every row,
    repeated rows included, is taken exactly once, and in each pass the rows written are compared with those in the
    footers; equal keys keep the order of the runs; NaN sorts last.  A key that fills more than a range is held by one
    task but never in memory at once.  A run with null keys is refused, since nulls have no place in a key range, and so
    is one that is not sorted.  An empty list is refused; an empty table of files gives no rows.

    Returns the range metadata: ``grp, path, lo, hi, rows``, one row per written file.  Output names carry the attempt,
    and only the returned files count: those of a failed or repeated attempt are leftovers to be cleaned up.
    """
    if not isinstance(files, DataFrame):
        files = list(files)
        if not files:
            raise ValueError("no files to merge")
    if fan_in < 2:
        raise ValueError("a merge takes at least two runs")
    listed = _listed(spark, files, group, order_by)
    runs = {r["grp"]: r["n"] for r in listed.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per group
    if not runs:
        return spark.createDataFrame([], "grp string, path string, lo string, hi string, rows long")
    key_type = spark.read.parquet(listed.first()["path"]).schema[key].dataType.simpleString()
    done = spark.createDataFrame([], f"grp string, path string, lo {key_type}, hi {key_type}, rows long")
    used = None
    while True:
        spans = materialize(read_spans(listed, key, key_type, target_bytes), "spans")
        total = spans.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum(F.col("lo").isNull().cast("long")).alias("nulls")).first()
        if total["nulls"]:
            raise ValueError(f"column {key} holds nulls; sorted runs need a key in every row")
        folder = scratch_path(spark, "merge-pass")
        merged = _merge_pass(spans, runs, key, key_type, out, folder, target_bytes, block_rows, fan_in)
        written = merged.agg(F.sum("rows")).first()[0] or 0
        if written != total["rows"]:
            raise RuntimeError(f"merge wrote {written} of {total['rows']} rows")
        if used:
            remove_path(spark, used)
        done = done.unionByName(merged.where("final").select(*done.columns))
        runs = {g: -(-n // fan_in) for g, n in runs.items() if n > fan_in}
        if not runs:
            return done
        listed, used = merged.where("not final").select("grp", "run", "piece", "path"), folder


def _merge_pass(spans, runs, key, key_type, out, folder, target_bytes, block_rows, fan_in) -> DataFrame:
    """``grp, run, piece, path, lo, hi, rows, final``: the files to which each batch of ``fan_in`` neighbouring runs is merged.

    Batches of groups that are done after this pass go to ``out``, the others to ``folder``.  The ranges of all batches are
    broadcast: a few values per ``target_bytes`` of data.
    """
    spark = spans.sparkSession
    spans = spans.withColumn("batch", F.floor(F.col("run") / fan_in).cast("int"))
    cuts = _boundaries(spans, target_bytes)
    ranges, tasks = {}, 0
    for grp, n in sorted(runs.items()):
        for batch in range(-(-n // fan_in)):
            ranges[grp, batch] = Ranges(tasks, tuple(cuts.get((grp, batch), ())))
            tasks += len(ranges[grp, batch].cuts) + 1
    final = {g for g, n in runs.items() if n <= fan_in}
    shared = spark.sparkContext.broadcast(ranges)
    columns = ["grp", "batch", "run", "piece", "path", "group", "lo", "hi"]
    placed_ddl = f"grp string, batch int, run int, piece long, path string, `group` int, low int, high int"
    placed_schema = to_arrow_schema(spark.createDataFrame([], placed_ddl).schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            for *who, lo, hi in zip(*(part.column(i).to_pylist() for i in range(len(columns)))):
                own = shared.value[who[0], who[1]]
                rows.append((*who, own.first + own.of(lo), own.first + own.of(hi)))
            yield _batch(list(zip(*rows)) if rows else [[]] * len(columns), placed_schema)

    work = spans.select(*columns).mapInArrow(place, placed_ddl).withColumn("task", F.explode(F.sequence("low", "high")))
    work = work.repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "run", "piece", "group")
    meta_ddl = f"grp string, run int, piece long, path string, lo {key_type}, hi {key_type}, rows long, final boolean"
    meta_schema = to_arrow_schema(spark.createDataFrame([], meta_ddl).schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]  # row-group descriptions, not data
        for task, own in itertools.groupby(rows, lambda r: r["task"]):
            own = list(own)
            grp, batch = own[0]["grp"], own[0]["batch"]
            low, high = shared.value[grp, batch].edges(task)
            last = grp in final
            target = f"{out.rstrip('/')}/{grp}".rstrip("/") if last else folder
            # a later pass reads parts of a run, so the row groups of its input are small
            group_rows = None if last else max(16, block_rows // fan_in)
            for path, lo, hi, rows_written, place in _merge_range(own, key, target, task, low, high, target_bytes, block_rows, fan_in, group_rows):
                yield _batch([[x] for x in (grp, batch, place, path, lo, hi, rows_written, last)], meta_schema)

    return materialize(work.mapInArrow(merge, meta_ddl), "merged")


def _at_least(keys: pa.ChunkedArray, low) -> pa.ChunkedArray:
    reached = pc.greater_equal(keys, pa.scalar(low, keys.type))
    return pc.or_(reached, pc.is_nan(keys)) if pa.types.is_floating(keys.type) else reached


def _merge_range(own, key, out, task, low, high, target_bytes, block_rows, fan_in, group_rows) -> Iterator[tuple]:
    """Writes one key range of a batch; yields ``path, lo, hi, rows, place`` of each file."""
    import os

    from pyarrow import fs

    by_run: dict[int, dict[str, list[int]]] = {}
    for r in own:
        by_run.setdefault(r["run"], {}).setdefault(r["path"], []).append(r["group"])
    if len(by_run) > fan_in:
        raise RuntimeError(f"{len(by_run)} runs to merge at once")
    share = max(16, block_rows // (2 * len(by_run)))

    def blocks(pieces: dict[str, list[int]]) -> Iterator[pa.Table]:
        before = None
        for path, groups in pieces.items():
            with open_parquet(path) as file:
                for part in file.iter_batches(batch_size=share, row_groups=groups):
                    block = _zoned(file, pa.Table.from_batches([part]))
                    keys = block.column(key)
                    if block.num_rows and (before is not None and _place(keys[0].as_py()) < before or not _ascending(keys)):
                        raise ValueError(f"{path} is not sorted by {key}")
                    before = _place(keys[-1].as_py()) if block.num_rows else before
                    keep = [_at_least(keys, low)] if low is not None else []
                    keep += [pc.less(keys, pa.scalar(high, keys.type))] if high is not None else []
                    if keep:
                        block = block.filter(reduce(pc.and_, keep))
                    if block.num_rows:
                        yield block

    def row_groups() -> Iterator[pa.Table]:
        held, n, size = [], 0, 0
        for block in merge_blocks([blocks(p) for _, p in sorted(by_run.items())], key):
            step = group_rows or max(1, GROUP_BYTES * block.num_rows // max(block.nbytes, 1))
            for at in range(0, block.num_rows, step):
                held.append(block.slice(at, step))
                n, size = n + held[-1].num_rows, size + held[-1].nbytes
                if n >= group_rows if group_rows else size >= GROUP_BYTES:
                    yield pa.concat_tables(held)
                    held, n, size = [], 0, 0
        if held:
            yield pa.concat_tables(held)

    filesystem, folder = fs.FileSystem.from_uri(out if "://" in out or out.startswith("file:") else f"file://{out}")
    filesystem.create_dir(folder, recursive=True)
    writer, count = None, 0
    for block in row_groups():
        if writer is None:
            path = f"part-{task:05d}-{uuid.uuid4().hex}.parquet"
            sink = filesystem.open_output_stream(os.path.join(folder, path))
            writer = pq.ParquetWriter(sink, block.schema, compression=CODEC)
            lo, n = block.column(key)[0].as_py(), 0
        writer.write_table(block)
        hi, n = block.column(key)[-1].as_py(), n + block.num_rows
        if sink.tell() >= target_bytes:
            writer.close(), sink.close()
            yield f"{out.rstrip('/')}/{path}", lo, hi, n, (task << 32) + count  # pieces of a run in key order
            writer, count = None, count + 1
    if writer is not None:
        writer.close(), sink.close()
        yield f"{out.rstrip('/')}/{path}", lo, hi, n, (task << 32) + count


def _ascending(keys: pa.ChunkedArray) -> bool:
    if len(keys) < 2:
        return True
    whole = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    a, b = whole.slice(0, len(whole) - 1), whole.slice(1)
    fits = pc.less_equal(a, b)
    return bool(pc.all(pc.or_(fits, pc.is_nan(b)) if pa.types.is_floating(whole.type) else fits).as_py())
