"""Work on keys of very uneven frequency: heavy-key search, salted joins, exact offset chunking.

Nothing here assumes that the rows of one key fit into a task.  What reaches the driver is bounded by a share of
the rows (``HEAVY_SHARE``), never by the number of keys.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelstone.session import materialize

#: A key is heavy if it holds at least this share of the rows; at most 1 / HEAVY_SHARE keys can be heavy.
HEAVY_SHARE = 1 / 64
#: Pieces into which each heavy key is split.
SALTS = 16


def unused_names(df: DataFrame, count: int) -> list[str]:
    """Column names that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    free = (f"_k{i}" for i in itertools.count())
    return list(itertools.islice((f for f in free if f not in taken), count))


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = HEAVY_SHARE) -> list[tuple]:
    """The keys that hold at least ``share`` of all rows.

    Rows are counted with map-side partial sums, so a hot key never travels.  At most ``1 / share`` keys are returned,
    whatever the data.  Rows with a null in any key column are left out: they match nothing in an equi-join.
    An empty input has no heavy keys.
    """
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    if not total:
        return []
    limit = int(1 / share) + 1
    rows = counts.where(present & (F.col("_n") >= F.lit(total * share))).orderBy(F.desc("_n")).limit(limit).collect()
    return [tuple(r[k] for k in keys) for r in rows]


def _is_heavy(keys: Sequence[Column], heavy: Sequence[tuple]) -> Column:
    if not heavy:
        return F.lit(False)
    tests = [reduce(lambda a, b: a & b, [k == F.lit(v) for k, v in zip(keys, values)]) for values in heavy]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def salt_of(keys: Sequence[Column], spread: Sequence[Column], heavy: Sequence[tuple], salts: int = SALTS) -> Column:
    """0 for ordinary keys; for heavy keys a piece number that depends on ``spread`` only (so equal rows stay together)."""
    return F.when(_is_heavy(keys, heavy), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")


def replicate_for_salt(df: DataFrame, keys: Sequence[str], heavy: Sequence[tuple], salts: int = SALTS) -> DataFrame:
    """Adds ``_salt``; rows of heavy keys appear once per piece, other rows once."""
    pieces = F.when(_is_heavy([F.col(k) for k in keys], heavy), F.sequence(F.lit(0), F.lit(salts - 1)))
    return df.withColumn("_salt", F.explode(pieces.otherwise(F.array(F.lit(0)))))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    weight: str | None = None,
    name: str = "row_no",
) -> DataFrame:
    """Exact running total of ``weight`` (of 1 if None) per key in the order of ``order_by``, added as column ``name``.

    Exact offset chunking: rows are range-partitioned by key and order, so a hot key is spread over many partitions;
    the weights of each (key, partition) are summed, prefix sums over the partitions give each partition its offset, and
    rows are numbered inside (key, partition) only.  No task sees more of one key than a partition holds.

    Null keys form one group.  ``order_by`` should be unique within a key; ties are put in an arbitrary but fixed order.
    Null weights count as 0.  An empty table gives an empty table.  A column already called ``name`` is replaced; other
    columns may have any names.
    """
    w = F.coalesce(F.col(weight), F.lit(0)).cast("long") if weight else F.lit(1).cast("long")
    # a struct is never null, so null keys join and group like others
    rows = df.select(F.struct(*keys).alias("k"), F.struct(*order_by).alias("o"), w.alias("w"), F.struct("*").alias("row"))
    stable = materialize(rows.repartitionByRange("k", "o").withColumn("pid", F.spark_partition_id()), "ranged")
    sums = stable.groupBy("k", "pid").agg(F.sum("w").alias("s"))
    before = F.sum("s").over(Window.partitionBy("k").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("k", "pid", F.coalesce(before, F.lit(0)).alias("before"))
    local = Window.partitionBy("k", "pid").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    numbered = stable.join(offsets, ["k", "pid"]).withColumn("upto", F.col("before") + F.sum("w").over(local))
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c != name]
    return numbered.select(*kept, F.col("upto").alias(name))


def chunked_states(
    df: DataFrame,
    key: str,
    input_part: Column,
    position: Column,
    states: dict[str, Column],
    chunk_rows: int = 65_536,
) -> DataFrame:
    """Partial results of equal-sized chunks of each key: ``key, chunk, chunk_first, chunk_size`` and the states.

    ``input_part`` names the input partition of a row and must not depend on where the row is processed (for files:
    path and block start); ``position`` orders the rows of one input partition.  Rows are counted per key and input
    partition, prefix sums of those counts are the offsets, and ``offset + local number`` numbers the rows of a key
    exactly; ``number // chunk_rows`` is the chunk.  ``states`` maps result names to aggregate expressions.
    """
    k, part, pos, n, before, no = unused_names(df, 6)
    rows = df.withColumn(k, F.struct(key)).withColumn(part, input_part).withColumn(pos, position)
    counts = rows.groupBy(k, part).agg(F.count(F.lit(1)).alias(n))
    earlier = F.sum(n).over(Window.partitionBy(k).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(k, part, F.coalesce(earlier, F.lit(0)).alias(before))
    numbered = rows.join(offsets, [k, part]).withColumn(
        no, F.col(before) + F.row_number().over(Window.partitionBy(k, part).orderBy(pos)) - 1
    )
    chunk = F.floor(F.col(no) / F.lit(chunk_rows)).cast("long")
    return numbered.groupBy(key, chunk.alias("chunk")).agg(
        F.min(no).alias("chunk_first"),
        F.count(F.lit(1)).alias("chunk_size"),
        *[c.alias(n) for n, c in states.items()],
    )


def merge_states(states: DataFrame, key: str, merges: dict[str, Column]) -> DataFrame:
    """One row per key from the states of its chunks: ``rows``, ``chunks`` and the merged states.

    The chunks of a key are contiguous and ordered by ``chunk``; order-dependent merges may refer to that column.
    """
    return states.groupBy(key).agg(
        F.sum("chunk_size").alias("rows"),
        F.count(F.lit(1)).alias("chunks"),
        *[c.alias(n) for n, c in merges.items()],
    )


def chunked_aggregate(
    df: DataFrame,
    key: str,
    input_part: Column,
    position: Column,
    states: dict[str, Column],
    merges: dict[str, Column],
    chunk_rows: int = 65_536,
) -> DataFrame:
    """Per-key results without per-key tasks: ``chunked_states`` then ``merge_states``.

    Null keys form one group; empty input gives no rows; repeated rows all count; columns of ``df`` other than those
    used in ``states`` are pruned and may have any names.
    """
    return merge_states(chunked_states(df, key, input_part, position, states, chunk_rows), key, merges)


def ordered_chunks(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], chunk_rows: int = 65_536, name: str = "chunk") -> DataFrame:
    """``df`` with a chunk number: the rows of each key in the order of ``order_by``, cut into chunks of equal size.

    Rows are numbered exactly by :func:`running_total`, so a hot key is spread over tasks before, in and after the
    numbering.  Null keys form one group; ties of ``order_by`` fall in a fixed order; an empty table stays empty; a
    column already called ``name`` is replaced.
    """
    (no,) = unused_names(df, 1)
    numbered = running_total(df.drop(name), keys, order_by, None, no)
    return numbered.withColumn(name, F.floor((F.col(no) - 1) / F.lit(chunk_rows)).cast("long")).drop(no)


def largest_gap(df: DataFrame, key: str, value: str, chunk_rows: int = 65_536) -> DataFrame:
    """``key, rows, first, last, gap``: the largest step between neighbouring values of a key in ascending order.

    A chunk is processed by itself; its boundary state is its first and last value and its largest inner step.  The states
    of a key are then taken in the order of chunks, where the step from one chunk's last to the next one's first counts
    too.  Null values are left out; a key with one value has no gap (null); repeated values make steps of 0.
    """
    rows = df.select(F.col(key), F.col(value)).where(F.col(value).isNotNull())
    chunks = ordered_chunks(rows, [key], [value], chunk_rows)
    values = F.array_sort(F.collect_list(value))  # one chunk
    states = chunks.groupBy(key, "chunk").agg(F.count(F.lit(1)).alias("_n"), values.alias("_v"))
    steps = F.zip_with(F.slice("_v", 2, F.size("_v")), F.col("_v"), lambda b, a: b - a)
    states = states.select(key, "chunk", "_n", F.col("_v")[0].alias("_first"), F.element_at("_v", -1).alias("_last"), F.array_max(F.filter(steps, lambda x: x.isNotNull())).alias("_inner"))
    before = F.lag("_last").over(Window.partitionBy(key).orderBy("chunk"))
    states = states.withColumn("_edge", F.col("_first") - before)
    return states.groupBy(key).agg(
        F.sum("_n").alias("rows"), F.min("_first").alias("first"), F.max("_last").alias("last"), F.max(F.greatest("_inner", "_edge")).alias("gap")
    )
