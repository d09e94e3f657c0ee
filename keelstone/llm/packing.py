"""Filling containers of fixed capacity: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.session import materialize

#: Items that one task packs together; a group leaves at most one container half empty.
GROUP_ITEMS = 4096
#: Containers that leave more than this share of each limit unused are emptied and packed once more.
LOOSE_SHARE = 1 / 32
PLACED = "budget_name string, container_id string, {id} {kind}, piece long, first_token long, tokens long, loss_tokens long"


def pack_group(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_capacity: int) -> np.ndarray:
    """Container number of each item under simultaneous limits on tokens, item count and loss-bearing tokens.

    A container takes, again and again, the item that fits and whose demand has the largest dot product with what is
    left, all measured in shares of the limits; when nothing fits, the next container is opened.  Every item must fit an
    empty container.  Ties go to the larger item, then to the earlier one.
    """
    n = len(tokens)
    place = np.full(n, -1, np.int64)
    if not n:
        return place
    if tokens.max() > capacity or loss.max() > loss_capacity or segments < 1:
        raise ValueError("an item does not fit an empty container")
    order = np.lexsort((-loss, -tokens))
    t, d = tokens[order].astype(np.int64), loss[order].astype(np.int64)
    left, less = np.ones(n, bool), -t
    start, container = 0, 0  # everything before start is placed
    remaining = n
    while remaining:
        room, seats, loss_room = capacity, segments, loss_capacity
        while seats and remaining:
            while start < n and not left[start]:
                start += 1
            first = max(start, int(less.searchsorted(-room)))  # t is descending: from here on items fit
            fits = left[first:] & (d[first:] <= loss_room)
            if not fits.any():
                break
            score = t[first:] * (room / capacity / capacity) + d[first:] * (loss_room / max(loss_capacity, 1) / max(loss_capacity, 1))
            pick = first + int(np.argmax(np.where(fits, score, -1.0)))
            left[pick] = False
            place[order[pick]] = container
            room, seats, loss_room = room - t[pick], seats - 1, loss_room - d[pick]
            remaining -= 1
        container += 1
        if remaining and remaining * 2 < n - start:  # squeeze out what is placed
            keep = np.flatnonzero(left)
            t, d, order = t[keep], d[keep], order[keep]
            left, less, n, start = np.ones(len(keep), bool), -t, len(keep), 0
    return place


def cut_item(tokens: int, quiet: list[int], capacity: int, loss_capacity: int) -> list[tuple[int, int, int]]:
    """``(first, tokens, loss)`` of as few pieces as fit: each is as long as both limits allow from where the last ended."""
    starts, sizes = quiet[0::2], quiet[1::2]
    before = [0, *itertools.accumulate(sizes)]  # quiet tokens before each run
    bearing = [at - n for at, n in zip(starts, before)]  # loss-bearing tokens before each run

    def loss_until(at: int) -> int:
        i = bisect.bisect_left(starts, at)
        inside = max(0, starts[i - 1] + sizes[i - 1] - at) if i else 0
        return at - before[i] + inside

    pieces, at, spent = [], 0, 0
    while at < tokens:
        target = spent + loss_capacity
        end = min(target + before[bisect.bisect_right(bearing, target)], at + capacity, tokens)
        loss = loss_until(end)
        pieces.append((at, end - at, loss - spent))
        at, spent = end, loss
    return pieces


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("first_token", "tokens", "loss_tokens")])))
def _cut(tokens: pd.Series, quiet: pd.Series, capacity: pd.Series, loss_capacity: pd.Series) -> pd.Series:
    found = []
    for n, runs, most, loss in zip(tokens, quiet, capacity, loss_capacity):
        pieces = cut_item(int(n), [] if runs is None else list(map(int, runs)), int(most), int(loss))
        found.append([dict(zip(("first_token", "tokens", "loss_tokens"), p)) for p in pieces])
    return pd.Series(found)


def _exact_pieces(items: DataFrame) -> DataFrame:
    """Like :func:`_pieces`, with the loss-bearing tokens of a piece counted where they stand."""
    fits = (F.col("tokens") <= F.col("capacity")) & (F.col("loss_tokens") <= F.col("loss_capacity"))
    zero = F.lit(0).cast("long")
    kept = [c for c in items.columns if c not in ("tokens", "loss_tokens", "quiet")]
    whole = items.where(fits).select(*kept, zero.alias("piece"), zero.alias("first_token"), "tokens", "loss_tokens")
    cut = items.where(~fits).select(*kept, F.posexplode(_cut("tokens", "quiet", "capacity", "loss_capacity")).alias("piece", "p"))
    return whole.unionByName(cut.select(*kept, F.col("piece").cast("long").alias("piece"), "p.first_token", "p.tokens", "p.loss_tokens"))


def _pieces(items: DataFrame) -> DataFrame:
    """Items over a limit cut into as few pieces as fit; other items are their own only piece."""
    by_tokens = F.ceil(F.col("tokens") / F.col("capacity"))
    by_loss = F.ceil(F.col("loss_tokens") / F.col("loss_capacity"))
    count = F.greatest(by_tokens, by_loss, F.lit(1)).cast("long")
    # whole containers unless a piece of that length could exceed the limit on loss-bearing tokens
    even = F.col("loss_tokens") * F.col("capacity") > F.col("loss_capacity") * F.col("tokens")
    cut = items.withColumn("_n", count).withColumn("_even", even)
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))

    def edge(i):
        return F.when(F.col("_even"), F.floor(i * F.col("tokens") / F.col("_n"))).otherwise(
            F.least(i * F.col("capacity"), F.col("tokens"))
        ).cast("long")

    def loss_before(i, at):
        by_length = F.floor(F.col("loss_tokens") * at / F.greatest(F.col("tokens"), F.lit(1)))
        return F.when(F.col("_even"), F.floor(i * F.col("loss_tokens") / F.col("_n"))).otherwise(by_length).cast("long")

    here, after = F.col("piece"), F.col("piece") + 1
    low, high = edge(here), edge(after)
    return cut.select(
        *[c for c in items.columns if c not in ("tokens", "loss_tokens")],
        "piece", low.alias("first_token"), (high - low).alias("tokens"),
        (loss_before(after, high) - loss_before(here, low)).alias("loss_tokens"),
    )


def pack(
    spark: SparkSession,
    items: DataFrame,
    budgets: DataFrame,
    id_column: str,
    tokens_per_segment: int = 16,
    loss_share: float = 1.0,
    group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """Place every item, for every budget, in a container.

    ``items`` has ``id_column``, ``tokens`` and ``loss_tokens``, and may have ``quiet`` (runs of tokens that bear no loss, see
    :mod:`keelstone.llm.tokens`); without it the loss of a piece is taken in proportion to its length.  ``budgets`` has ``budget_name`` and
    ``capacity_tokens`` (a small table of settings).  Limits of a container: capacity_tokens, one item per
    ``tokens_per_segment`` of it, and ``loss_share`` of it as loss-bearing tokens.

    Returns ``budget_name, container_id, <id>, piece, first_token, tokens, loss_tokens``.  Only an item over a limit is
    split, into as few pieces as fit; a piece that fills a container is a container.  Items without tokens (null, empty)
    take no room and come with a null container.  Repeated rows are items of their own.  Budgets without a positive
    capacity are left out; no items give no rows.

    Items are dealt to groups of about ``group_items`` by a hash of id and piece, so a task packs a bounded number of
    items however many there are; containers that stayed loose in all groups are packed again together.
    """
    kind = items.schema[id_column].dataType.simpleString()
    out = PLACED.format(id=f"`{id_column}`", kind=kind)
    settings = budgets.where("budget_name is not null and capacity_tokens > 0").select("budget_name", "capacity_tokens")
    limits = [
        F.struct(
            F.lit(name).alias("budget_name"),
            F.lit(capacity).cast("long").alias("capacity"),
            F.lit(max(1, capacity // tokens_per_segment)).cast("long").alias("segments"),
            F.lit(max(1, int(capacity * loss_share))).cast("long").alias("loss_capacity"),
        )
        for name, capacity in sorted(map(tuple, settings.distinct().collect()))  # a table of settings
    ]
    if not limits:
        return spark.createDataFrame([], out)
    exact = dict(items.dtypes).get("quiet") == "array<bigint>"
    wanted = items.select(
        id_column, F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("loss_tokens", F.lit(0)).alias("loss_tokens"),
        *(["quiet"] if exact else []),
    )
    every = wanted.withColumn("_b", F.explode(F.array(*limits))).select(*wanted.columns, "_b.*")
    empty = every.where("tokens <= 0")
    pieces = materialize((_exact_pieces if exact else _pieces)(every.where("tokens > 0")), "pieces")
    full = pieces.where("tokens = capacity")
    open_pieces = pieces.where("tokens < capacity")

    columns = ["budget_name", "container_id", id_column, "piece", "first_token", "tokens", "loss_tokens"]

    def packed(rows: DataFrame, label: str) -> DataFrame:
        per_budget = rows.groupBy("budget_name").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per budget
        if not per_budget:
            return spark.createDataFrame([], f"{out}, capacity long, segments long, loss_capacity long, loose boolean")
        counts = [x for r in per_budget for x in (F.lit(r["budget_name"]), F.lit(-(-r["n"] // group_items)))]
        groups = F.create_map(*counts)
        deal = F.pmod(F.xxhash64(id_column, "piece", F.lit(label)), groups[F.col("budget_name")])

        def place(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([id_column, "piece"], kind="stable").reset_index(drop=True)
            head = pdf.iloc[0]
            bins = pack_group(
                pdf["tokens"].to_numpy(), pdf["loss_tokens"].to_numpy(), int(head["capacity"]), int(head["segments"]), int(head["loss_capacity"])
            )
            room = 1 - LOOSE_SHARE
            loose = np.bincount(bins, weights=pdf["tokens"]) < int(head["capacity"]) * room
            loose &= np.bincount(bins) < int(head["segments"])  # one that a limit has closed would not become fuller
            loose &= np.bincount(bins, weights=pdf["loss_tokens"]) < int(head["loss_capacity"]) * room
            pdf["container_id"] = [f"{head['budget_name']}-{label}{head['_group']}-{b}" for b in bins]
            pdf["loose"] = loose[bins]
            return pdf[[*columns, "capacity", "segments", "loss_capacity", "loose"]]

        grouped = rows.withColumn("_group", deal).groupBy("budget_name", "_group")
        return materialize(grouped.applyInPandas(place, f"{out}, capacity long, segments long, loss_capacity long, loose boolean"), "packed")

    first = packed(open_pieces, "a")
    second = packed(first.where("loose").drop("container_id", "loose"), "b")
    own = F.concat_ws("-", "budget_name", F.lit("c"), F.monotonically_increasing_id().cast("string"))
    zero = F.lit(0).cast("long")
    nowhere = empty.select(
        "budget_name", F.lit(None).cast("string").alias("container_id"), id_column,
        zero.alias("piece"), zero.alias("first_token"), zero.alias("tokens"), zero.alias("loss_tokens"),
    )
    return (
        full.withColumn("container_id", own).select(*columns)
        .unionByName(first.where("not loose").select(*columns))
        .unionByName(second.select(*columns))
        .unionByName(nowhere)
    )
