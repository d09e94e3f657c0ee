"""References to records that do not exist, found without a hot key slowing one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelstone.operators.skew import HEAVY_SHARE
from keelstone.session import materialize


def orphan_references(
    references: DataFrame,
    keys: Sequence[str],
    period: Column,
    targets: DataFrame,
    heavy_share: float = HEAVY_SHARE,
) -> DataFrame:
    """``keys, period, n``: how often each missing key is referred to in each period.

    Skew-aware split.  References are pre-aggregated per key and period with map-side partial sums.  Keys that hold at
    least ``heavy_share`` of all references (at most ``1 / heavy_share`` of them, so the broadcast is bounded) are
    looked up in a broadcast; the remaining keys go through a shuffled anti-join, where no key has more rows than there
    are periods.  Both orphan counts are united.

    ``targets`` has the same key columns; repeated targets do no harm.  A reference with a null in a key column equals
    no target and is reported; leave such rows out beforehand if null means "no reference".  Empty references give no
    rows; empty targets make every reference an orphan.  Other columns are ignored, whatever their names; key columns
    must not be called ``period``, ``n`` or ``_total``.
    """
    counted = materialize(
        references.select(*keys, period.alias("period")).groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("n")),
        "references",
    )
    everything = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    per_key = counted.groupBy(*keys).agg(F.sum("n").alias("_total")).where(F.col("_total") >= everything * heavy_share)
    heavy_rows = per_key.orderBy(F.desc("_total"), *keys).limit(int(1 / heavy_share)).select(*keys).collect()
    found = targets.select(*keys)
    if not heavy_rows:
        return counted.join(found, list(keys), "left_anti")
    # heavy_rows holds at most 1 / heavy_share keys, so the two broadcasts below cannot grow with the data
    values = references.sparkSession.createDataFrame(heavy_rows, counted.select(*keys).schema)
    match = reduce(lambda a, b: a & b, [F.col(f"h.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])
    is_heavy = lambda df, how: df.alias("c").join(F.broadcast(values).alias("h"), match, how)
    known = found.join(F.broadcast(values), list(keys), "left_semi").distinct()  # at most the heavy keys
    heavy_orphans = is_heavy(counted, "left_semi").join(F.broadcast(known), list(keys), "left_anti")
    rest_orphans = is_heavy(counted, "left_anti").join(found, list(keys), "left_anti")
    return heavy_orphans.unionByName(rest_orphans)
