"""Column expressions for file metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The value that the metadata store writes for "not set".
NOT_SET = "-5"
#: Epoch values below this are seconds, not milliseconds (1e11 ms is in 1973, 1e11 s in the year 5138).
SECONDS_BELOW = 100_000_000_000


def file_name(path: Column) -> Column:
    """Last component of a path, however the path before it is spelled."""
    return F.substring_index(path, "/", -1)


def is_reference(value: Column) -> Column:
    """True for values that refer to something: neither null, empty nor the "not set" mark."""
    return value.isNotNull() & (value != "") & (value != NOT_SET)


def month_of(epoch: Column) -> Column:
    """``yyyy-MM`` (UTC) of an epoch time in milliseconds or seconds; ``unknown`` if missing or not positive."""
    seconds = F.when(epoch >= SECONDS_BELOW, epoch / 1000).otherwise(epoch)
    month = F.date_format(F.date_from_unix_date(F.floor(seconds / 86400).cast("int")), "yyyy-MM")
    return F.when((epoch > 0) & (epoch < SECONDS_BELOW * 1000), month).otherwise("unknown")
