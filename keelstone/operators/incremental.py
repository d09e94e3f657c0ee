"""Processing only new or changed records.

A state table holds one row per key with a hash of its content.  A run hashes the current rows, joins them with the
state, and writes the outcome of every key once, split by kind of change.  The written folder is both the list of
changes and the next state; a pointer file, created atomically, makes the two visible together.  A run that dies before
the pointer exists leaves the old version in force, so the next run reports the same changes again; a run that is
repeated under the same run id after its commit gets the committed changes back instead of new ones.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from keelstone.operators.skew import unused_names
from keelstone.session import _filesystem

KINDS = ("added", "changed", "removed", "unchanged")
#: Names of the state's own columns.
RESERVED = ("_h1", "_h2", "_kind", "_key", "_old", "_new")


def quoted(name: str) -> str:
    """A column name as it is, whatever signs it holds."""
    return f"`{name.replace('`', '``')}`"


def hash_parts(value: Column, kind: DataType) -> list[Column]:
    """Columns whose hashes together tell any two different values of this type apart.

    Spark's hash skips nulls, runs the elements of nested arrays together and takes no maps.  So every level says whether
    it is null and how many elements it has, and a map is an array of entries in order of its keys.  Values are hashed
    as what they are, not as text: the session's time zone plays no part, and values that print alike stay apart.
    """
    null = value.isNull()
    if isinstance(kind, StructType):
        inner = [p for f in kind.fields for p in hash_parts(value.getField(f.name), f.dataType)]
        return [null, *inner]
    if isinstance(kind, ArrayType):
        return [null, F.size(value), F.transform(value, lambda x: F.struct(*hash_parts(x, kind.elementType)))]
    if isinstance(kind, MapType):
        def entry(e: Column) -> Column:
            key, item = hash_parts(e["key"], kind.keyType), hash_parts(e["value"], kind.valueType)
            return F.struct(F.struct(*key), F.struct(*item))

        return [null, F.size(value), F.array_sort(F.transform(F.map_entries(value), entry))]
    if isinstance(kind, VariantType):
        return [null, F.to_json(value)]
    return [null, value]


class StateConflict(RuntimeError):
    """Another run committed the same state version first."""


@dataclass(frozen=True)
class Version:
    number: int
    run_id: str
    path: str
    schema: str


class StateStore:
    """Versioned key and content-hash state below ``path`` (a URI in a file system that all executors share)."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        if not self.keys:
            raise ValueError("a state needs at least one key column")
        if clash := [k for k in self.keys if k.lower() in RESERVED]:
            raise ValueError(f"reserved names as keys: {', '.join(clash)}")
        self._keys = [quoted(k) for k in self.keys]

    # versions -----------------------------------------------------------------------------------------------------

    def _pointer(self, number: int) -> str:
        return f"{self.path}/_versions/{number:020d}.json"

    def current(self) -> Version | None:
        """The newest committed version, or None before the first run."""
        fs, folder = _filesystem(self.spark, f"{self.path}/_versions")
        if not fs.exists(folder):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        return self._read(names[-1]) if names else None

    def _read(self, name: str) -> Version:
        text = self.spark.read.text(f"{self.path}/_versions/{name}", wholetext=True).first()[0]
        return Version(**json.loads(text))

    def _swap(self, version: Version) -> None:
        """Create the pointer with no overwrite: the one step that commits a run."""
        fs, target = _filesystem(self.spark, self._pointer(version.number))
        temporary = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
            f"{self.path}/_versions/.{version.number:020d}.{version.path.rsplit('/', 1)[-1]}.tmp"
        )
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(version.__dict__), "utf-8"))
        out.close()
        if fs.exists(target) or not fs.rename(temporary, target):
            fs.delete(temporary, False)
            raise StateConflict(f"version {version.number} of {self.path} exists already")

    # content ------------------------------------------------------------------------------------------------------

    def hashed(self, df: DataFrame, content: Sequence[str], unique: bool = False) -> DataFrame:
        """``keys + _h1 + _h2``: one row per key with a 128-bit hash of its content columns.

        Contents are hashed by type (see :func:`hash_parts`), so nulls, empty values, nested values that print alike and
        moved element borders all differ; a changed type of a column changes every row.  Values that SQL takes as equal
        (0.0 and -0.0) are equal.  Several rows of a key are taken as a set: the hash depends on the different contents,
        not on their number or order.  ``unique=True`` promises one row per key and saves that step.  Columns that are
        neither keys nor content are ignored, whatever their names.
        """
        parts = [p for c in content for p in hash_parts(F.col(quoted(c)), df.schema[c].dataType)]
        h1, h2 = F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *reversed(parts))
        rows = df.select(*self._keys, h1.alias("_h1"), h2.alias("_h2"))
        if unique:
            return rows
        wide = "decimal(20,0)"
        sums = rows.distinct().groupBy(*self._keys)
        sums = sums.agg(F.sum(F.col("_h1").cast(wide)).alias("_s1"), F.sum(F.col("_h2").cast(wide)).alias("_s2"))
        return sums.select(*self._keys, F.xxhash64("_s1").alias("_h1"), F.xxhash64("_s2").alias("_h2"))

    def state(self, version: Version | None = None) -> DataFrame | None:
        """Keys and hashes after the newest (or the given) version; None before the first."""
        version = version or self.current()
        return None if version is None else self._load(version).where("_kind <> 'removed'").drop("_kind")

    def changes(self, version: Version) -> DataFrame:
        """Keys that the run of ``version`` found added, changed or removed, with ``_kind``."""
        return self._load(version).where("_kind <> 'unchanged'").drop("_h1", "_h2")

    def _load(self, version: Version) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(version.schema))).parquet(version.path)

    # runs ---------------------------------------------------------------------------------------------------------

    def run(self, current: DataFrame, content: Sequence[str], run_id: str, unique: bool = False) -> Version:
        """Compare ``current`` with the state, write changes and next state, and commit both at once.

        Keys match null-safely.  An empty input removes every key.  If the newest version was committed under this
        ``run_id`` it is returned unchanged, which makes a retry after a crash between commit and answer harmless.
        """
        last = self.current()
        if last is not None and last.run_id == run_id:
            return last
        new = self.hashed(current, content, unique)
        if last is None:
            outcome = new.withColumn("_kind", F.lit("added"))
        else:
            side = F.struct(F.lit(True).alias("here"), "_h1", "_h2")
            old = self.state(last).select(F.struct(*self._keys).alias("_key"), side.alias("_old"))
            new = new.select(F.struct(*self._keys).alias("_key"), side.alias("_new"))
            both = old.join(new, "_key", "full")
            kind = (
                F.when(F.col("_old").isNull(), "added")
                .when(F.col("_new").isNull(), "removed")
                .when(F.col("_old") == F.col("_new"), "unchanged")
                .otherwise("changed")
            )
            kept = F.coalesce("_new", "_old")
            outcome = both.select(
                "_key.*", kept["_h1"].alias("_h1"), kept["_h2"].alias("_h2"), kind.alias("_kind")
            )
        return self._commit(outcome, run_id, last)

    def _commit(self, outcome: DataFrame, run_id: str, last: Version | None) -> Version:
        import uuid

        number = 1 if last is None else last.number + 1
        path = f"{self.path}/v{number}-{uuid.uuid4().hex[:8]}"
        version = Version(number, run_id, path, outcome.schema.json())
        outcome.write.option("compression", "zstd").partitionBy("_kind").parquet(version.path)
        self._swap(version)
        return version

    def process(self, current: DataFrame, content: Sequence[str], run_id: str) -> DataFrame:
        """The rows of ``current`` that are new or changed since the last committed run, all columns kept."""
        version = self.run(current, content, run_id)
        (key,) = unused_names(current, 1)
        wanted = self.changes(version).where("_kind <> 'removed'").select(F.struct(*self._keys).alias(key))
        rows = current.withColumn(key, F.struct(*self._keys))
        return rows.join(wanted, key, "left_semi").drop(key)
