"""Tables: reading, writing, changing and servicing them.

A table is a folder with Parquet files and a commit log (:mod:`keelstone.sources.log`).  Tables with hash columns are
keyed: one row per (range columns, hash columns), cheap upserts that are merged on read.
"""

from __future__ import annotations


import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import replace
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.errors import ConflictError, EngineError, NotFoundError, SchemaError, UnsupportedError
from keelstone.operators import merge as merging
from keelstone.operators import sorted_runs
from keelstone.operators.merge import MergeOperator
from keelstone.session import qualified, remove_path
from keelstone.sources import schema as schemas
from keelstone.sources.files import BUCKET_SCAN_BYTES, bucket_of, expired_on_disk, list_files, prune_ranges, range_key, scan, scan_kind, write_files
from keelstone.sources.log import (
    COMPACTION,
    DELTA,
    PART_COMPACTION,
    SIMPLE,
    CommitLog,
    DataFile,
    Meta,
    Snapshot,
)

# --- fixed values ---
#: Session settings and their defaults.
SETTINGS = {
    "spark.keelstone.schema.autoMerge.enabled": "false",
    "spark.keelstone.deltaFile.enabled": "true",
    "spark.keelstone.deltaFile.max.num": "5",
    "spark.keelstone.compaction.interval": "12",  # hours
    "spark.keelstone.cleanup.interval": "5",  # hours
    "spark.keelstone.full.partitioned.table.scan.enabled": "false",
    "spark.keelstone.part.merge.enable": "false",
    "spark.keelstone.part.merge.file.minimum.num": "5",
    "spark.keelstone.allow.stale.materialView": "false",
    "spark.keelstone.material.query.rewrite.enable": "true",
    "spark.keelstone.bucket.scan.max.bytes": str(BUCKET_SCAN_BYTES),
}
#: Table properties that the engine knows.
PROPERTIES = {"keelstone.appendOnly", "keelstone.sortBy"}
# --- end of fixed values ---
HOUR_MS = 3_600_000
_LOGS: dict[str, CommitLog] = {}


def setting(spark: SparkSession, name: str) -> str:
    key = f"spark.keelstone.{name}"
    return spark.conf.get(key, SETTINGS[key])


def enabled(spark: SparkSession, name: str) -> bool:
    return setting(spark, name).lower() == "true"


def check_properties(properties: dict[str, str]) -> None:
    unknown = sorted(k for k in properties if k.startswith("keelstone.") and k not in PROPERTIES)
    if unknown:
        raise EngineError(f"unknown table properties: {', '.join(unknown)}")


def _names(columns: str | Sequence[str] | None) -> list[str]:
    if columns is None:
        return []
    parts = columns.split(",") if isinstance(columns, str) else columns
    return [p.strip() for p in parts if p.strip()]


def _sql_of(condition: str | Column | None, name: str = "condition") -> str | Column | None:
    if condition is not None and not isinstance(condition, (str, Column)):
        raise TypeError(f"{name} must be a Spark SQL Column or a string, not {type(condition).__name__}")
    return condition


def _as_column(condition: str | Column) -> Column:
    return F.expr(condition) if isinstance(condition, str) else condition


class Table:
    """A handle on the table at a path. A path that goes on into a range partition narrows reads to it."""

    def __init__(self, spark: SparkSession, path: str, only: dict[str, str] | None = None):
        self.spark, self.path, self.only = spark, qualified(path).rstrip("/"), only or {}
        self.log = _LOGS.setdefault(self.path, CommitLog(spark, self.path))
        self.log.spark = spark

    # finding --------------------------------------------------------------------------------------------------------

    @classmethod
    def forPath(cls, spark: SparkSession, path: str) -> Table:
        """The table at ``path``; ``path/k=v`` is the table restricted to a range partition."""
        root, only = qualified(path).rstrip("/"), {}
        while not cls.isTable(spark, root):
            root, _, last = root.rpartition("/")
            if "=" not in last or not root:
                raise NotFoundError(f"no table at {path}")
            name, _, value = last.partition("=")
            only[name] = value
        table = cls(spark, root, only)
        unknown = [c for c in only if c not in table.meta.range_columns]
        if unknown:
            raise NotFoundError(f"{', '.join(unknown)}: no range column of {root}")
        return table

    @classmethod
    def forName(cls, spark: SparkSession, name: str) -> Table:
        from keelstone.catalog import lookup

        return cls.forPath(spark, lookup(spark, name))

    @staticmethod
    def isTable(spark: SparkSession, path: str) -> bool:
        root = qualified(path).rstrip("/")
        return _LOGS.setdefault(root, CommitLog(spark, root)).snapshot().meta is not None

    @staticmethod
    def createTable(spark: SparkSession, data: DataFrame, path: str) -> TableCreator:
        return TableCreator(spark, data, path)

    @staticmethod
    def registerMergeOperator(spark: SparkSession, name: str, operator: MergeOperator | Callable) -> None:
        merging.register(name, operator)

    # state ----------------------------------------------------------------------------------------------------------

    def snapshot(self) -> Snapshot:
        state = self.log.snapshot()
        if state.meta is None:
            raise NotFoundError(f"no table at {self.path}")
        return state

    @property
    def meta(self) -> Meta:
        return self.snapshot().meta

    def _files(self, state: Snapshot, condition: str | Column | None = None) -> list[DataFile]:
        """Files that can hold rows for ``condition``: by range values, and by bucket for equalities on all keys."""
        files = list(state.files.values())
        for name, value in self.only.items():
            files = [f for f in files if str(f.range_values.get(name)) == value]
        if condition is None or not files:
            return files
        for part in self._range_parts(state, condition):
            keys = prune_ranges(self.spark, state, part)
            if keys is not None:
                files = [f for f in files if f.range_key in keys]
        bucket = self._bucket(state.meta, condition)
        return files if bucket is None else [f for f in files if f.bucket in (bucket, -1)]

    def _conjuncts(self, state: Snapshot, condition: str | Column) -> list:
        """The analysed condition as a list of Catalyst expressions joined by AND."""
        empty = self.spark.createDataFrame([], state.meta.struct)
        plan = empty.where(condition)._jdf.queryExecution().analyzed()
        parts, todo = [], [plan.condition()]
        while todo:
            e = todo.pop()
            if e.prettyName() == "and":
                todo += [e.left(), e.right()]
            else:
                parts.append(e)
        return parts

    def _range_parts(self, state: Snapshot, condition: str | Column) -> list[str]:
        ranges = {c.lower() for c in state.meta.range_columns}
        parts = []
        for e in self._conjuncts(state, condition):
            used = e.references().toSeq()
            names = {used.apply(i).name().lower() for i in range(used.size())}
            if names and names <= ranges and e.deterministic():
                parts.append(e.sql().replace("spark_catalog.", ""))
        return parts

    def _bucket(self, meta: Meta, condition: str | Column) -> int | None:
        if not meta.keyed:
            return None
        fixed = {}
        for e in self._conjuncts(Snapshot(meta=meta), condition):
            if e.prettyName() in ("equalto", "equalnullsafe"):
                sides = [e.left(), e.right()]
                for a, b in (sides, sides[::-1]):
                    if a.prettyName() not in ("literal", "cast") and not a.children().size() and b.foldable():
                        fixed[a.sql().strip("`").rpartition(".")[2].strip("`")] = b.sql()
        if not all(k in fixed for k in meta.hash_columns):
            return None
        row = self.spark.range(1).select(
            *[F.expr(fixed[k]).cast(meta.struct[k].dataType).alias(k) for k in meta.hash_columns]
        )
        return row.select(bucket_of(meta.hash_columns, meta.bucket_num)).first()[0]

    # reading --------------------------------------------------------------------------------------------------------

    def toDF(self, condition: str | Column | None = None, merge: dict[str, str | MergeOperator | Callable] | None = None) -> DataFrame:
        """The table's rows. ``condition`` filters, and prunes partitions and buckets before anything is read.

        ``merge`` names merge operators for columns of a keyed table; other columns take their newest value.  With the setting
        ``part.merge.enable``, partitions with many versions have the oldest of them folded first; not under operators,
        since these need every version as it is.
        """
        state = self.snapshot()
        if state.meta.keyed and not merge and state.meta.view is None and enabled(self.spark, "part.merge.enable"):
            try:
                state = self.part_compaction()
            except ConflictError:  # another one folds them; the rows are the same
                state = self.snapshot()
        if state.meta.view is not None and not enabled(self.spark, "allow.stale.materialView"):
            from keelstone.plans.views import is_stale

            if is_stale(self.spark, state.meta):
                raise EngineError(f"the materialized view at {self.path} is stale; update it or allow stale views")
        rows = scan(self.spark, state.meta, self.path, self._files(state, condition), self._operators(state.meta, merge))
        return rows if condition is None else rows.where(condition)

    to_df = toDF

    def alias(self, name: str) -> DataFrame:
        return self.toDF().alias(name)

    def scanKind(self, condition: str | Column | None = None) -> str:
        state = self.snapshot()
        return scan_kind(state.meta, self._files(state, condition))

    def intersectKeys(self, other: Table) -> DataFrame:
        """The keys (hash columns) that both tables have, each once; see :meth:`_key_operation`."""
        return self._key_operation(other, "left_semi")

    def exceptKeys(self, other: Table) -> DataFrame:
        """The keys (hash columns) that the other table has not, each once; see :meth:`_key_operation`."""
        return self._key_operation(other, "left_anti")

    def _key_operation(self, other: Table, how: str) -> DataFrame:
        """A set operation on the keys as a join: keys are never null and, without range columns, unique, so neither
        null-safe comparison nor a distinct is needed, and tables with as many buckets are not shuffled."""
        mine, theirs = self.meta, other.meta
        if not mine.keyed or len(mine.hash_columns) != len(theirs.hash_columns):
            raise UnsupportedError("set operations on keys need tables with as many hash columns")
        left = self.toDF().select(*[F.col(f"`{c}`") for c in mine.hash_columns])
        right = other.toDF().select(*[F.col(f"`{c}`").alias(f"_key_{i}") for i, c in enumerate(theirs.hash_columns)])
        same = [F.col(f"`{c}`") == F.col(f"_key_{i}") for i, c in enumerate(mine.hash_columns)]
        joined = left.join(right, same, how)
        return joined.distinct() if mine.range_columns else joined

    def _operators(self, meta: Meta, merge: dict | None) -> dict[str, MergeOperator]:
        if not merge:
            return {}
        if not meta.keyed:
            raise UnsupportedError("merge operators need a table with hash columns")
        by_lower = {n.lower(): n for n in meta.struct.names}
        chosen: dict[str, MergeOperator] = {}
        for column, operator in merge.items():
            name = by_lower.get(column.lower())
            if name is None:
                raise NotFoundError(f"no column {column}")
            if name in chosen:
                raise EngineError(f"two merge operators for {name}")
            chosen[name] = merging.resolve(operator)
        return chosen

    # writing --------------------------------------------------------------------------------------------------------

    def _evolve(self, meta: Meta, data: DataFrame, merge_schema: bool | None) -> Meta:
        schemas.check_names(data.schema)
        found = schemas.differences(meta.struct, data.schema)
        if not found:
            return meta
        allowed = enabled(self.spark, "schema.autoMerge.enabled") if merge_schema is None else merge_schema
        if not allowed:
            raise SchemaError("the rows do not fit the table: " + "; ".join(found))
        merged = schemas.merge_schemas(meta.struct, data.schema)
        return Meta(**{**meta.__dict__, "schema": merged.json()})

    def _commit(self, state: Snapshot, kind: str, add: Sequence[DataFile] = (), expire: Iterable[DataFile] = (), meta: Meta | None = None,
                stream: dict | None = None, ranges: Iterable[str] | None = None, blind: bool = False, touched: Iterable[str] = ()) -> Snapshot:
        expired = list(expire)
        if expired and kind == SIMPLE and state.meta and state.meta.properties.get("keelstone.appendOnly", "").lower() == "true":
            raise UnsupportedError("the table is append-only")
        commit = {
            "kind": kind,
            "add": [f.__dict__ | {"columns": list(f.columns)} for f in add],
            "expire": [f.path for f in expired],
            "touched": sorted({f.range_key for f in expired} | set(touched)),
            "blind": blind,
        }
        if meta is not None and meta != state.meta:
            commit["meta"] = meta.__dict__
        if stream:
            commit["stream"] = stream
        return self.log.commit(state, commit, [f.path for f in expired], ranges)

    def write(
        self, data: DataFrame, mode: str = "append", *, range_partitions=None, hash_partitions=None, bucket_num: int | None = None,
        short_name: str | None = None, replace_where: str | None = None, merge_schema: bool | None = None,
        overwrite_schema: bool = False, properties: dict[str, str] | None = None, stream: dict | None = None, view: dict | None = None,
    ) -> Snapshot:
        """Write rows; creates the table if there is none.

        Modes ``error``, ``ignore``, ``append``, ``overwrite``.  Keyed tables take no appends (use :meth:`upsert`).
        ``replace_where`` overwrites only the range partitions that satisfy it, and the new rows must satisfy it too.
        """
        mode = {"errorifexists": "error"}.get(mode.lower(), mode.lower())
        if mode not in ("error", "ignore", "append", "overwrite"):
            raise UnsupportedError(f"unknown mode {mode}")
        data = schemas.drop_void(data)
        state = self.log.snapshot()
        ranges, hashes = _names(range_partitions), _names(hash_partitions)
        if state.meta is None:
            meta = self._new_meta(data, ranges, hashes, bucket_num, short_name, properties, view)
            add = write_files(data, meta, self.path)
            state = self._commit(state, SIMPLE, add, meta=meta, stream=stream)
            if short_name:
                from keelstone.catalog import register_name

                register_name(self.spark, short_name, self.path)
            return state
        if mode == "error":
            raise EngineError(f"a table exists at {self.path}")
        if mode == "ignore":
            return state
        meta = state.meta
        if meta.view is not None and view is None:
            raise UnsupportedError("rows of a materialized view come from its query only")
        if mode == "append" and meta.keyed:
            raise UnsupportedError("a keyed table takes upserts, not appends")
        for given, mine, what in ((ranges, meta.range_columns, "range columns"), (hashes, meta.hash_columns, "hash columns")):
            if given and [g.lower() for g in given] != [m.lower() for m in mine]:
                raise SchemaError(f"{what} are {mine}, not {given}")
        if bucket_num is not None and meta.keyed and bucket_num != meta.bucket_num:
            raise SchemaError(f"the table has {meta.bucket_num} buckets, not {bucket_num}")
        if mode == "overwrite" and overwrite_schema:
            if replace_where is not None:
                raise UnsupportedError("overwriteSchema and replaceWhere exclude each other")
            fresh = self._new_meta(data, meta.range_columns, meta.hash_columns, meta.bucket_num, meta.short_name, meta.properties, meta.view)
            meta = Meta(**{**fresh.__dict__, "table_id": meta.table_id})
        else:
            meta = self._evolve(meta, data, merge_schema)
        if view is not None:
            meta = Meta(**{**meta.__dict__, "view": view})
        if mode == "append":
            return self._commit(state, SIMPLE, write_files(data, meta, self.path), meta=meta, stream=stream, blind=True)
        old, touched = list(state.files.values()), None
        if replace_where is not None:
            keys = prune_ranges(self.spark, state, replace_where) if state.files else set()
            empty = self.spark.createDataFrame([], T.StructType([meta.struct[c] for c in meta.range_columns]))
            try:
                empty.where(replace_where)
            except AnalysisException as e:
                raise UnsupportedError(f"replaceWhere must be about range columns: {replace_where}") from e
            outside = ~F.coalesce(F.expr(replace_where), F.lit(False))
            if data.where(outside).limit(1).count():
                raise EngineError(f"rows do not satisfy replaceWhere {replace_where}")
            old, touched = [f for f in old if f.range_key in (keys or set())], keys
        return self._commit(state, SIMPLE, write_files(data, meta, self.path), old, meta=meta, stream=stream, ranges=touched)

    def _new_meta(self, data: DataFrame, ranges: Sequence[str], hashes: Sequence[str], buckets: int | None, short_name, properties, view) -> Meta:
        schemas.check_names(data.schema)
        by_lower = {n.lower(): n for n in data.schema.names}
        try:
            ranges, hashes = [by_lower[c.lower()] for c in ranges], [by_lower[c.lower()] for c in hashes]
        except KeyError as e:
            raise SchemaError(f"no column {e.args[0]} for the layout") from e
        if set(ranges) & set(hashes):
            raise SchemaError("a column is range or hash column, not both")
        if hashes and not (buckets and buckets > 0):
            raise SchemaError("hash columns need a number of buckets")
        if len(ranges) == len(data.schema.names):
            raise SchemaError("a table needs a column besides its range columns")
        check_properties(properties or {})
        properties, sort_by = dict(properties or {}), (properties or {}).get("keelstone.sortBy")
        if sort_by is not None:
            if hashes or sort_by.lower() not in by_lower or by_lower[sort_by.lower()] in ranges:
                raise SchemaError(f"files cannot be sorted by {sort_by}: it takes a plain column of a table without hash columns")
            properties["keelstone.sortBy"] = by_lower[sort_by.lower()]
        keys = {*ranges, *hashes, *([properties["keelstone.sortBy"]] if sort_by is not None else [])}
        fields = [T.StructField(f.name, f.dataType, f.name not in keys and (f.nullable or not _declared(f)), f.metadata) for f in data.schema.fields]
        return Meta(f"table_{uuid.uuid4()}", T.StructType(fields).json(), ranges, hashes, int(buckets or -1) if hashes else -1,
                    dict(properties or {}), short_name, view)

    # upsert ---------------------------------------------------------------------------------------------------------

    def upsert(self, source: DataFrame, condition: str = "", *, merge_schema: bool | None = None, stream: dict | None = None) -> Snapshot:
        """Insert rows and update those whose keys exist.

        By default rows are appended as delta files and merged on read; columns that ``source`` lacks keep their values
        and ``condition`` is not used.  With ``deltaFile.enabled`` off, the partitions that satisfy ``condition`` are
        rewritten: the source is filtered by it, and a null in the source keeps the old value.
        """
        if not isinstance(source, DataFrame):
            source = DataFrame(source, self.spark)
        state = self.snapshot()
        meta = state.meta
        if not meta.keyed:
            raise UnsupportedError("upsert needs a table with hash columns")
        if meta.view is not None:
            raise UnsupportedError("rows of a materialized view come from its query only")
        source = schemas.drop_void(source)
        have = {c.lower() for c in source.columns}
        missing = [c for c in [*meta.range_columns, *meta.hash_columns] if c.lower() not in have]
        if missing:
            raise SchemaError(f"the source lacks key columns: {', '.join(missing)}")
        if condition:
            self._check_condition(condition, state)
        evolved = self._evolve(meta, source, merge_schema)
        if enabled(self.spark, "deltaFile.enabled"):
            return self._commit(state, DELTA, write_files(source, evolved, self.path), meta=evolved, stream=stream)
        if not condition and meta.range_columns and not enabled(self.spark, "full.partitioned.table.scan.enabled"):
            raise UnsupportedError("this upsert rewrites partitions; give a condition on range columns")
        keys = prune_ranges(self.spark, state, condition) if condition and state.files else None
        if condition and state.files and keys is None:
            raise UnsupportedError(f"the condition must be about range columns: {condition}")
        files = [f for f in state.files.values() if keys is None or f.range_key in keys]
        target = scan(self.spark, meta, self.path, files)
        rows = schemas.align(source, evolved.struct)
        rows = rows.where(condition) if condition else rows
        on = [*meta.range_columns, *meta.hash_columns]
        joined = target.alias("t").join(_last_per_key(rows, on).alias("s"), on, "full")
        columns = []
        for f in evolved.struct.fields:
            both = [F.col(f"{side}.`{f.name}`") for side, names in (("s", rows.columns), ("t", target.columns)) if f.name in names]
            columns.append((F.col(f"`{f.name}`") if f.name in on else F.coalesce(*both)).alias(f.name))
        add = write_files(joined.select(*columns), evolved, self.path, unique=True)
        return self._commit(state, SIMPLE, add, files, meta=evolved, stream=stream, ranges=keys)

    def _check_condition(self, condition: str | Column, state: Snapshot) -> None:
        """Conditions must be deterministic, without aggregates and subqueries."""
        expression = _as_column(condition)
        try:
            plan = self.spark.createDataFrame([], state.meta.struct).where(expression)._jdf.queryExecution().analyzed()
        except AnalysisException as e:
            if "AGGREGATE" in (e.getCondition() or "") or "INVALID_WHERE" in (e.getCondition() or ""):
                raise UnsupportedError(f"aggregates are not allowed in a condition: {condition}") from e
            raise
        if _has_subquery(plan.condition()):
            raise UnsupportedError(f"subqueries are not allowed in a condition: {condition}")
        if not plan.condition().deterministic():
            raise UnsupportedError(f"a condition must be deterministic: {condition}")

    # delete and update ----------------------------------------------------------------------------------------------

    def delete(self, condition: str | Column | None = None) -> Snapshot:
        """Delete the rows for which the condition is true (not null). Without one, all rows go.

        A condition on range columns alone only changes the log; otherwise files (buckets of keyed tables) with rows to
        delete are rewritten.
        """
        _sql_of(condition)
        state = self.snapshot()
        self._check_view(state)
        if condition is None:
            return self._commit(state, SIMPLE, (), list(state.files.values()))
        self._check_condition(condition, state)
        conjuncts = self._conjuncts(state, condition)
        if state.files and len(self._range_parts(state, condition)) == len(conjuncts) and state.meta.range_columns:
            keys = set.intersection(*[prune_ranges(self.spark, state, p) or set() for p in self._range_parts(state, condition)])
            gone = [f for f in state.files.values() if f.range_key in keys]
            return self._commit(state, SIMPLE, (), gone, ranges=keys) if gone else state
        true = _as_column(condition).eqNullSafe(F.lit(True))
        return self._rewrite(state, condition, true, lambda rows: rows.where(~true))

    def update(self, condition: str | Column | None = None, set: dict | None = None) -> Snapshot:  # noqa: A002
        """Set columns (or fields of structs, dotted) in the rows for which the condition is true."""
        if set is None:
            raise ValueError("'set' cannot be None")
        if not isinstance(set, dict):
            raise TypeError(f"'set' must be a dict, not {type(set).__name__}")
        if condition is not None and not isinstance(condition, (str, Column)):
            raise TypeError(f"'condition' must be a Spark SQL Column or a string, not {type(condition).__name__}")
        for k, v in set.items():
            if not isinstance(k, str):
                raise TypeError(f"Keys of dict in 'set' must contain only strings, not {type(k).__name__}")
            if not isinstance(v, (str, Column)):
                raise TypeError(f"Values of dict in 'set' must contain only Spark SQL Columns or strings, not {type(v).__name__}")
        state = self.snapshot()
        self._check_view(state)
        if condition is not None:
            self._check_condition(condition, state)
        columns = _assignments(state.meta.struct, set)
        true = F.lit(True) if condition is None else _as_column(condition).eqNullSafe(F.lit(True))

        def change(rows: DataFrame) -> DataFrame:
            done = rows.withColumn("__hit", true)
            return done.select(
                *[
                    F.when(F.col("__hit"), columns[c].cast(rows.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`")
                    for c in rows.columns
                ]
            )

        return self._rewrite(state, condition, true, change)

    def updateExpr(self, condition: str | Column | None = None, set: dict[str, str] | None = None) -> Snapshot:  # noqa: A002
        return self.update(condition, set)

    def _check_view(self, state: Snapshot) -> None:
        if state.meta.view is not None:
            raise UnsupportedError("rows of a materialized view come from its query only")

    def _rewrite(self, state: Snapshot, condition, true: Column, change: Callable[[DataFrame], DataFrame]) -> Snapshot:
        """Rewrite what holds matching rows: single files, or all versions of a bucket in keyed tables."""
        meta, files = state.meta, self._files(state, condition)
        if not files:
            return state
        read = {f.range_key for f in files} if meta.range_columns else None
        rows = scan(self.spark, meta, self.path, files)
        if meta.keyed:
            bucket = bucket_of(meta.hash_columns, meta.bucket_num).alias("b")
            texts = [F.col(f"`{c}`").cast("string").alias(f"r{i}") for i, c in enumerate(meta.range_columns)]
            hits = rows.where(true).select(*texts, bucket).distinct().collect()  # at most one row per bucket of a partition
            wanted = {(range_key({c: r[f"r{i}"] for i, c in enumerate(meta.range_columns)}), r["b"]) for r in hits}
            touched = [f for f in files if (f.range_key, f.bucket) in wanted]
        else:
            located = rows.withColumn("__p", F.regexp_extract(F.input_file_name(), r"/(data/[0-9a-f]{32}/.*)$", 1))
            hits = located.where(true).select("__p").distinct().collect()  # one row per file with matches
            found = {unquote(r["__p"]) for r in hits}  # Spark reports paths URI-encoded
            touched = [f for f in files if f.path in found]
        if not touched:
            return state
        add = write_files(change(scan(self.spark, meta, self.path, touched)), meta, self.path)
        return self._commit(state, SIMPLE, add, touched, ranges=read)

    # services -------------------------------------------------------------------------------------------------------

    def compaction(self, condition: str | Column | None = None, force: bool = True, mergeOperatorInfo: dict | None = None) -> Snapshot:
        """Fold the deltas of partitions into base files. A condition must select exactly one range partition.

        Without ``force``, partitions with few deltas that were compacted lately are left alone.  Deltas that others
        commit meanwhile stay deltas on top of the new base.  ``mergeOperatorInfo`` folds columns by merge operators.
        Tables without hash columns have their files of each partition put together.
        """
        state = self.snapshot()
        files = self._files(state, condition)
        keys = {f.range_key for f in files}
        if condition is not None and len(keys) != 1:
            raise NotFoundError(f"the condition selects {len(keys)} partitions, not one")
        limit, hours = int(setting(self.spark, "deltaFile.max.num")), float(setting(self.spark, "compaction.interval"))
        now, due = time.time() * 1000, set()
        for key in keys:
            known = state.partitions.get(key)
            old = known is None or known.deltas >= limit or (not known.compacted and now - known.updated_ms > hours * HOUR_MS)
            if (force or old) and not all(f.is_base for f in files if f.range_key == key):
                due.add(key)
        return self._fold(state, [f for f in files if f.range_key in due], COMPACTION, mergeOperatorInfo)

    def part_compaction(self, merge: dict | None = None, minimum: int | None = None) -> Snapshot:
        """Where a partition has more than ``minimum`` versions, fold the oldest of them into one."""
        state = self.snapshot()
        least = minimum or int(setting(self.spark, "part.merge.file.minimum.num"))
        by_key: dict[str, list[DataFile]] = {}
        for f in state.files.values():
            by_key.setdefault(f.range_key, []).append(f)
        oldest = []
        for own in by_key.values():
            orders = sorted({f.order for f in own})
            if len(orders) > least:
                oldest += [f for f in own if f.order <= orders[len(orders) - least]]
        return self._fold(state, oldest, PART_COMPACTION, merge)

    def consolidate(
        self, small_bytes: int = sorted_runs.SMALL_BYTES, min_files: int = sorted_runs.MIN_FILES, target_bytes: int = sorted_runs.TARGET_BYTES,
        fan_in: int = sorted_runs.FAN_IN,
    ) -> Snapshot:
        """Merge the small files of a table whose files are sorted (property ``keelstone.sortBy``) into few sorted ones.

        Files below ``small_bytes`` of partitions that have at least ``min_files`` of them are runs of the external merge;
        no row is shuffled, lost or doubled.  One commit takes the runs out and puts the new files in, so readers see one
        or the other; if a run is gone by then, the commit is refused and the new files are left to :meth:`cleanup`.
        Files with other columns (before a change of the schema) are merged among themselves.
        """
        state = self.snapshot()
        sort_by = state.meta.properties.get("keelstone.sortBy")
        if sort_by is None:
            raise UnsupportedError("only tables with the property keelstone.sortBy have sorted files")
        groups: dict[tuple, list[DataFile]] = {}
        for f in state.files.values():
            if 0 < f.size < small_bytes:
                groups.setdefault((tuple(f.columns), f.range_key), []).append(f)
        by_columns: dict[tuple, list[DataFile]] = {}
        for (columns, _), own in groups.items():
            if len(own) >= min_files:
                by_columns.setdefault(columns, []).extend(own)
        add, gone = [], []
        for columns, own in by_columns.items():
            folder = lambda f: "/".join(f.path.split("/")[2:-1])  # noqa: E731  the directories of its partition
            token = f"data/{uuid.uuid4().hex}"
            listed = self.spark.createDataFrame([(folder(f), f.order, f"{self.path}/{f.path}") for f in own], "grp string, at int, path string")
            merged = sorted_runs.merge_sorted_files(
                self.spark, listed, sort_by, f"{self.path}/{token}", target_bytes, fan_in=fan_in, group="grp", order_by=["at"]
            )
            kept = {r["path"][len(self.path) + 1 :] for r in merged.select("path").collect()}  # one per target_bytes
            like, newest = {folder(f): f for f in own}, max(f.order for f in own)
            for path, size, _ in list_files(self.spark, f"{self.path}/{token}"):
                if f"{token}/{path}" in kept:
                    add.append(replace(like[path.rpartition("/")[0]], path=f"{token}/{path}", size=size, order=newest, is_base=True))
            gone += own
        return self._commit(state, COMPACTION, add, gone) if gone else state

    def _fold(self, state: Snapshot, files: list[DataFile], kind: str, merge: dict | None) -> Snapshot:
        """Merge files into one version per bucket: one job and one commit for all partitions.

        The result stands in the order of versions where the newest of its partition's merged files stood.
        """
        operators = self._operators(state.meta, merge)
        if not files:
            return state
        newest: dict[str, int] = {}
        for f in files:
            newest[f.range_key] = max(newest.get(f.range_key, 0), f.order)
        rows = scan(self.spark, state.meta, self.path, files, operators)
        if not state.meta.keyed and not state.meta.range_columns:
            rows = rows.hint("rebalance")
        written = write_files(rows, state.meta, self.path, base=kind == COMPACTION, checked=False, unique=True)
        return self._commit(state, kind, [replace(f, order=newest[f.range_key]) for f in written], files)

    def cleanup(self, justList: bool | None = None) -> list[str]:
        """Delete (or only list) files that no snapshot needs and that are older than the retention."""
        if justList is not None and not isinstance(justList, bool):
            raise TypeError(f"justList must be a bool, not {type(justList).__name__}")
        state = self.snapshot()
        hours = float(setting(self.spark, "cleanup.interval"))
        old = expired_on_disk(self.spark, state, self.path, int(hours * HOUR_MS))
        if not justList:
            for path in old:
                remove_path(self.spark, f"{self.path}/{path}")
        return old

    def dropPartition(self, condition: str | Column) -> Snapshot:
        """Drop the one range partition that the condition selects."""
        _sql_of(condition)
        state = self.snapshot()
        keys = prune_ranges(self.spark, state, condition) if state.files else set()
        if not keys or len(keys) != 1:
            raise NotFoundError(f"the condition selects {len(keys or ())} partitions, not one")
        gone = [f for f in state.files.values() if f.range_key in keys]
        return self._commit(state, SIMPLE, (), gone, ranges=keys)

    def dropTable(self) -> None:
        """Drop the views that depend on the table, its names, and its folder."""
        from keelstone.catalog import forget_path
        from keelstone.plans.views import drop_views_of

        self.snapshot()
        drop_views_of(self.spark, self.path)
        forget_path(self.spark, self.path)
        remove_path(self.spark, self.path)
        _LOGS.pop(self.path, None)

    def set_meta(self, change: Callable[[Meta], Meta]) -> Snapshot:
        """Commit a change of schema or settings."""
        state = self.snapshot()
        return self._commit(state, SIMPLE, meta=change(state.meta), blind=True)

    def updateMaterialView(self) -> bool:
        from keelstone.plans.views import update_view

        return update_view(self.spark, self)


def _has_subquery(expression) -> bool:
    if expression.getClass().getSimpleName() in ("InSubquery", "ScalarSubquery", "Exists", "ListQuery"):
        return True
    children = expression.children()
    return any(_has_subquery(children.apply(i)) for i in range(children.size()))


def _declared(field: T.StructField) -> bool:
    """True if a NOT NULL is meant as a constraint and not just a result of how the rows were made."""
    return bool((field.metadata or {}).get("keelstone.notNull"))


def _last_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    marked = rows.withColumn("__at", F.monotonically_increasing_id())
    last = marked.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__at").alias("__w"))
    return last.select(*keys, *[F.col("__w").getField(c).alias(c) for c in rest])


def _assignments(schema: T.StructType, assigned: dict[str, str | Column]) -> dict[str, Column]:
    """New values by top-level column; dotted names change fields inside structs."""
    by_lower = {n.lower(): n for n in schema.names}
    paths = {tuple(p.strip("`") for p in name.split(".")): value for name, value in assigned.items()}
    lowered = [tuple(x.lower() for x in p) for p in paths]
    for i, a in enumerate(lowered):
        for b in lowered[i + 1 :]:
            if a[: len(b)] == b[: len(a)]:
                raise EngineError(f"conflicting assignments: {'.'.join(a)} and {'.'.join(b)}")
    columns: dict[str, Column] = {}
    for path, value in paths.items():
        top = by_lower.get(path[0].lower())
        if top is None:
            raise NotFoundError(f"no column {path[0]}")
        new = _as_column(value)
        if len(path) == 1:
            columns[top] = new
            continue
        kind: T.DataType = schema[top].dataType
        names = []
        for step in path[1:]:
            if not isinstance(kind, T.StructType):
                raise EngineError(f"{'.'.join(path)}: {step} is not inside a struct")
            own = {n.lower(): n for n in kind.names}.get(step.lower())
            if own is None:
                raise NotFoundError(f"no field {step} in {'.'.join(path)}")
            kind = kind[own].dataType
            names.append(own)
        columns[top] = columns.get(top, F.col(f"`{top}`")).withField(".".join(f"`{n}`" for n in names), new.cast(kind))
    return columns


class TableCreator:
    """``Table.createTable(spark, df, path).rangePartitions("a").hashPartitions("k").hashBucketNum(4).create()``."""

    def __init__(self, spark: SparkSession, data: DataFrame, path: str):
        self.table, self.data, self.options = Table(spark, path), data, {}

    def rangePartitions(self, columns: str | Sequence[str]) -> TableCreator:
        self.options["range_partitions"] = columns
        return self

    def hashPartitions(self, columns: str | Sequence[str]) -> TableCreator:
        self.options["hash_partitions"] = columns
        return self

    def hashBucketNum(self, number: int) -> TableCreator:
        self.options["bucket_num"] = int(number)
        return self

    def shortTableName(self, name: str) -> TableCreator:
        self.options["short_name"] = name
        return self

    def tableProperty(self, key: str, value: str) -> TableCreator:
        self.options.setdefault("properties", {})[key] = value
        return self

    def create(self) -> Table:
        self.table.write(self.data, "overwrite", **self.options)
        return self.table


def read(spark: SparkSession, path: str, condition: str | Column | None = None, merge: dict | None = None) -> DataFrame:
    return Table.forPath(spark, path).toDF(condition, merge)


__all__ = ["ConflictError", "Table", "TableCreator", "read"]
