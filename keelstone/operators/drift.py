"""Schemas that drift: rows as path-value maps, type statistics per file, one typed table, and a report of each change."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from keelstone.operators.skew import running_total
from keelstone.operators.sorted_runs import open_parquet
from keelstone.session import list_files, qualified

# --- fixed values ---
#: Other names of the same type.
TYPE_SYNONYMS = {"int": "integer", "bigint": "long", "smallint": "short", "tinyint": "byte", "real": "float"}
#: Types from narrow to wide; a path whose files disagree gets the narrowest type that holds all of them.
NUMBER_WIDTH = ["boolean", "long", "double"]
# --- end of fixed values ---

#: One entry of a schema: path of the parent and own name as written, raw type, place among its siblings, field id.
ENTRY = T.StructType(
    [
        T.StructField("parent", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("id", T.StringType()),
    ]
)
#: Values that a typed table could not take.
FAILED = "array<struct<path:string,type:string,value:string>>"
CHANGE = T.StructType([T.StructField("change", T.StringType()), T.StructField("field_name", T.StringType())])


# one schema as a map from path to raw type ----------------------------------------------------------------------------


def type_text(kind: object) -> str:
    """A type as text in which spelling, nullability and comments make no difference."""
    if isinstance(kind, str):
        text = kind.strip().lower().replace(" ", "")
        return TYPE_SYNONYMS.get(text, text)
    if not isinstance(kind, dict):
        return "unknown"
    tag = kind.get("type")
    if tag == "struct":
        inner = (f"{str(f.get('name')).lower()}:{type_text(f.get('type'))}" for f in kind.get("fields") or [])
        return f"struct<{','.join(inner)}>"
    if tag == "array":
        return f"array<{type_text(kind.get('elementType'))}>"
    if tag == "map":
        return f"map<{type_text(kind.get('keyType'))},{type_text(kind.get('valueType'))}>"
    return type_text(tag) if isinstance(tag, str) else "unknown"


def _fields(schema: object) -> list[dict]:
    if isinstance(schema, dict) and schema.get("type") == "struct":
        return [f for f in schema.get("fields") or [] if isinstance(f, dict) and f.get("name") is not None]
    return []


def _parse(text: str | None) -> dict | None:
    """The schema of a JSON text; None if it is missing or no struct."""
    try:
        schema = json.loads(text) if text else None
    except ValueError:
        return None
    return schema if isinstance(schema, dict) and schema.get("type") == "struct" else None


def schema_entries(schema: dict | None, parent: str = "") -> list[tuple]:
    """The path-type map of a schema as a list of entries, structs before their fields."""
    entries = []
    for position, field in enumerate(_fields(schema)):
        kind, name = field.get("type"), str(field["name"])
        mark = (field.get("metadata") or {}).get("id")
        is_struct = isinstance(kind, dict) and kind.get("type") == "struct"
        entries.append((parent, name, "struct" if is_struct else type_text(kind), position, None if mark is None else str(mark)))
        if is_struct:
            entries += schema_entries(kind, f"{parent}{name}.")
    return entries


def compare_entries(old: Sequence[tuple], new: Sequence[tuple]) -> list[tuple[str, str]]:
    """``(change, field_name)`` between two path-type maps; see :func:`schema_changes` for the rules."""
    changes = []
    for was, now, kind in _differences(old, new):
        changes.append((kind, _full(now or was)))
    return changes


def renamed_paths(old: Sequence[tuple], new: Sequence[tuple]) -> dict[str, str]:
    """Old and new path (lower case) of each renamed field, by the same rules."""
    return {_full(was): _full(now) for was, now, kind in _differences(old, new) if kind == "renamed"}


def _full(entry: tuple) -> str:
    return f"{entry[0]}{entry[1]}".lower()


def _differences(old: Sequence[tuple], new: Sequence[tuple]) -> list[tuple[tuple | None, tuple | None, str]]:
    old_of: dict[str, list[tuple]] = {}
    new_of: dict[str, list[tuple]] = {}
    for source, target in ((old, old_of), (new, new_of)):
        for entry in source:
            target.setdefault(entry[0], []).append(entry)
    by_id = all(e[4] is not None for e in [*old_of.get("", []), *new_of.get("", [])])
    return _compare_level("", "", old_of, new_of, by_id)


def _compare_level(old_parent: str, new_parent: str, old_of: dict, new_of: dict, by_id: bool) -> list[tuple]:
    before, after = old_of.get(old_parent, []), new_of.get(new_parent, [])
    pairs: list[tuple[tuple, tuple]] = []
    waiting: dict[object, list[tuple]] = {}
    tag = (lambda e: ("id", e[4]) if by_id and e[4] is not None else ("name", e[1].lower()))
    for e in before:
        waiting.setdefault(tag(e), []).append(e)
    added = []
    for e in after:
        same = waiting.get(tag(e))
        if same:
            pairs.append((same.pop(0), e))
        else:
            added.append(e)
    removed = [e for rest in waiting.values() for e in rest]
    if not by_id:
        vanished = {(e[3], e[2]): e for e in removed if e[2] != "struct"}
        for e in list(added):
            if e[2] != "struct" and (was := vanished.pop((e[3], e[2]), None)) is not None:
                pairs.append((was, e))
                added.remove(e)
                removed.remove(was)
    changes: list[tuple] = [(None, e, "added") for e in added] + [(e, None, "removed") for e in removed]
    for was, now in pairs:
        if was[1].lower() != now[1].lower():
            changes.append((was, now, "renamed"))
        if was[2] == now[2] == "struct":
            changes += _compare_level(f"{was[0]}{was[1]}.", f"{now[0]}{now[1]}.", old_of, new_of, by_id)
        elif was[2] != now[2]:
            changes.append((was, now, "retyped"))
    return changes


#: A path-value map: raw type and value (as text) of each lower-case path.
ROW_VALUES = T.MapType(T.StringType(), T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]))
#: What is known of a field besides its type, and the type it must have.
FIELD_TYPES = {"parent": "string", "name": "string", "position": "int", "id": "string"}


@F.pandas_udf(ROW_VALUES)
def schema_values(texts: pd.Series) -> pd.Series:
    """Each JSON schema as a path-value map: a field's raw type, and where and under which id it stands as a JSON value.

    Null for a missing or unreadable schema.  Of paths that differ in case only, later ones are marked by a number.
    """
    known: dict = {}

    def values(text):
        if text not in known:
            schema, found = _parse(text), {}
            for entry in schema_entries(schema):
                path = _full(entry)
                while path in found:
                    path += "#"
                rest = {"parent": entry[0], "name": entry[1], "position": entry[3], "id": entry[4]}
                found[path] = {"type": entry[2], "value": json.dumps(rest)}
            known[text] = None if schema is None else found
        return known[text]

    return texts.map(values)


@F.pandas_udf(T.ArrayType(CHANGE))
def fields_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """What changed from one list of fields (:data:`ENTRY`) to the next."""
    def entries(fields) -> list[tuple]:
        return [tuple(None if pd.isna(f[c]) else f[c] for c in ENTRY.names) for f in fields]

    out = []
    for a, b in zip(old, new):
        changes = [] if a is None or b is None else compare_entries(entries(a), entries(b))
        out.append([{"change": c, "field_name": f} for c, f in changes])
    return pd.Series(out)


def schema_fields(versions: DataFrame, by: Sequence[str], schema: str) -> DataFrame:
    """``by, path, parent, name, type, position, id, failed_casts``: every field of every schema version.

    A version is a file of one row: it is loaded as a path-value map, path and raw type are counted per version, and what
    is known of each field is projected to typed columns.
    """
    maps = versions.select(*by, schema_values(F.col(schema)).alias("row_values"))
    statistics = path_type_statistics(maps, by)
    known = F.transform_values(F.from_json("value", "map<string,string>"), lambda _, v: F.struct(F.lit("string").alias("type"), v.alias("value")))
    fields = typed_table(statistics.select(F.struct(*by, "path", "type").alias("file"), known.alias("row_values")), FIELD_TYPES)
    return fields.select("file.*", *FIELD_TYPES, "failed_casts")


def schema_changes(
    versions: DataFrame, table: str, order_by: Sequence[str], commit: str, schema: str, skip_unreadable: bool = False,
    fields: DataFrame | None = None,
) -> DataFrame:
    """``table, commit, change, field_name``: each change between consecutive schema versions of a table.

    ``versions`` holds each version once; ``schema`` is Spark's JSON.  If all top-level fields of both versions have
    ``metadata.id``, fields of equal id in the same parent are the same (inner fields without id go by name).
    Otherwise equal names (case ignored) are the same, and a vanished and a new field at the same place of the same
    parent with the same type other than struct are one renamed field.  Structs are compared field by field; an added,
    removed or replaced struct counts once.  Case, order, nullability, comments and synonyms of types are no changes.

    The fields of a version come from its path-type statistics (:func:`schema_fields`, which may be given).  A missing
    schema is no version and is skipped.  So is an unreadable one with ``skip_unreadable``, and the next version is compared
    with the last readable one; otherwise it is not compared with its neighbours.  A readable schema without fields counts
    as an unreadable one.  Versions are numbered by exact offsets and each is joined with its predecessor, so a table with
    very many versions is spread over tasks.  No versions give no rows.
    """
    if fields is None:
        fields = schema_fields(versions, [table, commit], schema)
    entry = F.struct(*ENTRY.names)
    listed = fields.groupBy(table, commit).agg(F.sort_array(F.collect_list(entry)).alias("_fields"))  # of one schema
    present = versions.where(F.trim(F.col(schema)) != "").select(table, commit, *[c for c in order_by if c != commit])
    present = present.join(listed, [table, commit], "inner" if skip_unreadable else "left")
    numbered = running_total(present, [table], order_by, None, "_no")
    keyed = numbered.select(table, commit, "_no", "_fields")
    before = keyed.select(table, (F.col("_no") + 1).alias("_no"), F.col("_fields").alias("_old"))
    pairs = keyed.join(before, [table, "_no"]).where("_old <> _fields or _old is null or _fields is null")
    change = F.explode(fields_diff("_old", "_fields")).alias("c")
    return pairs.select(table, commit, change).select(table, commit, "c.change", "c.field_name")


# data files as path-value maps ----------------------------------------------------------------------------------------


def _leaves(schema: T.StructType, prefix: list[str]) -> Iterator[tuple[list[str], T.DataType]]:
    for field in schema.fields:
        path = [*prefix, field.name]
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(field.dataType, path)
        else:
            yield path, field.dataType


#: Times inside nested values keep their microseconds.
JSON_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def _entries_type(kind: T.DataType) -> T.DataType:
    """The type with maps as arrays of entries, whose keys may be of any type."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _entries_type(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_entries_type(kind.elementType))
    if isinstance(kind, T.MapType):
        entry = [T.StructField("key", _entries_type(kind.keyType)), T.StructField("value", _entries_type(kind.valueType))]
        return T.ArrayType(T.StructType(entry))
    return kind


def _without_maps(value: Column, kind: T.DataType) -> Column:
    if not _has_map(kind):
        return value
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_without_maps(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _without_maps(x, kind.elementType))
    return F.transform(F.map_entries(value), lambda e: F.struct(
        _without_maps(e["key"], kind.keyType).alias("key"), _without_maps(e["value"], kind.valueType).alias("value")))


def _with_maps(value: Column, kind: T.DataType) -> Column:
    if not _has_map(kind):
        return value
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_with_maps(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _with_maps(x, kind.elementType))
    return F.map_from_entries(F.transform(value, lambda e: F.struct(
        _with_maps(e["key"], kind.keyType).alias("key"), _with_maps(e["value"], kind.valueType).alias("value"))))


def raw_maps(df: DataFrame, file: Column | None = None, renames: dict[str, str] | None = None) -> DataFrame:
    """``file, row_values, clashes``: each row as a map from lower-case path to ``struct<type, value>``; nulls are left out.

    Structs contribute one path per inner field; arrays and maps are kept as JSON text of their raw type (maps as arrays
    of entries), binary values as base64.  ``renames`` gives paths their newer names.  Of names that differ in case only,
    the first non-null one counts; ``clashes`` has the other values.
    """
    by_path: dict[str, list[Column]] = {}
    for path, kind in _leaves(df.schema, []):
        column = F.col(".".join(f"`{p}`" for p in path))
        if isinstance(kind, (T.ArrayType, T.MapType)):
            value = F.to_json(_without_maps(column, kind), JSON_FORMATS)
        else:
            value = F.base64(column) if isinstance(kind, T.BinaryType) else column.cast("string")
        entry = F.struct(F.lit(kind.simpleString()).alias("type"), value.alias("value"))
        name = ".".join(path).lower()
        by_path.setdefault((renames or {}).get(name, name), []).append(F.when(column.isNotNull(), entry))
    entries = [F.struct(F.lit(p).alias("key"), F.coalesce(*c).alias("value")) for p, c in by_path.items()]
    present = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    lost = []
    for path, columns in by_path.items():
        first = F.coalesce(*columns)
        other = [F.when(c["value"] != first["value"], F.struct(F.lit(path).alias("path"), c["type"].alias("type"), c["value"].alias("value"))) for c in columns[1:]]
        lost += other
    clashes = F.filter(F.array(*lost), lambda e: e.isNotNull()) if lost else F.array().cast(FAILED)
    source = file if file is not None else F.input_file_name()
    return df.select(source.alias("file"), F.map_from_entries(present).alias("row_values"), clashes.alias("clashes"))


def path_type_statistics(maps: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """``by, path, type, n, value``: how many rows of a file have a value of this raw type at this path, and the least one."""
    entries = maps.select(*by, F.explode("row_values").alias("path", "v"))
    counts = entries.groupBy(*by, "path", F.col("v.type").alias("type"))
    return counts.agg(F.count(F.lit(1)).alias("n"), F.min("v.value").alias("value"))


def consistent_types(
    statistics: DataFrame, wanted: dict[str, str] | None = None, declared: dict[str, set[str]] | None = None
) -> dict[str, str]:
    """One type per path: the ``wanted`` one, else the only raw type, else the widest number, else string.

    A path without any value has the types that the files' schemas declare for it, if these are given.  The driver receives one row per path and raw type, which is the size of the schemas, not of the data.
    """
    seen: dict[str, set[str]] = {}
    for row in statistics.select("path", "type").distinct().collect():
        seen.setdefault(row["path"], set()).add(row["type"])
    seen = (declared or {}) | seen
    result = {}
    for path in sorted(seen):
        kinds = {{"int": "long", "smallint": "long", "tinyint": "long", "bigint": "long", "float": "double"}.get(k, k) for k in seen[path]}
        if wanted and path in wanted:
            result[path] = wanted[path]
        elif len(seen[path]) == 1:
            result[path] = next(iter(seen[path]))
        elif kinds <= set(NUMBER_WIDTH[1:]):
            result[path] = max(kinds, key=NUMBER_WIDTH.index)
        else:
            result[path] = "string"
    return result


def _typed(raw: Column, value: Column, kind: str) -> Column:
    """A path's value as ``kind``; null if it does not fit or would be rounded."""
    if kind.startswith(("array", "map")):
        wanted = T.StructType.fromDDL(f"x {kind}")["x"].dataType
        return _with_maps(F.from_json(value, _entries_type(wanted), JSON_FORMATS), wanted)
    as_bytes = F.when(raw == "binary", F.unbase64(value))
    if kind == "binary":
        return F.coalesce(as_bytes, value.cast("binary"))
    text = F.when(raw != "binary", value).when(F.is_valid_utf8(as_bytes.cast("string")), as_bytes.cast("string"))
    cast = text.try_cast(kind)
    if kind in ("float", "double"):
        whole = raw.isin("tinyint", "smallint", "int", "bigint")
        kept = (cast < F.lit(2.0**63)) & (cast.try_cast("long") == value.try_cast("long"))
        return F.when(~whole | kept, cast)
    return cast


def typed_table(maps: DataFrame, types: dict[str, str]) -> DataFrame:
    """``file``, one typed column per path (dots become ``__``), and ``failed_casts``.

    ``failed_casts`` is an array of ``struct<path, type, value>`` for the values that do not fit their column, whole
    numbers that a floating column would round among them; they read as null there and are reported instead of being
    lost.  The values of clashing names are reported too.
    """
    fit, failed = [], []
    for path, kind in types.items():
        entry = F.col("row_values")[path]
        cast = _typed(entry["type"], entry["value"], kind)
        fit.append(cast.alias(path.replace(".", "__")))
        bad = entry["value"].isNotNull() & cast.isNull()
        failed.append(F.when(bad, F.struct(F.lit(path).alias("path"), entry["type"].alias("type"), entry["value"].alias("value"))))
    problems = F.filter(F.array(*failed), lambda e: e.isNotNull()) if failed else F.expr("array()")
    if "clashes" in maps.columns:
        problems = F.concat(problems.cast(FAILED), "clashes")
    return maps.select("file", *fit, problems.alias("failed_casts"))


def file_schemas(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str]]:
    """``(file, schema)`` of every Parquet file, folders taken apart; executors read the footers.

    The schema is Spark's JSON, from the footer or, for files of other writers, from the Arrow schema.
    """
    files = []
    for path in paths:
        inner = list_files(spark, qualified(path)) if not path.endswith(".parquet") or path.endswith("/") else []
        files += [f"{qualified(path)}/{name}" for name, _, _ in inner] or [qualified(path)]

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(1).to_pylist():
                with open_parquet(path) as file:
                    stored = (file.schema_arrow.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
                    found.append(stored.decode() if stored else from_arrow_schema(file.schema_arrow).json())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["at", "path", "schema"])

    listed = spark.createDataFrame(list(enumerate(files)), "at long, path string")
    slices = max(1, min(len(files), spark.sparkContext.defaultParallelism * 4))
    read = listed.repartition(slices).mapInArrow(footers, "at long, path string, schema string")
    return [(r["path"], r["schema"]) for r in read.orderBy("at").collect()]  # one short row per file, as in Spark's file index


def read_unified(
    spark: SparkSession, paths: Sequence[str], wanted: dict[str, str] | None = None, renames: dict[str, str] | None = None,
    follow_renames: bool = False,
) -> DataFrame:
    """Parquet files of drifting schemas as one typed table (see :func:`typed_table`).

    Files of equal schema are read together; each schema is loaded as path-value maps, types are settled from the
    statistics over all files, and the typed projection reports casts that fail.  A path may be a folder.  A column that no
    row has a value for is there all the same.

    ``renames`` maps older paths (lower case, dotted) to newer ones.  With ``follow_renames`` the schemas, in the order in
    which the paths first show them, are versions, and a field renamed from one to the next (by id, or by place and type,
    as in :func:`schema_changes`) is one column under its newest name.
    """
    if not paths:
        raise ValueError("no files")
    groups: dict[str, list[str]] = {}
    for path, schema in file_schemas(spark, paths):
        groups.setdefault(schema, []).append(path)
    newer = dict(renames or {})
    if follow_renames:
        versions = [schema_entries(json.loads(text)) for text in groups]
        for old, new in zip(versions, versions[1:]):
            for was, now in renamed_paths(old, new).items():
                newer = {k: now if v == was else v for k, v in newer.items()} | {was: now}
    maps, declared = None, {}
    for text, members in groups.items():
        df = spark.read.schema(T.StructType.fromJson(json.loads(text))).parquet(*members)
        here = {_full(e) for e in schema_entries(json.loads(text))}
        own = {was: now for was, now in newer.items() if now not in here}  # a name that came back is a field of its own
        for path, kind in _leaves(df.schema, []):
            name = ".".join(path).lower()
            declared.setdefault(own.get(name, name), set()).add(kind.simpleString())
        part = raw_maps(df, renames=own)
        maps = part if maps is None else maps.unionByName(part)
    return typed_table(maps, consistent_types(path_type_statistics(maps), wanted, declared))


# names that no version declares ---------------------------------------------------------------------------------------


def clean_names(columns: Column) -> Column:
    """A comma list as an array of lower-case names without surrounding blanks; empty names are left out."""
    names = F.transform(F.split(columns, ","), lambda n: F.lower(F.regexp_replace(n, r"^\s+|\s+$", "")))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def column_values(columns: Column) -> Column:
    """A comma list of columns as a path-value map of paths whose types and values are not known."""
    unknown = F.struct(F.lit("unknown").alias("type"), F.lit(None).cast("string").alias("value"))
    return F.map_from_entries(F.transform(clean_names(columns), lambda n: F.struct(n.alias("key"), unknown.alias("value"))))
