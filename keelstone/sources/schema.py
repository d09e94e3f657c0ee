"""Schemas: enforcement, evolution, column edits and constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.errors import SchemaError

#: Key of the field metadata that holds a SQL condition on the column.
INVARIANT = "keelstone.invariants"
_WHOLE = [T.ByteType, T.ShortType, T.IntegerType]
_ODD_CHARACTERS = set(" ,;{}()\n\t=")


def check_names(schema: T.StructType) -> None:
    """Names must differ when case is ignored, at every level, and be storable in Parquet."""
    names = [f.name.lower() for f in schema.fields]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise SchemaError(f"duplicate columns: {', '.join(twice)}")
    for f in schema.fields:
        if _ODD_CHARACTERS & set(f.name):
            raise SchemaError(f"invalid character in column name {f.name!r}")
        for inner in _structs(f.dataType):
            check_names(inner)


def _structs(kind: T.DataType):
    if isinstance(kind, T.StructType):
        yield kind
    elif isinstance(kind, T.ArrayType):
        yield from _structs(kind.elementType)
    elif isinstance(kind, T.MapType):
        yield from _structs(kind.keyType)
        yield from _structs(kind.valueType)


def drop_void(df: DataFrame) -> DataFrame:
    """Untyped null columns are left out; inside arrays and maps they are an error."""
    def has_void(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return isinstance(kind.elementType, T.NullType) or has_void(kind.elementType)
        if isinstance(kind, T.MapType):
            return isinstance(kind.valueType, T.NullType) or has_void(kind.valueType)
        return isinstance(kind, T.StructType) and any(has_void(f.dataType) for f in kind.fields)

    check_names(df.schema)
    for f in df.schema.fields:
        if has_void(f.dataType):
            raise SchemaError(f"column {f.name} holds values without a type")
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.NullType)])


def merge_types(old: T.DataType, new: T.DataType, where: str = "") -> T.DataType:
    """The type that holds both; the old one's nullability and metadata stay."""
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        return merge_schemas(old, new, where)
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return T.ArrayType(merge_types(old.elementType, new.elementType, where), old.containsNull)
    if isinstance(old, T.MapType) and isinstance(new, T.MapType):
        key = merge_types(old.keyType, new.keyType, where)
        return T.MapType(key, merge_types(old.valueType, new.valueType, where), old.valueContainsNull)
    if isinstance(new, T.NullType):
        return old
    if isinstance(old, T.NullType):
        return new
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType) and old != new:
        raise SchemaError(f"{where}: {old.simpleString()} and {new.simpleString()} differ in precision or scale")
    if type(old) in _WHOLE and type(new) in _WHOLE:
        return old if _WHOLE.index(type(old)) >= _WHOLE.index(type(new)) else new
    if old == new:
        return old
    raise SchemaError(f"{where}: cannot merge {old.simpleString()} and {new.simpleString()}")


def merge_schemas(old: T.StructType, new: T.StructType, where: str = "") -> T.StructType:
    """Old columns in place, new ones at the end."""
    incoming = {f.name.lower(): f for f in new.fields}
    fields = []
    for f in old.fields:
        other = incoming.pop(f.name.lower(), None)
        kind = f.dataType if other is None else merge_types(f.dataType, other.dataType, f"{where}{f.name}")
        fields.append(T.StructField(f.name, kind, f.nullable, f.metadata))
    fields += [T.StructField(f.name, f.dataType, True, f.metadata) for f in new.fields if f.name.lower() in incoming]
    return T.StructType(fields)


def differences(table: T.StructType, data: T.StructType, where: str = "") -> list[str]:
    """Why rows of schema ``data`` cannot go into ``table`` as it is."""
    known = {f.name.lower(): f for f in table.fields}
    found = []
    for f in data.fields:
        name, mine = f"{where}{f.name}", known.get(f.name.lower())
        if mine is None:
            found.append(f"new column {name} {f.dataType.simpleString()}")
        elif isinstance(mine.dataType, T.StructType) and isinstance(f.dataType, T.StructType):
            found += differences(mine.dataType, f.dataType, f"{name}.")
        else:
            try:
                if merge_types(mine.dataType, f.dataType) != mine.dataType:
                    found.append(f"column {name} is {mine.dataType.simpleString()}, not {f.dataType.simpleString()}")
            except SchemaError:
                found.append(f"column {name} is {mine.dataType.simpleString()}, not {f.dataType.simpleString()}")
    return found


def _nullable(kind: T.DataType) -> T.DataType:
    """The type with null allowed at every level, as files store it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType), True)
    return kind


def file_schema(schema: T.StructType, columns) -> T.StructType:
    wanted = {c.lower() for c in columns}
    return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in schema.fields if f.name.lower() in wanted])


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``df`` in the table's order, case and types; columns that ``df`` lacks are left out."""
    mine = {f.name.lower(): f for f in df.schema.fields}
    picked = []
    for f in schema.fields:
        own = mine.get(f.name.lower())
        if own is not None:
            picked.append(F.col(f"`{own.name}`").cast(_nullable(f.dataType)).alias(f.name))
    return df.select(*picked)


# constraints -----------------------------------------------------------------------------------------------------------


def _required(schema: T.StructType, column: Column | None = None, where: str = ""):
    """(name, condition) of each NOT NULL field, inside structs too; arrays and maps are not looked into."""
    for f in schema.fields:
        value = F.col(f"`{f.name}`") if column is None else column.getField(f.name)
        name = f"{where}{f.name}"
        if not f.nullable:
            held = value.isNotNull()
            yield name, held if column is None else column.isNull() | held
        if isinstance(f.dataType, T.StructType):
            yield from _required(f.dataType, value, f"{name}.")


def check_rows(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with every constraint built into the columns themselves, so that pruning cannot drop a check.

    A missing or null NOT NULL field, and a condition that is false or null, stop the write.
    """
    present = {c.lower() for c in df.columns}
    missing = [f.name for f in schema.fields if not f.nullable and f.name.lower() not in present]
    if missing:
        raise SchemaError(f"missing NOT NULL columns: {', '.join(missing)}")
    checks: dict[str, list[tuple[str, Column]]] = {}
    for name, held in _required(schema):
        checks.setdefault(name.split(".")[0].lower(), []).append((f"NOT NULL constraint of {name} violated", held))
    for f in schema.fields:
        rule = (f.metadata or {}).get(INVARIANT)
        if rule and f.name.lower() in present:
            checks.setdefault(f.name.lower(), []).append((f"constraint {rule} of {f.name} violated", F.coalesce(F.expr(rule), F.lit(False))))
    columns = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        for message, held in checks.get(f.name.lower(), ()):
            value = F.when(held, value).otherwise(F.raise_error(F.lit(message)).cast(f.dataType))
        columns.append(value.alias(f.name))
    return df.select(*columns)


# column edits ----------------------------------------------------------------------------------------------------------


def add_column(schema: T.StructType, path: str, kind: T.DataType, comment: str | None = None, position: str | None = None) -> T.StructType:
    """``path`` is dotted for fields of structs (``element``, ``key`` and ``value`` step into arrays and maps);
    ``position`` is ``first``, ``after <name>`` or None for the end."""
    head, _, rest = path.partition(".")
    if rest:
        return _edit(schema, head, lambda f: T.StructField(f.name, _inside(f.dataType, rest, lambda s, p: add_column(s, p, kind, comment, position)), f.nullable, f.metadata))
    if any(f.name.lower() == head.lower() for f in schema.fields):
        raise SchemaError(f"column {head} exists")
    new = T.StructField(head, kind, True, {"comment": comment} if comment else {})
    return T.StructType(_placed(list(schema.fields), new, position))


def change_column(
    schema: T.StructType, path: str, kind: T.DataType | None = None, comment: str | None = None,
    nullable: bool | None = None, position: str | None = None, new_name: str | None = None,
) -> T.StructType:
    """Comment, place and a relaxed nullability may change; name and type may not."""
    head, _, rest = path.partition(".")
    if rest:
        return _edit(schema, head, lambda f: T.StructField(f.name, _inside(f.dataType, rest, lambda s, p: change_column(s, p, kind, comment, nullable, position, new_name)), f.nullable, f.metadata))
    old = next((f for f in schema.fields if f.name.lower() == head.lower()), None)
    if old is None:
        raise SchemaError(f"no column {head}")
    if new_name is not None and new_name != old.name:
        raise SchemaError("columns cannot be renamed")
    if kind is not None and _nullable(kind) != _nullable(old.dataType):
        raise SchemaError(f"type of {head} cannot change from {old.dataType.simpleString()} to {kind.simpleString()}")
    if nullable is False and old.nullable:
        raise SchemaError(f"{head} cannot become NOT NULL")
    metadata = dict(old.metadata or {}) | ({"comment": comment} if comment is not None else {})
    new = T.StructField(old.name, old.dataType, old.nullable if nullable is None else nullable, metadata)
    fields = [new if f is old else f for f in schema.fields]
    if position:
        fields.remove(new)
        fields = _placed(fields, new, position)
    return T.StructType(fields)


def _placed(fields: list, new: T.StructField, position: str | None) -> list:
    if not position:
        return [*fields, new]
    if position.lower() == "first":
        return [new, *fields]
    name = position.split(None, 1)[1].strip("`").lower()
    at = next((i for i, f in enumerate(fields) if f.name.lower() == name), None)
    if at is None:
        raise SchemaError(f"no column {name}")
    return [*fields[: at + 1], new, *fields[at + 1 :]]


def _edit(schema: T.StructType, name: str, change) -> T.StructType:
    if not any(f.name.lower() == name.lower() for f in schema.fields):
        raise SchemaError(f"no column {name}")
    return T.StructType([change(f) if f.name.lower() == name.lower() else f for f in schema.fields])


def _inside(kind: T.DataType, path: str, change) -> T.DataType:
    if isinstance(kind, T.StructType):
        return change(kind, path)
    step, _, rest = path.partition(".")
    if isinstance(kind, T.ArrayType) and step == "element" and rest:
        return T.ArrayType(_inside(kind.elementType, rest, change), kind.containsNull)
    if isinstance(kind, T.MapType) and step in ("key", "value") and rest:
        sides = {"key": kind.keyType, "value": kind.valueType}
        sides[step] = _inside(sides[step], rest, change)
        return T.MapType(sides["key"], sides["value"], kind.valueContainsNull)
    raise SchemaError(f"{path}: not inside a struct")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)
