"""Names, DDL and a small SQL front end.

Names of tables are kept as small files in a folder (``spark.keelstone.catalog.dir``, by default ``_names`` in the
warehouse); a file is created exclusively, so a name belongs to one path.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from keelstone import sqltext
from keelstone.errors import EngineError, NotFoundError, SchemaError, UnsupportedError
from keelstone.lake import Table, check_properties
from keelstone.operators import merge as merging
from keelstone.session import _filesystem, local_path, qualified, remove_path, warehouse
from keelstone.sources import schema as schemas
from keelstone.sources.log import CommitLog, Meta

# names -----------------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return qualified(spark.conf.get("spark.keelstone.catalog.dir", f"{warehouse(spark)}/_names"))


def names(spark: SparkSession) -> dict[str, str]:
    """Every registered name and its path."""
    folder = _folder(spark)
    if folder.startswith("file:"):
        root = local_path(folder)
        files = [f for f in os.listdir(root) if f.endswith(".json") and f[0] != "."] if os.path.isdir(root) else []
    else:
        fs, path = _filesystem(spark, folder)
        files = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        files = [f for f in files if f.endswith(".json") and f[0] != "."]
    log = _names_log(spark)
    return {f[:-5]: json.loads(log._read(f))["path"] for f in sorted(files)}


def _names_log(spark: SparkSession) -> CommitLog:
    store = CommitLog(spark, _folder(spark))
    store.path = _folder(spark)
    store._local = local_path(store.path) if store.path.startswith("file:") else None
    return store


def register_name(spark: SparkSession, name: str, path: str) -> None:
    if not re.fullmatch(r"\w+", name):
        raise EngineError(f"not a table name: {name}")
    if not _names_log(spark)._create(f"{name.lower()}.json", json.dumps({"path": path})):
        if lookup(spark, name) != path:
            raise EngineError(f"the name {name} belongs to another table")


def lookup(spark: SparkSession, name: str) -> str:
    plain = name.strip("`").split(".")[-1].lower()
    try:
        return json.loads(_names_log(spark)._read(f"{plain}.json"))["path"]
    except Exception as e:  # one of the file system's own kinds of "not found"
        if plain in names(spark):
            raise
        raise NotFoundError(f"no table {name}") from e


def forget_path(spark: SparkSession, path: str) -> None:
    for name, at in names(spark).items():
        if at == path:
            remove_path(spark, f"{_folder(spark)}/{name}.json")


# DDL -------------------------------------------------------------------------------------------------------------------


def create_table(
    spark: SparkSession, path: str, schema: T.StructType | str, *, range_partitions=(), hash_partitions=(), bucket_num: int | None = None,
    name: str | None = None, properties: dict[str, str] | None = None, comment: str | None = None, if_not_exists: bool = False,
) -> Table:
    """An empty table. The folder must not hold other files."""
    table = Table(spark, path)
    if Table.isTable(spark, path):
        if if_not_exists:
            return table
        raise EngineError(f"a table exists at {path}")
    from keelstone.sources.files import list_files

    if list_files(spark, table.path, ""):
        raise EngineError(f"the folder {path} is not empty")
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    marked = T.StructType(
        [T.StructField(f.name, f.dataType, f.nullable, (f.metadata or {}) | ({} if f.nullable else {"keelstone.notNull": True})) for f in kind.fields]
    )
    empty = spark.createDataFrame([], marked)
    meta = table._new_meta(empty, list(range_partitions), list(hash_partitions), bucket_num, name, properties, None)
    meta = Meta(**{**meta.__dict__, "comment": comment})
    table._commit(table.log.snapshot(), "simple", meta=meta)
    if name:
        register_name(spark, name, table.path)
    return table


def replace_table(*_args, **_kwargs) -> None:
    raise UnsupportedError("REPLACE TABLE is not supported")


def set_properties(table: Table, properties: dict[str, str]) -> None:
    check_properties(properties)
    table.set_meta(lambda m: Meta(**{**m.__dict__, "properties": {**m.properties, **properties}}))


def unset_properties(table: Table, keys, if_exists: bool = False) -> None:
    missing = [k for k in keys if k not in table.meta.properties]
    if missing and not if_exists:
        raise NotFoundError(f"no properties {', '.join(missing)}")
    table.set_meta(lambda m: Meta(**{**m.__dict__, "properties": {k: v for k, v in m.properties.items() if k not in keys}}))


def _new_schema(table: Table, change) -> None:
    def edit(meta: Meta) -> Meta:
        schema = change(meta.struct)
        schemas.check_names(schema)
        return Meta(**{**meta.__dict__, "schema": schema.json()})

    table.set_meta(edit)


def add_columns(table: Table, columns: list[dict]) -> None:
    """Each a dict: name (dotted inside structs), type, and optionally comment, position, nullable (must not be False)."""
    for c in columns:
        if c.get("nullable") is False:
            raise SchemaError(f"a NOT NULL column cannot be added: {c['name']}")

    def change(schema: T.StructType) -> T.StructType:
        for c in columns:
            kind = c["type"] if isinstance(c["type"], T.DataType) else T.StructType.fromDDL(f"x {c['type']}")["x"].dataType
            schema = schemas.add_column(schema, c["name"], kind, c.get("comment"), c.get("position"))
        return schema

    _new_schema(table, change)


def change_column(table: Table, name: str, **changes) -> None:
    _new_schema(table, lambda s: schemas.change_column(s, name, **changes))


def replace_columns(table: Table, schema: T.StructType) -> None:
    """A new list of columns; those that stay must keep their types, and key columns must stay."""
    def change(old: T.StructType) -> T.StructType:
        here = {f.name.lower() for f in schema.fields}
        gone = [c for c in [*table.meta.range_columns, *table.meta.hash_columns] if c.lower() not in here]
        if gone:
            raise SchemaError(f"key columns cannot be dropped: {', '.join(gone)}")
        known = {f.name.lower(): f for f in old.fields}
        for f in schema.fields:
            if f.name.lower() in known:
                schemas.change_column(old, f.name, kind=f.dataType)
        return T.StructType([T.StructField(known[f.name.lower()].name if f.name.lower() in known else f.name, f.dataType,
                                           known[f.name.lower()].nullable if f.name.lower() in known else True, f.metadata) for f in schema.fields])

    _new_schema(table, change)


def add_constraint(table: Table, column: str, rule: str) -> None:
    """A SQL condition that every row must satisfy."""
    def change(schema: T.StructType) -> T.StructType:
        schemas.change_column(schema, column)
        return T.StructType(
            [T.StructField(f.name, f.dataType, f.nullable, {**(f.metadata or {}), schemas.INVARIANT: rule}) if f.name.lower() == column.lower() else f
             for f in schema.fields]
        )

    _new_schema(table, change)


def describe(spark: SparkSession, table: Table) -> DataFrame:
    meta = table.meta
    rows = [(f.name, f.dataType.simpleString(), (f.metadata or {}).get("comment")) for f in meta.struct.fields]
    rows += [("# Partitioning", "", None)] + [(f"Range {i}", c, None) for i, c in enumerate(meta.range_columns)]
    rows += [(f"Hash {i}", c, None) for i, c in enumerate(meta.hash_columns)]
    rows += [("# Buckets", str(meta.bucket_num), None)] if meta.keyed else []
    rows += [(f"# {k}", v, None) for k, v in sorted(meta.properties.items())]
    return spark.createDataFrame(rows, "col_name string, data_type string, comment string")


# inserts by position ---------------------------------------------------------------------------------------------------


def insert_into(
    table: Table, data: DataFrame, overwrite: bool = False, static: dict[str, str] | None = None, by_name: bool = False,
    columns: list[str] | None = None,
) -> None:
    """SQL's INSERT: columns by position with casts; ``static`` partition values complete the rows and, with
    ``overwrite``, name the partitions to replace. With ``columns`` the rows fill these, and the others become null.
    Keyed tables take the rows as an upsert unless they overwrite."""
    from pyspark.sql import functions as F

    meta, static = table.meta, static or {}
    from keelstone.sources.files import output_columns

    own = {c.lower(): c for c in output_columns(meta)}
    unknown = [c for c in [*static, *(columns or [])] if c.lower() not in own]
    if unknown:
        raise NotFoundError(f"no column {', '.join(unknown)}")
    static = {own[k.lower()]: v for k, v in static.items()}
    wanted = [c for c in output_columns(meta) if c not in static]
    if columns is not None:
        chosen = [own[c.lower()] for c in columns]
        if len(set(chosen)) < len(chosen) or set(chosen) & set(static):
            raise SchemaError(f"a column is given twice: {', '.join(columns)}")
        if len(chosen) != len(data.columns):
            raise SchemaError(f"{len(data.columns)} values given for {len(chosen)} columns")
        data = data.toDF(*chosen)
        data = data.withColumns({c: F.lit(None).cast(meta.struct[c].dataType) for c in wanted if c not in chosen} or {})
    elif not by_name:
        if len(wanted) != len(data.columns):
            raise SchemaError(f"{len(data.columns)} columns given, {len(wanted)} expected")
        data = data.toDF(*wanted)
    kinds = {f.name: f.dataType for f in meta.struct.fields}
    data = data.select(*[F.col(f"`{c}`").cast(kinds.get(c, data.schema[c].dataType)).alias(c) for c in data.columns])
    data = data.withColumns({k: F.lit(v).cast(kinds[k]) for k, v in static.items()} or {})
    if overwrite:
        where = " AND ".join(f"`{k}` = {sqltext.literal(v)}" for k, v in static.items()) or None
        table.write(data, "overwrite", replace_where=where)
    elif meta.keyed:
        table.upsert(data)
    else:
        table.write(data, "append")


class WriterV2:
    """``write_to(spark, df, name_or_path)``: create, append, overwrite; dynamic partition overwrite is refused."""

    def __init__(self, spark: SparkSession, data: DataFrame, target: str):
        self.spark, self.data, self.target, self.layout, self.props = spark, data, target, {}, {}

    def _table(self) -> Table:
        if "/" in self.target:
            return Table.forPath(self.spark, self.target)
        return Table.forName(self.spark, self.target)

    def partitionedBy(self, *columns: str) -> WriterV2:
        self.layout["range_partitions"] = list(columns)
        return self

    def tableProperty(self, key: str, value: str) -> WriterV2:
        self.props[key] = value
        return self

    def create(self, path: str | None = None) -> None:
        path = path or self.target
        short = None if "/" in self.target else self.target
        Table(self.spark, path).write(self.data, "error", short_name=short, properties=self.props, **self.layout)

    def replace(self) -> None:
        replace_table()

    createOrReplace = replace

    def append(self) -> None:
        insert_into(self._table(), self.data, by_name=True)

    def overwrite(self, condition: str) -> None:
        self._table().write(self.data, "overwrite", replace_where=None if condition.strip().lower() == "true" else condition)

    def overwritePartitions(self) -> None:
        raise UnsupportedError("dynamic partition overwrite is not supported")


def write_to(spark: SparkSession, data: DataFrame, target: str) -> WriterV2:
    return WriterV2(spark, data, target)


# SQL -------------------------------------------------------------------------------------------------------------------

#: The catalog in front of a table's name in SQL.
PREFIX = "keel"
_ID = r"keel\s*\.\s*(`(?:[^`]|``)+`|\w+)"
_ALIAS = r"(?:\s+as\s+(\w+)|\s+(?!set\b|where\b)(\w+))?"
_REFUSED = [
    (r"create\s+table\s+(?:if\s+not\s+exists\s+)?\S+\s+like\b", "CREATE TABLE LIKE"),
    (r"analyze\s+table\b", "ANALYZE"),
    (r"alter\s+table\s+\S+\s+(add|drop|recover)\s+(if\s+(not\s+)?exists\s+)?partition", "partition DDL"),
    (r"msck\b", "partition recovery"),
    (r"alter\s+table\s+\S+\s+set\s+serde", "SERDE properties"),
    (r"load\s+data\b", "LOAD DATA"),
    (r"insert\s+overwrite\s+(local\s+)?directory\b", "INSERT OVERWRITE DIRECTORY"),
    (r"alter\s+table\s+\S+\s+rename\s+to\b", "RENAME"),
    (r"alter\s+table\s+\S+\s+set\s+location\b", "SET LOCATION"),
    (r"create\s+or\s+replace\s+table\b|replace\s+table\b", "REPLACE TABLE"),
]


def _target(spark: SparkSession, identifier: str) -> Table:
    plain = sqltext.unquoted(identifier)
    return Table.forPath(spark, plain) if "/" in plain else Table.forName(spark, plain)


def _merge_calls(spark: SparkSession, text: str) -> tuple[str, dict[str, dict[str, str]]]:
    """``merge_<operator>(column)`` calls replaced by the column, and the operators by table and column."""
    calls: dict[str, str] = {}

    def take(found) -> str:
        column = sqltext.unquoted(found[2].split(".")[-1]).lower()
        if calls.setdefault(column, found[1].lower()) != found[1].lower():
            raise EngineError(f"two merge operators for {column}")
        return found[2]

    out, at = [], 0
    for m in re.finditer(r"\bmerge_(\w+)\s*\(\s*((?:\w+\s*\.\s*)?(?:`[^`]+`|\w+))\s*\)", sqltext.masked(text), re.I):
        found = sqltext.Match(text, m)
        if found[1].lower() in merging.OPERATORS:
            out += [text[at : m.start()], take(found)]
            at = m.end()
    if not calls:
        return text, {}
    tables: list[str] = []
    sqltext.replace_tables(text, PREFIX, lambda name: tables.append(name) or "")
    chosen: dict[str, dict[str, str]] = {}
    for column, operator in calls.items():
        owners = [t for t in dict.fromkeys(tables) if column in {n.lower() for n in _target(spark, f"`{t}`").meta.struct.names}]
        if len(owners) != 1:
            raise EngineError(f"{column} is a column of {len(owners)} of the tables, not of one")
        chosen.setdefault(owners[0], {})[column] = operator
    return "".join([*out, text[at:]]), chosen


def _with_views(spark: SparkSession, text: str) -> str:
    """``text`` with every table of ours replaced by a temporary view of its rows."""
    text, operators = _merge_calls(spark, text)

    def view_of(name: str) -> str:
        table, merge = _target(spark, f"`{name}`"), operators.get(name)
        plain = re.fullmatch(r"\w+", name) and not merge
        view = f"_keel_{name.lower()}" if plain else f"_keel_{uuid.uuid4().hex}"
        table.toDF(merge=merge).createOrReplaceTempView(view)
        return view

    return sqltext.replace_tables(text, PREFIX, view_of)


def _conditions(alias: str | None, *texts: str | None) -> list[str | None]:
    return [t if t is None or alias is None else sqltext.without_alias(t, alias) for t in texts]


def sql(spark: SparkSession, text: str) -> DataFrame | None:
    """Run a statement. Tables of this engine are ``keel.name`` or ``keel.`/path```; all else is Spark's.

    DELETE, UPDATE, INSERT, CREATE / ALTER / DROP TABLE and DESCRIBE on such tables are carried out here; queries are
    answered from materialized views where one holds the answer; INTERSECT and EXCEPT on keys become joins.  ``merge_<operator>(column)`` in a query reads the column
    merged by that operator.
    """
    statement = sqltext.without_comments(text).strip().rstrip(";").strip()
    match = lambda pattern: sqltext.match(pattern, statement)
    if sqltext.has_table(statement, PREFIX):
        for pattern, what in _REFUSED:
            if match(pattern):
                raise UnsupportedError(f"{what} is not supported")
        if m := match(rf"delete\s+from\s+{_ID}{_ALIAS}(?:\s+where\s+(.*))?$"):
            _target(spark, m[1]).delete(*_conditions(m[2] or m[3], m[4]))
            return None
        if m := match(rf"update\s+{_ID}{_ALIAS}\s+set\s+(.*?)(?:\s+where\s+(.*))?$"):
            assigned, condition = _conditions(m[2] or m[3], m[4], m[5])
            _target(spark, m[1]).update(condition, _assigned(assigned))
            return None
        if m := match(rf"insert\s+(into|overwrite)\s+(?:table\s+)?{_ID}(?:\s+partition\s*\(([^)]*)\))?\s*(.*)$"):
            _insert(spark, _target(spark, m[2]), m[1].lower() == "overwrite", m[3], m[4])
            return None
        if m := match(rf"drop\s+table\s+(if\s+exists\s+)?{_ID}$"):
            try:
                _target(spark, m[2]).dropTable()
            except NotFoundError:
                if not m[1]:
                    raise
            return None
        if m := match(rf"desc(?:ribe)?\s+(?:table\s+)?(?:extended\s+)?{_ID}$"):
            return describe(spark, _target(spark, m[1]))
        if m := match(rf"create\s+table\s+(if\s+not\s+exists\s+)?{_ID}\s*(.*)$"):
            return _create(spark, bool(m[1]), m[2], m[3])
        if m := match(rf"alter\s+table\s+{_ID}\s+(.*)$"):
            _alter(_target(spark, m[1]), m[2])
            return None
    from keelstone.plans.views import answer

    if (found := _on_keys(spark, statement)) is not None:
        return found
    run = lambda s: spark.sql(_with_views(spark, s))
    return run(statement) if _merge_calls(spark, statement)[1] else answer(spark, statement, run)


def _on_keys(spark: SparkSession, statement: str) -> DataFrame | None:
    """INTERSECT or EXCEPT of exactly the hash columns of two tables with as many buckets: a join without a shuffle."""
    side = rf"select\s+([\w\s,`]+?)\s+from\s+{_ID}"
    m = sqltext.match(rf"{side}\s+(intersect|except|minus)\s+(?:distinct\s+)?{side}\s*$", statement)
    if not m:
        return None
    left, right = _target(spark, m[2]), _target(spark, m[5])
    mine, theirs = left.meta, right.meta
    if mine.view is not None or theirs.view is not None or mine.bucket_num != theirs.bucket_num:
        return None
    for columns, meta in ((m[1], mine), (m[4], theirs)):
        named = [sqltext.unquoted(c).lower() for c in sqltext.split(columns)]
        if not meta.keyed or named != [c.lower() for c in meta.hash_columns]:
            return None
    if [mine.struct[c].dataType for c in mine.hash_columns] != [theirs.struct[c].dataType for c in theirs.hash_columns]:
        return None
    return left.intersectKeys(right) if m[3].lower() == "intersect" else left.exceptKeys(right)


def _insert(spark: SparkSession, table: Table, overwrite: bool, partition: str | None, rest: str) -> None:
    columns, by_name, listed = None, False, sqltext.bracketed(rest)
    if listed is not None and not re.match(r"\s*(select|with|values|from|table|\()", sqltext.masked(listed), re.I):
        columns = [sqltext.unquoted(c) for c in sqltext.split(listed)]
        rest = rest[rest.index(listed) + len(listed) + 1 :]
    elif m := sqltext.match(r"by\s+name\s+(.*)$", rest):
        by_name, rest = True, m[1]
    static = sqltext.pairs(partition) if partition else None
    insert_into(table, sql(spark, rest), overwrite, static, by_name, columns)


def _assigned(text: str) -> dict[str, str]:
    return {k: v for k, v in (sqltext.split(part, "=", 1) for part in sqltext.split(text))}


def _create(spark: SparkSession, if_not_exists: bool, identifier: str, rest: str):
    query = sqltext.match(r"\bas\s+((?:select|with)\b.*)$", rest, anywhere=True)
    head = rest[: query.start()] if query else rest
    columns = sqltext.bracketed(head)
    tail = head[head.index(columns) + len(columns) + 1 :] if columns is not None else head
    clause = lambda pattern: sqltext.match(pattern, tail, anywhere=True)
    if clause(r"clustered\s+by|into\s+\d+\s+buckets"):
        raise UnsupportedError("bucketing in DDL is not supported; use hash partitions")
    parts = clause(r"partitioned\s+by\s*\(([^()]*)\)")
    if clause(r"partitioned\s+by") and not parts:
        raise UnsupportedError("partitioning by expressions is not supported")
    place, props, note = clause(r"location\s+('[^']*'|\"[^\"]*\")"), clause(r"tblproperties\s*\(([^)]*)\)"), clause(r"comment\s+('[^']*'|\"[^\"]*\")")
    plain = sqltext.unquoted(identifier)
    by_path = "/" in plain
    path = plain if by_path else (sqltext.unquoted(place[1]) if place else f"{warehouse(spark)}/{plain.lower()}")
    ranges = [sqltext.unquoted(c) for c in sqltext.split(parts[1])] if parts else []
    properties = sqltext.pairs(props[1]) if props else {}
    if if_not_exists and Table.isTable(spark, path):
        return None
    layout = {k: properties.pop(k, None) for k in ("hashPartitions", "hashBucketNum")}
    hashes, buckets = layout["hashPartitions"], layout["hashBucketNum"]
    short = None if by_path else plain.lower()
    if query:
        if columns is not None:
            raise UnsupportedError("CREATE TABLE AS takes no column list")
        Table(spark, path).write(sql(spark, query[1]), "error", range_partitions=ranges, hash_partitions=hashes,
                                 bucket_num=int(buckets) if buckets else None, short_name=short, properties=properties)
        return None
    if columns is None:
        raise SchemaError("a table needs columns")
    create_table(spark, path, columns, range_partitions=ranges, hash_partitions=sqltext.split(hashes or ""), bucket_num=int(buckets) if buckets else None,
                 name=short, properties=properties, comment=sqltext.unquoted(note[1]) if note else None, if_not_exists=if_not_exists)
    return None


def _type(text: str) -> T.DataType:
    return T.StructType.fromDDL(f"x {text}")["x"].dataType


def _alter(table: Table, action: str) -> None:
    match = lambda pattern, text: sqltext.match(pattern, text)
    if m := match(r"set\s+tblproperties\s*\((.*)\)$", action):
        set_properties(table, sqltext.pairs(m[1]))
    elif m := match(r"unset\s+tblproperties\s+(if\s+exists\s+)?\((.*)\)$", action):
        unset_properties(table, [sqltext.unquoted(k) for k in sqltext.split(m[2])], bool(m[1]))
    elif m := match(r"add\s+columns?\s*\((.*)\)$", action) or match(r"add\s+columns?\s+(.*)$", action):
        add_columns(table, [_column(c) for c in sqltext.split(m[1])])
    elif m := match(r"(?:alter|change)\s+(?:column\s+)?([\w.`]+)\s+(.*)$", action):
        name, rest = m[1].replace("`", ""), m[2]
        if n := match(r"comment\s+(.*)$", rest):
            change_column(table, name, comment=sqltext.unquoted(n[1]))
        elif n := match(r"(first|after\s+\S+)$", rest):
            change_column(table, name, position=n[1])
        elif match(r"drop\s+not\s+null$", rest):
            change_column(table, name, nullable=True)
        elif match(r"set\s+not\s+null$", rest):
            change_column(table, name, nullable=False)
        elif n := match(r"type\s+(.*)$", rest):
            change_column(table, name, kind=_type(n[1]))
        else:
            new, _, kind = rest.partition(" ")
            column = _column(f"{new} {kind}")
            change_column(table, name, new_name=new.strip("`"), kind=_type(column["type"]), comment=column.get("comment"), position=column.get("position"))
    elif m := match(r"replace\s+columns\s*\((.*)\)$", action):
        replace_columns(table, T.StructType.fromDDL(m[1]))
    else:
        raise UnsupportedError(f"ALTER TABLE ... {action}")


def _column(text: str) -> dict:
    m = re.match(r"([\w.`]+)\s+(.*)$", text.strip(), re.S)
    if not m:
        raise SchemaError(f"not a column: {text}")
    rest, column = m[2], {"name": m[1].replace("`", "")}
    if n := sqltext.match(r"\s+(first|after\s+\S+)\s*$", rest, anywhere=True):
        column["position"], rest = n[1], rest[: n.start()]
    if n := sqltext.match(r"\s+comment\s+('[^']*'|\"[^\"]*\")", rest, anywhere=True):
        column["comment"], rest = sqltext.unquoted(n[1]), rest[: n.start()] + rest[n.end() :]
    if n := sqltext.match(r"\s+not\s+null\b", rest, anywhere=True):
        column["nullable"], rest = False, rest[: n.start()]
    return column | {"type": rest.strip()}
