"""Deeply nested records as related flat tables.

``flatten_tables`` walks a schema and explodes each array or map level into a child table that carries its
parent's surrogate key and its ordinal. Records that come as JSON text in several layouts are read
under a schema merged over all of them (``infer_schema``, ``flatten_json``); what the layouts of a field do not agree on stays text in it. ``dag_tables`` builds
the node, sentence and edge tables of chunk graphs from both sources.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longspan.sources.tables import materialise

#: An object with more fields than this is a map if one type holds all its values; with values of several types it stays an object of as many fields.
WIDE = 256
_FIELD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*$")


# ---- merged schema of JSON texts -------------------------------------------------------------------------


def type_of(value: object) -> object:
    """Type tree of a JSON value: a scalar's name, ``["array", t]``, ``["map", t]`` or ``{field: t}``; None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint" if -(2**63) <= value < 2**63 else "string"
    if isinstance(value, float):
        return "double"
    if isinstance(value, str):
        return "string"
    if isinstance(value, list):
        return ["array", reduce(merge_types, map(type_of, value), None)]
    if value and not any(_FIELD.match(k) for k in value):
        return ["map", reduce(merge_types, map(type_of, value.values()), None)]
    return _narrow({k: type_of(v) for k, v in value.items()})


def _narrow(fields: dict) -> object:
    """A map for many fields of one type, such as records by their name."""
    if len(fields) <= WIDE:
        return fields
    kinds = {_kind(t) for t in fields.values()} - {None}
    return ["map", reduce(merge_types, fields.values(), None)] if len(kinds) <= 1 else fields


def _kind(t: object) -> str | None:
    return "object" if isinstance(t, dict) else str(t[0]) if isinstance(t, list) else None if t is None else "number" if t in ("bigint", "double") else str(t)


def merge_types(a: object, b: object) -> object:
    """Smallest type that holds both; layouts that exclude each other (an array and an object, say) become text."""
    if a is None or a == b:
        return b
    if b is None:
        return a
    if isinstance(a, dict) and isinstance(b, dict):
        return _narrow({k: merge_types(a.get(k), b.get(k)) for k in [*a, *(k for k in b if k not in a)]})
    if isinstance(a, list) and isinstance(b, list) and a[0] == b[0]:
        return [a[0], merge_types(a[1], b[1])]
    for x, y in ((a, b), (b, a)):
        if isinstance(x, list) and x[0] == "map" and isinstance(y, dict):
            return ["map", reduce(merge_types, y.values(), x[1])]
    return "double" if {str(a), str(b)} == {"bigint", "double"} else "string"


def to_spark(t: object) -> T.DataType:
    if isinstance(t, dict):
        return T.StructType([T.StructField(k, to_spark(v)) for k, v in t.items()])
    if isinstance(t, list):
        inner = to_spark(t[1])
        return T.ArrayType(inner) if t[0] == "array" else T.MapType(T.StringType(), inner)
    return {"boolean": T.BooleanType(), "bigint": T.LongType(), "double": T.DoubleType()}.get(str(t), T.StringType())


def parse(text: str | None) -> object:
    """Value of a JSON text; ``ValueError`` where it is none."""
    if text is None:
        raise ValueError("null")
    return json.loads(text, parse_constant=_no_constant)


#: What a text raises that is no JSON, or nests too deep to be read.
UNREADABLE = (ValueError, RecursionError)


def _no_constant(name: str) -> object:
    raise ValueError(f"{name} is no JSON")


def infer_schema(texts: DataFrame, column: str) -> T.DataType:
    """Schema merged over every valid JSON text of the column.

    Each task merges its own rows; one tree a task, as large as the schema, comes to the driver. Texts that are no JSON, or nest too deep to be read, count
    nothing; a field that is null throughout is text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: object = None
        for b in batches:
            for x in b.column(0).to_pylist():
                try:
                    t = merge_types(t, type_of(parse(x)))
                except UNREADABLE:
                    continue
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(t)])], names=["t"])

    return _merged([r.t for r in texts.select(column).mapInArrow(run, "t string").distinct().collect()])


def _merged(trees: list[str]) -> T.DataType:
    return to_spark(reduce(merge_types, map(json.loads, sorted(trees)), None))


#: Where the parser puts the text of what it cannot read.
CORRUPT = "_corrupt_text"

# ---- generic flattening -----------------------------------------------------------------------------------


def flatten_tables(df: DataFrame, key: list[str], column: str, prefix: str | None = None, carry: bool = False) -> dict[str, DataFrame]:
    """Tables of one nested column: name of the path -> table.

    Each table has the record's ``key``, ``parent_id`` (the surrogate key of the row it hangs under), ``id`` (its own:
    the parent's with the ordinal behind it), ``ordinal`` (0-based place in its array; places in a map follow its keys
    in order), ``map_key`` for entries of a map, and the scalar fields, those of inner structs joined with ``_``. An array
    or map inside makes a table of its own; with ``carry`` its rows also have their parent's scalar fields and map key, with
    ``up_`` before them, which saves the join back. Null and empty arrays make no rows; null elements keep theirs, with null
    fields. Fields that would clash with a key or bookkeeping column get a ``_`` behind. Narrow throughout: each
    record is exploded where it lies.
    """
    name = prefix or column
    base = df.select(*key, F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).alias("parent_id"), F.col(column).alias("_v"))
    return dict(_flatten(base, key, name, df.schema[column].dataType, carry, []))


def _flatten(base: DataFrame, key: list[str], name: str, kind: T.DataType, carry: bool, up: list[str]) -> Iterator[tuple[str, DataFrame]]:
    mapped = isinstance(kind, T.MapType)
    if mapped:
        entries = F.array_sort(F.map_keys("_v"))
        one = base.withColumn("_m", F.col("_v")).select(*key, *up, "parent_id", "_m", F.posexplode(entries).alias("ordinal", "map_key"))
        one = one.select(*key, *up, "parent_id", "ordinal", "map_key", F.col("_m")[F.col("map_key")].alias("_v"))
        inner = kind.valueType
    elif isinstance(kind, T.ArrayType):
        one = base.select(*key, *up, "parent_id", F.posexplode("_v").alias("ordinal", "_v"))
        inner = kind.elementType
    else:
        one, inner = base.withColumn("ordinal", F.lit(0)), kind
    one = one.withColumn("id", F.concat("parent_id", F.lit(f"/{name.rpartition('.')[2]}/"), F.col("ordinal")))
    keep = [*key, *up, "parent_id", "id", "ordinal", *["map_key"] * mapped]
    fields: list[tuple[str, Column]] = []
    below: list[tuple[str, Column, T.DataType]] = []

    def walk(col: Column, t: T.DataType, label: str) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(col[f.name], f.dataType, f"{label}_{f.name}" if label else f.name)
        elif isinstance(t, (T.ArrayType, T.MapType)):
            below.append((label or "item", col, t))
        else:
            label = label or "value"
            fields.append((label + "_" if label in keep else label, col))

    walk(F.col("_v"), inner, "")
    yield name, one.select(*keep, *[c.alias(n) for n, c in fields])
    above = [(f"up_{n}", c) for n, c in fields] + [("up_map_key", F.col("map_key"))] * mapped if carry else []
    for label, col, t in below:
        child = one.select(*key, *[c.alias(n) for n, c in above], F.col("id").alias("parent_id"), col.alias("_v"))
        yield from _flatten(child, key, f"{name}.{label}", t, carry, [n for n, _ in above])


def flatten_json(df: DataFrame, key: list[str], column: str, prefix: str | None = None) -> dict[str, DataFrame]:
    """``flatten_tables`` of a column of JSON texts, parsed once under the schema merged over all of them; null texts and those that are no JSON make no rows."""
    merged = infer_schema(df, column)
    read = df.select(*key, F.from_json(column, merged.add(CORRUPT, T.StringType()) if isinstance(merged, T.StructType) else merged, {"columnNameOfCorruptRecord": CORRUPT}).alias(column)).where(F.col(column).isNotNull())
    if isinstance(merged, T.StructType):
        read = read.where(F.col(column)[CORRUPT].isNull()).withColumn(column, F.col(column).dropFields(CORRUPT))
    return flatten_tables(read, key, column, prefix)


# ---- chunk graphs -----------------------------------------------------------------------------------------

ROOT, LEAF = -1, 0
RAW_INDEX = "struct<lr_index:string,hierarchy_index:string,passage_index:string,sent_index:string>"
RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("lr_index", "hierarchy_index", "passage_index", "sent_index")])
_PRINTED = r"\(\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*\)"


def _ints(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+"), F.lit(0)), lambda x: x.try_cast("int"))


def _part(col: Column, t: T.DataType, name: str) -> tuple[Column, T.DataType]:
    """A field of an object or entry of a map, and its type; null where the schema has none."""
    if isinstance(t, T.StructType) and name in t.fieldNames():
        return col[name], t[name].dataType
    return (col[name], t.valueType) if isinstance(t, T.MapType) else (F.lit(None), T.NullType())


def _int(col: Column, t: T.DataType) -> Column:
    return col.try_cast("int") if isinstance(t, T.AtomicType) else F.lit(None).cast("int")


def _pair(col: Column, t: T.DataType) -> Column:
    """Both ends of an interval that is an array, an object of left and right, or the text of either."""
    if isinstance(t, T.ArrayType):
        return F.transform(col, lambda x: _int(x, t.elementType))
    if isinstance(t, (T.StructType, T.MapType)):
        return F.array(*[_int(*_part(col, t, name)) for name in ("left", "right")])
    named = [F.regexp_extract(col, rf'"{name}"\s*:\s*"?(-?\d+)', 1).try_cast("int") for name in ("left", "right")]
    return F.when(F.contains(col, F.lit('"left"')), F.array(*named)).otherwise(_ints(col))


def _index(col: Column, t: T.DataType) -> Column:
    """Canonical index of one of any layout; null for null."""
    ends = _part(col, t, "lr_index")
    pair = F.lit(None).cast("array<int>") if isinstance(ends[1], T.NullType) else _pair(*ends)
    return F.when(col.isNotNull(), F.struct(pair.alias("lr_index"), *[_int(*_part(col, t, c)).alias(c) for c in ("hierarchy_index", "passage_index", "sent_index")]))


_INDEX = "struct<lr_index:array<int>,hierarchy_index:int,passage_index:int,sent_index:int>"


def _indices(col: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StringType):
        col, t = F.from_json(col, f"array<{RAW_INDEX}>"), T.ArrayType(RAW)
    return F.transform(col, lambda i: _index(i, t.elementType)) if isinstance(t, T.ArrayType) else F.lit(None).cast(f"array<{_INDEX}>")


def _texts(col: Column, t: T.DataType) -> Column:
    return F.from_json(col, "array<string>") if isinstance(t, T.StringType) else col.cast("array<string>") if isinstance(t, T.ArrayType) else F.lit(None).cast("array<string>")


def _printed_index(text: Column) -> Column:
    n = [F.regexp_extract(text, _PRINTED, i + 1).try_cast("int") for i in range(5)]
    return F.struct(F.array(n[0], n[1]).alias("lr_index"), n[2].alias("hierarchy_index"), n[3].alias("passage_index"), n[4].alias("sent_index"))


def _chunks(col: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StringType):
        raw = T.StructType.fromDDL(f"index {RAW_INDEX}, sentences array<string>, target_sentences array<string>")
        col, t = F.from_json(col, T.ArrayType(raw)), T.ArrayType(raw)
    if not isinstance(t, T.ArrayType):
        return F.lit(None).cast(f"array<struct<index:{_INDEX},sentences:array<string>,target_sentences:array<string>>>")

    def one(c: Column) -> Column:
        return F.struct(_index(*_part(c, t.elementType, "index")).alias("index"), *[_texts(*_part(c, t.elementType, n)).alias(n) for n in ("sentences", "target_sentences")])

    return F.transform(col, one)


def _levels(col: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StringType):
        col, t = F.from_json(col, f"map<string,array<{RAW_INDEX}>>"), T.MapType(T.StringType(), T.ArrayType(RAW))
    if not isinstance(t, T.MapType):
        return F.lit(None).cast(f"array<struct<level:int,members:array<{_INDEX}>>>")
    return F.transform(F.map_entries(col), lambda e: F.struct(e["key"].try_cast("int").alias("level"), _indices(e["value"], t.valueType).alias("members")))


def _links(col: Column, t: T.DataType) -> Column:
    """Parents with their children, from a map by printed parent or a list of both; where the layouts are mixed, from the text of either."""
    if isinstance(t, T.StringType):
        listed, mapped = T.ArrayType(T.StructType([T.StructField("parent", RAW), T.StructField("children", T.ArrayType(RAW))])), T.MapType(T.StringType(), T.ArrayType(RAW))
        return F.when(col.startswith("["), _links(F.from_json(col, listed), listed)).otherwise(_links(F.from_json(col, mapped), mapped))
    if isinstance(t, T.MapType):
        return F.transform(F.map_entries(col), lambda e: F.struct(_printed_index(e["key"]).alias("parent"), _indices(e["value"], t.valueType).alias("children")))
    if not isinstance(t, T.ArrayType):
        return F.lit(None).cast(f"array<struct<parent:{_INDEX},children:array<{_INDEX}>>>")
    return F.transform(col, lambda e: F.struct(_index(*_part(e, t.elementType, "parent")).alias("parent"), _indices(*_part(e, t.elementType, "children")).alias("children")))


#: Fields that tell a record, wherever in a payload it lies.
GRAPH_FIELDS = ("chunks", "h2indices", "p2c_edge")


def records_in(value: object) -> Iterator[dict]:
    """Objects with a field of a chunk graph, at any depth of objects and lists."""
    if isinstance(value, dict):
        if any(isinstance(value.get(f), (list, dict)) for f in GRAPH_FIELDS):
            yield value
            return
        value = list(value.values())
    if isinstance(value, list):
        for x in value:
            if isinstance(x, (list, dict)):
                yield from records_in(x)


def read_exports(exports: DataFrame, column: str = "payload") -> DataFrame:
    """``(dag_id, chunks, levels, p2c)`` of the records in JSON payloads of any layout; invalid JSON, and what nests too deep to be read, makes no row.

    One pass finds the valid payloads, the record in each (wrapped in objects or lists, by name or by number) and the schema merged over all records; its
    rows are written once to the shared folder. Each record is then parsed once under that schema. What its layouts agree on is typed; the parts
    whose layouts exclude each other are text in it, and only those are read by each layout in turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: object = None
        for b in batches:
            ids, found = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    value = parse(x)
                    own = [(type_of(r), x if r is value else json.dumps(r, ensure_ascii=False)) for r in records_in(value)]
                except UNREADABLE:
                    continue
                for kind, record in own:
                    t = merge_types(t, kind)
                    ids.append(i)
                    found.append(record)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.nulls(len(ids), pa.string())], names=["dag_id", "record", "tree"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.string()), pa.array([json.dumps(t)])], names=["dag_id", "record", "tree"])

    found = materialise(exports.select("dag_id", column).mapInArrow(run, "dag_id bigint, record string, tree string"), "exports")
    merged = _merged([r.tree for r in found.where("tree is not null").select("tree").distinct().collect()])
    if not isinstance(merged, T.StructType):
        merged = T.StructType([])
    read = found.where("tree is null").select("dag_id", F.from_json("record", merged).alias("doc"))
    doc = F.col("doc")
    return read.select(
        "dag_id", _chunks(*_part(doc, merged, "chunks")).alias("chunks"), _levels(*_part(doc, merged, "h2indices")).alias("levels"), _links(*_part(doc, merged, "p2c_edge")).alias("p2c")
    )


def read_dags(dags: DataFrame) -> DataFrame:
    """The same columns of typed records."""
    kinds = dags.schema
    return dags.select(
        "dag_id", "chunks", _levels(F.col("h2indices"), kinds["h2indices"].dataType).alias("levels"), _links(F.col("p2c_edge"), kinds["p2c_edge"].dataType).alias("p2c")
    )


def dag_tables(records: DataFrame, portable: bool = True, sentences: bool = True) -> dict[str, DataFrame]:
    """``nodes``, ``sentences``, ``levels`` and ``edges`` of chunk graphs, with the keys that join parents with their children.

    ``record`` is the hash of a record's own contents (rows repeated word for word are one, different records of one dag_id stay apart): an MD5 that any
    engine can compute, or, not ``portable``, the engine's own and cheaper one, for tables that are joined and thrown away. Without ``sentences`` these are left out before
    anything moves. In each
    table ``id`` is the row's surrogate key, ``parent_id`` that of the row it hangs under (a sentence's is the id of its node, a node's the
    record) and ``ordinal`` its 0-based place there. Links name their ends by ``(dag_id, record, hierarchy_index, key)``: the key of a root is its ``left:right``, that of a leaf its
    sent_index. Null elements and indices without the parts of their key make no row; dangling children
    keep their edge; what is listed twice has a row for each place. Null records, fields and arrays make no rows. One shuffle
    drops repeated records, which are written once to the shared folder in their canonical form: each table reads its own columns
    of them and explodes them where they lie, and no payload is parsed twice.
    """
    rows = records.where("dag_id is not null").select(
        "dag_id",
        F.transform("chunks", lambda c: F.struct(*_flat(c["index"]), (c["sentences"] if sentences else F.lit(None).cast("array<string>")).alias("sentences"))).alias("chunks"),
        F.transform("levels", lambda e: F.struct(e["level"].alias("level"), F.transform(e["members"], lambda i: F.struct(*_flat(i))).alias("members"))).alias("levels"),
        F.transform("p2c", lambda e: F.struct(*_flat(e["parent"], "parent_"), F.transform(e["children"], lambda i: F.struct(*_flat(i, "child_"))).alias("children"))).alias("p2c"),
    )
    record = record_hash() if portable else F.xxhash64("chunks", "levels", "p2c")
    rows = rows.withColumn("record", record).groupBy("dag_id", "record").agg(*[F.first(c).alias(c) for c in ("chunks", "levels", "p2c")])
    rows = materialise(rows, "records")
    key = ["dag_id", "record"]
    made = [*key, "parent_id", "id", "ordinal"]
    chunks = flatten_tables(rows, key, "chunks", carry=True)
    levels = flatten_tables(rows, key, "levels", carry=True)
    edges = flatten_tables(rows, key, "p2c", carry=True)
    links = _keyed(_keyed(edges["p2c.children"], "child_").withColumnRenamed("key", "child_key"), "up_parent_").withColumnRenamed("key", "parent_key")
    links = links.withColumnsRenamed({f"up_parent_{c}": f"parent_{c}" for c in ("left", "right", "hierarchy_index")})
    tables = {
        "nodes": _keyed(chunks["chunks"]).select(*made, "hierarchy_index", "key", "left", "right", "passage_index", "sent_index"),
        "sentences": _keyed(chunks["chunks.sentences"], "up_").select(*made, F.col("up_hierarchy_index").alias("hierarchy_index"), "key", F.col("value").alias("sentence")),
        "levels": _keyed(levels["levels.members"]).select(*made, F.col("up_level").alias("level"), "hierarchy_index", "key"),
        "edges": links.select(*made, "parent_hierarchy_index", "parent_key", "parent_left", "parent_right", "child_hierarchy_index", "child_key", "child_sent_index"),
    }
    return tables if sentences else {k: t for k, t in tables.items() if k != "sentences"}


def record_hash() -> Column:
    """Sixteen hexadecimal digits of the MD5 of a canonical record: its chunks in order, its levels and links sorted, nulls as ``~``."""

    def part(x: Column, label: str = "") -> Column:
        return F.concat_ws(",", *[F.coalesce(x[f"{label}{c}"].cast("string"), F.lit("~")) for c in ("left", "right", "hierarchy_index", "passage_index", "sent_index")])

    def joined(a: Column, by: str) -> Column:
        return F.coalesce(F.array_join(a, by, "~"), F.lit("~"))

    chunks = joined(F.transform("chunks", lambda c: F.concat(part(c), F.lit(":"), joined(c["sentences"], "\x1f"))), "\x1e")
    levels = joined(F.array_sort(F.transform("levels", lambda e: F.concat(F.coalesce(e["level"].cast("string"), F.lit("~")), F.lit("="), joined(F.transform(e["members"], lambda i: part(i)), "|")))), ";")
    p2c = joined(F.array_sort(F.transform("p2c", lambda e: F.concat(part(e, "parent_"), F.lit(">"), joined(F.transform(e["children"], lambda i: part(i, "child_")), "|")))), ";")
    return F.left(F.md5(F.concat_ws("\n", chunks, levels, p2c)), F.lit(16))


def _flat(index: Column, label: str = "") -> list[Column]:
    return [
        F.get(index["lr_index"], 0).alias(f"{label}left"),
        F.get(index["lr_index"], 1).alias(f"{label}right"),
        *[index[c].alias(f"{label}{c}") for c in ("hierarchy_index", "passage_index", "sent_index")],
    ]


def _keyed(t: DataFrame, label: str = "") -> DataFrame:
    c = {k: F.col(f"{label}{k}") for k in ("left", "right", "hierarchy_index", "sent_index")}
    key = F.when(c["hierarchy_index"] == ROOT, F.concat(c["left"].cast("string"), F.lit(":"), c["right"].cast("string"))).otherwise(c["sent_index"].cast("string"))
    return t.withColumn("key", key).where("key is not null")


def root_leaf_links(tables: dict[str, DataFrame]) -> DataFrame:
    """``(dag_id, parent_left, parent_right, child_sent_index)`` of links from a root to a leaf, both of which have a node and stand at their level.

    Equi-joins on the record and the key, which all tables are shuffled by alike.
    """
    record = ["dag_id", "record"]
    nodes = tables["nodes"].select(*record, "hierarchy_index", "key").distinct()
    placed = tables["levels"].where("level = hierarchy_index").select(*record, "hierarchy_index", "key").distinct()
    whole = nodes.join(placed, [*record, "hierarchy_index", "key"], "left_semi")
    roots = whole.where(F.col("hierarchy_index") == ROOT).select(*record, F.col("key").alias("parent_key"))
    leaves = whole.where(F.col("hierarchy_index") == LEAF).select(*record, F.col("key").alias("child_key"))
    links = tables["edges"].where((F.col("parent_hierarchy_index") == ROOT) & (F.col("child_hierarchy_index") == LEAF))
    return links.join(roots, [*record, "parent_key"], "left_semi").join(leaves, [*record, "child_key"], "left_semi").select("dag_id", "parent_left", "parent_right", "child_sent_index").distinct()
