"""Queries that flatten the nested chunk graphs of both sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.operators.nested import dag_tables, flatten_tables, read_dags, read_exports, root_leaf_links
from longspan.sources.tables import table


def _tables(spark: SparkSession, d: str, **how: bool) -> dict[str, DataFrame]:
    return dag_tables(read_dags(table(spark, d, "chunk_dags")).unionByName(read_exports(table(spark, d, "dag_exports"))), **how)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return root_leaf_links(_tables(spark, d, portable=False, sentences=False))


def p3_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["nodes"]


def p3_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["sentences"]


def p3_edges(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["edges"]


def p3_chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """The chunks level of the typed records as the generic flattening gives it, each record once."""
    records = table(spark, d, "chunk_dags", "dag_id", "chunks").distinct()
    flat = flatten_tables(records, ["dag_id"], "chunks")["chunks"]
    return flat.select("dag_id", F.col("id").alias("chunk_id"), "ordinal", "index_hierarchy_index", "index_sent_index")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_nodes, p3_sentences, p3_edges, p3_chunk_rows)}

_PRINTED = r"\(\((-?\d+), (-?\d+)\), (-?\d+), (-?\d+), (-?\d+)\)"
_FIELDS = {"l": 1, "r": 2, "h": 3, "p": 4, "s": 5}


def _typed(i: str) -> str:
    """SQL of a typed index as a flat struct."""
    return f"{{'l': {i}.lr_index[1], 'r': {i}.lr_index[2], 'h': {i}.hierarchy_index, 'p': {i}.passage_index, 's': {i}.sent_index"


def _json(i: str) -> str:
    ends = [f"CAST(coalesce({i} ->> '$.lr_index.{name}', {i} ->> '$.lr_index[{k}]') AS INT)" for k, name in enumerate(("left", "right"))]
    return f"{{'l': {ends[0]}, 'r': {ends[1]}, " + ", ".join(f"'{c[0]}': CAST({i} ->> '$.{c}' AS INT)" for c in ("hierarchy_index", "passage_index", "sent_index"))


def _printed(k: str) -> str:
    return "{" + ", ".join(f"'{c}': CAST(nullif(regexp_extract({k}, '{_PRINTED}', {n}), '') AS INT)" for c, n in _FIELDS.items())


def _told(i: str) -> str:
    return " || ',' || ".join(f"coalesce(CAST({i}.{c} AS VARCHAR), '~')" for c in "lrhps")


def _joined(a: str, by: str) -> str:
    return f"CASE WHEN {a} IS NULL THEN '~' ELSE coalesce(array_to_string({a}, {by}), '') END"


#: Records of both sources in one canonical shape, each once, with the hash of its contents.
_RECORDS = f"""
    WITH payloads AS (SELECT dag_id, coalesce(CAST(payload AS JSON) -> '$.dag', CAST(payload AS JSON)) AS j FROM dag_exports WHERE json_valid(payload)),
    canon AS (
        SELECT dag_id, list_transform(chunks, lambda c: {_typed('c."index"')}, 'ss': c.sentences}}) AS ch,
            list_transform(map_entries(h2indices), lambda e: {{'level': CAST(e.key AS INT), 'm': list_transform(e.value, lambda i: {_typed("i")}}})}}) AS lv,
            list_transform(map_entries(p2c_edge), lambda e: {{'p': {_printed("e.key")}}}, 'c': list_transform(e.value, lambda i: {_typed("i")}}})}}) AS pc
        FROM chunk_dags
        UNION ALL
        SELECT dag_id, list_transform(CAST(j -> '$.chunks' AS JSON[]), lambda c: {_json("(c -> '$.index')")}, 'ss': CASE WHEN json_type(c -> '$.sentences') = 'ARRAY' THEN CAST(c -> '$.sentences' AS VARCHAR[]) END}}),
            CASE WHEN json_type(j -> '$.h2indices') = 'OBJECT' THEN list_transform(json_keys(j -> '$.h2indices'), lambda k: {{'level': CAST(k AS INT), 'm': list_transform(CAST(json_extract(j -> '$.h2indices', '$."' || k || '"') AS JSON[]), lambda i: {_json("i")}}})}}) END,
            CASE json_type(j -> '$.p2c_edge')
                WHEN 'OBJECT' THEN list_transform(json_keys(j -> '$.p2c_edge'), lambda k: {{'p': {_printed("k")}}}, 'c': list_transform(CAST(json_extract(j -> '$.p2c_edge', '$."' || k || '"') AS JSON[]), lambda i: {_json("i")}}})}})
                WHEN 'ARRAY' THEN list_transform(CAST(j -> '$.p2c_edge' AS JSON[]), lambda e: {{'p': {_json("(e -> '$.parent')")}}}, 'c': list_transform(CAST(e -> '$.children' AS JSON[]), lambda i: {_json("i")}}})}}) END
        FROM payloads),
    told AS (
        SELECT *, list_transform(ch, lambda c: {_told("c")} || ':' || {_joined("list_transform(c.ss, lambda x: coalesce(x, '~'))", "chr(31)")}) AS a,
            list_sort(list_transform(lv, lambda e: coalesce(CAST(e.level AS VARCHAR), '~') || '=' || {_joined(f"list_transform(e.m, lambda i: {_told('i')})", "'|'")})) AS b,
            list_sort(list_transform(pc, lambda e: {_told("e.p")} || '>' || {_joined(f"list_transform(e.c, lambda i: {_told('i')})", "'|'")})) AS c
        FROM canon),
    hashed AS (SELECT *, left(md5({_joined("a", "chr(30)")} || chr(10) || {_joined("b", "';'")} || chr(10) || {_joined("c", "';'")}), 16) AS record FROM told),
    records AS (SELECT dag_id, record, any_value(ch) AS ch, any_value(lv) AS lv, any_value(pc) AS pc, dag_id || '/' || record AS rid FROM hashed GROUP BY dag_id, record),
    n AS (SELECT dag_id, record, rid AS parent_id, rid || '/chunks/' || o AS id, CAST(o AS INTEGER) AS ordinal, c.h, c.l, c.r, c.s, c.p, c.ss FROM (SELECT *, unnest(ch) AS c, unnest(range(len(ch))) AS o FROM records)),
    l1 AS (SELECT dag_id, record, e.level, unnest(e.m) AS i FROM (SELECT *, unnest(lv) AS e FROM records)),
    e1 AS (SELECT dag_id, record, rid || '/p2c/' || o AS parent_id, e.p AS p, e.c AS c FROM (SELECT *, unnest(pc) AS e, unnest(range(len(pc))) AS o FROM records)),
    e2 AS (SELECT dag_id, record, parent_id, parent_id || '/children/' || o AS id, CAST(o AS INTEGER) AS ordinal, p.h AS ph, p.l AS pl, p.r AS pr, p.s AS ps, c.h AS ch, c.l AS cl, c.r AS cr, c.s AS cs FROM (SELECT * REPLACE (unnest(c) AS c), unnest(range(len(c))) AS o FROM e1))
    """


def _key(prefix: str = "") -> str:
    return f"CASE WHEN {prefix}h = -1 THEN {prefix}l || ':' || {prefix}r ELSE CAST({prefix}s AS VARCHAR) END"


ORACLE_SQL: dict[str, str] = {
    "p3_found": _RECORDS
    + """SELECT DISTINCT dag_id, pl AS parent_left, pr AS parent_right, cs AS child_sent_index FROM e2 k WHERE ph = -1 AND ch = 0
        AND EXISTS (SELECT 1 FROM n WHERE n.dag_id = k.dag_id AND n.record = k.record AND n.h = -1 AND n.l = k.pl AND n.r = k.pr)
        AND EXISTS (SELECT 1 FROM n WHERE n.dag_id = k.dag_id AND n.record = k.record AND n.h = 0 AND n.s = k.cs)
        AND EXISTS (SELECT 1 FROM l1 WHERE l1.dag_id = k.dag_id AND l1.record = k.record AND level = -1 AND i.h = -1 AND i.l = k.pl AND i.r = k.pr)
        AND EXISTS (SELECT 1 FROM l1 WHERE l1.dag_id = k.dag_id AND l1.record = k.record AND level = 0 AND i.h = 0 AND i.s = k.cs)""",
    "p3_nodes": _RECORDS
    + f"""SELECT dag_id, record, parent_id, id, ordinal, h AS hierarchy_index, {_key()} AS key, l AS "left", r AS "right", p AS passage_index, s AS sent_index FROM n WHERE {_key()} IS NOT NULL""",
    "p3_sentences": _RECORDS
    + f"""SELECT dag_id, record, id AS parent_id, id || '/sentences/' || o AS id, CAST(o AS INTEGER) AS ordinal, h AS hierarchy_index, {_key()} AS key, sentence
        FROM (SELECT *, unnest(ss) AS sentence, unnest(range(len(ss))) AS o FROM n) WHERE {_key()} IS NOT NULL""",
    "p3_edges": _RECORDS
    + f"""SELECT dag_id, record, parent_id, id, ordinal, ph AS parent_hierarchy_index, {_key("p")} AS parent_key, pl AS parent_left, pr AS parent_right, ch AS child_hierarchy_index, {_key("c")} AS child_key, cs AS child_sent_index
        FROM e2 WHERE {_key("p")} IS NOT NULL AND {_key("c")} IS NOT NULL""",
    "p3_chunk_rows": """
        WITH d AS (SELECT dag_id, any_value(chunks) AS chunks FROM chunk_dags GROUP BY dag_id), u AS (SELECT dag_id, unnest(chunks) AS c, unnest(range(len(chunks))) AS o FROM d)
        SELECT dag_id, dag_id || '/chunks/' || o AS chunk_id, CAST(o AS INTEGER) AS ordinal, c."index".hierarchy_index AS index_hierarchy_index, c."index".sent_index AS index_sent_index FROM u""",
}
