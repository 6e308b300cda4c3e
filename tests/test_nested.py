import json

from longspan.operators.nested import dag_tables, flatten_json, flatten_tables, infer_schema, merge_types, read_dags, read_exports, root_leaf_links, type_of

DAG = (
    "dag_id bigint, chunks array<struct<index:struct<lr_index:array<int>,hierarchy_index:int,passage_index:int,sent_index:int>,sentences:array<string>,target_sentences:array<string>>>, "
    "h2indices map<string,array<struct<lr_index:array<int>,hierarchy_index:int,passage_index:int,sent_index:int>>>, p2c_edge map<string,array<struct<lr_index:array<int>,hierarchy_index:int,passage_index:int,sent_index:int>>>"
)
ROOT, LEAF, GONE = ([0, 5], -1, 0, 0), ([0, 2], 0, 0, 0), ([2, 5], 0, 0, 1)
PRINTED = "[Index]((0, 5), -1, 0, 0)"


def record(i=1, chunks=None, h2=None, p2c=None):
    return (i, [(ROOT, ["a", "b"], None), (LEAF, ["a"], None), None] if chunks is None else chunks, {"-1": [ROOT], "0": [LEAF, None]} if h2 is None else h2, {PRINTED: [LEAF, LEAF, GONE, None]} if p2c is None else p2c)


def obj(index, layout):
    lr, h, p, s = index
    if layout == "text":
        return {"lr_index": [str(x) for x in lr], "hierarchy_index": h, "passage_index": p, "sent_index": str(s)}
    return {"lr_index": {"left": lr[0], "right": lr[1]} if layout == "object" else lr, "hierarchy_index": h, "passage_index": p, "sent_index": s}


def payload(layout, wrap=False, listed=False):
    children = [obj(LEAF, layout), obj(GONE, layout)]
    p2c = [{"parent": obj(ROOT, layout), "children": children}] if listed else {PRINTED: children}
    d = {"chunks": [{"index": obj(ROOT, layout), "sentences": ["a", "b"]}, {"index": obj(LEAF, layout), "sentences": None}], "h2indices": {"-1": [obj(ROOT, layout)], "0": [obj(LEAF, layout)]}, "p2c_edge": p2c}
    return json.dumps({"meta": {"attempt": 1}, "dag": d} if wrap else d)


def test_links_need_chunk_and_level(spark):
    rows = [record(1), record(1), record(2, h2={"-1": [ROOT], "0": []}), record(3, chunks=[(ROOT, [], None)]), record(4, p2c={}), (5, None, None, None)]
    links = root_leaf_links(dag_tables(read_dags(spark.createDataFrame(rows, DAG)))).collect()
    assert [tuple(r) for r in links] == [(1, 0, 5, 0)]


def test_exports_of_every_layout(spark):
    rows = [(10, payload("array")), (11, payload("text")), (12, payload("object", wrap=True)), (13, payload("array", listed=True)), (14, payload("array")[:-9]), (15, None), (16, "{}"), (10, payload("array"))]
    records = read_exports(spark.createDataFrame(rows, "dag_id bigint, payload string"))
    links = root_leaf_links(dag_tables(records))
    assert sorted(tuple(r) for r in links.collect()) == [(i, 0, 5, 0) for i in (10, 11, 12, 13)]


def test_empty_tables(spark):
    assert root_leaf_links(dag_tables(read_dags(spark.createDataFrame([], DAG)))).count() == 0
    assert read_exports(spark.createDataFrame([], "dag_id bigint, payload string")).count() == 0


def test_merged_types():
    assert merge_types(type_of({"a": 1}), type_of({"a": 2.5, "b": [1]})) == {"a": "double", "b": ["array", "bigint"]}
    assert merge_types(type_of([1]), type_of({"a": 1})) == "string"
    assert type_of({"(0, 1)": 3}) == ["map", "bigint"] and merge_types(None, "bigint") == "bigint"


def test_infer_schema_merges_rows(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": null, "b": {"c": [true]}}',), ("no json",), (None,)], "j string")
    assert infer_schema(df, "j").simpleString() == "struct<a:bigint,b:struct<c:array<boolean>>>"


def test_flatten_keeps_ids_and_clashing_names(spark):
    df = spark.createDataFrame([(1, [("x", [7, 8]), None]), (2, []), (3, None)], "k int, v array<struct<id:string,inner:array<int>>>")
    t = flatten_tables(df, ["k"], "v")
    top = sorted((r.k, r.parent_id, r.id, r.ordinal, r.id_) for r in t["v"].collect())
    assert top == [(1, "1", "1/v/0", 0, "x"), (1, "1", "1/v/1", 1, None)]
    assert sorted((r.parent_id, r.ordinal, r.value) for r in t["v.inner"].collect()) == [("1/v/0", 0, 7), ("1/v/0", 1, 8)]


def test_flatten_maps(spark):
    df = spark.createDataFrame([(1, {"b": [1], "a": [2, 3]})], "k int, m map<string,array<int>>")
    t = flatten_tables(df, ["k"], "m")
    assert sorted((r.ordinal, r.map_key) for r in t["m"].collect()) == [(0, "a"), (1, "b")] and t["m.item"].count() == 3


def links_of(spark, rows):
    return sorted(tuple(r) for r in root_leaf_links(dag_tables(read_exports(spark.createDataFrame(rows, "dag_id bigint, payload string")))).collect())


def test_exports_wrapped_in_any_way(spark):
    plain = json.loads(payload("array"))
    further = {f"x{i}": i for i in range(300)}
    mixed = {f"y{i}": [i, "a", {"b": i}][i % 3] for i in range(600)}
    flipped = json.loads(payload("object"), object_pairs_hook=lambda x: dict(x[::-1]) if dict(x).keys() == {"left", "right"} else dict(x))
    wrapped = [{"dag": plain}, {"dag": plain | further}, {"dag": plain, **further}, {"dag": plain | mixed}, [plain], [[{"a": {"b": [plain]}}]], {"17": plain}, {"17": {"meta": 1}, "18": {"dag": plain}}, flipped, {"x": {f"r{i}": i for i in range(300)}, "dag": json.loads(payload("text", listed=True))}]
    rows = [(i, json.dumps(w)) for i, w in enumerate(wrapped)]
    assert links_of(spark, rows) == [(i, 0, 5, 0) for i in range(len(wrapped))]
    assert links_of(spark, rows[1:2]) == [(1, 0, 5, 0)]


def test_exports_that_hold_other_things(spark):
    rows = [(1, '{"chunks": "none", "h2indices": 3, "p2c_edge": null}'), (2, '{"chunks": {"a": 1}, "p2c_edge": []}'), (3, "[1, NaN]"), (4, "[" * 5000 + "]" * 5000), (5, '{"chunks": [null, {"index": null}, {"index": {"lr_index": [1]}, "sentences": [null, 3]}], "h2indices": {"x": [null]}}'), (None, payload("array")), (6, payload("array"))]
    assert links_of(spark, rows) == [(6, 0, 5, 0)]
    assert links_of(spark, [(1, None), (2, "{}")]) == []


def test_records_of_one_id_rejoin_exactly(spark):
    a = record(1, chunks=[(ROOT, ["a"], None), (LEAF, ["b", None], None)])
    b = record(1, chunks=[(ROOT, ["c"], None), (GONE, ["d"], None), (GONE, ["e"], None)])
    t = dag_tables(read_dags(spark.createDataFrame([a, a, b], DAG)))
    nodes, sentences, edges = (t[k].collect() for k in ("nodes", "sentences", "edges"))
    assert len({n.record for n in nodes}) == 2 and len({n.id for n in nodes}) == len(nodes) == 5
    by_id = {n.id: n for n in nodes}
    said = sorted((by_id[s.parent_id].left, by_id[s.parent_id].ordinal, s.ordinal, s.sentence) for s in sentences)
    assert said == [(0, 0, 0, "a"), (0, 0, 0, "c"), (0, 1, 0, "b"), (0, 1, 1, None), (2, 1, 0, "d"), (2, 2, 0, "e")]
    assert all(by_id[s.parent_id].record == s.record for s in sentences) and len({e.id for e in edges}) == len(edges) == 6
    ends = {(n.record, n.hierarchy_index, n.key) for n in nodes}
    joined = sorted((n_sent, (e.record, 0, e.child_key) in ends) for e in edges for n_sent in [e.child_sent_index])
    assert joined == [(0, False)] * 2 + [(0, True)] * 2 + [(1, False), (1, True)]
    assert {e.parent_id.rpartition("/p2c/")[0] for e in edges} == {n.parent_id for n in nodes}


def test_flatten_json_reaches_every_field(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [{"c": 1}, {"c": 2, "d": ["x"]}]}, "e": "f"}'), (2, '{"a": {"b": []}, "g": 2.5}'), (3, "no"), (4, None)], "k int, j string")
    t = flatten_json(df, ["k"], "j")
    assert sorted(t) == ["j", "j.a_b", "j.a_b.d"]
    assert sorted((r.k, r.e, r.g) for r in t["j"].collect()) == [(1, "f", None), (2, None, 2.5)]
    assert [(r.parent_id, r.ordinal, r.value) for r in t["j.a_b.d"].collect()] == [("1/j/0/a_b/1", 0, "x")]


def test_wide_objects():
    one_type, several = {f"k{i}": [i] for i in range(300)}, {f"k{i}": [i, "a"][i % 2] for i in range(300)}
    assert type_of(one_type) == ["map", ["array", "bigint"]] and len(type_of(several)) == 300
    assert merge_types(type_of({f"a{i}": "x" for i in range(200)}), type_of({f"b{i}": "x" for i in range(200)})) == ["map", "string"]
