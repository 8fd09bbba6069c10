import json

import pytest

from plexaform.operators.nested import array_links, array_rows, variant_children, variant_links, variant_tree, whole


def tree(spark, payloads, again="refines", keyed=True):
    df = spark.createDataFrame([(f"r{i}", p) for i, p in enumerate(payloads)], "rec string, payload string")
    top = df.selectExpr("rec", f"{whole('payload')} AS v").selectExpr("rec", "try_variant_get(v, '$.o', 'variant') AS top")
    return variant_tree(top, "rec", "top", "id", again=again, keyed=keyed)


@pytest.mark.parametrize("value, keys", [
    ([{"id": "a"}, None, {"x": 1}, {"id": "b"}], {"a", "b", None}), ({"id": "a", "n": {"z": 1}}, {"a"}), ({"a": {"x": 1}, "b": {"id": "c"}}, {"a", "c"}),
    (json.dumps([{"id": "a"}]), {"a"}), (None, set()), ([], set()), ({}, set()), ("no json", set()), (7, set()), ({"x": 1}, set())])
def test_layouts(spark, value, keys):
    rows = tree(spark, [json.dumps({"o": value})]).collect()
    assert {r["child_key"] for r in rows} == keys or {r["child_key"] for r in rows} - {None} == keys - {None}


def test_incomplete_texts(spark):
    good = json.dumps({"o": [{"id": "a"}]})
    rows = tree(spark, [good, good[:-1], good + " x", good + good, None, "", "  "]).collect()
    assert [(r["record_key"], r["child_key"]) for r in rows] == [("r0", "a")]


def test_recursion_beyond_one_expression(spark):
    deep = None
    for i in range(11, 0, -1):
        deep = [{"id": f"n{i}", "w": {"id": f"w{i}"}, **({"refines": deep} if deep else {})}]
    t = tree(spark, [json.dumps({"o": deep})])
    assert {(r["parent_key"], r["child_key"], r["level"]) for r in t.collect()} == {("r0", "n1", 0)} | {(f"n{i}", f"n{i + 1}", i) for i in range(1, 11)}
    assert {(r["parent_key"], r["child_key"]) for r in variant_children(t, "w", "id").collect()} == {(f"n{i}", f"w{i}") for i in range(1, 12)}


def test_typed_arrays(spark):
    df = spark.createDataFrame([("g", [("e", [("t0",), None, ("t0",)]), None, ("f", None), (None, [("u",)])]), ("h", None), ("i", [])], "k string, es array<struct<id string, ts array<struct<tid string>>>>")
    rows = array_rows(df, "k", [("es", "id"), ("ts", "tid")], {"copy": "x.tid"}).collect()
    assert sorted((r["parent_key"] or "", r["position"], r["child_key"], r["copy"]) for r in rows) == [("", "3.0", "u", "u"), ("e", "0.0", "t0", "t0"), ("e", "0.2", "t0", "t0")]
    assert array_rows(df, "k", [("es", "id")], {}).count() == 3


def test_links_in_one_pass(spark):
    deep = None
    for i in range(9, 0, -1):
        deep = [{"id": f"n{i}", "w": [{"wid": f"w{i}", "x": {"in": {"e": f"e{i}"}}}, None, {"no": 1}], **({"refines": deep} if deep else {})}]
    df = spark.createDataFrame([("r", json.dumps({"o": deep})), ("s", None), ("t", "{")], "rec string, payload string")
    top = df.selectExpr("rec", f"{whole('payload')} AS v").selectExpr("rec", "try_variant_get(v, '$.o', 'variant') AS top")
    got = {tuple(r) for r in variant_links(top, "rec", "top", "node", "id", [("witness", "node", "w", "wid"), ("edge", "witness", "x.in", "e")], again="refines", keyed=True).collect()}
    want = {("r", "node", "r" if i == 1 else f"n{i - 1}", f"n{i}") for i in range(1, 10)} | {("r", "witness", f"n{i}", f"w{i}") for i in range(1, 10)} | {("r", "edge", f"w{i}", f"e{i}") for i in range(1, 10)}
    assert got == want
    typed = spark.createDataFrame([("g", [("e", [("t0",), None, ("t0",)]), None, ("f", None), (None, [("u",)])], [("n",), None]), ("h", None, None), ("i", [], [])], "k string, es array<struct<id string, ts array<struct<tid string>>>>, ns array<struct<id string>>")
    rows = sorted(tuple(r) for r in array_links(typed, "k", [("edge", [("es", "id")]), ("tile", [("es", "id"), ("ts", "tid")]), ("node", [("ns", "id")])]).collect() if r["parent_key"])
    assert rows == [("g", "edge", "g", "e"), ("g", "edge", "g", "f"), ("g", "node", "g", "n"), ("g", "tile", "e", "t0"), ("g", "tile", "e", "t0")]
