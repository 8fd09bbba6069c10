import gzip
import json

import pytest
from pyspark.sql import functions as F

from plexaform.operators.datasets import Store
from plexaform.sources import files, logs
from plexaform.streaming import live


def test_binary_trace(spark, tmp_path):
    messages = [bytes([i] * 18) for i in range(5)]
    df = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(messages)], "i int, m binary")
    assert files.write_binary_trace(spark, str(tmp_path / "t.bin"), df, "i", "m", 7) == 5
    with pytest.raises(ValueError):
        files.write_binary_trace(spark, str(tmp_path / "s.bin"), spark.createDataFrame([(1, bytearray(b"short"))], "i int, m binary"), "i", "m", 7)
    got = files.read_binary_trace(spark, str(tmp_path / "t.bin")).orderBy("position").collect()
    assert [bytes(r["message"]) for r in got] == messages
    (tmp_path / "bad.bin").write_bytes((tmp_path / "t.bin").read_bytes() + b"x")
    with pytest.raises(Exception):
        files.read_binary_trace(spark, str(tmp_path / "bad.bin")).collect()


def test_trace_lines(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"sequence":0,"timestamp_ns":1,"information_id":"a","event":"construct","scope_instances":{"f":"1"}}\n\n')
    r = files.read_trace(spark, str(p)).first()
    assert (r["information_id"], r["byte_count"], r["scope_instances"]) == ("a", 0, {"f": "1"})
    p.write_text("not json\n")
    with pytest.raises(Exception):
        files.read_trace(spark, str(p)).collect()


def test_profile_log(spark, tmp_path):
    row = "PROFILE|node=1|op=mul|fused=0|cycles=10|us={}|name=x"
    (tmp_path / "log.txt").write_text("\n".join(["noise", "graph_begin", row.format(1), "graph_end", "graph_begin", row.format(2), "graph_end", "graph_begin", row.format(3)]))
    lines = logs.read_lines(spark, str(tmp_path / "log.txt")).withColumnRenamed("path", "run")
    assert [r["us"] for r in logs.parse_profile(lines).orderBy("us").collect()] == [1, 2]
    assert [r["us"] for r in logs.parse_profile(lines, drop_first=1).collect()] == [2]


def test_dot_and_counters(spark, tmp_path):
    lines = spark.createDataFrame([(0, '"a1" [label="mul"];'), (1, '"b2" [label="add"];'), (2, '"a1" -> "b2";'), (3, '"a1" -> "zz";')], "line_no bigint, value string")
    nodes, edges, lost = logs.parse_dot(lines)
    assert {(r["id"], r["label"]) for r in nodes.collect()} == {(0, "mul"), (1, "add")}
    assert [tuple(r) for r in edges.collect()] == [(0, 1)] and lost.count() == 1
    (tmp_path / "a.json").write_text(json.dumps({"metrics": {"x": 1.5}}))
    (tmp_path / "b.json").write_text(json.dumps({"metrics": [{"name": "y", "value": 2}]}))
    assert {tuple(r) for r in logs.counters(spark, str(tmp_path / "*.json")).collect()} == {("x", 1.5), ("y", 2.0)}


def test_store_is_immutable(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "id string, x int")
    assert store.append("roots", rows, "id") == 2
    assert store.append("roots", rows, "id") == 0
    for bad in ([("a", 9)], [("c", 1), ("c", 2)], [(None, 1)]):
        with pytest.raises(ValueError):
            store.append("roots", spark.createDataFrame(bad, "id string, x int"), "id")
    assert store.load("roots").count() == 2


def test_manifest_discovery_sinks(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": 1, "kind": "k", "w": 3}, {"id": 2}], "edges": [{"src": 1, "dst": 2}]}))
    nodes, edges = files.load_manifest(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and edges.count() == 1
    (tmp_path / "h.json").write_text(json.dumps({"nodes": [], "edges": [{"src": 1, "dst": 2}]}))
    with pytest.raises(ValueError):
        files.load_manifest(spark, str(tmp_path / "h.json"))
    (tmp_path / "c1.json").write_text('{"id":"a","v":1}\n')
    with gzip.open(tmp_path / "c2.json.gz", "wt") as f:
        f.write('{"id":"a","v":2}\n{"id":"b","v":3}\n')
    got = files.discover(spark, [str(tmp_path / "c1.json"), str(tmp_path / "c2.json.gz")], "id", "id string, v int")
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", 3)}
    files.write_rows(got, str(tmp_path / "csv"), "csv", ["id"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["id"]
    files.write_json_lines(got, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2
    assert files.graphml_text(nodes, "id", edges, "src", "dst").count() == 3


def stream_rows(spark, tmp_path, batches, schema, build, mode):
    src = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    name = f"out_{abs(hash(str(tmp_path))) % 10**8}"
    q = build(s).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_streamed_sequences(spark, tmp_path):
    got = stream_rows(spark, tmp_path, [[("k", 1, 10), ("k", 3, 30)], [("k", 2, 20), ("k", 4, 40), ("k", 4, 41)]], "k string, s bigint, v bigint", lambda s: live.increasing(s, "k", "s", ["v"]), "append")
    # 2 and the second 4 come too late or twice and change nothing
    assert sorted((r["s"], r["v"]) for r in got) == [(1, 10), (3, 30), (4, 40)]


def test_streamed_counter_and_book(spark, tmp_path):
    got = stream_rows(spark, tmp_path / "a", [[("k", 2)], [("k", 5), ("j", 1)]], "k string, v bigint", lambda s: live.running_counter(s, "k", "v"), "complete")
    assert {(r["k"], r["calls"], r["total"]) for r in got} == {("k", 2, 7), ("j", 1, 1)}
    rows = [(1, i, 1, i % 2, 100000 + i, 5, i + 1) for i in range(6)]
    schema = "key bigint, position bigint, kind int, side int, price_ticks int, quantity int, sequence bigint"
    got = stream_rows(spark, tmp_path / "b", [rows], schema, lambda s: live.live_pipeline(s, 100, 10), "append")
    assert [r["status"] for r in got] == [0] * 6


def test_cached_stage(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    assert files.cached_stage(spark, str(tmp_path), "s", {"a": 1}, build)[1] is False
    assert files.cached_stage(spark, str(tmp_path), "s", {"a": 1}, build)[1] is True
    assert files.cached_stage(spark, str(tmp_path), "s", {"a": 2}, build)[1] is False and len(calls) == 2


def test_hex_and_names(spark):
    from plexaform.functions.cleaning import hex_key, name_key, split_key

    df = spark.createDataFrame([(" Rt-3c8e6a95:da3e41e1",), ("0x3C8E6A95DA3E41E1",), ("root:3c8e6a95da3e41e1 ",), ("n/a",), (None,), ("short",)], "v string")
    assert [r[0] for r in df.select(hex_key(F.col("v"), 16)).collect()] == ["3c8e6a95da3e41e1"] * 3 + [None] * 3
    names = spark.createDataFrame([("Keen_Rivet-10c ",), ("-",), ("",)], "v string")
    assert [r[0] for r in names.select(name_key(F.col("v"))).collect()] == ["keen-rivet-10c", None, None]
    s = spark.createDataFrame([("TRAIN ",), (" test",), ("dev",), ("x",), (None,)], "v string")
    assert [r[0] for r in s.select(split_key(F.col("v"))).collect()] == ["train", "test", "validation", None, None]


def test_growing_table(spark):
    """Many parts are merged, none is lost, and what is dropped is no longer on disk."""
    import os

    from plexaform.session import Pile, Scratch

    tmp = Scratch(spark)
    first = tmp.keep(spark.range(0, 3))
    pile = Pile(tmp, first, most=4)
    for k in range(1, 12):
        pile.add(tmp.keep(spark.range(3 * k, 3 * k + 3)))
    assert sorted(r[0] for r in pile.all().collect()) == list(range(36)) and len(pile.parts) <= 5
    assert not os.path.exists(first._plexaform_path.removeprefix("file:"))
