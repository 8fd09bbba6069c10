"""Queries of the source family: texts are made from the tables and read back through the parsers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import market as mk
from ..sources import files, logs
from ..session import Scratch, load
from .registry import Registry

R = Registry()


def _lines(spark, sf_dir) -> DataFrame:
    """A profile log per run: markers around every run's samples."""
    p = load(spark, sf_dir, "profile_samples").dropDuplicates(["sample_id"])
    body = F.concat(F.lit("PROFILE|node="), F.col("node").cast("string"), F.lit("|op="), F.lower(F.trim("op")), F.lit("|fused="), F.col("fused").cast("string"), F.lit("|cycles="), F.col("cycles").cast("string"), F.lit("|us="), F.col("microseconds").cast("string"), F.lit("|name="), F.coalesce("name", F.lit("")))
    rows = p.where("cycles is not null and microseconds is not null").select(F.col("run_id").alias("run"), F.col("sample_id").alias("line_no"), body.alias("value"))
    ends = rows.groupBy("run").agg((F.min("line_no") - 1).alias("a"), (F.max("line_no") + 1).alias("b"))
    return rows.unionByName(ends.select("run", F.col("a").alias("line_no"), F.lit("graph_begin").alias("value"))).unionByName(ends.select("run", F.col("b").alias("line_no"), F.lit("graph_end").alias("value")))


@R.add("src09_profile_log", "SELECT lower(trim(op)) AS op, count(*) AS n, CAST(sum(microseconds) AS BIGINT) AS us, CAST(sum(cycles) AS BIGINT) AS cycles FROM (SELECT DISTINCT ON (sample_id) * FROM profile_samples ORDER BY sample_id) WHERE cycles IS NOT NULL AND microseconds IS NOT NULL GROUP BY 1")
def src09_profile_log(spark, sf_dir):
    return logs.parse_profile(_lines(spark, sf_dir)).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("us").alias("us"), F.sum("cycles").alias("cycles"))


@R.add("src10_substage_log", "SELECT l_linenumber AS tokens, 'read' AS stage, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS us FROM lineitem GROUP BY 1 UNION ALL SELECT l_linenumber, 'write', CAST(sum(CAST(l_quantity AS BIGINT) * 2) AS BIGINT) FROM lineitem GROUP BY 1")
def src10_substage_log(spark, sf_dir):
    q = F.col("l_quantity").cast("bigint")
    lines = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("tokens="), F.col("l_linenumber").cast("string"), F.lit(" stage=read:"), q.cast("string"), F.lit(" stage=write:"), (q * 2).cast("string")).alias("value"))
    return logs.parse_substages(lines).groupBy("tokens", "stage").agg(F.sum("us").alias("us"))


@R.add("src11_dispatch_log", "SELECT lower(p_brand[1:5]) AS path, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS rows FROM part GROUP BY 1")
def src11_dispatch_log(spark, sf_dir):
    lines = load(spark, sf_dir, "part").select(F.concat(F.lit("dispatch "), F.lower(F.substring("p_brand", 1, 5)), F.lit(" "), F.col("p_size").cast("string"), F.lit("x256")).alias("value"))
    return logs.parse_dispatch(lines).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))


@R.add("src12_dot_graph", "SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_regionkey AS BIGINT) AS dst FROM nation")
def src12_dot_graph(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    nodes = n.select(F.col("n_nationkey").cast("bigint").alias("line_no"), F.concat(F.lit('  "p'), F.col("n_nationkey").cast("string"), F.lit('" [label="'), "n_name", F.lit('"];')).alias("value"))
    edges = n.select((F.col("n_nationkey") + 100).cast("bigint").alias("line_no"), F.concat(F.lit('  "p'), F.col("n_nationkey").cast("string"), F.lit('" -> "p'), F.col("n_regionkey").cast("string"), F.lit('";')).alias("value"))
    return logs.parse_dot(nodes.unionByName(edges))[1]


@R.add("src15_last_json", "SELECT o_custkey AS run, max(o_orderkey) AS metric FROM orders GROUP BY 1")
def src15_last_json(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("line_no"), F.concat(F.lit('{"metric": '), F.col("o_orderkey").cast("string"), F.lit("}")).alias("value"))
    return logs.last_json(o, "run", "metric bigint", "metric")


@R.add("src18_dot_text", """SELECT 0 AS section, '  "' || n_nationkey || '" [label="' || n_name || '"];' AS line FROM nation UNION ALL SELECT 1, '  "' || n_nationkey || '" -> "' || n_regionkey || '";' FROM nation""")
def src18_dot_text(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    return files.dot_text(n, "n_nationkey", "n_name", n, "n_nationkey", "n_regionkey")


_FIELD = "CASE WHEN {0} IS NULL THEN NULL ELSE '\"{0}\":' || {1} END"


@R.add("src19_learning_lines", "SELECT '{' || array_to_string(list_filter([" + ", ".join(_FIELD.format(c, v) for c, v in (("example_id", "example_id"), ("branch_id", "to_json(branch_id)"), ("stage", "to_json(stage)"), ("depth", "depth"), ("target", "target"))) + "], lambda x: x IS NOT NULL), ',') || '}' AS value FROM search_examples")
def src19_learning_lines(spark, sf_dir):
    return load(spark, sf_dir, "search_examples").select(F.to_json(F.struct("example_id", "branch_id", "stage", "depth", "target")).alias("value"))


@R.add("src20_stage_cache", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def src20_stage_cache(spark, sf_dir):
    """Built once, then read from its content-addressed path."""
    root = Scratch(spark).root
    build = lambda: load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    files.cached_stage(spark, root, "status", {"table": sf_dir, "version": 1}, build)
    return files.cached_stage(spark, root, "status", {"table": sf_dir, "version": 1}, build)[0]


@R.add("src21_idempotent_store", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'stored' WHEN o_orderkey % 5 = 0 THEN 'conflict' ELSE 'duplicate' END AS status, count(*) AS n FROM orders GROUP BY 1")
def src21_idempotent_store(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    stored = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.sha2(F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE o_orderstatus END"), 256).alias("h"))
    return files.idempotent_status(o, "o_orderkey", F.col("o_orderstatus"), stored, "k", "h").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@R.add("src08_adversarial_trace", f"SELECT i % 4 AS key, i AS position, CAST(i % 3 + 1 AS INTEGER) AS kind, CAST(i % 2 AS INTEGER) AS side, CAST({mk.BASE_TICK} + (i * 37) % 64 AS INTEGER) AS price_ticks, CAST((i * 13) % 50 AS INTEGER) AS quantity, i AS sequence FROM range(1, 201) t(i)")
def src08_adversarial_trace(spark, sf_dir):
    return mk.adversarial_trace(spark, 200)


@R.add("src02_records", "SELECT stage, count(*) AS n, CAST(sum(target) AS BIGINT) AS target FROM search_examples GROUP BY 1")
def src02_records(spark, sf_dir):
    """Records written as JSON lines and read back by their schema."""
    path = f"{Scratch(spark).root}/records"
    files.write_json_lines(load(spark, sf_dir, "search_examples").select("example_id", "branch_id", "stage", "target"), path)
    rows = files.read_records(spark, path, "example_id bigint, branch_id string, stage string, target int")
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("target"))


def _nation_trace(spark, sf_dir) -> tuple[str, int]:
    path = f"{Scratch(spark).root}/nations.trace"
    k = F.col("n_nationkey")
    n = load(spark, sf_dir, "nation").select(k, mk.encode_event(F.lit(1), k % 2, mk.BASE_TICK + k, F.col("n_regionkey") * 10, k + 1).alias("raw"))
    return path, files.write_binary_trace(spark, path, n, "n_nationkey", "raw", 7)


@R.add("src06_trace_write", "SELECT 16 + 18 * count(*) AS length, '5354484654563100' || lpad(to_hex(count(*)), 8, '0') || '00000007' AS header FROM nation")
def src06_trace_write(spark, sf_dir):
    """Length and header of the file that is written."""
    path, _ = _nation_trace(spark, sf_dir)
    return spark.read.format("binaryFile").load(path).select("length", F.hex(F.substring("content", 1, 16)).alias("header"))


@R.add("src07_trace_read", "SELECT CAST(n_nationkey AS BIGINT) AS position, n_nationkey % 2 AS side, 100000 + n_nationkey AS price_ticks, n_regionkey * 10 AS quantity, CAST(n_nationkey + 1 AS DECIMAL(20,0)) AS sequence FROM nation")
def src07_trace_read(spark, sf_dir):
    """The file read back and decoded, message by message."""
    path, _ = _nation_trace(spark, sf_dir)
    d = files.read_binary_trace(spark, path).select(F.col("position").cast("bigint").alias("position"), mk.decode_event(F.col("message")).alias("d"))
    return d.select("position", "d.side", "d.price_ticks", "d.quantity", "d.sequence")


@R.add("src13_manifest", "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, r_name AS region, CAST(n_nationkey AS VARCHAR) AS weight FROM nation JOIN region ON r_regionkey = n_regionkey")
def src13_manifest(spark, sf_dir):
    """A graph manifest written as one file and loaded to its node and edge tables."""
    n = [r.asDict() for r in load(spark, sf_dir, "nation").collect()]  # a manifest describes one small graph
    r = [x.asDict() for x in load(spark, sf_dir, "region").collect()]
    nodes = [{"id": f"n{x['n_nationkey']}", "kind": "nation"} for x in n] + [{"id": f"r{x['r_regionkey']}", "kind": "region", "name": x["r_name"]} for x in r]
    path = f"{Scratch(spark).root}/graph.json"
    files.write_bytes(spark, path, json.dumps({"nodes": nodes, "edges": [{"src": f"n{x['n_nationkey']}", "dst": f"r{x['n_regionkey']}", "weight": x["n_nationkey"]} for x in n]}).encode())
    nodes, edges = files.load_manifest(spark, path)
    named = nodes.select("id", F.col("attrs")["name"].alias("region"))
    return edges.join(named, F.col("dst") == F.col("id")).select("src", "dst", "region", F.col("attrs")["weight"].alias("weight"))
