"""Log and text sources: profiler logs, dispatch logs, DOT graphs, JSON results. Lines come as (line_no, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, value of text files; a file is numbered on its own, in one task that reads it anyway."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("t"))
    return files.select("path", F.posexplode(F.split("t", "\r?\n")).alias("line_no", "value"))


def parse_profile(lines: DataFrame, begin: str = "graph_begin", end: str = "graph_end", tag: str = "PROFILE", drop_first: int = 0) -> DataFrame:
    """graph, node, op, fused, cycles, us, name of marker-delimited profile rows ``TAG|node=..|op=..``.

    Only graphs with both markers count; the first ``drop_first`` of them (warm-up) are left out. lines also has ``run``,
    the unit whose lines are in order."""
    w = Window.partitionBy("run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    seg = lines.withColumn("graph", F.sum((F.col("value") == begin).cast("int")).over(w))
    whole = seg.where(F.col("value") == end).select(F.col("run").alias("r2"), F.col("graph").alias("g2")).distinct()
    rows = seg.where(F.startswith("value", F.lit(f"{tag}|"))).join(whole, (F.col("run") == F.col("r2")) & (F.col("graph") == F.col("g2")), "left_semi").where(F.col("graph") > drop_first)
    field = lambda k: F.nullif(F.regexp_extract("value", rf"\|{k}=([^|]*)", 1), F.lit(""))
    return rows.select("run", F.col("graph").cast("int").alias("graph"), field("node").cast("int").alias("node"), field("op").alias("op"), field("fused").cast("int").alias("fused"), field("cycles").cast("bigint").alias("cycles"), field("us").cast("bigint").alias("us"), field("name").alias("name"))


def parse_substages(lines: DataFrame) -> DataFrame:
    """tokens, stage, us of every ``stage=<name>:<us>`` pair on lines ``tokens=<n> ...``."""
    x = lines.select(F.regexp_extract("value", r"tokens=(\d+)", 1).alias("t"), F.regexp_extract_all("value", F.lit(r"stage=(\w+:\d+)"), 1).alias("p")).where("t <> ''")
    y = x.select(F.col("t").cast("int").alias("tokens"), F.explode("p").alias("p"))
    return y.select("tokens", F.split("p", ":")[0].alias("stage"), F.split("p", ":")[1].cast("bigint").alias("us"))


def parse_dispatch(lines: DataFrame) -> DataFrame:
    """path, rows, cols of lines ``dispatch <path> <rows>x<cols>``."""
    m = lambda k: F.regexp_extract("value", r"^dispatch (\w+) (\d+)x(\d+)$", k)
    return lines.where(F.col("value").rlike(r"^dispatch \w+ \d+x\d+$")).select(m(1).alias("path"), m(2).cast("int").alias("rows"), m(3).cast("int").alias("cols"))


def parse_dot(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes: id, label; edges: src, dst; dangling edges) of DOT lines; ids are the order of first definition."""
    n = lines.select("line_no", F.regexp_extract("value", r'^\s*"?(\w+)"?\s*\[.*label="([^"]*)"', 1).alias("ptr"), F.regexp_extract("value", r'^\s*"?(\w+)"?\s*\[.*label="([^"]*)"', 2).alias("label")).where("ptr <> ''")
    first = n.groupBy("ptr").agg(F.min_by("label", "line_no").alias("label"), F.min("line_no").alias("line_no"))
    from ..operators.sequences import global_index
    nodes = global_index(first, ["line_no", "ptr"], "id")
    e = lines.select(F.regexp_extract("value", r'^\s*"?(\w+)"?\s*->\s*"?(\w+)"?', 1).alias("a"), F.regexp_extract("value", r'^\s*"?(\w+)"?\s*->\s*"?(\w+)"?', 2).alias("b")).where("a <> ''")
    p, q = nodes.select(F.col("ptr").alias("pa"), F.col("id").alias("src")), nodes.select(F.col("ptr").alias("pb"), F.col("id").alias("dst"))
    linked = e.join(p, F.col("a") == F.col("pa"), "left").join(q, F.col("b") == F.col("pb"), "left")
    return nodes.select("id", "label"), linked.where("src is not null and dst is not null").select("src", "dst"), linked.where("src is null or dst is null").select("a", "b")


def last_json(lines: DataFrame, by: str, schema: str, metric: str) -> DataFrame:
    """The last JSON object of each run's lines; one without ``metric`` is an error."""
    objects = lines.where(F.trim("value").like("{%}"))
    last = objects.groupBy(by).agg(F.max_by("value", "line_no").alias("v")).select(by, F.from_json("v", schema).alias("o"))
    return last.select(by, F.when(F.assert_true(F.col(f"o.{metric}").isNotNull()).isNull(), F.col("o")).alias("o")).select(by, "o.*")


def counters(spark: SparkSession, path: str) -> DataFrame:
    """name, value of evidence files whose ``metrics`` is an object or an array of {name, value}."""
    return parse_counters(spark.read.text(path, wholetext=True))


def parse_counters(texts: DataFrame) -> DataFrame:
    raw = texts.select(F.try_parse_json("value").alias("v"))
    m = "try_variant_get(v, '$.metrics', 'map<string,double>')"
    a = "try_variant_get(v, '$.metrics', 'array<struct<name string, value double>>')"
    return raw.select(F.expr(f"inline(coalesce(transform(map_entries({m}), e -> named_struct('name', e.key, 'value', e.value)), {a}, array()))"))
