"""File sources and sinks: validated JSON lines, binary traces, manifests, graph text, cached stages."""

from __future__ import annotations

import json
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values of the binary trace: magic, count, seed; then messages of 18 bytes
HEADER = ">8sII"
MAGIC = b"STHFTV1\0"
MESSAGE_BYTES = 18

TRACE_SCHEMA = ("sequence bigint, timestamp_ns bigint, information_id string, semantic_identity string, event string, scope_instances map<string,string>, "
                "mutation string, equivalence_key string, placement string, destination string, byte_count bigint")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Lifetime events of JSON lines; a line that is no such record is an error, blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", TRACE_SCHEMA, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    return parsed.withColumn("byte_count", F.coalesce("byte_count", F.lit(0)))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, on whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def write_binary_trace(spark: SparkSession, path: str, messages: DataFrame, order: str, message: str, seed: int) -> int:
    """One artifact: header and messages in ``order``; gives their number. A trace is held by the driver once, as it is one file;
    a message of another length is an error."""
    rows = [bytes(r[0]) for r in messages.orderBy(order).select(message).toLocalIterator()]
    if any(len(m) != MESSAGE_BYTES for m in rows):
        raise ValueError(f"a message must have {MESSAGE_BYTES} bytes")
    write_bytes(spark, path, struct.pack(HEADER, MAGIC, len(rows), seed) + b"".join(rows))
    return len(rows)


def read_binary_trace(spark: SparkSession, path: str) -> DataFrame:
    """path, position, message; a wrong magic, a short message or a trailing byte is an error."""
    return split_binary_trace(spark.read.format("binaryFile").load(path))


def split_binary_trace(blobs: DataFrame) -> DataFrame:
    """path, content -> path, position, message."""
    f = blobs.select("path", F.hex("content").alias("h"), F.octet_length("content").alias("n"))
    count = F.conv(F.substring("h", 17, 8), 16, 10).cast("int")
    ok = F.assert_true((F.substring("h", 1, 16) == MAGIC.hex().upper()) & (F.col("n") == 16 + MESSAGE_BYTES * count))
    f = f.withColumn("count", F.when(ok.isNull(), count)).where("count > 0")
    rows = f.select("path", "h", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("position"))
    return rows.select("path", "position", F.unhex(F.substring(F.col("h"), F.col("position") * (2 * MESSAGE_BYTES) + 33, F.lit(2 * MESSAGE_BYTES))).alias("message"))


def load_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, kind, attrs; edges: src, dst, attrs) of a JSON or, where a YAML reader is installed, YAML manifest."""
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        data = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no YAML reader is installed") from e
        data = yaml.safe_load(text)
    flat = lambda d, skip: {str(k): json.dumps(v) if isinstance(v, (dict, list)) else str(v) for k, v in d.items() if k not in skip}
    nodes = [(str(n["id"]), n.get("kind"), flat(n, ("id", "kind"))) for n in data.get("nodes", [])]
    edges = [(str(e["src"]), str(e["dst"]), flat(e, ("src", "dst"))) for e in data.get("edges", [])]
    known = {n[0] for n in nodes}
    lost = [e for e in edges if e[0] not in known or e[1] not in known]
    if lost:
        raise ValueError(f"edge to an unknown node: {lost[0][:2]}")
    return spark.createDataFrame(nodes, "id string, kind string, attrs map<string,string>"), spark.createDataFrame(edges, "src string, dst string, attrs map<string,string>")


def discover(spark: SparkSession, paths: list[str], key: str, schema: str) -> DataFrame:
    """Records of plain and gzip JSON files; of several with one key the one from the first path counts."""
    d = spark.read.schema(schema).json(paths).withColumn("__f", F.input_file_name())
    rest = [c for c in d.columns if c not in (key, "__f")]
    return d.groupBy(key).agg(F.min_by(F.struct(*rest), "__f").alias("r")).select(key, "r.*")


def write_rows(df: DataFrame, path: str, form: str, fields: list[str] | None = None) -> None:
    df = df.select(*fields) if fields else df
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if form == "csv" else writer.json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Learning examples: one JSON object a line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def dot_text(nodes: DataFrame, node: str, label: str, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """section, line: the body of a DOT graph, nodes (0) before edges (1)."""
    n = nodes.select(F.lit(0).alias("section"), F.concat(F.lit('  "'), F.col(node).cast("string"), F.lit('" [label="'), F.replace(F.col(label).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"];')).alias("line"))
    e = edges.select(F.lit(1).alias("section"), F.concat(F.lit('  "'), F.col(src).cast("string"), F.lit('" -> "'), F.col(dst).cast("string"), F.lit('";')).alias("line"))
    return n.unionByName(e)


def graphml_text(nodes: DataFrame, node: str, edges: DataFrame, src: str, dst: str) -> DataFrame:
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.lit(0).alias("section"), F.concat(F.lit('<node id="'), esc(node), F.lit('"/>')).alias("line"))
    return n.unionByName(edges.select(F.lit(1).alias("section"), F.concat(F.lit('<edge source="'), esc(src), F.lit('" target="'), esc(dst), F.lit('"/>')).alias("line")))


def cached_stage(spark: SparkSession, root: str, name: str, key: dict, build) -> tuple[DataFrame, bool]:
    """(rows, reused): the stage's table under a path named by the digest of its inputs, built only if it isn't complete."""
    import hashlib

    digest = hashlib.sha256(json.dumps(key, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]
    path = f"{root}/{name}-{digest}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    reused = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    if not reused:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), reused


def idempotent_status(incoming: DataFrame, key: str, payload: Column, stored: DataFrame, stored_key: str, stored_hash: str) -> DataFrame:
    """key, status: stored (new), duplicate (same hash) or conflict (other hash)."""
    s = stored.select(F.col(stored_key).alias("__k"), F.col(stored_hash).alias("__h"))
    j = incoming.select(F.col(key), F.sha2(payload, 256).alias("__p")).join(s, F.col(key) == F.col("__k"), "left")
    return j.select(key, F.when(F.col("__k").isNull(), "stored").when(F.col("__h") == F.col("__p"), "duplicate").otherwise("conflict").alias("status"))
