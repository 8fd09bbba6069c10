"""Queries of the general problems: heavy keys, nested records, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import hex_key, name_key, present
from ..operators.hierarchy import descendants, hierarchy
from ..operators.hotkeys import heavy_keys, keyed_states
from ..operators.nested import array_links, array_rows, variant_links, variant_tree, whole
from ..session import Scratch, load
from .registry import Registry

R = Registry()

#: DuckDB: NULL where the text only says that there is no value (fixed values, as in functions.cleaning)
_MISSING = "('', '-', '--', '–', '—', 'unknown', 'n/a', 'na', 'none', 'null', 'nil', 'nan', 'missing', 'undefined')"


def sql_present(col: str) -> str:
    return f"CASE WHEN lower(trim({col}, ' ' || chr(9) || chr(10) || chr(13))) NOT IN {_MISSING} THEN {col} END"


def sql_name(col: str) -> str:
    return f"regexp_replace(lower(trim({sql_present(col)}, ' ' || chr(9) || chr(10) || chr(13))), '[\\s_\\-]+', '-', 'g')"


def sql_hex(col: str, digits: int) -> str:
    return f"nullif(regexp_extract(regexp_replace(lower({sql_present(col)}), '[^0-9a-z]', '', 'g'), '([0-9a-f]{{{digits}}})$', 1), '')"


# ---- 1: a few keys holding most records


@R.add("p1_found", """
    SELECT 'search_examples.root_id' AS field, root_id AS key_value FROM search_examples WHERE root_id IS NOT NULL
    GROUP BY root_id HAVING count(*) >= 0.04::DOUBLE * (SELECT count(*) FROM search_examples)
    UNION ALL
    SELECT 'lazy_trace_nodes.family', family FROM lazy_trace_nodes WHERE family IS NOT NULL
    GROUP BY family HAVING count(*) >= 0.04::DOUBLE * (SELECT count(*) FROM lazy_trace_nodes)""")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for table, key in (("search_examples", "root_id"), ("lazy_trace_nodes", "family")):
        heavy = heavy_keys(load(spark, sf_dir, table), key, 0.04)
        parts.append(heavy.select(F.lit(f"{table}.{key}").alias("field"), F.col("key").alias("key_value")))
    return parts[0].unionByName(parts[1])


def _valid_calls():
    calls = F.col("proof_calls")
    return F.when(~F.isnan(calls) & (calls >= 0) & (calls < float("inf")), calls)


@R.add("p1_examples_by_root", f"""
    WITH once AS (
      SELECT {sql_hex('root_id', 16)} AS root, example_id, branch_id, count(*) AS n, max(CASE WHEN depth >= 0 THEN depth END) AS depth,
             max(CASE WHEN NOT isnan(proof_calls) AND proof_calls >= 0 AND proof_calls < 'inf'::DOUBLE THEN proof_calls END) AS calls
      FROM search_examples GROUP BY ALL)
    SELECT root, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS records, max(depth) AS deepest, CAST(sum(CAST(calls AS DECIMAL(20,3))) AS DECIMAL(30,3)) AS proof_calls
    FROM once GROUP BY root""")
def p1_examples_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per root (one spelling): rows, distinct records, deepest recorded level (negative ones ignored), proof calls."""
    df = load(spark, sf_dir, "search_examples")
    out = keyed_states(df, hex_key(F.col("root_id"), 16), [F.col("example_id"), F.col("branch_id")],
                       maxima={"deepest": F.expr("CASE WHEN depth >= 0 THEN depth END")},
                       sums={"proof_calls": _valid_calls().cast("decimal(20,3)")})
    return out.select(F.col("key").alias("root"), F.col("rows").alias("n_rows"), "records", "deepest", F.col("proof_calls").cast("decimal(30,3)").alias("proof_calls"))


@R.add("p1_nodes_by_family", f"""
    WITH once AS (
      SELECT {sql_name('family')} AS family, node_id, count(*) AS n, max(CASE WHEN depth >= 0 THEN depth END) AS depth, max(decision_confidence) AS confidence
      FROM lazy_trace_nodes GROUP BY ALL)
    SELECT family, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS records, max(depth) AS deepest, round(avg(confidence), 9) AS confidence
    FROM once GROUP BY family""")
def p1_nodes_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "lazy_trace_nodes")
    out = keyed_states(df, name_key(F.col("family")), [F.col("node_id")],
                       maxima={"deepest": F.expr("CASE WHEN depth >= 0 THEN depth END")}, means={"confidence": F.col("decision_confidence")})
    return out.select(F.col("key").alias("family"), F.col("rows").alias("n_rows"), "records", "deepest", F.round("confidence", 9).alias("confidence"))


# ---- 4: nested records


def _evidence_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "device_evidence").select("evidence_id", F.expr(whole("payload")).alias("v"))
    return df.selectExpr("evidence_id", "coalesce(try_variant_get(v, '$.evidence.obligations', 'variant'), try_variant_get(v, '$.obligations', 'variant')) AS top")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obligations with those nested under ``refines``, whatever the layout of the payload."""
    return variant_tree(_evidence_top(spark, sf_dir), "evidence_id", "top", "id", again="refines", keyed=True)


def _frontiers_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "trace_trees").select("tree_id", F.expr(whole("frontiers")).alias("v0"))
    # the text may itself be an encoded text, and the frontiers may be wrapped with their count
    df = df.selectExpr("tree_id", f"CASE WHEN try_variant_get(v0, '$', 'array<variant>') IS NULL AND try_variant_get(v0, '$', 'map<string,variant>') IS NULL THEN {whole("try_variant_get(v0, '$', 'string')")} ELSE v0 END AS v")
    return df.selectExpr("tree_id", "coalesce(try_variant_get(v, '$.frontiers', 'variant'), v) AS top")


def _frontiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_tree(_frontiers_top(spark, sf_dir), "tree_id", "top", "frontier_id")


@R.add("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over each table: all kinds of a record in one array, one ``inline``."""
    parts = {
        "projection_graphs": array_links(load(spark, sf_dir, "projection_graphs"), "graph_hash", [("node", [("nodes", "id")]), ("edge", [("edges", "id")]), ("tile", [("edges", "id"), ("consumer_tiles", "tile_id")])]),
        "device_evidence": variant_links(_evidence_top(spark, sf_dir), "evidence_id", "top", "obligation", "id", [("witness", "obligation", "witnesses", "witness_id")], again="refines", keyed=True),
        "trace_trees": variant_links(_frontiers_top(spark, sf_dir), "tree_id", "top", "frontier", "frontier_id", [("option", "frontier", "options", "action_id"), ("delta_edge", "option", "delta.added", "edge_id")]),
    }
    out = None
    for table, rows in parts.items():
        part = rows.where("record_key IS NOT NULL").select(F.lit(table).alias("table_name"), "record_key", "child_kind", "parent_key", "child_key")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


@R.add("p4_nodes", """
    SELECT graph_hash AS record_key, CAST(i - 1 AS VARCHAR) AS position, n.id AS child_key, n.kind AS kind, n.attrs['cost'] AS cost, n.attrs['tile'] AS tile
    FROM (SELECT DISTINCT graph_hash, i, nodes[i] AS n FROM projection_graphs, unnest(generate_series(1, len(nodes))) AS u(i)) WHERE n IS NOT NULL""")
def p4_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = array_rows(load(spark, sf_dir, "projection_graphs"), "graph_hash", [("nodes", "id")], {"kind": "x.kind", "cost": "x.attrs['cost']", "tile": "x.attrs['tile']"})
    return rows.drop("parent_key").distinct()


@R.add("p4_edges", """
    SELECT graph_hash AS record_key, CAST(i - 1 AS VARCHAR) AS position, e.id AS child_key, e.src AS src, e.dst AS dst, array_to_string(e.shape, 'x') AS shape,
           e.element_type AS element_type, e.layout AS layout, e.role AS role, e.logical_bytes AS logical_bytes, coalesce(len(e.consumer_tiles), 0) AS tiles
    FROM (SELECT DISTINCT graph_hash, i, edges[i] AS e FROM projection_graphs, unnest(generate_series(1, len(edges))) AS u(i)) WHERE e IS NOT NULL""")
def p4_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"src": "x.src", "dst": "x.dst", "shape": "array_join(x.shape, 'x')", "element_type": "x.element_type", "layout": "x.layout",
              "role": "x.role", "logical_bytes": "x.logical_bytes", "tiles": "CAST(coalesce(size(x.consumer_tiles), 0) AS BIGINT)"}
    return array_rows(load(spark, sf_dir, "projection_graphs"), "graph_hash", [("edges", "id")], fields).drop("parent_key").distinct()


@R.add("p4_obligations")
def p4_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = {a: f"try_variant_get(o, '$.{p}', 'string')" for a, p in (("category", "category"), ("status", "status"), ("scope", "scope"), ("fact_limit", "binding.facts.limit"), ("lane", "binding.facts.lane"))}
    return _evidence(spark, sf_dir).selectExpr("record_key", "parent_key", "level", "position", "child_key", *[f"{e} AS {a}" for a, e in text.items()]).distinct()


@R.add("p4_frontiers")
def p4_frontiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frontiers(spark, sf_dir).selectExpr(
        "record_key", "position", "child_key", "coalesce(try_variant_get(o, '$.state_id', 'string'), nullif(k, 'null')) AS state_id", "try_variant_get(o, '$.depth', 'int') AS depth",
        "size(coalesce(try_variant_get(o, '$.options', 'array<variant>'), array())) AS options").distinct()


# ---- 5: hierarchies

_KINDS = (("node", "lazy_trace_nodes", "node_id", "parent_id"), ("branch", "search_examples", "branch_id", "parent_branch_id"))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables as one forest: the kind is the first letter of the key, so no link crosses kinds."""
    parts = [load(spark, sf_dir, t).where(F.col(k).isNotNull()).select(F.concat(F.lit(kind[0]), k).alias("v"), F.concat(F.lit(kind[0]), present(F.col(p))).alias("p")) for kind, t, k, p in _KINDS]
    return parts[0].unionByName(parts[1])


_KIND_OF = "CASE WHEN left(node, 1) = 'n' THEN 'node' ELSE 'branch' END AS record_kind"


_FOREST_SQL = f"""links AS (SELECT DISTINCT 'node' AS record_kind, node_id AS v, {sql_present('parent_id')} AS p FROM lazy_trace_nodes WHERE node_id IS NOT NULL
      UNION ALL SELECT DISTINCT 'branch', branch_id, {sql_present('parent_branch_id')} FROM search_examples WHERE branch_id IS NOT NULL),
    tree AS (SELECT record_kind, v, v AS root, 0 AS depth FROM links l WHERE p IS NULL OR NOT EXISTS (SELECT 1 FROM links x WHERE x.record_kind = l.record_kind AND x.v = l.p)
      UNION ALL SELECT l.record_kind, l.v, tree.root, tree.depth + 1 FROM tree JOIN links l ON l.record_kind = tree.record_kind AND l.p = tree.v),
    rest AS (SELECT * FROM links l WHERE NOT EXISTS (SELECT 1 FROM tree WHERE tree.record_kind = l.record_kind AND tree.v = l.v)),
    up AS (SELECT record_kind, v AS start, p AS cur FROM rest UNION SELECT up.record_kind, up.start, r.p FROM up JOIN rest r ON r.record_kind = up.record_kind AND r.v = up.cur),
    loops AS (SELECT record_kind, start AS v FROM up WHERE start = cur),
    found AS (SELECT record_kind, v AS node_key, root AS root_key, depth FROM tree UNION ALL
      SELECT up.record_kind, up.start, min(up.cur), -1 FROM up JOIN loops ON loops.record_kind = up.record_kind AND loops.v = up.cur GROUP BY up.record_kind, up.start)"""


@R.add("p5_found", f"WITH RECURSIVE {_FOREST_SQL} SELECT record_kind, node_key, root_key, depth FROM found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hierarchy(_linked(spark, sf_dir), "v", "p")
    return rows.selectExpr(_KIND_OF, "substr(node, 2) AS node_key", "substr(root, 2) AS root_key", "depth")


@R.add("p5_hierarchy", f"""WITH RECURSIVE {_FOREST_SQL},
    pt AS (SELECT record_kind, v, [left(record_kind, 1) || v] AS way FROM links l WHERE p IS NULL OR NOT EXISTS (SELECT 1 FROM links x WHERE x.record_kind = l.record_kind AND x.v = l.p)
      UNION ALL SELECT l.record_kind, l.v, list_append(pt.way, left(l.record_kind, 1) || l.v) FROM pt JOIN links l ON l.record_kind = pt.record_kind AND l.p = pt.v),
    o AS (SELECT *, row_number() OVER (ORDER BY way) - 1 AS first FROM pt), n AS (SELECT a, count(*) - 1 AS below FROM (SELECT unnest(way) AS a FROM pt) GROUP BY a)
    SELECT f.record_kind, f.node_key, f.root_key, f.depth, n.below AS descendants, o.first, o.first + n.below AS last, array_to_string(list_transform(o.way, lambda x: substr(x, 2)), '/') AS path
    FROM found f LEFT JOIN o ON o.record_kind = f.record_kind AND o.v = f.node_key LEFT JOIN n ON n.a = left(f.record_kind, 1) || f.node_key""")
def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root, number of descendants and nested-set range of every record."""
    rows = hierarchy(_linked(spark, sf_dir), "v", "p", paths=True)
    return rows.selectExpr(_KIND_OF, "substr(node, 2) AS node_key", "substr(root, 2) AS root_key", "depth", "descendants", "`first`", "`last`", "array_join(transform(path, x -> substr(x, 2)), '/') AS path")


@R.add("p5_loops", f"WITH RECURSIVE {_FOREST_SQL} SELECT record_kind, node_key, root_key AS loop_key FROM found WHERE depth = -1")
def p5_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records caught in loops or below them, with the loop's smallest key."""
    return p5_found(spark, sf_dir).where("depth = -1").select("record_kind", "node_key", F.col("root_key").alias("loop_key"))


def _hundredth(key: str) -> str:
    """SQL for both engines' keys: the last eight hex digits, read as a number, are divisible by 100."""
    return f"right({key}, 8)"


@R.add("p5_descendants", f"""WITH RECURSIVE {_FOREST_SQL},
    below AS (SELECT f.record_kind, f.node_key AS ancestor, f.node_key AS node, 0 AS steps FROM found f WHERE f.depth >= 0 AND regexp_matches({_hundredth('f.node_key')}, '^[0-9a-f]{{8}}$')
        AND CAST('0x' || {_hundredth('f.node_key')} AS BIGINT) % 100 = 0
      UNION ALL SELECT below.record_kind, below.ancestor, l.v, below.steps + 1 FROM below JOIN links l ON l.record_kind = below.record_kind AND l.p = below.node)
    SELECT record_kind, ancestor, node, steps FROM below WHERE steps > 0""")
def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants, with the steps to them, of every record whose key (its last eight hex digits) is divisible by 100."""
    tmp = Scratch(spark)
    tree = tmp.keep(hierarchy(_linked(spark, sf_dir), "v", "p", scratch=tmp).select("node", "first", "last", "depth", "descendants"))
    wanted = tree.where(F.expr("right(node, 8) rlike '^[0-9a-f]{8}$'")).where(F.expr("CAST(conv(right(node, 8), 16, 10) AS BIGINT) % 100 = 0"))
    rows = descendants(tree, wanted.select("node"))
    return rows.selectExpr(_KIND_OF, "substr(ancestor, 2) AS ancestor", "substr(node, 2) AS node", "steps")
