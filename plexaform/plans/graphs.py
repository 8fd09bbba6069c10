"""Queries of the graph family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cleaning import name_key, present, trimmed
from ..operators import graph as g
from ..operators.hierarchy import hierarchy, subtree_totals
from ..session import Scratch, load
from .core_problems import sql_name, sql_present
from .registry import Registry

R = Registry()


def _sql_node(expr: str) -> str:
    return f"CAST('0x' || substr(md5(graph_hash || ':' || {expr}), 1, 12) AS BIGINT)"


def _node(col: Column) -> Column:
    """A number for a node, whose id is unique only inside its graph."""
    return F.conv(F.substring(F.md5(F.concat(F.col("graph_hash"), F.lit(":"), col)), 1, 12), 16, 10).cast("bigint")


#: the edges of all projection graphs, with cycles and self-edges
_RAW = "SELECT graph_hash, e.src AS src, e.dst AS dst, e.role AS role FROM (SELECT graph_hash, unnest(edges) AS e FROM projection_graphs) WHERE e.src IS NOT NULL AND e.dst IS NOT NULL"
CALLS_SQL = f"SELECT DISTINCT {_sql_node('src')} AS s, {_sql_node('dst')} AS d FROM ({_RAW})"
_E = f"e AS ({CALLS_SQL})"
#: the same edges, each from its lesser to its greater node: an acyclic graph
_D = f"d AS (SELECT DISTINCT least(s, d) AS s, greatest(s, d) AS d FROM (SELECT {_sql_node('src')} AS s, {_sql_node('dst')} AS d FROM ({_RAW})) WHERE s <> d)"


def _edges(spark, sf_dir) -> DataFrame:
    """graph_hash, src, dst, role of every edge with both ends."""
    g_ = load(spark, sf_dir, "projection_graphs").select("graph_hash", F.explode("edges").alias("e"))
    return g_.where("e.src is not null and e.dst is not null").select("graph_hash", "e.src", "e.dst", "e.role")


def _calls(spark, sf_dir) -> DataFrame:
    return _edges(spark, sf_dir).select(_node(F.col("src")).alias("s"), _node(F.col("dst")).alias("d")).distinct()


def _dag(spark, sf_dir) -> DataFrame:
    return _calls(spark, sf_dir).where("s <> d").select(F.least("s", "d").alias("s"), F.greatest("s", "d").alias("d")).distinct()


def _links(spark, sf_dir) -> DataFrame:
    """A small acyclic graph of nations, for routes."""
    n = load(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS k", "CAST(n_regionkey AS BIGINT) AS r")
    return n.selectExpr("k AS s", "k + 1 + r AS d").unionByName(n.where("k > 0").selectExpr("k AS s", "k * 2 AS d")).where("d < 25").distinct()


_LINKS = "d AS (SELECT CAST(n_nationkey AS BIGINT) AS s, CAST(n_nationkey + 1 + n_regionkey AS BIGINT) AS d FROM nation WHERE n_nationkey + 1 + n_regionkey < 25 UNION SELECT n_nationkey, n_nationkey * 2 FROM nation WHERE n_nationkey * 2 < 25 AND n_nationkey > 0)"

_CLOSE = "RECURSIVE c AS (SELECT s AS a, d AS b FROM e UNION SELECT c.a, e.d FROM c JOIN e ON c.b = e.s)"
_COMP = "m AS (SELECT n.v, least(n.v, coalesce(min(x.b), n.v)) AS component FROM (SELECT s AS v FROM e UNION SELECT d FROM e) n LEFT JOIN (SELECT c.a, c.b FROM c JOIN c r ON c.a = r.b AND c.b = r.a) x ON n.v = x.a GROUP BY n.v)"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(p.replace("RECURSIVE ", "") for p in parts) + " "


@R.add("graph12_closure", _with(_E, _CLOSE) + "SELECT a, b FROM c")
def graph12_closure(spark, sf_dir):
    return g.transitive_closure(_calls(spark, sf_dir), "s", "d")


@R.add("graph01_strong_components", _with(_E, _CLOSE, _COMP) + "SELECT v, component FROM m")
def graph01_strong_components(spark, sf_dir):
    return g.strong_components(_calls(spark, sf_dir), "s", "d")


@R.add("graph02_largest_component", _with(_E, _CLOSE, _COMP) + "SELECT max(n) AS largest FROM (SELECT count(*) AS n FROM m GROUP BY component)")
def graph02_largest_component(spark, sf_dir):
    return g.strong_components(_calls(spark, sf_dir), "s", "d").groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"))


@R.add("graph04_recursive_components", _with(_E, _CLOSE, _COMP) + "SELECT component, count(*) AS size FROM m GROUP BY component HAVING count(*) > 1 OR bool_or(v IN (SELECT s FROM e WHERE s = d))")
def graph04_recursive_components(spark, sf_dir):
    return g.recursive_components(_calls(spark, sf_dir), "s", "d")


@R.add("graph03_effect_closure", _with(_E, _CLOSE) + "SELECT DISTINCT n, e FROM (SELECT s AS n, s % 4 AS e FROM e UNION SELECT c.a, x.s % 4 FROM c JOIN e x ON c.b = x.s)")
def graph03_effect_closure(spark, sf_dir):
    e = _calls(spark, sf_dir)
    return g.effect_closure(e.selectExpr("s AS n", "s % 4 AS e"), "n", "e", e, "s", "d")


@R.add("graph05_boundary_status", f"WITH {_E} SELECT s AS v, CASE WHEN bool_or(d NOT IN (SELECT s FROM e WHERE s % 7 <> 4)) THEN 'partial' ELSE 'closed' END AS status FROM e GROUP BY s")
def graph05_boundary_status(spark, sf_dir):
    e = _calls(spark, sf_dir)
    known = e.where("s % 7 <> 4").select(F.col("s").alias("k")).distinct()
    j = e.join(known, F.col("d") == F.col("k"), "left")
    return j.groupBy(F.col("s").alias("v")).agg(F.when(F.bool_or(F.col("k").isNull()), "partial").otherwise("closed").alias("status"))


@R.add("graph06_bounded_slice", _with(_E) + """, o AS (SELECT v, min(k) AS k FROM (WITH RECURSIVE t AS (SELECT DISTINCT s AS v, 0 AS k FROM e WHERE s % 10 = 0 UNION SELECT e.d, t.k + 1 FROM t JOIN e ON t.v = e.s WHERE t.k < 3) SELECT * FROM t) GROUP BY v),
    i AS (SELECT v, min(k) AS k FROM (WITH RECURSIVE t AS (SELECT DISTINCT s AS v, 0 AS k FROM e WHERE s % 10 = 0 UNION SELECT e.s, t.k + 1 FROM t JOIN e ON t.v = e.d WHERE t.k < 3) SELECT * FROM t) GROUP BY v),
    u AS (SELECT v, k AS depth, 'out' AS direction FROM o UNION ALL SELECT v, k, 'in' FROM i) SELECT v, depth, direction, row_number() OVER (PARTITION BY direction ORDER BY depth, v) <= 6 AS kept FROM u""")
def graph06_bounded_slice(spark, sf_dir):
    e = _calls(spark, sf_dir)
    return g.bounded_slice(e, "s", "d", e.where("s % 10 = 0"), "s", 3, 6)


@R.add("graph07_ownership", f"""WITH x AS ({_RAW}), n AS (SELECT DISTINCT graph_hash, n.id AS id FROM (SELECT graph_hash, unnest(nodes) AS n FROM projection_graphs) WHERE n.id IS NOT NULL)
    SELECT DISTINCT x.graph_hash, src AS owner, dst AS resource, CASE role WHEN 'residual' THEN 'writes' WHEN 'weight' THEN 'reads' ELSE 'passes' END AS relation, n.id IS NULL AS leak FROM x LEFT JOIN n ON n.graph_hash = x.graph_hash AND n.id = x.dst""")
def graph07_ownership(spark, sf_dir):
    """Effects as typed edges from owner to resource; a resource that is no node of its graph leaks out of it."""
    n = load(spark, sf_dir, "projection_graphs").select(F.col("graph_hash").alias("g"), F.explode("nodes").alias("n")).where("n.id is not null").select("g", F.col("n.id").alias("id")).distinct()
    e = _edges(spark, sf_dir).distinct()
    relation = F.when(F.col("role") == "residual", "writes").when(F.col("role") == "weight", "reads").otherwise("passes")
    return e.join(n, (F.col("graph_hash") == F.col("g")) & (F.col("dst") == F.col("id")), "left").select("graph_hash", F.col("src").alias("owner"), F.col("dst").alias("resource"), relation.alias("relation"), F.col("id").isNull().alias("leak")).distinct()


_LEVEL = "l AS (SELECT v, max(k) AS level FROM (SELECT v, 0 AS k FROM (SELECT s AS v FROM d UNION SELECT d FROM d) UNION ALL SELECT v, k FROM t) GROUP BY v)"
_WALK = "t AS (SELECT d AS v, 1 AS k FROM d UNION SELECT d.d, t.k + 1 FROM t JOIN d ON t.v = d.s)"


@R.add("graph08_topological_levels", _with(_D, _WALK, _LEVEL) + "SELECT v, level FROM l")
def graph08_topological_levels(spark, sf_dir):
    return g.topological_levels(_dag(spark, sf_dir), "s", "d")


@R.add("graph08_cyclic_levels", _with(_E, _CLOSE) + "SELECT DISTINCT v, NULL::INTEGER AS level FROM (SELECT a AS v FROM c WHERE a = b UNION SELECT x.b FROM c x JOIN c y ON x.a = y.a AND y.a = y.b)")
def graph08_cyclic_levels(spark, sf_dir):
    """Of the call graph only the part on and behind cycles: it has no level."""
    return g.topological_levels(_calls(spark, sf_dir), "s", "d").where("level is null")


@R.add("graph09_live_bytes", _with(_D, _WALK, _LEVEL) + ", x AS (SELECT a.level AS f, b.level AS t, d.s % 1000 * 10 + 1 AS bytes FROM d JOIN l a ON a.v = d.s JOIN l b ON b.v = d.d) SELECT stage, CAST(sum(bytes) AS BIGINT) AS live FROM (SELECT unnest(generate_series(f, t)) AS stage, bytes FROM x) GROUP BY stage")
def graph09_live_bytes(spark, sf_dir):
    e = _dag(spark, sf_dir)
    l = g.topological_levels(e, "s", "d")
    a, b = l.select(F.col("v").alias("va"), F.col("level").alias("f")), l.select(F.col("v").alias("vb"), F.col("level").alias("t"))
    x = e.join(a, F.col("s") == F.col("va")).join(b, F.col("d") == F.col("vb"))
    return x.select(F.explode(F.sequence(F.col("f").cast("bigint"), F.col("t").cast("bigint"))).alias("stage"), (F.col("s") % 1000 * 10 + 1).alias("bytes")).groupBy("stage").agg(F.sum("bytes").alias("live"))


@R.add("graph10_critical_path", _with(_D, "n AS (SELECT v, CASE WHEN v % 4 = 0 THEN 1.0::DOUBLE ELSE CAST(v % 4 AS DOUBLE) END AS w FROM (SELECT s AS v FROM d UNION SELECT d FROM d))", "t AS (SELECT v, w AS c FROM n UNION SELECT d.d, t.c + n.w FROM t JOIN d ON t.v = d.s JOIN n ON n.v = d.d)") + "SELECT v, max(c) AS cost FROM t GROUP BY v")
def graph10_critical_path(spark, sf_dir):
    e = _dag(spark, sf_dir)
    w = e.select(F.explode(F.array("s", "d")).alias("v")).distinct().withColumn("w", F.col("v") % 4)
    return g.critical_path(e, "s", "d", w, "v", "w")


@R.add("graph11_fusion_regions", _with(_E, "f AS (SELECT s, d FROM e WHERE s % 5 <> 0 AND d % 5 <> 0)", "u AS (SELECT s, d FROM f UNION SELECT d, s FROM f)", "c AS (SELECT s AS a, s AS b FROM u UNION SELECT c.a, u.d FROM c JOIN u ON c.b = u.s)") + "SELECT CAST(a AS VARCHAR) AS v, min(CAST(b AS VARCHAR)) AS component FROM c GROUP BY a")
def graph11_fusion_regions(spark, sf_dir):
    e = _calls(spark, sf_dir)
    barriers = e.select(F.explode(F.array("s", "d")).alias("v")).where("v % 5 = 0")
    return g.fusion_regions(e, "s", "d", barriers, "v")


@R.add("graph13_routes", _with(_LINKS, "t AS (SELECT [s, d] AS path, CAST(s + d AS DOUBLE) AS latency, CAST(100 - d AS DOUBLE) AS bandwidth FROM d WHERE s = 1 UNION ALL SELECT list_append(t.path, d.d), t.latency + d.s + d.d, least(t.bandwidth, 100 - d.d) FROM t JOIN d ON t.path[-1] = d.s WHERE NOT list_contains(t.path, d.d) AND len(t.path) < 6 AND t.path[-1] <> 12)") + "SELECT array_to_string(path, '>') AS path, latency, bandwidth, CAST(len(path) - 1 AS INTEGER) AS hops FROM t WHERE path[-1] = 12")
def graph13_routes(spark, sf_dir):
    links = _links(spark, sf_dir).select(F.col("s").alias("from"), F.col("d").alias("to"), (F.col("s") + F.col("d")).alias("latency"), (100 - F.col("d")).alias("bandwidth"))
    return g.routes(links, 1, 12).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "latency", "bandwidth", "hops")


@R.add("rank16_best_route", _with(_LINKS, "t AS (SELECT [s, d] AS path, CAST(s + d AS DOUBLE) AS latency FROM d WHERE s = 1 UNION ALL SELECT list_append(t.path, d.d), t.latency + d.s + d.d FROM t JOIN d ON t.path[-1] = d.s WHERE NOT list_contains(t.path, d.d) AND len(t.path) < 6 AND t.path[-1] <> 12)") + "SELECT array_to_string(path, '>') AS path, latency FROM t WHERE path[-1] = 12 ORDER BY latency, len(path), array_to_string(path, '>') LIMIT 3")
def rank16_best_route(spark, sf_dir):
    return graph13_routes(spark, sf_dir).orderBy("latency", "hops", "path").limit(3).select("path", "latency")


@R.add("graph14_unreachable_states", _with(_E, "t AS (SELECT DISTINCT s AS v FROM e WHERE s % 3 = 0 UNION SELECT e.d FROM t JOIN e ON t.v = e.s)") + "SELECT v FROM (SELECT s AS v FROM e UNION SELECT d FROM e) WHERE v NOT IN (SELECT v FROM t)")
def graph14_unreachable_states(spark, sf_dir):
    """States of all machines that no initial state reaches, at any depth."""
    e = _calls(spark, sf_dir)
    every = e.select(F.explode(F.array("s", "d")).alias("v")).distinct()
    reach = g.reachable(e, "s", "d", e.where("s % 3 = 0"), "s").select(F.col("v").alias("r"))
    return every.join(reach, F.col("v") == F.col("r"), "left_anti")


@R.add("graph15_protocol_rules", _with(_E, _CLOSE) + "SELECT 'happens-before cycle' AS rule, count(*) AS violations FROM c WHERE a = b UNION ALL SELECT 'use after terminal', count(*) FROM e WHERE s % 6 = 5")
def graph15_protocol_rules(spark, sf_dir):
    """Nodes on a cycle are those of recursive components."""
    e = _calls(spark, sf_dir)
    cyc = g.recursive_components(e, "s", "d").agg(F.lit("happens-before cycle").alias("rule"), F.coalesce(F.sum("size"), F.lit(0)).alias("violations"))
    return cyc.unionByName(e.agg(F.lit("use after terminal").alias("rule"), F.count_if(F.col("s") % 6 == 5).alias("violations")))


@R.add("graph16_unordered_hazards", _with(_D, "c AS (SELECT s AS a, d AS b FROM d UNION SELECT c.a, d.d FROM c JOIN d ON c.b = d.s)", "x AS (SELECT s AS op, d AS r, s % 2 = 0 AS w FROM d)") + "SELECT DISTINCT p.op AS earlier, q.op AS later FROM x p JOIN x q ON p.r = q.r AND p.op < q.op AND (p.w OR q.w) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.a = p.op AND c.b = q.op)")
def graph16_unordered_hazards(spark, sf_dir):
    """Hazards (two operations on one node, one of them writing) that no chain of dependencies orders."""
    from ..operators.relations import hazards
    d = _dag(spark, sf_dir)
    c = g.transitive_closure(d, "s", "d")
    h = hazards(d.selectExpr("s AS op", "s AS ord", "d AS r", "s % 2 = 0 AS w"), "op", "ord", "r", "w").select("earlier", "later").distinct()
    return h.join(c, (F.col("earlier") == F.col("a")) & (F.col("later") == F.col("b")), "left_anti")


_DOWN = "c AS (SELECT s AS a, d AS b FROM d UNION SELECT c.a, d.d FROM c JOIN d ON c.b = d.s)"


@R.add("graph17_containment", _with(_D, _DOWN) + "SELECT a AS outer_scope, count(*) AS contained FROM c GROUP BY a")
def graph17_containment(spark, sf_dir):
    return g.transitive_closure(_dag(spark, sf_dir), "s", "d").groupBy(F.col("a").alias("outer_scope")).agg(F.count(F.lit(1)).alias("contained"))


@R.add("graph18_broadest_scope", _with(_D, _DOWN, "n AS (SELECT a, count(*) AS n FROM c GROUP BY a)") + "SELECT b AS item, arg_min(c.a, (-n.n, c.a)) AS broadest FROM c JOIN n ON n.a = c.a GROUP BY b")
def graph18_broadest_scope(spark, sf_dir):
    """Of the scopes that contain an item the one that contains most; ties go to the smaller key."""
    c = g.transitive_closure(_dag(spark, sf_dir), "s", "d")
    n = c.groupBy(F.col("a").alias("scope")).agg(F.count(F.lit(1)).alias("n"))
    return c.join(n, F.col("a") == F.col("scope")).groupBy(F.col("b").alias("item")).agg(F.min_by("a", F.struct(-F.col("n"), F.col("a"))).alias("broadest"))


def _wl_sql(rounds: int, both: bool) -> str:
    out = [_E, "w0 AS (SELECT v, sha256(CAST(v % 3 AS VARCHAR)) AS c FROM (SELECT s AS v FROM e UNION SELECT d FROM e))"]
    for k in range(rounds):
        parts = f"SELECT e.d AS t, '<' || 'r' || w.c AS x FROM e JOIN w{k} w ON w.v = e.s" + (f" UNION ALL SELECT e.s, '>' || 'r' || w.c FROM e JOIN w{k} w ON w.v = e.d" if both else "")
        out.append(f"g{k} AS (SELECT t, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT t, x || '*' || count(*) AS x FROM ({parts}) GROUP BY t, p.x) GROUP BY t)".replace("p.x", "x").replace("SELECT t, x || '*'", "SELECT t, q.x || '*'").replace(f"FROM ({parts}) GROUP BY t, x)", f"FROM ({parts}) q GROUP BY q.t, q.x)"))
        out.append(f"w{k + 1} AS (SELECT w{k}.v, sha256(w{k}.c || '|' || coalesce(g{k}.x, '')) AS c FROM w{k} LEFT JOIN g{k} ON w{k}.v = g{k}.t)")
    return "WITH " + ", ".join(out) + f" SELECT v, c AS label FROM w{rounds}"


def _wl(spark, sf_dir, rounds, both):
    e = _calls(spark, sf_dir).withColumn("r", F.lit("r"))
    nodes = e.select(F.explode(F.array("s", "d")).alias("v")).distinct().withColumn("l", F.col("v") % 3)
    return g.wl_labels(nodes, "v", "l", e, "s", "d", "r", rounds, both)


@R.add("graph19_wl_incoming", _wl_sql(3, False))
def graph19_wl_incoming(spark, sf_dir):
    return _wl(spark, sf_dir, 3, False)


@R.add("graph20_wl_both_ways", _wl_sql(2, True))
def graph20_wl_both_ways(spark, sf_dir):
    return _wl(spark, sf_dir, 2, True)


@R.add("graph21_layered_digest", "SELECT sha256(sha256(string_agg(sha256(layer), ',' ORDER BY r))) AS digest, count(*) AS n FROM (SELECT n_regionkey AS r, sha256(string_agg(n_name, ',' ORDER BY n_name)) AS layer FROM nation GROUP BY 1)")
def graph21_layered_digest(spark, sf_dir):
    """Digest per layer (region), then of the layers: the same however the rows are stored."""
    n = load(spark, sf_dir, "nation")
    layers = n.groupBy("n_regionkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("n_name")), ","), 256).alias("layer"))
    return g.ordered_digest(layers, ["n_regionkey"], [F.col("layer")])


@R.add("graph22_dependency_order", _with(_D, _WALK, _LEVEL) + "SELECT v, CAST(row_number() OVER (ORDER BY level, v) AS INTEGER) AS place FROM l")
def graph22_dependency_order(spark, sf_dir):
    l = g.topological_levels(_dag(spark, sf_dir), "s", "d")
    from ..operators.sequences import global_index
    return global_index(l, ["level", "v"], "i").select("v", (F.col("i") + 1).cast("int").alias("place"))


@R.add("graph23_degree_tokens", f"WITH {_E} SELECT s AS v, least(count(*), 8) AS degree FROM e GROUP BY s")
def graph23_degree_tokens(spark, sf_dir):
    return _calls(spark, sf_dir).groupBy(F.col("s").alias("v")).agg(F.least(F.count(F.lit(1)), F.lit(8)).alias("degree"))


_BRANCHES = f"""x AS (SELECT branch_id AS v, min({sql_present('parent_branch_id')}) AS p, max((list_has_any(outcomes, ['faster', 'proved']) AND NOT list_contains(outcomes, 'refuted'))::INTEGER) AS direct,
      max((coverage.children_status = 'exhaustive' OR coverage.children_status = 'not_applicable')::INTEGER) AS listed, max(coverage.expected_child_count) AS expected, max(baseline::INTEGER) AS base, max((branch_state = 'pruned' AND quality_grade = 'A')::INTEGER) AS sound,
      max(CASE WHEN list_contains(outcomes, 'faster') THEN 3 WHEN list_contains(outcomes, 'proved') THEN 2 WHEN list_contains(outcomes, 'identical') THEN 1 ELSE 0 END) AS tier, max(CASE WHEN NOT isnan(proof_calls) AND proof_calls >= 0 AND proof_calls < 'inf'::DOUBLE THEN CAST(proof_calls AS DECIMAL(20,3)) END) AS cost
      FROM search_examples WHERE branch_id IS NOT NULL GROUP BY branch_id),
    k AS (SELECT p AS kp, count(*) AS children FROM x WHERE p IS NOT NULL GROUP BY p), y AS (SELECT x.*, coalesce(children, 0) AS children, coalesce(sound, 0) = 1 OR (coalesce(listed, 0) = 1 AND coalesce(expected, 0) = coalesce(children, 0)) AS complete FROM x LEFT JOIN k ON kp = v),
    t AS (SELECT v, 0 AS depth FROM y WHERE p IS NULL OR p NOT IN (SELECT v FROM y) UNION ALL SELECT y.v, t.depth + 1 FROM t JOIN y ON y.p = t.v),
    up AS (SELECT v AS a, v AS d, 0 AS steps FROM t UNION ALL SELECT y.p, up.d, up.steps + 1 FROM up JOIN y ON y.v = up.a JOIN t ON t.v = y.p)"""


def _branches(spark, sf_dir) -> DataFrame:
    """One row per branch of the searches: v, p, direct, listed, expected, base, sound, tier, cost, children, complete."""
    e = load(spark, sf_dir, "search_examples").where("branch_id is not null")
    out, calls = F.col("outcomes"), F.col("proof_calls")
    has = lambda x: F.array_contains(out, x)
    flag = lambda c: F.max(c.cast("int"))
    status = F.col("coverage.children_status")
    x = e.groupBy(F.col("branch_id").alias("v")).agg(
        F.min(present(F.col("parent_branch_id"))).alias("p"), flag((has("faster") | has("proved")) & ~has("refuted")).alias("direct"), flag(status.isin("exhaustive", "not_applicable")).alias("listed"), F.max("coverage.expected_child_count").alias("expected"), flag(F.col("baseline")).alias("base"),
        flag((F.col("branch_state") == "pruned") & (F.col("quality_grade") == "A")).alias("sound"), F.max(F.when(has("faster"), 3).when(has("proved"), 2).when(has("identical"), 1).otherwise(0)).alias("tier"),
        F.max(F.when(~F.isnan(calls) & (calls >= 0) & (calls < float("inf")), calls.cast("decimal(20,3)"))).alias("cost"))
    k = x.where("p is not null").groupBy(F.col("p").alias("kp")).agg(F.count(F.lit(1)).alias("children"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    x = x.join(k, F.col("v") == F.col("kp"), "left").withColumn("children", zero("children"))
    return x.withColumn("complete", (zero("sound") == 1) | ((zero("listed") == 1) & (zero("expected") == F.col("children"))))


@R.add("graph24_survival_labels", f"""WITH RECURSIVE {_BRANCHES}, s AS (SELECT a, CAST(sum(coalesce(direct, 0)) AS BIGINT) AS positive, CAST(sum((NOT complete)::INTEGER) AS BIGINT) AS gaps FROM up JOIN y ON y.v = up.d GROUP BY a)
    SELECT a AS branch, positive, CASE WHEN positive > 0 THEN true WHEN gaps = 0 THEN false END AS useful, CASE WHEN coalesce(base, 0) = 1 OR positive > 0 THEN 'KEEP' WHEN coalesce(sound, 0) = 1 THEN 'BLOCKED_BY_CONTRACT' WHEN gaps = 0 THEN 'PRUNE_HIGH_CONFIDENCE' ELSE 'KEEP_UNCERTAIN' END AS class FROM s JOIN y ON y.v = s.a""")
def graph24_survival_labels(spark, sf_dir):
    """Bottom-up over trees of any depth: useful if anything below is, not useful if all below is known, else unknown."""
    x = Scratch(spark).keep(_branches(spark, sf_dir))
    totals = subtree_totals(x, "v", "p", {"positive": F.col("direct").cast("bigint"), "gaps": (~F.col("complete")).cast("bigint")}, {}).drop("children")
    one = F.coalesce("base", F.lit(0)) == 1
    label = F.when(one | (F.col("positive") > 0), "KEEP").when(F.coalesce("sound", F.lit(0)) == 1, "BLOCKED_BY_CONTRACT").when(F.col("gaps") == 0, "PRUNE_HIGH_CONFIDENCE").otherwise("KEEP_UNCERTAIN")
    return totals.join(x, F.col("node") == F.col("v")).select(F.col("node").alias("branch"), "positive", F.when(F.col("positive") > 0, True).when(F.col("gaps") == 0, False).alias("useful"), label.alias("class"))


@R.add("graph25_contextual_labels", f"""WITH RECURSIVE {_BRANCHES}, s AS (SELECT a, max(tier) AS best, CAST(count(*) AS BIGINT) AS size, CAST(coalesce(sum(cost), 0) AS DECIMAL(30,3)) AS cost FROM up JOIN y ON y.v = up.d GROUP BY a)
    SELECT s.a AS branch, s.best, CASE WHEN s.best > 0 THEN min(up.steps) END AS distance, s.size, s.cost FROM s JOIN up ON up.a = s.a JOIN y ON y.v = up.d AND y.tier = s.best GROUP BY s.a, s.best, s.size, s.cost""")
def graph25_contextual_labels(spark, sf_dir):
    """Best tier below each branch, how many steps away the nearest of that tier is, and the size and cost of the subtree."""
    tmp = Scratch(spark)
    x = tmp.keep(_branches(spark, sf_dir))
    depth = hierarchy(x, "v", "p", scratch=tmp).where("depth >= 0").select(F.col("node").alias("h"), "depth")
    x = tmp.keep(x.join(depth, F.col("v") == F.col("h")).select("v", "p", "tier", "depth", "cost"))
    # the greatest (tier, -depth) below a node is the nearest of the best tier
    t = subtree_totals(x, "v", "p", {"size": F.lit(1).cast("bigint"), "cost": F.col("cost").cast("decimal(30,3)")}, {"near": F.struct(F.col("tier").alias("tier"), (-F.col("depth")).alias("high"))}, tmp)
    t = t.join(x.select("v", "depth"), F.col("node") == F.col("v"))
    best = F.col("near.tier")
    return t.select(F.col("node").alias("branch"), best.alias("best"), F.when(best > 0, -F.col("near.high") - F.col("depth")).alias("distance"), "size", F.col("cost").cast("decimal(30,3)").alias("cost"))


_FRONTIER = f"x AS (SELECT DISTINCT lower(trim({sql_present('search_id')})) AS search, {sql_present('parent_branch_id')} AS parent, branch_id, coverage.children_status AS status, coverage.expected_child_count AS expected FROM search_examples)"


@R.add("graph26_complete_frontiers", f"""WITH {_FRONTIER}, f AS (SELECT search, parent, count(DISTINCT branch_id) AS siblings FROM x WHERE search IS NOT NULL AND parent IS NOT NULL GROUP BY ALL),
    p AS (SELECT branch_id, bool_or(status = 'exhaustive') AS exhaustive, max(expected) AS expected FROM x GROUP BY 1)
    SELECT f.search, f.parent, f.siblings, coalesce(exhaustive, false) AND siblings >= 2 AND coalesce(expected = siblings, false) AS complete FROM f LEFT JOIN p ON p.branch_id = f.parent""")
def graph26_complete_frontiers(spark, sf_dir):
    """Sibling groups per search and parent; complete if the parent says so and as many siblings (two at least) are there."""
    e = load(spark, sf_dir, "search_examples").select(F.lower(trimmed(present(F.col("search_id")))).alias("search"), present(F.col("parent_branch_id")).alias("parent"), "branch_id",
                                                      F.col("coverage.children_status").alias("status"), F.col("coverage.expected_child_count").alias("expected")).distinct()
    f = e.where("search is not null and parent is not null").groupBy("search", "parent").agg(F.count_distinct("branch_id").alias("siblings"))
    p = e.groupBy(F.col("branch_id").alias("b")).agg(F.bool_or(F.col("status") == "exhaustive").alias("exhaustive"), F.max("expected").alias("expected"))
    complete = F.coalesce("exhaustive", F.lit(False)) & (F.col("siblings") >= 2) & F.coalesce(F.col("expected") == F.col("siblings"), F.lit(False))
    return f.join(p, F.col("parent") == F.col("b"), "left").select("search", "parent", "siblings", complete.alias("complete"))


@R.add("graph27_pruned_subtrees", """WITH RECURSIVE e AS (SELECT branch_id AS v, any_value(CASE WHEN lower(trim(parent_branch_id)) NOT IN ('', '-', 'null', 'none', 'unknown', 'n/a') THEN parent_branch_id END) AS p, any_value(branch_state) AS s, coalesce(any_value(node_expansions), 0) AS w FROM search_examples GROUP BY 1),
    t AS (SELECT v, w, s = 'pruned' AS gone FROM e WHERE p IS NULL OR p NOT IN (SELECT v FROM e) UNION ALL SELECT e.v, e.w, coalesce(t.gone, false) OR coalesce(e.s = 'pruned', false) FROM t JOIN e ON e.p = t.v)
    SELECT count(*) FILTER (WHERE gone) AS nodes_removed, sum(w) FILTER (WHERE gone) AS work_removed, sum(w) AS work FROM t""")
def graph27_pruned_subtrees(spark, sf_dir):
    """Work removed when every branch that was pruned takes its descendants with it: nested-set ranges, no expansion.

    Inside a root the outermost pruned ranges are found by a running maximum of range ends."""
    e = load(spark, sf_dir, "search_examples").dropDuplicates(["branch_id"])
    h = hierarchy(e.withColumn("p", present(F.col("parent_branch_id"))), "branch_id", "p").where("depth >= 0")
    x = h.join(e.select(F.col("branch_id").alias("b"), "branch_state", F.coalesce("node_expansions", F.lit(0.0)).alias("work")), F.col("node") == F.col("b"))
    w = Window.partitionBy("root").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("covered", F.max(F.when(F.col("branch_state") == "pruned", F.col("last"))).over(w) >= F.col("first"))
    return x.agg(F.count_if("covered").alias("nodes_removed"), F.sum(F.when(F.col("covered"), F.col("work"))).alias("work_removed"), F.sum("work").alias("work"))


@R.add("graph28_replay_curve", "WITH r AS (SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k, p_size AS gain, count(*) OVER () AS n, sum(p_size) OVER () AS total FROM part), c AS (SELECT k, n, sum(gain) OVER (ORDER BY k) / CAST(total AS DOUBLE) AS got FROM r) SELECT pct, round(max(got), 9) AS recovered FROM c, (VALUES (10), (30), (50), (100)) v(pct) WHERE k <= ceil(n * pct / 100.0) GROUP BY pct")
def graph28_replay_curve(spark, sf_dir):
    """Share of the gain recovered after 10, 30, 50 and 100 percent of the work, best score first."""
    from ..operators.sequences import global_prefix_sum
    p = load(spark, sf_dir, "part").select((-F.col("p_retailprice")).alias("s"), "p_partkey", "p_size", F.lit(1).cast("bigint").alias("one"))
    r = global_prefix_sum(p, ["s", "p_partkey"], "one", "k")
    r = global_prefix_sum(r, ["s", "p_partkey"], "p_size", "got")
    n, total = p.agg(F.count(F.lit(1))).scalar(), p.agg(F.sum("p_size")).scalar()
    x = r.withColumn("pct", F.explode(F.array(*[F.lit(v) for v in (10, 30, 50, 100)]))).where(F.col("k") <= F.ceil(n * F.col("pct") / 100.0))
    return x.groupBy("pct").agg(F.round(F.max(F.col("got") / total), 9).alias("recovered"))


@R.add("graph29_interaction_edges", f"""WITH x AS (SELECT DISTINCT node_id, {sql_present('parent_id')} AS parent, {sql_name('family')} AS family, disposition, terminal FROM lazy_trace_nodes)
    SELECT a.family AS source, b.family AS target, CASE WHEN b.disposition = 'pruned' THEN 'conflicts' WHEN b.terminal THEN 'completes' ELSE 'enables' END AS relation, count(*) AS n
    FROM x a JOIN x b ON b.parent = a.node_id GROUP BY ALL""")
def graph29_interaction_edges(spark, sf_dir):
    """History against frontier: what follows an action, and whether it enables, completes or conflicts with it."""
    x = load(spark, sf_dir, "lazy_trace_nodes").select("node_id", present(F.col("parent_id")).alias("parent"), name_key(F.col("family")).alias("family"), "disposition", "terminal").distinct()
    a = x.select(F.col("node_id").alias("a_id"), F.col("family").alias("source"))
    relation = F.when(F.col("disposition") == "pruned", "conflicts").when(F.col("terminal"), "completes").otherwise("enables")
    return x.join(a, F.col("parent") == F.col("a_id")).groupBy("source", F.col("family").alias("target"), relation.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@R.add("graph30_lineage", _with(_D, _DOWN) + "SELECT DISTINCT b AS artifact, 'descendant' AS side FROM c WHERE a % 10 = 0 AND b % 10 <> 0 UNION SELECT a, 'ancestor' FROM c WHERE b % 10 = 0 AND a % 10 <> 0")
def graph30_lineage(spark, sf_dir):
    """Ancestors and descendants of the artifacts in question, to any depth and without a closure of the whole graph."""
    d = _dag(spark, sf_dir)
    asked = d.select(F.explode(F.array("s", "d")).alias("q")).where("q % 10 = 0")
    side = lambda a, b, name: g.reachable(d, a, b, asked, "q").where("v % 10 <> 0").select(F.col("v").alias("artifact"), F.lit(name).alias("side"))
    return side("s", "d", "descendant").unionByName(side("d", "s", "ancestor"))


@R.add("graph31_topology_hash", "SELECT graph_hash, sha256(array_to_string(list_sort(list_transform(list_filter(edges, lambda e: e IS NOT NULL), lambda e: coalesce(e.role, '?') || ':' || coalesce(e.layout, '?'))), ',')) AS topology FROM (SELECT DISTINCT graph_hash, edges FROM projection_graphs) WHERE edges IS NOT NULL")
def graph31_topology_hash(spark, sf_dir):
    """Digest of a graph's edge kinds without any id."""
    e = load(spark, sf_dir, "projection_graphs").where("edges is not null").dropDuplicates(["graph_hash"])
    kinds = F.transform(F.filter("edges", lambda x: x.isNotNull()), lambda x: F.concat(F.coalesce(x.role, F.lit("?")), F.lit(":"), F.coalesce(x.layout, F.lit("?"))))
    return e.select("graph_hash", F.sha2(F.array_join(F.array_sort(kinds), ","), 256).alias("topology"))


@R.add("graph32_common_vocabulary", "SELECT 'node' AS element, n.kind AS kind, count(*) AS n FROM (SELECT unnest(nodes) AS n FROM (SELECT DISTINCT graph_hash, nodes FROM projection_graphs)) WHERE n IS NOT NULL GROUP BY 2 UNION ALL SELECT 'edge', e.role, count(*) FROM (SELECT unnest(edges) AS e FROM (SELECT DISTINCT graph_hash, edges FROM projection_graphs)) WHERE e IS NOT NULL GROUP BY 2")
def graph32_common_vocabulary(spark, sf_dir):
    p = load(spark, sf_dir, "projection_graphs").dropDuplicates(["graph_hash"])
    n = p.select(F.lit("node").alias("element"), F.explode("nodes").alias("x")).where("x is not null").select("element", F.col("x.kind").alias("kind"))
    e = p.select(F.lit("edge").alias("element"), F.explode("edges").alias("x")).where("x is not null").select("element", F.col("x.role").alias("kind"))
    return n.unionByName(e).groupBy("element", "kind").agg(F.count(F.lit(1)).alias("n"))


@R.add("graph33_last_writer", "SELECT event_id AS reader, (SELECT max(w.event_id) FROM events w WHERE w.user_id = r.user_id AND w.event_id < r.event_id AND w.event_type = 'purchase') AS writer FROM events r WHERE event_type = 'click'")
def graph33_last_writer(spark, sf_dir):
    """Read-after-write edges: the last earlier write of the same register (user) before each read."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = load(spark, sf_dir, "events").withColumn("writer", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w))
    return e.where("event_type = 'click'").select(F.col("event_id").alias("reader"), "writer")


@R.add("graph34_register_pressure", "WITH i AS (SELECT o_custkey % 50 AS g, o_orderkey AS a, o_orderkey + o_custkey % 40 AS b FROM orders), x AS (SELECT g, a AS t, 0 AS o, 1 AS x FROM i UNION ALL SELECT g, b, 1, -1 FROM i) SELECT g, CAST(max(n) AS BIGINT) AS most FROM (SELECT g, sum(x) OVER (PARTITION BY g ORDER BY t, o ROWS UNBOUNDED PRECEDING) AS n FROM x) GROUP BY g")
def graph34_register_pressure(spark, sf_dir):
    return g.live_overlap(load(spark, sf_dir, "orders").selectExpr("o_custkey % 50 AS g", "o_orderkey AS a", "o_orderkey + o_custkey % 40 AS b"), ["g"], "a", "b")


@R.add("graph35_longest_load_use", "SELECT max(reader - writer) AS longest FROM (SELECT event_id AS reader, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS writer, event_type FROM events) WHERE event_type = 'click'")
def graph35_longest_load_use(spark, sf_dir):
    return graph33_last_writer(spark, sf_dir).agg(F.max(F.col("reader") - F.col("writer")).alias("longest"))


@R.add("graph36_plan_errors", """WITH g AS (SELECT DISTINCT graph_hash, nodes, edges FROM projection_graphs WHERE graph_hash IS NOT NULL), n AS (SELECT DISTINCT graph_hash, n.id AS id FROM (SELECT graph_hash, unnest(nodes) AS n FROM g) WHERE n.id IS NOT NULL),
    e AS (SELECT DISTINCT graph_hash, e.id AS id, e.src AS src, e.dst AS dst, e.logical_bytes AS bytes, len(e.consumer_tiles) AS tiles FROM (SELECT graph_hash, unnest(edges) AS e FROM g) WHERE e IS NOT NULL),
    r AS (SELECT e.*, e.src = e.dst AS alias, s.id IS NULL OR d.id IS NULL AS owner, coalesce(tiles, 0) = 0 AS tile FROM e LEFT JOIN n s ON s.graph_hash = e.graph_hash AND s.id = e.src LEFT JOIN n d ON d.graph_hash = e.graph_hash AND d.id = e.dst)
    SELECT graph_hash, count(*) AS edges, count(*) FILTER (WHERE alias) AS aliases, count(*) FILTER (WHERE owner) AS unowned, count(*) FILTER (WHERE tile) AS untiled, coalesce(sum(bytes), 0) > 20000000 AS over_budget FROM r GROUP BY graph_hash""")
def graph36_plan_errors(spark, sf_dir):
    """Errors of each plan: edges that alias their source, edges with an end that is no node, edges nothing tiles, and the
    budget of bytes."""
    p = load(spark, sf_dir, "projection_graphs").where("graph_hash is not null")
    n = p.select(F.col("graph_hash").alias("g"), F.explode("nodes").alias("n")).where("n.id is not null").select("g", F.col("n.id").alias("id")).distinct()
    e = p.select("graph_hash", F.explode("edges").alias("e")).where("e is not null").select("graph_hash", F.col("e.id").alias("id"), "e.src", "e.dst", F.col("e.logical_bytes").alias("bytes"), F.coalesce(F.size("e.consumer_tiles"), F.lit(0)).alias("tiles")).distinct()
    s, d = n.toDF("sg", "s_id"), n.toDF("dg", "d_id")
    r = e.join(s, (F.col("graph_hash") == F.col("sg")) & (F.col("src") == F.col("s_id")), "left").join(d, (F.col("graph_hash") == F.col("dg")) & (F.col("dst") == F.col("d_id")), "left")
    return r.groupBy("graph_hash").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("aliases"), F.count_if(F.col("s_id").isNull() | F.col("d_id").isNull()).alias("unowned"),
                                       F.count_if(F.col("tiles") <= 0).alias("untiled"), (F.coalesce(F.sum("bytes"), F.lit(0)) > 20_000_000).alias("over_budget"))


@R.add("graph37_kernel_vocabulary", "SELECT graph_hash, n.id AS id, CASE n.kind WHEN 'quantise' THEN 'codec' WHEN 'project' THEN 'matmul' WHEN 'normalise' THEN 'reduction' ELSE 'io' END AS kernel FROM (SELECT graph_hash, unnest(nodes) AS n FROM (SELECT DISTINCT graph_hash, nodes FROM projection_graphs)) WHERE n IS NOT NULL")
def graph37_kernel_vocabulary(spark, sf_dir):
    n = load(spark, sf_dir, "projection_graphs").dropDuplicates(["graph_hash"]).select("graph_hash", F.explode("nodes").alias("n")).where("n is not null")
    k = F.col("n.kind")
    return n.select("graph_hash", "n.id", F.when(k == "quantise", "codec").when(k == "project", "matmul").when(k == "normalise", "reduction").otherwise("io").alias("kernel"))


@R.add("graph38_decision_context", "SELECT example_id, branch_id, action.family AS family, depth, stage, len(outcomes) AS seen FROM (SELECT DISTINCT example_id, branch_id, action, depth, stage, outcomes FROM search_examples)")
def graph38_decision_context(spark, sf_dir):
    e = load(spark, sf_dir, "search_examples").select("example_id", "branch_id", "action", "depth", "stage", "outcomes").distinct()
    return e.select("example_id", "branch_id", "action.family", "depth", "stage", F.when(F.col("outcomes").isNotNull(), F.size("outcomes").cast("bigint")).alias("seen"))


@R.add("graph39_system_closure", _with(_E, _CLOSE) + "SELECT a AS root, count(*) AS reached, count(*) FILTER (WHERE b % 5 = 4) AS boundary FROM c GROUP BY a")
def graph39_system_closure(spark, sf_dir):
    return g.transitive_closure(_calls(spark, sf_dir), "s", "d").groupBy(F.col("a").alias("root")).agg(F.count(F.lit(1)).alias("reached"), F.count_if(F.col("b") % 5 == 4).alias("boundary"))
