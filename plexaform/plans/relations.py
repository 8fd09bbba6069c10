"""Queries of the join, set and ranking families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relations as rel
from ..functions.cleaning import present
from ..operators.prefix import bucketed_prefix_sum, group_buckets
from ..operators.sequences import global_index
from ..session import Scratch, load
from .core_problems import sql_present
from .graphs import CALLS_SQL, _calls
from .registry import Registry

R = Registry()


@R.add("join01_lookup", "SELECT o_orderkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join01_lookup(spark, sf_dir):
    return load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "c_nationkey")


@R.add("join02_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) o WHERE o_orderkey = l_orderkey)")
def join02_orphans(spark, sf_dir):
    parent = load(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0")
    return rel.orphans(load(spark, sf_dir, "lineitem"), "l_orderkey", parent, "o_orderkey").select("l_orderkey", "l_linenumber")


@R.add("join03_repeated_keys", "SELECT sample_id, count(*) AS n FROM profile_samples GROUP BY 1 HAVING count(*) > 1")
def join03_repeated_keys(spark, sf_dir):
    return rel.repeated_keys(load(spark, sf_dir, "profile_samples"), "sample_id")


@R.add("join04_exclusion_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY o_custkey")
def join04_exclusion_first(spark, sf_dir):
    used = load(spark, sf_dir, "customer").where("c_nationkey < 5")
    left = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(used, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return rel.first_wins(left, ["o_custkey"], ["o_orderkey"])


def _versions(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    after = o.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END"))
    return o.where("o_orderkey % 11 <> 0"), after


_VER = "b AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 11 <> 0), a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 0)"


@R.add("join05_record_delta", f"WITH {_VER} SELECT * FROM (SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.s IS DISTINCT FROM b.s THEN 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k) WHERE change IS NOT NULL")
def join05_record_delta(spark, sf_dir):
    return rel.record_delta(*_versions(spark, sf_dir), "o_orderkey", ["o_orderstatus"])


@R.add("join06_set_differences", f"WITH {_VER} SELECT 'created' AS side, s FROM (SELECT DISTINCT s FROM a EXCEPT SELECT DISTINCT s FROM b) UNION ALL SELECT 'invalidated', s FROM (SELECT DISTINCT s FROM b EXCEPT SELECT DISTINCT s FROM a)")
def join06_set_differences(spark, sf_dir):
    before, after = (x.select(F.col("o_orderstatus").alias("s")) for x in _versions(spark, sf_dir))
    return after.subtract(before).select(F.lit("created").alias("side"), "s").unionByName(before.subtract(after).select(F.lit("invalidated").alias("side"), "s"))


_EDGES = f"e0 AS (SELECT * FROM ({CALLS_SQL})), e AS (SELECT s AS src, d AS dst FROM e0)"


def _edges(spark, sf_dir):
    return _calls(spark, sf_dir).toDF("src", "dst")


@R.add("join07_two_hops", f"WITH {_EDGES} SELECT x.src AS first, x.dst AS middle, y.dst AS last FROM e x JOIN e y ON x.dst = y.src")
def join07_two_hops(spark, sf_dir):
    return rel.two_hops(_edges(spark, sf_dir), "src", "dst")


@R.add("join08_hazards", "WITH a AS (SELECT l_orderkey AS op, l_partkey * 100000 + l_suppkey AS r, bool_or(l_linenumber = 1) AS w FROM lineitem GROUP BY 1, 2) SELECT DISTINCT x.op AS earlier, y.op AS later FROM a x JOIN a y ON x.r = y.r AND x.op < y.op AND (x.w OR y.w)")
def join08_hazards(spark, sf_dir):
    """Operations are orders, resources the (part, supplier) stocks they touch; an order writes the stock of its first line."""
    a = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("op"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("r")).agg(F.bool_or(F.col("l_linenumber") == 1).alias("w"))
    a = a.withColumn("ord", F.col("op"))
    return rel.hazards(a, "op", "ord", "r", "w")


_TOK = "list_distinct(string_split(lower({c}), ' '))"


@R.add("join09_nearest_signature", """WITH x AS (SELECT p_partkey, list_sort(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))) AS s FROM part), q AS (SELECT * FROM x WHERE p_partkey % 100 = 0), b AS (SELECT s, count(*) AS n FROM x GROUP BY s)
    SELECT p_partkey, coalesce(min(1 - len(list_intersect(q.s, b.s)) / CAST(len(list_distinct(list_concat(q.s, b.s))) AS DOUBLE)) FILTER (WHERE q.s <> b.s OR b.n > 1), 1.0) AS distance FROM q CROSS JOIN b GROUP BY p_partkey""")
def join09_nearest_signature(spark, sf_dir):
    """Queries are the parts whose key is divisible by 100, against all parts but the query itself."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("s"))
    return rel.nearest_sets(p.where("p_partkey % 100 = 0"), "p_partkey", "s", p, "s", within=True)


@R.add("join10_symbol_resolution", """WITH d AS (SELECT p_brand AS symbol, count(DISTINCT p_size % 3) AS n FROM part WHERE p_size < 3 GROUP BY 1), r AS (SELECT DISTINCT p_brand AS symbol FROM part)
    SELECT symbol, CASE coalesce(n, 0) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status, CAST(coalesce(n, 0) AS INTEGER) AS definitions FROM r LEFT JOIN d USING (symbol)""")
def join10_symbol_resolution(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), "p_size", (F.col("p_size") % 3).alias("unit"))
    return rel.resolution(p, "symbol", p.where("p_size < 3"), "unit")


@R.add("join11_inverted_index", "SELECT p_brand AS symbol, p_size AS unit, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS place, count(*) AS hits FROM part GROUP BY p_brand, p_size")
def join11_inverted_index(spark, sf_dir):
    """Postings: one row per symbol and unit with its place, so a symbol found everywhere is no array of its own."""
    postings = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol"), F.col("p_size").alias("unit")).agg(F.count(F.lit(1)).alias("hits"))
    most = postings.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    one = postings.withColumn("one", F.lit(1))
    if group_buckets(most) > 1:
        return bucketed_prefix_sum(one, ["symbol"], "unit", "one", "before", group_buckets(most)).select("symbol", "unit", (F.col("before") + 1).alias("place"), "hits")
    return one.select("symbol", "unit", F.row_number().over(Window.partitionBy("symbol").orderBy("unit")).cast("bigint").alias("place"), "hits")


_LANES = "t AS (SELECT n_nationkey AS g, l AS lane, 10.0::DOUBLE + l * 3 + n_nationkey AS us FROM nation, (VALUES (2), (4), (8), (16)) v(l))"


@R.add("join12_as_of_lane", f"""WITH {_LANES} SELECT c_custkey, coalesce((SELECT max_by(us, lane) FROM t WHERE g = c_nationkey AND lane <= c_custkey % 20), (SELECT min_by(us, lane) FROM t WHERE g = c_nationkey)) AS us FROM customer""")
def join12_as_of_lane(spark, sf_dir):
    t = load(spark, sf_dir, "nation").selectExpr("n_nationkey AS g", "explode(array(2L, 4L, 8L, 16L)) AS lane").withColumn("us", F.lit(10.0) + F.col("lane") * 3 + F.col("g"))
    c = load(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey AS g", "c_custkey % 20 AS lanes")
    return rel.latest_at_or_before(c, ["g"], "lanes", t, "lane", "us", "us", otherwise_first=True).select("c_custkey", "us")


@R.add("join13_producer_for_wait", "SELECT event_id, (SELECT max(s.event_id) FROM events s WHERE s.user_id = e.user_id AND s.event_id < e.event_id AND s.event_type = 'view') AS producer FROM events e WHERE event_type <> 'view'")
def join13_producer_for_wait(spark, sf_dir):
    """The latest earlier signal (a view) of the same queue (user); NULL is a wait without producer."""
    e = load(spark, sf_dir, "events")
    signals = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("sid"))
    return rel.latest_at_or_before(e.where("event_type <> 'view'").select("event_id", "user_id"), ["user_id"], "event_id", signals.withColumn("v", F.col("sid")), "sid", "v", "producer").select("event_id", "producer")


@R.add("join14_overlapping_coverage", "SELECT n_nationkey % 4 AS region, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) > 1")
def join14_overlapping_coverage(spark, sf_dir):
    return rel.repeated_keys(load(spark, sf_dir, "nation").select((F.col("n_nationkey") % 4).alias("region")), "region")


@R.add("join15_boundary", f"WITH {_EDGES} SELECT src, dst FROM e WHERE dst NOT IN (SELECT src FROM e WHERE src % 5 <> 4)")
def join15_boundary(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return rel.orphans(e, "dst", e.where("src % 5 <> 4"), "src")


@R.add("join16_sibling_order", f"""WITH x AS (SELECT node_id, min({sql_present('parent_id')}) AS parent, max(coalesce(CASE WHEN NOT isnan(decision_confidence) THEN decision_confidence END, -1)) AS c FROM lazy_trace_nodes WHERE node_id IS NOT NULL GROUP BY 1)
    SELECT parent, node_id, row_number() OVER (PARTITION BY parent ORDER BY c DESC, node_id) AS rank, count(*) OVER (PARTITION BY parent) - row_number() OVER (PARTITION BY parent ORDER BY c DESC, node_id) AS preferred_over FROM x WHERE parent IS NOT NULL""")
def join16_sibling_order(spark, sf_dir):
    """Ordered pairs of siblings as membership: each sibling's rank by confidence and how many it is preferred over.

    Positions in one order over all siblings, less that of the parent's first, so a parent of any number of children is ranked
    across tasks."""
    n = load(spark, sf_dir, "lazy_trace_nodes").where("node_id is not null")
    c = F.max(F.coalesce(F.when(~F.isnan("decision_confidence"), F.col("decision_confidence")), F.lit(-1.0)))
    x = n.groupBy("node_id").agg(F.min(present(F.col("parent_id"))).alias("parent"), (-c).alias("low")).where("parent is not null")
    tmp = Scratch(spark)
    placed = tmp.keep(global_index(x, ["parent", "low", "node_id"], "i"))
    spans = placed.groupBy(F.col("parent").alias("p")).agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    rank = F.col("i") - F.col("first") + 1
    return placed.join(spans, F.col("parent") == F.col("p")).select("parent", "node_id", rank.alias("rank"), (F.col("n") - rank).alias("preferred_over"))


@R.add("join17_group_members", "SELECT s_suppkey AS id, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS representative, count(*) OVER (PARTITION BY s_nationkey) - 1 AS partners FROM supplier")
def join17_group_members(spark, sf_dir):
    """Candidate pairs inside a signature group, as membership: representative and number of partners of each member."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    g = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.min("id").alias("representative"), (F.count(F.lit(1)) - 1).alias("partners"))
    return s.join(g, F.col("s_nationkey") == F.col("k")).select("id", "representative", "partners")


@R.add("join18_terminal_parity", f"WITH {_VER} SELECT coalesce(b.k, a.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'lost' ELSE 'extra' END AS side FROM b FULL JOIN a ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def join18_terminal_parity(spark, sf_dir):
    return rel.set_parity(*_versions(spark, sf_dir), "o_orderkey")


@R.add("join19_key_set_equality", f"WITH {_VER} SELECT count(*) FILTER (WHERE a.k IS NULL) AS missing, count(*) FILTER (WHERE b.k IS NULL) AS unexpected FROM b FULL JOIN a ON a.k = b.k")
def join19_key_set_equality(spark, sf_dir):
    return rel.set_parity(*_versions(spark, sf_dir), "o_orderkey").agg(F.count_if(F.col("side") == "lost").alias("missing"), F.count_if(F.col("side") == "extra").alias("unexpected"))


@R.add("join20_counter_compare", """WITH c AS (SELECT o_orderpriority AS category, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) AS base, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 1) AS cand FROM orders GROUP BY 1)
    SELECT category, round((cand - base) / nullif(base, 0) * 100, 6) AS delta_percent, cand < base AS favorable FROM c WHERE base IS NOT NULL AND cand IS NOT NULL""")
def join20_counter_compare(spark, sf_dir):
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("category"), (F.col("o_orderkey") % 2).alias("side")).agg(F.avg("o_totalprice").alias("v"))
    base = o.where("side = 0").select(F.col("category").alias("c2"), F.col("v").alias("base"))
    both = o.where("side = 1").join(base, F.col("category") == F.col("c2"))
    return both.select("category", F.round((F.col("v") - F.col("base")) / F.nullif("base", F.lit(0.0)) * 100, 6).alias("delta_percent"), (F.col("v") < F.col("base")).alias("favorable"))


@R.add("join21_three_way_chain", "WITH " + _EDGES + " SELECT count(*) AS regions FROM (SELECT DISTINCT a.src, a.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src % 2 = 0 AND a.dst % 3 = 0 AND b.dst % 2 = 1)")
def join21_three_way_chain(spark, sf_dir):
    h = rel.two_hops(_edges(spark, sf_dir), "src", "dst").where("first % 2 = 0 AND middle % 3 = 0 AND last % 2 = 1")
    return h.agg(F.count_distinct("first", "middle").alias("regions"))


@R.add("join22_state_owner", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS owner FROM documents")
def join22_state_owner(spark, sf_dir):
    """Exact dedup of whole texts: later copies are aliases of the first."""
    return rel.owners(load(spark, sf_dir, "documents"), F.col("text"), "doc_id", "doc_id")


@R.add("join23_feature_dedup", "SELECT DISTINCT p_brand AS name, p_size AS value FROM part")
def join23_feature_dedup(spark, sf_dir):
    return load(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("value")).dropDuplicates()


@R.add("join24_idempotent_upsert", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'stored' WHEN o_orderkey % 5 = 0 AND o_orderstatus <> 'X' THEN 'conflict' ELSE 'duplicate' END AS status FROM orders WHERE o_orderkey % 7 <> 0) GROUP BY status")
def join24_idempotent_upsert(spark, sf_dir):
    """Same id and content: duplicate; same id, other content: conflict; new id: stored."""
    before, after = _versions(spark, sf_dir)
    b = before.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    j = after.join(b, F.col("o_orderkey") == F.col("k"), "left")
    return j.groupBy(F.when(F.col("k").isNull(), "stored").when(F.col("s").eqNullSafe(F.col("o_orderstatus")), "duplicate").otherwise("conflict").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@R.add("join25_owner_evidence", "WITH o AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS owner FROM documents) SELECT owner, count(*) AS labels FROM doc_labels JOIN o USING (doc_id) GROUP BY owner")
def join25_owner_evidence(spark, sf_dir):
    """Labels of copies move to the owner of their text."""
    o = rel.owners(load(spark, sf_dir, "documents"), F.col("text"), "doc_id", "doc_id").withColumnRenamed("doc_id", "d")
    return load(spark, sf_dir, "doc_labels").join(o, F.col("doc_id") == F.col("d")).groupBy("owner").agg(F.count(F.lit(1)).alias("labels"))


@R.add("join26_material_fields", "SELECT n_nationkey, f AS field FROM nation, (VALUES ('region'), ('length')) v(f) WHERE CASE f WHEN 'region' THEN n_regionkey <> (SELECT min_by(n_regionkey, n_nationkey) FROM nation) ELSE length(n_name) <> (SELECT min_by(length(n_name), n_nationkey) FROM nation) END")
def join26_material_fields(spark, sf_dir):
    """Material fields of every manifest against those of the first; the first is one row, read as a scalar."""
    n = load(spark, sf_dir, "nation").selectExpr("n_nationkey", "CAST(n_regionkey AS BIGINT) AS region", "CAST(length(n_name) AS BIGINT) AS length")
    first = n.agg(F.min_by(F.struct("region", "length"), "n_nationkey")).scalar()
    rows = n.withColumn("f", first).select("n_nationkey", F.explode(F.array(F.struct(F.lit("region").alias("field"), (~F.col("region").eqNullSafe(F.col("f.region"))).alias("differs")), F.struct(F.lit("length").alias("field"), (~F.col("length").eqNullSafe(F.col("f.length"))).alias("differs")))).alias("x"))
    return rows.where("x.differs").select("n_nationkey", "x.field")


@R.add("join27_guard_coverage", "SELECT l_orderkey, list_sort(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(list(DISTINCT l_returnflag), x))) AS missing FROM lineitem GROUP BY l_orderkey")
def join27_guard_coverage(spark, sf_dir):
    g = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("s"))
    return g.select("l_orderkey", F.array_sort(F.array_except(F.array(*[F.lit(x) for x in "ANR"]), "s")).alias("missing"))


@R.add("join28_identity_first", "SELECT p_partkey, CASE WHEN md5(p_brand) = (SELECT md5(min_by(p_brand, p_partkey)) FROM part) THEN 'tie' WHEN p_retailprice < 1200 THEN 'better' ELSE 'worse' END AS verdict FROM part")
def join28_identity_first(spark, sf_dir):
    """Identical implementations tie, whatever was measured."""
    p = load(spark, sf_dir, "part")
    own = p.agg(F.md5(F.min_by("p_brand", "p_partkey"))).scalar()
    return p.select("p_partkey", F.when(F.md5("p_brand") == own, "tie").when(F.col("p_retailprice") < 1200, "better").otherwise("worse").alias("verdict"))


# ---- ranking, budgets, skylines


@R.add("rank01_by_score", "SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer")
def rank01_by_score(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return load(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.row_number().over(w).alias("rank"))


@R.add("rank02_budgeted_selection", """WITH c AS (SELECT c_nationkey AS g, c_custkey AS id, c_acctbal AS s, c_mktsegment AS f FROM customer), x AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, id) AS r FROM c),
    fam AS (SELECT g, f, count(*) AS n FROM c GROUP BY 1, 2), y AS (SELECT x.*, row_number() OVER (PARTITION BY x.g ORDER BY n, sha256(CAST(id AS VARCHAR)), id) AS e FROM x JOIN fam ON x.g = fam.g AND x.f = fam.f WHERE r > 6)
    SELECT g, id, 'exploit' AS slot FROM x WHERE r <= 6 UNION ALL SELECT g, id, 'explore' FROM y WHERE e <= 2""")
def rank02_budgeted_selection(spark, sf_dir):
    """Six slots by score, two for the least represented families, ties by a seeded digest."""
    c = load(spark, sf_dir, "customer").selectExpr("c_nationkey AS g", "c_custkey AS id", "c_acctbal AS s", "c_mktsegment AS f")
    x = c.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), "id"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g", "f")))
    explore = x.where("r > 6").withColumn("e", F.row_number().over(Window.partitionBy("g").orderBy("n", F.sha2(F.col("id").cast("string"), 256), "id"))).where("e <= 2")
    return x.where("r <= 6").select("g", "id", F.lit("exploit").alias("slot")).unionByName(explore.select("g", "id", F.lit("explore").alias("slot")))


@R.add("rank03_stratified_sample", "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('7' || chr(31) || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 3")
def rank03_stratified_sample(spark, sf_dir):
    """The first three by seeded digest in every stratum; a bounded heap per stratum, not a sort of it."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2(F.concat_ws("\x1f", F.lit("7"), F.col("doc_id").cast("string")), 256).alias("h"))
    w = Window.partitionBy("lang", "source").orderBy("h", "doc_id")
    return d.withColumn("r", F.row_number().over(w)).where("r <= 3").select("doc_id", "lang", "source")


@R.add("rank04_first_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r <= 5")
def rank04_first_per_group(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return load(spark, sf_dir, "customer").withColumn("r", F.row_number().over(w)).where("r <= 5").select("c_nationkey", "c_custkey")


@R.add("rank05_saturating_score", """SELECT p_brand, p_partkey, s FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, p_partkey) AS r FROM (SELECT p_brand, p_partkey, 2 * least(p_size, 20) + least(floor(p_retailprice / 100), 12) AS s FROM part WHERE p_size > 2)) WHERE r <= 2""")
def rank05_saturating_score(spark, sf_dir):
    p = load(spark, sf_dir, "part").where("p_size > 2").select("p_brand", "p_partkey", (2 * F.least("p_size", F.lit(20)) + F.least(F.floor(F.col("p_retailprice") / 100), F.lit(12))).cast("double").alias("s"))
    return p.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("s"), "p_partkey"))).where("r <= 2").drop("r")


@R.add("rank06_pareto3", """WITH p AS (SELECT p_partkey AS id, p_size AS a, p_partkey * 13 % 101 AS b, p_retailprice AS c FROM part) SELECT id FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.a >= x.a AND y.b >= x.b AND y.c <= x.c AND (y.a > x.a OR y.b > x.b OR y.c < x.c))""")
def rank06_pareto3(spark, sf_dir):
    p = load(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size AS a", "p_partkey * 13 % 101 AS b", "p_retailprice AS c")
    return rel.pareto(p, ["a", "b"], ["c"], "id").select("id")


@R.add("rank07_pareto_costs", """WITH p AS (SELECT p_partkey AS id, p_size AS a, p_retailprice AS b FROM part) SELECT id FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.a <= x.a AND y.b <= x.b AND (y.a < x.a OR y.b < x.b))""")
def rank07_pareto_costs(spark, sf_dir):
    return rel.pareto(load(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size AS a", "p_retailprice AS b"), [], ["a", "b"], "id").select("id")


@R.add("rank11_best_sibling", "SELECT n_regionkey, min_by(n_nationkey, (n_nationkey % 3) * 1000 + n_nationkey) AS chosen FROM nation GROUP BY 1")
def rank11_best_sibling(spark, sf_dir):
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min(F.struct(F.col("n_nationkey") % 3, F.col("n_nationkey").alias("k"))).alias("m")).select("n_regionkey", F.col("m.k").alias("chosen"))


@R.add("rank12_newest_approved", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 12")
def rank12_newest_approved(spark, sf_dir):
    limit = max(1, min(50, 12))
    return load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(limit).select("o_orderkey")


@R.add("rank14_smallest_encoding", "SELECT doc_id, CASE WHEN strlen(text) <= least(2 * length(text), 40 + length(text) // 2) THEN 'utf8' WHEN 2 * length(text) <= 40 + length(text) // 2 THEN 'utf16' ELSE 'packed' END AS encoding, least(strlen(text), 2 * length(text), 40 + length(text) // 2) AS bytes FROM documents WHERE text IS NOT NULL")
def rank14_smallest_encoding(spark, sf_dir):
    """Fewest bytes; of equal ones the first declared."""
    n, chars = F.octet_length("text").cast("bigint"), F.length("text").cast("bigint")
    best = F.least(*[F.struct(size.alias("bytes"), F.lit(k).alias("rank"), F.lit(name).alias("encoding")) for k, (name, size) in enumerate([("utf8", n), ("utf16", chars * 2), ("packed", F.lit(40).cast("bigint") + F.floor(chars / 2))])])
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", best.alias("b")).select("doc_id", "b.encoding", "b.bytes")


@R.add("rank15_sparse_policy", "SELECT user_id, d >= 0.25 AS dense, CASE WHEN d >= 0.25 THEN n * 8 ELSE CAST(k * 12 + 16 AS BIGINT) END AS bytes FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value > 500) AS k, count(*) FILTER (WHERE value > 500) / CAST(count(*) AS DOUBLE) AS d FROM events GROUP BY 1)")
def rank15_sparse_policy(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 500).alias("k"))
    dense = F.col("k") / F.col("n") >= 0.25
    return e.select("user_id", dense.alias("dense"), F.when(dense, F.col("n") * 8).otherwise(F.col("k") * 12 + 16).alias("bytes"))


@R.add("rank17_feasible_order", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size <= 25 DESC, p_retailprice DESC, p_partkey) AS INTEGER) AS place FROM part")
def rank17_feasible_order(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.desc(F.col("p_size") <= 25), F.desc("p_retailprice"), "p_partkey")
    return load(spark, sf_dir, "part").select("p_partkey", F.row_number().over(w).alias("place"))


@R.add("rank18_dispatch", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_retailprice > 1500 THEN 'costly' WHEN p_brand LIKE '%1' THEN 'first' ELSE 'fallback' END AS route FROM part")
def rank18_dispatch(spark, sf_dir):
    """The first true guard in priority order, with a total fallback."""
    guards = [("small", F.col("p_size") < 10), ("costly", F.col("p_retailprice") > 1500), ("first", F.col("p_brand").like("%1"))]
    out = F.lit("fallback")
    for name, guard in reversed(guards):
        out = F.when(guard, F.lit(name)).otherwise(out)
    return load(spark, sf_dir, "part").select("p_partkey", out.alias("route"))
