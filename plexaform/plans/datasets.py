"""Queries of the dataset-engineering and plan-search families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import derived
from ..functions.cleaning import name_key
from ..operators import datasets as ds
from ..operators import learning
from ..operators import plansearch as ps
from ..operators import relations as rel
from ..session import Scratch, load
from .core_problems import sql_name
from .registry import Registry

R = Registry()

_SPLIT = """g AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS key FROM orders), p AS (SELECT key, row_number() OVER (ORDER BY sha256('4242' || chr(31) || key), key) - 1 AS i, count(*) OVER () AS n FROM g),
    t AS (SELECT *, CAST(CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.2, 0)) ELSE 1 END AS BIGINT) AS nt FROM p), c AS (SELECT *, CAST(CASE WHEN n - nt >= 2 THEN greatest(1, round_even((n - nt) * 0.2, 0)) ELSE 0 END AS BIGINT) AS nc FROM t)"""


@R.add("data01_grouped_split", f"WITH {_SPLIT} SELECT key, CASE WHEN i < nt THEN 'test' WHEN i < nt + nc THEN 'calibration' ELSE 'train' END AS part FROM c")
def data01_grouped_split(spark, sf_dir):
    return ds.seeded_group_split(load(spark, sf_dir, "orders"), "o_custkey", 4242, 0.2, 0.2)


@R.add("data02_holdout", "SELECT n_name AS key FROM nation WHERE contains(n_name, '1')")
def data02_holdout(spark, sf_dir):
    return ds.seeded_group_split(load(spark, sf_dir, "nation"), "n_name", 1, 0.2, 0.2, holdout="1").where("part = 'test'").select("key")


@R.add("data03_split_leaks", "SELECT project, count(DISTINCT lower(trim(split))) AS parts FROM search_examples WHERE project IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1")
def data03_split_leaks(spark, sf_dir):
    e = load(spark, sf_dir, "search_examples").where("project is not null").withColumn("part", F.lower(F.trim("split")))
    return ds.leaks(e, "project", "part")


@R.add("data04_labels", """SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 0.0 WHEN bool_or(o_orderstatus IN ('F', 'P')) THEN 1.0 ELSE 0.5 END::DOUBLE AS proof_risk, NOT bool_or(o_orderstatus = 'P') AS applicable,
    coalesce(max(o_totalprice) FILTER (WHERE o_orderstatus = 'O' AND left(o_orderpriority, 1) <> '4'), 0.0) AS utility FROM orders GROUP BY 1""")
def data04_labels(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("grade", F.when(F.left("o_orderpriority", F.lit(1)) == "4", "D").otherwise("A"))
    return ds.labels(o, "o_custkey", "o_orderstatus", "grade", "o_totalprice", ["F"], ["P"], ["O"])


_TOKENS = "SELECT p_partkey AS row, unnest([p_brand, p_type, 'size=' || p_size]) AS token FROM part"
_HF = "h AS (SELECT row, sha256(token) AS h FROM (" + _TOKENS + ")), b AS (SELECT row, CAST(CAST('0x' || " + " || ".join(f"h[{2 * k + 1}:{2 * k + 2}]" for k in range(7, -1, -1)) + " AS UBIGINT) % 64 AS BIGINT) AS bucket, CASE WHEN CAST('0x' || h[17:18] AS INTEGER) & 1 = 1 THEN 1.0 ELSE -1.0 END AS s FROM h)"


@R.add("data05_feature_hashing", f"WITH {_HF}, v AS (SELECT row, bucket, sum(s) AS x FROM b GROUP BY ALL), n AS (SELECT row, sqrt(sum(x * x)) AS n FROM v GROUP BY 1) SELECT row, bucket, round(CASE WHEN n > 0 THEN x / n ELSE 0 END, 12) AS value FROM v JOIN n USING (row)")
def data05_feature_hashing(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    t = p.select(F.col("p_partkey").alias("row"), F.explode(F.array("p_brand", "p_type", F.concat(F.lit("size="), F.col("p_size").cast("string")))).alias("token")).withColumn("w", F.lit(1.0))
    return ds.hashed_vectors(t, "row", "token", "w", 64).withColumn("value", F.round("value", 12))


@R.add("data06_flatten_tokens", """SELECT graph_hash, 'attrs.' || k AS token, CASE WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN round(sign(CAST(v AS DOUBLE)) * log2(1 + abs(CAST(v AS DOUBLE))), 9) ELSE 1.0 END AS value, count(*) AS n FROM (
    SELECT graph_hash, e.key AS k, CASE WHEN try_cast(e.value AS DOUBLE) IS NULL THEN '=' || e.value ELSE e.value END AS v0, e.value AS v FROM (SELECT graph_hash, unnest(map_entries(n.attrs)) AS e FROM (SELECT graph_hash, unnest(nodes) AS n FROM (SELECT DISTINCT graph_hash, nodes FROM projection_graphs)) WHERE n IS NOT NULL)) GROUP BY ALL""")
def data06_flatten_tokens(spark, sf_dir):
    """Dotted tokens of nested attributes: a number becomes its signed log2, a word the token's presence."""
    n = load(spark, sf_dir, "projection_graphs").dropDuplicates(["graph_hash"]).select("graph_hash", F.explode("nodes").alias("n")).where("n is not null")
    e = n.select("graph_hash", F.explode("n.attrs").alias("k", "v"))
    x = F.col("v").try_cast("double")
    value = F.when(x.isNotNull(), F.round(F.signum(x) * F.log2(1 + F.abs(x)), 9)).otherwise(1.0)
    return e.select("graph_hash", F.concat(F.lit("attrs."), "k").alias("token"), value.alias("value")).groupBy("graph_hash", "token", "value").agg(F.count(F.lit(1)).alias("n"))


@R.add("data07_preferences", """WITH c AS (SELECT c_nationkey AS g, CAST(c_custkey % 7 AS DOUBLE) / 20 AS u FROM customer) SELECT a.g, a.u, count(*) FILTER (WHERE a.u > b.u) // (SELECT count(*) FROM c x WHERE x.g = a.g AND x.u = a.u) AS wins FROM c a JOIN c b ON a.g = b.g WHERE abs(a.u - b.u) >= 1e-6 GROUP BY a.g, a.u HAVING count(*) FILTER (WHERE a.u > b.u) > 0""")
def data07_preferences(spark, sf_dir):
    c = load(spark, sf_dir, "customer").selectExpr("c_nationkey AS g", "CAST(c_custkey % 7 AS DOUBLE) / 20 AS u")
    return ds.pairwise_preferences(c, ["g"], "u").where("wins is not null").select("g", "u", "wins")


#: five members of a linear ensemble, as a trained model gives them: weight of size and of price
_MEMBERS = [(0.60, 0.40), (0.50, 0.50), (0.66, 0.34), (0.58, 0.45), (0.40, 0.52)]
_SCORED = "s AS (SELECT p_brand AS g, p_partkey AS i, p_type AS family, p_size % 11 = 0 AS baseline, CAST((p_size * 37 + p_partkey * 11) % 101 AS DOUBLE) / 101 AS u, [" + ", ".join(f"p_size / 50.0::DOUBLE * {a}::DOUBLE + p_retailprice / 2000 * {b}::DOUBLE" for a, b in _MEMBERS) + "] AS m FROM part), sc AS (SELECT g, i, family, baseline, u, list_avg(m) AS mean, list_stddev_pop(m) AS spread FROM s)"


def _scored_parts(spark, sf_dir) -> DataFrame:
    """g (root), i (candidate), family, baseline, u (utility), mean and population deviation of the members' scores."""
    p = load(spark, sf_dir, "part")
    members = [F.col("p_size") / 50.0 * a + F.col("p_retailprice") / 2000 * b for a, b in _MEMBERS]
    mean, spread = learning.ensemble(members)
    return p.select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("i"), F.col("p_type").alias("family"), (F.col("p_size") % 11 == 0).alias("baseline"),
                    (((F.col("p_size") * 37 + F.col("p_partkey") * 11) % 101).cast("double") / 101).alias("u"), mean.alias("mean"), spread.alias("spread"))


@R.add("data09_ensemble", f"""WITH {_SCORED}, t AS (SELECT quantile_disc(spread, 0.95) AS t FROM sc WHERE i % 5 = 0), b AS (SELECT g, list_sort(list(DISTINCT family)) AS fs FROM sc GROUP BY g),
    r AS (SELECT g, round(max(mean), 9) AS best, arg_min(i, (-round(mean, 9), i)) AS first, list_filter([CASE WHEN bool_and(spread > (SELECT t FROM t)) THEN 'ensemble uncertainty above threshold' END, CASE WHEN count(*) FILTER (WHERE baseline) = 0 THEN 'no baseline' END, CASE WHEN g NOT IN (SELECT g FROM sc WHERE i % 5 <> 0) THEN 'unseen root' END,
      CASE WHEN count(DISTINCT family) < 3 THEN 'too few families' END], lambda x: x IS NOT NULL) AS reasons FROM sc GROUP BY g) SELECT g, best, first, array_to_string(reasons, '; ') AS reasons, len(reasons) > 0 AS abstain FROM r""")
def data09_ensemble(spark, sf_dir):
    """Per root the best candidate by mean score, and why a recommendation is withheld: the deviations' 95th percentile on the
    calibration part is the threshold, and roots, families and baselines must have been seen."""
    s = _scored_parts(spark, sf_dir)
    threshold = s.where("i % 5 = 0").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY spread)")).scalar()
    seen = s.where("i % 5 <> 0").select(F.col("g").alias("k")).distinct()
    r = s.groupBy("g").agg(F.round(F.max("mean"), 9).alias("best"), F.min_by("i", F.struct(-F.round("mean", 9), F.col("i"))).alias("first"), F.min("spread").alias("least"), F.count_if("baseline").alias("baselines"), F.count_distinct("family").alias("families"))
    r = r.join(seen, F.col("g") == F.col("k"), "left")
    reasons = F.array_compact(F.array(F.when(F.col("least") > threshold, "ensemble uncertainty above threshold"), F.when(F.col("baselines") == 0, "no baseline"), F.when(F.col("k").isNull(), "unseen root"), F.when(F.col("families") < 3, "too few families")))
    return r.select("g", "best", "first", F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) > 0).alias("abstain"))


@R.add("data10_shadow_report", f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(mean, 9) DESC, i) AS k, count(*) OVER (PARTITION BY g) AS n, max(baseline::INTEGER) OVER (PARTITION BY g) AS based, first_value(i) OVER (PARTITION BY g ORDER BY u DESC, i DESC) AS winner,
      sum(baseline::INTEGER) OVER (PARTITION BY g ORDER BY round(mean, 9) DESC, i) AS nb FROM sc), q AS (SELECT *, k <= greatest(2, 1 + CAST(ceil((n - 1) * 0.1::DOUBLE) AS BIGINT)) OR (baseline AND nb = 1) AS taken FROM r WHERE n >= 2 AND based = 1),
    x AS (SELECT g, max(n) AS n, min(k) FILTER (WHERE i = winner) AS place, count(*) FILTER (WHERE taken) AS taken, bool_or(taken AND i = winner) AS hit, max(u) - max(u) FILTER (WHERE taken) AS regret FROM q GROUP BY g)
    SELECT count(*) AS roots, round(avg(hit::INTEGER), 9) AS recall_at_budget, round(avg((place <= 1)::INTEGER), 9) AS recall_at_1, round(avg((place <= 5)::INTEGER), 9) AS recall_at_5, round(avg((place <= greatest(1, ceil(n * 0.1::DOUBLE)))::INTEGER), 9) AS recall_at_tenth,
      round(sum(n) / CAST(sum(taken) AS DOUBLE), 9) AS reduction, round(max(regret), 9) AS largest_regret, round(list_sort(list(regret))[1 + count(*) // 2], 9) AS median_regret FROM x""")
def data10_shadow_report(spark, sf_dir):
    """What a budget of a tenth of the candidates (two at least, and the baseline) would have found per root, against full search."""
    return learning.shadow_report(_scored_parts(spark, sf_dir).withColumn("mean", F.round("mean", 9)), "g", "i", "mean", "u", "baseline", 0.1, 2)


#: fixed values: families and languages of the controlled corpus
_FAMILIES = ["stable_compaction", "wire_codec", "stateful_delta", "aos_fused_reduction", "lifetime_extension", "gpu_schedule"]
_LANGUAGES = ["c", "cpp", "rust", "zig", "julia"]


@R.add("data11_synthetic_corpus", f"""WITH f AS (SELECT {_FAMILIES} AS fs, {_LANGUAGES} AS ls), x AS (SELECT o AS root, fs[1 + o % 6] AS own, fs[1 + (o + 1) % 6] AS next, ls[1 + o % 5] AS language, 'synthetic-project-' || (o % 12) AS project, fs[1 + f] AS family, v AS variant, o % 2 = 0 AS wide FROM f, range(60) a(o), range(6) b(f), range(5) c(v)),
    y AS (SELECT *, CASE WHEN family = own THEN 0.10::DOUBLE + (root % 4) * 0.025::DOUBLE + CASE WHEN variant = 1 AND wide THEN 0.05::DOUBLE WHEN variant = 1 THEN -0.02::DOUBLE WHEN variant >= 2 THEN -0.08::DOUBLE - 0.01::DOUBLE * variant ELSE 0.0::DOUBLE END WHEN family = next THEN 0.0::DOUBLE ELSE -0.04::DOUBLE - 0.01::DOUBLE * variant END AS utility FROM x)
    SELECT root, project, language, family, variant, family = own AS applicable, round(utility, 9) AS utility, CASE WHEN family = own THEN CASE WHEN round(utility, 9) >= 0.03 THEN 'material_regional_win' ELSE 'small_win_below_floor' END WHEN family = next THEN 'compiler_identical' ELSE 'measured_regression' END AS outcome FROM y""")
def data11_synthetic_corpus(spark, sf_dir):
    """A controlled corpus of 60 roots: every family in five variants per root, with its outcome by fixed rules."""
    return ds.controlled_corpus(spark, 60, _FAMILIES, _LANGUAGES)


@R.add("data12_scrub", r"""SELECT doc_id, CASE WHEN doc_kind IN ('report', 'log', 'review') THEN doc_kind ELSE 'other' END AS kind, CASE WHEN n_chars = 0 THEN 0 ELSE pow(2, floor(log2(n_chars))) END AS size_bucket, CASE WHEN project IS NULL OR length(project) > 96 OR regexp_matches(project, '[/\\]|\.[a-z]{1,4}$|[0-9a-f]{16,}') OR NOT regexp_full_match(project, '[A-Za-z0-9_.:+-]+') THEN 'other' ELSE project END AS project FROM documents""")
def data12_scrub(spark, sf_dir):
    """Vocabulary whitelist, power-of-two sizes, safe tokens."""
    from ..functions.pointwise import power_bucket
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.when(F.col("doc_kind").isin("report", "log", "review"), F.col("doc_kind")).otherwise("other").alias("kind"), power_bucket(F.col("n_chars")).alias("size_bucket"), derived.safe_token(F.col("project"), "other").alias("project"))


@R.add("data13_integrity", "SELECT 'label without document' AS error, count(*) AS n FROM doc_labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'document repeated', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)")
def data13_integrity(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id")
    a = rel.orphans(load(spark, sf_dir, "doc_labels"), "doc_id", d, "doc_id").agg(F.lit("label without document").alias("error"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(rel.repeated_keys(d, "doc_id").agg(F.lit("document repeated").alias("error"), F.count(F.lit(1)).alias("n")))


@R.add("data14_lineage_examples", """WITH RECURSIVE e AS (SELECT DISTINCT branch_id AS v, CASE WHEN lower(trim(parent_branch_id)) NOT IN ('', '-', 'null', 'none', 'unknown', 'n/a') THEN parent_branch_id END AS p, stage FROM search_examples),
    t AS (SELECT v, stage, 0 AS depth, '' AS lineage FROM e WHERE p IS NULL OR p NOT IN (SELECT v FROM e) UNION ALL SELECT e.v, e.stage, t.depth + 1, CASE WHEN t.depth = 0 THEN t.stage ELSE t.lineage || '>' || t.stage END FROM t JOIN e ON e.p = t.v)
    SELECT v AS branch_id, depth, lineage FROM t""")
def data14_lineage_examples(spark, sf_dir):
    """Learning examples: each branch with the stages of its ancestors, from root to parent."""
    from ..functions.cleaning import present
    from ..operators.hierarchy import hierarchy
    e = load(spark, sf_dir, "search_examples").dropDuplicates(["branch_id"])
    h = hierarchy(e.withColumn("p", present(F.col("parent_branch_id"))), "branch_id", "p", paths=True).where("depth >= 0")
    up = h.select("node", F.posexplode(F.expr("slice(path, 1, depth)")).alias("k", "a"))
    stages = up.join(e.select(F.col("branch_id").alias("b"), "stage"), F.col("a") == F.col("b")).groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "stage"))), lambda s: s.stage), ">").alias("lineage"))
    return h.select("node", "depth").join(stages, "node", "left").select(F.col("node").alias("branch_id"), "depth", F.coalesce("lineage", F.lit("")).alias("lineage"))


@R.add("data15_inference_view", "SELECT DISTINCT example_id, branch_id, project, stage, depth FROM search_examples")
def data15_inference_view(spark, sf_dir):
    """Outcome columns dropped; what is left of repeated deliveries is one row."""
    e = load(spark, sf_dir, "search_examples").drop("outcomes", "coverage", "target", "failure_class", "quality_grade", "proof_calls", "node_expansions", "compiler_invocations", "split", "emitted_at", "ingested_at")
    return e.select("example_id", "branch_id", "project", "stage", "depth").distinct()


@R.add("data16_redundancy_class", "SELECT DISTINCT node_id, CASE WHEN canonical_of IS NOT NULL THEN 'alias' WHEN terminal THEN 'terminal' WHEN disposition = 'pruned' THEN 'pruned' WHEN child_count = 0 THEN 'leaf' ELSE 'useful' END AS class FROM lazy_trace_nodes")
def data16_redundancy_class(spark, sf_dir):
    c = F.when(F.col("canonical_of").isNotNull(), "alias").when(F.col("terminal"), "terminal").when(F.col("disposition") == "pruned", "pruned").when(F.col("child_count") == 0, "leaf").otherwise("useful")
    return load(spark, sf_dir, "lazy_trace_nodes").select("node_id", c.alias("class")).distinct()


@R.add("data17_equal_mass", "SELECT c_custkey, round(1.0::DOUBLE / count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) / (SELECT count(DISTINCT x.c_nationkey) FROM customer x WHERE x.c_mktsegment = customer.c_mktsegment), 12) AS weight FROM customer")
def data17_equal_mass(spark, sf_dir):
    return ds.equal_mass_weights(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_mktsegment", "c_nationkey").select("c_custkey", F.round("weight", 12).alias("weight"))


@R.add("data18_capped_negatives", "SELECT c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_acctbal > 8000 ORDER BY sha256(CAST(c_custkey AS VARCHAR)), c_custkey) AS r FROM customer) WHERE c_acctbal > 8000 OR r <= 4")
def data18_capped_negatives(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return ds.capped_negatives(c, "c_nationkey", F.col("c_acctbal") > 8000, F.sha2(F.col("c_custkey").cast("string"), 256), "c_custkey", 4).select("c_custkey")


@R.add("data19_risk_threshold", "WITH s AS (SELECT p_size AS score, count(*) FILTER (WHERE p_retailprice > 1300) AS p FROM part GROUP BY 1), u AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS upto, sum(p) OVER () AS total FROM s) SELECT max(score) AS threshold FROM u WHERE upto >= 0.9 * total")
def data19_risk_threshold(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_size").alias("score"), (F.col("p_retailprice") > 1300).alias("good"))
    return ds.risk_threshold(p, "score", "good", 0.9)


@R.add("data20_fold_metrics", "SELECT stage, count(DISTINCT project) AS folds, round(avg(m), 9) AS mean FROM (SELECT stage, project, avg(CAST(target AS DOUBLE)) AS m FROM (SELECT DISTINCT example_id, branch_id, stage, project, target FROM search_examples) WHERE project IS NOT NULL GROUP BY 1, 2) GROUP BY stage")
def data20_fold_metrics(spark, sf_dir):
    e = load(spark, sf_dir, "search_examples").select("example_id", "branch_id", "stage", "project", "target").distinct().where("project is not null")
    f = e.groupBy("stage", "project").agg(F.avg(F.col("target").cast("double")).alias("m"))
    return f.groupBy("stage").agg(F.count_distinct("project").alias("folds"), F.round(F.avg("m"), 9).alias("mean"))


@R.add("data22_missing_domains", "SELECT b.p_brand, s.s AS size FROM (SELECT DISTINCT p_brand FROM part) b, (VALUES (1), (7), (13)) s(s) WHERE NOT EXISTS (SELECT 1 FROM part WHERE part.p_brand = b.p_brand AND p_size = s.s)")
def data22_missing_domains(spark, sf_dir):
    """Parameter domains not covered yet: wanted settings per brand minus those that exist."""
    p = load(spark, sf_dir, "part")
    wanted = p.select("p_brand").distinct().select("p_brand", F.explode(F.array(*[F.lit(x) for x in (1, 7, 13)])).alias("size"))
    have = p.select(F.col("p_brand").alias("b"), F.col("p_size").alias("s")).distinct()
    return wanted.join(have, (F.col("p_brand") == F.col("b")) & (F.col("size") == F.col("s")), "left_anti")


@R.add("data23_root_families", r"SELECT sample_id, CASE WHEN regexp_matches(name, 'blk\.0\.') THEN 'first' WHEN regexp_matches(name, 'blk\.[1-9]\.') THEN 'early' WHEN name LIKE 'blk.%' THEN 'late' ELSE 'other' END AS family, regexp_extract(name, '([a-z0-9]+)$', 1) AS short FROM (SELECT DISTINCT sample_id, name FROM profile_samples) WHERE name IS NOT NULL")
def data23_root_families(spark, sf_dir):
    n = load(spark, sf_dir, "profile_samples").select("sample_id", "name").distinct().where("name is not null")
    family = derived.first_match(F.col("name"), [("first", r"blk\.0\."), ("early", r"blk\.[1-9]\."), ("late", r"^blk\.")], F.lit("other"))
    return n.select("sample_id", family.alias("family"), F.regexp_extract("name", "([a-z0-9]+)$", 1).alias("short"))


@R.add("src03_content_ids", """SELECT o_orderkey, sha256('{"key":"' || o_orderkey || '","priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS id FROM orders""")
def src03_content_ids(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", ds.content_id({"status": F.col("o_orderstatus"), "key": F.col("o_orderkey"), "priority": F.col("o_orderpriority")}).alias("id"))


@R.add("src05_references", "SELECT o_orderkey, c_custkey AS customer_id FROM (SELECT o_orderkey, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS ref FROM orders) LEFT JOIN customer ON c_name = ref")
def src05_references(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("ref"))
    return ds.materialize_references(o, "ref", load(spark, sf_dir, "customer"), "c_name", "c_custkey", "customer_id")


# ---- plan search

_DIMS = {"token": [1, 2, 4, 8, 16], "sequence": [1, 2, 4, 8], "sharing": ["independent", "sibling"], "traversal": ["token_major", "weight_major", "mixed"], "policy": ["latency_first", "prompt", "decode", "mixed", "continuous_batch", "throughput_first"], "speculative": [False, True]}
_WEIGHTS = {"interactive": 0.4, "prompt": 0.2, "concurrent": 0.3, "kv_pressure": 0.1}


def _values(name: str, xs: list) -> str:
    return "(VALUES " + ", ".join(f"({repr(x) if isinstance(x, str) else str(x).lower()})" for x in xs) + f") {name}_({name})"


_GRID = "x AS (SELECT * FROM " + ", ".join(_values(k, v) for k, v in _DIMS.items()) + ")"
_REASON = "CASE WHEN sharing <> 'independent' THEN 'projection sharing not admitted' WHEN speculative THEN 'speculation without commit contract' WHEN policy IN ('decode','latency_first','continuous_batch','throughput_first') AND token > 1 THEN 'future tokens without speculation' WHEN policy = 'latency_first' AND sequence <> 1 THEN 'latency policy fixes one sequence' WHEN traversal = 'weight_major' AND token * sequence < 4 THEN 'weight-major needs four rows' WHEN traversal = 'token_major' AND sequence > 1 THEN 'token-major can''t join sequences' END"


@R.add("plan01_legality", f"WITH {_GRID} SELECT coalesce({_REASON}, 'legal') AS reason, count(*) AS n FROM x GROUP BY 1")
def plan01_legality(spark, sf_dir):
    x = ps.grid(spark, _DIMS).withColumn("reason", F.coalesce(ps.traversal_legality(), F.lit("legal")))
    return x.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _plans(spark) -> DataFrame:
    x = ps.grid(spark, _DIMS).where(ps.traversal_legality().isNull())
    return x.select("token", "sequence", "traversal", "policy", *[c.alias(n) for n, c in ps.traversal_estimate(_WEIGHTS, 1.5).items()])


_EST = f"""{_GRID}, y AS (SELECT *, CASE policy WHEN 'decode' THEN 100 WHEN 'mixed' THEN 250 WHEN 'continuous_batch' THEN 500 WHEN 'throughput_first' THEN 1000 ELSE 0 END AS wait, greatest(1, token * sequence) AS lanes FROM x WHERE {_REASON} IS NULL),
    z AS (SELECT *, CASE WHEN traversal IN ('weight_major','mixed') AND lanes >= 4 THEN lanes ELSE 1 END AS reuse, CASE WHEN sequence = 1 AND wait = 0 THEN 1.0::DOUBLE ELSE greatest(0.9::DOUBLE, 1.0 - wait * (CASE WHEN policy IN ('continuous_batch','throughput_first') THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END) / 10000.0) END AS interactive FROM y),
    e AS (SELECT token, sequence, traversal, policy, interactive, lanes * 1.5::DOUBLE / ceil(lanes / CAST(reuse AS DOUBLE)) AS macs, CAST(wait AS DOUBLE) AS queue_us, interactive * 0.4::DOUBLE + (1.0 + 0.01::DOUBLE * log2(token)) * 0.2::DOUBLE + (1.0 + 0.02::DOUBLE * (reuse - 1)) * 0.3::DOUBLE + (1.0 + 0.02::DOUBLE * (reuse - 1)) * (CASE WHEN sequence > 4 THEN 0.99::DOUBLE ELSE 1.0 END) * 0.1::DOUBLE AS score FROM z)"""


@R.add("plan01_estimates", f"WITH {_EST} SELECT token, sequence, traversal, policy, round(score, 9) AS score, round(interactive, 9) AS interactive, round(macs, 9) AS macs, queue_us FROM e")
def plan01_estimates(spark, sf_dir):
    return _plans(spark).select("token", "sequence", "traversal", "policy", *[F.round(c, 9).alias(c) for c in ("score", "interactive", "macs")], "queue_us")


@R.add("plan01_frontier", f"WITH {_EST} SELECT token, sequence, traversal, policy FROM (SELECT * FROM e WHERE interactive >= 0.95) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM e WHERE interactive >= 0.95) b WHERE round(b.score, 9) >= round(a.score, 9) AND b.macs >= a.macs AND b.queue_us <= a.queue_us AND (round(b.score, 9) > round(a.score, 9) OR b.macs > a.macs OR b.queue_us < a.queue_us))")
def plan01_frontier(spark, sf_dir):
    p = _plans(spark).where("interactive >= 0.95").withColumn("score", F.round("score", 9))
    return rel.pareto(p, ["score", "macs"], ["queue_us"], "token").select("token", "sequence", "traversal", "policy")


_WIDE = "SELECT * FROM e WHERE interactive >= 0.9"


def _beam_sql(width: int, depth: int) -> str:
    """Beam steps written out: neighbours change one setting to the next value in its list."""
    def near(name: str, values: list) -> str:
        lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
        return f"(abs(list_position([{', '.join(map(lit, values))}], a.{name}) - list_position([{', '.join(map(lit, values))}], b.{name})) = 1)"
    names = ["token", "sequence", "traversal", "policy"]
    one = " OR ".join("(" + near(n, _DIMS[n]) + "".join(f" AND a.{m} = b.{m}" for m in names if m != n) + ")" for n in names)
    key = "token || '|' || sequence || '|' || traversal || '|' || policy"
    out = f"{_EST}, w AS (SELECT *, {key} AS k FROM ({_WIDE})), b0 AS (SELECT * FROM w WHERE token = 1 AND sequence = 1 ORDER BY round(score, 9) DESC, k LIMIT {width})"
    for d in range(1, depth + 1):
        out += f", b{d} AS (SELECT DISTINCT b.* FROM b{d - 1} a JOIN w b ON {one} ORDER BY round(b.score, 9) DESC, b.k LIMIT {width})"
    return f"WITH {out} " + " UNION ALL ".join(f"SELECT {d} AS step, token, sequence, traversal, policy FROM b{d}" for d in range(depth + 1))


@R.add("rank13_beam", _beam_sql(6, 3))
def rank13_beam(spark, sf_dir):
    """Beam over plans: from single-row plans on, a step changes one setting to a neighbouring value."""
    names = ["token", "sequence", "traversal", "policy"]
    w = _plans(spark).where("interactive >= 0.9").select(*names, F.round("score", 9).alias("score"), F.concat_ws("|", *names).alias("k"))
    place = lambda n, c: F.array_position(F.array(*[F.lit(v) for v in _DIMS[n]]), c)

    def expand(front: DataFrame) -> DataFrame:
        a = front.select(*[F.col(n).alias(f"a_{n}") for n in names])
        step = F.lit(False)
        for n in names:
            one = F.abs(place(n, F.col(f"a_{n}")) - place(n, F.col(n))) == 1
            for m in names:
                one = one & (F.col(f"a_{m}") == F.col(m)) if m != n else one
            step = step | one
        return w.join(F.broadcast(a), step, "left_semi")  # the front holds at most ``width`` rows

    return ps.beam(w.where("token = 1 and sequence = 1"), expand, "score", "k", 6, 3).select("step", *names)


_SM = {"warp": 32, "register_unit": 256, "threads": 2048, "warps": 64, "registers": 65536, "shared": 102400, "blocks": 32, "block_threads": 1024}
_GPU = {"local": [32, 64, 128, 256, 512, 1024], "unroll": [1, 2, 4], "vector": [1, 2, 4], "staged": [False, True]}


@R.add("plan02_enumeration", "WITH x AS (SELECT * FROM " + ", ".join(_values(k, v) for k, v in _GPU.items()) + ") SELECT local, unroll, vector, staged FROM x WHERE local * vector <= 2048 ORDER BY local, unroll, vector, staged LIMIT 256")
def plan02_enumeration(spark, sf_dir):
    return ps.grid(spark, _GPU).where("local * vector <= 2048").orderBy("local", "unroll", "vector", "staged").limit(256)


@R.add("plan03_occupancy", "WITH x AS (SELECT *, 24 + greatest(0, unroll - 1) * 2 + greatest(0, vector - 1) AS regs, CASE WHEN staged THEN local * 4 * vector ELSE 0 END AS sh FROM " + ", ".join(_values(k, v) for k, v in _GPU.items()) + "), y AS (SELECT *, least(2048 // local, 64 // CAST(ceil(local / 32.0) AS BIGINT), 65536 // CAST(ceil(regs * local / 256.0) * 256 AS BIGINT), CASE WHEN sh > 0 THEN 102400 // sh ELSE 32 END, 32) AS resident FROM x) SELECT local, unroll, vector, staged, CAST(resident AS BIGINT) AS resident, round(least(1.0, resident * ceil(local / 32.0) / 64.0), 9)::DOUBLE AS occupancy FROM y")
def plan03_occupancy(spark, sf_dir):
    x = ps.grid(spark, _GPU)
    regs = F.lit(24) + F.greatest(F.lit(0), F.col("unroll") - 1) * 2 + F.greatest(F.lit(0), F.col("vector") - 1)
    o = ps.occupancy(F.col("local"), regs, F.when(F.col("staged"), F.col("local") * 4 * F.col("vector")).otherwise(0), _SM)
    return x.select("local", "unroll", "vector", "staged", o["resident"].cast("bigint").alias("resident"), F.round(o["occupancy"], 9).alias("occupancy"))


_OPS = "o AS (SELECT plan, l, d, fixed, row_number() OVER (PARTITION BY plan ORDER BY l) AS k, count(*) OVER (PARTITION BY plan) AS n FROM (SELECT l_orderkey AS plan, l_linenumber AS l, sum(l_quantity) AS d, bool_or(l_returnflag = 'R') AS fixed FROM lineitem GROUP BY 1, 2))"
_SCHEDULE = """t AS (SELECT plan, n, bits, 0::BIGINT AS k, 0.0::DOUBLE AS f0, 0.0::DOUBLE AS f1, 0.0::DOUBLE AS e1, 0.0::DOUBLE AS e2, 0.0::DOUBLE AS m FROM w
      UNION ALL SELECT plan, n, bits, k, CASE WHEN q = 0 THEN done ELSE f0 END, CASE WHEN q = 1 THEN done ELSE f1 END, done, e1, greatest(m, done) FROM (
        SELECT t.plan, t.n, t.bits, o.k, f0, f1, e1, m, (t.bits >> (t.n - o.k)) & 1 AS q, greatest(CASE WHEN (t.bits >> (t.n - o.k)) & 1 = 0 THEN f0 ELSE f1 END, CASE WHEN o.k >= 3 AND o.k % 2 = 1 THEN e2 ELSE 0.0 END) + o.d AS done
        FROM t JOIN o ON o.plan = t.plan AND o.k = t.k + 1 WHERE NOT (o.fixed AND (t.bits >> (t.n - o.k)) & 1 = 1)))"""


def _operations(spark, sf_dir) -> DataFrame:
    """An order is a plan, its line numbers (seven at most) are operations; every odd one from the third on waits for the one before last;
    what was returned must be computed."""
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("l")).agg(F.sum("l_quantity").alias("d"), F.bool_or(F.col("l_returnflag") == "R").alias("fixed"), F.max("l_linestatus").alias("status"))
    ops = lines.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("l", "d", "fixed", "status"))).alias("ops"))
    after = F.transform("ops", lambda o, k: F.when((k >= 2) & (k % 2 == 0), F.array((k - 2).cast("int"))))
    return ops.select("plan", F.transform("ops", lambda o: o.d).alias("durations"), after.alias("after"), F.transform("ops", lambda o: F.when(o.fixed, F.array(F.lit("compute")))).alias("allowed"),
                      F.transform("ops", lambda o: F.array(F.when(o.status == "F", "compute").otherwise("copy"))).alias("given"))


@R.add("plan04_queue_assignment", f"""WITH RECURSIVE {_OPS}, w AS (SELECT plan, n, unnest(range(1 << n)) AS bits FROM (SELECT DISTINCT plan, n FROM o)), {_SCHEDULE},
    b AS (SELECT plan, n, min(round(m, 6)) AS makespan, arg_min(bits, (round(m, 6), bits)) AS bits, count(*) AS legal FROM t WHERE k = n GROUP BY plan, n) SELECT plan, makespan, legal, array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN (bits >> (n - i)) & 1 = 0 THEN 'compute' ELSE 'copy' END), ',') AS assignment FROM b""")
def plan04_queue_assignment(spark, sf_dir):
    """Best of all allowed queue assignments of every plan's operations by makespan."""
    return ps.best_schedules(_operations(spark, sf_dir), ["compute", "copy"]).select("plan", "assignment", F.round("makespan", 6).alias("makespan"), "legal")


_GIVEN = "w AS (SELECT plan, n, CAST(sum(CASE WHEN status = 'F' THEN 0 ELSE 1 << (n - k) END) AS BIGINT) AS bits FROM (SELECT o.*, s.status FROM o JOIN (SELECT l_orderkey AS plan, l_linenumber AS l, max(l_linestatus) AS status FROM lineitem GROUP BY 1, 2) s ON s.plan = o.plan AND s.l = o.l) GROUP BY plan, n)"


@R.add("stream14_makespan", f"WITH RECURSIVE {_OPS.replace(chr(39) + 'R' + chr(39), chr(39) + chr(39))}, {_GIVEN}, {_SCHEDULE} SELECT plan, round(m, 6) AS makespan FROM t WHERE k = n")
def stream14_makespan(spark, sf_dir):
    """Makespan of every plan on the queues its operations are given to."""
    o = _operations(spark, sf_dir)
    return ps.best_schedules(o.withColumn("allowed", F.col("given")), ["compute", "copy"]).select("plan", F.round("makespan", 6).alias("makespan"))


#: rules of the search: name, factor on the cost
_RULES = [("fuse", 0.9), ("tile", 0.95), ("vector", 0.92)]


def _rules_sql(width: int, depth: int) -> str:
    legal = "NOT contains(s.rules, r.f) AND NOT (r.f = 'fuse' AND s.k % 2 = 1) AND NOT (r.f = 'vector' AND NOT contains(s.rules, 'tile'))"
    out = f"r AS (SELECT * FROM (VALUES {', '.join(f'({n!r}, {x}::DOUBLE)' for n, x in _RULES)}) v(f, x)), s0 AS (SELECT p_partkey AS k, '' AS rules, p_retailprice AS c FROM part ORDER BY round(-c, 6) DESC, k || ':' LIMIT {width})"
    for d in range(1, depth + 1):
        out += f", s{d} AS (SELECT k, rules, max(c) AS c FROM (SELECT s.k, array_to_string(list_sort(list_append(CASE WHEN s.rules = '' THEN [] ELSE string_split(s.rules, '+') END, r.f)), '+') AS rules, s.c * r.x AS c FROM s{d - 1} s JOIN r ON {legal}) GROUP BY k, rules ORDER BY round(-max(c), 6) DESC, k || ':' || rules LIMIT {width})"
    return f"WITH {out} " + " UNION ALL ".join(f"SELECT {d} AS step, k, rules, round(c, 6) AS cost FROM s{d}" for d in range(depth + 1))


@R.add("plan05_rule_search", _rules_sql(20, 3))
def plan05_rule_search(spark, sf_dir):
    """Rules with cost factors over all parts: a step applies one more legal rule to a state, and the cheapest twenty go on."""
    s = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.lit("").alias("rules"), F.col("p_retailprice").alias("c"))
    named = lambda df: df.withColumn("score", F.round(-F.col("c"), 6)).withColumn("key", F.concat(F.col("k").cast("string"), F.lit(":"), "rules"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.lit(v).alias("x")) for n, v in _RULES]))

    def expand(front: DataFrame) -> DataFrame:
        r = front.select("k", "rules", "c", rules.alias("r"))
        r = r.where(~F.contains("rules", F.col("r.f")) & ~((F.col("r.f") == "fuse") & (F.col("k") % 2 == 1)) & ~((F.col("r.f") == "vector") & ~F.contains("rules", F.lit("tile"))))
        grown = F.array_join(F.array_sort(F.array_append(F.when(F.col("rules") == "", F.array().cast("array<string>")).otherwise(F.split("rules", r"\+")), F.col("r.f"))), "+")
        return named(r.select("k", grown.alias("rules"), (F.col("c") * F.col("r.x")).alias("c")))

    return ps.beam(named(s), expand, "score", "key", 20, 3).select("step", "k", "rules", F.round("c", 6).alias("cost"))


def _trace_sql() -> str:
    return f"x AS (SELECT node_id AS k, max(nullif(nullif(trim(parent_id), ''), '-')) AS p, max(coalesce(CASE WHEN isnan(decision_confidence) THEN NULL ELSE decision_confidence END, 0)) AS c, CAST(1 + max(coalesce(child_count, 0)) AS DOUBLE) AS w FROM lazy_trace_nodes WHERE node_id IS NOT NULL GROUP BY 1)"


def _lazy_sql(batch: int, rounds: int, budget: float) -> str:
    out = f"{_trace_sql()}, o0 AS (SELECT k, c, w FROM x WHERE p IS NULL OR p NOT IN (SELECT k FROM x))"
    for r in range(rounds):
        before = f"coalesce((SELECT max(spent) FROM t{r - 1}), 0)" if r else "0"
        place = f"coalesce((SELECT max(place) FROM t{r - 1}), 0)" if r else "0"
        whole = f" AND (SELECT count(*) FROM t{r - 1}) = least({batch}, (SELECT count(*) FROM o{r - 1}))" if r else ""
        out += f", t{r} AS (SELECT * FROM (SELECT k, c, w, {r} AS round, {place} + row_number() OVER v AS place, {before} + sum(w) OVER v AS spent FROM (SELECT * FROM o{r} ORDER BY c DESC, k LIMIT {batch}) WINDOW v AS (ORDER BY c DESC, k ROWS UNBOUNDED PRECEDING)) WHERE spent <= {budget}{whole})"
        out += f", o{r + 1} AS (SELECT * FROM o{r} WHERE k NOT IN (SELECT k FROM t{r}) UNION ALL SELECT x.k, x.c, x.w FROM x JOIN t{r} ON x.p = t{r}.k)"
    return f"WITH {out} " + " UNION ALL ".join(f"SELECT k AS state, round, place, spent FROM t{r}" for r in range(rounds))


@R.add("plan06_best_first", _lazy_sql(40, 4, 400.0))
def plan06_best_first(spark, sf_dir):
    """Best-first over the trace's states by confidence, forty at a time, within 160 states and 400 units of work (one and one per child)."""
    n = load(spark, sf_dir, "lazy_trace_nodes").where("node_id is not null")
    parent = F.nullif(F.nullif(F.trim("parent_id"), F.lit("")), F.lit("-"))
    x = n.groupBy(F.col("node_id").alias("k")).agg(F.max(parent).alias("p"), F.max(F.coalesce(F.when(~F.isnan("decision_confidence"), F.col("decision_confidence")), F.lit(0.0))).alias("c"), (1 + F.max(F.coalesce("child_count", F.lit(0)))).cast("double").alias("w"))
    there = x.select(F.col("k").alias("pk"))
    start = x.join(there, F.col("p") == F.col("pk"), "left_anti").select("k", "c", "w")

    def expand(front: DataFrame) -> DataFrame:
        return x.join(front.select(F.col("k").alias("f")), F.col("p") == F.col("f"), "left_semi").select("k", "c", "w")

    return ps.best_first(start, expand, "c", "w", "k", 40, 160, 400.0).select(F.col("k").alias("state"), "round", "place", "spent")


_ACTIONS = f"a AS (SELECT DISTINCT {sql_name('project')} AS g, action.family AS f FROM search_examples WHERE {sql_name('project')} IS NOT NULL AND action.family IS NOT NULL)"


def _actions(spark, sf_dir) -> DataFrame:
    """g, f: the action families known in each project."""
    e = load(spark, sf_dir, "search_examples").select(name_key(F.col("project")).alias("g"), F.col("action.family").alias("f"))
    return e.where("g is not null and f is not null").distinct()


@R.add("plan07_canonical_levels", f"""WITH {_ACTIONS}, n AS (SELECT g, count(*) AS n FROM a GROUP BY g), k AS (SELECT unnest([1, 2, 3]) AS step),
    c AS (SELECT step, CASE step WHEN 1 THEN n WHEN 2 THEN n * (n - 1) ELSE n * (n - 1) // 2 * (n - 2) END AS raw, CASE step WHEN 1 THEN n WHEN 2 THEN n * (n - 1) // 2 ELSE n * (n - 1) * (n - 2) // 6 END AS fresh FROM n, k)
    SELECT step, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(fresh) AS BIGINT) AS fresh, CAST(sum(raw) - sum(fresh) AS BIGINT) AS repeated FROM c GROUP BY step""")
def plan07_canonical_levels(spark, sf_dir):
    """Canonical search over sets of actions of each project: successors per step, and how many are states seen before."""
    a = _actions(spark, sf_dir)

    def expand(front: DataFrame) -> DataFrame:
        step = front.join(a.select(F.col("g").alias("ga"), "f"), F.col("g") == F.col("ga")).where(~F.array_contains("acts", F.col("f")))
        step = step.select("g", F.array_sort(F.array_append("acts", F.col("f"))).alias("acts"), "paths")
        return step.withColumn("key", F.concat_ws("|", "g", F.array_join("acts", "+")))

    start = a.select("g").distinct().select("g", F.array().cast("array<string>").alias("acts"), F.col("g").alias("key"))
    return ps.canonical_search(start, expand, "key", 3)[1]


@R.add("plan08_exhaustive", f"""WITH RECURSIVE {_ACTIONS}, s AS (SELECT DISTINCT g, CAST([] AS VARCHAR[]) AS acts, 0 AS step FROM a UNION ALL SELECT s.g, list_append(s.acts, a.f), s.step + 1 FROM s JOIN a ON a.g = s.g AND NOT list_contains(s.acts, a.f) WHERE s.step < 3)
    SELECT g, step, count(*) AS sequences, count(DISTINCT list_sort(acts)) AS states FROM s WHERE step > 0 GROUP BY g, step""")
def plan08_exhaustive(spark, sf_dir):
    """Every sequence of up to three different actions of a project, unreduced: what the canonical search is compared with."""
    a = _actions(spark, sf_dir)
    level = a.select("g").distinct().withColumn("acts", F.array().cast("array<string>"))
    out = None
    for k in (1, 2, 3):
        level = level.join(a.select(F.col("g").alias("ga"), "f"), F.col("g") == F.col("ga")).where(~F.array_contains("acts", F.col("f"))).select("g", F.array_append("acts", F.col("f")).alias("acts"))
        out = level.withColumn("step", F.lit(k)) if out is None else out.unionByName(level.withColumn("step", F.lit(k)))
    return out.groupBy("g", "step").agg(F.count(F.lit(1)).alias("sequences"), F.count_distinct(F.array_sort("acts")).alias("states"))


@R.add("plan09_dominance", "SELECT a.l_orderkey AS dominated, b.l_orderkey AS dominator FROM (SELECT l_orderkey, list(DISTINCT l_returnflag || l_linestatus) AS s FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey, list(DISTINCT l_returnflag || l_linestatus) AS s FROM lineitem GROUP BY 1) b ON b.l_orderkey = a.l_orderkey + 1 WHERE list_has_all(b.s, a.s)")
def plan09_dominance(spark, sf_dir):
    """A proposal (the next order) dominates if it reaches everything that is reached here."""
    s = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("s"))
    b = s.select((F.col("l_orderkey") - 1).alias("k"), F.col("l_orderkey").alias("dominator"), F.col("s").alias("t"))
    return s.join(b, F.col("l_orderkey") == F.col("k")).where(F.size(F.array_except("s", "t")) == 0).select(F.col("l_orderkey").alias("dominated"), "dominator")


@R.add("plan10_equivalence_classes", """WITH RECURSIVE e AS (SELECT DISTINCT node_id AS a, nullif(trim(canonical_of), '') AS b FROM lazy_trace_nodes WHERE node_id IS NOT NULL), u AS (SELECT a, b FROM e WHERE b IS NOT NULL UNION SELECT b, a FROM e WHERE b IS NOT NULL),
    n AS (SELECT a AS v FROM e UNION SELECT b FROM u), c AS (SELECT v AS a, v AS b FROM n UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a) SELECT a AS v, min(b) AS component FROM c GROUP BY a""")
def plan10_equivalence_classes(spark, sf_dir):
    """States and what they are said to be equal to close to classes by union-find over tables."""
    from ..operators.components import connected_components
    e = load(spark, sf_dir, "lazy_trace_nodes").where("node_id is not null").select(F.col("node_id").alias("a"), F.nullif(F.trim("canonical_of"), F.lit("")).alias("b"))
    return connected_components(e, "a", "b")


@R.add("plan11_cost_gate", "SELECT p_partkey, CASE WHEN p_size < 5 THEN 'raw' WHEN p_retailprice / p_size > 100 THEN 'reduced' ELSE 'probe' END AS mode FROM part")
def plan11_cost_gate(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") < 5, "raw").when(F.col("p_retailprice") / F.col("p_size") > 100, "reduced").otherwise("probe").alias("mode"))


@R.add("plan13_grammar_coverage", """WITH RECURSIVE g AS (SELECT DISTINCT graph_hash, nodes, edges FROM projection_graphs), n AS (SELECT DISTINCT graph_hash, n.id AS id, n.kind AS kind FROM (SELECT graph_hash, unnest(nodes) AS n FROM g) WHERE n.kind IS NOT NULL),
    r AS (SELECT s.kind AS a, d.kind AS b, count(*) AS uses FROM (SELECT DISTINCT graph_hash, e.id, e.src, e.dst FROM (SELECT graph_hash, unnest(edges) AS e FROM g)) e JOIN n s ON s.graph_hash = e.graph_hash AND s.id = e.src JOIN n d ON d.graph_hash = e.graph_hash AND d.id = e.dst GROUP BY 1, 2),
    c AS (SELECT a, b FROM r UNION SELECT c.a, r.b FROM c JOIN r ON c.b = r.a) SELECT a AS kind, max(u.uses) AS uses, count(*) AS reaches FROM c JOIN (SELECT a AS k, CAST(sum(uses) AS BIGINT) AS uses FROM r GROUP BY a) u ON u.k = c.a GROUP BY a""")
def plan13_grammar_coverage(spark, sf_dir):
    """The grammar in use: which kinds of node follow which, how often, and how many kinds each reaches through such rules."""
    from ..operators.graph import transitive_closure
    p = load(spark, sf_dir, "projection_graphs")
    n = p.select("graph_hash", F.explode("nodes").alias("n")).where("n.kind is not null").select("graph_hash", F.col("n.id").alias("id"), F.col("n.kind").alias("kind")).distinct()
    e = p.select("graph_hash", F.explode("edges").alias("e")).select("graph_hash", F.col("e.id").alias("eid"), "e.src", "e.dst").distinct()
    s, d = n.toDF("sg", "sid", "a"), n.toDF("dg", "did", "b")
    r = e.join(s, (F.col("graph_hash") == F.col("sg")) & (F.col("src") == F.col("sid"))).join(d, (F.col("graph_hash") == F.col("dg")) & (F.col("dst") == F.col("did")))
    r = Scratch(spark).keep(r.groupBy("a", "b").agg(F.count(F.lit(1)).alias("uses")))
    reach = transitive_closure(r, "a", "b").groupBy(F.col("a").alias("kind")).agg(F.count(F.lit(1)).alias("reaches"))
    return reach.join(r.groupBy(F.col("a").alias("k")).agg(F.sum("uses").alias("uses")), F.col("kind") == F.col("k")).drop("k")


#: fixed values: archetypes, and the parts of words that are evidence of each
_ARCHETYPES = {
    "stable-partition-prefix-scatter": ["stable_partition", "partition", "prefix", "scan", "scatter", "compact"],
    "sparse-indexed-update": ["operator[]", "index", "lookup", "patch", "delta", "dirty"],
    "parse-validate-materialize": ["parse", "decode", "validate", "serialize", "encode", "materialize"],
    "retained-cache-conditional-patch": ["lookup", "has_value", "insert", "erase", "swap", "assign", "load"],
    "state-transition-coalescing": ["coalesce", "publish", "commit", "rollback", "advance", "retire", "detach"],
    "structured-traversal-fusion": ["operator->", "getelementptr", "loop", "traverse"],
    "realization-lifetime": ["reserve", "resize", "clear", "emplace", "push_back", "allocat", "release"],
}
_ARCH_SQL = "[" + ", ".join(f"{{'id': '{k}', 'evidence': list_filter({v}, lambda n: contains(t, n))}}" for k, v in _ARCHETYPES.items()) + "]"
_ROUTE_SQL = "CASE WHEN list_contains(ids, 'state-transition-coalescing') THEN 'finite_protocol_plan_then_local_lowerer' WHEN len(ids) > 0 THEN 'architectural_realization_plan_adapter_required' ELSE 'no_supported_structured_archetype' END"


@R.add("plan14_archetypes", f"""WITH x AS (SELECT doc_id, list_filter({_ARCH_SQL}, lambda a: len(a.evidence) > 0) AS found FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)), y AS (SELECT doc_id, found, list_transform(found, lambda a: a.id) AS ids FROM x)
    SELECT doc_id, array_to_string(list_transform(found, lambda a: a.id || ':' || array_to_string(a.evidence, '+') || ':' || CASE WHEN len(a.evidence) >= 2 THEN 'high' ELSE 'medium' END), ' ') AS archetypes, {_ROUTE_SQL} AS route FROM y""")
def plan14_archetypes(spark, sf_dir):
    """Archetypes a text gives evidence of, with the evidence and how sure it makes, and the route that follows."""
    d = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.lower("text").alias("t"))
    every = F.array(*[F.struct(F.lit(k).alias("id"), F.filter(F.array(*[F.lit(x) for x in v]), lambda n: F.contains(F.col("t"), n)).alias("evidence")) for k, v in _ARCHETYPES.items()])
    d = d.select("doc_id", F.filter(every, lambda a: F.size(a.evidence) > 0).alias("found"))
    ids = F.transform("found", lambda a: a.id)
    route = F.when(F.array_contains(ids, "state-transition-coalescing"), "finite_protocol_plan_then_local_lowerer").when(F.size("found") > 0, "architectural_realization_plan_adapter_required").otherwise("no_supported_structured_archetype")
    shown = F.transform("found", lambda a: F.concat(a.id, F.lit(":"), F.array_join(a.evidence, "+"), F.lit(":"), F.when(F.size(a.evidence) >= 2, "high").otherwise("medium")))
    return d.select("doc_id", F.array_join(shown, " ").alias("archetypes"), route.alias("route"))


#: fixed values: patterns of facts a text may state, in the syntax both engines share
_FACTS = {
    "max_elements": r"(?i)(?:limit|max|bound|capacity)[ _:=]{1,3}([0-9]{1,9})",
    "element_bits": r"u?int(8|16|32|64)_t",
    "byte_order": r"(?i)(big|little)[ -]endian",
    "capacity_policy": r"(?i)(unchanged|truncat|fail)",
    "aliasing": r"(?i)(disjoint|in-place|alias)",
    "no_growth": r"(?i)(caller-owned|preallocated|no growth|no-growth)",
}


@R.add("plan15_contracts", f"""WITH x AS (SELECT doc_id, {', '.join(f"nullif(regexp_extract(text, '{p}', 1), '') AS {n}" for n, p in _FACTS.items())}, len(regexp_extract_all(text, '0x[0-9a-f]+')) AS addresses FROM documents WHERE text IS NOT NULL)
    SELECT *, array_to_string(list_filter([{', '.join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in _FACTS)}], lambda u: u IS NOT NULL), ' ') AS unresolved, CASE WHEN {' AND '.join(f'{n} IS NOT NULL' for n in _FACTS)} THEN 'complete' ELSE 'contract_blocked' END AS status FROM x""")
def plan15_contracts(spark, sf_dir):
    """Facts of a bounded contract that a text states, what stays unresolved, and whether the contract is complete."""
    facts = {n: F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for n, p in _FACTS.items()}
    d = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", *[c.alias(n) for n, c in facts.items()], F.size(F.regexp_extract_all("text", F.lit("(0x[0-9a-f]+)"), 1)).cast("bigint").alias("addresses"))
    unresolved = F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in _FACTS]))
    return d.select("*", F.array_join(unresolved, " ").alias("unresolved"), F.when(F.size(unresolved) == 0, "complete").otherwise("contract_blocked").alias("status"))


#: fixed values: rules in order, each a decision and what it rests on; f: promoted, integrated, measured, exhausted, proved, reachable, gain, represented
_DECISIONS = [
    ("promoted AND integrated", "STOP", "objective reached"),
    ("promoted", "CONTINUE", "local gates passed, application open"),
    ("measured AND exhausted", "STOP", "search did not meet the floor"),
    ("measured", "ESCALATE", "negative result is limited by the grammar"),
    ("proved", "CONTINUE", "measurement is next"),
    ("NOT reachable", "ESCALATE", "a stage can't be reached"),
    ("gain < 0.05D", "STOP", "optimistic gain is below the floor"),
    ("represented < 0.25D", "ESCALATE", "too weakly representative"),
]
_STATES = {
    "promoted": "list_contains(o, 'faster') AND coalesce(grade = 'A', false)", "integrated": "coalesce(base, false)", "measured": "list_has_any(o, ['faster', 'slower', 'identical'])", "exhausted": "coalesce(status = 'exhaustive', false)",
    "proved": "list_contains(o, 'proved')", "reachable": "coalesce(state <> 'deferred', false)", "gain": "coalesce(target, 0) / 100.0::DOUBLE * 0.25::DOUBLE", "represented": "CASE quality WHEN 'full' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END",
}


@R.add("plan16_economic_decision", f"""WITH x AS (SELECT DISTINCT example_id, branch_id, coalesce(outcomes, []) AS o, quality_grade AS grade, baseline AS base, coverage.children_status AS status, branch_state AS state, target, context_quality AS quality FROM search_examples),
    y AS (SELECT example_id, branch_id, {', '.join(f'{e} AS {n}' for n, e in _STATES.items())} FROM x)
    SELECT decision, reason, count(*) AS n FROM (SELECT CASE {' '.join(f"WHEN {c.replace('D', '') if '0.' in c else c} THEN '{d}'" for c, d, _ in _DECISIONS)} ELSE 'CONTINUE' END AS decision, CASE {' '.join(f"WHEN {c.replace('D', '') if '0.' in c else c} THEN '{r.replace(chr(39), chr(39) * 2)}'" for c, _, r in _DECISIONS)} ELSE 'worth the next stage' END AS reason FROM y) GROUP BY ALL""")
def plan16_economic_decision(spark, sf_dir):
    """Whether to go on with a search, by the evidence it has reached: the first rule that holds, and how often it does."""
    e = load(spark, sf_dir, "search_examples").select("example_id", "branch_id", F.coalesce("outcomes", F.array().cast("array<string>")).alias("o"), "quality_grade", "baseline", F.col("coverage.children_status").alias("status"), "branch_state", "target", "context_quality").distinct()
    no = lambda c: F.coalesce(c, F.lit(False))
    has = lambda *xs: F.arrays_overlap("o", F.array(*[F.lit(x) for x in xs]))
    quality = F.when(F.col("context_quality") == "full", 1.0).when(F.col("context_quality") == "partial", 0.5).otherwise(0.1)
    y = e.select(no(has("faster") & no(F.col("quality_grade") == "A")).alias("promoted"), no(F.col("baseline")).alias("integrated"), no(has("faster", "slower", "identical")).alias("measured"), no(F.col("status") == "exhaustive").alias("exhausted"),
                 no(has("proved")).alias("proved"), no(F.col("branch_state") != "deferred").alias("reachable"), (F.coalesce("target", F.lit(0)) / 100.0 * 0.25).alias("gain"), quality.alias("represented"))
    decision, reason = F.lit("CONTINUE"), F.lit("worth the next stage")
    for condition, what, why in reversed(_DECISIONS):
        decision, reason = F.when(F.expr(condition), what).otherwise(decision), F.when(F.expr(condition), why).otherwise(reason)
    return y.groupBy(decision.alias("decision"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


#: fixed values: what leaves a local unit, in order, and the words that show it
_AUTH = [
    ("device_runtime", r"\b(vk[A-Z][a-z]+|cuda|hip[A-Z][a-z]+)"),
    ("network_io", r"\b(send|recv|socket|connect|accept|poll)\b"),
    ("filesystem_io", r"\b(open|read|write|close|fsync|mmap)\b"),
    ("synchronization", r"\b(atomic|mutex|lock|semaphore|futex|barrier|fence)\b"),
    ("allocation", r"\b(new|delete|malloc|free|reserve|push_back)\b"),
    ("callback", r"\b(callback|visitor|handler)\b"),
    ("exception_unwind", r"\b(throw|try|catch)\b"),
    ("foreign_object_model", r"(pxr::|PyObject|objc_msgSend)"),
    ("dynamic_dispatch", r"\b(dynamic_cast|typeid|virtual)\b"),
]


@R.add("plan17_authorities", "SELECT category, count(*) AS documents, CAST(sum(n) AS BIGINT) AS observations FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS category, len(list_distinct(regexp_extract_all(text, '{p}'))) AS n FROM documents WHERE text IS NOT NULL" for n, p in _AUTH) + ") WHERE n > 0 GROUP BY category")
def plan17_authorities(spark, sf_dir):
    """Per category the documents that show it and the different observations in them: one scan tries all patterns."""
    d = load(spark, sf_dir, "documents").where("text is not null")
    found = F.array(*[F.struct(F.lit(n).alias("category"), F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(p), 0))).alias("n")) for n, p in _AUTH])
    return d.select(F.explode(found).alias("x")).where("x.n > 0").groupBy("x.category").agg(F.count(F.lit(1)).alias("documents"), F.sum("x.n").alias("observations"))


def _batches(spark, sf_dir) -> DataFrame:
    o = load(spark, sf_dir, "events").selectExpr("user_id AS scenario", "event_id AS id", "CAST(event_id * 50 AS DOUBLE) AS arrival_us", "user_id % 40 + 1 AS prompt_tokens", "event_id % 6 + 1 AS generated_tokens")
    return ps.simulate_batches(o, 4, 32, 250.0, 2000.0, [(1, 900.0), (2, 1100.0), (4, 1500.0)])


@R.add("stream10_batch_simulator")
def stream10_batch_simulator(spark, sf_dir):
    """When each request of each scenario gets its first and its last token."""
    return _batches(spark, sf_dir).drop("gaps")


@R.add("stream10_batch_figures")
def stream10_batch_figures(spark, sf_dir):
    """Requests, throughput, makespan, and percentiles of the time to the first token and between tokens, per scenario."""
    return ps.batch_figures(_batches(spark, sf_dir))
