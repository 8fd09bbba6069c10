"""Queries of the aggregate and example-kernel families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import reductions as rd
from ..session import load
from .registry import Registry

R = Registry()


@R.add("a8_fused_multi_reduction", """SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS n, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_linestatus = 'F'), 0) AS BIGINT) AS bytes,
    count(*) FILTER (WHERE l_linestatus = 'F' AND l_discount >= 0.05) AS flagged FROM lineitem GROUP BY l_returnflag""")
def a8_fused_multi_reduction(spark, sf_dir):
    """One scan and one aggregate: count, sum and conditional count of the records of each kind that pass the flag."""
    live = F.col("l_linestatus") == "F"
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(live).alias("n"), F.coalesce(F.sum(F.when(live, F.col("l_quantity").cast("bigint"))), F.lit(0).cast("bigint")).alias("bytes"), F.count_if(live & (F.col("l_discount") >= 0.05)).alias("flagged"))


@R.add("agg01_count_equal", "SELECT CAST(sum(length(text) - length(replace(text, 'e', ''))) AS BIGINT) AS n FROM documents")
def agg01_count_equal(spark, sf_dir):
    return load(spark, sf_dir, "documents").agg(F.sum(rd.count_byte(F.col("text"), "e").cast("bigint")).alias("n"))


@R.add("agg02_count_true", "SELECT l_shipdate >= TIMESTAMP '1995-01-01' AS late, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1")
def agg02_count_true(spark, sf_dir):
    late = F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")
    return load(spark, sf_dir, "lineitem").agg(F.lit(True).alias("late"), F.count_if(late).alias("n"))


@R.add("agg03_count_nonzero", "SELECT count(*) FILTER (WHERE l_discount <> 0) AS n FROM lineitem")
def agg03_count_nonzero(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").agg(F.count_if(F.col("l_discount") != 0).alias("n"))


@R.add("agg04_runs", "SELECT user_id, count(*) FILTER (WHERE r = 1 OR event_type <> p) AS runs FROM (SELECT user_id, event_type, lag(event_type) OVER w AS p, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id")
def agg04_runs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select("user_id", rd.runs(F.col("event_type"), w).alias("b")).groupBy("user_id").agg(F.sum("b").cast("bigint").alias("runs"))


@R.add("agg05_utf8_leading", "SELECT lang, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def agg05_utf8_leading(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(rd.utf8_leading(F.col("text")).cast("bigint")).alias("characters"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes"))


@R.add("agg06_pop_count", "SELECT CAST(sum(bit_count(l_partkey & 255)) AS BIGINT) AS b8, CAST(sum(bit_count(l_partkey & 65535)) AS BIGINT) AS b16, CAST(sum(bit_count(l_orderkey)) AS BIGINT) AS b64 FROM lineitem")
def agg06_pop_count(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").agg(*[F.sum(rd.pop_count(F.col(c), b).cast("bigint")).alias(f"b{b}") for c, b in (("l_partkey", 8), ("l_partkey", 16), ("l_orderkey", 64))])


@R.add("agg07_banked_sum", "SELECT CAST(sum(l_partkey) AS BIGINT) AS s FROM lineitem")
def agg07_banked_sum(spark, sf_dir):
    """Four accumulator banks summed at the end: the same integer sum."""
    li = load(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 4).alias("bank")).agg(F.sum("l_partkey").alias("s"))
    return li.agg(F.sum("s").alias("s"))


_TILE = "SELECT l_orderkey // 16 AS tile, CAST(l_partkey % 256 AS INTEGER) AS r, CAST(l_suppkey % 256 AS INTEGER) AS g, CAST(l_linenumber * 7 % 256 AS INTEGER) AS b FROM lineitem"


@R.add("agg09_block_endpoints", f"SELECT tile, min(r) AS r0, max(r) AS r1, min(g) AS g0, max(g) AS g1, min(b) AS b0, max(b) AS b1 FROM ({_TILE}) GROUP BY tile")
def agg09_block_endpoints(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey DIV 16 AS tile", "CAST(l_partkey % 256 AS INT) AS r", "CAST(l_suppkey % 256 AS INT) AS g", "CAST(l_linenumber * 7 % 256 AS INT) AS b")
    return li.groupBy("tile").agg(*[f(c).alias(f"{c}{i}") for c in "rgb" for i, f in ((0, F.min), (1, F.max))])


@R.add("agg10_quantile_interpolated", "SELECT event_type, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.5) AS p50 FROM events GROUP BY event_type")
def agg10_quantile_interpolated(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", 0.9).alias("p90"), F.percentile("value", 0.5).alias("p50"))


@R.add("agg11_quantile_nearest", "SELECT event_type, coalesce(quantile_disc(value, 0.9), 0) AS p90 FROM events GROUP BY event_type")
def agg11_quantile_nearest(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(rd.nearest_rank("value", 0.9, 0.0).alias("p90"))


@R.add("agg12_upper_median", "SELECT event_type, max(CASE WHEN r = n // 2 + 1 THEN value END) AS median FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def agg12_upper_median(spark, sf_dir):
    """sorted[n / 2]: values are counted first, so a window runs over distinct values and not over rows."""
    counts = load(spark, sf_dir, "events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("event_type")
    upto = counts.withColumn("u", F.sum("c").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    return upto.where("u >= n DIV 2 + 1 AND u - c < n DIV 2 + 1").select("event_type", F.col("value").alias("median"))


_PS = ["0.5", "0.9", "0.95", "0.99", "0.999", "0.9999"]


@R.add("agg13_latency_summary", "SELECT event_type, count(*) AS n, " + ", ".join(f"quantile_cont(value, {p}) AS p{p[2:]}" for p in _PS) + ", max(value) AS worst, round(avg(value), 9) AS mean, count(*) >= 10000 AS tail_supported FROM events GROUP BY event_type")
def agg13_latency_summary(spark, sf_dir):
    p = F.percentile("value", F.array(*[F.lit(float(x)) for x in _PS]))
    s = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), p.alias("p"), F.max("value").alias("worst"), F.round(F.avg("value"), 9).alias("mean"))
    return s.select("event_type", "n", *[F.col("p")[i].alias(f"p{x[2:]}") for i, x in enumerate(_PS)], "worst", "mean", (F.col("n") >= 10000).alias("tail_supported"))


_PROF = "SELECT run_id AS g, lower(trim(op)) AS category, CAST(coalesce(sum(greatest(microseconds, 0)), 0) AS BIGINT) AS us FROM profile_samples GROUP BY ALL"


@R.add("agg14_profile_categories", f"""WITH t AS ({_PROF}), grid AS (SELECT g, category FROM (SELECT DISTINCT g FROM t), (SELECT DISTINCT category FROM t)),
    z AS (SELECT grid.category, coalesce(t.us, 0) AS us FROM grid LEFT JOIN t USING (g, category)) SELECT category, quantile_cont(us, 0.5) AS median_us, round(avg(us), 6) AS mean_us FROM z GROUP BY category""")
def agg14_profile_categories(spark, sf_dir):
    """Per category the median and mean over runs; a category absent from a run counts 0 there.

    Zeros are not materialised: one row per category stands for all of its missing runs, with their number as weight."""
    p = load(spark, sf_dir, "profile_samples").select(F.col("run_id").alias("g"), F.lower(F.trim("op")).alias("category"), F.greatest(F.col("microseconds"), F.lit(0)).alias("us"))
    t = p.groupBy("g", "category").agg(F.coalesce(F.sum("us"), F.lit(0)).alias("us"))
    runs = p.agg(F.count_distinct("g")).scalar()
    zeros = t.groupBy("category").agg((runs - F.count(F.lit(1))).alias("w")).where("w > 0").select("category", F.lit(0).cast("bigint").alias("us"), "w")
    x = t.select("category", "us", F.lit(1).cast("bigint").alias("w")).unionByName(zeros)
    return x.groupBy("category").agg(F.expr("percentile(us, 0.5, w)").alias("median_us"), F.round(F.sum(F.col("us") * F.col("w")) / F.sum("w"), 6).alias("mean_us"))


@R.add("agg15_substage_summary", """WITH s AS (SELECT l_linenumber AS tokens, l_shipmode_ AS category, CAST(floor(l_quantity) AS BIGINT) AS us FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem)), t AS (SELECT CAST(sum(us) AS DOUBLE) AS total FROM s)
    SELECT CAST(tokens AS VARCHAR) AS tokens, category, CAST(sum(us) AS BIGINT) AS sum_us, round(sum(us) / (SELECT total FROM t), 9) AS fraction, quantile_cont(us, 0.5) AS median_us, min(us) AS min_us, max(us) AS max_us FROM s GROUP BY tokens, category
    UNION ALL SELECT 'overall', category, CAST(sum(us) AS BIGINT), round(sum(us) / (SELECT total FROM t), 9), quantile_cont(us, 0.5), min(us), max(us) FROM s GROUP BY category""")
def agg15_substage_summary(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("string").alias("tokens"), F.col("l_returnflag").alias("category"), F.floor("l_quantity").cast("bigint").alias("us"))
    total = s.agg(F.sum("us")).scalar()

    def summary(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("us").alias("sum_us"), F.percentile("us", 0.5).alias("median_us"), F.min("us").alias("min_us"), F.max("us").alias("max_us"))
    both = summary(s, "tokens", "category").unionByName(summary(s, "category").withColumn("tokens", F.lit("overall")))
    return both.withColumn("fraction", F.when(total == 0, 0.0).otherwise(F.round(F.col("sum_us") / total, 9)))


@R.add("agg16_dataset_statistics", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS projects, count(DISTINCT o_orderpriority) AS priorities, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(DISTINCT o_custkey) >= 10 AS enough FROM orders")
def agg16_dataset_statistics(spark, sf_dir):
    return load(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("projects"), F.count_distinct("o_orderpriority").alias("priorities"),
                                             F.count_if(F.col("o_orderstatus") == "F").alias("finished"), (F.count_distinct("o_custkey") >= 10).alias("enough"))


@R.add("agg16_outcome_histogram", "SELECT o_orderstatus AS outcome, count(*) AS n FROM orders GROUP BY 1")
def agg16_outcome_histogram(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@R.add("agg21_graph_summary", "SELECT coalesce(n.kind, 'unknown') AS kind, count(*) AS n FROM (SELECT unnest(nodes) AS n FROM (SELECT DISTINCT graph_hash, nodes FROM projection_graphs)) WHERE n IS NOT NULL GROUP BY 1")
def agg21_graph_summary(spark, sf_dir):
    g = load(spark, sf_dir, "projection_graphs").select("graph_hash", "nodes").dropDuplicates(["graph_hash"]).select(F.explode("nodes").alias("n")).where("n is not null")
    return g.groupBy(F.coalesce("n.kind", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@R.add("agg22_operation_counts", r"SELECT lower(trim(op)) AS op, regexp_extract(name, 'blk\.([0-9]+)\.', 1) AS layer, count(*) AS n FROM profile_samples WHERE name IS NOT NULL GROUP BY 1, 2")
def agg22_operation_counts(spark, sf_dir):
    return load(spark, sf_dir, "profile_samples").where("name is not null").groupBy(F.lower(F.trim("op")).alias("op"), F.regexp_extract("name", r"blk\.([0-9]+)\.", 1).alias("layer")).agg(F.count(F.lit(1)).alias("n"))


_PRED = "SELECT o_orderstatus = 'F' AS y, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS p FROM orders"


@R.add("agg23_macro_f1", f"""WITH c AS (SELECT count(*) FILTER (WHERE y AND p >= 0.5) AS tp, count(*) FILTER (WHERE NOT y AND p >= 0.5) AS fp, count(*) FILTER (WHERE y AND p < 0.5) AS fn, count(*) FILTER (WHERE NOT y AND p < 0.5) AS tn FROM ({_PRED}))
    SELECT round((CASE WHEN 2*tp+fp+fn = 0 THEN 1 ELSE 2.0::DOUBLE*tp/(2*tp+fp+fn) END + CASE WHEN 2*tn+fp+fn = 0 THEN 1 ELSE 2.0::DOUBLE*tn/(2*tn+fp+fn) END) / 2, 12) AS macro_f1 FROM c""")
def agg23_macro_f1(spark, sf_dir):
    """Mean of the two classes' F1; a class that neither occurs nor is predicted has 1."""
    y, p = F.col("o_orderstatus") == "F", F.col("o_orderkey") * 7919 % 1000 / 1000.0 >= 0.5
    c = load(spark, sf_dir, "orders").agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    f1 = lambda t: F.when(2 * F.col(t) + F.col("fp") + F.col("fn") == 0, 1.0).otherwise(2.0 * F.col(t) / (2 * F.col(t) + F.col("fp") + F.col("fn")))
    return c.select(F.round((f1("tp") + f1("tn")) / 2, 12).alias("macro_f1"))


@R.add("agg23_calibration_error", f"SELECT round(sum(abs(conf - acc) * n) / sum(n), 9) AS ece FROM (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS conf, avg(CAST(y AS INTEGER)) AS acc FROM ({_PRED}) GROUP BY 1)")
def agg23_calibration_error(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("y"), (F.col("o_orderkey") * 7919 % 1000 / 1000.0).alias("p"))
    b = o.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("conf"), F.avg(F.col("y").cast("int")).alias("acc"))
    return b.agg(F.round(F.sum(F.abs(F.col("conf") - F.col("acc")) * F.col("n")) / F.sum("n"), 9).alias("ece"))


_RANKED = "SELECT c_nationkey AS g, c_custkey AS id, c_custkey * 31 % 97 AS score, CAST(c_custkey * 17 % 11 AS DOUBLE) AS u FROM customer"


@R.add("agg24_ndcg", f"""WITH r AS (SELECT g, u - min(u) OVER (PARTITION BY g) AS d, row_number() OVER (PARTITION BY g ORDER BY score DESC, id) AS k, row_number() OVER (PARTITION BY g ORDER BY u DESC, id) AS b FROM ({_RANKED})),
    s AS (SELECT g, sum((pow(2, d) - 1) / log2(k + 1)) AS dcg, sum((pow(2, d) - 1) / log2(b + 1)) AS ideal FROM r GROUP BY g) SELECT g, round(CASE WHEN ideal = 0 THEN 1.0 ELSE dcg / ideal END, 9) AS ndcg FROM s""")
def agg24_ndcg(spark, sf_dir):
    """Gain 2^(u - lowest u) - 1; a group without gain has 1."""
    c = load(spark, sf_dir, "customer").selectExpr("c_nationkey AS g", "c_custkey AS id", "c_custkey * 31 % 97 AS score", "CAST(c_custkey * 17 % 11 AS DOUBLE) AS u")
    w = Window.partitionBy("g")
    r = c.select("g", (F.col("u") - F.min("u").over(w)).alias("d"), F.row_number().over(w.orderBy(F.desc("score"), "id")).alias("k"), F.row_number().over(w.orderBy(F.desc("u"), "id")).alias("b"))
    gain = F.pow(F.lit(2.0), "d") - 1
    s = r.groupBy("g").agg(F.sum(gain / F.log2(F.col("k") + 1)).alias("dcg"), F.sum(gain / F.log2(F.col("b") + 1)).alias("ideal"))
    return s.select("g", F.round(F.when(F.col("ideal") == 0, 1.0).otherwise(F.col("dcg") / F.col("ideal")), 9).alias("ndcg"))


@R.add("agg25_pairwise_accuracy", f"""WITH r AS (SELECT g, u, row_number() OVER (PARTITION BY g ORDER BY score DESC, id) AS k FROM ({_RANKED}))
    SELECT a.g, round(avg(CASE WHEN a.u > b.u THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM r a JOIN r b ON a.g = b.g AND a.k < b.k WHERE abs(a.u - b.u) >= 1e-12 GROUP BY a.g""")
def agg25_pairwise_accuracy(spark, sf_dir):
    """Share of pairs with different utility that are ranked rightly, without forming pairs: the utilities ranked
    before each row are counted by value (their number of distinct values is what a row is compared with)."""
    c = load(spark, sf_dir, "customer").selectExpr("c_nationkey AS g", "c_custkey AS id", "c_custkey * 31 % 97 AS score", "CAST(c_custkey * 17 % 11 AS DOUBLE) AS u")
    r = c.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "id")))
    levels = c.select(F.col("g").alias("lg"), F.col("u").alias("lu")).distinct()
    x = r.join(levels, F.col("g") == F.col("lg"))
    before = Window.partitionBy("g", "lu").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("seen", F.coalesce(F.sum((F.col("u") == F.col("lu")).cast("bigint")).over(before), F.lit(0)))
    good, bad = F.sum(F.when(F.col("lu") > F.col("u"), F.col("seen"))), F.sum(F.when(F.col("lu") < F.col("u"), F.col("seen")))
    s = x.groupBy("g").agg(F.coalesce(good, F.lit(0)).alias("a"), F.coalesce(bad, F.lit(0)).alias("b"))
    return s.where("a + b > 0").select("g", F.round(F.col("a") / (F.col("a") + F.col("b")), 9).alias("accuracy"))


@R.add("agg26_information_movement", """SELECT level, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT unnest(CASE l_linenumber % 3 WHEN 0 THEN ['l1'] WHEN 1 THEN ['l1', 'l2'] ELSE ['l1', 'l2', 'dram'] END) AS level,
    CAST(l_quantity AS BIGINT) * CASE WHEN l_linenumber % 3 = 0 THEN 2 ELSE 1 END AS bytes FROM lineitem) GROUP BY level""")
def agg26_information_movement(spark, sf_dir):
    """Bytes per memory level: a value held in the first level only moves in and out of it."""
    k = F.col("l_linenumber") % 3
    levels = F.when(k == 0, F.array(F.lit("l1"))).when(k == 1, F.array(F.lit("l1"), F.lit("l2"))).otherwise(F.array(F.lit("l1"), F.lit("l2"), F.lit("dram")))
    li = load(spark, sf_dir, "lineitem").select(F.explode(levels).alias("level"), (F.col("l_quantity").cast("bigint") * F.when(k == 0, 2).otherwise(1)).alias("bytes"))
    return li.groupBy("level").agg(F.sum("bytes").alias("bytes"))


@R.add("agg27_capability_rollup", "SELECT count(*) AS reports, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed, count(*) FILTER (WHERE o_orderstatus = 'P') AS partial, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS executable FROM orders")
def agg27_capability_rollup(spark, sf_dir):
    s = F.col("o_orderstatus")
    return load(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("reports"), F.count_if(s == "F").alias("closed"), F.count_if(s == "P").alias("partial"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("executable"))


@R.add("agg28_corpus_audit", "SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates, count(*) AS keys FROM (SELECT count(*) AS c FROM profile_samples GROUP BY sample_id)")
def agg28_corpus_audit(spark, sf_dir):
    c = load(spark, sf_dir, "profile_samples").groupBy("sample_id").agg(F.count(F.lit(1)).alias("c"))
    return c.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"), F.count(F.lit(1)).alias("keys"))


@R.add("agg29_running_mean", "SELECT event_id, sum(c) OVER w / CAST(count(*) OVER w AS DOUBLE) AS mean FROM (SELECT *, CAST(floor(value * 100 + 0.5) AS BIGINT) AS c FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def agg29_running_mean(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, sf_dir, "events").select("event_id", (F.sum(F.floor(F.col("value") * 100 + 0.5).cast("bigint")).over(w) / F.count(F.lit(1)).over(w)).alias("mean"))


@R.add("agg30_effect_join", """SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS effects, bool_or(l_discount = 0) AS unknown, NOT list_contains(list(DISTINCT l_returnflag), 'R') AS contained FROM lineitem GROUP BY l_orderkey""")
def agg30_effect_join(spark, sf_dir):
    """Join in the effect lattice: union of sets, unknown if any part is; contained: nothing outside {A, N}."""
    j = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("effects"), F.bool_or(F.col("l_discount") == 0).alias("unknown"))
    return j.withColumn("contained", F.size(F.array_except("effects", F.array(F.lit("A"), F.lit("N")))) == 0)


@R.add("agg33_portfolio", """WITH w AS (SELECT o_orderpriority AS workload, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT workload, m / (SELECT 0.97::DOUBLE * avg(o_totalprice) FROM orders) AS ratio, n / CAST((SELECT count(*) FROM orders) AS DOUBLE) AS weight FROM w)
    SELECT round(sum(weight * (ratio - 1) * 100), 6) AS score, bool_and(ratio >= 0.95) AS floors_met FROM r""")
def agg33_portfolio(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    whole, n = o.agg(F.avg("o_totalprice") * 0.97).scalar(), o.agg(F.count(F.lit(1))).scalar()
    r = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"), F.count(F.lit(1)).alias("n")).select((F.col("m") / whole).alias("ratio"), (F.col("n") / n).alias("weight"))
    return r.agg(F.round(F.sum(F.col("weight") * (F.col("ratio") - 1) * 100), 6).alias("score"), F.bool_and(F.col("ratio") >= 0.95).alias("floors_met"))


@R.add("agg34_composed_effects", """WITH e AS (SELECT n_nationkey AS id, n_regionkey AS g, n_nationkey % 7 - 3 AS percent, n_nationkey % 4 AS covers FROM nation)
    SELECT g, round((list_product(list(1 + percent / 100.0::DOUBLE)) - 1) * 100, 9) AS percent, count(*) > count(DISTINCT covers) AS overlapping FROM e GROUP BY g""")
def agg34_composed_effects(spark, sf_dir):
    """Product of the effects; overlapping coverage means that they may not be composed."""
    e = load(spark, sf_dir, "nation").selectExpr("n_regionkey AS g", "n_nationkey % 7 - 3 AS percent", "n_nationkey % 4 AS covers")
    return e.groupBy("g").agg(F.round((F.product(1 + F.col("percent") / 100.0) - 1) * 100, 9).alias("percent"), (F.count(F.lit(1)) > F.count_distinct("covers")).alias("overlapping"))


@R.add("agg35_amdahl_forecast", """WITH r AS (SELECT l_returnflag AS region, sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem) AS share FROM lineitem GROUP BY 1)
    SELECT round(sum(share), 6) AS covered, round(1 / (1 - sum(share) * 0.5 + sum(share * 0.5 / 1.25)), 6) AS speedup, sum(share) <= 1.0000001 AS valid FROM r WHERE region <> 'N'""")
def agg35_amdahl_forecast(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    total = li.agg(F.sum("l_quantity")).scalar()
    r = li.groupBy("l_returnflag").agg((F.sum("l_quantity") / total).alias("share")).where("l_returnflag <> 'N'")
    s = F.sum("share")
    return r.agg(F.round(s, 6).alias("covered"), F.round(1 / (1 - s * 0.5 + F.sum(F.col("share") * 0.5 / 1.25)), 6).alias("speedup"), (s <= 1.0000001).alias("valid"))


# ---- example kernels


@R.add("kern01_parse_word", "SELECT doc_id, strlen(text) >= 4 AS ok, CASE WHEN strlen(text) >= 4 THEN CAST(('0x' || left(hex(encode(text)), 8)) AS BIGINT) ELSE 0 END AS value FROM documents")
def kern01_parse_word(spark, sf_dir):
    b = F.encode("text", "UTF-8")
    ok = F.octet_length("text") >= 4
    return load(spark, sf_dir, "documents").select("doc_id", ok.alias("ok"), F.when(ok, F.conv(F.left(F.hex(b), F.lit(8)), 16, 10).cast("bigint")).otherwise(F.lit(0)).alias("value"))


_BYTES = "list_transform(range(1, strlen(o_orderpriority) + 1), lambda k: CAST(ascii(substr(o_orderpriority, CAST(k AS INTEGER), 1)) AS BIGINT))"


@R.add("kern02_fnv1a", f"SELECT o_orderkey, list_reduce(list_prepend(2166136261::BIGINT, {_BYTES}), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS h FROM orders")
def kern02_fnv1a(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", rd.fnv1a(rd.bytes_of(F.col("o_orderpriority"))).alias("h"))


@R.add("kern03_additive_checksum", f"SELECT o_orderkey, CAST(list_sum({_BYTES}) AS BIGINT) & 4294967295 AS h FROM orders")
def kern03_additive_checksum(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", rd.additive_checksum(rd.bytes_of(F.col("o_orderpriority"))).alias("h"))


@R.add("kern04_mixed_hash_sum", "SELECT CAST(sum(CAST((CAST(xor(l_partkey, 2654435769) AS HUGEINT) * 2246822507) % 4294967296 AS BIGINT)) AS BIGINT) AS total FROM lineitem")
def kern04_mixed_hash_sum(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").agg(F.sum(rd.mixed_hash(F.col("l_partkey"))).alias("total"))


@R.add("kern05_changed_indices", "SELECT o_orderkey AS i FROM orders WHERE o_orderkey % 3 <> 0 AND (SELECT count(*) FROM orders) <= 1000000000")
def kern05_changed_indices(spark, sf_dir):
    from ..operators import sequences as sq
    cur = load(spark, sf_dir, "orders").selectExpr("o_orderkey AS i", "o_orderkey + o_orderkey % 3 AS v")
    base = load(spark, sf_dir, "orders").selectExpr("o_orderkey AS i", "o_orderkey AS v")
    return sq.with_capacity(sq.changed(cur, base, "i", "v"), "i", 10**9, "fail-input-extent-unchanged", cur).select("i")


@R.add("kern06_late_guard", "SELECT o_orderkey AS i FROM orders WHERE o_orderkey % 3 <> 0 AND (SELECT count(*) FROM orders) <= 10")
def kern06_late_guard(spark, sf_dir):
    """The guard stands before the emit: an output too small gives nothing, never a part."""
    from ..operators import sequences as sq
    cur = load(spark, sf_dir, "orders").selectExpr("o_orderkey AS i").where("i % 3 <> 0")
    return sq.with_capacity(cur, "i", 10, "fail-input-extent-unchanged", load(spark, sf_dir, "orders"))


@R.add("kern07_first_positive", "SELECT user_id, coalesce(min(i) FILTER (WHERE value > 500), -1) AS first FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) GROUP BY user_id")
def kern07_first_positive(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf_dir, "events").select("user_id", "value", (F.row_number().over(w) - 1).cast("bigint").alias("i"))
    return e.groupBy("user_id").agg(rd.first_index(F.col("i"), F.col("value") > 500).alias("first"))


@R.add("kern08_weighted_total", "SELECT CAST(sum(CAST(l_quantity AS BIGINT) * l_linenumber) AS BIGINT) AS total FROM lineitem")
def kern08_weighted_total(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").agg(F.sum(F.col("l_quantity").cast("bigint") * F.col("l_linenumber").cast("bigint")).alias("total"))


@R.add("kern09_running_counter", "SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS calls, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS total FROM orders")
def kern09_running_counter(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.count(F.lit(1)).over(w).alias("calls"), F.sum("o_orderkey").over(w).alias("total"))


@R.add("kern10_status_result", "SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 'empty' ELSE 'ok' END AS message, CASE WHEN strlen(text) > 0 THEN CAST(('0x' || left(hex(encode(text)), 2)) AS BIGINT) ELSE 0 END AS value FROM documents WHERE text IS NOT NULL")
def kern10_status_result(spark, sf_dir):
    none = F.octet_length("text") == 0
    r = F.when(none, F.struct(F.lit("empty").alias("message"), F.lit(0).cast("bigint").alias("value"))).otherwise(F.struct(F.lit("ok").alias("message"), F.conv(F.left(F.hex(F.encode("text", "UTF-8")), F.lit(2)), 16, 10).cast("bigint").alias("value")))
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", r.alias("r")).select("doc_id", "r.message", "r.value")


R.add("kern15_byte_equality", R.sql["agg01_count_equal"])(agg01_count_equal)
R.add("kern16_utf8_leading", R.sql["agg05_utf8_leading"])(agg05_utf8_leading)


@R.add("kern18_low_bit_matvec", """WITH a AS (SELECT s_suppkey AS j, CAST(s_suppkey * 37 % 255 AS BIGINT) - 127 AS act FROM supplier), w AS (SELECT l_partkey % 50 AS r, l_suppkey AS j, l_orderkey % 256 AS b FROM lineitem)
    SELECT r, CAST(sum(((b & 15) - 8) * act + ((b >> 4) - 8) * act) AS BIGINT) AS y FROM w JOIN a USING (j) GROUP BY r""")
def kern18_low_bit_matvec(spark, sf_dir):
    """Two signed 4-bit weights in a byte times an int8 activation, summed exactly per row."""
    a = load(spark, sf_dir, "supplier").selectExpr("s_suppkey AS aj", "CAST(s_suppkey * 37 % 255 AS BIGINT) - 127 AS act")
    w = load(spark, sf_dir, "lineitem").selectExpr("l_partkey % 50 AS r", "l_suppkey AS j", "explode(array(l_orderkey % 256 & 15, shiftright(l_orderkey % 256, 4))) AS q")
    return w.join(a, F.col("j") == F.col("aj")).groupBy("r").agg(F.sum((F.col("q") - 8) * F.col("act")).alias("y"))
