"""Queries of the measurement, resampling and lifetime-trace families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resampling as rs
from ..operators import traces as tr
from ..session import load
from .registry import Registry

R = Registry()

# ---- resampling


def draws_sql(rounds: int, n: int, seed: int) -> str:
    return f"(SELECT r AS round, CAST('0x' || substr(md5('{seed}-' || r || '-' || k), 1, 13) AS BIGINT) % {n} AS pick FROM range({rounds}) a(r), range({n}) b(k))"


@R.add("boot01_cluster", f"""WITH d AS {draws_sql(100, 10, 42)}, x AS (SELECT round, quantile_cont(value, 0.5) AS x FROM d JOIN events ON user_id % 10 = pick GROUP BY round)
    SELECT quantile_cont(x, 0.025) AS low, (SELECT quantile_cont(value, 0.5) FROM events) AS point, quantile_cont(x, 0.975) AS high FROM x""")
def boot01_cluster(spark, sf_dir):
    e = load(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("process"), "value")
    return rs.cluster_bootstrap(e, "process", "value", 100, 0.5, 42, 10)


_PAIRS = "p AS (SELECT o_custkey % 20 AS i, quantile_cont(o_totalprice, 0.5) FILTER (WHERE o_orderkey % 2 = 0) / quantile_cont(o_totalprice, 0.5) FILTER (WHERE o_orderkey % 2 = 1) - 1 AS e FROM orders GROUP BY 1)"


def _pairs(spark, sf_dir) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    side = lambda k: F.percentile(F.when(F.col("o_orderkey") % 2 == k, F.col("o_totalprice")), 0.5)
    return o.groupBy((F.col("o_custkey") % 20).alias("i")).agg((side(0) / side(1) - 1).alias("e"))


@R.add("boot02_paired", f"WITH {_PAIRS}, d AS {draws_sql(200, 20, 7)}, x AS (SELECT round, quantile_cont(e, 0.5) AS x FROM d JOIN p ON i = pick GROUP BY round) SELECT round(quantile_cont(x, 0.025), 12) AS low, round(quantile_cont(x, 0.975), 12) AS high FROM x")
def boot02_paired(spark, sf_dir):
    return rs.paired_bootstrap(_pairs(spark, sf_dir), "i", "e", 200, 7, 20).select(F.round("low", 12).alias("low"), F.round("high", 12).alias("high"))


@R.add("boot03_paired_effect", f"WITH {_PAIRS} SELECT i, round(e * 100, 9) AS effect_percent FROM p")
def boot03_paired_effect(spark, sf_dir):
    return _pairs(spark, sf_dir).select("i", F.round(F.col("e") * 100, 9).alias("effect_percent"))


@R.add("boot04_sequential_stop", f"WITH {_PAIRS}, c AS (SELECT i + 1 AS n, avg(e) OVER w AS m, coalesce(stddev_samp(e) OVER w, 0) / sqrt(i + 1) AS s FROM p WINDOW w AS (ORDER BY i)) SELECT min(n) AS pairs FROM c WHERE n >= 5 AND 2 * s < 0.05")
def boot04_sequential_stop(spark, sf_dir):
    """First number of pairs (at least 5) at which the interval is narrow."""
    from pyspark.sql import Window
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # one row per process, at most 20
    c = _pairs(spark, sf_dir).select((F.col("i") + 1).alias("n"), (F.coalesce(F.stddev_samp("e").over(w), F.lit(0.0)) / F.sqrt(F.col("i") + 1)).alias("s"))
    return c.where("n >= 5 and 2 * s < 0.05").agg(F.min("n").alias("pairs"))


@R.add("boot05_outcome", f"WITH {_PAIRS} SELECT i, CASE WHEN e IS NULL THEN 'insufficient' WHEN e > 0.05 THEN 'retained' WHEN e < -0.05 THEN 'regression' ELSE 'tie' END AS outcome FROM p")
def boot05_outcome(spark, sf_dir):
    e = F.col("e")
    return _pairs(spark, sf_dir).select("i", F.when(e.isNull(), "insufficient").when(e > 0.05, "retained").when(e < -0.05, "regression").otherwise("tie").alias("outcome"))


@R.add("boot06_latency_verdict", """WITH s AS (SELECT user_id % 8 AS g, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.999) AS p999, quantile_cont(value, 0.9999) AS p9999 FROM events GROUP BY 1), v AS (SELECT a.g, a.p50 AS b50, b.p50 AS c50, a.p999 AS b999, b.p999 AS c999, a.p9999 AS b9999, b.p9999 AS c9999 FROM s a JOIN s b ON b.g = (a.g + 1) % 8)
    SELECT g, CASE WHEN (b50*0.98::DOUBLE/(c50*1.02::DOUBLE)-1)*100 >= 10 AND (b999/c999-1)*100 >= 5 AND (c9999/b9999-1)*100 <= 1 THEN 'accepted' WHEN (b50*0.98::DOUBLE/(c50*1.02::DOUBLE)-1)*100 < 10 AND (b50*1.02::DOUBLE/(c50*0.98::DOUBLE)-1)*100 >= 10 THEN 'statistical_tie' ELSE 'rejected' END AS verdict FROM v""")
def boot06_latency_verdict(spark, sf_dir):
    s = load(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("g")).agg(F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.999).alias("p999"), F.percentile("value", 0.9999).alias("p99_99"))
    c = s.select(F.col("g").alias("h"), *[F.col(x).alias(f"c_{x}") for x in ("p50", "p999", "p99_99")])
    v = s.join(c, F.col("h") == (F.col("g") + 1) % 8)
    b50, c50 = F.col("p50"), F.col("c_p50")
    verdict = rs.latency_verdict({"p99_99": F.col("p99_99")}, {"p99_99": F.col("c_p99_99")}, b50 * F.lit(0.98), b50 * F.lit(1.02), c50 * F.lit(0.98), c50 * F.lit(1.02), F.col("p999"), F.col("c_p999"))
    return v.select("g", verdict.alias("verdict"))


@R.add("boot07_portfolio", f"""WITH w AS (SELECT l_returnflag AS g, l_orderkey % 10 AS i, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), d AS {draws_sql(50, 10, 3)}, m AS (SELECT g, round, avg(v) AS m FROM d JOIN w ON i = pick GROUP BY 1, 2), b AS (SELECT g, avg(v) AS b FROM w GROUP BY g),
    x AS (SELECT round, sum((m / b - 1) * 100 / 3) AS x FROM m JOIN b USING (g) GROUP BY round) SELECT round(quantile_cont(x, 0.025), 9) AS low, round(quantile_cont(x, 0.975), 9) AS high FROM x""")
def boot07_portfolio(spark, sf_dir):
    """Equal weights over three workloads; each round's mean ratio is resampled within the workload."""
    w = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), (F.col("l_orderkey") % 10).alias("i")).agg(F.avg("l_extendedprice").alias("v"))
    times = rs.draws(spark, 50, 10, 10, 3).groupBy("round", "pick").agg(F.count(F.lit(1)).alias("times"))
    m = times.join(w, F.col("pick") == F.col("i")).groupBy("g", "round").agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("m"))
    b = w.groupBy(F.col("g").alias("gb")).agg(F.avg("v").alias("b"))
    x = m.join(b, F.col("g") == F.col("gb")).groupBy("round").agg(F.sum((F.col("m") / F.col("b") - 1) * 100 / 3).alias("x"))
    return x.agg(F.round(F.percentile("x", 0.025), 9).alias("low"), F.round(F.percentile("x", 0.975), 9).alias("high"))


_TWO = "s AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS side, (o_orderkey // 2) % 25 AS i, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)"


@R.add("boot14_ratio_of_means", f"WITH {_TWO}, a AS (SELECT round, avg(v) AS m FROM {draws_sql(100, 25, 5)} JOIN s ON side = 'a' AND i = pick GROUP BY 1), b AS (SELECT round, avg(v) AS m FROM {draws_sql(100, 25, 106)} JOIN s ON side = 'b' AND i = pick GROUP BY 1) SELECT round(quantile_cont(a.m / b.m, 0.025), 9) AS low, round(quantile_cont(a.m / b.m, 0.975), 9) AS high FROM a JOIN b USING (round)")
def boot14_ratio_of_means(spark, sf_dir):
    s = load(spark, sf_dir, "orders").groupBy(F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END").alias("side"), F.expr("(o_orderkey DIV 2) % 25").alias("i")).agg(F.avg("o_totalprice").alias("v"))
    return rs.ratio_bootstrap(s, "side", "i", "v", 100, 5, {"a": 25, "b": 25}).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@R.add("boot08_speedup", f"""WITH p AS (SELECT l_linenumber % 2 = 0 AS cand, l_orderkey % 30 AS i, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), x AS (SELECT b.i, b.v / c.v AS s FROM p b JOIN p c ON b.i = c.i AND NOT b.cand AND c.cand),
    d AS {draws_sql(200, 30, 8)}, r AS (SELECT round, avg(s) AS m FROM d JOIN x ON i = pick GROUP BY 1) SELECT round((SELECT avg(s) FROM x), 9) AS speedup, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high, quantile_cont(m, 0.025) > 1 AS retained FROM r""")
def boot08_speedup(spark, sf_dir):
    """Mean of the paired speedups of 30 processes with its interval; the value is retained if the whole interval is above 1."""
    p = load(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 30).alias("i")).agg(*[F.avg(F.when(F.col("l_linenumber") % 2 == k, F.col("l_extendedprice"))).alias(n) for k, n in ((1, "b"), (0, "c"))])
    x = p.where("b is not null and c is not null").select("i", (F.col("b") / F.col("c")).alias("s"))
    times = rs.draws(spark, 200, 30, 30, 8).groupBy("round", "pick").agg(F.count(F.lit(1)).alias("times"))
    r = times.join(x, F.col("pick") == F.col("i")).groupBy("round").agg((F.sum(F.col("s") * F.col("times")) / F.sum("times")).alias("m"))
    low, high = F.percentile("m", 0.025), F.percentile("m", 0.975)
    return r.agg(F.round(F.max(x.agg(F.avg("s")).scalar()), 9).alias("speedup"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), (low > 1).alias("retained"))


@R.add("boot09_plan_ranking", f"WITH {_PAIRS}, d AS {draws_sql(100, 20, 11)}, x AS (SELECT round, avg(e) AS x FROM d JOIN p ON i = pick GROUP BY round) SELECT round(quantile_cont(x, 0.025), 9) AS low, round(quantile_cont(x, 0.975), 9) AS high FROM x")
def boot09_plan_ranking(spark, sf_dir):
    times = rs.draws(spark, 100, 20, 20, 11).groupBy("round", "pick").agg(F.count(F.lit(1)).alias("times"))
    x = times.join(_pairs(spark, sf_dir), F.col("pick") == F.col("i")).groupBy("round").agg((F.sum(F.col("e") * F.col("times")) / F.sum("times")).alias("x"))
    return x.agg(F.round(F.percentile("x", 0.025), 9).alias("low"), F.round(F.percentile("x", 0.975), 9).alias("high"))


@R.add("boot10_admission", """SELECT n_nationkey, CASE WHEN n_regionkey = 4 THEN 'rejected' WHEN n_nationkey % 6 = 5 THEN 'rejected' WHEN n_nationkey % 5 = 4 THEN 'rejected' WHEN n_nationkey % 7 = 6 THEN 'rejected'
    WHEN n_nationkey * 0.004::DOUBLE < 0.05 THEN 'exploratory' WHEN n_nationkey % 2 = 0 THEN 'exploratory' ELSE 'admitted' END AS status FROM nation""")
def boot10_admission(spark, sf_dir):
    n, k = load(spark, sf_dir, "nation"), F.col("n_nationkey")
    status = rs.admission(F.col("n_regionkey") != 4, k % 6 != 5, F.lit(False), F.when(k % 5 == 4, "sideways").otherwise("decrease"), F.lit("latency"), k % 7 != 6, k * F.lit(0.004), k % 2 == 0)
    return n.select("n_nationkey", status.alias("status"))


@R.add("boot11_parity_gate", "SELECT o_orderpriority, bool_and(o_orderstatus IS NOT DISTINCT FROM CASE WHEN o_orderkey % 997 = 0 THEN 'X' ELSE o_orderstatus END) AS parity FROM orders GROUP BY 1")
def boot11_parity_gate(spark, sf_dir):
    cand = F.when(F.col("o_orderkey") % 997 == 0, "X").otherwise(F.col("o_orderstatus"))
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.bool_and(F.col("o_orderstatus").eqNullSafe(cand)).alias("parity"))


@R.add("boot12_promotion", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'blocked' WHEN p_size % 3 = 0 AND p_retailprice / 1000 - 1 >= 0.05 THEN 'promoted' WHEN p_retailprice / 1000 - 1 >= 0.05 THEN 'provisional' ELSE 'measured' END AS level FROM part")
def boot12_promotion(spark, sf_dir):
    gain = F.col("p_retailprice") / 1000 - 1 >= 0.05
    return load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 7 == 0, "blocked").when((F.col("p_size") % 3 == 0) & gain, "promoted").when(gain, "provisional").otherwise("measured").alias("level"))


@R.add("boot15_amdahl", "SELECT p_partkey, round(1 / (1 - s + s / 1.5::DOUBLE), 12) AS forward, round(greatest(0, least(1, (1 - 1 / (1 / (1 - s + s / 1.5::DOUBLE))) / (1 - 1 / 1.5::DOUBLE))), 9) AS share FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS s FROM part)")
def boot15_amdahl(spark, sf_dir):
    from ..functions.reductions import amdahl
    f = amdahl(F.col("p_size") / 50.0, F.lit(1.5))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(f, 12).alias("forward"), F.round(rs.affected_fraction(F.lit(1.5), f), 9).alias("share"))


@R.add("boot16_complement_product", "SELECT p_brand, round((1 - list_product(list_transform(list(p_size / 50.0::DOUBLE ORDER BY p_size), lambda p: 1 - greatest(0, least(100, p)) / 100.0::DOUBLE))) * 100, 9) AS combined FROM part GROUP BY p_brand")
def boot16_complement_product(spark, sf_dir):
    rest = 1 - F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("p_size") / 50.0)) / 100
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.round((1 - F.product(rest)) * 100, 9).alias("combined"))


@R.add("boot17_gains", "SELECT l_returnflag, round(min(g), 9) AS overall FROM (SELECT l_returnflag, l_linestatus, sum(l_extendedprice) FILTER (WHERE l_orderkey % 2 = 0) / sum(l_extendedprice) FILTER (WHERE l_orderkey % 2 = 1) AS g FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def boot17_gains(spark, sf_dir):
    side = lambda k: F.sum(F.when(F.col("l_orderkey") % 2 == k, F.col("l_extendedprice")))
    g = load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg((side(0) / side(1)).alias("g"))
    return g.groupBy("l_returnflag").agg(F.round(F.min("g"), 9).alias("overall"))


# ---- lifetime traces, made from the event table

_KINDS = "['construct','publish','consume','mutate','invalidate','retire','destroy','transfer']"
_TR = f"""tr AS (SELECT event_id AS sequence, event_id * 10 AS timestamp_ns, event_type AS information_id, 'u' || (user_id % 50) AS semantic_identity, ({_KINDS})[1 + (event_id * 5 + user_id) % 8] AS event, 's' || (user_id % 7) AS s,
    'm' || (event_id % 3) AS mutation, 'k' || (event_id % 2) AS equivalence_key, 'p' || (event_id % 3) AS placement, 'd' || (user_id % 4) AS destination, CAST(floor(value) AS BIGINT) % 900 AS byte_count FROM events), it AS (SELECT DISTINCT event_type AS id, 64::BIGINT AS byte_size FROM events)"""


def _trace(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = load(spark, sf_dir, "events")
    kinds = F.array(*[F.lit(k) for k in tr.EVENT_KINDS])
    tag = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    events = e.select(F.col("event_id").alias("sequence"), (F.col("event_id") * 10).alias("timestamp_ns"), F.col("event_type").alias("information_id"), tag("u", F.col("user_id") % 50).alias("semantic_identity"),
                      kinds[((F.col("event_id") * 5 + F.col("user_id")) % 8).cast("int")].alias("event"), F.create_map(F.lit("scope"), tag("s", F.col("user_id") % 7)).alias("scope_instances"), tag("m", F.col("event_id") % 3).alias("mutation"),
                      tag("k", F.col("event_id") % 2).alias("equivalence_key"), tag("p", F.col("event_id") % 3).alias("placement"), tag("d", F.col("user_id") % 4).alias("destination"), (F.floor("value").cast("bigint") % 900).alias("byte_count"))
    items = e.select(F.col("event_type").alias("id")).distinct().select("id", F.lit(64).cast("bigint").alias("byte_size"), F.lit("scope").alias("scope"), F.array(F.lit("m1")).alias("invalidators"), F.array(F.lit("m0"), F.lit("m1")).alias("mutations"))
    return events, items


_WASTE = "SELECT information_id, CASE WHEN sum(greatest(0, e - s)) > 0 THEN sum(greatest(0, e - coalesce(u, s))) / CAST(sum(greatest(0, e - s)) AS DOUBLE) ELSE 0 END AS waste FROM (SELECT information_id, semantic_identity, min(timestamp_ns) FILTER (WHERE event = 'construct') AS s, max(timestamp_ns) FILTER (WHERE event IN ('retire', 'destroy')) AS e, max(timestamp_ns) FILTER (WHERE event = 'consume') AS u FROM tr GROUP BY 1, 2) WHERE s IS NOT NULL AND e IS NOT NULL GROUP BY 1"


@R.add("agg18_retention_waste", f"WITH {_TR} SELECT information_id, round(waste, 12) AS waste FROM ({_WASTE})")
def agg18_retention_waste(spark, sf_dir):
    return tr.retention_waste(_trace(spark, sf_dir)[0]).select("information_id", F.round("waste", 12).alias("waste"))


_ATTR = f"""m AS (SELECT information_id, count(*) FILTER (WHERE event = 'construct') AS n_construct, count(*) FILTER (WHERE event = 'consume') AS n_consume, count(*) FILTER (WHERE event = 'transfer') AS n_transfer,
    CAST(coalesce(sum(CASE WHEN byte_count = 0 THEN 64 ELSE byte_count END) FILTER (WHERE event = 'construct'), 0) AS BIGINT) AS bytes_materialized, CAST(coalesce(sum(byte_count) FILTER (WHERE event = 'transfer'), 0) AS BIGINT) AS transfer_bytes,
    greatest(1, count(DISTINCT s) + count(*) FILTER (WHERE event = 'mutate' AND mutation = 'm1')) AS required FROM tr GROUP BY 1),
    u AS (SELECT information_id, sum(b) AS ub FROM (SELECT information_id, min_by(byte_count, sequence) AS b FROM tr WHERE event = 'transfer' GROUP BY information_id, semantic_identity, equivalence_key, destination, placement) GROUP BY 1), w AS ({_WASTE}),
    a AS (SELECT m.*, n_construct / CAST(required AS DOUBLE) AS realization_ratio, coalesce(w.waste, 0) AS retention_waste, CASE WHEN coalesce(ub, 0) > 0 THEN transfer_bytes / CAST(ub AS DOUBLE) ELSE 1 END AS transfer_ratio FROM m LEFT JOIN u USING (information_id) LEFT JOIN w USING (information_id))"""


@R.add("agg17_trace_attribution", f"WITH {_TR}, {_ATTR} SELECT information_id, n_construct, n_consume, n_transfer, bytes_materialized, transfer_bytes, required, round(realization_ratio, 9) AS realization_ratio, round(retention_waste, 9) AS retention_waste, round(transfer_ratio, 9) AS transfer_ratio FROM a")
def agg17_trace_attribution(spark, sf_dir):
    a = tr.attribution(*_trace(spark, sf_dir))
    return a.select("information_id", "n_construct", "n_consume", "n_transfer", "bytes_materialized", "transfer_bytes", "required", *[F.round(c, 9).alias(c) for c in ("realization_ratio", "retention_waste", "transfer_ratio")])


@R.add("agg19_transfer_redundancy", f"WITH {_TR}, {_ATTR} SELECT information_id, round(transfer_ratio, 9) AS transfer_ratio FROM a")
def agg19_transfer_redundancy(spark, sf_dir):
    return agg17_trace_attribution(spark, sf_dir).select("information_id", "transfer_ratio")


@R.add("life04_summary", f"WITH {_TR}, {_ATTR} SELECT count(*) FILTER (WHERE realization_ratio > 1) AS repeated_realization_items, count(*) FILTER (WHERE retention_waste >= 0.5) AS over_retained_items, count(*) FILTER (WHERE transfer_ratio > 1) AS redundant_transfer_items FROM a")
def life04_summary(spark, sf_dir):
    return tr.summary(tr.attribution(*_trace(spark, sf_dir)))


@R.add("agg20_trace_quality", f"WITH {_TR}, w AS ({_WASTE}), k AS (SELECT information_id, list(DISTINCT event) AS ks, count(*) FILTER (WHERE event = 'construct') AS c, count(*) FILTER (WHERE event = 'transfer') AS t, count(*) FILTER (WHERE event = 'consume') AS u FROM tr GROUP BY 1), q AS (SELECT k.information_id, ks, c, t, u, coalesce(waste, 0) > 0 OR list_has_all(ks, ['construct', 'consume', 'retire']) AS stay FROM k LEFT JOIN w USING (information_id)) SELECT information_id, round(CASE WHEN list_has_any(ks, ['construct', 'transfer']) THEN 0.2 ELSE 0 END + CASE WHEN list_has_any(ks, ['consume']) THEN 0.2 ELSE 0 END + CASE WHEN list_has_any(ks, ['publish', 'transfer']) THEN 0.2 ELSE 0 END + CASE WHEN list_has_any(ks, ['retire', 'destroy', 'mutate']) THEN 0.2 ELSE 0 END + CASE WHEN c > 1 OR t > 1 OR u > 1 OR stay THEN 0.1 ELSE 0 END + 0.1, 3)::DOUBLE AS score, (c > 1)::INTEGER + (t > 1)::INTEGER + (u > 1)::INTEGER + stay::INTEGER AS modes FROM q")
def agg20_trace_quality(spark, sf_dir):
    return tr.trace_quality(*_trace(spark, sf_dir)).select("information_id", "score", F.size("modes").alias("modes"))


@R.add("src01_trace_errors", f"WITH {_TR} SELECT count(*) AS errors FROM tr WHERE event NOT IN ('construct','publish','consume','mutate','invalidate','retire','destroy','transfer')")
def src01_trace_errors(spark, sf_dir):
    return tr.trace_errors(*_trace(spark, sf_dir)).agg(F.count(F.lit(1)).alias("errors"))


_REPLAY = f"""{_TR}, e AS (SELECT information_id, semantic_identity, sequence, event, mutation, CASE WHEN sequence % 11 > 0 THEN s END AS inst, mutation IN ('m0', 'm1') AS declared FROM tr),
    a AS (SELECT *, sum((event = 'mutate' AND mutation = 'm1')::INTEGER) OVER i AS version, sum((event = 'invalidate')::INTEGER) OVER i AS swept FROM e WHERE inst IS NOT NULL WINDOW i AS (PARTITION BY information_id, semantic_identity ORDER BY sequence)),
    b AS (SELECT *, sum((event IN ('retire', 'destroy'))::INTEGER) OVER k AS gone, max((event = 'construct')::INTEGER) OVER k AS ever FROM a WINDOW k AS (PARTITION BY information_id, semantic_identity, inst ORDER BY sequence)),
    x AS (SELECT b.information_id, b.semantic_identity, b.sequence, b.inst, b.swept, b.gone, b.version, arg_max(c.version, c.sequence) AS made FROM b LEFT JOIN b c ON c.event = 'construct' AND c.information_id = b.information_id AND c.semantic_identity = b.semantic_identity AND c.inst = b.inst AND c.swept = b.swept AND c.gone = b.gone AND c.sequence < b.sequence WHERE b.event = 'consume' GROUP BY ALL),
    y AS (SELECT x.*, min(c.sequence) AS begun FROM x LEFT JOIN b c ON c.event = 'construct' AND c.version = x.made AND c.information_id = x.information_id AND c.semantic_identity = x.semantic_identity AND c.inst = x.inst AND c.swept = x.swept AND c.gone = x.gone AND c.sequence < x.sequence GROUP BY ALL),
    z AS (SELECT y.*, max(c.sequence) AS told FROM y LEFT JOIN b c ON c.event = 'publish' AND c.information_id = y.information_id AND c.semantic_identity = y.semantic_identity AND c.inst = y.inst AND c.swept = y.swept AND c.gone = y.gone AND c.sequence < y.sequence GROUP BY ALL),
    r AS (SELECT information_id, 'candidate scope instance missing' AS reason FROM e WHERE inst IS NULL UNION ALL SELECT information_id, 'undeclared mutation' FROM b WHERE event = 'mutate' AND NOT declared
      UNION ALL SELECT information_id, 'publish before construction' FROM b WHERE event = 'publish' AND ever = 0
      UNION ALL SELECT information_id, CASE WHEN made IS NULL THEN 'read outside valid realization lifetime' WHEN NOT coalesce(told > begun, false) THEN 'read before publication' WHEN made <> version THEN 'stale realization read' END FROM z)"""


def _replayed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every eleventh event lacks the scope; the candidate does not clear on the invalidating mutation, so stale reads occur."""
    events, items = _trace(spark, sf_dir)
    scopes = F.when(F.col("sequence") % 11 > 0, F.col("scope_instances")).otherwise(F.create_map().cast("map<string,string>"))
    return events.withColumn("scope_instances", scopes), items


@R.add("stream11_replay", f"""WITH {_TR}, q AS (SELECT information_id, count(*) FILTER (WHERE event = 'consume' AND sequence % 11 > 0) AS observations, count(*) FILTER (WHERE sequence % 11 = 0 OR (event = 'mutate' AND mutation = 'm2')) AS failures FROM tr GROUP BY 1)
    SELECT information_id, observations, failures, CASE WHEN failures = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM q""")
def stream11_replay(spark, sf_dir):
    """Verdict for a candidate that hands values directly to their consumer: nothing is kept, so only the trace itself can fail."""
    events, items = _replayed(spark, sf_dir)
    return tr.replay(events, items, "scope", [], mode="direct_consumer")


@R.add("stream11_replay_reasons", f"WITH {_REPLAY} SELECT information_id, reason, count(*) AS n FROM r GROUP BY ALL")
def stream11_replay_reasons(spark, sf_dir):
    """Failures of a retaining candidate, by item and reason; a NULL reason counts the reads without fault."""
    events, items = _replayed(spark, sf_dir)
    f = tr.replay_failures(events, items, "scope", [])
    return f.groupBy("information_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def _lifetime_items(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    events, items = _trace(spark, sf_dir)
    scopes = F.array(F.lit("s1"), F.lit("s2"), F.lit("s9"))
    i = items.select("*", F.when(F.col("id") == "click", F.array(F.lit("derived"))).when(F.col("id") == "view", F.array(F.lit("serialized_body"))).otherwise(F.array(F.lit("mixed_mutability"))).alias("traits"),
                     scopes.alias("candidate_scopes"), F.array(F.lit("heap"), F.lit("device")).alias("candidate_placements"), F.lit("s2").alias("current_scope"), F.lit("heap").alias("current_placement"), F.lit("s2").alias("consumer_scope"),
                     (F.col("id") != "purchase").alias("fallback"), F.lit("immutable").alias("consistency"), F.lit(False).alias("independent_observer"))
    contains = spark.createDataFrame([("s1", "s1"), ("s2", "s2"), ("s1", "s2")], "outer_scope string, inner_scope string")
    return i, tr.attribution(events, items), contains


@R.add("life01_candidates", f"WITH {_TR}, {_ATTR}, s AS (SELECT * FROM (VALUES ('s1'), ('s2'), ('s9')) s(candidate_scope)), p AS (SELECT * FROM (VALUES ('heap'), ('device')) p(candidate_placement)), f AS (SELECT information_id AS id, realization_ratio AS rr, retention_waste AS rw, transfer_ratio AS tt FROM a) "
       "SELECT id, 'serialization-body-reuse' AS family, candidate_scope, candidate_placement FROM f, s, p WHERE id = 'view' AND rr > 1 UNION ALL SELECT id, 'repeated-derivation-elimination', candidate_scope, candidate_placement FROM f, s, p WHERE id = 'click' AND rr > 1 "
       "UNION ALL SELECT id, 'immutable-mutable-projection-split', candidate_scope, candidate_placement FROM f, s, p WHERE id NOT IN ('view', 'click') UNION ALL SELECT id, 'intermediate-realization-elimination', 's2', 'heap' FROM f WHERE rw >= 0.5 UNION ALL SELECT id, 'placement-resident-state', candidate_scope, candidate_placement FROM f, s, p WHERE tt > 1 AND candidate_placement <> 'heap'")
def life01_candidates(spark, sf_dir):
    i, a, c = _lifetime_items(spark, sf_dir)
    return tr.candidates(i, a, c).drop("mode")


_DIAG = """array_to_string(list_filter([CASE WHEN candidate_scope = 's9' THEN 'candidate scope is undeclared' END, CASE WHEN candidate_scope = 's9' THEN 'candidate scope does not contain consumer scope' END,
    CASE WHEN candidate_scope = 's9' AND family <> 'intermediate-realization-elimination' THEN 'lifetime extension scope does not contain the current scope' END, CASE WHEN id = 'purchase' THEN 'candidate has no fallback' END], lambda d: d IS NOT NULL), '; ')"""


@R.add("life02_legality", f"SELECT id, family, candidate_scope, candidate_placement, {_DIAG} AS diagnostics FROM ({R.sql['life01_candidates']})")
def life02_legality(spark, sf_dir):
    i, a, c = _lifetime_items(spark, sf_dir)
    return tr.legality(tr.candidates(i, a, c), i, c).select("id", "family", "candidate_scope", "candidate_placement", F.array_join("diagnostics", "; ").alias("diagnostics"))


@R.add("life03_costs", f"WITH {_TR}, {_ATTR} SELECT information_id, CAST(n_construct * 100 + n_consume * 5 + n_transfer * 40 AS BIGINT) AS baseline_ns, CAST(required * 100 + n_consume * 5 + n_transfer * 40 AS BIGINT) AS candidate_ns FROM a")
def life03_costs(spark, sf_dir):
    a = tr.attribution(*_trace(spark, sf_dir))
    use = F.col("n_consume") * 5 + F.col("n_transfer") * 40
    return a.select("information_id", (F.col("n_construct") * 100 + use).alias("baseline_ns"), (F.col("required") * 100 + use).alias("candidate_ns"))


@R.add("life05_confusion", f"WITH {_TR}, {_ATTR} SELECT CASE WHEN realization_ratio > 1 THEN 'reuse' ELSE 'none' END AS found, CASE WHEN information_id IN ('view', 'click') THEN 'reuse' ELSE 'none' END AS expected, count(*) AS n FROM a GROUP BY ALL")
def life05_confusion(spark, sf_dir):
    a = tr.attribution(*_trace(spark, sf_dir))
    return a.groupBy(F.when(F.col("realization_ratio") > 1, "reuse").otherwise("none").alias("found"), F.when(F.col("information_id").isin("view", "click"), "reuse").otherwise("none").alias("expected")).agg(F.count(F.lit(1)).alias("n"))


@R.add("life06_obligations", f"SELECT id, family, candidate_scope, candidate_placement, candidate_scope <> 's9' AS scope_declared, id <> 'purchase' AS has_fallback, {_DIAG} = '' AS legal FROM ({R.sql['life01_candidates']})")
def life06_obligations(spark, sf_dir):
    """Structural obligations of each candidate as boolean columns."""
    i, a, c = _lifetime_items(spark, sf_dir)
    l = tr.legality(tr.candidates(i, a, c), i, c)
    return l.select("id", "family", "candidate_scope", "candidate_placement", (~F.array_contains("diagnostics", "candidate scope is undeclared")).alias("scope_declared"), (~F.array_contains("diagnostics", "candidate has no fallback")).alias("has_fallback"), (F.size("diagnostics") == 0).alias("legal"))
