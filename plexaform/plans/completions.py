"""Further queries: recognised shapes, differentials, store and file round trips, gates, scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pointwise as pw
from ..operators import datasets as ds
from ..operators import learning, market as mk, resampling
from ..operators import sequences as sq
from ..session import Scratch, load
from ..sources import files, logs
from .registry import Registry

R = Registry()


@R.add("map21_recognised_shapes", "SELECT c_custkey, least(greatest(x, -1), 1) AS clamp, x * 0.5::DOUBLE AS halved FROM (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer)")
def map21_recognised_shapes(spark, sf_dir):
    """Clamp and power-of-two division in their recognised forms give what the plain forms give."""
    x = F.col("c_acctbal") / F.lit(1000.0)
    return load(spark, sf_dir, "customer").select("c_custkey", pw.clamp(x, -1.0, 1.0).alias("clamp"), pw.divide(x, 2.0).alias("halved"))


@R.add("map27_softmax", "SELECT c_custkey, round(exp(s - max(s) OVER w) / sum(exp(s - m)) OVER w, 12) AS p FROM (SELECT c_custkey, c_nationkey, c_acctbal / 1000 / greatest(0.05::DOUBLE, 2.0::DOUBLE) AS s, max(c_acctbal / 1000 / 2.0::DOUBLE) OVER (PARTITION BY c_nationkey) AS m FROM customer) WINDOW w AS (PARTITION BY c_nationkey)")
def map27_softmax(spark, sf_dir):
    """Per group, with a floor of 0.05 on the temperature and the maximum subtracted."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") / 1000 / max(0.05, 2.0)).alias("s"))
    top = c.groupBy(F.col("c_nationkey").alias("g")).agg(F.max("s").alias("m"))
    e = c.join(top, F.col("c_nationkey") == F.col("g")).withColumn("e", F.exp(F.col("s") - F.col("m")))
    t = e.groupBy(F.col("g").alias("h")).agg(F.sum("e").alias("t"))
    return e.join(t, F.col("g") == F.col("h")).select("c_custkey", F.round(F.col("e") / F.col("t"), 12).alias("p"))


@R.add("seq19_differential", "SELECT count(*) AS prefix, CAST(sum(floor(value)) AS BIGINT) AS total, (SELECT count(*) FROM orders WHERE o_orderkey % 3 > 0) AS compaction FROM events")
def seq19_differential(spark, sf_dir):
    """Two formulations of each family must agree: rows on which they do, and the sum of all values."""
    e = load(spark, sf_dir, "events").select("ts", "event_id", F.floor("value").cast("bigint").alias("v"), "value")
    a = sq.global_prefix_sum(e, ["ts", "event_id"], "v", "s").select(F.col("event_id").alias("k"), "s")
    day = e.withColumn("d", F.col("ts").cast("date"))
    totals = day.groupBy("d").agg(F.sum("v").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = day.withColumn("l", F.sum("v").over(Window.partitionBy("d").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    b = local.join(totals.select(F.col("d").alias("d2"), "before"), F.col("d") == F.col("d2")).select("ts", "event_id", (F.col("l") + F.col("before")).alias("s2"))
    prefix = a.join(b, F.col("k") == F.col("event_id")).agg(F.count_if(F.col("s") == F.col("s2"))).scalar()
    o = load(spark, sf_dir, "orders").selectExpr("o_orderkey AS i", "o_orderkey % 3 AS m")
    x = sq.offsets_by_mask(o, "i", F.col("m") > 0).select("i", "offset")
    y = sq.global_index(o.where("m > 0"), ["i"], "n").select(F.col("i").alias("j"), "n")
    compaction = x.join(y, F.col("i") == F.col("j"), "full_outer").agg(F.count_if(F.col("offset") == F.col("n"))).scalar()
    total = b.agg(F.max_by("s2", F.struct("ts", "event_id"))).scalar()
    return spark.range(1).select(prefix.alias("prefix"), total.alias("total"), compaction.alias("compaction"))


@R.add("kern17_step_status", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN -1 WHEN 1 THEN -2 ELSE 0 END AS native, CASE event_id % 5 WHEN 0 THEN -2 WHEN 1 THEN -2 ELSE 0 END AS pipeline FROM events")
def kern17_step_status(spark, sf_dir):
    """Both status conventions of a step: a wrong length is -1 or -2, any other invalid message -2."""
    good = mk.encode_event(F.lit(1), F.lit(0), F.lit(mk.BASE_TICK) + F.col("event_id") % mk.LEVELS, F.lit(5), F.col("event_id") + 1)
    bad = mk.encode_event(F.lit(9), F.lit(0), F.lit(mk.BASE_TICK), F.lit(5), F.col("event_id") + 1)
    k = F.col("event_id") % 5
    e = load(spark, sf_dir, "events").select("event_id", F.when(k == 0, F.unhex(F.lit("0102"))).when(k == 1, bad).otherwise(good).alias("raw"))
    d = e.select("event_id", F.octet_length("raw").alias("n"), mk.decode_event(F.col("raw")).alias("d"))
    valid = F.col("d.kind").isin(1, 2, 3) & F.col("d.side").isin(0, 1) & (F.col("d.price_ticks") - mk.BASE_TICK).between(0, mk.LEVELS - 1) & (F.col("d.quantity") >= 0)
    return d.select("event_id", F.when(F.col("n") != 18, -1).when(~valid, -2).otherwise(0).alias("native"), F.when((F.col("n") != 18) | ~valid, -2).otherwise(0).alias("pipeline"))


@R.add("boot13_minimised_failure", "SELECT n_name FROM nation WHERE n_regionkey = 2")
def boot13_minimised_failure(spark, sf_dir):
    """A sequence that fails as long as it holds every nation of region 2 is cut down to just those."""
    rows = [(r["n_name"], r["n_regionkey"]) for r in load(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # one test sequence
    needed = {x for x in rows if x[1] == 2}
    return spark.createDataFrame([(n,) for n, _ in resampling.minimise_failure(rows, lambda s: needed <= set(s))] or [(None,)], "n_name string").where("n_name is not null")


@R.add("codec10_trace_round_trip", "SELECT i - 1 AS position, i % 3 + 1 AS kind, CAST(i AS DECIMAL(20,0)) AS sequence FROM range(1, 201) t(i)")
def codec10_trace_round_trip(spark, sf_dir):
    """An adversarial trace of 200 messages is encoded, written with its header, read back and decoded."""
    t = mk.adversarial_trace(spark, 200)
    raw = t.select("position", mk.encode_event(F.col("kind"), F.col("side"), F.col("price_ticks"), F.col("quantity"), F.col("sequence")).alias("raw"))
    path = f"{Scratch(spark).root}/adversarial.trace"
    files.write_binary_trace(spark, path, raw, "position", "raw", 7)
    d = files.read_binary_trace(spark, path).select("position", mk.decode_event(F.col("message")).alias("d"))
    return d.select(F.col("position").cast("bigint").alias("position"), F.col("d.kind").cast("bigint").alias("kind"), "d.sequence")


@R.add("src03_store_append", "SELECT count(*) AS stored, 0::BIGINT AS added_again FROM orders")
def src03_store_append(spark, sf_dir):
    store = ds.Store(spark, Scratch(spark).root + "/store")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    n, again = store.append("orders", o, "o_orderkey"), store.append("orders", o, "o_orderkey")
    return spark.createDataFrame([(n, again)], "stored bigint, added_again bigint")


@R.add("src04_store_load", "SELECT count(*) AS n FROM nation")
def src04_store_load(spark, sf_dir):
    from ..operators.graph import ordered_digest
    store = ds.Store(spark, Scratch(spark).root + "/store")
    store.append("nation", load(spark, sf_dir, "nation"), "n_nationkey")
    return ordered_digest(store.load("nation"), ["n_nationkey"], [F.col("n_name")]).select("n")


@R.add("src14_counters", "SELECT 'p' || p_partkey % 5 AS name, CAST(sum(p_size) AS DOUBLE) AS value FROM part GROUP BY 1")
def src14_counters(spark, sf_dir):
    """Evidence as an object and as an array of metrics, read alike."""
    p = load(spark, sf_dir, "part").select(F.concat(F.lit("p"), (F.col("p_partkey") % 5).cast("string")).alias("name"), F.col("p_size").cast("double").alias("value"), (F.col("p_partkey") % 2).alias("layout"))
    g = p.groupBy("name", "layout").agg(F.sum("value").alias("value"))
    text = F.when(F.col("layout") == 0, F.format_string('{"metrics":{"%s":%s}}', "name", F.col("value").cast("string"))).otherwise(F.format_string('{"metrics":[{"name":"%s","value":%s}]}', "name", F.col("value").cast("string")))
    return logs.parse_counters(g.select(text.alias("value"))).groupBy("name").agg(F.sum("value").alias("value"))


@R.add("src16_discovery", "SELECT n_nationkey, n_name FROM nation")
def src16_discovery(spark, sf_dir):
    """Plain and compressed copies of a corpus; of two records with one key the first path's counts."""
    root = Scratch(spark).root
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    n.where("n_nationkey < 15").coalesce(1).write.json(f"{root}/a")
    n.withColumn("n_name", F.when(F.col("n_nationkey") < 15, "later copy").otherwise(F.col("n_name"))).coalesce(1).write.option("compression", "gzip").json(f"{root}/b")
    return files.discover(spark, [f"{root}/a", f"{root}/b"], "n_nationkey", "n_nationkey int, n_name string")


@R.add("src17_sinks", "SELECT n_nationkey, n_name FROM nation")
def src17_sinks(spark, sf_dir):
    root = Scratch(spark).root
    files.write_rows(load(spark, sf_dir, "nation"), f"{root}/rows", "csv", ["n_nationkey", "n_name"])
    return spark.read.schema("n_nationkey int, n_name string").option("header", True).csv(f"{root}/rows")


@R.add("data08_preference_model")
def data08_preference_model(spark, sf_dir):
    """Ensemble of pairwise logistic scorers of parts within a brand: its share of rightly ordered pairs among all held-out ones, and
    the calibrated thresholds on its deviation and residual."""
    p = load(spark, sf_dir, "part").selectExpr("p_brand", "p_partkey", "p_size / 50.0D AS f0", "p_retailprice / 2000.0D AS f1", "p_size * 0.6D / 50 + p_retailprice * 0.4D / 2000 AS u")
    train = Scratch(spark).keep(learning.preference_differences(p.where("p_partkey % 5 > 1"), "p_brand", "p_partkey", ["f0", "f1"], "u"))
    members = learning.train_ensemble(train, 2)
    mean, spread = learning.ensemble([F.col("f0") * a + F.col("f1") * b for a, b in members])
    scored = p.where("p_partkey % 5 < 2").withColumn("score", mean).withColumn("spread", spread).withColumn("residual", F.abs(F.col("score") - F.col("u")))
    counted = learning.ordered_pairs(scored.where("p_partkey % 5 = 0"), "p_brand", "p_partkey", "score", "u")
    limits = learning.calibration(scored.where("p_partkey % 5 = 1"), "spread", "residual")
    held = counted.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), (F.try_divide(F.sum("ordered"), F.sum("pairs")) > 0.95).alias("ordered"))
    return held.withColumn("members", F.lit(len(members))).withColumn("uncertainty", limits.select("uncertainty").scalar()).withColumn("residual", limits.select("residual").scalar())
