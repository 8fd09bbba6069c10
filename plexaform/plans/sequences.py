"""Queries of the sequence family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sequences as sq
from ..session import load
from .registry import Registry

R = Registry()

CENTS = "CAST(floor(value * 100 + 0.5) AS BIGINT)"
SNAP_SQL = "snap AS (SELECT o_orderkey AS i, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS b, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) + o_orderkey % 3 AS v FROM orders)"
EV_SQL = f"ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type, value, {CENTS} AS cents FROM events)"


def _snap(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = load(spark, sf_dir, "orders").selectExpr("o_orderkey AS i", "CAST(floor(o_totalprice * 100 + 0.5D) AS BIGINT) AS v")
    return o.withColumn("v", F.col("v") + F.col("i") % 3), o


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).cast("bigint").alias("i"), "event_type", "value", F.expr("CAST(floor(value * 100 + 0.5D) AS BIGINT)").alias("cents"))


@R.add("seq01_compaction", f"WITH {SNAP_SQL} SELECT i, v FROM snap WHERE v <> b")
def seq01_compaction(spark, sf_dir):
    return sq.changed(*_snap(spark, sf_dir), "i", "v")


@R.add("seq02_index_only", f"WITH {SNAP_SQL} SELECT i FROM snap WHERE v <> b")
def seq02_index_only(spark, sf_dir):
    return sq.changed(*_snap(spark, sf_dir), "i", "v").select("i")


@R.add("seq02_value_only", f"WITH {SNAP_SQL} SELECT v FROM snap WHERE v <> b")
def seq02_value_only(spark, sf_dir):
    return sq.changed(*_snap(spark, sf_dir), "i", "v").select("v")


@R.add("seq03_fail_unchanged", f"WITH {SNAP_SQL}, s AS (SELECT i, v FROM snap WHERE v <> b) SELECT i, v FROM s WHERE (SELECT count(*) FROM s) <= 1000")
def seq03_fail_unchanged(spark, sf_dir):
    return sq.with_capacity(sq.changed(*_snap(spark, sf_dir), "i", "v"), "i", 1000, "fail-unchanged")


@R.add("seq03_status", f"WITH {SNAP_SQL} SELECT count(*) AS selected, CASE WHEN count(*) <= 1000 THEN count(*) ELSE -1 END AS status FROM snap WHERE v <> b")
def seq03_status(spark, sf_dir):
    return sq.capacity_status(sq.changed(*_snap(spark, sf_dir), "i", "v"), 1000)


@R.add("seq04_fail_input_extent", f"WITH {SNAP_SQL} SELECT i, v FROM snap WHERE v <> b AND (SELECT count(*) FROM orders) <= 1000000000")
def seq04_fail_input_extent(spark, sf_dir):
    cur, base = _snap(spark, sf_dir)
    return sq.with_capacity(sq.changed(cur, base, "i", "v"), "i", 10**9, "fail-input-extent-unchanged", cur)


@R.add("seq05_truncate", f"WITH {SNAP_SQL} SELECT i, v FROM snap WHERE v <> b ORDER BY i LIMIT 500")
def seq05_truncate(spark, sf_dir):
    return sq.with_capacity(sq.changed(*_snap(spark, sf_dir), "i", "v"), "i", 500, "truncate")


@R.add("seq06_mask_scatter", f"WITH {SNAP_SQL} SELECT i, v, row_number() OVER (ORDER BY i) - 1 AS \"offset\" FROM snap WHERE v <> b")
def seq06_mask_scatter(spark, sf_dir):
    cur, base = _snap(spark, sf_dir)
    both = cur.join(base.select(F.col("i").alias("bi"), F.col("v").alias("b")), F.col("i") == F.col("bi")).drop("bi")
    return sq.offsets_by_mask(both, "i", F.col("v") != F.col("b")).select("i", "v", "offset")


@R.add("seq07_narrow_compaction", "SELECT p_partkey AS i, CAST(p_size AS SMALLINT) AS v FROM part WHERE p_size % 256 <> (p_size + p_partkey % 2) % 256")
def seq07_narrow_compaction(spark, sf_dir):
    base = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.pmod(F.col("p_size") + F.col("p_partkey") % 2, F.lit(256)).cast("smallint").alias("v"))
    cur = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("smallint").alias("v"))
    return sq.changed(cur, base, "i", "v")


@R.add("seq09_two_level_offsets", f"WITH {SNAP_SQL} SELECT i, v, row_number() OVER (ORDER BY i) - 1 AS slot FROM snap WHERE v <> b")
def seq09_two_level_offsets(spark, sf_dir):
    return sq.global_index(sq.changed(*_snap(spark, sf_dir), "i", "v"), ["i"], "slot")


@R.add("seq10_delta", f"WITH {SNAP_SQL} SELECT i, v FROM snap WHERE v <> b")
def seq10_delta(spark, sf_dir):
    return sq.transduce(*_snap(spark, sf_dir), "i", "v", 10**9)[0]


@R.add("seq10_next_state", f"WITH {SNAP_SQL} SELECT i, v FROM snap")
def seq10_next_state(spark, sf_dir):
    return sq.transduce(*_snap(spark, sf_dir), "i", "v", 10**9)[1]


@R.add("seq10_rejected_state", f"WITH {SNAP_SQL} SELECT i, CASE WHEN (SELECT count(*) FROM snap WHERE v <> b) <= 10 THEN v ELSE b END AS v FROM snap")
def seq10_rejected_state(spark, sf_dir):
    return sq.transduce(*_snap(spark, sf_dir), "i", "v", 10)[1]


@R.add("seq11_codec", """SELECT l_orderkey, l_linenumber, (l_partkey & 65535) | ((l_suppkey & 65535) << 16) | ((l_orderkey & 2147483647) << 32) AS word FROM lineitem""")
def seq11_codec(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", sq.pack_fields([F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")], [16, 16, 31]).alias("word"))


@R.add("seq11_codec_round_trip", "SELECT l_orderkey, l_linenumber, l_partkey & 65535 AS f0, l_suppkey & 65535 AS f1, l_orderkey & 4294967295 AS f2 FROM lineitem")
def seq11_codec_round_trip(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").withColumn("word", sq.pack_fields([F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")], [16, 16, 32], big_endian=True))
    f = sq.unpack_fields(F.col("word"), [16, 16, 32], big_endian=True)
    return li.select("l_orderkey", "l_linenumber", *[c.alias(f"f{i}") for i, c in enumerate(f)])


@R.add("seq12_prefix_sum", f"WITH {EV_SQL} SELECT user_id, i, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY i) AS BIGINT) AS s FROM ev")
def seq12_prefix_sum(spark, sf_dir):
    return _events(spark, sf_dir).select("user_id", "i", F.sum("cents").over(sq.running(["user_id"], ["i"])).alias("s"))


@R.add("seq12_global_prefix_sum", f"SELECT event_id, CAST(sum({CENTS}) OVER (ORDER BY ts, event_id) AS BIGINT) AS s FROM events")
def seq12_global_prefix_sum(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("ts", "event_id", F.expr("CAST(floor(value * 100 + 0.5D) AS BIGINT)").alias("cents"))
    return sq.global_prefix_sum(e, ["ts", "event_id"], "cents", "s").select("event_id", "s")


@R.add("seq13_running_max", f"WITH {EV_SQL} SELECT user_id, i, max(value) OVER (PARTITION BY user_id ORDER BY i) AS m FROM ev")
def seq13_running_max(spark, sf_dir):
    return _events(spark, sf_dir).select("user_id", "i", sq.running_max("value", sq.running(["user_id"], ["i"])).alias("m"))


@R.add("seq14_recurrence", """SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY ts, event_id)), lambda y, x: y * 0.875::DOUBLE + x * 0.125::DOUBLE), 9) AS y FROM events GROUP BY user_id""")
def seq14_recurrence(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    y = sq.long_recurrence(e, ["ts", "event_id"], "value", 0.875, 0.125, "y", ["user_id"])
    return y.groupBy("user_id").agg(F.round(F.max_by("y", F.struct("ts", "event_id")), 9).alias("y"))


@R.add("seq14_folded_recurrence", R.sql["seq14_recurrence"])
def seq14_folded_recurrence(spark, sf_dir):
    """The same as a fold over collected arrays, for sequences known to be short."""
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("a"))
    return e.select("user_id", F.round(sq.affine_recurrence(F.transform("a", lambda s: s.value), 0.875, 0.125), 9).alias("y"))


@R.add("seq14_long_recurrence", """WITH RECURSIVE n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS k FROM events), b AS (SELECT k, event_id, sum(value * 0.125::DOUBLE * pow(0.875::DOUBLE, -(k % 400))) OVER (PARTITION BY k // 400 ORDER BY k) * pow(0.875::DOUBLE, k % 400) AS own FROM n),
    e AS (SELECT k // 400 AS g, max(k % 400) + 1 AS len, max_by(own, k) AS own FROM b GROUP BY 1), c AS (SELECT min(g) AS g, 0.0::DOUBLE AS y FROM e UNION ALL SELECT c.g + 1, e.own + pow(0.875::DOUBLE, CASE WHEN e.g = 0 THEN e.len - 1 ELSE e.len END) * c.y FROM c JOIN e ON e.g = c.g)
    SELECT event_id, round(own + pow(0.875::DOUBLE, CASE WHEN k < 400 THEN k ELSE k % 400 + 1 END) * c.y, 6) AS y FROM b JOIN c ON c.g = k // 400""")
def seq14_long_recurrence(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("ts", "event_id", "value")
    return sq.long_recurrence(e, ["ts", "event_id"], "value", 0.875, 0.125, "y").select("event_id", F.round("y", 6).alias("y"))


@R.add("seq15_stencil3", f"WITH {EV_SQL}, n AS (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS r FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, i, CASE WHEN l IS NULL OR r IS NULL THEN value ELSE l * 0.25::DOUBLE + value * 0.5::DOUBLE + r * 0.25::DOUBLE END AS y FROM n")
def seq15_stencil3(spark, sf_dir):
    return _events(spark, sf_dir).select("user_id", "i", sq.stencil3("value", ["user_id"], ["i"]).alias("y"))


@R.add("seq16_average5", f"WITH {EV_SQL}, n AS (SELECT *, lag(value,2) OVER w AS a, lag(value) OVER w AS b, lead(value) OVER w AS c, lead(value,2) OVER w AS d FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, i, CASE WHEN a IS NULL OR d IS NULL THEN value ELSE (a + b + value + c + d) * 0.2::DOUBLE END AS y FROM n")
def seq16_average5(spark, sf_dir):
    return _events(spark, sf_dir).select("user_id", "i", sq.centred_average("value", ["user_id"], ["i"]).alias("y"))


_MIX = "WITH s AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_totalprice AS v, count(*) OVER () AS n FROM orders) SELECT a.i, b.v * 0.75::DOUBLE + a.v * 0.25::DOUBLE AS y FROM s a JOIN s b ON b.i = (a.i * {k}) % a.n"


@R.add("seq17_stride_mix", _MIX.format(k=17))
def seq17_stride_mix(spark, sf_dir):
    o = sq.global_index(load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v")), ["o_orderkey"], "i")
    return sq.strided_mix(o, "i", "v", 17, 0.75, 0.25, "y").select("i", "y")


@R.add("seq18_indirect_stride", _MIX.format(k=5))
def seq18_indirect_stride(spark, sf_dir):
    o = sq.global_index(load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v")), ["o_orderkey"], "i")
    return sq.strided_mix(o, "i", "v", 5, 0.75, 0.25, "y").select("i", "y")


@R.add("seq20_prefix_extent", f"WITH {EV_SQL} SELECT user_id, coalesce(min(i) FILTER (WHERE NOT value < 400), count(*)) AS extent FROM ev GROUP BY user_id")
def seq20_prefix_extent(spark, sf_dir):
    return sq.prefix_extent(_events(spark, sf_dir), ["user_id"], "i", F.col("value") < 400)


@R.add("seq21_suffix_extent", f"WITH {EV_SQL} SELECT user_id, coalesce(count(*) - 1 - max(i) FILTER (WHERE NOT value < 400), count(*)) AS extent FROM ev GROUP BY user_id")
def seq21_suffix_extent(spark, sf_dir):
    return sq.suffix_extent(_events(spark, sf_dir), ["user_id"], "i", F.col("value") < 400)


@R.add("seq22_common_prefix", f"WITH {EV_SQL}, b AS (SELECT user_id + 1 AS user_id, i, event_type FROM ev), j AS (SELECT ev.user_id, ev.i, ev.event_type = b.event_type AS same FROM ev JOIN b ON ev.user_id = b.user_id AND ev.i = b.i) SELECT user_id, coalesce(min(i) FILTER (WHERE NOT same), count(*)) AS extent FROM j GROUP BY user_id")
def seq22_common_prefix(spark, sf_dir):
    """Common prefix of each user's event types with those of the user before."""
    e = _events(spark, sf_dir).select("user_id", "i", "event_type")
    return sq.common_extent(e, e.withColumn("user_id", F.col("user_id") + 1), "user_id", "i", "event_type")


@R.add("seq23_traffic", "SELECT CAST(sum(l_quantity) FILTER (WHERE l_shipdate < TIMESTAMP '1995-01-01') AS DECIMAL(20,2)) AS materialized, CAST(coalesce(sum(l_quantity) FILTER (WHERE NOT l_shipdate < TIMESTAMP '1995-01-01'), 0) AS DECIMAL(20,2)) AS streamed FROM lineitem")
def seq23_traffic(spark, sf_dir):
    """Bytes (here quantities) of materialized and of streamed edges in one aggregate."""
    early = F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz")
    q = F.col("l_quantity").cast("decimal(12,2)")
    return load(spark, sf_dir, "lineitem").agg(F.sum(F.when(early, q)).cast("decimal(20,2)").alias("materialized"), F.coalesce(F.sum(F.when(~early, q)), F.lit(0)).cast("decimal(20,2)").alias("streamed"))


@R.add("seq24_interleave", """SELECT o_orderkey, upper(substr(a,1,8)||substr(b,1,8)||substr(a,9,8)||substr(b,9,8)) AS packed, a || b AS inverse FROM (
    SELECT o_orderkey, md5(o_orderstatus || o_orderkey)[1:16] AS a, md5(o_orderpriority || o_orderkey)[1:16] AS b FROM orders)""")
def seq24_interleave(spark, sf_dir):
    half = lambda c: F.unhex(F.substring(F.md5(F.concat(c, F.col("o_orderkey").cast("string"))), 1, 16))
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.array(half("o_orderstatus"), half("o_orderpriority")).alias("p"))
    o = o.withColumn("w", sq.interleave(F.col("p"), 4))
    back = F.flatten(F.transform(F.array(sq.deinterleave(F.col("w"), 2, 4)), lambda a: F.array(F.hex(a[0]), F.hex(a[1]))))
    return o.select("o_orderkey", F.hex("w").alias("packed"), F.lower(F.array_join(back, "")).alias("inverse"))


@R.add("seq25_columns_of_records", """SELECT o_custkey, block, list(o_orderkey ORDER BY o_orderkey) AS keys, list(o_orderstatus ORDER BY o_orderkey) AS states
    FROM (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 64 AS block FROM orders) GROUP BY o_custkey, block""")
def seq25_columns_of_records(spark, sf_dir):
    """Records to columns in blocks of 64 records: places come from one order over all records, so a key of any size is shared among tasks."""
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    placed = sq.global_index(o, ["o_custkey", "o_orderkey"], "i")
    first = o.groupBy(F.col("o_custkey").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    first = sq.global_prefix_sum(first, ["c"], "n", "upto").select("c", (F.col("upto") - F.col("n")).alias("first"))
    a = placed.join(first, F.col("o_custkey") == F.col("c")).withColumn("block", F.floor((F.col("i") - F.col("first")) / 64))
    a = a.groupBy("o_custkey", "block").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("r"))
    return a.select("o_custkey", "block", F.transform("r", lambda x: x.o_orderkey).alias("keys"), F.transform("r", lambda x: x.o_orderstatus).alias("states"))


@R.add("seq26_ewma", """SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY ts, event_id)), lambda r, v: r + 0.25::DOUBLE * (v - r)), 9) AS r FROM events GROUP BY user_id""")
def seq26_ewma(spark, sf_dir):
    """The average at the end of each sequence, which may span any number of partitions."""
    e = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    y = sq.long_recurrence(e, ["ts", "event_id"], "value", 0.75, 0.25, "y", ["user_id"])
    return y.groupBy("user_id").agg(F.round(F.max_by("y", F.struct("ts", "event_id")), 9).alias("r"))
